"""Packing tokens into windows by Karmarkar-Karp multiway differencing.

A task encodes its documents as they stream by. Whole windows of a long
document are sequences of their own; what is left of each document is an item.
Once the items of ``GROUP`` windows have come together they are packed:
partial partitions are merged by differencing, the two with the largest
spreads first, the fullest windows of one on the emptiest of the other. While
a window exceeds the capacity, the number of windows rises. The gaps that stay
are then filled by cutting up the least filled windows, so that each but the
last is full, and what the last window of a task holds is cut into sequences
of a power of two.

Nothing is shuffled and nothing is counted beforehand: a task holds one group.
Sequence ids start with the number of the task's partition.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kinfold.llm.common import ship, table, text_of

WINDOW = 2048
GROUP = 64  # windows that are packed together
END = 1  # the id after each document
KEPT = 500_000  # words whose ids a task keeps
_NEW = 20_000  # new words that are encoded together
_TEXTS = 64  # texts that are encoded together
# White space that a word cannot be cut off from, since only a single space before a word belongs to it.
_LOOSE = re.compile(r"\s\s|\s\Z")

class Encoder:
    """Ids of whole texts as little-endian 32-bit words.

    The ids are those that ``tokenizers`` gives for the file at ``path``,
    without special tokens added. Words recur, so their ids are kept; new words
    are encoded together from ``ranks``, the same vocabulary as a table of
    ranks. That is only done where a cut before a single space is a cut of the
    tokenizer too; any other text, and any with a special token, goes through
    ``tokenizers`` as a whole.
    """

    def __init__(self, path: str, ranks: str, pattern: str, end: int = END):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.words = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.length = np.zeros(max(table.values()) + 1, np.int64)
        for token, number in table.items():
            self.length[number] = len(token)
        self.kept: dict[str, bytes | None] = {}
        self.end = np.array([end], "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Keep the ids of ``" " + word``; None for words that cannot be cut off."""
        joined = " " + " ".join(words)
        if _LOOSE.search(joined) or any(s in joined for s in self.special):
            odd = {w for w in words if _LOOSE.search(f" {w}") or any(s in w for s in self.special)}
            self.kept.update(dict.fromkeys(odd))
            words = [w for w in words if w not in odd]
            joined = " " + " ".join(words)
        if not words:
            return
        ids = np.array(self.words.encode_ordinary(joined), "<u4")
        data = joined.encode()
        starts = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)[1:]
        ends = np.searchsorted(np.cumsum(self.length[ids]), starts) + 1
        cuts = [0, *(ends * 4).tolist(), 4 * len(ids)]
        data = ids.tobytes()
        self.kept.update(zip(words, [data[a:b] for a, b in itertools.pairwise(cuts)], strict=True))

    def _wholly(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text and the end id."""
        split = [t.split(" ") for t in texts]
        new = list(set(itertools.chain.from_iterable(split)).difference(self.kept))
        if len(self.kept) + len(new) > KEPT:
            self.kept.clear()
            new = list(set(itertools.chain.from_iterable(split)))
        for i in range(0, len(new), _NEW):
            self._learn(new[i : i + _NEW])
        found = []
        for text, words in zip(texts, split, strict=True):
            try:
                rest = b"".join(map(self.kept.__getitem__, words[1:]))
                loose = self.kept[words[0]] is None
            except TypeError:  # a word that cannot be cut off
                loose = True
            if loose:
                found.append((self._wholly(text) if text else b"") + self.end)
            else:
                first = np.array(self.words.encode_ordinary(words[0]), "<u4").tobytes()
                found.append(first + rest + self.end)
        return found


@dataclass(frozen=True)
class Piece:
    """``length`` ids of a document from ``start`` on."""

    doc: tuple  # doc_id and the document's number of ids
    start: int
    ids: bytes

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def cut(self, length: int) -> tuple[Piece, Piece]:
        at = 4 * length
        return Piece(self.doc, self.start, self.ids[:at]), Piece(self.doc, self.start + length, self.ids[at:])


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: indices of ``sizes`` in ``windows`` sets of nearly equal sums.

    A partial partition lists its non-empty sets by falling sum; the others
    are empty.
    """
    heap = [(-size, i, [(size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, two = heapq.heappop(heap)
        alone = windows - len(two)  # sets of the first that meet an empty one
        merged = one[:alone]
        rising = two[::-1]
        for i, (size, members) in enumerate(rising):
            if alone + i < len(one):
                other, others = one[alone + i]
                merged.append((size + other, members + others))
            else:
                merged.append((size, members))
        merged.sort(key=lambda x: -x[0])
        least = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (least - merged[0][0], number, merged))
        number += 1
    sets = [members for _, members in heap[0][2]] if heap else []
    return sets + [[] for _ in range(windows - len(sets))]


def pack_group(items: list[Piece], window: int = WINDOW) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows and the pieces left over, which are less than a window.

    The number of windows rises until the fullest set fits; then the emptiest
    sets are cut up to close the gaps of the others.
    """
    sizes = [p.length for p in items]
    total = sum(sizes)
    number = needed = -(-total // window)
    while True:
        sets = difference(sizes, number)
        fullest = max((sum(sizes[i] for i in s) for s in sets), default=0)
        if fullest <= window:
            break
        number += max(1, number * (fullest - window) // (2 * window))
    sets.sort(key=lambda s: -sum(sizes[i] for i in s))
    full = total // window
    windows = [[items[i] for i in s] for s in sets[:full]]
    spare = [items[i] for s in sets[full:] for i in s][::-1]
    for held in windows:
        gap = window - sum(p.length for p in held)
        while gap:
            piece = spare.pop()
            if piece.length > gap:
                piece, rest = piece.cut(gap)
                spare.append(rest)
            held.append(piece)
            gap -= piece.length
    assert needed - full <= 1 and sum(p.length for p in spare) == total - full * window
    return windows, spare[::-1]


def powers(pieces: list[Piece]) -> list[list[Piece]]:
    """Cut pieces into sequences whose lengths are falling powers of two."""
    left, total, found = pieces[::-1], sum(p.length for p in pieces), []
    while total:
        gap = 1 << (total.bit_length() - 1)
        total -= gap
        held = []
        while gap:
            piece = left.pop()
            if piece.length > gap:
                piece, rest = piece.cut(gap)
                left.append(rest)
            held.append(piece)
            gap -= piece.length
        found.append(held)
    return found


def sequences(documents: Iterator[tuple], window: int = WINDOW, group: int = GROUP) -> Iterator[list[Piece]]:
    """Sequences of pieces of ``(doc_id, ids)``, holding one group at a time."""
    items: list[Piece] = []
    waiting = 0
    for doc_id, ids in documents:
        doc = (doc_id, len(ids) // 4)
        whole = doc[1] // window
        for i in range(whole):
            yield [Piece(doc, i * window, ids[4 * i * window : 4 * (i + 1) * window])]
        if rest := ids[4 * whole * window :]:
            items.append(Piece(doc, whole * window, rest))
            waiting += len(rest) // 4
        if waiting >= group * window:
            windows, items = pack_group(items, window)
            waiting = sum(p.length for p in items)
            yield from windows
    if items:
        windows, items = pack_group(items, window)
        yield from windows
        yield from powers(items)


def _packed(batches: Iterator[pa.RecordBatch], kind: pa.DataType, files: tuple, window: int, group: int):
    encoder = Encoder(*files)
    first = TaskContext.get().partitionId() << 32

    def documents() -> Iterator[tuple]:
        for batch in batches:
            for i in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(i, _TEXTS)
                ids = encoder(part.column("text").to_pylist())
                yield from zip(part.column("doc_id").to_pylist(), ids, strict=True)

    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    rows: list[tuple] = []
    for number, held in enumerate(sequences(documents(), window, group)):
        offset = 0
        for p in held:
            rows.append((p.doc[0], p.start, p.length, p.ids, p.doc[1], first + number, offset))
            offset += p.length
        if len(rows) >= 2000:
            yield _batch(rows, names, kinds)
            rows = []
    if rows:
        yield _batch(rows, names, kinds)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def packed(
    docs: DataFrame,
    tokenizer: str | None = None,
    ranks: str | None = None,
    window: int = WINDOW,
    group: int = GROUP,
) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` in sequences of at most ``window`` ids.

    Returns doc_id, start, length, ids (little-endian 32-bit words),
    doc_tokens, sequence_id and offset. A null text is encoded as the empty
    one, which is its end id alone; a null id is kept; repeated rows are packed
    each for itself; an empty table gives an empty result; other columns are
    ignored. ``tokenizer`` and ``ranks`` name the same vocabulary's files.
    """
    ship(docs.sparkSession)
    files = (
        tokenizer or public_tokenizers.path("byte_bpe_50k.json"),
        ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    rows = docs.select("doc_id", text_of().alias("text"))
    kind = rows.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    schema = (
        f"doc_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, "
        "sequence_id long, offset long"
    )
    return rows.mapInArrow(lambda it: _packed(it, arrow, files, window, group), schema)


def with_digest(pieces: DataFrame) -> DataFrame:
    """``packed`` pieces with the CRC-32 of their ids in place of them; a row per piece, none for no pieces."""
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op9_packing(spark, sf_dir):
    return with_digest(packed(table(spark, sf_dir, "documents")))
