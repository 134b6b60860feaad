"""SimHash near-duplicates over deletion variants of fingerprint segments.

Fingerprints are cut into ``SEGMENTS`` pieces, fewer than bits may differ plus
one, so that of two linked fingerprints one piece differs by at most one bit.
Each piece is indexed once per bit with that bit struck out: two pieces that
differ by at most one bit share such a variant. Rows with equal variants meet
by a shuffle on the variant and are verified on all 64 bits.

Work is on distinct fingerprints, so exact copies cost nothing. Within a
variant only the edges of a spanning forest leave a task, never all pairs. A
variant with more than ``BUCKET`` fingerprints is not kept in memory: its
fingerprints go another, exact way. Two of them are within ``2 * r`` bits
exactly if some word is within ``r`` bits of both, and a word has a bounded
number of such neighbours, so these are grouped by word and linked as stars.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import materialize, remaining, row_key, ship, stored, table, text_of
from kinfold.llm.components import components

SHINGLE = 4
DISTANCE = 4
SEGMENTS = 3
BITS = 64
BUCKET = 4096
SEED = 42
_CHUNK = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a text; zero if it has no words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    stops = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *stops[:-1]]
    spans = zip(starts, stops[shingle - 1 :]) if len(words) >= shingle else [(0, len(joined) + 1)]
    count, total, digest = np.zeros(BITS, np.int64), 0, xxhash.xxh64_intdigest
    spans = iter(spans)
    while hashes := [digest(joined[a : b - 1], SEED) for a, b in itertools.islice(spans, _CHUNK)]:
        packed = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(packed, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    bits = np.packbits(count * 2 > total, bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t.as_py(), shingle) for t in batch.column("text")]
        columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(prints, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, text_hash, fp)`` of every row of ``docs(doc_id, text)``, stored."""
    ship(docs.sparkSession)
    rows = docs.select(*row_key(), text_of().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(lambda it: _fingerprints(it, shingle), f"doc_id {kind}, text_hash long, fp long")
    return materialize(found, "fingerprints")


def _pieces(segments: int) -> list[tuple[int, int]]:
    """First bit and number of bits of each segment."""
    cuts = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(cuts)]


def variants(prints: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """``(variant, fp)``: each segment of ``fp`` with each of its bits struck out.

    The number of the bit, which names the segment too, stands above the
    segment's other bits.
    """
    made = []
    for first, width in _pieces(segments):
        piece = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            name = (first + bit) << 40
            made.append(piece.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << bit))).bitwiseOR(F.lit(name)))
    return prints.select("fp", F.explode(F.array(*made)).alias("variant"))


def _edges_within(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    edges, left = [], prints
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            one = front.pop()
            near = np.bitwise_count(left ^ one) <= distance
            if near.any():
                found = left[near]
                left = left[~near]
                front.extend(found)
                edges.extend((one, f) for f in found)
    return edges


def _linked(batches: Iterator[pa.RecordBatch], distance: int, most: int) -> Iterator[pa.RecordBatch]:
    """Forest edges ``(a, b, false)`` of each variant; ``(fp, fp, true)`` for those of a large one.

    The rows come sorted by variant, so a variant's rows are next to each
    other; one that goes on in the next batch is carried there, up to ``most``.
    """

    def batch_of(a: list, b: list, large: bool) -> pa.RecordBatch:
        a, b = np.asarray(a, np.uint64).view(np.int64), np.asarray(b, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(b), pa.array(np.full(len(a), large))], names=["a", "b", "large"]
        )

    carried_key, carried, spilled = None, np.empty(0, np.uint64), False
    for batch in itertools.chain(batches, [None]):
        if batch is None:
            keys, prints = np.empty(0, np.int64), np.empty(0, np.uint64)
        else:
            if not batch.num_rows:
                continue
            keys = batch.column("variant").to_numpy()
            prints = batch.column("fp").to_numpy().view(np.uint64)
        if carried_key is not None:
            same = int(np.searchsorted(keys, carried_key, "right")) if len(keys) else 0
            carried = np.concatenate([carried, prints[:same]])
            keys, prints = keys[same:], prints[same:]
            if spilled or len(carried) > most:
                if len(carried):
                    yield batch_of(carried, carried, True)
                carried, spilled = np.empty(0, np.uint64), True
            if batch is not None and not len(keys):
                continue
            if len(carried) > 1:
                if edges := _edges_within(carried, distance):
                    yield batch_of(*zip(*edges, strict=True), False)
            carried_key, carried, spilled = None, np.empty(0, np.uint64), False
        if not len(keys):
            continue
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        carried_key, carried = int(keys[-1]), prints[starts[-1] :].copy()
        starts, sizes = starts[:-1], sizes[:-1]
        pairs = starts[sizes == 2]
        left, right = prints[pairs], prints[pairs + 1]
        near = np.bitwise_count(left ^ right) <= distance
        if near.any():
            yield batch_of(left[near], right[near], False)
        edges = []
        for at, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            if size > most:
                yield batch_of(prints[at : at + size], prints[at : at + size], True)
            else:
                edges.extend(_edges_within(prints[at : at + size], distance))
        if edges:
            yield batch_of(*zip(*edges, strict=True), False)


def _ball_edges(prints: DataFrame, distance: int) -> DataFrame:
    """Exact links among ``prints`` by the words within half the distance of both."""
    masks = [
        sum(1 << b for b in bits) for r in range(distance // 2 + 1) for bits in itertools.combinations(range(BITS), r)
    ]
    signed = np.array(masks, np.uint64).view(np.int64).tolist()
    flips = F.array(*[F.lit(m) for m in signed])
    words = prints.select("fp", F.explode(F.transform(flips, lambda m: m.bitwiseXOR(F.col("fp")))).alias("word"))
    # A word has at most len(masks) neighbours, which bounds its list.
    stars = words.groupBy("word").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    star = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    return star.where("a <> b")


def link_edges(
    prints: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, bucket: int = BUCKET
) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of all links among distinct ``fp``."""
    if distance >= 2 * segments:
        raise ValueError("a segment could differ by more than one bit")
    if distance % 2:
        raise ValueError("the distance must be even, as the exact way for large buckets halves it")
    ship(prints.sparkSession)
    keyed = variants(prints, segments)
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(tasks, "variant").sortWithinPartitions("variant")
    found = dealt.mapInArrow(lambda it: _linked(it, distance, bucket), "a long, b long, large boolean")
    found = stored(found.distinct(), "links")
    edges = found.where("not large").select("a", "b")
    large = found.where("large").select(F.col("a").alias("fp"))
    if large.isEmpty():
        return edges
    return edges.union(_ball_edges(large, distance).distinct())


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, segments: int = SEGMENTS, bucket: int = BUCKET
) -> DataFrame:
    """``(doc_id, text_hash, fp, root, component_id)``, a row per row of ``docs(doc_id, text)``.

    A null text counts as empty; a text without words has fingerprint zero and
    is linked like any other; one with fewer words than a shingle is hashed as
    a whole. Null ids come last: component_id is the least id that is not null,
    null if a component has none. Repeated rows give repeated rows. An empty
    table gives an empty result; other columns are ignored.
    """
    rows = fingerprints(docs, shingle)
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "prints")
    roots = components(link_edges(nodes.select("fp"), distance, segments, bucket))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left")
    rooted = stored(rooted.select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "rooted")
    # Written first, so that the join is split at the root of a large component.
    least = stored(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    classes = stored(rooted.select(F.col("fp").alias("of"), "root").join(least, "root"), "classes")
    return rows.join(classes, rows["fp"] == classes["of"]).select("doc_id", "text_hash", "fp", "root", "component_id")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with the least id of their component, one for each, with all their columns.

    Null ids come last, so a component of null ids alone keeps one of them; of
    rows that share the least id, the one with the least hash of its text stays,
    and of rows that repeat both, one. Null texts count as empty; an empty table
    stays empty; columns may have any names.
    """
    classes = stored(near_duplicates(docs, **options), "near-classes")
    least = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # Repeated ids: of the texts that bear the least id, the one with the least hash stays.
    stays = least.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("s")).select("s.*")
    return remaining(docs, classes.select("doc_id", "text_hash"), stays)


def op8_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
