"""Ids against tokenizers, and round trips through the sequences."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinfold.llm import packing as P

FILES = (
    public_tokenizers.path("byte_bpe_50k.json"),
    public_tokenizers.path("byte_bpe_50k.tiktoken"),
    public_tokenizers.PATTERN,
)
TEXTS = [
    "", " ", "a", " a", "a ", "a  b", "a \nb", "a\n b", "x<|endoftext|> y <|endoftext|>", "\n\n a", "é b ç  d",
    "日本 語 " * 50, "ab" * 3000, "a\x00b \x00c", "I'm we're don't 's 's", "\ta b\x1c c", "a b  c d　 e",
    "one  two three 1234 5,6.7 !!! ?!", "word " * 3000, "😀 😀😀 x",
]


def ids_of(text, whole):
    return [*whole.encode(text, add_special_tokens=False).ids, 1]


def test_ids_equal_the_tokenizer():
    whole, encoder = Tokenizer.from_file(FILES[0]), P.Encoder(*FILES)
    draw = random.Random(4)
    letters = ["a", "B", "é", " ", " ", " ", "\n", "\t", "1", "2", ".", "'", "s", "日", " ", "😀", "<|endoftext|>"]
    texts = TEXTS + ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(500)]
    for _ in range(2):  # the second time from what is kept
        for text, ids in zip(texts, encoder(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == ids_of(text, whole), repr(text)


@pytest.mark.parametrize("seed", range(5))
def test_differencing_and_groups(seed):
    draw = random.Random(seed)
    items = [P.Piece((i, n), 0, bytes(4 * n)) for i in range(draw.randint(1, 80)) for n in [draw.randint(1, 99)]]
    sizes = [p.length for p in items]
    for windows in (1, 2, 7, 200):
        sets = P.difference(sizes, windows)
        assert len(sets) == windows and sorted(i for s in sets for i in s) == list(range(len(sizes)))
    sums = [sum(sizes[i] for i in s) for s in P.difference(sizes, 4)]
    assert max(sums) - min(sums) <= max(sizes)
    full, rest = P.pack_group(items, 100)
    assert all(sum(p.length for p in w) == 100 for w in full) and sum(p.length for p in rest) == sum(sizes) % 100
    tail = [sum(p.length for p in s) for s in P.powers(rest)]
    assert all(n & (n - 1) == 0 for n in tail) and sum(tail) == sum(sizes) % 100


def test_packed_round_trip(spark):
    texts = TEXTS + [None, "long text of words " * 4000, "twice", "twice"]
    rows = [(i if t != "twice" else 99, t) for i, t in enumerate(texts)] + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("start", F.lit(2))
    found = P.packed(docs.repartition(2), group=2)
    pieces = found.collect()
    digests = {(r.doc_id, r.start, r.ids_crc32) for r in P.with_digest(found).collect()}
    assert digests == {(r.doc_id, r.start, zlib.crc32(r.ids)) for r in pieces}
    whole = Tokenizer.from_file(FILES[0])
    by_doc = {}
    for r in pieces:
        assert len(r.ids) == 4 * r.length > 0
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        ids = np.array(ids_of(t or "", whole), "<u4").tobytes()
        held = sorted(by_doc[i], key=lambda r: r.start)
        if t == "twice":
            assert [r.ids for r in held] == [ids, ids]
            continue
        assert b"".join(r.ids for r in held) == ids and {r.doc_tokens for r in held} == {len(ids) // 4}
        assert [r.start for r in held] == np.cumsum([0, *[r.length for r in held]])[:-1].tolist()
    by_sequence = {}
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for held in by_sequence.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == np.cumsum([0, *[r.length for r in held]])[:-1].tolist()
        total = sum(r.length for r in held)
        assert total <= 2048 and total & (total - 1) == 0
    assert P.packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
