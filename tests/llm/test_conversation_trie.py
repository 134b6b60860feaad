"""The prefix trie against sets of prefixes."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from kinfold.llm import conversation_trie as C

SCHEMA = "conv_id long, turn long, role string, text string"


def key_of(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[: C.KEY]


def paths_of(rows):
    """conv_id -> rebuilt turns as (role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0, key_of(role, text)), (role, text)))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    base = {c: c - int(math.fmod(c, 5)) for c in own}  # remainders have the sign of c, as in SQL
    return {c: tuple(own.get(base[c], [])[: heads[c]] + own[c][heads[c] :]) for c in own}


def brute(rows):
    paths = paths_of(rows)
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    out = []
    for node, inside in members.items():
        subtree = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in subtree if n)
        ends = ",".join(map(str, sorted(c for c in inside if paths[c] == node)))
        parent = min(members[node[:-1]]) if node else None
        leaves = sum(n not in kids for n in subtree)
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(inside), len(node), parent, len(inside), len(kids.get(node, [])), leaves, saved, digest))
    return sorted(out, key=str)


def run(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("path", F.lit("clash")).withColumn("key", F.lit(1))
    frame = frame.repartition(3).withColumn("size", F.lit(None)).withColumn("shard", F.lit("x"))
    return sorted(map(tuple, C.prefix_trie(C.rebuilt(frame), **options).collect()), key=str)


def conversations(seed, n=60):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        if draw.random() < 0.1:
            continue  # absent, perhaps the head of others
        for t in range(draw.choice([1, 2, 3, 4, 9, 12])):
            rows.append((c, t, draw.choice(["user", "assistant"]), draw.choice(["hi", "ho", "ça va", "", "x" * 30])))
    return rows


@pytest.mark.parametrize("seed,shard_turns", [(1, 10**6), (2, 40), (3, 7)])
def test_equals_brute_force(spark, seed, shard_turns):
    rows = conversations(seed)
    assert run(spark, rows, shard_turns=shard_turns) == brute(rows)


def test_a_third_of_all_conversations_is_one(spark):
    """Their nodes and their end stand in many shards."""
    same = [("system", "be kind"), ("user", "héllo"), ("assistant", "hi")]
    rows = [(c, t, *turn) for c in range(0, 600, 5) for t, turn in enumerate(same)]
    rows += [(c, 0, "user", f"text {c}") for c in range(1, 600, 5)] + conversations(5, 30)
    assert run(spark, rows, shard_turns=30) == brute(rows)


def test_nulls_ties_long_and_turnless(spark):
    rows = [
        (0, 1, "user", "b"), (0, None, "user", "first"), (0, 1, "user", "a"), (0, 1, "user", "a"),  # ties
        (1, None, None, None), (2, 0, "", None), (None, 0, "user", "no id"), (3, 0, "user", "y" * 100_000),
        (7, 0, "user", "head is absent"), (-3, 0, "user", "negative id"),
    ]
    rows += [(25, t, "user", str(t % 3)) for t in range(400)] + [(26, t, "user", str(t % 3)) for t in range(400)]
    assert any(not p for p in paths_of(rows).values())
    assert run(spark, rows, shard_turns=100) == brute(rows)
    assert run(spark, []) == [] and run(spark, [(None, 0, "user", "x")]) == []


def test_double_array_holds_its_paths_and_no_others():
    draw = random.Random(4)
    paths = sorted({tuple(draw.randrange(1, 30) for _ in range(draw.randrange(1, 6))) for _ in range(400)})
    trie = C.DoubleArray([list(p) for p in paths])
    prefixes = {p[:d] for p in paths for d in range(1, len(p) + 1)}
    states = {}
    for prefix in prefixes:
        state = C.np.array([1])
        for one in prefix:
            state = trie.step(state, C.np.array([one]))
        states[prefix] = int(state[0])
    assert 0 not in states.values() and len(set(states.values())) == len(prefixes)
    for prefix in [(), *prefixes]:
        for one in range(1, 32):
            to = trie.step(C.np.array([states.get(prefix, 1)]), C.np.array([one]))[0]
            assert (to > 0) == (prefix + (one,) in prefixes)
    assert len(trie.check) < 2 * len(prefixes) + 64
