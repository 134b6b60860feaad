"""Prefix trie of conversations, as a double array per shard of prefixes.

A conversation is a path of turn keys. Paths are range-partitioned, so a shard
holds neighbouring prefixes, and a prefix or a whole path that a third of all
conversations share is cut into as many shards as its members fill. A task
gives a shard's turns dense ids, packs the trie of its paths into BASE and
CHECK arrays, and walks all paths through them at once, which gives the nodes
and what belongs to each.

Only prefixes that a shard shares with the one before or after it stand in
several shards: these upper nodes leave their task as partial aggregates. They
are merged globally, and what their subtrees hold is added up by pointer
doubling, in as many rounds as the logarithm of the shared depth.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import materialize, ship, stored, table
from kinfold.operators.ordering import lookup_join

KEY = 16  # bytes of a turn's key
SHARD_TURNS = 200_000  # turns of a shard, about
GROUP = 5  # conversations that share the head of one of them
HEADS = 9  # heads have fewer turns than this
_TRIES = 64  # places tried for a node's children before they go behind all others


def turn_keys(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, key, size)``: 16 bytes of a digest of role and text, and the text's bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.substring(digest, 1, KEY).alias("key"),
        F.octet_length(text).cast("long").alias("size"),
    )


def sequences(turns: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: the turns of a conversation in order, null first, ties by key."""
    listed = F.sort_array(F.collect_list(F.struct("turn", "key", "size")))
    strip = lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))
    return turns.groupBy("conv_id").agg(F.transform(listed, strip).alias("turns"))


def rebuilt(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """``sequences`` whose first h turns are those of conversation ``c - c % group``.

    h is crc32 of c's decimal digits modulo ``heads``; the remainder of a
    negative id is negative, as in SQL. A conversation whose
    head is absent, or shorter than h, has fewer turns; it may have none.
    """
    whole = stored(sequences(turn_keys(conversations)), "sequences")
    first = whole.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("of"), F.slice("turns", 1, heads - 1).alias("head")
    )
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    keyed = whole.withColumn("h", h).withColumn("of", F.col("conv_id") - F.col("conv_id") % group)
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return keyed.join(first, "of", "left").select("conv_id", F.concat(head, own).alias("turns"))


class DoubleArray:
    """A trie over sequences of dense ids from 1; state 1 is the root.

    ``base[s] + id`` is the state that follows s, if ``check`` of it is s.
    """

    def __init__(self, paths: list[list[int]]):
        """``paths`` are distinct and sorted."""
        parent, label, stack, before = [-1], [0], [0], []
        for path in paths:
            same = 0
            for a, b in zip(before, path):
                if a != b:
                    break
                same += 1
            del stack[same + 1 :]
            for one in path[same:]:
                stack.append(len(parent))
                parent.append(stack[-2])
                label.append(one)
            before = path
        self._pack(np.array(parent), np.array(label))

    def _pack(self, parent: np.ndarray, label: np.ndarray) -> None:
        n = len(parent)
        order = np.lexsort((label, parent))[1:]  # all but the root, by parent
        starts = np.flatnonzero(np.r_[True, np.diff(parent[order]) > 0]) if n > 1 else np.empty(0, int)
        sizes = np.diff(np.r_[starts, n - 1])
        state, shift = np.zeros(n, np.int64), np.zeros(n, np.int64)
        state[0] = 1
        taken = np.zeros(2 * n + int(label.max(initial=0)) + 4, bool)
        taken[:2] = True
        low, top = 2, 2
        # Nodes with many children choose first; those with one fill what is left.
        for g in np.argsort(-sizes, kind="stable"):
            if sizes[g] == 1:
                break
            kids = order[starts[g] : starts[g] + sizes[g]]
            ids = label[kids]
            while taken[low]:
                low += 1
            place = low
            for _ in range(_TRIES):
                if not taken[ids + (place - ids[0])].any():
                    break
                place += 1
                while taken[place]:
                    place += 1
            else:
                place = top
            at = ids + (place - ids[0])
            top = max(top, int(at[-1]) + 1)
            if top + int(label.max()) + 2 > len(taken):
                taken = np.r_[taken, np.zeros(len(taken) + top, bool)]
            taken[at] = True
            state[kids], shift[parent[kids[0]]] = at, place - ids[0]
        single = order[starts[sizes == 1]]
        free = np.flatnonzero(~taken)[: len(single)]
        if len(free) < len(single):
            free = np.r_[free, np.arange(len(taken), len(taken) + len(single) - len(free))]
        state[single], shift[parent[single]] = free, free - label[single]
        self.base = np.zeros(int(state.max()) + 1, np.int64)
        self.check = np.zeros(int(state.max()) + 1, np.int64)
        self.base[state] = shift
        self.check[state[1:]] = state[parent[1:]]

    def step(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The states that follow, 0 where there is none."""
        to = self.base[states] + ids
        inside = (to > 1) & (to < len(self.check))
        to = np.where(inside, to, 0)
        return np.where(inside & (self.check[to] == states), to, 0)

    def walk(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The state after each id of the sequences in ``flat``, all sequences at once."""
        states, at = np.zeros(len(flat), np.int64), np.cumsum(sizes) - sizes
        now, live, depth = np.ones(len(sizes), np.int64), np.flatnonzero(sizes > 0), 0
        while len(live):
            now[live] = states[at[live] + depth] = self.step(now[live], flat[at[live] + depth])
            depth += 1
            live = live[sizes[live] > depth]
        return states


_NODE = (
    "open boolean, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, size long, ends_sha256 string, first_end long, ends binary"
)


def _digest(prefix: bytes) -> bytes:
    return hashlib.sha256(prefix).digest()


def _decimal(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def _nodes(table: pa.Table, front: int, back: int) -> Iterator[pa.RecordBatch]:
    """The nodes of a shard: whole ones, and parts of those shared with its neighbours.

    ``front`` and ``back`` are the depths to which the first path is shared with
    the shard before, and the last path with the shard after, -1 for no shard.
    """
    conv = table.column("conv_id").to_numpy()
    raw = table.column("path").to_pylist()
    new = [i for i in range(len(raw)) if not i or raw[i] != raw[i - 1]]
    paths, members = [raw[i] for i in new], np.diff([*new, len(raw)])
    sizes = np.array([len(p) // KEY for p in paths])
    keys = np.frombuffer(b"".join(paths), np.dtype((np.void, KEY)))
    flat = np.unique(keys, return_inverse=True)[1].astype(np.int64).ravel() + 1 if len(keys) else np.empty(0, np.int64)
    ends = np.cumsum(sizes)
    trie = DoubleArray([flat[a:b].tolist() for a, b in zip(ends - sizes, ends)])
    states = trie.walk(flat, sizes)

    n = len(trie.check)
    depth, size, count = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    least = np.full(n, np.iinfo(np.int64).max)
    depth[1], count[1], least[1] = 0, len(conv), conv.min()
    depth[states] = np.arange(len(flat)) - np.repeat(ends - sizes, sizes) + 1
    text_bytes = list(itertools.chain.from_iterable(table.column("sizes").take(pa.array(new)).to_pylist()))
    size[states] = np.array(text_bytes, np.int64)
    np.add.at(count, states, np.repeat(members, sizes))
    np.minimum.at(least, states, np.repeat(np.minimum.reduceat(conv, new), sizes))
    last = np.ones(len(paths), np.int64)
    last[sizes > 0] = states[ends[sizes > 0] - 1]
    ending = dict(zip(last.tolist(), zip(new, [*new[1:], len(raw)])))

    opened: dict[int, bytes] = {}
    for which, shared in ((0, front), (len(paths) - 1, back)):
        spine = [1, *states[ends[which] - sizes[which] : ends[which]].tolist()]
        for d in range(min(shared, sizes[which]) + 1):
            opened[spine[d]] = _digest(paths[which][: d * KEY])
    is_open = np.zeros(n, bool)
    is_open[list(opened)] = True

    found = np.flatnonzero(depth >= 0)
    parent = np.where(found == 1, 0, trie.check[found])
    whole = ~is_open[found]
    children = np.bincount(parent[whole], minlength=n)  # open children are counted when they are merged
    leaves, saved = np.zeros(n, np.int64), np.zeros(n, np.int64)
    by_depth = found[np.argsort(-depth[found], kind="stable")]
    for at in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1):
        at = at[~is_open[at]]  # an open node has open nodes above it only
        leaves[at] += children[at] == 0
        saved[at] += (count[at] - 1) * size[at]
        up = trie.check[at]
        np.add.at(leaves, up, np.where(at == 1, 0, leaves[at]))
        np.add.at(saved, up, np.where(at == 1, 0, saved[at]))

    of_ends = [conv[slice(*ending[s])] if s in ending else conv[:0] for s in found.tolist()]
    under_open = is_open[parent] & (found != 1)
    columns = {
        "open": pa.array(~whole),
        "key": pa.array([opened.get(s) for s in found.tolist()], pa.binary()),
        "parent_key": pa.array([opened[p] if u else None for p, u in zip(parent.tolist(), under_open)], pa.binary()),
        "depth": pa.array(depth[found], pa.int64()),
        "conv_id": pa.array(least[found], pa.int64()),
        "parent_conv_id": pa.array(least[parent], pa.int64(), mask=(found == 1) | under_open),
        "n_convs": pa.array(count[found], pa.int64()),
        "n_children": pa.array(children[found], pa.int64()),
        "n_leaves": pa.array(leaves[found], pa.int64()),
        "saved_tokens": pa.array(saved[found], pa.int64()),
        "size": pa.array(size[found], pa.int64()),
        "ends_sha256": pa.array(
            [hashlib.sha256(_decimal(e)).hexdigest() if w else None for e, w in zip(of_ends, whole)], pa.string()
        ),
        "first_end": pa.array([None if w or not len(e) else e[0] for e, w in zip(of_ends, whole)], pa.int64()),
        "ends": pa.array([None if w or not len(e) else e.tobytes() for e, w in zip(of_ends, whole)], pa.binary()),
    }
    yield pa.RecordBatch.from_pydict(columns)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (shard, path, conv_id)."""
    current, held = None, []
    for batch in batches:
        marks = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(marks)]
        for start, end in zip(cuts[:-1], cuts[1:]):
            if start == end:
                continue
            if held and marks[start] != current:
                yield from _shard(held)
                held = []
            current = marks[start]
            held.append(batch.slice(start, end - start))
    if held:
        yield from _shard(held)


def _shard(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(held)
    yield from _nodes(rows, rows.column("front")[0].as_py(), rows.column("back")[0].as_py())


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns that a shard's ends share with the neighbouring shards' ends."""

    def turns(a: bytes | None, b: bytes | None) -> int:
        if a is None or b is None:
            return -1
        return next((i for i in range(0, min(len(a), len(b)), KEY) if a[i : i + KEY] != b[i : i + KEY]), min(len(a), len(b))) // KEY

    for batch in batches:
        before, first, last, after = (batch.column(c).to_pylist() for c in ("before", "first", "last", "after"))
        front = [turns(a, b) for a, b in zip(before, first)]
        back = [turns(a, b) for a, b in zip(last, after)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("shard"), pa.array(front, pa.int64()), pa.array(back, pa.int64())], names=["shard", "front", "back"]
        )


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of a key's ids over rows sorted by (key, first_end), one row held at a time."""

    def out(key: bytes, digest) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"key": pa.array([key], pa.binary()), "ends_sha256": pa.array([digest.hexdigest()])}
        )

    current, digest = None, None
    for batch in batches:
        for key, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if key != current:
                if current is not None:
                    yield out(current, digest)
                current, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(_decimal(np.frombuffer(ends, np.int64)))
    if current is not None:
        yield out(current, digest)


def _sharded(convs: DataFrame, shard_turns: int) -> tuple[DataFrame, int]:
    """Rows ``(shard, path, sizes, conv_id, front, back)`` and the number of shards."""
    spark = convs.sparkSession
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), ""))
    paths = stored(convs.select("conv_id", path.alias("path"), F.col("turns.size").alias("sizes")), "paths")
    turns = paths.agg(F.coalesce(F.sum(F.size("sizes") + 1), F.lit(0))).first()[0]
    n = max(1, math.ceil(turns / shard_turns), min(spark.sparkContext.defaultParallelism, math.ceil(turns / 1000)))
    ranged = paths.repartitionByRange(n, "path", "conv_id").withColumn("shard", F.spark_partition_id())
    ranged = materialize(ranged, "shards")
    # One row per shard, so one window is enough.
    order = Window.orderBy("shard")
    ends = ranged.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    ends = ends.withColumn("before", F.lag("last").over(order)).withColumn("after", F.lead("first").over(order))
    shared = ends.mapInArrow(_shared, "shard int, front long, back long")
    return lookup_join(ranged, shared, "shard", "inner", salt_on="conv_id"), n


def _subtrees(nodes: DataFrame) -> DataFrame:
    """``nodes(key, parent_key, leaves, saved)`` with the sums over what hangs below each, by pointer doubling."""
    now = stored(nodes.select("key", F.col("parent_key").alias("jump"), "leaves", "saved"), "subtrees")
    while not now.where("jump IS NOT NULL").isEmpty():
        below = now.where("jump IS NOT NULL").groupBy("jump").agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        further = now.select(F.col("key").alias("jump"), F.col("jump").alias("next"))
        moved = lookup_join(now, further, "jump", "left", salt_on="key", stored=True)
        moved = moved.join(below.withColumnRenamed("jump", "key"), "key", "left")
        now = stored(
            moved.select(
                "key",
                F.col("next").alias("jump"),
                (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
            ),
            "subtrees",
        )
    return now.select("key", "leaves", "saved")


def _merged(parts: DataFrame) -> DataFrame:
    """The shared upper nodes, from their parts in all shards; ``key`` and ``parent_key`` are kept."""
    nodes = parts.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"),
        F.max("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("whole_children"),
        F.sum("n_leaves").alias("whole_leaves"),
        F.sum("saved_tokens").alias("whole_saved"),
        F.max("size").alias("size"),
    )
    nodes = stored(nodes, "upper-nodes")
    kids = nodes.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(
        F.count(F.lit(1)).alias("open_children")
    )
    nodes = nodes.join(kids, "key", "left").withColumn(
        "n_children", F.col("whole_children") + F.coalesce("open_children", F.lit(0))
    )
    own = nodes.select(
        "key",
        "parent_key",
        (F.col("whole_leaves") + (F.col("n_children") == 0).cast("long")).alias("leaves"),
        (F.col("whole_saved") + (F.col("n_convs") - 1) * F.col("size")).alias("saved"),
    )
    # A shard's ids of a node are one row, and shards follow each other by id.
    listed = parts.where("ends IS NOT NULL").select("key", "first_end", "ends")
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chained = listed.repartition(tasks, "key").sortWithinPartitions("key", "first_end")
    digests = chained.mapInArrow(_chained, "key binary, ends_sha256 string")
    joined = nodes.join(_subtrees(own), "key").join(digests, "key", "left")
    return joined.select(
        "key",
        "parent_key",
        "depth",
        "conv_id",
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


_RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of all prefixes of ``convs(conv_id, turns)``, a row each.

    ``turns`` is an array of (key, size). A node's members are the
    conversations that start with it; a conversation without turns is a member
    of the root only. conv_id is the smallest member, parent_conv_id the
    parent's (null for the root), ends_sha256 the digest of the ids of the
    members that end there. Equal conversations are members of the same nodes;
    a third of them may be equal. An empty table has no node, not even a root.
    A conversation's keys stand in one row, 24 bytes a turn, so it is bounded
    by Spark's row size, some 10^7 turns; a node's digest is a chain, which one
    task follows over packed ids, a shard's at a time.
    """
    ship(convs.sparkSession)
    rows, n = _sharded(convs, shard_turns)
    dealt = rows.repartitionById(n, F.pmod("shard", F.lit(n))).sortWithinPartitions("shard", "path", "conv_id")
    found = materialize(dealt.mapInArrow(_shards, _NODE), "trie-nodes")
    upper = stored(_merged(found.where("open")), "upper-nodes")
    ids = upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("upper_id"))
    whole = found.where("NOT open")
    below = lookup_join(whole.where("parent_key IS NOT NULL"), ids, "parent_key", "left", salt_on="conv_id", stored=True)
    below = below.withColumn("parent_conv_id", F.col("upper_id"))
    tops = lookup_join(upper, ids, "parent_key", "left", salt_on="key", stored=True)
    tops = tops.withColumn("parent_conv_id", F.col("upper_id"))
    return whole.where("parent_key IS NULL").select(_RESULT).union(below.select(_RESULT)).union(tops.select(_RESULT))


def op12_conversations(spark, sf_dir):
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))


# The byte-wise CRC-32 in SQL: eight shifts a character, over decimal digits.
_CRC32 = """xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({c} AS VARCHAR), ''), lambda d: ord(d)::BIGINT)),
    lambda acc, d: list_reduce(
        list_prepend(xor(acc, d), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda y, z: xor(y >> 1, (y & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"""

ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, turn, left(sha256(concat(length(role), ':', role, text)), 32) AS key, strlen(text) AS size FROM t),
own AS (SELECT conv_id, key, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS n FROM k),
c AS (SELECT conv_id, {_CRC32.format(c="conv_id")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
both_parts AS (
    SELECT c.conv_id, 0 AS part, n, key, size FROM c JOIN own ON own.conv_id = c.conv_id - c.conv_id % 5 AND n <= h
    UNION ALL SELECT c.conv_id, 1, n, key, size FROM c JOIN own ON own.conv_id = c.conv_id AND n > h),
r AS (SELECT conv_id, key, size, row_number() OVER (PARTITION BY conv_id ORDER BY part, n) AS d FROM both_parts),
p AS (SELECT conv_id, d, size, string_agg(key, '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d) AS path FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
node AS (SELECT path, max(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size
         FROM p GROUP BY path),
kids AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
last AS (SELECT path, conv_id FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY d DESC) = 1),
ends AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM last GROUP BY path),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children, coalesce(ids, '') AS ids
              FROM node LEFT JOIN kids USING (path) LEFT JOIN ends USING (path)),
up AS (SELECT left(path, 32 * CAST(i AS INTEGER)) AS path, n_children, (n_convs - 1) * size AS saved
       FROM full_node, unnest(range(0, depth + 1)) AS a(i)),
sub AS (SELECT path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
        FROM up GROUP BY path)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(f.ids) AS ends_sha256
FROM full_node f JOIN sub USING (path)
LEFT JOIN node q ON f.depth > 0 AND q.path = left(f.path, length(f.path) - 32)
"""
