"""All-pairs similarity: reduced to histograms and best matches in the tasks.

A pass over the pairs can score several kinds of vectors of the same rows at
once: ``kinds`` maps a name to the columns (indices, values), with None for the
indices of dense vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.vectors import scale_by_norm
from kinfold.operators.blocks import (
    Rows,
    block_pairs,
    column,
    dot_strips,
    kind_strips,
    lists,
    row_grid,
    tiles,
)
from kinfold.session import materialize

Kinds = dict[str, tuple[str | None, str]]

METRICS = ("cosine", "linear kernel")
TIE_DIGITS = 9  # scores equal to this many digits are ties
_CACHED = 1 << 15  # scores that are rounded and counted at once
_JOINT = 2  # labels that are counted together; more states would take too much memory


def prepared(
    df: DataFrame, id_col: str, metric: str = "cosine", norm: str = "", keep: list[str] | None = None
) -> DataFrame:
    """Rows scaled so that the metric is a plain dot product.

    Takes packed rows (``idx``, ``val``) or dense rows (``vec``).
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}; got {metric!r}")
    values = "val" if "val" in df.columns else "vec"
    scaled = scale_by_norm(F.col(values), norm)
    if metric == "cosine" and norm != "l2":
        scaled = scale_by_norm(scaled, "l2")
    index = ["idx"] if values == "val" else []
    return df.select(F.col(id_col).cast("bigint").alias(id_col), *index, scaled.alias(values), *(keep or []))


def _kinds_of(df: DataFrame, kinds: Kinds | None) -> Kinds:
    return kinds or {"": ("idx", "val") if "val" in df.columns else (None, "vec")}


def _prepared_kinds(df: DataFrame, id_col: str, kinds: Kinds, metric: str, norm: str, keep: list[str]) -> DataFrame:
    """Rows with the columns ``idx_<n>``, ``val_<n>`` or ``vec_<n>`` of the n-th kind, scaled for the metric."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}; got {metric!r}")
    out = [F.col(id_col).cast("bigint").alias(id_col), *keep]
    for n, (index, values) in enumerate(kinds.values()):
        scaled = scale_by_norm(F.col(values), norm)
        if metric == "cosine" and norm != "l2":
            scaled = scale_by_norm(scaled, "l2")
        if index is not None and _index_of(kinds, n) == n:
            out.append(F.col(index).alias(f"idx_{n}"))
        out.append(scaled.alias(f"{'vec' if index is None else 'val'}_{n}"))
    return df.select(*out)


def _index_of(kinds: Kinds, n: int) -> int:
    """The first kind with the column of indices of the n-th."""
    columns = [index for index, _ in kinds.values()]
    return columns.index(columns[n])


def _rows_of(table: pa.Table, n: int, index: int = 0) -> Rows:
    """The vectors of the n-th kind of a tile's side, with the indices of another one or its own."""
    names = [c for c in table.column_names if c in (f"val_{n}", f"vec_{n}")]
    if names[0].startswith("val"):
        names.append(f"idx_{index}")
    return Rows(table.select(names).rename_columns([c.split("_")[0] for c in names]))


def pairwise_similarity(
    df: DataFrame,
    id_col: str,
    metric: str = "cosine",
    norm: str = "",
    min_score: float | None = None,
    set_diagonal_zero: bool = True,
    with_diagonal: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """``(id_a, id_b, score)`` with ``id_a < id_b``, produced lazily.

    The relation has one row per pair by definition; for evaluation use the
    reducing operators below. ``min_score`` keeps higher scores only;
    ``with_diagonal`` adds each row with itself, scored 0 or as measured.
    """
    rows = prepared(df, id_col, metric, norm)

    def tile_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lt, rt, same in tiles(batches):
            lid, rid = column(lt, id_col), column(rt, id_col)
            for start, score in dot_strips(Rows(lt), Rows(rt)):
                a = lid[start : start + len(score)]
                if same:
                    keep = a[:, None] <= rid[None, :] if with_diagonal else a[:, None] < rid[None, :]
                    if set_diagonal_zero:
                        score[a[:, None] == rid[None, :]] = 0.0
                else:
                    keep = np.ones(score.shape, dtype=bool)
                if min_score is not None:
                    keep &= score >= min_score
                i, j = np.nonzero(keep)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id_a": pa.array(np.minimum(a[i], rid[j]), pa.int64()),
                        "id_b": pa.array(np.maximum(a[i], rid[j]), pa.int64()),
                        "score": pa.array(score[i, j], pa.float64()),
                    }
                )

    paired = block_pairs(rows, id_col, block_rows)
    return paired.mapInArrow(tile_scores, "id_a bigint, id_b bigint, score double")


def tile_best(
    lid: np.ndarray, rid: np.ndarray, left: Rows, right: Rows, same: bool, self_score: float | None, one_sided: bool = False
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(ids, others, scores)``: the best match in this tile of each left row, and of each right row."""
    best_r = np.full(len(rid), -np.inf)
    arg_r = np.zeros(len(rid), dtype=np.int64)
    for start, score in dot_strips(left, right):
        score = np.round(score, TIE_DIGITS) + 0.0
        a = lid[start : start + len(score)]
        if same:
            at = np.arange(len(a))
            score[at, start + at] = -np.inf if self_score is None else self_score
        elif one_sided:  # the row itself may be on the other side
            at = np.minimum(np.searchsorted(rid, a), len(rid) - 1)
            own = rid[at] == a
            score[own, at[own]] = -np.inf if self_score is None else self_score
        j = score.argmax(1)  # ids ascend, so the first maximum has the lowest id
        yield a, rid[j], score[np.arange(len(a)), j]
        if not same and not one_sided:
            top = score.max(0)
            better = np.flatnonzero(top > best_r)
            # Few right rows gain by a later strip, and their columns are searched as rows.
            i = np.ascontiguousarray(score[:, better].T).argmax(1) if len(better) else better
            best_r[better], arg_r[better] = top[better], a[i]
    if not same and not one_sided:
        yield rid, arg_r, best_r


def _best_kernel(id_col: str, indices: list[int], self_score: float | None, one_sided: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lt, rt, same in tiles(batches):
            lid, rid = column(lt, id_col), column(rt, id_col)
            if len(lid) == 0 or len(rid) == 0:
                continue
            for n, index in enumerate(indices):
                left, right = _rows_of(lt, n, index), _rows_of(rt, n, index)
                for ids, other, score in tile_best(lid, rid, left, right, same, self_score, one_sided):
                    keep = np.isfinite(score)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "n": pa.array(np.full(keep.sum(), n), pa.int32()),
                            "id": pa.array(ids[keep], pa.int64()),
                            "other": pa.array(other[keep], pa.int64()),
                            "score": pa.array(score[keep], pa.float64()),
                        }
                    )

    return run


_BEST = "n int, id bigint, other bigint, score double"


def best_of(found: DataFrame, id_col: str, kinds: Kinds | None) -> DataFrame:
    """The best of the tiles' matches ``(n, id, other, score)``, ties to the lowest id."""
    top = found.groupBy("n", "id").agg(F.max(F.struct("score", (-F.col("other")).alias("neg"))).alias("_m"))
    named = [F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("n") + 1).alias("kind")] if kinds else []
    return top.select(
        *named, F.col("id").alias(id_col), (-F.col("_m.neg")).alias("best_id"), F.col("_m.score").alias("score")
    )


def most_similar(
    df: DataFrame,
    id_col: str,
    metric: str = "cosine",
    norm: str = "",
    self_score: float | None = None,
    block_rows: int | None = None,
    kinds: Kinds | None = None,
    of: DataFrame | None = None,
) -> DataFrame:
    """``([kind,] id, best_id, score)``: per row the highest score, lowest id on ties.

    A row is never its own match, unless ``self_score`` (0 for a zeroed
    diagonal) makes it a candidate with that score. ``of`` names, by its id
    column, the rows whose match is wanted: then only these are compared with
    all rows.
    """
    every = _kinds_of(df, kinds)
    rows = _prepared_kinds(df, id_col, every, metric, norm, [])
    if of is None:
        paired = block_pairs(rows, id_col, block_rows)
    else:
        rows = materialize(rows, "compared")
        some = rows.join(of.select(F.col(id_col).cast("bigint").alias(id_col)).distinct(), id_col, "left_semi")
        paired = row_grid(some, rows, id_col)
    indices = [_index_of(every, n) for n in range(len(every))]
    found = paired.mapInArrow(_best_kernel(id_col, indices, self_score, of is not None), _BEST)
    return best_of(found, id_col, kinds)


def score_histogram(
    df: DataFrame,
    id_col: str,
    labels: list[str] | None = None,
    metric: str = "cosine",
    norm: str = "",
    digits: int = 6,
    diagonal: str = "none",
    block_rows: int | None = None,
    kinds: Kinds | None = None,
) -> DataFrame:
    """``([kind,] label_kind, related, score, n)``: pairs per rounded score.

    Without labels all pairs count (``label_kind`` 'all', ``related`` null).
    With labels, a pair counts for a label when both values are >= 0, and is
    related when they are equal. ``diagonal`` adds self pairs: 'zero', 'real'.
    Each task adds up all its tiles before it emits a row.
    """
    if diagonal not in ("none", "zero", "real"):
        raise ValueError("diagonal must be none, zero or real")
    names = labels or []
    every = _kinds_of(df, kinds)
    rows = _prepared_kinds(df, id_col, every, metric, norm, names)
    if names:
        rows = rows.withColumn("_labels", F.array(*[F.col(c).cast("bigint") for c in names])).drop(*names)
    unit = 10.0**digits
    bounded = metric == "cosine" and digits <= 6
    span = int(unit) + 1
    slots = max(len(names), 1)
    indices = [_index_of(every, n) for n in range(len(every))]

    def tile_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [_Totals(bounded, span) for _ in range(slots * len(every))]
        # Pairs whose labels are all known are counted once for all labels.
        joint = [_Totals(bounded, span, 2 ** len(names)) for _ in every] if bounded and len(names) == _JOINT else None
        for lt, rt, same in tiles(batches):
            if names:
                ll = lists(lt, "_labels", np.int64)[1].reshape(lt.num_rows, -1)
                rl = lists(rt, "_labels", np.int64)[1].reshape(rt.num_rows, -1)
                whole = ll.min(initial=0) >= 0 and rl.min(initial=0) >= 0
            sides = [[_rows_of(t, n, index) for n, index in enumerate(indices)] for t in (lt, rt)]
            step = max(1, _CACHED // max(rt.num_rows, 1))
            for first, strips in kind_strips(*sides):
                for at in range(0, len(strips[0]), step):
                    scores, start = [x[at : at + step] for x in strips], first + at
                    part = slice(start, start + len(scores[0]))
                    wanted = None
                    if same:
                        row = np.arange(part.start, part.stop)[:, None]
                        col = np.arange(scores[0].shape[1])[None, :]
                        wanted = col > row if diagonal == "none" else col >= row
                    if names:
                        equal = [ll[part, k][:, None] == rl[:, k][None, :] for k in range(len(names))]
                    if names and joint is not None and whole:
                        state = sum(e.astype(np.int64) << k for k, e in enumerate(equal))
                        state = state.ravel() if wanted is None else state[wanted]
                    for n, score in enumerate(scores):
                        score *= unit
                        bins = np.rint(score, out=score).astype(np.int64)
                        if same and diagonal == "zero":
                            bins[col == row] = 0
                        if not names:
                            totals[n].add(bins.ravel() if wanted is None else bins[wanted])
                        elif joint is not None and whole:
                            joint[n].add(bins.ravel() if wanted is None else bins[wanted], state)
                        else:
                            for k, total in enumerate(totals[n * slots : (n + 1) * slots]):
                                a, b = ll[part, k][:, None], rl[:, k][None, :]
                                if wanted is None and a.min() >= 0 and b.min() >= 0:
                                    total.add(bins.ravel(), equal[k].ravel())
                                    continue
                                known = (a >= 0) & (b >= 0)
                                if wanted is not None:
                                    known &= wanted
                                total.add(bins[known], equal[k][known])
        for slot, total in enumerate(totals):
            yield from total.batches(2 * slot)
        for n, total in enumerate(joint or []):
            yield from total.batches(2 * n * slots)

    counted = block_pairs(rows, id_col, block_rows).mapInArrow(tile_counts, "slot int, bin bigint, n bigint")
    summed = counted.groupBy("slot", "bin").agg(F.sum("n").alias("n"))
    total = F.floor(F.col("slot") / 2).cast("int")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)
    named = [pick(list(kinds), F.floor(total / slots).cast("int")).alias("kind")] if kinds else []
    if not names:
        label_kind, related = F.lit("all"), F.lit(None).cast("boolean")
    else:
        label_kind, related = pick(names, F.pmod(total, F.lit(slots))), F.col("slot") % 2 == 1
    return summed.select(
        *named,
        label_kind.alias("label_kind"),
        related.alias("related"),
        (F.col("bin") / F.lit(unit)).alias("score"),
        "n",
    )


class _Totals:
    """Counts per (state, score bin) of one task; a state has a bit for each label: 1 if the pair is related.

    Bounded scores are counted in an array over all bins, one state's after
    another's, so that most pairs meet in few places; unbounded ones in a sorted
    list that grows with distinct scores, a few million pairs at a time at most.
    """

    _HELD = 4_000_000
    _EMIT = 100_000

    def __init__(self, bounded: bool, span: int, states: int = 2):
        self.bounded, self.span, self.states = bounded, span, states
        self.held: list[np.ndarray] = []
        self.size = 0
        self.keys = np.empty(0, dtype=np.int64)
        self.n = np.empty(0, dtype=np.int64)
        self.table: np.ndarray | None = None

    def add(self, bins: np.ndarray, state: np.ndarray | None = None) -> None:
        if self.bounded:
            if self.table is None:
                self.table = np.zeros(self.states * (2 * self.span + 1), dtype=np.int64)
            keys = bins + np.int64(self.span)
            if state is not None:
                keys += state * np.int64(2 * self.span + 1)
            np.add.at(self.table, keys, 1)
            return
        keys = self.states * bins
        if state is not None:
            keys += state
        self.held.append(keys)
        self.size += len(keys)
        if self.size > self._HELD:
            self.flush()

    def flush(self) -> None:
        if not self.size:
            return
        keys = np.concatenate(self.held)
        self.held, self.size = [], 0
        new, n = np.unique(keys, return_counts=True)
        every, at = np.unique(np.concatenate([self.keys, new]), return_inverse=True)
        self.n = np.bincount(at, weights=np.concatenate([self.n, n])).astype(np.int64)
        self.keys = every

    def _of(self, label: int, related: int) -> tuple[np.ndarray, np.ndarray]:
        """Bins and counts of the pairs that are related by a label, or not."""
        if not self.bounded:
            here = (self.keys % self.states >> label) & 1 == related
            return self.keys[here] // self.states, self.n[here]
        if self.table is None:
            return self.keys, self.n
        of_states = self.table.reshape(self.states, -1)
        n = sum(of_states[s] for s in range(self.states) if (s >> label) & 1 == related)
        own = np.flatnonzero(n)
        return own - self.span, n[own]

    def batches(self, slot: int) -> Iterator[pa.RecordBatch]:
        """The counts of each label: slots follow each other, first unrelated, then related."""
        self.flush()
        for label in range(self.states.bit_length() - 1):
            for related in (0, 1):
                own, n = self._of(label, related)
                for s in range(0, len(own), self._EMIT):
                    part = slice(s, s + self._EMIT)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "slot": pa.array(np.full(len(own[part]), slot + 2 * label + related), pa.int32()),
                            "bin": pa.array(own[part], pa.int64()),
                            "n": pa.array(n[part], pa.int64()),
                        }
                    )


def related_counts(df: DataFrame, label: str) -> DataFrame:
    """Number of related and unrelated pairs, from class sizes alone."""
    sizes = df.filter(F.col(label) >= 0).groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    n, same = F.sum("c"), F.sum(F.col("c") * (F.col("c") - 1))
    return sizes.agg(
        F.coalesce((same / 2).cast("bigint"), F.lit(0)).alias("related_pairs"),
        F.coalesce(((n * n - n - same) / 2).cast("bigint"), F.lit(0)).alias("unrelated_pairs"),
    )


def similar_articles(df: DataFrame, id_col: str, show: list[str], kinds: Kinds, of: DataFrame | None = None) -> DataFrame:
    """Per article its best match by each kind of vectors, with metadata, from one pass over the pairs.

    Each kind adds ``<kind>_id``, ``<kind>_<shown column>`` and ``<kind>_score``.
    ``of`` names, by its id column, the articles that are reported.
    """
    best = materialize(most_similar(df, id_col, kinds=kinds, of=of), "best-matches")
    meta = df.select(id_col, *show)
    out = meta if of is None else meta.join(of.select(id_col).distinct(), id_col, "left_semi")
    for kind in kinds:
        own = best.where(F.col("kind") == kind)
        out = out.join(own.select(id_col, F.col("best_id").alias(f"{kind}_id"), F.col("score").alias(f"{kind}_score")), id_col, "left")
        match = meta.select(F.col(id_col).alias(f"{kind}_id"), *[F.col(c).alias(f"{kind}_{c}") for c in show])
        out = out.join(match, f"{kind}_id", "left")
    return out
