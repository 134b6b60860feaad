"""Encoder parameters as tables, and encoding with them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.encoder import math as M
from kinfold.functions.hashing import hash_uniform
from kinfold.functions.vectors import activation
from kinfold.operators.blocks import Rows
from kinfold.operators.ordering import lookup_join
from kinfold.operators.vectorize import to_long
from kinfold.session import ship

MAX_BROADCAST = 1 << 30  # bytes of parameters that may be sent to every task
_CODE_ROWS = 2048  # rows that a task encodes at once


def xavier_weights(
    spark: SparkSession, fan_in: int, fan_out: int, const: float = 1.0, seed=42, method: str = "md5"
) -> DataFrame:
    """``(term_id, w, bv)``: uniform in +-const * sqrt(6 / (in + out)), zero bias."""
    bound = const * math.sqrt(6.0 / (fan_in + fan_out))
    draw = lambda j: hash_uniform(seed, F.col("id"), j, method=method)
    w = F.transform(F.sequence(F.lit(0), F.lit(fan_out - 1)), lambda j: (draw(j) * 2.0 - 1.0) * F.lit(bound))
    return spark.range(fan_in).select(F.col("id").cast("int").alias("term_id"), w.alias("w"), F.lit(0.0).alias("bv"))


def zero_hidden_bias(spark: SparkSession, n_components: int) -> DataFrame:
    return spark.range(1).select(F.array_repeat(F.lit(0.0), n_components).alias("bh"))


class EncoderModel:
    """Weights ``(term_id, w, bv)`` and the one-row hidden bias ``(bh)``."""

    def __init__(
        self,
        weights: DataFrame,
        hidden_bias: DataFrame,
        n_features: int,
        n_components: int,
        enc_act_func: str = "sigmoid",
        dec_act_func: str = "sigmoid",
        slots: DataFrame | None = None,
        metrics: DataFrame | None = None,
        steps: int = 0,
        max_broadcast: int = MAX_BROADCAST,
    ):
        activation(enc_act_func), activation(dec_act_func)
        self.weights, self.hidden_bias = weights, hidden_bias
        self.n_features, self.n_components = n_features, n_components
        self.enc_act_func, self.dec_act_func = enc_act_func, dec_act_func
        self.slots, self.metrics, self.steps = slots, metrics, steps
        self.max_broadcast = max_broadcast
        self._params: M.Params | None = None

    @property
    def parameter_bytes(self) -> int:
        return 8 * (self.n_features * (self.n_components + 1) + self.n_components)

    def params(self) -> M.Params:
        """Parameters as arrays on the driver; refused above the size limit."""
        if self._params is None:
            if self.parameter_bytes > self.max_broadcast:
                raise ValueError(
                    f"{self.parameter_bytes} bytes of parameters exceed the limit of {self.max_broadcast}"
                )
            table = self.weights.select("term_id", "w", "bv").toArrow()
            order = np.argsort(table.column("term_id").to_numpy())
            w = table.column("w").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
            bh = np.array(self.hidden_bias.first()["bh"], dtype=float)
            self._params = M.Params(w[order], bh, table.column("bv").to_numpy()[order])
        return self._params

    def transform(self, rows: DataFrame, id_col: str, keep: list[str] | None = None) -> DataFrame:
        """``(id, keep..., embedding)`` for packed or dense rows; also on streams.

        Parameters within the size limit go to the tasks; larger ones stay a
        table and are joined by term.
        """
        if self.parameter_bytes > self.max_broadcast:
            return self.transform_by_join(rows, id_col, keep)
        ship(rows.sparkSession)
        shared = rows.sparkSession.sparkContext.broadcast(self.params())
        act = self.enc_act_func
        keep = keep or []
        kept = [id_col, *keep]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in range(0, max(batch.num_rows, 1), _CODE_ROWS):
                    part = batch.slice(s, _CODE_ROWS)
                    h = M.encode(shared.value, Rows(pa.Table.from_batches([part])), act)
                    ends = pa.array(np.arange(len(h) + 1) * h.shape[1], pa.int32())
                    code = pa.ListArray.from_arrays(ends, pa.array(h.ravel(), pa.float64()))
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], code], [*kept, "embedding"])

        inputs = ["idx", "val"] if "val" in rows.columns else ["vec"]
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
        schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], "embedding array<double>"])
        return rows.select(*kept, *inputs).mapInArrow(run, schema)

    def transform_by_join(self, rows: DataFrame, id_col: str, keep: list[str] | None = None) -> DataFrame:
        """The same codes from a join of features and weights on the term.

        Term products are added in the tasks, for the rows of an Arrow batch at a
        time. Beyond the size limit, where the entries of a row are dealt by term,
        they are added per (row, component), so nothing of the parameters has to
        fit one process. ``id_col`` is a key.
        """
        long = to_long(rows, id_col)
        most = max(self.max_broadcast // (8 * max(self.n_components, 1)), 1)
        joined = lookup_join(
            long, self.weights.select("term_id", "w"), "term_id", "inner", salt_on=id_col, max_rows=most, stored=True
        )
        if self.n_features <= most:
            dense = _added_products(joined.where("value IS NOT NULL").select(id_col, "value", "w"), id_col)
        else:
            parts = joined.select(id_col, "value", F.posexplode("w").alias("component", "w"))
            sums = parts.groupBy(id_col, "component").agg(F.sum(F.col("value") * F.col("w")).alias("a"))
            entry = F.struct("component", "a")
            dense = sums.groupBy(id_col).agg(F.sort_array(F.collect_list(entry))["a"].alias("_a"))
        f = activation(self.enc_act_func)
        bias = F.broadcast(self.hidden_bias.select(F.lit(1).alias("_one"), "bh"))  # one row of n_components
        every = rows.select(id_col, *(keep or [])).join(dense, id_col, "left").withColumn("_one", F.lit(1))
        code = F.zip_with(
            F.coalesce("_a", F.array_repeat(F.lit(0.0), self.n_components)), F.col("bh"), lambda a, b: f(a + b) - f(b)
        )
        return every.join(bias, "_one").select(id_col, *(keep or []), code.alias("embedding"))

    def reconstruction_losses(
        self, rows: DataFrame, id_col: str, loss_func: str = "cross_entropy", clean: str | None = None
    ) -> DataFrame:
        """``(id, loss)``: encode, decode and compare, without storing a reconstruction.

        Rows are ``idx``, ``val``; ``clean`` names another value column over the
        same ``idx`` to compare with. Parameters above the size limit stay a
        table that is read block by block; ``id_col`` is then a whole number.
        """
        if self.parameter_bytes > self.max_broadcast:
            from kinfold.encoder.blocked import row_losses

            return row_losses(self, rows, id_col, loss_func, clean)
        ship(rows.sparkSession)
        shared = rows.sparkSession.sparkContext.broadcast(self.params())
        enc, dec = self.enc_act_func, self.dec_act_func

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                target = Rows(table.select(["idx", "target"]).rename_columns(["idx", "val"]))
                loss = M.row_losses(shared.value, target, Rows(table), enc, dec, loss_func)
                yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(loss)], [id_col, "loss"])

        kind = rows.schema[id_col].dataType.simpleString()
        chosen = rows.select(id_col, "idx", "val", F.col(clean or "val").alias("target"))
        return chosen.mapInArrow(run, f"`{id_col}` {kind}, loss double")

    def save(self, path: str, mode: str = "errorifexists") -> None:
        spark = self.weights.sparkSession
        self.weights.write.mode(mode).parquet(f"{path}/weights")
        self.hidden_bias.write.mode(mode).parquet(f"{path}/hidden_bias")
        shape = [(self.n_features, self.n_components, self.enc_act_func, self.dec_act_func, self.steps)]
        names = "n_features bigint, n_components bigint, enc_act_func string, dec_act_func string, steps bigint"
        spark.createDataFrame(shape, names).coalesce(1).write.mode(mode).parquet(f"{path}/shape")
        if self.slots is not None:
            self.slots.write.mode(mode).parquet(f"{path}/optimizer_slots")
        if self.metrics is not None:
            self.metrics.write.mode(mode).parquet(f"{path}/epoch_metrics")

    @classmethod
    def load(cls, spark: SparkSession, path: str, max_broadcast: int = MAX_BROADCAST) -> "EncoderModel":
        shape = spark.read.parquet(f"{path}/shape").first()

        def optional(name: str) -> DataFrame | None:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
            return spark.read.parquet(f"{path}/{name}") if fs.exists(folder) else None

        return cls(
            spark.read.parquet(f"{path}/weights"),
            spark.read.parquet(f"{path}/hidden_bias"),
            shape["n_features"],
            shape["n_components"],
            shape["enc_act_func"],
            shape["dec_act_func"],
            optional("optimizer_slots"),
            optional("epoch_metrics"),
            shape["steps"],
            max_broadcast,
        )

    @classmethod
    def initial(cls, spark: SparkSession, config, n_features: int, method: str = "md5") -> "EncoderModel":
        k = config.components(n_features)
        if k < 1:
            raise ValueError("compress_factor leaves no component")
        return cls(
            xavier_weights(spark, n_features, k, config.xavier_init, config.seed, method),
            zero_hidden_bias(spark, k),
            n_features,
            k,
            config.enc_act_func,
            config.dec_act_func,
            max_broadcast=config.max_parameter_bytes,
        )


def _added_products(joined: DataFrame, id_col: str) -> DataFrame:
    """``(id, _a)``: sums of ``value * w`` over the entries of an id, which mostly follow each other."""
    ship(joined.sparkSession)
    kind = joined.schema[id_col].dataType.simpleString()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last id of a batch may go on in the next one
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(id_col).dictionary_encode(null_encoding="encode")
            starts = np.flatnonzero(np.diff(ids.indices.to_numpy(), prepend=-1))
            w = batch.column("w").flatten().to_numpy().reshape(batch.num_rows, -1)
            if "value" in batch.schema.names:
                value = batch.column("value").to_numpy(zero_copy_only=False)
                ends = [*starts[1:].tolist(), batch.num_rows]
                sums = np.stack([value[s:e] @ w[s:e] for s, e in zip(starts.tolist(), ends)])
            else:
                sums = np.add.reduceat(w, starts, axis=0)
            keys = batch.column(id_col).take(pa.array(starts))
            if held is not None:
                if held[0][0] == keys[0]:
                    sums[0] += held[1][0]
                else:
                    yield out(*held)
            if len(keys) > 1:
                yield out(keys[:-1], sums[:-1])
            held = keys[-1:], sums[-1:].copy()
        if held is not None:
            yield out(*held)

    def out(keys: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
        ends = pa.array(np.arange(len(keys) + 1) * sums.shape[1], pa.int32())
        return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(ends, pa.array(sums.ravel()))], names=[id_col, "w"])

    schema = f"`{id_col}` {kind}, w array<double>"
    parts = joined.mapInArrow(add, schema)
    dealt = parts.repartition(id_col).sortWithinPartitions(id_col)
    return dealt.mapInArrow(add, schema).withColumnRenamed("w", "_a")


def save_encoded(model: EncoderModel, encoded: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Codes (by ``split`` where there is one) and the weights used for them."""
    writer = encoded.write.mode(mode)
    (writer.partitionBy("split") if "split" in encoded.columns else writer).parquet(f"{path}/encoded")
    model.weights.write.mode(mode).parquet(f"{path}/weights")


__all__ = ["EncoderModel", "save_encoded", "xavier_weights", "zero_hidden_bias"]
