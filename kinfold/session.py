"""Session helpers: a default session, and tables that cut lineage."""

from __future__ import annotations

import contextlib
import pathlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_FOLDER = "_kinfold_folder"
_SCOPES = "_kinfold_scopes"


def local_session(app: str = "kinfold", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder; a cluster
    session without it is refused, since a machine-local folder would be lost
    with its executor. A ``file:`` folder is taken as named: it may be a mount
    that all machines share, which Spark cannot tell from a local disk.
    """
    sc = spark.sparkContext
    named = spark.conf.get(_CHECKPOINT_KEY, None) or sc.getConf().get(_CHECKPOINT_KEY)
    named = named or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_KEY} to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="kinfold-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/kinfold/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This freezes values that depend on the physical layout and cuts the
    lineage, so lost executors only cost a re-read.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if scopes := getattr(spark.sparkContext, _SCOPES, None):
        scopes[-1].add(path)
    writer.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    setattr(stored, _FOLDER, path)
    return stored


def held_by(stored: DataFrame, df: DataFrame) -> DataFrame:
    """Let ``discard(df)`` delete the folder of the ``stored`` table that it reads."""
    setattr(df, _FOLDER, getattr(stored, _FOLDER, None))
    return df


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete at the end, also after an error, what ``materialize`` wrote inside.

    Tables passed to the function it yields stay, for the scope around this one
    if there is one. Nothing lazy that reads another table may leave the scope.
    """
    scopes = getattr(spark.sparkContext, _SCOPES, [])
    setattr(spark.sparkContext, _SCOPES, scopes)
    written: set[str] = set()
    scopes.append(written)
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(getattr(df, _FOLDER))
        return df

    try:
        yield keep
    finally:
        scopes.remove(written)
        if scopes:
            scopes[-1].update(kept & written)
        for path in written - kept:
            remove(spark, path)


def discard(*tables: DataFrame | None) -> None:
    """Delete the folders of tables that ``materialize`` wrote and nothing reads any more."""
    for df in tables:
        path = getattr(df, _FOLDER, None)
        if path is not None:
            remove(df.sparkSession, path)


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    system, folder = _file_system(spark, path)
    return system.exists(folder)


def remove(spark: SparkSession, path: str) -> None:
    system, folder = _file_system(spark, path)
    system.delete(folder, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give heavy per-row work at least one partition per core.

    Only inputs with fewer scan partitions than cores are moved (a few small
    files); anything larger keeps its scan layout and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


_SHIPPED = "_kinfold_shipped"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context.

    Tasks unpickle functions by module name, and a worker need not start in a
    folder, or on a machine, where the package can be found.
    """
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    root = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="kinfold-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(target))
    setattr(sc, _SHIPPED, True)
