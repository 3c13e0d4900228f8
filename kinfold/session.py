"""Session settings and table access shared by the rest of the library."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, tuple[SparkSession, str | None]] = {}  # path: its session, and the name in the catalog if it has one


def local_session(app: str = "kinfold", cpus: int | None = None, partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench. On a cluster the caller brings its own session."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir``; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the checkpoint folder that the context was given. Where neither is
    set in a local session (tests) a temporary folder takes its place and is set for the context too; on a cluster executors would each write to
    a disk of their own, so there it is an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    given = context._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="kinfold-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Cuts the lineage: writes ``df`` to the shared folder and reads it back. A lost executor then
    costs no recomputation of what lies before. Returns the table and its path for ``discard``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinfold-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written[path] = (spark, None)
    return spark.read.schema(df.schema).parquet(path), path


def written_by(df: DataFrame, label: str, key: str, buckets: int) -> tuple[DataFrame, str]:
    """Like ``written``, but dealt into buckets by ``key``: a join on the key reads this side where it lies,
    without another shuffle of it. Buckets need a name in the catalog, which goes with the table."""
    spark, name = df.sparkSession, f"kinfold_{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    _written[path] = (spark, name)
    return spark.table(name), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a written intermediate that nothing reads any more, and its name in the catalog."""
    _, name = _written.pop(path, (spark, None))
    if name is not None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def collect_garbage(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of a plan that nothing holds any more when the driver's JVM collects it, which with a roomy heap is not before the disk is full."""
    gc.collect()
    spark._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Deletes all intermediates of a session. Results that haven't been written yet can't be read any more."""
    for path, (own, _) in list(_written.items()):
        if own is spark:
            discard(spark, path)


@atexit.register
def _discard_all() -> None:
    for path, (spark, _) in list(_written.items()):
        with contextlib.suppress(Exception):
            discard(spark, path)
