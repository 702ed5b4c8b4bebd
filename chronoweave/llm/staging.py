"""Tables written to the folder that all executors share, so that lost executors cost no recomputed lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of our own, as in tests on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="stages-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Spark removes a statement's shuffle files as it ends; else they stay until the driver's JVM collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stage(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again.

    With by, as a table bucketed by these columns into as many buckets as there
    are shuffle partitions: what groups or joins by all of them reads it without a shuffle.
    """
    spark = df.sparkSession
    name = f"{name}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    if not _WRITTEN:
        atexit.register(_remove)
    _WRITTEN.append((spark, path))
    writer = df.write.option("compression", "zstd")
    if not by:
        with cleaned_up(spark):
            writer.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    table = name.replace("-", "_")
    with cleaned_up(spark):
        writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


#: A table of so many rows of a few numbers is sent to all executors: some 20 MB.
FEW_ROWS = 200_000


def few(df: DataFrame) -> DataFrame:
    """A staged table with a hint to broadcast it if it has FEW_ROWS at most, so that what it is joined with stays where it is; a larger one as it is."""
    return broadcast(df) if df.count() <= FEW_ROWS else df


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of results that nothing refers to any more; it does so when the driver's JVM collects its garbage."""
    spark.sparkContext._jvm.System.gc()


def _remove() -> None:
    """Staged tables back lazy results, so they go when the process ends."""
    for spark, path in _WRITTEN:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone already
            return


def spare(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
