"""Tables kept between jobs in the folder all executors share, so a lost executor costs no result."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Spark deletes the shuffle files of a job's plan when the job ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where that is unset (local runs and tests)."""
    found = spark.conf.get(SETTING, None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = f"file://{tempfile.mkdtemp(prefix='rankloom-')}"
    return _own[app]


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def option(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session option set for a while and put back."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage, and the shuffle files it came from, end there."""
    spark = df.sparkSession
    path = fresh(spark, name)
    with option(spark, CLEANUP, "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = (path,)
    return out


def holding(df: DataFrame, *tables: DataFrame | None) -> DataFrame:
    """df, marked as a plan over these kept tables: dropping it drops them."""
    df._kept_at = tuple(p for t in tables if t is not None for p in getattr(t, "_kept_at", ()))
    return df


def drop(*tables: DataFrame | None) -> None:
    """Deletes kept tables that no plan reads any more."""
    for t in tables:
        for path in getattr(t, "_kept_at", ()) if t is not None else ():
            p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most so many rows in an Arrow batch, so that a worker holds a few megabytes of text at once.  Lower settings stay."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= rows:
        spark.conf.set(setting, str(rows))


def some_rows(df: DataFrame, key: Column, most: int) -> list:
    """All rows, or about ``most`` of them if there are more: those whose key, a 64-bit hash, is low.

    A cut by the hash needs no order, so tasks send the driver only what it keeps: a top-k
    would send it k rows from every task.
    """
    n = df.count()
    if n > most:
        df = df.where(key < int(most / n * 2.0**64) - (1 << 63))
    return df.collect()
