"""Shared plumbing: column names that cannot clash, durable intermediate tables, broadcast guards."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A build side is broadcast only when its measured size stays under this many bytes.
BROADCAST_BYTES = 64 << 20

_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[str] = []


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Names derived from ``bases`` that no column of ``df`` has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for base in bases:
        name = base
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """The column of exactly this name, dots and backquotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def added(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with more columns. Those that are there stay: a name that is taken gets underscores before it."""
    return df.withColumns(dict(zip(fresh(df, *columns), columns.values())))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key of a document row that a recomputed task reproduces: equal rows share it, others don't."""
    return F.xxhash64(col(doc_id), col(text))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where the session is local and names none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(shared_dir, "local", None):
        shared_dir.local = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return shared_dir.local


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and executors may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"
    # the shuffle files behind the table are of no more use once it is written
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Delete every table that ``stage`` wrote in this process; results not yet written must be written first."""
    jvm = spark.sparkContext._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a staged table is known to fit a broadcast, judged by the optimizer's size of its files."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint when its measured size allows; else the join stays a shuffle join."""
    return F.broadcast(df) if small(df, limit) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
