"""Writers of tokens, candidate pools, batches and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def tokens_json(df: DataFrame, tokens: str, path: str) -> None:
    """One JSON array of [form, tag] pairs per row, an empty one for an empty text."""
    df.select(F.to_json(F.transform(tokens, lambda t: F.array(t["text"], t["pos"]))).alias("value")).write.text(path)


def tokens_tsv(df: DataFrame, tokens: str, path: str) -> None:
    """Lines of form and tag, each text closed by a line of dashes."""
    pairs = F.transform(tokens, lambda t: F.concat_ws("\t", t["text"], t["pos"]))
    df.select(F.concat_ws("\n", F.concat(pairs, F.array(F.lit("---")))).alias("value")).write.text(path)


def append_daily(df: DataFrame, path: str, domain: str = "domain", date: str = "date") -> None:
    df.write.mode("append").partitionBy(domain, date).option("compression", "gzip").json(path)


def split(df: DataFrame, condition, yes: str, no: str) -> None:
    """Two outputs by a condition (null counts as no); neither may exist."""
    df.where(condition).write.mode("errorifexists").json(yes)
    df.where(~F.coalesce(condition, F.lit(False))).write.mode("errorifexists").json(no)


def free_version(spark: SparkSession, root: str, version: str) -> str:
    """``version``, or the first of version.2, version.3, ... that isn't there yet."""
    jvm = spark._jvm
    base, k, name = jvm.org.apache.hadoop.fs.Path(root), 1, version
    files = base.getFileSystem(spark._jsc.hadoopConfiguration())
    while files.exists(jvm.org.apache.hadoop.fs.Path(base, f"v={name}")):
        k += 1
        name = f"{version}.{k}"
    return name


def publish(df: DataFrame, root: str, version: str) -> str:
    """A new version of a table beside the old ones, which stay readable: going back is reading another version."""
    path = f"{root}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def chunks(df: DataFrame, order: str, size: int, path: str) -> None:
    """Files of ``size`` rows in order. The table is a review queue, small enough to number in one window."""
    df.withColumn("chunk", F.floor((F.row_number().over(Window.orderBy(order)) - 1) / size)).write.partitionBy("chunk").json(path)


def report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.option("header", True).csv(path)
