"""An extension: analysis and dedup of arriving documents with Structured Streaming (batch jobs need none of it)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..analysis.api import Analyzer
from ..functions.text import collapse_key


def analyzed(stream: DataFrame, analyzer: Analyzer, text: str = "text") -> DataFrame:
    """Rows with their analysis; stateless."""
    return stream.withColumn("analysis", analyzer.analyze(F.col(text)))


def first_seen(stream: DataFrame, time: str, text: str = "text", wait: str = "1 hour") -> DataFrame:
    """Rows whose text, white space apart, hasn't come within ``wait``; later rows than that are dropped."""
    keyed = stream.withWatermark(time, wait).withColumn("_key", F.md5(collapse_key(F.col(text))))
    return keyed.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def counts(stream: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def run_once(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what there is and stop; the checkpoint makes a restart go on where the last run ended."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
