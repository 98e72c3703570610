"""Connected components by alternating large-star and small-star steps, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the least node reachable. Loops are ignored."""
    now = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # sums on the map side and joins, which AQE may split, in place of windows: a node may have any number of neighbours
        least = both.groupBy("u").agg(F.min("v").alias("l")).select(F.col("u").alias("n"), F.least("u", "l").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("n")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        low = large.join(lowest, F.col("u") == F.col("n")).select("u", "v", "m")
        small = low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()
        now = stage(small, "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()
