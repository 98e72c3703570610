"""Admission of dictionary layers: gate, append, score, keep or go back. Dictionaries are versioned tables, so going
back is reading the version before."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import curate
from ..sources import writers


@dataclass
class Outcome:
    layer: str
    added: int
    decision: str
    scores: dict[str, float] | None
    version: str


def decide(base: dict[str, float], new: dict[str, float], tolerance: float = 0.10) -> str:
    """'pass', or why not: the overall score fell, or a domain's by more than ``tolerance``."""
    if new["overall"] < base["overall"]:
        return f"reject_overall ({new['overall'] - base['overall']:+.4f})"
    for name, score in new.items():
        if name != "overall" and score < base.get(name, 0) - tolerance:
            return f"reject_domain_{name} ({score - base.get(name, 0):+.4f})"
    return "pass"


def run_layer(pool: DataFrame, gate: tuple, root: str, version: str, score: Callable[[DataFrame], dict[str, float]], base: dict[str, float], log: str | None = None, tolerance: float = 0.10, stop: list[str] | None = None) -> Outcome:
    """Appends what passes ``gate`` to version ``version`` of the dictionary (surface, pos, freq) under ``root``, as a
    new version; ``score`` gets the new dictionary. A rejected or failed layer leaves the old version in force; what it
    wrote stays beside it, and another attempt gets a name of its own."""
    spark, name = pool.sparkSession, gate[0]
    passed = curate.gate(pool, [gate], stop).select("surface", "pos", F.col("frequency").alias("freq"))
    old = spark.read.parquet(f"{root}/v={version}")
    fresh = passed.join(old.select("surface", "pos"), ["surface", "pos"], "left_anti").dropDuplicates(["surface", "pos"])
    scores: dict[str, float] | None = None
    added = fresh.count()
    if not passed.take(1):
        out = Outcome(name, 0, "skip_empty", None, version)
    else:
        new = writers.free_version(spark, root, f"{version}-{name}")
        path = writers.publish(curate.append_absent(old, fresh.select(*old.columns), ["surface", "pos"]), root, new)
        try:
            scores = score(spark.read.parquet(path))
            decision = decide(base, scores, tolerance)
        except Exception as e:  # whatever the scorer raises: the layer isn't admitted, and the log says why
            decision = f"reject_error ({type(e).__name__})"
        out = Outcome(name, added if decision == "pass" else 0, decision, scores, new if decision == "pass" else version)
    if log:
        line = [(name, out.added, out.decision, *[float((scores or {}).get("overall", float("nan")))], "\t".join(f"{k}={v}" for k, v in (scores or {}).items() if k != "overall"))]
        logged = spark.createDataFrame(line, "layer string, added long, decision string, overall double, domains string").withColumn("at", F.current_timestamp())
        logged.coalesce(1).write.mode("append").option("sep", "\t").csv(log)
    return out
