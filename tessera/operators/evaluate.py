"""Scores of predicted against gold morphemes. Both sides are rows (sentence, form, pos), one per morpheme."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def with_f1(sums: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn", f1: str = "f1") -> DataFrame:
    """precision, recall and f1 from tp, fp, fn; 0 where undefined."""
    p, r = safe_ratio(F.col(tp), F.col(tp) + F.col(fp)), safe_ratio(F.col(tp), F.col(tp) + F.col(fn))
    return sums.withColumns({"precision": p, "recall": r}).withColumn(f1, safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def matches(gold: DataFrame, pred: DataFrame, keys: list[str], distinct: bool = False) -> DataFrame:
    """Per key: tp, fp, fn as multisets, or as sets where ``distinct``. One shuffle: both sides in one aggregation."""
    both = gold.select(*keys, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(pred.select(*keys, F.lit(0).alias("g"), F.lit(1).alias("p")))
    return matched(both, keys, distinct)


def matched(both: DataFrame, keys: list[str], distinct: bool = False) -> DataFrame:
    """``matches`` of one table: g and p say how often a row is gold and predicted. Rows hashed by a key aren't moved."""
    f = F.max if distinct else F.sum
    n = both.groupBy(*keys).agg(f("g").alias("g"), f("p").alias("p"))
    return n.select(*keys, F.least("g", "p").alias("tp"), F.greatest(F.col("p") - F.col("g"), F.lit(0)).alias("fp"), F.greatest(F.col("g") - F.col("p"), F.lit(0)).alias("fn"))


def total(matched: DataFrame, *by: str) -> DataFrame:
    g = matched.groupBy(*by) if by else matched.groupBy()
    return with_f1(g.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def by_sets(matched: DataFrame, *sets: tuple[str, ...]) -> DataFrame:
    """Sums over several groupings in one pass; columns not grouped by are null."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    return with_f1(matched.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names]).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def confusion(gold: DataFrame, pred: DataFrame, sentence: str) -> DataFrame:
    """(gold_pos, pred_pos, n): forms whose one tag of a sentence (the greatest, where there are more) differs."""
    none = F.lit(None).cast("string")
    both = gold.select(sentence, "form", F.col("pos").alias("gold_pos"), none.alias("pred_pos")).unionByName(pred.select(sentence, "form", none.alias("gold_pos"), F.col("pos").alias("pred_pos")))
    return confused(both, sentence)


def confused(both: DataFrame, sentence: str) -> DataFrame:
    """``confusion`` of one table with both tags, null where a row has but one."""
    one = both.groupBy(sentence, "form").agg(F.max("gold_pos").alias("gold_pos"), F.max("pred_pos").alias("pred_pos"))
    return one.where("gold_pos <> pred_pos").groupBy("gold_pos", "pred_pos").agg(F.count("*").alias("n"))


def compare(a: DataFrame, b: DataFrame, sentence: str, by: str | None = None) -> DataFrame:
    """Two models' per-sentence f1: sentences improved, worsened and unchanged, and the mean difference."""
    keys = [sentence, *([by] if by else [])]
    return compared(a.select(*keys, F.col("f1").alias("a")).join(b.select(*keys, F.col("f1").alias("b")), keys), by)


def both_f1(n: DataFrame, *by: str) -> DataFrame:
    """(by, a, b): the f1 of two models, from how often each row is gold (g) and either's (a, b)."""
    sums = n.groupBy(*by).agg(*[F.sum(x).alias(m + c) for m in "ab" for c, x in (("tp", F.least("g", m)), ("fp", F.greatest(F.col(m) - F.col("g"), F.lit(0))), ("fn", F.greatest(F.col("g") - F.col(m), F.lit(0))))])
    for m in "ab":
        sums = with_f1(sums, m + "tp", m + "fp", m + "fn", m)
    return sums.select(*by, "a", "b")


def compared(d: DataFrame, by: str | None = None) -> DataFrame:
    """``compare`` of one table with both models' f1, a and b."""
    d = d.withColumn("d", F.col("b") - F.col("a"))
    g = d.groupBy(by) if by else d.groupBy()
    return g.agg(F.count_if(F.col("d") > 1e-6).alias("improved"), F.count_if(F.col("d") < -1e-6).alias("worsened"), F.count_if(F.abs("d") <= 1e-6).alias("unchanged"), F.avg("d").alias("mean_delta"))


def oracle(candidates: DataFrame, sentence: str) -> DataFrame:
    """Of candidates (sentence, rank, f1): first, best and gain, and whether a perfect one is there."""
    return candidates.groupBy(sentence).agg(F.max_by("f1", -F.col("rank")).alias("first_f1"), F.max("f1").alias("oracle_f1"), F.max_by("rank", F.struct("f1", -F.col("rank"))).alias("oracle_rank"), F.max((F.col("f1") >= 1).cast("int")).alias("has_exact"))
