"""More queries over the driver's tables: mining, scoring of candidates, model tables, selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import costs
from ..operators import counts, curate, evaluate
from .relational import F1, SUMS, G, W, both_sides, read, rounded, sides, single_and_split, words

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


CAND = f"""WITH {W}, c AS (SELECT doc_id, rank, form, pos FROM (SELECT doc_id, form, pos, unnest([1, 2, 3]) AS rank FROM t) WHERE rank = 1 AND pos <> 'NNP' OR rank = 2 AND pos <> 'SN' OR rank = 3),
m AS (SELECT doc_id, rank, count(*) AS tp FROM c GROUP BY ALL), g AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
f AS (SELECT doc_id, rank, 2 * tp / (tp + n) AS f1 FROM m JOIN g USING (doc_id))"""


def _candidates(docs, keep_tp: bool = False):
    """Three stand-in candidates per text: without proper nouns, without numbers, complete; with their F1 against all words."""
    w = words(docs)
    c = w.select("doc_id", "pos", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("rank")).where("(rank = 1 and pos <> 'NNP') or (rank = 2 and pos <> 'SN') or rank = 3")
    m = c.groupBy("doc_id", "rank").agg(F.count("*").alias("tp"))
    g = w.groupBy("doc_id").agg(F.count("*").alias("n"))
    return m.join(g, "doc_id").select("doc_id", "rank", *(["tp"] if keep_tp else []), (2 * F.col("tp") / (F.col("tp") + F.col("n"))).alias("f1"))


@query(CAND + """, o AS (SELECT doc_id, arg_min(f1, rank) AS first, max(f1) AS best, min(rank) FILTER (WHERE f1 = bf) AS best_rank, max((f1 >= 1)::INT) AS exact FROM (SELECT *, max(f1) OVER (PARTITION BY doc_id) AS bf FROM f) GROUP BY doc_id)
SELECT best_rank, count(*) AS texts, sum(exact)::BIGINT AS with_exact, count(*) FILTER (WHERE best > first + 1e-9) AS improvable, round(avg(best - first), 6) AS gain FROM o GROUP BY best_rank""")
def oracle_at_k(spark, d):
    o = evaluate.oracle(_candidates(read(spark, d, "documents")), "doc_id")
    return o.groupBy(F.col("oracle_rank").alias("best_rank")).agg(F.count("*").alias("texts"), F.sum("has_exact").cast("bigint").alias("with_exact"), F.count_if(F.col("oracle_f1") > F.col("first_f1") + 1e-9).alias("improvable"), F.round(F.avg(F.col("oracle_f1") - F.col("first_f1")), 6).alias("gain"))


@query(f"""WITH {G}, n AS (SELECT doc_id, lang, count(*) FILTER (WHERE g = 1 AND pos = 'SF') AS want, count(*) FILTER (WHERE p = 1 AND pos = 'SF') AS got FROM b GROUP BY ALL)
SELECT lang, count(*) AS texts, round(avg((got >= want)::INT), 6) AS hit_rate, avg((got >= want)::INT) >= 0.9 AS passed FROM n GROUP BY lang""")
def tag_hit_rate(spark, d):
    """Texts in which a tag is predicted at least as often as it is there; passed from 90 %."""
    gold, pred = sides(read(spark, d, "documents"))
    n = gold.withColumn("k", F.lit(0)).union(pred.withColumn("k", F.lit(1))).groupBy("doc_id", "lang").agg(*[F.count_if((F.col("k") == k) & (F.col("pos") == "SF")).alias(c) for k, c in ((0, "want"), (1, "got"))])
    hit = F.avg((F.col("got") >= F.col("want")).cast("int"))
    return n.groupBy("lang").agg(F.count("*").alias("texts"), F.round(hit, 6).alias("hit_rate"), (hit >= 0.9).alias("passed"))


@query(f"WITH {W}, s AS (SELECT doc_id, lang, string_agg(form, ' ' ORDER BY idx) AS a, string_agg(lower(form), ' ' ORDER BY idx) AS b FROM t GROUP BY ALL) SELECT lang, count(*) AS texts, count(*) FILTER (WHERE a = b) AS exact FROM s GROUP BY lang")
def exact_match(spark, d):
    """Texts whose whole prediction equals the gold sequence: arrays compared within a row, no join."""
    from ..functions.text import eojeols

    docs = read(spark, d, "documents").select("lang", eojeols(F.col("text")).alias("a")).where("size(a) > 0")
    return docs.groupBy("lang").agg(F.count("*").alias("texts"), F.count_if(F.col("a") == F.transform("a", F.lower)).alias("exact"))


@query(f"""WITH {W}, c AS (SELECT coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY idx), 'BOS') AS before, pos FROM t), n AS (SELECT before, pos, count(*) AS n FROM c GROUP BY ALL) SELECT before, pos, n, round(n / sum(n) OVER (PARTITION BY before), 6) AS share FROM n""")
def context_distribution(spark, d):
    """Tags by the tag before, with shares."""
    w = words(read(spark, d, "documents"))
    c = w.select(F.coalesce(F.lag("pos").over(Window.partitionBy("doc_id").orderBy("idx")), F.lit("BOS")).alias("before"), "pos")
    n = c.groupBy("before", "pos").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("before")), 6))


@query(f"""WITH {W}, n AS (SELECT lower(form) AS form, pos, count(*) AS n FROM t GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY form)::BIGINT AS total, row_number() OVER (PARTITION BY form ORDER BY n DESC, pos) AS k FROM n)
SELECT form, pos, n, total FROM r WHERE k = 2 AND total >= 100 AND n >= 0.15 * total""")
def secondary_tags(spark, d):
    """A word's second tag, of words seen 100 times or more with 15 % for it."""
    n = words(read(spark, d, "documents")).groupBy(F.lower("form").alias("form"), "pos").agg(F.count("*").alias("n"))
    r = counts.ranked(n, "form", [F.desc("n"), F.col("pos")], "k").withColumn("total", F.sum("n").over(Window.partitionBy("form")))
    return r.where("k = 2 and total >= 100 and n >= 0.15 * total").select("form", "pos", "n", "total")


@query(f"""WITH {W}, m AS (SELECT lower(form) AS form, count(*) FILTER (WHERE pos = 'NNG') AS merged, count(*) FILTER (WHERE pos = 'NNP') AS split FROM t GROUP BY 1) SELECT form, merged, split FROM m WHERE merged > 0 AND merged >= greatest(split, 1)""")
def lexicalized_words(spark, d):
    """Words whose merged reading is at least as frequent as the other."""
    m = words(read(spark, d, "documents")).groupBy(F.lower("form").alias("form")).agg(F.count_if(F.col("pos") == "NNG").alias("merged"), F.count_if(F.col("pos") == "NNP").alias("split"))
    return m.where((F.col("merged") > 0) & (F.col("merged") >= F.greatest("split", F.lit(1))))


@query(f"""WITH {W}, f AS (SELECT DISTINCT lower(form) AS form FROM t WHERE length(form) BETWEEN 3 AND 12), p(stem) AS (VALUES ('the'), ('and'), ('with'), ('der'), ('que')) SELECT form, stem FROM f JOIN p ON starts_with(form, stem) AND form <> stem""")
def prefix_semi_join(spark, d):
    """Words that begin with one of a few listed stems."""
    f = words(read(spark, d, "documents")).select(F.lower("form").alias("form")).where(F.length("form").between(3, 12)).distinct()
    stems = spark.createDataFrame([(s,) for s in ("the", "and", "with", "der", "que")], "stem string")
    return f.join(F.broadcast(stems), F.col("form").startswith(F.col("stem")) & (F.col("form") != F.col("stem")))


@query(f"WITH {G}, n AS (SELECT doc_id, form, pos, lang, sum(g) AS g, sum(p) AS p FROM b GROUP BY ALL), m AS (SELECT doc_id, least(g, p) AS tp, greatest(p - g, 0) AS fp, greatest(g - p, 0) AS fn FROM n), j AS (SELECT quality, m.* FROM m JOIN labels USING (doc_id)) SELECT coalesce(quality::VARCHAR, 'all') AS quality, {SUMS}, {F1} FROM j GROUP BY GROUPING SETS ((), (quality))")
def f1_by_confidence(spark, d):
    """Scores overall and by the kind of label, in one pass."""
    m = evaluate.matched(both_sides(read(spark, d, "documents")), ["doc_id", "lang", "form", "pos"])
    # a row per text meets its label
    sums = m.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    scores = evaluate.by_sets(sums.join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id"), (), ("quality",))
    return rounded(scores.withColumn("quality", F.coalesce(F.col("quality").cast("string"), F.lit("all"))))


_MARGINS = (0.0, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)


@query(CAND + f""", k AS (SELECT doc_id, max(tp) FILTER (WHERE rank = 1) AS a, max(tp) FILTER (WHERE rank = 2) AS b FROM m GROUP BY doc_id), p AS (SELECT k.doc_id, abs(coalesce(b, 0) - coalesce(a, 0)) AS delta, coalesce(x.f1, 0) AS fa, coalesce(y.f1, 0) AS fb FROM k LEFT JOIN f x ON x.doc_id = k.doc_id AND x.rank = 1 LEFT JOIN f y ON y.doc_id = k.doc_id AND y.rank = 2),
z AS (SELECT unnest([{", ".join(map(str, _MARGINS))}])::DOUBLE AS margin)
SELECT margin, count(*) FILTER (WHERE delta > margin) AS overrides, count(*) FILTER (WHERE delta > margin AND fb > fa) AS improved, count(*) FILTER (WHERE delta > margin AND fb < fa) AS worsened FROM p, z GROUP BY margin""")
def margin_sweep(spark, d):
    """How often each margin lets the second candidate override the first, and whether its F1 is better or worse then."""
    c = _candidates(read(spark, d, "documents"), keep_tp=True).where("rank <= 2")
    one = lambda k, name: F.coalesce(F.max(F.when(F.col("rank") == k, F.col(name))), F.lit(0))
    both = c.groupBy("doc_id").agg(one(1, "f1").alias("fa"), one(2, "f1").alias("fb"), F.abs(one(2, "tp") - one(1, "tp")).alias("delta"))
    x = both.crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in _MARGINS], "margin double")))
    over = F.col("delta") > F.col("margin")
    return x.groupBy("margin").agg(F.count_if(over).alias("overrides"), F.count_if(over & (F.col("fb") > F.col("fa"))).alias("improved"), F.count_if(over & (F.col("fb") < F.col("fa"))).alias("worsened"))


_GRID = [(round(0.1 * p, 2), round(0.2 * b, 2)) for p in range(15) for b in range(15)]


@query(f"""WITH {W}, q AS (SELECT lead(form) OVER (PARTITION BY doc_id ORDER BY idx) AS nxt, form FROM t), s AS (SELECT lower(form || nxt) AS form, count(*) AS split FROM q WHERE nxt IS NOT NULL GROUP BY 1), o AS (SELECT lower(form) AS form, count(*) AS single FROM t GROUP BY 1),
x AS (SELECT length(form) AS k, single >= split AS gold, ln(single) AS ls, ln(split) AS lp FROM o JOIN s USING (form)), g(penalty, bonus) AS (VALUES {", ".join(f"({p}::DOUBLE, {b}::DOUBLE)" for p, b in _GRID)}),
h AS (SELECT penalty, bonus, count(*) FILTER (WHERE (round(-ls - bonus * (k - 1), 9) <= round(-lp - bonus * (k - 2) + penalty, 9)) = gold) AS hits FROM x, g GROUP BY ALL)
SELECT penalty, bonus, hits, row_number() OVER (ORDER BY hits DESC, penalty, bonus)::INT AS rank FROM h""")
def parameter_grid(spark, d):
    """225 settings of morpheme penalty and length bonus, scored in one pass by how often the cheaper of two analyses
    of a word, whole or cut in two, is the more frequent one; few settings, so they are ranked together."""
    # words alike in length and counts are scored together
    alike = single_and_split(read(spark, d, "documents")).groupBy(F.length("form").alias("k"), "single", "split").agg(F.count("*").alias("n"))
    x = alike.select("k", "n", (F.col("single") >= F.col("split")).alias("gold"), F.log("single").alias("ls"), F.log("split").alias("lp"))
    x = x.crossJoin(F.broadcast(spark.createDataFrame(_GRID, "penalty double, bonus double")))
    whole, cut = F.round(-F.col("ls") - F.col("bonus") * (F.col("k") - 1), 9), F.round(-F.col("lp") - F.col("bonus") * (F.col("k") - 2) + F.col("penalty"), 9)
    h = x.groupBy("penalty", "bonus").agg(F.sum(F.when((whole <= cut) == F.col("gold"), F.col("n")).otherwise(0)).alias("hits"))
    return h.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("hits"), "penalty", "bonus")))


@query(f"""WITH {W}, b AS (SELECT pos AS p1, lead(pos) OVER (PARTITION BY doc_id ORDER BY idx) AS p2 FROM t), n AS (SELECT p1, p2, count(*) AS n FROM b WHERE p2 IS NOT NULL GROUP BY ALL), c AS (SELECT p1, p2, -ln(n / sum(n) OVER ()) AS cost FROM n)
SELECT p1, p2, round(cost, 6) AS cost, (1 + floor((cost - (min(cost) OVER ())) / ((max(cost) OVER ()) - (min(cost) OVER ())) * 254 + 0.5))::INT AS q FROM c""")
def bigram_table(spark, d):
    """Tag-pair costs (share of all pairs) and their 8-bit codes."""
    w = words(read(spark, d, "documents"))
    b = w.select(F.col("pos").alias("p1"), F.lead("pos").over(Window.partitionBy("doc_id").orderBy("idx")).alias("p2")).where("p2 is not null")
    n = b.groupBy("p1", "p2").agg(F.count("*").alias("n"))
    c = n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("p1", "p2", (-F.log(F.col("n") / F.col("all"))).alias("cost"))
    e = c.agg(F.min("cost").alias("lo"), F.max("cost").alias("hi"))
    return c.crossJoin(F.broadcast(e)).select("p1", "p2", F.round("cost", 6).alias("cost"), costs.quantize_range(F.col("cost"), F.col("lo"), F.col("hi")).alias("q"))


@query()
def near_duplicate_filter(spark, d):
    """Greedy keep-first by 64-bit fingerprints within 6 bits, the reference's default. The hash isn't the SQL engine's: tested by brute force."""
    spark.sparkContext.getCheckpointDir() or _local_checkpoints(spark)
    docs = read(spark, d, "documents")
    f = words(docs).select("doc_id", F.lower("form").alias("s"))
    prints = curate.simhash(f, "doc_id", "s")
    return curate.near_duplicates(prints, "doc_id", "fingerprint", 6).select("doc_id")


def _local_checkpoints(spark) -> None:
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-"))
