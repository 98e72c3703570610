"""Queries of the analyzer with the seed model: over the documents, and over Korean rows dealt to them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..analysis import api, rules, sql
from ..analysis.seed import seed_model
from ..functions import text
from . import korean
from .relational import read, spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: A case or more for each correction rule: tokens before and after, words apart by a bar, with their length after a colon.
CASES = [tuple(x.split("; ")) for x in """
auxiliary; 먹/VV 고/EC | 있/VA 다/EF; 먹/VV 고/EC 있/VX 다/EF
conjunction; 너/NP 와/JKB | 나/NP; 너/NP 와/JC 나/NP
conjunction; 너/NP 와/JKB | 가/VV; 너/NP 와/JKB 가/VV
bound_noun; 먹/VV ㄹ/ETM | 것/NNG; 먹/VV ㄹ/ETM 것/NNB
bound_noun; 2024/SN 년/NNG; 2024/SN 년/NNB
affix; 사회/NNG 적/NNG; 사회/NNG 적/XSN
affix; 비/NNG 성/NNG; 비/XPN 성/NNG
affix; 사회/NNG 성/NNG 적/NNG; 사회/NNG 성/XSN 적/NNG
determiner; 이/NP | 사람/NNG; 이/MM 사람/NNG
complement; 물/NNG 이/JKS | 되/VV; 물/NNG 이/JKC 되/VV
or; 책/NNG 나/JX | 물/NNG; 책/NNG 나/JC 물/NNG
bound_without; 먹/VV 고/EC | 말/NNB; 먹/VV 고/EC 말/NNG
lone_prefix; 저/XPN | 사람/NNG; 저/MM 사람/NNG
final; 가/VV | 다/EC ./SF; 가/VV 다/EF ./SF
final; 가/VV 라/EC; 가/VV 아라/EF
imperative; 먹/VV 라/EF; 먹/VV 어라/EF
come; 오너/NNG 라/EF; 오/VV 너라/EF
eat_honorific; 드시/VV 다/EF; 들/VV 시/EP 다/EF
copula; 책/NNG 이다/EF; 책/NNG 이/VCP 다/EF
copula; 먹/VV 이다/EF; 먹/VV 이다/EF
question_copula; 책/NNG 인가/NNG; 책/NNG 이/VCP ㄴ가/EF
present_copula; 책/NNG 다/JX; 책/NNG 이/VCP 다/EF
past_copula; 학생/NNG 잇/VV 었/EP; 학생/NNG 이/VCP 었/EP
my; 제/NP; 저/NP
me; 절/VV 는/ETM | 집/NNG; 저/NP 는/JX 집/NNG
noun_back; 이/VCP ㄴ지/EC; 인지/NNG
nde; 크/VA ㄴ/ETM 데/NNB; 크/VA ㄴ데/EC
haeyo; 공부/NNG 해/NNG 요/JX; 공부/NNG 하/XSV 아요/EF
polite; 먹/VV 거든/EF 요/JX; 먹/VV 거든요/EF
polite; 먹/VV 거든/EF | 요/JX; 먹/VV 거든/EF 요/JX
ending_pairs; 먹/VV 어/EC 도/JX; 먹/VV 어도/EC
adverb_copula; 정말/MAG 야/JX; 정말/MAG 이/VCP 야/EF
what_time; 몇/MM | 시야/NNG; 몇/MM 시/NNB 이/VCP 야/EF
degree; 3/SN 도/JX 이/VCP; 3/SN 도/NNB 이/VCP
one; 하/VV ㄴ/ETM:1 | 사람/NNG; 한/MM 사람/NNG
promise; 놀/VV 게/EC; 놀/VV ㄹ게/EF
hither; 이리/NNP | 오/VV; 이리/MAG 오/VV
adverb_go; 잘/MAG 가/JKS; 잘/MAG 가/VV
adverb_come; 빨리/MAG 와/JKB; 빨리/MAG 오/VV 아/EF
try; 가/JKS 보/VV 아/EC; 가/VV 보/VX 아/EC
determiners; 새/NNG | 책/NNG; 새/MM 책/NNG
such; 그렇/VA ㄴ/ETM; 그런/MM
honorific_yo; 가/VV 시/EP 어요/EF; 가/VV 세요/EF
so; 그렇/VA 아서/EC; 그래서/MAJ
during; 사용/NNG | 시/NNG; 사용/NNG 시/NNB
quote; '/SS 고/EC; '/SS 고/JKQ
quote; '/SS | 고/EC; '/SS 고/EC
""".strip().split("\n")]


def _corrected(case: str) -> str:
    name, before = case.split("; ")
    tokens, at = [], 0
    for word in before.split(" | "):
        word, _, size = word.partition(":")
        ms = [m.rsplit("/", 1) for m in word.split()]
        end = at + (int(size) if size else sum(len(f) for f, _ in ms))
        tokens += [rules.Token(f, p, at, end) for f, p in ms]
        at = end + 1
    return " ".join(f"{t.text}/{t.pos}" for t in rules.correct(tokens, [name]))


@query("SELECT doc_id, k::INT AS k, result FROM (SELECT doc_id, unnest([0, 1, 2, 3]) AS k, unnest([" + ", ".join(korean.dealt_sql([c[2] for c in CASES], k) for k in range(4)) + "]) AS result FROM documents)")
def correction_rules(spark, d):
    """Each of the 39 rules on the cases dealt to the documents."""
    x = korean.ids(spark, d).select("doc_id", F.posexplode(F.array(*[korean.dealt(["; ".join(c[:2]) for c in CASES], k) for k in range(4)])).alias("k", "case"))

    def run(cases: pa.Array) -> pa.Array:
        return pa.array([_corrected(c) for c in cases.to_pylist()], pa.string())

    return x.select("doc_id", "k", F.arrow_udf(run, "string")("case").alias("result"))


def _document_sentences(spark, d):
    """(doc_id, start, sentence) of the documents whole; a sentence is a lattice of its own."""
    docs = spread(read(spark, d, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.inline(text.segments(F.col("text")))).where("text <> ''").select("doc_id", "start", F.col("text").alias("sentence"))


def _shown(tokens):
    return F.array_join(F.transform(tokens, lambda t: F.concat(t["text"], F.lit("/"), t["pos"])), " ")


@query()
def analyze_pos_counts(spark, d):
    """Tokens by tag over all documents."""
    counts = api.Analyzer(seed_model()).token_counts(spread(read(spark, d, "documents").select("doc_id", "text")), "text")
    forms = counts.groupBy("pos", "text").agg(F.sum("n").alias("n"))
    return forms.groupBy("pos").agg(F.sum("n").alias("n"), F.count("*").alias("forms"))


@query()
def analyze_nbest(spark, d):
    """Ten candidates of every sentence of the documents: how many there are, and their spread of scores."""
    c = F.col("c")
    out = _document_sentences(spark, d).select("doc_id", "start", api.Analyzer(seed_model()).n_best(F.col("sentence"), 10).alias("c"))
    return out.select("doc_id", "start", F.size(c).alias("candidates"), F.round(c[0]["score"], 4).alias("best"), F.round(F.get(c, F.size(c) - 1)["score"], 4).alias("last"), _shown(c[0]["tokens"]).alias("analysis"))


_WORDS = [(s, p) for s, e in seed_model().words.items() for p, _ in e]


@query(f"""WITH s AS (SELECT doc_id, {korean.joined_sql([korean.dealt_sql(p[0], k, k * k) for k, p in enumerate(korean.PARTS)])} AS s FROM documents), w(form, pos) AS (VALUES {", ".join(f"('{s}', '{p}')" for s, p in _WORDS)}),
p AS (SELECT doc_id, s, unnest(range(0, length(s))) AS start FROM s) SELECT doc_id, start::INT AS start, (start + length(form))::INT AS "end", form, pos FROM p JOIN w ON s[start + 1:start + length(form)] = form""")
def lattice_words(spark, d):
    """Arcs of single dictionary words, at every place of the dealt sentences."""
    arcs = korean.sentences(spark, d).select("doc_id", F.explode(api.Analyzer(seed_model()).arcs(F.col("sentence"))).alias("a"))
    one = arcs.where("size(a.morphemes) = 1").select("doc_id", "a.start", "a.end", F.col("a.morphemes")[0]["form"].alias("form"), F.col("a.morphemes")[0]["pos"].alias("pos")).distinct()
    words = spark.createDataFrame(_WORDS, "form string, pos string")  # as small as the seed model
    return one.join(F.broadcast(words), ["form", "pos"], "left_semi").where(F.col("end") - F.col("start") == F.length("form"))


@query()
def lattice_arcs(spark, d):
    """All candidate arcs of every sentence of the documents, by kind: their number and mean cost."""
    out = _document_sentences(spark, d).select("doc_id", F.inline(api.Analyzer(seed_model()).arc_sums(F.col("sentence"))))
    return out.groupBy("doc_id", "source").agg(F.sum("arcs").alias("arcs"), F.round(F.sum("cost") / F.sum("arcs"), 4).alias("cost"))


@query(f"SELECT doc_id, {korean._expected(lambda m: m.split('/')[0] if m.split('/')[1] in ('NNG', 'NNP') else '')} AS nouns, {korean._expected()} AS tokens FROM documents")
def sql_functions(spark, d):
    """The analyzer called from SQL."""
    sql.register(spark, seed_model())
    korean.sentences(spark, d).createOrReplaceTempView("tessera_sentences")
    return spark.sql("SELECT doc_id, array_join(ko_nouns(sentence), ' ') AS nouns, array_join(transform(ko_tokens(sentence), t -> t.text || '/' || t.pos), ' ') AS tokens FROM tessera_sentences")


@query(f"SELECT doc_id, {korean._expected()} AS own, {korean.joined_sql([korean.dealt_sql([w + '/NNG' for w in korean.PARTS[2][0]], 2, 4)])} AS simple, 0 AS failed FROM documents")
def analyzers_by_name(spark, d):
    """Analyzers called alike: the own one, a simple one, and one that fails, whose readings are empty."""
    s = korean.sentences(spark, d)
    third = lambda t: [(t.split(" ")[-2], "NNG")]
    named = {"own": sql.own(seed_model()), "simple": sql.safe(third), "failed": sql.safe(lambda t: [(t[10**6], "")])}
    return s.select("doc_id", *[(F.size(f(F.col("sentence"))) if n == "failed" else _shown(f(F.col("sentence")))).alias(n) for n, f in named.items()])


@query(f"SELECT doc_id, {korean._expected(lambda m: m.split('/')[0] if m.split('/')[1] in api.SEARCH_TAGS else '')} AS terms FROM documents")
def tokenizer_terms(spark, d):
    return korean.sentences(spark, d).select("doc_id", F.array_join(sql.Tokenizer(seed_model()).terms(F.col("sentence")), " ").alias("terms"))
