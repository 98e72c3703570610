"""The analyzer: lattice, decoder against full enumeration, rules, selection, public functions."""

import pytest
from pyspark.sql import functions as F

from tessera.analysis import api, decode, rules, select
from tessera.analysis.lattice import Lattice, ascii_runs, char_class
from tessera.analysis.model import Model, user_words
from tessera.analysis.rules import Token
from tessera.analysis.seed import seed_model

M = seed_model()


def shown(tokens):
    return " ".join(f"{t.text}/{t.pos}" for t in tokens)


def toks(text):
    """'가/X 나/Y | 다/Z': words apart by a bar."""
    out = []
    for k, word in enumerate(text.split(" | ")):
        for m in word.split():
            f, p = m.rsplit("/", 1)
            out.append(Token(f, p, k * 10, k * 10 + 5))
    return out


def test_runs():
    assert ascii_runs("b2b BM25 GPT-4o 2024") == [(0, 3, "SL"), (4, 8, "SL"), (9, 15, "SL"), (16, 20, "SN")]
    assert ascii_runs("2026.04.0924,991") == [(0, 10, "SN"), (10, 16, "SN")]
    assert ascii_runs("3.14, 1,900. x-") == [(0, 4, "SN"), (6, 11, "SN"), (13, 14, "SL")]


@pytest.mark.parametrize(("c", "tag"), [("·", "SP"), ("…", "SE"), ("~", "SO"), ("「", "SS"), ("a", "SL"), ("7", "SN"), ("漢", "SH"), ("é", "SW"), ("ㅋ", "SW"), ("%", "SW"), ("가", "NNG")])
def test_character_classes(spark, c, tag):
    from tessera.functions.text import char_class as column

    assert char_class(c) == tag and spark.range(1).select(column(F.lit(c)).alias("t")).first().t == tag


def enumerate_best(model, text):
    """Cheapest path by trying all of them."""
    arcs = Lattice(model, text).arcs()
    best = [float("inf")]

    def go(i, before, last, cost):
        if i == len(text):
            best[0] = min(best[0], cost + model.transition(before, last, "EOS"))
            return
        if text[i].isspace():
            go(i + 1, before, last, cost)
        for a in arcs:
            if a.start == i:
                c, x, y = cost + a.cost, before, last
                c += next((b for p, t, b in model.word_bigrams.get(a.morphemes[0][0], ()) if p == y and t == a.morphemes[0][1]), 0.0)
                for _, t in a.morphemes:
                    c += model.transition(x, y, t)
                    x, y = y, t
                go(a.end, x, y, c)

    go(0, "BOS", "BOS", 0.0)
    return best[0]


@pytest.mark.parametrize("text", ["나는 새", "갔다", "한국에", "a1 새", "집이다"])
def test_decoder_finds_the_cheapest_path(text):
    arcs = Lattice(M, text).arcs()
    paths = decode.best_paths(M, text, arcs, 3)
    assert paths[0][0] == pytest.approx(enumerate_best(M, text))
    assert [c for c, _ in paths] == sorted(c for c, _ in paths)


@pytest.mark.parametrize(
    ("names", "before", "after"),
    [
        (["auxiliary"], "먹/VV 고/EC | 있/VA 다/EF", "먹/VV 고/EC 있/VX 다/EF"),
        (["conjunction"], "너/NP 와/JKB | 나/NP", "너/NP 와/JC 나/NP"),
        (["conjunction"], "너/NP 와/JKB | 가/VV", "너/NP 와/JKB 가/VV"),
        (["bound_noun"], "먹/VV ㄹ/ETM | 것/NNG", "먹/VV ㄹ/ETM 것/NNB"),
        (["bound_noun"], "2024/SN 년/NNG", "2024/SN 년/NNB"),
        (["complement"], "물/NNG 이/JKS | 되/VV", "물/NNG 이/JKC 되/VV"),
        (["final"], "가/VV | 다/EC ./SF", "가/VV 다/EF ./SF"),
        (["final"], "가/VV 라/EC", "가/VV 아라/EF"),
        (["copula"], "책/NNG 이다/EF", "책/NNG 이/VCP 다/EF"),
        (["copula"], "먹/VV 이다/EF", "먹/VV 이다/EF"),
        (["present_copula"], "책/NNG 다/JX", "책/NNG 이/VCP 다/EF"),
        (["polite"], "먹/VV 거든/EF 요/JX", "먹/VV 거든요/EF"),
        (["polite"], "먹/VV 거든/EF | 요/JX", "먹/VV 거든/EF 요/JX"),
        (["haeyo"], "공부/NNG 해/NNG 요/JX", "공부/NNG 하/XSV 아요/EF"),
        (["ending_pairs"], "먹/VV 어/EC 도/JX", "먹/VV 어도/EC"),
        (["such"], "그렇/VA ㄴ/ETM", "그런/MM"),
        (["honorific_yo"], "가/VV 시/EP 어요/EF", "가/VV 세요/EF"),
        (["quote"], "'/SS 고/EC", "'/SS 고/JKQ"),
        (["quote"], "'/SS | 고/EC", "'/SS 고/EC"),
        (["so"], "그렇/VA 아서/EC", "그래서/MAJ"),
        (["me"], "절/VV 는/ETM | 집/NNG", "저/NP 는/JX 집/NNG"),
        (["promise"], "놀/VV 게/EC", "놀/VV ㄹ게/EF"),
        (["degree"], "3/SN 도/JX 이/VCP", "3/SN 도/NNB 이/VCP"),
        (["eat_honorific"], "드시/VV 다/EF", "들/VV 시/EP 다/EF"),
    ],
)
def test_rules(names, before, after):
    assert shown(rules.correct(toks(before), names)) == after


def test_both_orders_have_all_their_rules():
    assert len(rules.FIRST) == 29 and len(rules.SECOND) == 39 and set(rules.FIRST) < set(rules.SECOND) == set(rules.RULES)


@pytest.mark.parametrize(("text", "want"), [("학교에 갔다", "학교/NNG 에/JKB 가/VV 았/EP 다/EF"), ("깨끗한 물을 마셨다", "깨끗/XR 하/XSA ㄴ/ETM 물/NNG 을/JKO 마시/VV 었/EP 다/EF"), ("안녕하세요", "안녕/NNG 하/XSA 세요/EF")])
def test_sentences(text, want):
    assert shown(select.analyze(M, text)[1]) == want


def test_no_surface_is_invented_and_spans_are_words():
    text = "나는 2.2배다. GPT-4o 漢字 새를 봤다!"
    for cost, tokens in decode.n_best(M, text, 10):
        words = {(0, 2), (3, 9), (10, 16), (17, 19), (20, 22), (23, 26)}
        assert cost > 0 and all((t.start, t.end) in words for t in tokens)


def test_empty_text_and_user_words(spark):
    assert select.analyze(M, "") == (0.0, []) == select.analyze(M, "  ") and decode.n_best(M, "", 3) == [(0.0, [])]
    rows = spark.createDataFrame([("탄소중립", "NNG", 10, 1), ("탄소중립", "NNP", None, 2), ("", "NNG", 1, 3)], "surface string, pos string, freq int, seq int")
    assert user_words(rows) == {"탄소중립": ("NNP", 5000)}
    a = api.Analyzer(M)
    df = spark.createDataFrame([("탄소중립 목표",), (None,), ("",)], "s string")
    got = df.select(a.analyze(F.col("s")).alias("x"), a.with_user_words(user_words(rows)).analyze(F.col("s")).alias("y")).collect()
    assert shown(got[0].x.tokens) == "탄소/NNG 중립/NNG 목표/NNG" and shown(got[0].y.tokens) == "탄소중립/NNP 목표/NNG"
    assert got[1].x is None and got[2].x.tokens == [] and got[2].x.score == 0


def test_model_survives_parquet(spark, tmp_path):
    M.save(spark, str(tmp_path / "m"))
    back = Model.load(spark, str(tmp_path / "m"))
    for text in ("학교에 갔다", "나는 하늘을 나는 새를 보았다."):
        assert decode.n_best(back, text, 5) == decode.n_best(M, text, 5)


def test_reranker_overrides_beyond_its_margin():
    text = "나는 새를 보았다"
    found = decode.n_best(M, text, 10)
    first, other = found[0][1], next(t for _, t in found[1:] if t != found[0][1])
    only = set(f for f, _ in select.features(select.finish(other, M), 0, 2)) - set(f for f, _ in select.features(select.finish(first, M), 0, 1))
    feature = sorted(f for f in only if f.startswith("w:"))[0]
    for weight, want in ((100.0, True), (1.0, False)):
        m = Model(**{k: getattr(M, k) for k in ("words", "suffixes", "trigrams", "bigrams", "word_bigrams", "cache", "params", "adjective_roots")}, weights={select.bucket(feature): weight})
        picked = [f for f, _ in select.features(select.analyze(m, text)[1], 0, 1)]
        assert (feature in picked) == want


def test_hash_matches_its_column(spark):
    from tessera.functions.costs import feature_bucket

    names = ["bias", "w:정부/NNG", "", "é"]
    df = spark.createDataFrame([(n,) for n in names], "f string").select(feature_bucket(F.col("f")).alias("b"))
    assert [r.b for r in df.collect()] == [select.bucket(n) for n in names] and select.bucket("bias") == 543140


def test_greedy_near_duplicates_match_their_definition(spark):
    import random

    from tessera.operators import curate

    r = random.Random(4)
    prints, base = {}, [r.getrandbits(63) for _ in range(6)]
    for k in range(90):
        f = base[k % 6]
        for _ in range(r.randrange(5)):
            f ^= 1 << r.randrange(63)
        prints[k] = f
    df = spark.createDataFrame(list(prints.items()), "k long, f long")
    for most in (3, 6):
        kept = []
        for k, f in prints.items():
            if all((f ^ prints[j]).bit_count() > most for j in kept):
                kept.append(k)
        spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
        assert sorted(x.k for x in curate.near_duplicates(df, "k", "f", most).collect()) == kept


def test_the_registered_near_duplicate_filter_takes_six_bits(spark):
    from tessera.operators import curate
    from tessera.plans import mining
    from tessera.plans.relational import read, words

    d = "/root/testdata/sf0.001"
    prints = curate.simhash(words(read(spark, d, "documents")).select("doc_id", F.lower("form").alias("s")), "doc_id", "s").collect()
    kept = {}
    for k, f in sorted((r.doc_id, r.fingerprint & (1 << 64) - 1) for r in prints):
        if all((f ^ g).bit_count() > 6 for g in kept.values()):
            kept[k] = f
    assert sorted(r.doc_id for r in mining.near_duplicate_filter(spark, d).collect()) == sorted(kept)


@pytest.mark.parametrize("most", [0, 6, 15])
def test_bands_find_all_pairs(spark, most):
    import random

    from tessera.operators import curate

    r = random.Random(most)
    rows = [(0, 0)]
    for k in range(1, 60):
        f = r.choice(rows)[1]
        for b in r.sample(range(64), r.choice([0, most, most + 1])):
            f ^= 1 << b
        rows.append((k, f))
    kept = []
    for k, f in rows:
        if all((f ^ g).bit_count() > most for _, g in kept):
            kept.append((k, f))
    df = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in rows], "k long, f long")
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    assert sorted(x.k for x in curate.near_duplicates(df, "k", "f", most).collect()) == [k for k, _ in kept]
