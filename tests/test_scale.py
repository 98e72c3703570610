"""Figures that must not outgrow the input: time for one long row, rows and bytes that are shuffled, memory of a task."""

import time

from pyspark.sql import functions as F

from tessera.functions import text


def exchanges(df) -> str:
    """The physical plan's shuffles, one a line."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "\n".join(x.strip() for x in plan.splitlines() if "Exchange hashpartitioning" in x or "Exchange RoundRobin" in x)


def test_sentences_of_a_long_text_take_time_in_proportion(spark):
    parts = [f"Wort{k} und\x1c noch {k % 7} mehr. " for k in range(3000)]
    df = spark.createDataFrame([("".join(parts),), (None,), (" \n ",), ("a.　B\x01c",)], "t string")
    began = time.time()
    got = [r.s for r in df.select(text.segments(F.col("t")).alias("s")).collect()]
    assert time.time() - began < 60
    assert [(r.text, r.start) for r in got[0]] == [(p.strip(), sum(map(len, parts[:k]))) for k, p in enumerate(parts)]
    assert [[tuple(r) for r in s] for s in got[1:]] == [[(None, 0)], [("", 0)], [("a.", 0), ("B", 3), ("c", 4)]]


def test_no_correction_fits_a_plain_text():
    from tessera.analysis import rules, select

    marks = {"SL", "SN", "SF", "SP", "SE", "SO", "SS", "SH", "SW"}
    hangul = lambda forms: all("ㄱ" <= f[0] <= "힣" or "ᄀ" <= f[0] <= "ᇿ" for f in forms)
    for rule in [r for n in rules.SECOND for r in rules.RULES[n]] + rules.DERIVED + [rules._MERGE] + select._LAST:
        assert any((tags is not None and tags.isdisjoint(marks)) or (forms is not None and hangul(forms)) for forms, tags in rule.items), rule


def test_plain_texts_are_decoded_as_by_the_lattice():
    import random

    from tessera.analysis import decode
    from tessera.analysis.lattice import Lattice
    from tessera.analysis.seed import seed_model

    m, r = seed_model(), random.Random(3)
    for k in range(300):
        t = "".join(r.choice('aZ19.,- é漢(\xa0"…\x1c') for _ in range(r.randrange(1, 30)))
        if t.strip():
            path = decode.best_paths(m, t, Lattice(m, t).arcs(), 10)
            assert m.is_plain(t) and len(path) == 1
            assert decode.single(m, t) == (path[0][0], decode._spans(decode._tokens(path[0][1], t, m), t))
        arcs = Lattice(m, t).arcs()
        for source, (n, cost) in decode.arc_sums(m, t).items():
            of = [a.cost for a in arcs if a.source == source]
            assert n == len(of) and abs(cost - sum(of)) < 1e-6
        assert sum(n for n, _ in decode.arc_sums(m, t).values()) == len(arcs)
    assert not m.is_plain("abc 나") and not m.is_plain("a b", {"b": ("NNG", 1)})


def test_one_long_sentence_is_decoded_in_time_in_proportion():
    from tessera.analysis import decode
    from tessera.analysis.seed import seed_model

    m = seed_model()
    for text in ("abc é1 " * 40_000, "가 é1 " * 4_000):
        began = time.time()
        cost, tokens = decode.single(m, text)
        assert time.time() - began < 20 and tokens[-1].end == len(text) - 1


def test_tokens_of_a_batch_never_leave_the_worker(spark):
    from tessera.analysis import api
    from tessera.analysis.seed import seed_model

    a = api.Analyzer(seed_model())
    df = spark.createDataFrame([("나는 새를 보았다. abc\nabc 1",), (None,), ("",), ("학교에 갔다!",)], "t string")
    counts = a.token_counts(df, "t").groupBy("pos", "text").agg(F.sum("n").alias("n"))
    rows = df.select(F.explode(a.analyze(F.col("t"))["tokens"]).alias("x")).groupBy("x.pos", "x.text").agg(F.count("*").alias("n"))
    assert counts.count() > 5 and counts.exceptAll(rows).count() == rows.exceptAll(counts).count() == 0


def test_a_sentence_that_comes_again_is_read_once():
    from tessera.analysis import api
    from tessera.analysis.seed import seed_model

    asked = []
    read = api.Reader(lambda model, sentence, user: asked.append(sentence) or len(sentence), seed_model(), {})
    assert [read(x) for x in ("가", "가", "나", "abc", "abc", "", "가")] == [1, 1, 1, 3, 3, 0, 1] and asked == ["가", "나", "abc", "abc", ""]
    for k in range(3 * api._MOST_KEPT // 200):
        read("가" * 190 + str(k))
    assert sum(map(len, api._SHELVES[read.name])) <= api._MOST_KEPT + 256


def test_near_duplicates_by_blocks_make_no_pairs(spark, monkeypatch):
    import random

    from tessera.operators import curate

    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(3)]
    prints = {}
    for k in range(3000):  # three clusters: a million pairs within 6 bits
        f = base[k % 3]
        for _ in range(r.randrange(5)):
            f ^= 1 << r.randrange(64)
        prints[k] = f
    df = spark.createDataFrame([(k, f - (1 << 64) if f >> 63 else f) for k, f in prints.items()] + [(9000, None), (None, 5)], "k long, f long")
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    monkeypatch.setattr(curate, "BLOCK", 300)
    for most in (6, 20):
        kept = []
        for k, f in prints.items():
            if all((f ^ prints[j]).bit_count() > most for j in kept):
                kept.append(k)
        assert sorted(x.k for x in curate.near_duplicates(df, "k", "f", most).collect()) == [*kept, 9000]


def test_letters_and_digits_of_a_word(spark):
    from tessera.plans.relational import alnum

    words = ["Hello,", "abc9", "éa", "漢字", "", "a😀b-c", "--", "x\x00y", None, "ééb́"]
    df = spark.createDataFrame([(x,) for x in words], "w string")
    assert all(a == b for a, b in df.select(alnum(F.col("w")), F.regexp_replace("w", "[^A-Za-z0-9]", "")).collect())


def test_words_of_a_text_are_counted_where_it_lies(spark):
    from tessera.plans import registry

    names = "candidate_pool layer_gates pool_upsert pool_comparison set_operations model_comparison word_readings same_output set_f1_by_pos f1_by_confidence multiset_f1_by_domain sentence_rollup confusion_matrix unresolved_patterns parameter_grid single_vs_split".split()
    for name in names:
        moved = exchanges(registry.queries()[name](spark, "/root/testdata/sf0.001")).split("\n")
        # rows that have a document's id and more by which they are hashed: its words
        assert not [x for x in moved if "hashpartitioning(" in x and "doc_id" in x and len(x.split("hashpartitioning(")[1].split("), ")[0].split(", ")) > 2], (name, moved)


def test_parts_of_documents_follow_their_size(spark, monkeypatch):
    from tessera.plans import relational

    docs = relational.read(spark, "/root/testdata/sf0.001", "documents")
    few = relational.doc_words(docs).rdd.getNumPartitions()
    monkeypatch.setattr(relational, "TASK_BYTES", 1 << 14)
    assert relational.doc_words(docs).rdd.getNumPartitions() > 2 * few


def test_one_table_of_both_sides_scores_as_two(spark):
    from tessera.operators import curate, evaluate

    gold = spark.createDataFrame([(1, "a", "X"), (1, "a", "X"), (1, "b", "Y"), (2, "a", "X")], "d int, form string, pos string")
    pred = spark.createDataFrame([(1, "a", "X"), (1, "b", "Z"), (3, "a", "X")], "d int, form string, pos string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(evaluate.matches(gold, pred, ["d", "form", "pos"])) == [(1, "a", "X", 1, 0, 1), (1, "b", "Y", 0, 0, 1), (1, "b", "Z", 0, 1, 0), (2, "a", "X", 0, 0, 1), (3, "a", "X", 0, 1, 0)]
    assert rows(evaluate.confusion(gold, pred, "d")) == [("Y", "Z", 1)]
    assert rows(curate.same_rows(gold, pred)) == [(3, 2, False)]
    words = spark.createDataFrame([(1, 0, "ab"), (1, 1, "c"), (2, 0, "ab")], "d int, i int, form string")
    ms = spark.createDataFrame([(1, 0, 1, "b", "Y"), (1, 0, 0, "a", "X"), (2, 0, 0, "ab", "Z"), (9, 0, 0, "q", "Q")], "d int, i int, order int, form string, pos string")
    assert rows(curate.word_readings(words, ms, ["d", "i"])) == [("ab", "a/X b/Y", 1), ("ab", "ab/Z", 1)]
    n = spark.createDataFrame([(1, "k", 1, 1, 0), (1, "k", 0, 0, 1), (2, "k", 1, 1, 1)], "d int, lang string, g int, a int, b int")
    assert rows(evaluate.compared(evaluate.both_f1(n, "d", "lang"), "lang")) == [("k", 0, 1, 1, -0.5)]


def test_dictionary_words_are_found_at_every_place(spark):
    from tessera.operators import counts

    texts = ["ththe", "", None, "漢字the😀th", "e" * 5, "the" * 400_000]
    lex = ["the", "th", "e", "ee", "字t", "😀", "xyz"]
    df = spark.createDataFrame(list(enumerate(texts[:5])), "k long, t string")
    words = spark.createDataFrame([(w, w.upper()) for w in lex] + [("th", "again"), (None, "n")], "s string, tag string")
    want = sorted((k, i, w, tag) for k, t in enumerate(texts[:5]) for w, tag in [(w, w.upper()) for w in lex] + [("th", "again")] for i in range(len(t or "")) if t.startswith(w, i))
    assert sorted((r.k, r.start, r.s, r.tag) for r in counts.prefix_matches(df, words, "k", "t", "s").collect()) == want
    long = spark.createDataFrame([(7, texts[5])], "k long, t string")
    began = time.time()
    assert counts.prefix_matches(long, words, "k", "t", "s").groupBy("s").count().where("s = 'the'").first()["count"] == 400_000
    assert time.time() - began < 30
