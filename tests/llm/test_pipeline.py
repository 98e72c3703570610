"""The registered queries with their SQL twins, and the pipeline stage by stage against brute force."""

import os
from collections import Counter, defaultdict

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from tessera.llm import packing, queries

from .helpers import SCHEMA, docs, odd_rows, prose
from .test_dedup import edited, jaccard, kept_words, lines_left
from .test_models import slow_pack, unpacked

DIR = "/root/testdata/sf0.001"


def plain(x):
    return round(x, 5) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    df = queries.queries()[name](spark, DIR)
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(map(plain, r)) for r in df.select(*[df[c] for c in names]).collect()) == Counter(tuple(map(plain, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(queries.queries().keys() - queries.oracle_sql().keys()))
def test_query_covers_its_table(spark, name):
    df = queries.queries()[name](spark, DIR)
    key = "vec_id" if name.startswith("op3") else "doc_id"
    got = {r[0] for r in df.select(key).collect()}
    every = {r[0] for r in spark.read.parquet(f"{DIR}/{'embeddings' if key == 'vec_id' else 'documents'}.parquet").select(key).collect()}
    assert got <= every and (name[:4] in ("op2_", "op10") or got == every)


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names


def written(spark, tmp_path, rows, marks):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def rows_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_match_brute_force(spark, tmp_path):
    texts, bad, shared = {}, set(), prose(70, 999, 5000)
    for d in range(60):
        texts[d] = "\n".join(prose(40, d * 10 + k, 5000) for k in range(4))
        if d % 6 == 0:
            texts[d] = texts[d].upper().replace(" ", "!! ")
            bad.add(d)
    for d in range(60, 75):  # near copies, lines that repeat, a passage that repeats
        texts[d] = edited(texts[d - 50], 0.01, d) if d % 5 and d - 50 not in bad else texts[1] + "\n" + prose(90, d, 5000)
    for d in range(75, 80):
        texts[d] = prose(60, d, 5000) + " " + shared + " " + prose(50, d + 500, 5000)
    rows = [(d, t, "en", "ab"[d % 2], len(t)) for d, t in texts.items()]
    at = written(spark, tmp_path, rows, [(d, int(d not in bad), 0) for d in texts])
    now = spark.read.parquet(at + "/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, now, at)
        if name != names[-1]:
            assert made.columns == now.columns
            made.write.parquet(f"{at}/stage{k}")
            made = spark.read.parquet(f"{at}/stage{k}")
            assert all(r.n_chars == len(r.text) for r in made.collect())
        out[name] = now, made
        now = made
    before, after = map(rows_of, out["quality"])
    assert set(after) == set(before) - bad and all(after[d] == before[d] for d in after)
    before, after = map(rows_of, out["line dedup"])
    assert after == lines_left(sorted(before.items()))
    before, after = map(rows_of, out["near dedup"])
    near = defaultdict(set)
    for a in before:
        for b in before:
            if a < b and jaccard(before[a], before[b]) >= 0.7:
                near[b].add(a)
    assert set(after) <= set(before) and all(d not in after for d in near) and len(after) >= len(before) - len(near)
    before, after = map(rows_of, out["suffix dedup"])
    assert {d: t.split() for d, t in after.items()} == kept_words(before, 50)
    own, packed = out["packing"]
    own = [(r.doc_id, r.text, r.source) for r in own.collect()]
    totals = Counter()
    for _, t, s in own:
        totals[s] += len(t.split())
    assert unpacked(packed.collect()) == slow_pack(own, packing.WINDOW, {s: w for s, _, w in packing.shares(list(totals.items()))})
    again = corpus_pipeline.run(spark, at).collect()
    assert sorted(map(str, again)) == sorted(map(str, packed.collect()))


def test_pipeline_odd_cases(spark, tmp_path):
    rows = [(d, t, "en", None if d == 6 else "s", None if t is None else len(t)) for d, t in odd_rows()]
    at = written(spark, tmp_path, rows, [])
    got = corpus_pipeline.run(spark, at).collect()
    words = Counter(w for win in unpacked(got) for _, _, _, w in win)
    # of the equal texts one stays, of 6 and 7 one; without labels nothing is rejected
    kept = {t for _, t in odd_rows() if t}
    assert words == Counter(w for t in kept for w in t.split())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    at = written(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, at).count() == 0
