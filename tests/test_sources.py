import gzip
import json

import pytest
from pyspark.sql import functions as F

from tessera.analysis.api import Analyzer
from tessera.analysis.seed import seed_model
from tessera.sources import readers, writers
from tessera.streaming import pipeline


def test_lines_keep_blank_ones(spark, tmp_path):
    (tmp_path / "a.txt").write_text("하나 \n\n 둘")
    assert [(r.line, r.text) for r in readers.lines(spark, str(tmp_path)).orderBy("line").collect()] == [(0, "하나"), (1, ""), (2, "둘")]


def test_jsonl_counts_bad_lines(spark, tmp_path):
    with gzip.open(tmp_path / "g.jsonl.gz", "wt") as f:
        f.write(json.dumps({"text": "가", "morphemes": [["가", "VV"]]}) + "\n{broken\n")
    df = readers.jsonl(spark, str(tmp_path)).cache()
    assert readers.bad_lines(df) == 1
    r = readers.gold(df).first()
    assert (r.text, r.domain, [tuple(m) for m in r.morphemes]) == ("가", "unknown", [("가", "VV")])


def test_nikl(spark, tmp_path):
    doc = {"document": [{"sentence": [{"form": "나는 학교에", "word": [{"id": 1, "form": "나는"}], "MP": [{"form": "나_", "label": "NP", "word_id": 1}, {"form": " ", "label": "SP", "word_id": 1}]}, {"form": "짧", "word": [], "morpheme": [{"form": "짧", "label": "VA", "word_id": 1}]}, {"form": "모르는 문장이다", "word": [], "morpheme": [{"form": "모르", "label": "VV", "word_id": 1}]}]}, {"sentence": None}]}
    (tmp_path / "n.json").write_text(json.dumps(doc, indent=1))
    assert [(r.text, [(m.form, m.pos) for m in r.morphemes]) for r in readers.nikl(spark, str(tmp_path)).collect()] == [("나는 학교에", [("나 ", "NP")]), ("모르는 문장이다", [("모르", "VV")])]


def test_dictionary_and_flags(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("# c\n클라우드\tNNG\t500\nbad line\n서버\tNNG\tx\n")
    assert [tuple(r) for r in readers.dictionary(spark, str(tmp_path / "d.tsv")).collect()] == [("클라우드", "NNG", 500)]
    (tmp_path / "f.tsv").write_text("surface\tin_cache\tin_dict\n가\tN\tN\n나\tY\tN\n")
    assert readers.flagged(spark, str(tmp_path / "f.tsv"), (F.col("in_cache") == "N") & (F.col("in_dict") == "N")).count() == 1


def test_sections():
    data = b"MAGC" + (3).to_bytes(4, "little") + b"\x06" + (2).to_bytes(4, "little") + b"ab" + b"\x07" + (0).to_bytes(4, "little")
    assert list(readers.sections(data, b"MAGC")) == [(6, b"ab"), (7, b"")]
    with pytest.raises(ValueError):
        list(readers.sections(data[:14], b"MAGC"))


def test_paged_source(spark):
    def fetch(start, size):
        return [(k,) for k in range(start, min(start + size, 26))]

    spark.dataSource.register(readers.paged_source("pages_of_numbers", "n int", fetch, size=10, most=50))
    assert sorted(r.n for r in spark.read.format("pages_of_numbers").load().collect()) == list(range(1, 26))


def test_writers(spark, tmp_path):
    a = Analyzer(seed_model())
    df = spark.createDataFrame([(1, "학교에"), (2, "")], "id int, s string").coalesce(1).withColumn("a", a.analyze(F.col("s")))
    writers.tokens_json(df, "a.tokens", str(tmp_path / "j"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect()) == ['[["학교","NNG"],["에","JKB"]]', "[]"]
    writers.tokens_tsv(df, "a.tokens", str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["학교\tNNG", "에\tJKB", "---", "---"]
    writers.split(df.select("id"), F.col("id") > 1, str(tmp_path / "y"), str(tmp_path / "n"))
    assert spark.read.json(str(tmp_path / "y")).count() == spark.read.json(str(tmp_path / "n")).count() == 1
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        writers.split(df.select("id"), F.col("id") > 1, str(tmp_path / "y"), str(tmp_path / "n"))
    assert spark.read.parquet(writers.publish(df.select("id"), str(tmp_path / "m"), "2")).count() == 2
    writers.chunks(spark.range(5), "id", 2, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).select("chunk").distinct().count() == 3


def test_stream(spark, tmp_path):
    rows = [("가 나", "2026-01-01 00:00:00"), ("가나", "2026-01-01 00:00:10"), ("다", "2026-01-01 00:00:20")]
    spark.createDataFrame(rows, "text string, ts string").selectExpr("text", "cast(ts as timestamp) as ts").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("text string, ts timestamp").parquet(str(tmp_path / "in"))
    q = pipeline.run_once(pipeline.analyzed(pipeline.first_seen(s, "ts"), Analyzer(seed_model())), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_lines_of_files_in_many_splits(spark, tmp_path):
    texts = {"a.txt": [f"줄 {k} " + "가" * (k % 50) for k in range(3000)], "b.txt": ["", "x", "", "y" * 5000, "z"], "c.txt": []}
    for name, own in texts.items():
        (tmp_path / name).write_text("\n".join(own))
    size = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(size)
    try:
        spark.conf.set(size, "7000")
        df = readers.lines(spark, str(tmp_path))
        got = {(r.file.rpartition("/")[2], r.line): r.text for r in df.collect()}
        splits = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set(size, old)
    assert got == {(f, k): t.strip() for f, own in texts.items() for k, t in enumerate(own)} and splits > 10
