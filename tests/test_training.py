"""The reranker's perceptron and the admission of dictionary layers."""

import math
import random

import pytest

from tessera.training import layers, perceptron

CANDIDATES = "sentence string, rank int, buckets array<int>, values array<double>, tp int, fp int, fn int"


def made(seed, n):
    """Sentences whose best candidate is the one with bucket 1; others carry bucket 2 and noise."""
    r = random.Random(seed)
    rows = []
    for s in range(n):
        best = r.randrange(4)
        for rank in range(4):
            own = [1 if rank == best else 2, 3 + r.randrange(5)]
            rows.append((f"{seed}-{s}", rank, own, [1.0, 1.0], 3 if rank == best else 1, 0, 0 if rank == best else 2))
    return rows


def test_perceptron_learns_what_tells_candidates_apart(spark):
    train, dev = (perceptron.gathered(spark.createDataFrame(made(k, 60), CANDIDATES), "sentence") for k in (1, 2))
    weights, log = perceptron.train(train, dev, size=16)
    assert weights[1] > weights[2] and log[0]["oracle"] == 1.0 and log[0]["first"] < 1.0
    assert max(x["pick"] for x in log) == 1.0 and len(log) == perceptron.EPOCHS
    assert perceptron.train(train, dev, size=16) == (weights, log)


def test_perceptron_keeps_the_first_best_epoch(spark):
    train = perceptron.gathered(spark.createDataFrame(made(1, 60), CANDIDATES), "sentence")
    weights, log = perceptron.train(train, train, size=16)
    first = next(k for k, x in enumerate(log) if x["pick"] == max(y["pick"] for y in log))
    assert perceptron.train(train, train, size=16, epochs=first + 1)[0] == weights


def test_perceptron_without_anything_to_learn(spark):
    assert perceptron.train([], []) == ({}, [])
    alike = perceptron.gathered(spark.createDataFrame([("a", 0, [1], [1.0], 1, 0, 0), ("a", 1, [2], [1.0], 1, 0, 0)], CANDIDATES), "sentence")
    assert perceptron.train(alike, alike) == ({}, [])


def test_gathered_is_ordered_and_bounded(spark):
    rows = made(3, 20)
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, CANDIDATES).repartition(3)
    whole = perceptron.gathered(df, "sentence")
    assert len(whole) == 20 and all(len(s.ids) == 4 for s in whole)
    part = perceptron.gathered(df, "sentence", most=5)
    assert [s.counts.tolist() for s in part] == [s.counts.tolist() for s in whole[:5]]


@pytest.mark.parametrize(
    "new, want",
    [({"overall": 0.9, "a": 0.8}, "pass"), ({"overall": 0.89, "a": 0.9}, "reject_overall (-0.0100)"), ({"overall": 0.95, "a": 0.65}, "reject_domain_a (-0.1500)"), ({"overall": 0.9, "a": 0.71}, "pass")],
)
def test_decisions(new, want):
    assert layers.decide({"overall": 0.9, "a": 0.8}, new) == want


GATE = ("L5", ["NNG"], 2, 5, None, 2, 9)


@pytest.fixture()
def root(spark, tmp_path):
    spark.createDataFrame([("나라", "NNG", 7)], "surface string, pos string, freq long").write.parquet(f"{tmp_path}/v=0")
    return str(tmp_path)


def candidates(spark, *rows):
    return spark.createDataFrame(rows, "surface string, pos string, frequency long, votes long, in_dict boolean, domains array<string>")


def words(spark, root, version):
    return {r.surface: r.freq for r in spark.read.parquet(f"{root}/v={version}").collect()}


def test_an_admitted_layer_is_a_new_version(spark, root, tmp_path):
    pool = candidates(spark, ("하늘", "NNG", 9, 3, False, ["news"]), ("바다", "NNG", 9, 1, False, ["news"]), ("나라", "NNG", 99, 3, False, []), ("강산", "NNG", 9, 3, False, []))
    out = layers.run_layer(pool, GATE, root, "0", lambda d: {"overall": d.count() / 10}, {"overall": 0.1}, log=f"{tmp_path}/log", stop=["강산"])
    assert (out.added, out.decision, out.version) == (1, "pass", "0-L5")
    assert words(spark, root, "0-L5") == {"나라": 7, "하늘": 9} and words(spark, root, "0") == {"나라": 7}
    assert [r[:3] for r in map(tuple, spark.read.option("sep", "\t").csv(f"{tmp_path}/log").collect())] == [("L5", "1", "pass")]


def test_rejected_empty_and_failing_layers_leave_the_old_version(spark, root):
    pool = candidates(spark, ("하늘", "NNG", 9, 3, False, ["news"]))
    worse = layers.run_layer(pool, GATE, root, "0", lambda d: {"overall": 0.0}, {"overall": 0.1})
    assert (worse.added, worse.decision, worse.version) == (0, "reject_overall (-0.1000)", "0")
    none = layers.run_layer(pool.where("votes > 9"), GATE, root, "0", lambda d: {}, {"overall": 0.1})
    assert (none.decision, none.version, none.scores) == ("skip_empty", "0", None)

    def broken(d):
        raise ValueError(d)

    failed = layers.run_layer(pool, GATE, root, "0", broken, {"overall": 0.1})
    assert (failed.decision, failed.version) == ("reject_error (ValueError)", "0") and words(spark, root, "0") == {"나라": 7}
    again = layers.run_layer(pool, GATE, root, "0", lambda d: {"overall": math.inf}, {"overall": 0.1})
    assert (again.decision, again.added) == ("pass", 1) and words(spark, root, again.version) == {"나라": 7, "하늘": 9}
