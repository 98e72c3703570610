"""Operators 1, 3, 4, 6, 7, 8 and 9 against the library, brute force or held-out accuracy, and their odd cases."""

import math
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import ctw, packing, pieces, pivots, quality, segments, toxicity

from .helpers import CLASH, docs, odd_rows, prose

TEXTS = ["", " ", "a", "Hello  world\n\nfoo   bar ", "      deep", "naïve café – 你好 😀\t\x00x", "1234567890 " * 5, "ab" * 200, "The the THE tHe.", "▁mark ▁▁ x▁y", "été\r\n|||!!!", prose(300, 1)]


def letters(seed, n):
    r = random.Random(seed)
    return "".join(r.choice("abcdeéhinorst  .,\nÜ日") for _ in range(n))


def test_ids_equal_the_library(spark):
    texts = TEXTS + [letters(k, 120) for k in range(150)]
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = pieces.decode(pieces.encode(docs(spark, list(enumerate(texts))))).collect()
    for r in got:
        assert r.ids == lib.encode(texts[r.doc_id]), texts[r.doc_id]
        assert r.decoded == lib.decode(r.ids) == texts[r.doc_id].replace("▁", " ")


def test_ids_of_a_unigram_model_equal_the_library():
    """The same pieces as a unigram model, made by changing the kind in the file."""
    data = open(pieces.MODEL, "rb").read()
    at = data.index(b"tok_v0") + len(b"tok_v0")
    assert data[at : at + 2] == b"\x18\x02"
    # the library adds scores as 32-bit floats, in which those of -1e9 would drown all others
    data = (data[: at + 1] + b"\x01" + data[at + 2 :]).replace(struct.pack("<f", -1e9), struct.pack("<f", -5e4))
    p, lib = pieces.Pieces(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    assert not p.bpe
    words = sorted({pieces.MARK + w for w in re.findall(r"\w+", " ".join(letters(k, 200) for k in range(40)))})
    for w, ids in zip(words, p.encode_sorted(words)):
        assert p.to_ids([]) == [] and ids == lib.encode(w[1:]), w


def test_pieces_odd_cases(spark):
    df = docs(spark, odd_rows(), extra=True)
    # columns named ids and decoded are there already: they stay, and the new ones step aside
    out = pieces.decode(pieces.encode(df), ids="_ids").collect()
    assert len(out) == len(odd_rows()) and set(CLASH) < set(out[0].asDict())
    assert all(r["_decoded"] == r.text and (r["_ids"] is None) == (r.text is None) and r.ids == CLASH.index("ids") for r in out)
    assert [r["_ids"] for r in out if r.text == ""] == [[]]
    checked = pieces.encode_checked(df).collect()
    assert len(checked) == len(odd_rows()) and all(r.round_trip is not False for r in checked) and sum(r.round_trip is None for r in checked) == 2
    with pytest.raises(Exception, match="outside the vocabulary"):
        pieces.decode(spark.createDataFrame([([10**6],)], "ids array<int>")).collect()
    assert pieces.decode(pieces.encode(docs(spark, []))).count() == 0
    bad = spark.createDataFrame([([3 + 0xFF, 3 + 0xC3, 29706, 1],)], "ids array<int>")
    assert pieces.decode(bad).first().decoded.startswith("��")


def vectors(spark, rows, extra=False):
    df = spark.createDataFrame(rows, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())]))
    return df.withColumns({c: F.lit(1) for c in ("id", "v", "row", "block", "d2", "pivot")}) if extra else df


def cloud(seed, n, groups, copies, dim=32):
    r = np.random.default_rng(seed)
    v = r.standard_normal((n, dim))
    for g in range(groups):
        base = r.standard_normal(dim)
        v = np.concatenate([v, base + 0.12 * r.standard_normal((copies, dim))])
    return v.astype(np.float32)


def test_near_links_recall(spark):
    v = np.concatenate([cloud(1, 1500, 20, 6), cloud(2, 0, 1, 400)])
    v = np.concatenate([v, v[:5], v[-3:], 2 * v[-3:]])
    u = v.astype(float) / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= pivots.SIMILAR
    links = near.sum(1) - 1
    got = {r.vec_id: r for r in pivots.near_classes(vectors(spark, [(k, x.tolist(), 0) for k, x in enumerate(v)]), block=150).collect()}
    assert sorted(got) == list(range(len(v))) and links.sum() > 100_000
    assert all(got[k].n_links <= links[k] for k in got) and sum(r.n_links for r in got.values()) >= 0.9 * links.sum()
    root = np.arange(len(v))  # the least id that chains of links lead to
    for _ in range(len(v)):
        new = np.where(near, root[None, :], len(v)).min(1)
        if (new == root).all():
            break
        root = new
    assert np.mean([got[k].class_id == root[k] for k in got]) >= 0.98
    assert all(root[got[k].class_id] == root[k] for k in got)


def test_shared_pivots_are_counted_alike():
    r = np.random.default_rng(4)
    for most, n in ((400, 300), (14, 300)):  # from lists, and where lists are as long as the block
        p = np.sort(np.array([r.choice(most, 12, replace=False) for _ in range(n)]), axis=1).astype(np.int32)
        count, early = pivots._shared_counts(p[:50], p, 6)
        for a in range(50):
            for b in range(0, n, 7):
                both = set(p[a].tolist()) & set(p[b].tolist())
                assert count[a, b] == len(both) and early[a, b] == any(x < 6 for x in both)


ODD = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, [], 0), (5, None, 0), (6, [1.0, None], 0), (7, [float("nan"), 1.0], 0), (None, [1.0, 0.0], 0), (8, [1.0, 0.0, 0.0], 0), (9, [0.0, 2.0], None)]


def test_vector_odd_cases(spark):
    got = sorted(tuple(r) for r in pivots.near_classes(vectors(spark, ODD, extra=True)).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (9, 9, 0)]
    several = [(1, [1.0, 0.0], 0), (1, [1.0, 0.01], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.0], 0)]
    assert sorted(tuple(r) for r in pivots.near_classes(vectors(spark, several)).collect()) == [(1, 1, 0), (1, 1, 2), (1, 1, 2), (2, 1, 2)]
    top = {(r.vec_id, r.rank): (r.neighbour_id, round(r.distance, 4)) for r in segments.nearest_neighbours(vectors(spark, ODD, extra=True), k=2, every=1).collect()}
    assert top == {(1, 1): (2, 0.0), (1, 2): (3, 1.0), (2, 1): (1, 0.0), (2, 2): (3, 1.0), (3, 1): (1, 1.0), (3, 2): (2, 1.0), (9, 1): (3, 2.0), (9, 2): (1, 2.2361)}
    assert pivots.near_classes(vectors(spark, [])).count() == 0 and segments.nearest_neighbours(vectors(spark, [])).count() == 0


def test_top_k_of_an_id_with_several_vectors(spark):
    """Each vector of an id is a neighbour of its own, so ten near ones fill ten ranks."""
    rows = [(0, [0.0, 0.0], 0)] + [(7, [0.1 * k, 0.0], 0) for k in range(1, 11)] + [(8, [5.0, 5.0], 0)]
    got = [(r.neighbour_id, round(r.distance, 4)) for r in sorted(segments.nearest_neighbours(vectors(spark, rows), block=4).collect(), key=lambda r: r["rank"])]
    assert got == [(7, round(0.1 * k, 4)) for k in range(1, 11)]


@pytest.mark.parametrize(("block", "every"), [(64, 1), (4096, 7)])
def test_top_k_is_exact(spark, block, every):
    # the last 200 rows are equal, so that a leaf is cut by a hash
    v = np.concatenate([cloud(3, 700, 5, 8, 16), cloud(3, 20, 0, 0, 16), np.repeat(cloud(5, 1, 0, 0, 16), 200, axis=0)])
    d = np.linalg.norm(v[:, None].astype(float) - v[None].astype(float), axis=2)
    np.fill_diagonal(d, np.inf)
    got = defaultdict(dict)
    for r in segments.nearest_neighbours(vectors(spark, [(k, x.tolist(), 0) for k, x in enumerate(v)]), k=5, block=block, every=every).collect():
        got[r.vec_id][r.rank] = (r.neighbour_id, r.distance)
    assert sorted(got) == list(range(0, len(v), every))
    for q in got:
        want = sorted((x, k) for k, x in enumerate(d[q]))[:5]
        assert [got[q][i + 1][0] for i in range(5)] == [k for _, k in want]
        assert np.allclose([got[q][i + 1][1] for i in range(5)], [x for x, _ in want])


def labelled(spark, n=400):
    r = random.Random(3)
    rows, marks = [], []
    for d in range(n):
        text = prose(r.randrange(60, 300), d)
        bad, toxic = d % 5 == 0, d % 3 == 0
        if toxic:
            words = text.split()
            for _ in range(len(words) // 40 + 1):
                words.insert(r.randrange(len(words)), r.choice(["Vile", "rotten", "wretch", "scoundrel"]))
            text = " ".join(words)
        if bad:
            text = text.upper().replace(" ", "!! ")
        rows.append((d, text))
        marks.append((d, 0 if bad else 1, 1 if toxic else 0))
    return docs(spark, rows), spark.createDataFrame(marks + [(None, 1, 1), (99999, 1, 1)], "doc_id long, quality int, toxic int")


def test_quality_on_held_out_texts(spark):
    df, labels = labelled(spark)
    fitted = quality.fit(df.where("doc_id < 300"), labels)
    got = quality.score(df, fitted).where("doc_id >= 300").collect()
    assert np.mean([(r.quality_score >= 0.5) == (r.doc_id % 5 != 0) for r in got]) > 0.97
    kept = {r.doc_id for r in quality.quality_filter(df, labels).collect()}
    assert np.mean([(d in kept) == (d % 5 != 0) for d in range(400)]) > 0.97


def test_partition_sums_equal_one_fit(spark):
    df, labels = labelled(spark, 120)
    a, b = quality.fit(df.repartition(7), labels), quality.fit(df.coalesce(1), labels)
    assert np.allclose(a.weights, b.weights, atol=1e-6)


def test_pool_adjacent_is_isotonic():
    r = np.random.default_rng(1)
    s = r.integers(0, 30, 200) / 10
    y = (r.random(200) < s / 3).astype(float)
    at, value = quality.pool_adjacent(s, y)
    assert (np.diff(value) > 0).all() and (np.diff(at) > 0).all()
    fit = value[np.searchsorted(at, s, "right") - 1]
    assert abs(fit.sum() - y.sum()) < 1e-9
    best = min(((fit - y) ** 2).sum() - ((np.clip(fit + e, 0, 1) - y) ** 2).sum() for e in (0.02, -0.02))
    assert best <= 0


def test_classifier_odd_cases(spark):
    df = docs(spark, odd_rows(), extra=True)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_filter(df, empty).count() == len(odd_rows())
    out = toxicity.classify(df, toxicity.fit(df, empty)).collect()
    assert all(r["_toxic"] is None and r.toxic == CLASH.index("toxic") for r in out)
    known, labels = labelled(spark)
    out = quality.score(df, quality.fit(known, labels)).collect()
    assert len(out) == len(odd_rows()) and all((r["_quality_score"] is None) == (r.text is None) and r.quality_score == CLASH.index("quality_score") for r in out)
    out = toxicity.classify(df, toxicity.fit(known, labels)).collect()
    assert set(CLASH) < set(out[0].asDict()) and all((r["_toxic"] is None) == (r.text is None) and not r["_toxic"] and not r["_toxic_windows"] for r in out)
    assert quality.quality_filter(docs(spark, []), labels).count() == 0 and toxicity.classify(docs(spark, []), toxicity.fit(known, labels)).count() == 0


def test_toxicity_on_held_out_texts(spark):
    df, labels = labelled(spark)
    got = toxicity.classify(df, toxicity.fit(df.where("doc_id < 240"), labels)).where("doc_id >= 240").collect()
    assert np.mean([r.toxic for r in got if r.doc_id % 3 == 0]) > 0.9
    assert np.mean([r.toxic for r in got if r.doc_id % 3]) < 0.05


def test_toxicity_of_a_rare_language():
    """A frequent language with clear toxic words, and a rare one whose toxic texts only repeat a beginning of words."""
    r = random.Random(5)

    def text(lang, toxic):
        words = [f"{lang}{r.randrange(300):03d}" for _ in range(120)]
        for _ in range(4 if toxic else 0):
            words.insert(r.randrange(120), r.choice(["wretch", "scoundrel", "rotten"]) if lang == "w" else "grumbel" + "".join(r.choices("aeiostr", k=4)))
        return " ".join(words)

    def sample(n):
        return [text("w", True) for _ in range(6 * n)] + [text("é", True) for _ in range(n)], [text("w", False) for _ in range(20 * n)] + [text("é", False) for _ in range(6 * n)]

    ordinary, toxic = toxicity.train(*sample(20))
    model = toxicity.calibrate(toxicity.Model(ordinary, toxic), *sample(10))

    def share(texts):
        return model.verdicts(*model.counts(pa.array(texts))).mean()

    assert share([text("é", True) for _ in range(40)]) > 0.9 and share([text("w", True) for _ in range(40)]) > 0.9
    assert share([text("é", False) for _ in range(40)] + [text("w", False) for _ in range(40)]) < 0.05


def slow_ctw(texts, depth):
    """Context-tree weighting straight from its definition."""
    counts = defaultdict(lambda: [0, 0])
    coded = []
    for t in texts:
        data = b"\0" * depth + t.encode()
        for i in range(depth, len(data)):
            v = 1
            for k in range(7, -1, -1):
                bit = data[i] >> k & 1
                for d in range(depth + 1):
                    counts[v, data[i - d : i]][bit] += 1
                v = 2 * v + bit
    kids = defaultdict(set)
    for v, c in counts:
        if c:
            kids[v, c[1:]].add((v, c))

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def pw(node):
        if len(node[1]) == depth:
            return kt(*counts[node])
        return math.log(0.5) + np.logaddexp(kt(*counts[node]), sum(pw(n) for n in kids[node]))

    weights = {n: pw(n) for n in counts}
    for t in texts:
        data, bits = b"\0" * depth + t.encode(), 0.0
        for i in range(depth, len(data)):
            v = 1
            for k in range(7, -1, -1):
                bit, p, left = data[i] >> k & 1, 0.0, 1.0
                for d in range(depth + 1):
                    node = (v, data[i - d : i])
                    a, b = counts[node]
                    stop = 1.0 if d == depth else math.exp(math.log(0.5) + kt(a, b) - weights[node])
                    p += left * stop * (b + 0.5) / (a + b + 1)
                    left *= 1 - stop
                bits -= math.log2(p if bit else 1 - p)
                v = 2 * v + bit
        coded.append(bits / max(1, len(t.encode())))
    return coded


@pytest.mark.parametrize("depth", [2, 3])
def test_ctw_matches_its_definition(spark, depth):
    texts = [letters(k, 40) for k in range(12)] + ["a", "aaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaa"]
    want = slow_ctw(texts, depth)
    for limit in (1 << 26, 0):
        got = {r.doc_id: r.bits_per_byte for r in ctw.score(docs(spark, list(enumerate(texts))), depth, broadcast_bytes=limit).collect()}
        assert np.allclose([got[k] for k in range(len(texts))], want, atol=1e-4)


def test_ctw_odd_cases(spark):
    for limit in (1 << 26, 0):
        out = ctw.score(docs(spark, odd_rows(), extra=True), 3, broadcast_bytes=limit).collect()
        assert len(out) == len(odd_rows()) and set(CLASH) < set(out[0].asDict())
        assert all((r["_bits_per_byte"] is None) == (not r.text) for r in out)
        assert len({round(r["_bits_per_byte"], 4) for r in out if r.doc_id in (4, 5, None) and r.text}) == 1
        assert ctw.score(docs(spark, []), 3, broadcast_bytes=limit).count() == 0


def shuffled(spark):
    """Bytes that this session has written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


def test_ctw_beyond_the_broadcast_shuffles_a_few_times_the_text(spark):
    texts = [prose(400, k, 5000) for k in range(2000)]
    df, size = docs(spark, list(enumerate(texts))).cache(), sum(map(len, texts))
    df.count()
    before = shuffled(spark)
    # so small a table Spark would broadcast by itself
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        ctw.score(df, broadcast_bytes=0).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled(spark) - before < 4 * size
    df.unpersist()


def test_ctw_scores_agree_over_many_chunks(spark, monkeypatch):
    """Chunks of a few texts, buckets shared by chunks, batches that end inside both; filters, pruning and sorts after."""
    rows = odd_rows() + [(100 + k, letters(k, 60 + 7 * (k % 5))) for k in range(80)]
    df = docs(spark, rows, extra=True).withColumns({"chunk": F.lit(1), "code": F.lit(2), "bits": F.lit(3), "a.b`c": F.array(F.lit(4))})
    want = sorted(map(str, ctw.score(df, 3).select("doc_id", F.round("_bits_per_byte", 6), "text", "chunk", "code", "bits", ctw.col("a.b`c")).collect()))
    monkeypatch.setattr(ctw, "CHUNK_BYTES", 5000)
    monkeypatch.setattr(ctw, "MOST_BUCKETS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        out = ctw.score(df, 3, broadcast_bytes=0)
        assert out.columns == [*df.columns, "_bits_per_byte"]
        got = sorted(map(str, out.select("doc_id", F.round("_bits_per_byte", 6), "text", "chunk", "code", "bits", ctw.col("a.b`c")).collect()))
        assert got == want
        assert out.count() == len(rows) and out.where("doc_id >= 100 and _bits_per_byte > 0").count() == 80
        assert out.orderBy("doc_id").groupBy("chunk").agg(F.count("_bits_per_byte")).collect()[0][1] == sum(bool(r[1]) for r in rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_packed_grams_come_back():
    code = np.unique(np.random.default_rng(1).integers(0, 1 << 56, 1000, dtype=np.uint64))
    for some in (code, code[:1], code[:0]):
        assert (ctw._unpacked(ctw._packed(some)) == some).all()
    dealt = list(ctw._dealt(code, 7))
    assert sorted(np.concatenate([at for _, at in dealt]).tolist()) == list(range(len(code)))
    assert all((np.diff(at) > 0).all() for _, at in dealt) and [b for b, _ in dealt] == list(range(7))


def slow_pack(rows, window, weights):
    """Deficit round-robin, one queue visit at a time."""
    queues = defaultdict(list)
    import hashlib

    for d, text, source in sorted(rows, key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest() if r[0] is not None else "", r[0] is not None, r[0] or 0, r[1] or "")):
        queues[source] += [(d, i, w) for i, w in enumerate((text or "").split())]
    queues = {s: q for s, q in queues.items() if q}
    order = sorted(queues, key=lambda s: (s is not None, s or ""))
    total = sum(weights[s] for s in order)
    deficit, taken, stream, r = {s: 0 for s in order}, dict.fromkeys(order, 0), [], 0
    while any(taken[s] < len(queues[s]) for s in order):
        for s in order:
            deficit[s] += weights[s] * window  # in parts of ``total``
            n = min(deficit[s] // total, len(queues[s]) - taken[s])
            deficit[s] -= n * total
            stream += [(s, *x) for x in queues[s][taken[s] : taken[s] + n]]
            taken[s] += n
        r += 1
    return [[(s, d, i, w) for s, d, i, w in stream[k : k + window]] for k in range(0, len(stream), window)]


def unpacked(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.window_id, r.position)):
        assert len(out[r.window_id]) == r.position and len(r.text.split()) == r.n_tokens
        out[r.window_id] += [(r.source, r.doc_id, r.first_token + k, w) for k, w in enumerate(r.text.split())]
    return [out[k] for k in sorted(out)]


@pytest.mark.parametrize("weights", [None, {"a": 5, "b": 1, "c": 3, None: 2}])
def test_packing_is_deficit_round_robin(spark, weights):
    r = random.Random(8)
    rows = [(d, prose(r.randrange(0, 90), d), r.choice(["a", "a", "a", "b", "c", None])) for d in range(150)] + [(500, prose(700, 500), "b"), (501, None, "a"), (502, " ", "c")]
    got = packing.pack(docs(spark, rows), window=64, targets=weights).collect()
    totals = Counter()
    for _, t, s in rows:
        totals[s] += len((t or "").split())
    share = {s: w for s, _, w in packing.shares(list(totals.items()), weights)}
    want = slow_pack(rows, 64, share)
    assert unpacked(got) == want
    assert all(len(w) == 64 for w in want[:-1])


def test_packing_odd_cases(spark):
    got = packing.pack(docs(spark, odd_rows(), extra=True), window=100).collect()
    words = Counter(w for _, t in odd_rows() for w in (t or "").split())
    assert Counter(w for win in unpacked(got) for _, _, _, w in win) == words
    assert packing.pack(docs(spark, [(1, None), (2, "")])).count() == 0 and packing.pack(docs(spark, [])).count() == 0


def slow_windows(model, text):
    """Gain of each word of a text, each compressed by itself with both dictionaries."""
    plain, toxic = model.compressors()
    framed = [toxicity._BEFORE + b" " + w.encode() + b" " + toxicity._AFTER for w in text.split()]
    return [len(plain.compress(x)) - len(toxic.compress(x)) for x in framed]


def test_toxicity_matches_brute_force(spark):
    df, labels = labelled(spark, 250)
    model = toxicity.fit(df, labels)
    for r in toxicity.classify(df, model).collect():
        gains = slow_windows(model, r.text.lower())
        hits = [sum(g >= gain for g in gains) for gain, _, _ in model.rules]
        toxic = any(h >= least and h >= rate * len(gains) for h, (_, least, rate) in zip(hits, model.rules))
        assert (r.toxic, r.windows, r.toxic_windows) == (toxic, len(gains), max(hits) if toxic else 0)


def test_a_long_labelled_text_does_not_crowd_out_others(spark):
    df, labels = labelled(spark, 120)
    huge = docs(spark, [(-1, "vile " * 50_000)])
    more = spark.createDataFrame([(-1, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(df.union(huge), labels.union(more), most_bytes=1 << 20) is not None


def test_quality_matches_one_fit_by_hand(spark):
    """Random features, ridge and calibration on the driver alone give the scores of the distributed fit."""
    df, labels = labelled(spark, 200)
    model = quality.fit(df, labels)
    rows = {r.doc_id: r.text for r in df.collect()}
    marks = {r.doc_id: float(r.quality > 0) for r in labels.collect() if r.doc_id in rows}
    held = {r.d: r.held for r in df.select(F.col("doc_id").alias("d"), (F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(4)) == 0).alias("held")).collect()}
    ids = sorted(marks)
    x, y = quality.statistics(pa.array([rows[d] for d in ids])), np.array([marks[d] for d in ids])
    z = quality.fourier((x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1), quality.FEATURES, quality.WIDTH)
    t = np.array([not held[d] for d in ids])
    w = np.linalg.solve(z[t].T @ z[t] + quality.RIDGE * t.sum() * np.eye(z.shape[1]), z[t].T @ y[t])
    steps, values = quality.pool_adjacent(z[~t] @ w, y[~t])
    want = values[np.maximum(np.searchsorted(steps, z @ w, "right") - 1, 0)]
    got = {r.doc_id: r.quality_score for r in quality.score(df, model).collect()}
    assert np.mean(np.abs(np.array([got[d] for d in ids]) - want) < 1e-6) > 0.98
