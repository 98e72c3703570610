"""Operators 2, 5 and 10 against brute force, and their defined odd cases."""

import random
from collections import defaultdict

import pytest

from tessera.llm import line_dedup, minhash, suffix

from .helpers import CLASH, docs, odd_rows, prose


def maximal_repeats(texts, least):
    """{words: places} of every maximal repeat, from all pairs of places."""
    words = {d: t.split() for d, t in texts.items()}
    places = defaultdict(list)
    for d, w in words.items():
        for i in range(len(w) - least + 1):
            places[tuple(w[i : i + least])].append((d, i))
    found = set()
    for at in places.values():
        for x in range(len(at)):
            for y in range(x):
                (d, i), (e, j) = at[x], at[y]
                a, b = words[d], words[e]
                if i and j and a[i - 1] == b[j - 1]:
                    continue
                n = least
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                found.add(tuple(a[i : i + n]))
    return {r: sorted((d, i) for d, w in words.items() for i in range(len(w) - len(r) + 1) if tuple(w[i : i + len(r)]) == r) for r in found}


def scattered(seed, n_docs=14):
    r = random.Random(seed)
    shared = [prose(r.randrange(6, 30), seed * 100 + k) for k in range(5)]
    out = {}
    for d in range(n_docs):
        parts = []
        for _ in range(r.randrange(1, 6)):
            parts.append(r.choice(shared) if r.random() < 0.6 else prose(r.randrange(1, 12), r.random()))
        out[d] = " ".join(parts)
    out[n_docs] = out[0]
    out[n_docs + 1] = "a b " * 20  # overlaps itself
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_match_brute_force(spark, seed):
    texts = scattered(seed)
    got = suffix.repeats(docs(spark, texts.items()), least=6, anchor=3)
    words = {d: t.split() for d, t in texts.items()}
    repeat, size, parent, places = {}, {}, {}, defaultdict(set)
    rows = got.collect()
    for r in rows:
        assert repeat.setdefault(r.group_id, tuple(words[r.doc_id][r.start : r.start + r.n_words])) == tuple(words[r.doc_id][r.start : r.start + r.n_words])
        assert size.setdefault(r.group_id, r.n_occurrences) == r.n_occurrences and parent.setdefault(r.group_id, r.parent_id) == r.parent_id
        places[r.group_id].add((r.doc_id, r.start))
    assert len(rows) <= len({p for g in places.values() for p in g}) + len(places)
    for g, up in parent.items():
        assert up is None or repeat[g][: len(repeat[up])] == repeat[up] != repeat[g]
    for g in list(places):
        own, up = set(places[g]), parent[g]
        while up is not None:
            places[up] |= own
            up = parent[up]
    assert all(len(places[g]) == size[g] for g in places)
    assert {repeat[g]: sorted(p) for g, p in places.items()} == maximal_repeats(texts, 6) and len(set(repeat.values())) == len(repeat)
    spelled = defaultdict(set)
    for r in suffix.occurrences(got).collect():
        spelled[r.group_id].add((r.doc_id, r.start))
    assert spelled == places


def test_long_suffixes_reach_the_scan_in_pieces(spark, monkeypatch):
    """Rows for the scan are small however long the texts, and any cut of pieces into batches gives the same groups."""
    copy = prose(1500, 1, 5000)
    rows = [(d, f"head{d} {copy} tail{d}") for d in range(3)] + [(9, copy)]
    _, sent = suffix.sorted_suffixes(docs(spark, rows))
    got = sent.toPandas()
    assert len(copy) > 2 * suffix.PIECE and 0 < max(len(p) for x in got.columns for p in got[x] if isinstance(p, (bytes, bytearray))) <= suffix.PIECE
    want = sorted(map(tuple, suffix.repeats(docs(spark, rows)).collect()), key=str)
    assert {(w[2], w[3]) for w in want} == {(1500, 4)}
    monkeypatch.setattr(suffix, "PIECE", 100)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(map(tuple, suffix.repeats(docs(spark, rows)).collect()), key=str) == want
        texts = scattered(6)
        left = {r.doc_id: r.text.split() for r in suffix.suffix_dedup(docs(spark, texts.items()), least=6, anchor=3).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert left == kept_words(texts, 6)


def kept_words(texts, least):
    """What suffix_dedup must leave, by its definition: of each repeat's places all but the first go."""
    words = {d: t.split() for d, t in texts.items()}
    gone = defaultdict(set)
    for r, at in maximal_repeats(texts, least).items():
        for d, i in at[1:]:
            gone[d].update(range(i, i + len(r)))
    return {d: [w for k, w in enumerate(ws) if k not in gone[d]] for d, ws in words.items()}


@pytest.mark.parametrize("seed", [4, 5])
def test_suffix_dedup_matches_brute_force(spark, seed):
    texts = scattered(seed)
    got = {r.doc_id: (r.text.split(), r.n_chars, len(r.text)) for r in suffix.suffix_dedup(docs(spark, texts.items()), least=6, anchor=3).collect()}
    assert {d: g[0] for d, g in got.items()} == kept_words(texts, 6)
    assert all(n == m for _, n, m in got.values())


def test_suffix_odd_cases(spark):
    df = docs(spark, odd_rows(), extra=True)
    out = suffix.suffix_dedup(df).collect()
    assert len(out) == len(odd_rows()) and set(CLASH) < set(out[0].asDict())
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r.text)
    # a null id comes first, so its copy stays and those of 4 (a repeated row) and 5 lose the passage
    assert sorted(by[None], key=lambda t: t is None)[0].startswith("w") and by[1] == [None] and by[2] == [""] and by[3] == [" \n\t "]
    assert all(t.split() == [] for t in by[4] + by[5]) and len(by[8][0].split()) == 60_000
    groups = suffix.repeats(df).collect()
    assert sorted((g.n_words, g.n_occurrences, str(g.doc_id), g.start) for g in groups) == [(85, 4, "4", 0), (85, 4, "4", 0), (85, 4, "5", 0), (85, 4, "None", 0)]
    assert suffix.suffix_dedup(docs(spark, [])).count() == 0 and suffix.repeats(docs(spark, [])).count() == 0


def lines_left(rows, width=3):
    seen, gone = set(), defaultdict(set)
    for d, text in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0])):
        lines = text.split("\n")
        for p in range(len(lines) - width + 1):
            w = tuple(lines[p : p + width])
            if w in seen:
                gone[d].update(range(p, p + width))
            seen.add(w)
    return {d: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_matches_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(d, "\n".join(r.choice("abcd") for _ in range(r.randrange(12)))) for d in range(60)] + [(99, None)]
    assert {x.doc_id: x.text for x in line_dedup.line_dedup(docs(spark, rows)).collect()} == lines_left(rows)


def test_line_odd_cases(spark):
    out = line_dedup.line_dedup(docs(spark, odd_rows(), extra=True)).collect()
    assert len(out) == len(odd_rows()) and set(CLASH) < set(out[0].asDict())
    texts = defaultdict(list)
    for r in out:
        texts[r.doc_id].append(r.text)
        assert r.text is None or r.n_chars == len(r.text)
    assert texts[4] == ["", ""] and texts[5] == [""] and texts[2] == [""] and texts[1] == [None]
    assert sorted(texts[None], key=str)[1].endswith("x\ny")
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0


def edited(text, rate, seed):
    r = random.Random(seed)
    return " ".join(f"new{r.randrange(10**6)}" if r.random() < rate else w for w in text.split())


def jaccard(a, b, k=3):
    a, b = ({tuple(x[i : i + k]) for i in range(len(x) - k + 1)} for x in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_near_dedup_against_brute_force(spark):
    rows, family = [], {}
    for g in range(25):
        base = prose(200, g, 5000)
        for k in range(4):
            rows.append((g * 10 + k, edited(base, 0.02, g * 10 + k)))
            family[g * 10 + k] = g
    for k in range(60):
        rows.append((1000 + k, prose(200, 1000 + k, 5000)))
    # half of the text shared is no near copy
    rows += [(2000 + k, prose(100, 2000, 5000) + " " + prose(200, 2001 + k, 5000)) for k in range(6)]
    texts = dict(rows)
    pairs = {(a, b) for a in texts for b in texts if a < b and jaccard(texts[a], texts[b]) >= 0.6}
    got = {r.doc_id: r.group_id for r in minhash.near_dedup_groups(docs(spark, rows)).collect()}
    assert sum(got.get(a, -1) == got.get(b, -2) for a, b in pairs) >= 0.9 * len(pairs)
    assert all(d in family for d in got) and all(family[d] == family[g] for d, g in got.items())
    kept = {r.doc_id for r in minhash.near_dedup(docs(spark, rows)).collect()}
    assert kept == set(texts) - {d for d, g in got.items() if d != g}


def test_odd_sketches_estimate_similarity():
    import numpy as np

    from tessera.llm.blocks import mix

    for shared in (500, 800, 950):
        a = mix(np.arange(1, 1001, dtype=np.uint64))
        b = mix(np.arange(1001 - shared, 2001 - shared, dtype=np.uint64))
        truth = shared / (2000 - shared)
        s = minhash.odd_sketch(minhash.minhash(np.concatenate([a, b]), np.array([0, 1000, 2000]), 126), 512).view(np.uint64)
        z = int(np.bitwise_count(s[0] ^ s[1]).sum())
        assert abs(1 + 512 / (4 * 126) * np.log(1 - 2 * z / 512) - truth) < 0.15
        assert (z <= minhash.most_differing(126, 512, 0.5)) == (1 + 512 / (4 * 126) * np.log(1 - 2 * z / 512) >= 0.5)


def test_near_odd_cases(spark):
    out = minhash.near_dedup(docs(spark, odd_rows(), extra=True)).collect()
    ids = sorted((r.doc_id for r in out), key=str)
    # 4 stands for its repeated row, 5 and the null id; 6 for 7; what has no words stays
    assert ids == sorted([1, 2, 3, 4, 6, 8, 9, 10, None], key=str) and set(CLASH) < set(out[0].asDict())
    groups = sorted(((r.doc_id, r.group_id) for r in minhash.near_dedup_groups(docs(spark, odd_rows())).collect()), key=str)
    assert groups == sorted([(4, 4), (4, 4), (5, 4), (None, 4), (6, 6), (7, 6)], key=str)
    assert minhash.near_dedup(docs(spark, [])).count() == 0 and minhash.near_dedup_groups(docs(spark, [])).count() == 0


def test_a_large_bucket_of_copies(spark):
    base = prose(120, 1, 5000)
    rows = [(d, edited(base, 0.01, d)) for d in range(1500)] + [(5000 + d, base) for d in range(500)]
    got = [r.group_id for r in minhash.near_dedup_groups(docs(spark, rows)).collect()]
    assert len(got) == 2000 and set(got) == {0}


def test_cut_buckets_lose_no_link(spark):
    """Two families in one bucket, chains of edits and copies: groups are the same whatever the blocks."""
    r = random.Random(2)
    start = prose(60, 77, 5000)
    rows, chain = [], prose(140, 9, 5000)
    for d in range(300):
        rows.append((d, start + " " + edited(chain, 0.01, d)))
        if d % 10 == 0:
            chain = edited(chain, 0.06, r.random())
    rows += [(1000 + d, start + " " + edited(prose(300, 10, 5000), 0.01, d)) for d in range(80)] + [(2000 + d, rows[5][1]) for d in range(40)]
    whole, cut = ({x.doc_id: x.group_id for x in minhash.near_dedup_groups(docs(spark, rows), block=b).collect()} for b in (4096, 16))
    assert cut == whole and len(set(whole.values())) > 1 and len(whole) > 400
