"""MinHash near-dedup with odd sketches (operator 10).

Words are lower-cased runs free of white space and ASCII punctuation; shingles are ``shingle`` consecutive
words, or all words of a shorter text. ``bands * rows`` MinHash samples are taken per text. Texts with equal
samples collapse to one representative. Representatives meet in band buckets; inside a bucket pairs are decided by
their odd sketches (each sample toggles one of ``bits`` parity bits; z differing bits estimate
J = 1 + bits/(4k) ln(1 - 2z/bits)), breadth-first from each undecided member, which yields the components of the
bucket's similarity graph without writing all its pairs. A bucket of more than ``block`` members is cut by a hash: its
members are compared with one pivot, which goes to every block; those near it are connected through it, and only the
others go to every block to be compared with all members. No link is lost, and a task holds one block. Components over
all buckets are the groups.

Defined cases: a null text, or one without words, has no shingles and joins no group; equal texts are always one
group, also texts of one word; rows that repeat doc_id and text are one group with themselves and all their
copies; a null doc_id sorts last, so it represents a group only where no other is there; of a group's rows that tie
on doc_id one stays; an empty table gives an empty table; extra columns pass through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BREAK, _C3, mix, pair, signed, window_hash, word_runs
from .common import col, fresh, row_key, stage
from .components import components

BANDS, ROWS, SHINGLE, BITS, SIMILAR, BLOCK = 42, 3, 3, 512, 0.5, 4096
_SKETCHED = "rk long, whole long, sketch binary, bands array<long>"


def _multipliers(k: int) -> np.ndarray:
    return np.random.default_rng(77).integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhash(hashes: np.ndarray, first: np.ndarray, k: int, step: int = 1 << 15) -> np.ndarray:
    """(len(first) - 1, k) minima of k multiplicative permutations; every segment must hold something."""
    out = np.empty((k, len(first) - 1), np.uint64)
    by = _multipliers(k)
    lo = 0
    while lo < len(first) - 1:
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + step, "right")) - 1)
        part, heads = hashes[first[lo] : first[hi]], first[lo:hi] - first[lo]
        turned = np.empty_like(part)
        for p in range(k):
            np.multiply(part, by[p], out=turned)
            out[p, lo:hi] = np.minimum.reduceat(turned, heads)
        lo = hi
    return out.T


def odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps, packed to bytes: sample p with value v toggles the bit that hash(p, v) names."""
    n, k = samples.shape
    at = (mix(samples ^ mix(np.arange(1, k + 1, dtype=np.uint64) * _C3)[None, :]) % np.uint64(bits)).astype(np.int64)
    counts = np.bincount((np.arange(n)[:, None] * bits + at).ravel(), minlength=n * bits)
    return np.packbits((counts & 1).astype(np.uint8).reshape(n, bits), axis=1)


def most_differing(k: int, bits: int, similar: float) -> int:
    """The most differing bits at which the estimate still reaches ``similar``."""
    return math.floor(bits / 2 * (1 - math.exp(-4 * k * (1 - similar) / bits)))


def _sketch(bands: int, rows: int, shingle: int, bits: int):
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for lo, _, w in word_runs(batch.column(1), BREAK):
                n = np.diff(w.first)
                rows_with = np.flatnonzero(n)
                if not len(rows_with):
                    continue
                grams = window_hash(w.hashes, shingle)
                starts, size = w.first[:-1][rows_with], n[rows_with]
                for short in range(1, shingle):
                    own = starts[size == short]
                    grams[own] = pair(window_hash(w.hashes, short)[own], np.full(len(own), short, np.uint64))
                count = np.maximum(1, size - shingle + 1)
                first = np.zeros(len(count) + 1, np.int64)
                np.cumsum(count, out=first[1:])
                picked = grams[np.repeat(starts - first[:-1], count) + np.arange(first[-1])]
                # halves keep what reduceat and the bands hold at once small
                for a in range(0, len(count), 2048):
                    b = min(a + 2048, len(count))
                    seg = first[a : b + 1] - first[a]
                    s = minhash(picked[first[a] : first[b]], seg, k)
                    whole = s[:, 0].copy()
                    for p in range(1, k):
                        whole = pair(whole, s[:, p])
                    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (b - a, bands)).copy()
                    for r in range(rows):
                        key = pair(key, s[:, r::rows])
                    packed = odd_sketch(s, bits)
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.take(pa.array(rows_with[a:b] + lo)),
                            pa.array(signed(whole)),
                            pa.array([x.tobytes() for x in packed], pa.binary()),
                            pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * bands, bands, dtype=np.int32)), pa.array(signed(key.ravel()))),
                        ],
                        names=["rk", "whole", "sketch", "bands"],
                    )

    return run


def _links(keys: np.ndarray, sketches: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first member's key, the others' keys) for each component of more than one in one bucket."""
    left = np.arange(len(keys))
    while len(left) > 1:
        root, left = left[0], left[1:]
        found, queue = [], [root]
        while queue and len(left):
            now = queue.pop()
            near = np.bitwise_count(sketches[left] ^ sketches[now]).sum(axis=1) <= most
            if near.any():
                hit = left[near]
                found.append(hit)
                queue.extend(hit.tolist())
                left = left[~near]
        if found:
            yield keys[root], keys[np.concatenate(found)]


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _edges(u: list, v: list, rest: np.ndarray | None = None, band: int = 0) -> pa.RecordBatch:
    """Edges, then what isn't near its bucket's pivot (no v)."""
    none = np.zeros(0, np.int64)
    u, v, rest = np.concatenate([none, *u]), np.concatenate([none, *v]), none if rest is None else rest
    gone = np.arange(len(u) + len(rest)) >= len(u)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, rest])), pa.array(np.concatenate([v, rest]), mask=gone), pa.array(np.full(len(gone), band), mask=~gone)], names=["u", "v", "band"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut where the first two columns change."""
    for batch in batches:
        x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = np.concatenate([[0], np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1, [len(x)]])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if b > a:
                yield batch.slice(a, b - a)


def _bucket_edges(most: int):
    """band, block, blocks, node, sketch, the pivot first -> edges and rests. A bucket of one block is settled here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = pivot = None
        u: list = []
        v: list = []
        n = 0

        def whole() -> None:
            nonlocal n
            t = pa.Table.from_batches(held)
            n += len(t)
            for root, others in _links(t.column("node").to_numpy(), _sketches(t.column("sketch").combine_chunks()), most):
                u.append(np.full(len(others), root))
                v.append(others)
            held.clear()

        for part in _parts(batches):
            key = (part.column(0)[0], part.column(1)[0])
            if key != at:
                if held:
                    whole()
                at, pivot = key, None
            if part.column(2)[0].as_py() == 1:
                held.append(part)
            else:  # one block of a hot bucket: against its pivot only, as batches come
                nodes, sketches = part.column("node").to_numpy(), _sketches(part.column("sketch"))
                if pivot is None:
                    pivot = nodes[0], sketches[0]
                near = np.bitwise_count(sketches ^ pivot[1]).sum(axis=1) <= most
                hit = nodes[near & (nodes != pivot[0])]
                yield _edges([np.full(len(hit), pivot[0])], [hit], nodes[~near], key[0].as_py())
            if n > 50_000:
                yield _edges(u, v)
                u, v, n = [], [], 0
        if held:
            whole()
        yield _edges(u, v)

    return run


def _rest_edges(most: int):
    """band, block, asks, node, sketch: a block's members, then every row of the bucket that isn't near its pivot -> edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, nodes, sketches = None, [], None, None
        for part in _parts(batches):
            key = (part.column(0)[0], part.column(1)[0])
            if key != at:
                at, held, nodes = key, [], None
            asks = np.asarray(part.column(2)).astype(bool)
            n = int((~asks).sum())
            if n:
                held.append(part.slice(0, n))
            if n == len(part):
                continue
            if nodes is None:
                t = pa.Table.from_batches(held)
                nodes, sketches = t.column("node").to_numpy(), _sketches(t.column("sketch").combine_chunks())
            u, v = [], []
            for q, s in zip(part.column("node").to_numpy()[n:], _sketches(part.column("sketch").slice(n))):
                hit = nodes[np.bitwise_count(sketches ^ s).sum(axis=1) <= most]
                hit = hit[hit != q]
                u.append(np.full(len(hit), q))
                v.append(hit)
            yield _edges(u, v)

    return run


def near_groups(docs: DataFrame, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE, bits: int = BITS, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(rk, root): row keys of the documents that resemble another row's key, and their group."""
    if bits % 64:
        raise ValueError("bits must be a multiple of 64")
    most = most_differing(bands * rows, bits, similar)
    texts = docs.select(row_key(doc_id, text).alias("rk"), F.lower(col(text)).alias("text")).where("text is not null")
    sketched = stage(texts.mapInArrow(_sketch(bands, rows, shingle, bits), _SKETCHED), "sketches")
    # rows of equal samples have equal sketches and bands: any of them stands for all
    leads = stage(sketched.groupBy("whole").agg(F.count("*").alias("n"), F.any_value(F.struct("sketch", "bands")).alias("x")).select(F.col("whole").alias("node"), "n", "x.*"), "leads")
    posted = leads.select("node", F.explode("bands").alias("band"))
    buckets = posted.groupBy("band").agg(F.count("*").alias("size"), F.min("node").alias("pivot")).where("size > 1").selectExpr("band as b", "pivot", f"ceil(size / {block}) as blocks")
    shared = posted.join(buckets, F.col("band") == F.col("b")).selectExpr("band", "node", "blocks", "pivot", "pmod(xxhash64(node), blocks) as own")
    shared = shared.join(leads.select("node", "sketch"), "node")
    sent = shared.select("band", F.explode(F.expr("if(node = pivot, sequence(0L, blocks - 1), array(own))")).alias("block"), "blocks", "node", "sketch", (F.col("node") != F.col("pivot")).alias("later"))
    found = sent.repartition("band", "block").sortWithinPartitions("band", "block", "later", "node").drop("later").mapInArrow(_bucket_edges(most), "u long, v long, band long")
    found = stage(found, "bucket-edges")
    edges, rest = found.where("v is not null").select("u", "v"), found.where("v is null").selectExpr("band as rb", "u as q")
    if not rest.isEmpty():
        hot = buckets.where("blocks > 1").join(rest.select("rb").distinct(), F.col("b") == F.col("rb"), "left_semi")
        members = posted.join(hot, F.col("band") == F.col("b")).selectExpr("band", "pmod(xxhash64(node), blocks) as block", "false as asks", "node")
        asking = rest.distinct().join(hot, F.col("rb") == F.col("b")).select(F.col("b").alias("band"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), F.lit(True).alias("asks"), F.col("q").alias("node"))
        both = members.unionByName(asking).join(leads.select("node", "sketch"), "node").select("band", "block", "asks", "node", "sketch")
        more = both.repartition("band", "block").sortWithinPartitions("band", "block", "asks", "node").mapInArrow(_rest_edges(most), "u long, v long, band long")
        edges = edges.union(more.select("u", "v"))
    roots = components(edges).withColumnRenamed("node", "r")
    groups = leads.select("node", "n").join(roots, F.col("node") == F.col("r"), "left").where("n > 1 or root is not null").select("node", F.coalesce("root", "node").alias("root"))
    return sketched.select("rk", "whole").distinct().join(groups, F.col("whole") == F.col("node")).select("rk", "root")


def _has_words(text: str) -> Column:
    return col(text).rlike(r"[^\s\p{Punct}]")


def near_dedup_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(doc_id, group_id) of every row that has a near copy, group_id being the least doc_id of its group."""
    keyed = docs.where(_has_words(text)).select(col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("rk"))
    own = keyed.join(near_groups(docs, doc_id=doc_id, text=text, **how), "rk")
    least = own.groupBy("root").agg(F.min("doc_id").alias("group_id"))
    return own.join(least, "root").select("doc_id", "group_id")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each near-copy group, that of the least doc_id; repeated rows are near copies too."""
    rk, key, out, n = fresh(docs, "rk", "key", "out", "n")
    # which row goes on is decided on narrow rows; texts are shuffled once, to meet the verdict
    keyed = docs.where(_has_words(text)).select(col(doc_id).alias("d"), row_key(doc_id, text).alias("rk")).distinct()
    groups = near_groups(docs, doc_id=doc_id, text=text, **how)
    own = keyed.join(groups, "rk")
    first = own.groupBy("root").agg(F.min(F.struct(F.col("d").isNull().alias("none"), "d", "rk"))["rk"].alias("stays"))
    verdict = own.join(first, "root").where("rk <> stays").select(F.col("rk").alias(key), F.lit(True).alias(out))
    met = docs.withColumn(rk, row_key(doc_id, text)).join(verdict, col(rk) == col(key), "left")
    met = met.withColumn(n, F.row_number().over(Window.partitionBy(col(rk)).orderBy(col(rk))))
    return met.where(~F.coalesce(_has_words(text), F.lit(False)) | (col(out).isNull() & (col(n) == 1))).select(*[col(c) for c in docs.columns])
