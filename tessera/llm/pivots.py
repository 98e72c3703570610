"""Embedding near-dedup by a pivot-permutation index (operator 3).

Reference points (pivots) are rows of the table, from a sample spread by a hash of vec_id, of which near copies of one
another are dropped; there are about ``per_root`` times the root of the table's rows, ``most_pivots`` at most, and
beyond that lists grow with the table. Each vector is described by its ``nearest`` pivots in order. Pivots are ranked
from the rarest to the commonest; of two vectors that share ``shared`` pivots or more, the rarest shared one is among
the first ``nearest - shared + 1`` of both, so a vector is posted in the inverted lists of these alone, and a pair is
handled in the list of its rarest shared pivot only. In a list, shared pivots are counted from the lists of its
members' other pivots; pairs with enough are verified by their exact cosine.

Equal vectors are one class, of which the index holds one. A list longer than ``block`` is cut into blocks, and each
pair of blocks is a task of its own, so a hot list is spread; a task returns numbers of links and the edges of a
spanning forest, not pairs.

The result has a row per distinct (vec_id, vector) that is usable: ``class_id``, the least vec_id that chains of links
lead to, and ``n_links``, how many other such rows have a cosine of at least ``similar``.

Defined cases: rows with a null or empty vector, a null or non-finite component, length zero, or another dimension
than most rows, are left out; a null vec_id likewise; equal directions are linked (cosine 1); rows that repeat vec_id
and vector count once, an id with several vectors has a row for each, which may be linked; ties are all kept; other
columns aren't returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, stage
from .components import components

SIMILAR, NEAREST, SHARED, BLOCK, PER_ROOT, MOST_PIVOTS = 0.95, 12, 4, 2000, 4.0, 60_000


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v): distinct ids and unit vectors of the usual dimension."""
    v = col(embedding).cast("array<double>")
    rows = vectors.select(col(vec_id).cast("long").alias("id"), v.alias("v")).where("id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('Infinity'))")
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    rows = rows.join(F.broadcast(usual), F.size("v") == F.col("d")).select("id", "v", F.expr("sqrt(aggregate(v, 0D, (a, x) -> a + x * x))").alias("l")).where("l > 0")
    return rows.select("id", F.expr("transform(v, x -> cast(x / l as float))").alias("v")).distinct()


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1), np.float32)


def sample(rows: DataFrame, n: int, want: int) -> pa.Table:
    """About ``want`` of ``n`` rows' vectors, never more, in the order of a hash of id; only these reach the driver."""
    order = F.xxhash64(F.lit(9), "id")
    some = rows.where(F.pmod(order, F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, 1.5 * want / n)))) if n > want else rows
    return some.orderBy(order, "id").limit(want).select("v").toArrow()


def choose_pivots(rows: DataFrame, n: int, per_root: float = PER_ROOT, similar: float = SIMILAR, most: int = MOST_PIVOTS) -> np.ndarray:
    """Pivots, from a sample of twice their number."""
    want = min(most, max(1, int(per_root * math.sqrt(n))))
    v = matrix(sample(rows, n, 2 * want).column(0))
    keep = np.empty_like(v)
    kept = 0
    for lo in range(0, len(v), 512):
        part = v[lo : lo + 512]
        part = part[(part @ keep[:kept].T).max(axis=1, initial=-1) < similar]
        alike = np.tril(part @ part.T >= similar, -1)
        ok = np.ones(len(part), bool)
        for k in np.flatnonzero(alike.any(axis=1)):
            ok[k] = not (alike[k] & ok).any()
        new = part[ok][: want - kept]
        keep[kept : kept + len(new)] = new
        kept += len(new)
        if kept == want:
            break
    return keep[:kept]


def _lists(pivots: np.ndarray, nearest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                v = matrix(part.column(1))
                close = v @ pivots.T
                k = min(nearest, len(pivots))
                top = np.argpartition(-close, k - 1, axis=1)[:, :k]
                rank = np.argsort(-np.take_along_axis(close, top, 1), axis=1, kind="stable")
                order = np.take_along_axis(top, rank, 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(np.arange(0, (len(part) + 1) * k, k, dtype=np.int32)), pa.array(order.ravel()))], names=["h", "v", "n", "pivots"])

    return run


def _shared_counts(p: np.ndarray, q: np.ndarray, pivot: int) -> tuple[np.ndarray, np.ndarray]:
    """How many pivots each row of ``p`` shares with each of ``q``; and whether one of them ranks before ``pivot``."""
    names, own = np.unique(np.concatenate([p.ravel(), q.ravel()]), return_inverse=True)
    a, b = own[: p.size].reshape(p.shape), own[p.size :]
    order = np.argsort(b, kind="stable")
    member, begin = order // q.shape[1], np.searchsorted(b[order], np.arange(len(names) + 1))
    size = np.diff(begin)[a.ravel()]
    n = len(q)
    if size.sum() < 4 * len(p) * n:  # from the lists of each pivot
        at = np.repeat(begin[a.ravel()] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        cell = np.repeat(np.arange(len(p)), size.reshape(p.shape).sum(1)) * n + member[at]
        early = np.repeat(names[a.ravel()] < pivot, size)
        return np.bincount(cell, minlength=len(p) * n).reshape(len(p), n), np.bincount(cell[early], minlength=len(p) * n).reshape(len(p), n) > 0
    one, two = np.zeros((len(p), len(names)), np.float32), np.zeros((n, len(names)), np.float32)  # lists as long as the block
    one[np.arange(len(p))[:, None], a] = 1
    two[np.arange(n)[:, None], b.reshape(q.shape)] = 1
    first = int(np.searchsorted(names, pivot))
    return one @ two.T, one[:, :first] @ two[:, :first].T > 0


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least place that edges x - y lead to, for each of n places."""
    least = np.arange(n)
    while len(x):
        a, b = least[x], least[y]
        if (a == b).all():
            break
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (up := least[least]).tobytes() != least.tobytes():
            least = up
    return least


def _verify(shared: int, similar: float):
    """Rows of one (list, block pair), sorted by it: side 0 and 1 -> links of each and a forest's edges."""

    def links(pivot: int, table: pa.Table) -> pa.RecordBatch:
        side = table.column("side").to_numpy()
        h, n = table.column("h").to_numpy(), table.column("n").to_numpy()
        v, p = matrix(table.column("v")), matrix(table.column("pivots"))
        left = np.flatnonzero(side == 0)
        alone = len(left) == len(side)
        right = left if alone else np.flatnonzero(side == 1)
        found = np.zeros(len(h), np.int64)
        least = np.arange(len(h))
        for lo in range(0, len(left), 256):
            rows = left[lo : lo + 256]
            count, early = _shared_counts(p[rows], p[right], pivot)
            ok = (count >= shared) & ~early
            if alone:
                ok &= rows[:, None] < right[None, :]
            a, b = np.nonzero(ok)
            if 8 * len(a) > ok.size:  # many candidates: all cosines of the tile at once
                near = (v[rows] @ v[right].T)[a, b] >= similar - 1e-5
                a, b = a[near], b[near]
            for at in range(0, len(a), 1 << 16):
                x, y = rows[a[at : at + (1 << 16)]], right[b[at : at + (1 << 16)]]
                near = np.einsum("ij,ij->i", v[x].astype(np.float64), v[y].astype(np.float64)) >= similar
                x, y = x[near], y[near]
                found += np.bincount(x, n[y], len(h)).astype(np.int64) + np.bincount(y, n[x], len(h)).astype(np.int64)
                least = forest(len(h), np.concatenate([np.arange(len(h)), x]), np.concatenate([least, y]))
        some = np.flatnonzero(found)
        return pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(h[least[some]]), pa.array(found[some])], names=["h", "to", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            yield links(t.column("pivot")[0].as_py(), t)

        key = None
        for batch in batches:
            k = np.column_stack([batch.column(c).to_numpy() for c in range(3)])
            cut = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, [len(k)]]) if len(k) else [0]
            for a, b in zip(cut[:-1], cut[1:]):
                if key is not None and key != tuple(k[a]):
                    yield from done()
                    held = []
                key = tuple(k[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from done()

    return run


def near_classes(vectors: DataFrame, similar: float = SIMILAR, nearest: int = NEAREST, shared: int = SHARED, block: int = BLOCK, per_root: float = PER_ROOT, most_pivots: int = MOST_PIVOTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, class_id, n_links): each vector's class of near copies and its number of near vectors."""
    spark = vectors.sparkSession
    rows = stage(usable(vectors, vec_id, embedding).withColumn("h", F.xxhash64("v")), "vectors")
    reps = stage(rows.groupBy("h").agg(F.any_value("v").alias("v"), F.count("*").alias("n"), F.min("id").alias("id")), "vector-classes")
    n = reps.count()
    if not n:
        return spark.createDataFrame([], "vec_id long, class_id long, n_links long")
    pivots = choose_pivots(reps, n, per_root, similar, most_pivots)
    shared, nearest = min(shared, len(pivots)), min(nearest, len(pivots))
    index = stage(reps.select("h", "v", "n").mapInArrow(_lists(pivots, nearest), "h long, v array<float>, n long, pivots array<int>"), "pivot-lists")
    # ranks: as many numbers as there are pivots
    often = dict(tuple(r) for r in index.select(F.explode("pivots").alias("p")).groupBy("p").count().collect())
    rank = np.empty(len(pivots), np.int32)
    rank[sorted(range(len(pivots)), key=lambda p: (often.get(p, 0), p))] = np.arange(len(pivots), dtype=np.int32)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.sort(rank[matrix(batch.column(3))], axis=1) if len(batch) else np.zeros((0, nearest), np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(np.arange(0, (len(batch) + 1) * nearest, nearest, dtype=np.int32)), pa.array(p.ravel()))], names=["h", "v", "n", "pivots"])

    index = index.mapInArrow(ranked, "h long, v array<float>, n long, pivots array<int>")
    posted = index.select("*", F.explode(F.slice("pivots", 1, nearest - shared + 1)).alias("pivot"))
    lists = posted.groupBy("pivot").count().where("count > 1").selectExpr("pivot as list", f"cast(ceil(count / {block}) as int) as blocks")
    # at most one row per pivot
    placed = posted.join(F.broadcast(lists), F.col("pivot") == F.col("list")).withColumn("own", F.expr("cast(pmod(xxhash64(h), blocks) as int)"))
    # block own meets every block: as side 0 of pairs (own, y >= own), as side 1 of pairs (x < own, own)
    sent = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).selectExpr("pivot", "least(own, other) as x", "greatest(own, other) as y", "if(own <= other, 0, 1) as side", "h", "v", "n", "pivots")
    done = sent.repartition("pivot", "x", "y").sortWithinPartitions("pivot", "x", "y", "h").mapInArrow(_verify(shared, similar), "h long, to long, links long")
    done = stage(done.groupBy("h", "to").agg(F.sum("links").alias("links")), "links")
    links = done.groupBy("h").agg(F.sum("links").alias("links"))
    roots = components(done.select(F.col("h").alias("u"), F.col("to").alias("v")))
    of = reps.select("h", "n", "id").join(links, "h", "left").join(roots, F.col("h") == F.col("node"), "left").select("h", "id", F.expr("n - 1 + coalesce(links, 0)").alias("n_links"), F.coalesce("root", "h").alias("root"))
    least = of.groupBy("root").agg(F.min("id").alias("class_id"))
    verdict = of.join(least, "root").select(F.col("h").alias("key"), "class_id", "n_links")
    return rows.select("id", "h").join(verdict, F.col("h") == F.col("key")).select(F.col("id").alias("vec_id"), "class_id", "n_links")
