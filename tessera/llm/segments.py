"""Exact nearest neighbours by multi-resolution segment statistics (operator 4).

A vector is cut into equal segments; with mean m and deviation s of each segment of w components, the sum of
w ((m - m')^2 + (s - s')^2) is a lower bound of the squared Euclidean distance (by Cauchy-Schwarz in each segment).
Coarse bounds of few segments come first, then finer ones, then exact distances for what is left.

The queries are the rows whose id is divisible by ``every`` (1: all); they are asked against all rows. A k-d tree over
segment statistics, fitted to a sample of at most ``most_sample`` rows, sends every row to a leaf; a leaf of more than
``block`` rows, such as one of many copies, is cut by a hash, so blocks are bounded whatever the data. Each block keeps
the box of its finest statistics. First a query is searched in its own block, which bounds its k-th distance from
above. Then it is sent to the other blocks whose box isn't farther than that; there it meets the block's rows in the
order of the levels. A task holds one block and streams the queries sent to it. Results are exact for any tree.

Defined cases: rows with a null or empty vector, a null or non-finite component, a null id, or another dimension than
most rows, neither ask nor answer; a row isn't its own neighbour, but rows of another id with an equal vector are, at
distance 0; ties in distance go to the lesser id; rows that repeat id and vector count once, an id with several
vectors as several rows, each a query and a neighbour of its own; fewer than k other rows give fewer neighbours; an
empty table gives none; other columns aren't returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, stage
from .pivots import matrix, sample

K, LEVELS, BLOCK, EVERY, MOST_SAMPLE = 10, (2, 4, 8, 16), 8192, 50, 1 << 18


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    v = col(embedding)
    if vectors.schema[embedding].dataType.simpleString() != "array<float>":
        v = v.cast("array<double>")
    rows = vectors.select(col(vec_id).cast("long").alias("id"), v.alias("v")).where("id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('Infinity'))")
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    return rows.join(F.broadcast(usual), F.size("v") == F.col("d")).select("id", "v")


def statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """Scaled means and deviations: squared distances of these are lower bounds of those of the vectors."""
    parts = np.array_split(np.arange(v.shape[1]), min(segments, v.shape[1]))
    out = [np.sqrt(len(p)) * f(v[:, p], axis=1) for p in parts for f in (np.mean, np.std)]
    return np.column_stack(out)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


class Side:
    """Rows of a block with their statistics at every level."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, v: np.ndarray, levels: tuple[int, ...]):
        self.ids, self.rows, self.v = ids, rows, v.astype(np.float64)
        self.single = v.astype(np.float32)
        self.levels = [statistics(self.v, s).astype(np.float32) for s in levels]
        self.norm = (self.v * self.v).sum(1).max(initial=0)

    def part(self, keep: np.ndarray) -> Side:
        out = Side.__new__(Side)
        out.ids, out.rows, out.v, out.single = self.ids[keep], self.rows[keep], self.v[keep], self.single[keep]
        out.levels, out.norm = [x[keep] for x in self.levels], self.norm
        return out


def nearest(q: Side, d: Side, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, data place, squared distance) of each query's up to k nearest in d within its bound."""
    # bounds are taken in single precision: its rounding must not prune a true neighbour
    slack = 1e-5 * (1 + q.norm + d.norm)
    qs, ds, dist = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for lo in range(0, len(q.ids), 256):
        rows = np.arange(lo, min(lo + 256, len(q.ids)))
        limit = (bound[rows] + slack).astype(np.float32)[:, None]
        live, fine = np.arange(len(d.ids)), len(d.levels) - 1
        level = 0
        while True:  # a column lives while some row of the tile may need it
            near = squared(q.levels[level][rows], d.levels[level][live]) <= limit
            some = near.any(axis=0)
            kept = some.mean() if len(some) else 0.0
            live, near = live[some], near[:, some]
            if level == fine or not len(live):
                break
            level = level + 1 if kept < 0.9 else fine  # a level that spares little is followed by the finest
        if not len(live):
            continue
        near &= q.ids[rows][:, None] != d.ids[live][None, :]
        rough = squared(q.single[rows], d.single[live])
        rough[~near] = np.inf
        if k < len(live):
            near &= rough <= np.minimum(np.partition(rough, k - 1, axis=1)[:, k - 1 : k] + np.float32(2 * slack), limit)
        x, y = np.nonzero(near)
        gap = q.v[rows[x]] - d.v[live[y]]
        exact = np.einsum("ij,ij->i", gap, gap)
        order = np.lexsort((d.ids[live[y]], exact, x))
        x, y, exact = x[order], y[order], exact[order]
        rank = np.arange(len(x)) - np.searchsorted(x, x)
        ok = (rank < k) & (exact <= bound[rows[x]] * (1 + 1e-12))
        qs.append(rows[x[ok]])
        ds.append(live[y[ok]])
        dist.append(exact[ok])
    return np.concatenate(qs), np.concatenate(ds), np.concatenate(dist)


class Tree:
    """A complete k-d tree over segment statistics, its nodes in heap order."""

    def __init__(self, sample: np.ndarray, depth: int, segments: int):
        self.depth, self.segments = depth, segments
        self.axis, self.cut = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
        parts = [statistics(sample, segments)]
        for level in range(depth):
            below = []
            for k, s in enumerate(parts):
                at = 2**level - 1 + k
                if len(s):
                    self.axis[at] = int(s.var(0).argmax())
                    self.cut[at] = np.median(s[:, self.axis[at]])
                right = s[:, self.axis[at]] > self.cut[at]
                below += [s[~right], s[right]]
            parts = below

    def leaves(self, v: np.ndarray) -> np.ndarray:
        s, node = statistics(v, self.segments), np.zeros(len(v), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (s[np.arange(len(s)), self.axis[node]] > self.cut[node])
        return node - (2**self.depth - 1)


def _placed(tree: Tree):
    """id, v, row -> leaf, row, id, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.leaves(matrix(batch.column(1)).astype(np.float64)) if len(batch) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), batch.column(2), batch.column(0), batch.column(1)], names=["leaf", "row", "id", "v"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut where the first column changes."""
    for batch in batches:
        b = batch.column(0).to_numpy()
        cut = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1, [len(b)]])
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


_FOUND = "row long, id long, neighbour long, d2 double"


def _found(q: Side, d: Side, at: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[pa.Array]:
    return [pa.array(q.rows[at[0]]), pa.array(q.ids[at[0]]), pa.array(d.ids[at[1]]), pa.array(at[2])]


def _own(k: int, levels: tuple[int, ...], every: int):
    """block, row, id, v, a block's rows in succession -> its queries' nearest in it, then its box."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "id", "neighbour", "d2", "block", "lo", "hi"]
        box = pa.list_(pa.float64())

        def done(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            d = Side(t.column("id").to_numpy(), t.column("row").to_numpy(), matrix(t.column("v")), levels)
            q = d.part(np.flatnonzero(d.ids % every == 0))
            if len(q.ids):
                found = _found(q, d, nearest(q, d, k, np.full(len(q.ids), np.inf)))
                n = len(found[0])
                yield pa.RecordBatch.from_arrays([*found, pa.nulls(n, pa.int64()), pa.nulls(n, box), pa.nulls(n, box)], names=names)
            s = statistics(d.v, levels[-1])
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, x) for x in (pa.int64(), pa.int64(), pa.int64(), pa.float64())), t.column("block").combine_chunks().slice(0, 1), pa.array([s.min(0).tolist()], box), pa.array([s.max(0).tolist()], box)], names=names)

        held: list[pa.RecordBatch] = []
        for part in _runs(batches):
            if held and held[0].column(0)[0] != part.column(0)[0]:
                yield from done(held)
                held = []
            held.append(part)
        if held:
            yield from done(held)

    return run


def _routes(blocks: np.ndarray, low: np.ndarray, high: np.ndarray, finest: int):
    """row, block, id, v, bound -> one line for each other block that may hold a neighbour."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 21) // max(1, len(blocks)))
        for batch in batches:
            for lo in range(0, len(batch), step):
                part = batch.slice(lo, step)
                v = matrix(part.column(3)).astype(np.float64)
                s = statistics(v, finest)
                gap = np.zeros((len(s), len(blocks)))
                for c in range(s.shape[1]):
                    out = np.maximum(np.maximum(low[:, c][None, :] - s[:, c][:, None], s[:, c][:, None] - high[:, c][None, :]), 0)
                    gap += out * out
                bound = part.column(4).to_numpy(zero_copy_only=False)
                slack = 1e-9 * (1 + 2 * (v * v).sum(1))
                x, y = np.nonzero((gap <= (bound + slack)[:, None]) & (part.column(1).to_numpy()[:, None] != blocks[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(blocks[y]), *(part.column(c).take(pa.array(x)) for c in (0, 2, 3, 4))], names=["block", "row", "id", "v", "bound"])

    return run


def _others(k: int, levels: tuple[int, ...]):
    """Rows of one block, data first (bound null), then the queries sent there, which are streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, side = None, [], None
        for part in _runs(batches):
            if part.column(0)[0].as_py() != block:
                block, held, side = part.column(0)[0].as_py(), [], None
            data = np.asarray(part.column(4).is_null())
            n = int(data.sum())
            if n:
                held.append(part.slice(0, n))
            if n == len(part):
                continue
            if side is None:
                t = pa.Table.from_batches(held)
                side, held = Side(t.column("id").to_numpy(), t.column("row").to_numpy(), matrix(t.column("v")), levels), []
            asked = part.slice(n)
            q = Side(asked.column(2).to_numpy(), asked.column(1).to_numpy(), matrix(asked.column(3)), levels)
            yield pa.RecordBatch.from_arrays(_found(q, side, nearest(q, side, k, asked.column(4).to_numpy())), names=["row", "id", "neighbour", "d2"])

    return run


def nearest_neighbours(vectors: DataFrame, k: int = K, levels: tuple[int, ...] = LEVELS, block: int = BLOCK, every: int = EVERY, most_sample: int = MOST_SAMPLE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): the k nearest other rows, by Euclidean distance, of each query."""
    spark = vectors.sparkSession
    raw = usable(vectors, vec_id, embedding)
    n = raw.count()
    if n < 2:
        return spark.createDataFrame([], "vec_id long, rank int, neighbour_id long, distance double")
    # a leaf's cut rests on 16 rows of the sample at least
    depth = max(0, min(math.ceil(math.log2(n / block)), int(math.log2(most_sample / 16))))
    tree = Tree(matrix(sample(raw, n, min(most_sample, 64 * 2**depth)).column(0)).astype(np.float64), depth, levels[min(2, len(levels) - 1)])
    kind_of_v = raw.schema["v"].dataType.simpleString()
    rows = raw.distinct().withColumn("row", F.xxhash64("id", "v"))
    rows = stage(rows.mapInArrow(_placed(tree), f"leaf long, row long, id long, v {kind_of_v}"), "leaves")
    # at most most_sample / 16 leaves
    sizes = rows.groupBy("leaf").count().orderBy("leaf").collect()
    parts, first = [], 0
    for leaf, count in sizes:
        parts.append((leaf, first, -(-count // block)))
        first += parts[-1][2]
    cut = F.broadcast(spark.createDataFrame(parts, "l long, first long, parts long"))
    blocks = rows.join(cut, F.col("leaf") == F.col("l")).selectExpr("first + pmod(xxhash64(7, row), parts) as block", "row", "id", "v")
    own = stage(blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_own(k, levels, every), _FOUND + ", block long, lo array<double>, hi array<double>"), "own-block")
    # one box per block, of the finest statistics: n / block rows
    boxes = own.where("block is not null").select("block", "lo", "hi").toPandas()
    found = own.where("block is null").select("row", "id", "neighbour", "d2")
    bounds = found.groupBy("row").agg(F.when(F.count("*") >= k, F.max("d2")).alias("bound"))
    asking = blocks.where(F.pmod("id", F.lit(every)) == 0).join(bounds, "row", "left").selectExpr("row", "block", "id", "v", "coalesce(bound, double('Infinity')) as bound")
    routed = asking.mapInArrow(_routes(boxes.block.to_numpy(), np.array(boxes.lo.tolist()), np.array(boxes.hi.tolist()), levels[-1]), f"block long, row long, id long, v {kind_of_v}, bound double")
    both = blocks.selectExpr("block", "row", "id", "v", "cast(null as double) as bound").unionByName(routed)
    second = both.repartition("block").sortWithinPartitions("block", F.col("bound").isNotNull()).mapInArrow(_others(k, levels), _FOUND)
    best = Window.partitionBy("row").orderBy("d2", "neighbour")
    return found.union(second).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).selectExpr("id as vec_id", "rank", "neighbour as neighbour_id", "sqrt(d2) as distance")


TOP_K_SQL = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
d AS (SELECT a.vec_id, b.vec_id AS neighbour_id, list_distance(a.v, b.v) AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id)::INT AS rank, neighbour_id, distance FROM d)
SELECT * FROM r WHERE rank <= {K}
"""
