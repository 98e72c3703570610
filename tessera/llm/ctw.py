"""LM scoring by context-tree weighting over bytes (operator 8).

A byte is eight binary decisions; decision v (the bits of the byte so far) has its own tree of contexts, the last
0 to ``depth`` bytes. At each node the Krichevsky-Trofimov estimate Pe of the decisions seen there is mixed with what
the deeper contexts say: Pw = Pe / 2 + (product of the children's Pw) / 2, and Pw = Pe at full depth. The counts are
those of the whole table. A decision of a text is coded with the posterior mixture along its context path: depth d
has the weight that the path stops there, Pe(d) / (2 Pw(d)), and the estimate (n1 + 1/2) / (n0 + n1 + 1). A text's
score is its code length in bits per byte.

Partitions count (context, byte) grams of their texts; the counts are summed in a shuffle, gathered by the last two
bytes of context, and each such subtree is weighted on its own; only depths 0 to 2, whose size the alphabet bounds,
meet on the driver. Texts look code lengths up in a table of the grams that occur. It is broadcast where its counted
size is under ``broadcast_bytes``. Beyond that texts are dealt to chunks by a hash; each chunk's distinct grams, packed,
go to hash buckets of the table and come back to the chunk's texts with their code lengths. So texts are shuffled once
at a time and grams once a chunk, not once a text, and nothing is sent to the driver or held whole by a worker.

Defined cases: before a text's start stand zero bytes; a null text has a null score, and so has an empty one, with 0
bytes; repeated rows count and score each; texts are scored whole; other columns pass through, and one that has the
score's name stays, the score's name getting an underscore before it; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import chunks, mix, signed, text_buffers
from .common import BROADCAST_BYTES, added, col, fresh, row_key, stage

DEPTH = 5
#: Bytes of text in a chunk, about, and most buckets that a chunk's grams are dealt to: a bucket's share must not get tiny.
CHUNK_BYTES, MOST_BUCKETS = 48 << 20, 1024
_HALF = math.log(0.5)
_SMALL = np.array([math.lgamma(k / 2) if k else 0.0 for k in range(512)])


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma of positive multiples of one half."""
    with np.errstate(divide="ignore", invalid="ignore"):
        big = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(x < 255, _SMALL[np.minimum(2 * x, 511).astype(np.int64)], big)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - math.log(math.pi)


def grams(body: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """For each byte its context, nearest byte highest, and itself lowest, as one integer."""
    out = body.astype(np.uint64)
    starts, ends = at[:-1], at[1:]
    for d in range(1, depth + 1):
        back = np.zeros(len(body), np.uint64)
        back[d:] = body[:-d] if d < len(body) else body[:0]
        for j in range(d):
            early = starts + j
            back[early[early < ends]] = 0
        out |= back << np.uint64(8 * (depth + 1 - d))
    return out


class Level:
    """The nodes of one depth: keys (context << 8 | decision), counts, log Pw, weight of stopping, parent's place."""

    def __init__(self, key: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray | None):
        self.key, self.a, self.b = key, a, b
        kt = log_kt(a, b)
        self.pw = kt if below is None else _HALF + np.logaddexp(kt, below)
        self.stop = np.ones(len(key)) if below is None else np.exp(np.minimum(0.0, _HALF + kt - self.pw))
        self.one = (b + 0.5) / (a + b + 1.0)

    def above(self) -> tuple[Level, np.ndarray]:
        """The depth above, and each node's parent in it."""
        key, parent = np.unique((self.key >> np.uint64(16) << np.uint64(8)) | (self.key & np.uint64(255)), return_inverse=True)
        n = len(key)
        return Level(key, np.bincount(parent, self.a, n), np.bincount(parent, self.b, n), np.bincount(parent, self.pw, n)), parent


def decisions(code: np.ndarray, n: np.ndarray) -> tuple[Level, np.ndarray, np.ndarray]:
    """The deepest level from gram counts; each gram's eight nodes in it and bits."""
    x, context = code & np.uint64(255), code >> np.uint64(8)
    keys, bits = [], []
    for k in range(8):
        v = (np.uint64(1) << np.uint64(k)) | (x >> np.uint64(8 - k))
        keys.append((context << np.uint64(8)) | v)
        bits.append((x >> np.uint64(7 - k)) & np.uint64(1))
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    bit = np.concatenate(bits).astype(np.float64)
    weight = np.tile(n.astype(np.float64), 8)
    return Level(key, np.bincount(where, weight * (1 - bit), len(key)), np.bincount(where, weight * bit, len(key)), None), where, bit


def _arrays(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not held:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([c for c, _ in held]).view(np.uint64), np.concatenate([n for _, n in held])


def _count(depth: int, most: int = 3 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merge() -> None:
            code, where = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            held[:] = [(code, np.bincount(where, np.concatenate([n for _, n in held]), len(code)).astype(np.int64))]

        def flush() -> pa.RecordBatch:
            merge()
            (code, n), held[:] = held[0], []
            return pa.RecordBatch.from_arrays([pa.array(signed(code)), pa.array(n)], names=["code", "n"])

        for batch in batches:
            body, at = text_buffers(batch.column(0))
            for lo, hi in chunks(at, 2 << 20):
                held.append(np.unique(grams(body[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], depth), return_counts=True))
                if sum(len(c) for c, _ in held) > most:
                    merge()
                    if len(held[0][0]) > most // 2:
                        yield flush()
        if held:
            yield flush()

    return run


def _tops(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n = _arrays(batches)
        if len(code):
            level, _, _ = decisions(code, n)
            for _ in range(depth - 2):
                level, _ = level.above()
            yield pa.RecordBatch.from_arrays([pa.array(signed(level.key)), pa.array(level.a), pa.array(level.b), pa.array(level.pw)], names=["key", "a", "b", "pw"])

    return run


def _lengths(depth: int, base: np.ndarray, rest: np.ndarray):
    """Code length of each gram; base and rest are what depths 0 and 1 give, by (last byte << 8 | decision)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n = _arrays(batches)
        if not len(code):
            return
        level, where, bit = decisions(code, n)
        path = [level]
        parents = []
        for _ in range(depth - 2):
            level, parent = level.above()
            path.append(level)
            parents.append(parent)
        top = path[-1]
        up = ((top.key >> np.uint64(16) << np.uint64(8)) | (top.key & np.uint64(255))).astype(np.int64)
        p, left = base[up], rest[up]
        for k in range(len(path) - 1, -1, -1):
            level = path[k]
            p = p + left * level.stop * level.one
            left = left * (1 - level.stop)
            if k:
                p, left = p[parents[k - 1]], left[parents[k - 1]]
        chosen = np.where(bit > 0, p[where], 1 - p[where])
        bits = -np.log2(np.maximum(chosen, 1e-300)).reshape(8, len(code)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(signed(code)), pa.array(bits), pa.array(n)], names=["code", "bits", "n"])

    return run


def fit(docs: DataFrame, depth: int = DEPTH, text: str = "text") -> DataFrame:
    """(code, bits, n): code length and number of every (context, byte) gram of the table under the model of the whole table."""
    if not 2 <= depth <= 6:
        raise ValueError("depth must be 2 to 6")
    seen = docs.select(col(text).alias("text")).where("length(text) > 0").mapInArrow(_count(depth), "code long, n long")
    counts = stage(seen.groupBy("code").agg(F.sum("n").alias("n")), "grams")
    by_context = counts.repartition(F.shiftright("code", 8 * (depth - 1)))
    # nodes of depth 2: bounded by the alphabet (256 x 256 contexts, 255 decisions each), not by the corpus
    rows = by_context.mapInArrow(_tops(depth), "key long, a double, b double, pw double").toArrow().sort_by("key")
    base, rest = np.zeros(1 << 16), np.ones(1 << 16)
    if len(rows):
        key, n0, n1, pw = (c.to_numpy() for c in rows.columns)
        two = Level(key.astype(np.uint64), n0, n1, None)
        two.pw = pw
        one, _ = two.above()
        zero, up = one.above()
        at = one.key.astype(np.int64)
        base[at] = (zero.stop * zero.one)[up] + (1 - zero.stop)[up] * one.stop * one.one
        rest[at] = (1 - zero.stop)[up] * (1 - one.stop)
    return stage(by_context.mapInArrow(_lengths(depth, base, rest), "code long, bits double, n long"), "code-lengths")


def _distinct(code: np.ndarray) -> np.ndarray:
    """Sorted; several times as fast as ``np.unique``, which hashes where it returns nothing else."""
    code = np.sort(code)
    return code[np.concatenate([[True], code[1:] != code[:-1]])] if len(code) else code


def _packed(code: np.ndarray) -> bytes:
    """Sorted grams as differences, byte by byte of their places, so that the high ones, mostly zero, compress."""
    return np.diff(code, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _dealt(code: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its grams, in order) for the buckets that occur."""
    bucket = (mix(code) % np.uint64(buckets)).astype(np.uint16)
    order, ends = np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=buckets))
    for b in np.flatnonzero(np.diff(ends, prepend=0)):
        yield int(b), order[ends[b - 1] if b else 0 : ends[b]]


def _chunk_grams(depth: int, buckets: int, most: int = 8 << 20):
    """chunk, text -> bucket, chunk, code: the distinct grams of each chunk's texts in a partition, packed by bucket.

    ``most`` grams are held; a chunk of mixed languages has some 3.5 million, and what is let go early may come again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def merge(chunk: int) -> None:
            held[chunk] = [_distinct(np.concatenate(held[chunk]))]

        def flush(chunk: int) -> pa.RecordBatch:
            merge(chunk)
            code = held.pop(chunk)[0]
            found = [(b, _packed(code[at])) for b, at in _dealt(code, buckets)]
            columns = [pa.array([b for b, _ in found], pa.int32()), pa.array([chunk] * len(found), pa.int32()), pa.array([x for _, x in found], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "chunk", "code"])

        for batch in batches:
            owner = batch.column(0).to_numpy()
            for chunk in np.unique(owner).tolist():
                body, at = text_buffers(batch.column(1).filter(pa.array(owner == chunk)))
                for lo, hi in chunks(at, 2 << 20):
                    held.setdefault(chunk, []).append(_distinct(grams(body[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], depth)))
                    if sum(map(len, held[chunk])) > most:
                        merge(chunk)
                        if len(held[chunk][0]) > most // 2:
                            yield flush(chunk)
            while sum(len(c) for x in held.values() for c in x) > most:
                yield flush(max(held, key=lambda k: sum(map(len, held[k]))))
        for chunk in list(held):
            yield flush(chunk)

    return run


def _by_bucket(buckets: int, most: int = 1 << 20):
    """code, bits, n -> bucket, chunk, code, bits: the table packed by bucket, as of chunk -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            code, bits = _arrays(iter(held))
            held.clear()
            order = np.argsort(code)
            code, bits = code[order], bits[order].astype(np.float32)
            found = [(b, _packed(code[at]), bits[at].tobytes()) for b, at in _dealt(code, buckets)]
            columns = [pa.array([b for b, _, _ in found], pa.int32()), pa.array([-1] * len(found), pa.int32()), pa.array([x for _, x, _ in found], pa.binary()), pa.array([x for _, _, x in found], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "chunk", "code", "bits"])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) > most:
                yield flush()
        if sum(map(len, held)):
            yield flush()

    return run


class _Table:
    """Code lengths of grams, gathered part by part and sorted when the first is looked up."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, code: bytes, bits: bytes) -> None:
        self.parts.append((_unpacked(code), np.frombuffer(bits, np.float32)))

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) != 1:
            # parts go as soon as they are copied: a worker has room for about one more table
            code, bits = [x for x, _ in self.parts], [y for _, y in self.parts]
            self.parts.clear()
            code = np.concatenate([*code, np.zeros(0, np.uint64)])
            order = np.argsort(code)
            code = code[order]
            bits = np.concatenate([*bits, np.zeros(0, np.float32)])[order]
            self.parts.append((code, bits))
        return self.parts[0]


def _find(known: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Places of the grams in the sorted table, which must have them all."""
    at = np.searchsorted(known, code)
    if len(code) and (at[-1] == len(known) or (known[at] != code).any()):
        raise ValueError("a text has grams that weren't counted; does the table change from one reading to the next?")
    return at


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by bucket, the table's before the chunks' -> chunk, code, bits."""
    now, table = None, _Table()
    for batch in batches:
        chunk, code, bits = [], [], []
        for b, c, x, y in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if b != now:
                now, table = b, _Table()
            if c < 0:
                table.add(x, y)
                continue
            known, of = table.sorted()
            chunk.append(c)
            code.append(x)
            bits.append(of[_find(known, _unpacked(x))].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int32()), pa.array(code, pa.binary()), pa.array(bits, pa.binary())], names=["chunk", "code", "bits"])


def _scores(column: pa.Array, known: np.ndarray, bits: np.ndarray, depth: int) -> pa.Array:
    """Code length per byte of each text from the sorted table."""
    body, at = text_buffers(column)
    total = np.zeros(len(at) - 1)
    for lo, hi in chunks(at, 2 << 20):
        own, off = grams(body[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], depth), at[lo : hi + 1] - at[lo]
        code, where = np.unique(own, return_inverse=True)
        upto = np.concatenate([[0.0], np.cumsum(bits[_find(known, code)].astype(np.float64)[where])])
        total[lo:hi] = np.diff(upto[off])
    wide = np.diff(at)
    return pa.array(total / np.maximum(wide, 1), mask=wide == 0)


def _score_by_chunk(docs: DataFrame, table: DataFrame, total: int, depth: int, doc_id: str, text: str, name: str) -> DataFrame:
    """``score`` for a table of code lengths of any size; total: bytes of all texts."""
    n = max(1, -(-total // CHUNK_BYTES))
    buckets = min(n, MOST_BUCKETS)
    # names that neither clash with the table's columns nor with the score's
    chunk, code, bits = fresh(docs.withColumn(fresh(docs, name)[0], F.lit(0)), "chunk", "code", "bits")
    keyed = docs.withColumn(chunk, F.pmod(row_key(doc_id, text), F.lit(n)).cast("int"))
    texts = keyed.where(F.octet_length(col(text)) > 0).select(col(chunk).alias("chunk"), col(text).alias("text"))
    asked = stage(texts.repartitionById(n, "chunk").mapInArrow(_chunk_grams(depth, buckets), "bucket int, chunk int, code binary"), "chunk-grams")
    known = table.mapInArrow(_by_bucket(buckets), "bucket int, chunk int, code binary, bits binary")
    met = known.unionByName(asked, allowMissingColumns=True).repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "chunk")
    found = met.mapInArrow(_looked_up, "chunk int, code binary, bits binary")
    found = found.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema], F.col("chunk").alias(chunk), F.col("code").alias(code), F.col("bits").alias(bits))
    rows = found.union(keyed.withColumns({code: F.lit(None).cast("binary"), bits: F.lit(None).cast("binary")}))

    def scored(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        now, own = None, _Table()
        for which, codes, lengths, texts in batches:
            at, is_text = which.to_numpy(), np.asarray(codes.is_null())
            ends = np.flatnonzero((at[1:] != at[:-1]) | (is_text[1:] != is_text[:-1])) + 1
            out = []
            for lo, hi in zip([0, *ends.tolist()], [*ends.tolist(), len(at)]):
                if lo == hi:
                    continue
                if at[lo] != now:
                    now, own = at[lo], _Table()
                if is_text[lo]:
                    out.append(_scores(texts.slice(lo, hi - lo), *own.sorted(), depth))
                else:
                    for k in range(lo, hi):
                        own.add(codes[k].as_py(), lengths[k].as_py())
                    out.append(pa.nulls(hi - lo, pa.float64()))
            yield pa.concat_arrays(out) if out else pa.nulls(0, pa.float64())

    # not deterministic: a text's score comes from the rows before it, so no filter or sort may move past the function
    look = F.arrow_udf(scored, "double").asNondeterministic()
    sorted_rows = rows.repartitionById(n, chunk).sortWithinPartitions(col(chunk), col(code).isNull())
    scores = sorted_rows.withColumn(fresh(docs, name)[0], look(col(chunk), col(code), col(bits), col(text)))
    return scores.where(col(code).isNull()).drop(chunk, code, bits)


def score(docs: DataFrame, depth: int = DEPTH, doc_id: str = "doc_id", text: str = "text", name: str = "bits_per_byte", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with the code length per byte of each text under the model of all texts."""
    table = fit(docs, depth, text)
    n, total = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if 16 * n > broadcast_bytes:
        return _score_by_chunk(docs, table, total, depth, doc_id, text, name)
    rows = table.select("code", "bits").toArrow().sort_by("code")
    shared = docs.sparkSession.sparkContext.broadcast((rows.column(0).to_numpy().astype(np.uint64), rows.column(1).to_numpy().astype(np.float32)))

    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield _scores(column, *shared.value, depth)

    return added(docs, {name: F.arrow_udf(scored, "double")(col(text))})
