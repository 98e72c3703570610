"""Quality classifier (operator 7): random Fourier features of document statistics, ridge, isotonic calibration.

A text becomes ``STATISTICS`` numbers (sizes, letter classes, repetition), standardised, then cosines of ``features``
random projections, which approximate a Gaussian kernel of width ``width``. Each partition of the labelled sample
sums its part of Z'Z and Z'y; the sums, row by row of the matrix, meet in a groupBy. Scores of the held-out quarter
of the sample are calibrated by pool-adjacent-violators; between two steps the calibration is linear. ``most_labels`` bounds the labelled rows used to fit, taken
in the order of a hash of doc_id; scoring covers every row and every whole text.

Defined cases: labels whose doc_id or quality is null, and those whose document is missing, are not used; several
labels of one document all count; a null text has a null score and is kept, an empty one is scored by its zero
statistics; repeated rows score alike; with no usable label, or only one class, scores are null and all rows are
kept; extra columns pass through, whatever their names, and one that has the score's name stays, the score's name
getting an underscore before it; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Words, chunks, text_buffers
from .common import added, col, fresh, stage

STATISTICS = ["bytes", "words", "word_bytes", "upper", "digit", "punct", "marks", "bars", "other", "blank", "lines", "fresh_words", "fresh_lines"]
MOST_LABELS, FEATURES, WIDTH, RIDGE, LEAST_QUALITY = 20_000, 256, 3.0, 1e-3, 0.5

_CLASS = np.zeros((256, 7), np.int64)
_CLASS[[b for b in range(65, 91)], 0] = 1
_CLASS[[b for b in range(48, 58)], 1] = 1
_CLASS[[b for b in range(33, 127) if not chr(b).isalnum()], 2] = 1
_CLASS[ord("!"), 3] = _CLASS[ord("|"), 4] = 1
_CLASS[128:, 5] = 1
_CLASS[[9, 10, 11, 12, 13, 32], 6] = 1
#: All seven counts packed in one integer per byte, 21 bits for three classes at a time.
_PACKED = [(_CLASS[:, a] << 42) + (_CLASS[:, b] << 21 if b is not None else 0) + (_CLASS[:, c] if c is not None else 0) for a, b, c in ((0, 1, 2), (3, 4, 5), (6, None, None))]
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def _distinct(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    key = np.unique((owner.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    return np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=n)


def statistics(column: pa.Array) -> np.ndarray:
    """(texts, len(STATISTICS)) numbers."""
    body, at = text_buffers(column)
    out = np.zeros((len(at) - 1, len(STATISTICS)))
    for lo, hi in chunks(at, 2 << 20):
        part, off = body[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        n, size = hi - lo, np.diff(off)
        counts = np.zeros((n, 7))
        some = np.flatnonzero(size)
        if len(some):
            for k, packed in enumerate(_PACKED):
                # a class of 21 bits holds segments of up to 2 MB; longer texts are a chunk of their own, summed in pieces
                cuts = np.unique(np.concatenate([off[some], np.arange(0, len(part), 1 << 20)]))
                sums = np.add.reduceat(packed[part], cuts)
                where = np.searchsorted(off[some], cuts, "right") - 1
                for c, bits in enumerate((42, 21, 0)):
                    if 3 * k + c < 7:
                        counts[some, 3 * k + c] = np.bincount(where, (sums >> bits) & 0x1FFFFF, len(some))
        w, lines = Words(part, off), Words(part, off, _NEWLINE)
        n_words, n_lines = np.diff(w.first), np.diff(lines.first)
        wide = np.maximum(size, 1)
        out[lo:hi] = np.column_stack(
            [
                np.log1p(size), np.log1p(n_words), size / np.maximum(n_words, 1), *(counts[:, :7] / wide[:, None]).T, np.log1p(n_lines),
                _distinct(w.hashes, np.repeat(np.arange(n), n_words), n) / np.maximum(n_words, 1), _distinct(lines.hashes, np.repeat(np.arange(n), n_lines), n) / np.maximum(n_lines, 1),
            ]
        )
    out[:, 2] = np.log1p(out[:, 2])
    return out


def projections(features: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.standard_normal((len(STATISTICS), features)) / width, rng.uniform(0, 2 * np.pi, features)


def fourier(x: np.ndarray, features: int, width: float) -> np.ndarray:
    w, b = projections(features, width)
    return np.column_stack([np.cos(x @ w + b) * np.sqrt(2 / features), np.ones(len(x))])


def pool_adjacent(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: least scores of the steps, and their values. Equal scores share a step."""
    at, inverse = np.unique(scores, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    value = np.bincount(inverse, labels) / weight
    steps: list[list[float]] = []
    for s, v, w in zip(at, value, weight):
        steps.append([s, v, w])
        while len(steps) > 1 and steps[-2][1] >= steps[-1][1]:
            _, v2, w2 = steps.pop()
            s1, v1, w1 = steps.pop()
            steps.append([s1, (v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2])
    return np.array([s[0] for s in steps]), np.array([s[1] for s in steps])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    values: np.ndarray
    features: int
    width: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale, self.features, self.width) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.steps, self.values)


def _stat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column(3))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c) for c in x.T)], names=["y", "held", "part", *STATISTICS])


def fit(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, doc_id: str = "doc_id", text: str = "text") -> Model | None:
    """The model, or None where no usable label, or only one class, is there."""
    order = F.xxhash64(F.lit(7), F.col("doc_id"))
    taken = labels.select(F.col("doc_id").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("doc_id is not null and y is not null").orderBy(order, "doc_id", "y").limit(most_labels)
    # at most most_labels narrow rows: fit to broadcast at any size of the corpus
    seen = docs.where(col(text).isNotNull()).select(col(doc_id).alias("d"), col(text).alias("text")).join(F.broadcast(taken.withColumnRenamed("doc_id", "key")), F.col("d") == F.col("key"))
    rows = seen.select((F.col("y") > 0).cast("double").alias("y"), (F.pmod(F.xxhash64(F.lit(11), "d"), F.lit(4)) == 0).cast("int").alias("held"), F.lit(0).alias("part"), "text")
    x = stage(rows.mapInArrow(_stat_rows, "y double, held int, part int, " + ", ".join(f"{c} double" for c in STATISTICS)), "labelled")
    sums = x.agg(F.count("*").alias("n"), F.sum("held").alias("h"), F.min("y").alias("lo"), F.max("y").alias("hi"), *[f(c).alias(f"{k}_{c}") for c in STATISTICS for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not sums["n"] or sums["lo"] == sums["hi"]:
        return None
    mean = np.array([sums[f"m_{c}"] for c in STATISTICS])
    scale = np.array([sums[f"s_{c}"] or 1.0 for c in STATISTICS])
    train = x if sums["h"] in (0, sums["n"]) else x.where("held = 0")

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((features + 1, features + 2))
        for batch in batches:
            m = np.column_stack([c.to_numpy() for c in batch.columns])
            z = fourier((m[:, 1:] - mean) / scale, features, width)
            total[:, :-1] += z.T @ z
            total[:, -1] += z.T @ m[:, 0]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(features + 1)), pa.array([r.tobytes() for r in total], pa.binary())], names=["r", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own[r] = own.get(r, 0) + np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([v.tobytes() for v in own.values()], pa.binary())], names=["r", "v"])

    parts = train.select("y", *STATISTICS).mapInArrow(gram, "r long, v binary").repartition("r").mapInArrow(add, "r long, v binary")
    matrix = np.zeros((features + 1, features + 2))
    for r, v in parts.collect():  # one row of the matrix each
        matrix[r] = np.frombuffer(v)
    n = matrix[-1, -2]
    weights = np.linalg.solve(matrix[:, :-1] + ridge * n * np.eye(features + 1), matrix[:, -1])
    model = Model(mean, scale, weights, np.array([0.0]), np.array([0.0]), features, width)
    held = x if sums["h"] in (0, sums["n"]) else x.where("held = 1")
    m = np.array(held.select("y", *STATISTICS).orderBy("y", *STATISTICS).collect(), float)  # part of the bounded sample
    raw = model.raw(m[:, 1:])
    least, values = pool_adjacent(raw, m[:, 0])
    at = np.unique(raw)
    greatest = at[np.append(np.searchsorted(at, least[1:]) - 1, -1)]
    model.steps, model.values = np.column_stack([least, greatest]).ravel(), values.repeat(2)
    return model


def score(docs: DataFrame, model: Model | None, name: str = "quality_score", text: str = "text") -> DataFrame:
    """``docs`` with the calibrated probability of good quality, null where the text is or where there's no model."""
    if model is None:
        return added(docs, {name: F.lit(None).cast("double")})

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        return pa.array(model.score(statistics(column)), mask=np.asarray(column.is_null()))

    return added(docs, {name: scored(col(text))})


def quality_filter(docs: DataFrame, labels: DataFrame, least: float = LEAST_QUALITY, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without the rows whose calibrated quality is below ``least``."""
    (name,) = fresh(docs, "quality_score")
    scored = score(docs, fit(docs, labels, doc_id=doc_id, text=text, **how), name, text)
    return scored.where(col(name).isNull() | (col(name) >= least)).select(*[col(c) for c in docs.columns])
