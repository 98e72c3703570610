"""The reranker's averaged perceptron.

Candidates come as a table (sentence, rank, buckets, values, tp, fp, fn); Spark makes it, and at most ``most`` sentences
of it, in the order of a hash, reach the driver, for the updates are sequential. Only sentences whose candidates differ
in F1 teach anything. After each epoch the averaged weights pick on the dev sentences; the first best epoch stays.

Defined cases: no candidates, or none that differ, give no weights; ties in score or F1 go to the lesser rank.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST, EPOCHS = 200_000, 8


@dataclass
class Sentence:
    ids: list[np.ndarray]
    values: list[np.ndarray]
    counts: np.ndarray

    @property
    def f1(self) -> np.ndarray:
        tp, fp, fn = self.counts.T
        return 2 * tp / np.maximum(2 * tp + fp + fn, 1)

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.array([w[i] @ v for i, v in zip(self.ids, self.values)])


def gathered(candidates: DataFrame, sentence: str, most: int = MOST) -> list[Sentence]:
    """The sample's sentences, in the order of the hash, candidates by rank."""
    keys = candidates.select(sentence).distinct().orderBy(F.xxhash64(F.lit(42), sentence), sentence).limit(most)
    own = F.array_sort(F.collect_list(F.struct("rank", "buckets", "values", "tp", "fp", "fn"))).alias("c")
    rows = candidates.join(keys, sentence, "left_semi").groupBy(sentence).agg(own).orderBy(F.xxhash64(F.lit(42), sentence), sentence).select("c").collect()
    return [Sentence([np.array(c.buckets, np.int64) for c in r.c], [np.array(c["values"], float) for c in r.c], np.array([(c.tp, c.fp, c.fn) for c in r.c], float)) for r in rows]


def evaluated(sentences: list[Sentence], w: np.ndarray) -> dict[str, float]:
    """F1 over all sentences of the picked, the first and the best candidates."""
    picks = {"pick": lambda s: int(np.argmax(s.scores(w))), "first": lambda s: 0, "oracle": lambda s: int(np.argmax(s.f1))}
    out = {}
    for name, f in picks.items():
        tp, fp, fn = sum((s.counts[f(s)] for s in sentences), np.zeros(3))
        out[name] = float(2 * tp / max(2 * tp + fp + fn, 1))
    return out


def train(sentences: list[Sentence], dev: list[Sentence], size: int = 1 << 20, epochs: int = EPOCHS, seed: int = 42) -> tuple[dict[int, float], list[dict[str, float]]]:
    """(weights other than 0, scores of each epoch)."""
    useful = [s for s in sentences if len(s.ids) > 1 and np.ptp(s.f1) > 1e-9]
    w, late, step, best, kept, log = np.zeros(size), np.zeros(size), 0, -1.0, None, []
    rng = np.random.default_rng(seed)
    for _ in range(epochs if useful else 0):
        for k in rng.permutation(len(useful)):
            s = useful[k]
            step += 1
            pick, goal = int(np.argmax(s.scores(w))), int(np.argmax(s.f1))
            if s.f1[pick] < s.f1[goal] - 1e-9:
                for at, sign in ((goal, 1.0), (pick, -1.0)):
                    np.add.at(w, s.ids[at], sign * s.values[at])
                    np.add.at(late, s.ids[at], step * sign * s.values[at])
        mean = (w - late / step).astype(np.float32)
        log.append(evaluated(dev, mean))
        if log[-1]["pick"] > best:
            best, kept = log[-1]["pick"], mean
    return ({} if kept is None else {int(k): float(kept[k]) for k in np.flatnonzero(kept)}), log
