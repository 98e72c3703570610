"""Toxicity by compression distance (operator 6).

Two zstandard dictionaries are made: one trained on ordinary labelled text, and the same followed by what sets toxic
texts apart. A window is one word with its blanks (lower case), set in a fixed frame that both dictionaries end with,
for zstandard matches nothing in the last eight bytes of a block. A window's gain is its compressed length with the
ordinary dictionary less that with the toxic one; a text is toxic when enough of its windows gain enough, by one of two
rules. All limits
are calibrated on labelled texts that the dictionaries haven't seen. As most of a toxic text is ordinary prose, the
telling part holds words and beginnings of words (4 to 16 characters) that more toxic than ordinary texts have, at
all or three times, with a log-likelihood ratio of at least ``contrast`` and four times as often: an absolute test of
each, so that a rare language's words aren't held against a frequent one's, and words that only the mix of languages or
lengths makes more frequent don't pass. Ordinary text with such words stays out of the ordinary
dictionary. Windows wider than a word were tried: the chance matches of ordinary words outweigh the few bytes that a
toxic word saves.

The fit uses at most ``most_toxic`` and ``most_ordinary`` labelled texts and ``most_bytes`` of each class, in the order
of a hash of doc_id, of which texts of more than an eighth of these bytes are passed over; of the telling part, what
goes beyond 16 KB, the weakest, is left out. Every text is scored, whole.

Defined cases: labels whose doc_id or toxic is null, and those without a document, aren't used; a null text has a
null verdict; an empty one isn't toxic; repeated rows score alike; without texts of both classes all verdicts are
null; extra columns pass through, and those that have the names of new ones stay, the new names getting underscores
before them; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import SPACE, chunks, text_buffers
from .common import added, col, fresh

MOST_TOXIC, MOST_ORDINARY, MOST_BYTES, CONTRAST = 1500, 3000, 16 << 20, 24.0
# the level and the least match are such that a dictionary is searched at every position: lower levels index each third
ORDINARY_BYTES, TOXIC_BYTES, LEVEL = 16_384, 4096, 6
_BEFORE, _AFTER = b"the quick window opens here: ", b"\nand closes here."
_MOST_WORDS = 300_000
_SHORTEST, _LONGEST, _TIMES, _RATIO = 4, 16, (1, 3), 4
_BLANKS = np.where(SPACE, 32, np.arange(256)).astype(np.uint8)


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    #: A text is toxic by any of them: so many windows, and such a share of them, gain so many bytes.
    rules: tuple[tuple[int, int, float], ...] = ((1, 1, 0.0),)
    _tools: tuple | None = field(default=None, repr=False, compare=False)
    _known: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return self.ordinary, self.toxic, self.rules

    def __setstate__(self, state):
        self.__init__(*state)

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        if self._tools is None:
            made = []
            for content in (self.ordinary, self.toxic):
                how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=64, dict_size=2 * ORDINARY_BYTES, min_match=5, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
                d = zstandard.ZstdCompressionDict(content + _AFTER + _BEFORE, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=how)
                made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))
            self._tools = tuple(made)
        return self._tools

    def gains(self, windows: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window, kept for words met again."""
        known = self._known
        if len(known) > _MOST_WORDS:
            known.clear()
        ordinary, toxic = (c.compress for c in self.compressors())
        out = np.empty(len(windows), np.int32)
        for k, w in enumerate(windows):
            g = known.get(w)
            if g is None:
                framed = _BEFORE + b" " + w + _AFTER
                g = known[w] = len(ordinary(framed)) - len(toxic(framed))
            out[k] = g
        return out

    def windows(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gain of every window, and where each text's windows begin."""
        body = _BLANKS[body]
        blank = body == 32
        head = ~blank
        head[1:] &= blank[:-1]
        first = at[:-1][(np.diff(at) > 0)]
        head[first] = ~blank[first]
        starts = np.flatnonzero(head)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        # a window runs to the next word's begin; a text's end closes its last one
        offsets = np.concatenate([starts, [len(body)]]).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))]).dictionary_encode()
        gains = self.gains([w.rstrip(b" ") + b" " for w in words.dictionary.to_pylist()])
        return gains[words.indices.to_numpy()], np.searchsorted(starts, at)

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the windows that gain enough, by rule, and all windows."""
        body, at = text_buffers(column)
        hits, total = np.zeros((len(self.rules), len(at) - 1), np.int64), np.zeros(len(at) - 1, np.int64)
        for lo, hi in chunks(at, 8 << 20):
            g, cut = self.windows(body[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            for k, (gain, _, _) in enumerate(self.rules):
                hits[k, lo:hi] = np.diff(np.concatenate([[0], np.cumsum(g >= gain)])[cut])
            total[lo:hi] = np.diff(cut)
        return hits, total

    def verdicts(self, hits: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.any([(h >= least) & (h >= rate * total) for h, (_, least, rate) in zip(hits, self.rules)], axis=0)


def beginnings(text: str) -> set[tuple[str, int]]:
    """Its words, each closed by a blank, and their beginnings of 4 to 16 characters; with the 3, once more if it has them three times."""
    n = Counter()
    for w, c in Counter(text.split()).items():
        n[w + " "] += c
        for k in range(_SHORTEST, min(len(w), _LONGEST) + 1):
            n[w[:k]] += c
    return {(w, least) for w, c in n.items() for least in _TIMES if c >= least}


def evidence(p: int, n: int, q: int, m: int) -> float:
    """Log-likelihood ratio (G squared) of p of n against q of m documents; 0 unless the first share is greater."""
    if p * m <= q * n:
        return 0.0
    return 2 * sum(x * math.log(x * (n + m) / (side * both)) for x, side, both in ((p, n, p + q), (n - p, n, n + m - p - q), (q, m, p + q), (m - q, m, n + m - p - q)) if x)


def contrast_terms(toxic: list[str], ordinary: list[str], contrast: float = CONTRAST) -> list[str]:
    """Words and beginnings of words that set toxic texts apart, the strongest first.

    Each is tested by itself, so the words of a rare language needn't match the best word of a frequent one.
    """
    n, m = len(toxic), len(ordinary)
    p = {x: c for x, c in Counter(x for t in toxic for x in beginnings(t)).items() if evidence(c, n, 0, m) >= contrast}
    q = Counter(x for t in ordinary for x in beginnings(t) if x in p)
    score: dict[str, float] = {}
    for x, c in p.items():
        if (s := evidence(c, n, q[x], m)) >= contrast and c * m >= _RATIO * q[x] * n:
            score[x[0]] = max(s, score.get(x[0], 0.0))
    kept: dict[str, None] = {}
    # of equals the longest: the shorter ones say the same with fewer bytes to match
    for w in sorted(score, key=lambda w: (-score[w], -len(w), w)):
        same = next((k for k in kept if k.startswith(w) and score[k] == score[w]), None)
        if same is None and not any(w[:k] in kept for k in range(_SHORTEST, len(w))):
            kept[w] = None
    return list(kept)


def pieces(text: str) -> Iterator[bytes]:
    """All of a text, 64 characters each from a word's begin unless that lies far back."""
    t = " " + " ".join(text.split())
    for i in range(0, max(1, len(t)), 64):
        at = t.rfind(" ", max(0, i - 64), i + 1)
        at = i if at < 0 else at
        yield t[at : at + 64].encode()


def train(toxic: list[str], ordinary: list[str], contrast: float = CONTRAST) -> tuple[bytes, bytes]:
    """Contents of the two dictionaries."""

    def dictionary(samples: list[bytes], size: int) -> bytes:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:  # too few samples to train on: they are the dictionary
            return b"".join(dict.fromkeys(samples))[-size:]

    terms = contrast_terms(toxic, ordinary, contrast)
    known = set(terms)
    plain = [b for t in ordinary for b in pieces(t)]
    # ordinary texts hold a few telling words too; in their dictionary, these would hide the gain
    mark = re.compile(r"(?<!\S)(?:" + "|".join(re.escape(w.rstrip()) + (r"(?!\S)" if w[-1] == " " else "") for w in terms) + ")") if terms else None
    if mark:
        plain = [b for b in plain if not mark.search(b.decode())] or plain
    telling = [f" {w}".encode() for t in toxic for w, _ in sorted(beginnings(t)) if w in known]
    # every telling word must be in the dictionary, so the trained content is followed by what it left out
    trained = dictionary(telling * 3, TOXIC_BYTES)
    rest = b"".join(f" {w}".encode() for w in terms if f" {w}".encode() not in trained)[:ORDINARY_BYTES]
    base = dictionary(plain, ORDINARY_BYTES)
    # what both hold costs the same with both, so only telling bytes can gain
    return base, base + trained + rest


def calibrate(model: Model, toxic: list[str], ordinary: list[str]) -> Model:
    """The rule with the greatest recall less three times the false alarms, of equals the strictest; and a second one
    if it adds to that: few windows that gain much tell as well as many that gain less."""
    truth = np.array([True] * len(toxic) + [False] * len(ordinary))
    column = pa.array([*toxic, *ordinary])
    body, at = text_buffers(column)
    g, cut = model.windows(body, at)
    total, rules, found = np.diff(cut), [], []
    for gain in range(1, 25):
        hits = np.diff(np.concatenate([[0], np.cumsum(g >= gain)])[cut])
        for least in range(1, 9):
            for rate in (0.0, 0.001, 0.002, 0.004, 0.006, 0.008, 0.01, 0.012, 0.016, 0.024, 0.032):
                rules.append((gain, least, rate))
                found.append((hits >= least) & (hits >= rate * total))
    by_rule, chosen, now, best = np.array(found), (), np.zeros(len(truth), bool), -np.inf
    for _ in range(2):
        either = by_rule | now
        # a false alarm weighs more than a miss: clean text is the rule
        value = either[:, truth].mean(axis=1) - 3 * either[:, ~truth].mean(axis=1)
        k = int(np.flatnonzero(value >= value.max() - 1e-12)[-1])
        if value[k] <= best + (0.005 if chosen else 0):
            break
        chosen, now, best = (*chosen, rules[k]), either[k], value[k]
    model.rules = chosen
    return model


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_ordinary: int = MOST_ORDINARY, most_bytes: int = MOST_BYTES, contrast: float = CONTRAST, doc_id: str = "doc_id", text: str = "text") -> Model | None:
    """The calibrated model, or None without texts of both classes."""
    known = labels.select(F.col("doc_id").alias("key"), (F.col("toxic") > 0).alias("toxic"), F.xxhash64(F.lit(3), "doc_id").alias("o")).where("key is not null and toxic is not null").distinct()
    taken = [known.where("toxic").orderBy("o", "key").limit(most_toxic), known.where("not toxic").orderBy("o", "key").limit(most_ordinary)]
    # at most most_toxic + most_ordinary narrow rows: fit to broadcast at any size of the corpus
    seen = docs.where(col(text).isNotNull()).select(col(doc_id).alias("d"), F.lower(col(text)).alias("text")).join(F.broadcast(taken[0].union(taken[1])), F.col("d") == F.col("key"))
    size = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("toxic").orderBy("o", "key", "text").rowsBetween(Window.unboundedPreceding, 0))
    # a text too long for the sample isn't to crowd out those after it
    seen = seen.where(F.octet_length("text") <= most_bytes // 8)
    rows = seen.withColumn("size", size).where(F.col("size") <= most_bytes).select("toxic", F.pmod("o", F.lit(5)).alias("part"), "text").orderBy("toxic", "o", "key", "text").collect()
    sets = {(t, held): [r.text for r in rows if r.toxic == t and (r.part < 2) == held] for t in (True, False) for held in (True, False)}
    if not sets[True, False] or not sets[False, False]:
        if not any(r.toxic for r in rows) or all(r.toxic for r in rows):
            return None
        sets = {(t, held): [r.text for r in rows if r.toxic == t] for t in (True, False) for held in (True, False)}
    ordinary, toxic = train(sets[True, False], sets[False, False], contrast)
    return calibrate(Model(ordinary, toxic), sets[True, True] or sets[True, False], sets[False, True] or sets[False, False])


def classify(docs: DataFrame, model: Model | None, text: str = "text", verdict: str = "toxic", hits: str = "toxic_windows", windows: str = "windows") -> DataFrame:
    """``docs`` with the number of telling windows (0 in a text that isn't toxic), of all windows, and the verdict."""
    if model is None:
        return added(docs, {hits: F.lit(None).cast("long"), windows: F.lit(None).cast("long"), verdict: F.lit(None).cast("boolean")})

    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            found, total = model.counts(column)
            missing, verdicts = np.asarray(column.is_null()), model.verdicts(found, total)
            yield pa.StructArray.from_arrays([pa.array(found.max(axis=0) * verdicts, mask=missing), pa.array(total, mask=missing), pa.array(verdicts, mask=missing)], names=["h", "n", "v"])

    (own,) = fresh(docs, "scored")
    out = docs.withColumn(own, F.arrow_udf(scored, "h long, n long, v boolean")(F.lower(col(text))))
    return added(out, {hits: col(own)["h"], windows: col(own)["n"], verdict: col(own)["v"]}).drop(col(own))
