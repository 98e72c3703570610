"""Model tables. They are small next to any corpus; a task gets them as one value and looks words up in memory.

On disk a model is a folder of Parquet tables, one per field; texts never move for the sake of the model.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..schema import CONTENT, TAGS

BOS = 255
IDS = {t: k for k, t in enumerate(TAGS)}
Morphemes = tuple[tuple[str, str], ...]

_TABLES = {
    "content_dict": "surface string, pos string, freq bigint, rank int",
    "suffix_codebook": "surface string, morphemes array<struct<form:string,pos:string>>, freq bigint",
    "trigram": "p1 string, p2 string, p3 string, cost double",
    "bigram": "p1 string, p2 string, cost double",
    "word_bigram": "form string, prev_pos string, target_pos string, bonus double, seq int",
    "eojeol_cache": "surface string, morphemes array<struct<form:string,pos:string>>",
    "ambiguity": "surface string, pos string, freq bigint",
    "rerank_weight": "bucket int, weight double",
    "params": "name string, value double",
}


@dataclass
class Model:
    words: dict[str, list[tuple[str, int]]] = field(default_factory=dict)
    suffixes: dict[str, list[tuple[Morphemes, int]]] = field(default_factory=dict)
    trigrams: dict[tuple[str, str, str], float] = field(default_factory=dict)
    bigrams: dict[tuple[str, str], float] = field(default_factory=dict)
    word_bigrams: dict[str, list[tuple[str, str, float]]] = field(default_factory=dict)
    cache: dict[str, Morphemes] = field(default_factory=dict)
    ambiguity: dict[str, list[tuple[str, int]]] = field(default_factory=dict)
    weights: dict[int, float] = field(default_factory=dict)
    params: dict[str, float] = field(default_factory=dict)
    hints: frozenset[str] = frozenset()
    adjective_roots: frozenset[str] = frozenset()

    def __post_init__(self):
        p = {"default_cost": 8.0, "morpheme_penalty": 0.25, "oov_penalty": 4.75, "length_bonus": 1.5, "single_penalty": 3.5, "rerank_margin": 4.0} | self.params
        self.default, self.penalty, self.oov, self.bonus, self.single, self.margin = (float(p[k]) for k in ("default_cost", "morpheme_penalty", "oov_penalty", "length_bonus", "single_penalty", "rerank_margin"))
        self.max_freq = float(p.get("max_freq") or max((f for e in self.words.values() for _, f in e), default=1))
        self.max_suffix_freq = float(p.get("max_suffix_freq") or max((f for e in self.suffixes.values() for _, f in e), default=1))
        self.longest_word = max(map(len, self.words), default=0)
        # readings whose content part is longer than their key can't come from it
        fits = lambda key, ms: sum(len(f) for f, p in _before_function(ms)) <= len(key)
        self.suffixes = {k: kept for k, e in self.suffixes.items() if (kept := [a for a in e if fits(k, a[0])])}
        self.first = frozenset(w[0] for t in (self.words, self.suffixes) for w in t if w and not w[0].isspace())
        self.longest_suffix = max(map(len, self.suffixes), default=0)
        #: Characters at which anything but a run or a lone character can begin.
        self.begins = re.compile("[가-힣" + "".join(re.escape(c) for c in sorted(self.first | {w[0] for w in self.cache if w})) + "]")
        self.seen: dict = {}  # what ``decode.plain`` keeps of words, and of the costs of transitions between them
        self.moves: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"seen": {}, "moves": {}}

    def is_plain(self, text: str, user: dict | None = None) -> bool:
        """Whether a text has a single path, of runs and lone characters."""
        return not self.begins.search(text) and not (user and any(w in text for w in user))

    def transition(self, a: str, b: str, c: str) -> float:
        """Cost of tag c after a, b; BOS and EOS are no tags of the tables."""
        if b not in IDS or c not in IDS:
            return self.default
        if a in IDS and (t := self.trigrams.get((a, b, c), 0.0)):
            return t
        return (self.bigrams.get((b, c), 0.0) or self.default) + 2.0

    def word_cost(self, surface: str, pos: str, freq: int) -> float:
        if freq <= 0:
            return self.oov
        cost, n = math.log(self.max_freq / freq), len(surface)
        return cost - self.bonus * (n - 1) if n > 1 else cost + self.single if pos in CONTENT else cost

    def bare_cost(self, freq: int) -> float:
        return math.log(self.max_freq / freq) if freq > 0 else self.oov

    def suffix_cost(self, key: str, morphemes: Morphemes, freq: int) -> float:
        return math.log(self.max_suffix_freq / max(freq, 1)) + self.penalty * len(morphemes) - self.bonus * (len(key) - 1 if len(key) > 1 else 0)

    @staticmethod
    def from_tables(t: dict[str, list]) -> Model:
        m: dict = {k: {} for k in ("words", "suffixes", "word_bigrams", "ambiguity")}
        for surface, pos, freq, _ in sorted(t.get("content_dict", []), key=lambda r: r[3]):
            m["words"].setdefault(surface, []).append((pos, freq))
        for surface, ms, freq in t.get("suffix_codebook", []):
            m["suffixes"].setdefault(surface, []).append((tuple((x[0], x[1]) for x in ms), freq))
        for form, prev, target, bonus, _ in sorted(t.get("word_bigram", []), key=lambda r: r[4]):
            m["word_bigrams"].setdefault(form, []).append((prev, target, bonus))
        for surface, pos, freq in t.get("ambiguity", []):
            m["ambiguity"].setdefault(surface, []).append((pos, freq))
        return Model(
            **m, trigrams={(a, b, c): x for a, b, c, x in t.get("trigram", [])}, bigrams={(a, b): x for a, b, x in t.get("bigram", [])},
            cache={s: tuple((x[0], x[1]) for x in ms) for s, ms in t.get("eojeol_cache", [])}, weights=dict(map(tuple, t.get("rerank_weight", []))), params=dict(map(tuple, t.get("params", []))),
        )

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        return Model.from_tables({name: [tuple(r) for r in spark.read.schema(kind).parquet(f"{path}/{name}").collect()] for name, kind in _TABLES.items()})

    def tables(self) -> dict[str, list]:
        return {
            "content_dict": [(s, p, f, k + 1) for s, e in self.words.items() for k, (p, f) in enumerate(e)],
            "suffix_codebook": [(s, list(ms), f) for s, e in self.suffixes.items() for ms, f in e],
            "trigram": [(*k, c) for k, c in self.trigrams.items()],
            "bigram": [(*k, c) for k, c in self.bigrams.items()],
            "word_bigram": [(s, p, t, b, k) for s, e in self.word_bigrams.items() for k, (p, t, b) in enumerate(e)],
            "eojeol_cache": [(s, list(ms)) for s, ms in self.cache.items()],
            "ambiguity": [(s, p, f) for s, e in self.ambiguity.items() for p, f in e],
            "rerank_weight": list(self.weights.items()),
            "params": [(k, float(v)) for k, v in {"default_cost": self.default, "morpheme_penalty": self.penalty, "oov_penalty": self.oov, "length_bonus": self.bonus, "single_penalty": self.single, "rerank_margin": self.margin, "max_freq": self.max_freq, "max_suffix_freq": self.max_suffix_freq}.items()],
        }

    def save(self, spark: SparkSession, path: str) -> None:
        for name, rows in self.tables().items():
            spark.createDataFrame(rows, _TABLES[name]).coalesce(1).write.mode("errorifexists").parquet(f"{path}/{name}")


def _before_function(ms: Morphemes) -> list[tuple[str, str]]:
    out = []
    for m in ms:
        if m[1].startswith(("J", "E")):
            break
        out.append(m)
    return out


def user_words(rows: DataFrame) -> dict[str, tuple[str, int]]:
    """User words from (surface, pos, freq, seq): the last of a surface wins; no frequency means 5000, and it is at least 1."""
    out: dict[str, tuple[str, int]] = {}
    for surface, pos, freq, _ in sorted(((r.surface, r.pos, r.freq, r.seq) for r in rows.collect()), key=lambda r: r[3]):
        if pos not in IDS:
            raise ValueError(f"unknown part of speech {pos!r}")
        if surface:
            out[surface] = (pos, max(1, 5000 if freq is None else freq))
    return out
