"""Analysis of text columns. Texts are analyzed where they lie: no shuffle, the model travels with the function."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from ..functions.hangul import lead_to_joining
from . import decode, select
from .lattice import Lattice
from .model import Model

_TOKEN = pa.struct([("text", pa.string()), ("pos", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
RESULT = pa.struct([("tokens", pa.list_(_TOKEN)), ("score", pa.float64())])
NBEST = pa.list_(pa.struct([("rank", pa.int32()), ("tokens", pa.list_(_TOKEN)), ("score", pa.float64())]))
ARCS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("morphemes", pa.list_(pa.struct([("form", pa.string()), ("pos", pa.string())]))), ("cost", pa.float64()), ("source", pa.string())]))
ARC_SUMS = pa.list_(pa.struct([("source", pa.string()), ("arcs", pa.int64()), ("cost", pa.float64())]))
SEARCH_TAGS = ("NNG", "NNP", "NR", "VV", "VA", "SL", "SH", "SN", "XR")
_BREAK = re.compile(r"[.!?…]+\s+(?=[가-힣A-Z\"'(\[{])|\n+")


def segments(text: str) -> Iterator[tuple[int, str]]:
    """Sentences with their places; a very long text is never one lattice."""
    at = 0
    for m in _BREAK.finditer(text):
        yield at, text[at : m.end()]
        at = m.end()
    yield at, text[at:]


def _per_text(f: Callable[[str], object], kind: pa.DataType):
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else f(t) for t in texts.to_pylist()], kind)

    return F.arrow_udf(run, from_arrow_type(kind))


class _Tokens:
    """Lists of tokens, gathered as columns: a dictionary for each token would take twenty times the memory."""

    def __init__(self):
        self.columns: tuple[list, list, list, list] = ([], [], [], [])
        self.ends, self.parts = [0], []

    def add(self, forms: list[str], tags: list[str], starts: list[int], ends: list[int], shift: int = 0) -> None:
        f, t, a, b = self.columns
        f += forms
        t += tags
        a += [x + shift for x in starts] if shift else starts
        b += [x + shift for x in ends] if shift else ends
        if len(f) >= _MOST_TOKENS:
            self._pack()

    def close(self) -> None:
        self.ends.append(sum(map(len, self.parts)) + len(self.columns[0]))

    def _pack(self) -> None:
        f, t, a, b = self.columns
        self.parts.append(pa.StructArray.from_arrays([pa.array(f, pa.string()), pa.array(t, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], fields=list(_TOKEN)))
        for x in self.columns:
            x.clear()

    def lists(self) -> pa.Array:
        self._pack()
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.concat_arrays(self.parts))


_MOST_TOKENS = 1 << 16
_MOST_KEPT = 1 << 18  # characters of the sentences whose readings a worker keeps
_SHELVES: dict[str, dict] = {}  # by column function, for the tasks that a worker runs; the last few


class Reader:
    """A reader of sentences, f(model, sentence, user, *rest), that reads one that comes again only once.

    A plain sentence is read faster than it is worth keeping.
    """

    def __init__(self, f: Callable, model: Model, user: dict, *rest):
        self.f, self.model, self.user, self.rest, self.name = f, model, user, rest, uuid.uuid4().hex

    def __call__(self, sentence: str):
        if len(sentence) > 256 or self.model.is_plain(sentence, self.user):
            return self.f(self.model, sentence, self.user, *self.rest)
        shelf = _SHELVES.get(self.name)
        if shelf is None:
            while len(_SHELVES) >= 4:
                del _SHELVES[next(iter(_SHELVES))]
            shelf = _SHELVES[self.name] = {"": 0}  # characters kept
        found = shelf.get(sentence) if sentence else None
        if found is None:
            found = self.f(self.model, sentence, self.user, *self.rest)
            if sentence:
                if shelf[""] > _MOST_KEPT:
                    shelf.clear()
                    shelf[""] = 0
                shelf[sentence] = found
                shelf[""] += len(sentence)
        return found


def _columns(cost: float, tokens: list) -> decode.Columns:
    return cost, [t.text for t in tokens], [t.pos for t in tokens], [t.start for t in tokens], [t.end for t in tokens]


def best(model: Model, sentence: str, user: dict, choose: Callable) -> decode.Columns:
    if sentence.strip() and model.is_plain(sentence, user):
        return decode.plain(model, sentence)
    return _columns(*choose(model, sentence, user))


def _n_best(model: Model, text: str, user: dict, k: int) -> list[decode.Columns]:
    if k > 0 and text.strip() and model.is_plain(text, user):
        return [decode.plain(model, text)]
    return [_columns(c, select.finish(x, model)) for c, x in decode.n_best(model, text, k, user)]


class Analyzer:
    """Functions from text columns to analyses, for one model and user dictionary."""

    def __init__(self, model: Model, user_words: dict[str, tuple[str, int]] | None = None):
        self.model, self.user = model, dict(user_words or {})

    def with_user_words(self, words: dict[str, tuple[str, int]]) -> Analyzer:
        return Analyzer(self.model, self.user | words)

    def _whole(self, choose: Callable, text: Column) -> Column:
        read = Reader(best, self.model, self.user, choose)

        def run(texts: pa.Array) -> pa.Array:
            tokens, scores, none = _Tokens(), [], []
            for t in texts.to_pylist():
                score = 0.0
                if t is not None:
                    for at, sentence in segments(t):
                        cost, *columns = read(sentence)
                        tokens.add(*columns, at)
                        score += cost
                tokens.close()
                scores.append(score)
                none.append(t is None)
            return pa.StructArray.from_arrays([tokens.lists(), pa.array(scores, pa.float64())], fields=list(RESULT), mask=pa.array(none, pa.bool_()))

        return F.arrow_udf(run, from_arrow_type(RESULT))(text)

    def analyze(self, text: Column, joining: bool = False) -> Column:
        """The chosen analysis of each text, sentence by sentence; with conjoining letters where asked."""
        out = self._whole(select.analyze, text)
        if not joining:
            return out
        lead = lambda t: t.withField("text", F.when(t["pos"].isin("ETM", "EC", "EF", "EP", "JKO", "JX"), lead_to_joining(t["text"])).otherwise(t["text"]))
        return out.withField("tokens", F.transform(out["tokens"], lead))

    def single_best(self, text: Column) -> Column:
        return self._whole(decode.single, text)

    def token_counts(self, df: DataFrame, text: str) -> DataFrame:
        """(pos, text, n): tokens of the texts as ``analyze`` has them, added up by batch, to be summed.

        Only sums leave the worker, so neither it nor the JVM holds the tokens of a batch of long texts.
        """
        read = Reader(best, self.model, self.user, select.analyze)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()

            def rows() -> pa.RecordBatch:
                keys = list(found)
                out = pa.RecordBatch.from_arrays([pa.array([p for _, p in keys], pa.string()), pa.array([f for f, _ in keys], pa.string()), pa.array(list(found.values()), pa.int64())], ["pos", "text", "n"])
                found.clear()
                return out

            for batch in batches:
                for t in batch.column(0):
                    for _, sentence in segments(t.as_py() or ""):
                        _, forms, tags, _, _ = read(sentence)
                        found.update(zip(forms, tags))
                    if len(found) >= _MOST_TOKENS:
                        yield rows()
            yield rows()

        return df.select(text).mapInArrow(run, "pos string, text string, n bigint")

    def n_best(self, text: Column, k: int = 5) -> Column:
        """Candidates of each text taken as one sentence, cheapest first."""
        read = Reader(_n_best, self.model, self.user, k)

        def run(texts: pa.Array) -> pa.Array:
            tokens, ranks, scores, ends, none = _Tokens(), [], [], [0], []
            for t in texts.to_pylist():
                if t is not None:
                    for rank, (cost, *columns) in enumerate(read(t)):
                        tokens.add(*columns)
                        tokens.close()
                        ranks.append(rank + 1)
                        scores.append(cost)
                ends.append(len(ranks))
                none.append(t is None)
            rows = pa.StructArray.from_arrays([pa.array(ranks, pa.int32()), tokens.lists(), pa.array(scores, pa.float64())], fields=list(NBEST.value_type))
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, mask=pa.array(none, pa.bool_()))

        return F.arrow_udf(run, from_arrow_type(NBEST))(text)

    def arcs(self, text: Column) -> Column:
        model, user = self.model, self.user

        def f(t: str) -> list[dict]:
            found = sorted(Lattice(model, t, user).arcs(), key=lambda a: (a.start, a.end, a.cost, a.morphemes))
            return [{"start": a.start, "end": a.end, "morphemes": [{"form": x, "pos": p} for x, p in a.morphemes], "cost": a.cost, "source": a.source} for a in found]

        return _per_text(f, ARCS)(text)

    def arc_sums(self, text: Column) -> Column:
        """array<struct<source, arcs, cost>>: how many arcs of each kind ``arcs`` has, and the sum of their costs."""
        model, user = self.model, self.user
        f = lambda t: [{"source": s, "arcs": n, "cost": c} for s, (n, c) in decode.arc_sums(model, t, user).items()]
        return _per_text(f, ARC_SUMS)(text)


def surfaces(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: t["text"])


def nouns(tokens: Column, latin: bool = False) -> Column:
    return surfaces(F.filter(tokens, lambda t: t["pos"].isin("NNG", "NNP", *(["SL"] if latin else []))))


def search_terms(tokens: Column, tags: tuple[str, ...] = SEARCH_TAGS, stop: tuple[str, ...] = (), lower: bool = True) -> Column:
    """Terms for a search index: chosen tags, lower case, then without stop words; repeats stay."""
    terms = surfaces(F.filter(tokens, lambda t: t["pos"].isin(*tags)))
    terms = F.transform(terms, F.lower) if lower else terms
    return F.filter(terms, lambda x: ~x.isin(*stop)) if stop else terms


def search_term(term: Column, stop: tuple[str, ...] = (), lower: bool = True) -> Column:
    """One query term, null for a stop word."""
    t = F.lower(term) if lower else term
    return F.when(~t.isin(*stop), t) if stop else t


def token_rows(df: DataFrame, key: str, analysis: str) -> DataFrame:
    return df.select(key, F.posexplode(F.col(analysis)["tokens"]).alias("idx", "t")).select(key, "idx", "t.text", "t.pos", "t.start", "t.end")
