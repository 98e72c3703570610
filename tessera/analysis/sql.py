"""The analyzer as SQL functions, and analyzers by name.

``register`` gives a session ko_tokens, ko_nouns, ko_terms and ko_score over text columns, and ko_arcs as a table
function to be used with LATERAL. ``analyzers`` are functions from a text column to an array<struct<text, pos>>; one
that fails gives an empty reading.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import select
from .api import SEARCH_TAGS, Analyzer, Reader, best
from .lattice import Lattice
from .model import Model

READING = "array<struct<text:string,pos:string>>"
_READING = pa.list_(pa.struct([("text", pa.string()), ("pos", pa.string())]))


def safe(f: Callable[[str], list[tuple[str, str]]]) -> Callable[[Column], Column]:
    """A column function of an analyzer that reads one text; an exception, and a null text, is an empty reading."""

    def one(text: str | None) -> list[dict]:
        try:
            return [] if text is None else [{"text": a, "pos": b} for a, b in f(text)]
        except Exception:  # any analyzer's failure counts as no reading
            return []

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([one(t) for t in texts.to_pylist()], _READING)

    return F.arrow_udf(run, READING)


def own(model: Model) -> Callable[[Column], Column]:
    analyzer = Analyzer(model)
    return lambda text: F.transform(F.coalesce(analyzer.analyze(text)["tokens"], F.array().cast(READING.replace("text:string,pos:string", "text:string,pos:string,start:int,end:int"))), lambda t: F.struct(t["text"].alias("text"), t["pos"].alias("pos")))


def given(column: str) -> Callable[[Column], Column]:
    """Readings that another program made beforehand, in a column of the same rows."""
    return lambda text: F.coalesce(F.col(column), F.array().cast(READING))


class Tokenizer:
    """Terms of documents and queries, made alike; ``info`` tells the model's size, ``close`` lets go of it."""

    def __init__(self, model: Model, tags: tuple[str, ...] = SEARCH_TAGS, stop: tuple[str, ...] = (), lower: bool = True):
        self.model: Model | None = model
        self.tags, self.stop, self.lower = tags, stop, lower

    @property
    def loaded(self) -> bool:
        return self.model is not None

    def info(self) -> dict[str, int]:
        if self.model is None:
            raise RuntimeError("the tokenizer is closed")
        return {"words": len(self.model.words), "suffixes": len(self.model.suffixes), "cache": len(self.model.cache), "weights": len(self.model.weights)}

    def terms(self, text: Column) -> Column:
        from .api import search_terms

        if self.model is None:
            raise RuntimeError("the tokenizer is closed")
        return search_terms(Analyzer(self.model).analyze(text)["tokens"], self.tags, self.stop, self.lower)

    def close(self) -> None:
        self.model = None


def register(spark: SparkSession, model: Model, prefix: str = "ko_") -> None:
    from pyspark.sql.functions import udtf

    read = Reader(best, model, {}, select.analyze)

    def over(f: Callable[[tuple], object], kind: pa.DataType) -> Callable[[pa.Array], pa.Array]:
        def run(texts: pa.Array) -> pa.Array:
            return pa.array([None if t is None else f(read(t)) for t in texts.to_pylist()], kind)

        return run

    kinds = {
        "tokens": (lambda a: [{"text": x, "pos": p} for x, p in zip(a[1], a[2])], _READING, READING),
        "nouns": (lambda a: [x for x, p in zip(a[1], a[2]) if p in ("NNG", "NNP")], pa.list_(pa.string()), "array<string>"),
        "terms": (lambda a: [x.lower() for x, p in zip(a[1], a[2]) if p in SEARCH_TAGS], pa.list_(pa.string()), "array<string>"),
        "score": (lambda a: float(a[0]), pa.float64(), "double"),
    }
    for name, (f, arrow, kind) in kinds.items():
        spark.udf.register(prefix + name, F.arrow_udf(over(f, arrow), kind))

    class Arcs:
        def eval(self, text: str) -> Iterator[tuple]:
            for a in Lattice(model, text or "", {}).arcs():
                yield a.start, a.end, " ".join(f"{f}/{p}" for f, p in a.morphemes), float(a.cost), a.source

    spark.udtf.register(prefix + "arcs", udtf(Arcs, returnType="start int, end int, reading string, cost double, source string"))
