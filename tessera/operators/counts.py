"""Counting operators: n-grams, words, majority readings, ambiguity, dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..schema import TAGS


def tag_ngrams(tokens: DataFrame, sentence: str, order: str, pos: str) -> DataFrame:
    """(p1, p2, p3, n): counts of tag triples, each sentence with two BOS before and one EOS after.

    One shuffle by sentence for the neighbours, one (with map-side sums) for the counts.
    """
    w = Window.partitionBy(sentence).orderBy(order)
    inside = tokens.select(
        F.coalesce(F.lag(pos, 2).over(w), F.lit("BOS")).alias("p1"), F.coalesce(F.lag(pos, 1).over(w), F.lit("BOS")).alias("p2"), F.col(pos).alias("p3"), F.lead(pos).over(w).isNull().alias("last")
    )
    both = inside.select(F.explode(F.when(F.col("last"), F.array(F.struct("p1", "p2", "p3"), F.struct(F.col("p2").alias("p1"), F.col("p3").alias("p2"), F.lit("EOS").alias("p3")))).otherwise(F.array(F.struct("p1", "p2", "p3")))).alias("g"))
    return both.groupBy("g.p1", "g.p2", "g.p3").agg(F.count("*").alias("n"))


def ngram_costs(grams: DataFrame, alpha: float = 0.01, n_tags: int = len(TAGS)) -> DataFrame:
    """(p1, p2, p3, n, cost): smoothed negative logs, a trigram given its first two tags, a bigram (p3 null) out of all.

    Grams with BOS or EOS are left out of the tables; those that go on to EOS do count for their first two tags.
    """
    inner = F.col("p1") != "BOS"
    both = grams.where(inner & (F.col("p2") != "BOS")).select("p1", "p2", "p3", "n", F.sum("n").over(Window.partitionBy("p1", "p2")).alias("total"))
    three = both.where("p3 <> 'EOS'").select("p1", "p2", "p3", "n", (F.col("n") + alpha) / (F.col("total") + alpha * n_tags))
    two = grams.where("p2 <> 'BOS' and p3 <> 'EOS'").groupBy(F.col("p2").alias("p1"), F.col("p3").alias("p2")).agg(F.sum("n").alias("n"))
    total = F.broadcast(two.agg(F.sum("n").alias("total")))
    two = two.crossJoin(total).select("p1", "p2", F.lit(None).cast("string").alias("p3"), "n", (F.col("n") + alpha) / (F.col("total") + alpha * n_tags))
    costs = three.toDF("p1", "p2", "p3", "n", "p").union(two.toDF("p1", "p2", "p3", "n", "p"))
    return costs.select("p1", "p2", "p3", "n", F.round(-F.log(F.greatest("p", F.lit(1e-10))), 4).alias("cost"))


def suffix_patterns(tokens: DataFrame, sentence: str, order: str, form: str, functional: Column, content: Column, longest: int = 10) -> DataFrame:
    """(surface, kind, n): how often functional morphemes occur alone, as maximal runs, as beginnings of the runs after a
    content word, and as such a word with its run, of at most ``longest`` characters.

    Runs are numbered by one window over the sentence; a row then knows its run and whether a content word leads it.
    """
    w = Window.partitionBy(sentence).orderBy(order)
    marked = tokens.select(sentence, order, form, functional.alias("_f"), content.alias("_c"))
    first = F.col("_f") & ~F.coalesce(F.lag("_f").over(w), F.lit(False))
    marked = marked.withColumns({"_run": F.sum(F.when(first, 1).otherwise(0)).over(w), "_lead": F.when(first & F.lag("_c").over(w), F.lag(form).over(w))})
    runs = marked.where("_f").groupBy(sentence, "_run").agg(F.array_sort(F.collect_list(F.struct(order, form))).alias("m"), F.max("_lead").alias("lead"))
    forms = runs.select("lead", F.transform("m", lambda x: x[form]).alias("m"))
    joined = lambda x: F.array_join(x, "")
    row = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("surface"))
    single = F.transform("m", lambda x: row("single", x))
    prefixes = F.when(F.col("lead").isNotNull(), F.transform(F.sequence(F.lit(1), F.size("m")), lambda k: row("after content", joined(F.slice("m", F.lit(1), k))))).otherwise(F.array().cast("array<struct<kind:string,surface:string>>"))
    span = F.concat("lead", joined(F.col("m")))
    spans = F.when(F.col("lead").isNotNull() & (F.length(span) <= longest), F.array(row("span", span))).otherwise(F.array().cast("array<struct<kind:string,surface:string>>"))
    return forms.select(F.inline(F.concat(single, F.array(row("run", joined(F.col("m")))), prefixes, spans))).groupBy("surface", "kind").agg(F.count("*").alias("n"))


def top_reading(counts: DataFrame, key: str, value: str, n: str, least: int = 1, share: float = 0.0) -> DataFrame:
    """Most frequent value per key (the lesser of equals), of keys with ``least`` in all and that share for it."""
    w = Window.partitionBy(key)
    r = counts.select(key, value, F.col(n).alias("best"), F.sum(n).over(w).alias("total"), F.row_number().over(w.orderBy(F.desc(n), value)).alias("rank"))
    return r.where((F.col("rank") == 1) & (F.col("total") >= least) & (F.col("best") >= share * F.col("total"))).drop("rank")


def ranked(counts: DataFrame, key: str, by: list[Column], name: str = "rank") -> DataFrame:
    return counts.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*by)))


def ambiguous(counts: DataFrame, key: str, value: str, n: str, least_total: int, least_share: float) -> DataFrame:
    """Keys with two readings or more, at least ``least_total`` in all, whose second has ``least_share``."""
    w = Window.partitionBy(key)
    r = counts.select(key, value, n, F.row_number().over(w.orderBy(F.desc(n), value)).alias("rank"), F.sum(n).over(w).alias("total"))
    return r.where("rank <= 2").groupBy(key).agg(F.max("total").alias("total"), F.max(F.when(F.col("rank") == 1, F.col(value))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col(value))).alias("second"), F.max(F.when(F.col("rank") == 2, F.col(n))).alias("second_n")).where((F.col("total") >= least_total) & (F.col("second_n") >= least_share * F.col("total")))


def prefix_matches(texts: DataFrame, words: DataFrame, key: str, text: str, surface: str = "surface") -> DataFrame:
    """Dictionary words that begin at each place of each text: (key, start, surface, ...), places from 0.

    A dictionary of up to a million words travels as a trie, which all places of a batch go down together: only those
    that still match are looked at again. For a larger one, places times its lengths are joined with it.
    """
    if words.count() < 1_000_000:
        trie = _Trie([r[0] for r in words.select(surface).distinct().collect() if r[0] is not None], key, surface)
        kinds = StructType([StructField(key, texts.schema[key].dataType), StructField("start", IntegerType()), StructField(surface, StringType())])
        return texts.select(key, F.col(text).alias("t")).mapInArrow(trie, kinds).join(F.broadcast(words), surface)
    found = words.select(F.length(surface)).distinct().collect()  # one row per length
    lengths = ", ".join(str(r[0]) for r in sorted(found))
    # characters as an array, held by a lambda's variable: places in a long string are found by counting from its start
    cut = f"flatten(transform(sequence(0, size(c) - 1), p -> transform(filter(array({lengths}), k -> p + k <= size(c)), k -> struct(p as start, array_join(slice(c, p + 1, k), '') as {surface}))))"
    texts = texts.select(key, F.col(text).alias("t")).where("length(t) > 0")
    at = texts.select(key, F.expr(f"element_at(transform(array(filter(split(t, ''), x -> x <> '')), c -> {cut}), 1)").alias("at")).select(key, F.expr("inline_outer(at)"))
    return at.join(words, surface)


_END = 0x110000  # stands between texts: no character


class _Trie:
    """Batches (key, t) into rows (key, start, surface). Nodes are numbered from 0, the root; an edge is node, character."""

    def __init__(self, surfaces: list[str], key: str, surface: str):
        edges: dict[tuple[int, str], int] = {}
        ends = {}
        for k, word in enumerate(surfaces):
            node = 0
            for c in word:
                node = edges.setdefault((node, c), len(edges) + 1)
            ends[node] = k
        self.names, self.surfaces = [key, "start", surface], surfaces
        order = sorted((node << 21 | ord(c), to) for (node, c), to in edges.items())
        self.edges, self.to = np.array([e for e, _ in order], np.int64), np.array([t for _, t in order], np.int32)
        self.word = np.full(len(edges) + 1, -1, np.int32)
        for node, k in ends.items():
            self.word[node] = k

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.zeros(_END + 1, np.int32)  # the first step, from the root, looks at every place
        root = self.edges < 1 << 21
        first[self.edges[root]] = self.to[root]
        surfaces = pa.array(self.surfaces, pa.string())
        for batch in batches:
            rows, parts, size = [], [], 0
            for k, t in enumerate(batch.column(1)):
                if t := t.as_py():
                    rows.append(k)
                    parts.append(np.frombuffer(t.encode("utf-32-le"), np.uint32))
                    size += len(parts[-1])
                if parts and (size >= 1 << 20 or k == batch.num_rows - 1):
                    yield from self._found(batch.column(0), rows, parts, first, surfaces)
                    rows, parts, size = [], [], 0
            if parts:
                yield from self._found(batch.column(0), rows, parts, first, surfaces)

    def _found(self, keys: pa.Array, rows: list[int], parts: list[np.ndarray], first: np.ndarray, surfaces: pa.Array) -> Iterator[pa.RecordBatch]:
        end = np.array([_END], np.uint32)
        codes = np.concatenate([x for p in parts for x in (p, end)])
        begin = np.cumsum([0] + [len(p) + 1 for p in parts])
        at, node = np.flatnonzero(codes != _END), None
        if self.word[0] >= 0:
            yield self._rows(keys, rows, begin, at, np.full(len(at), self.word[0]), surfaces)
        depth = 0
        while len(at):
            if depth == 0:
                node = first[codes[at]]
            else:
                edge = node.astype(np.int64) << 21 | codes[at + depth]
                k = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
                node = np.where(self.edges[k] == edge, self.to[k], 0)
            at, node = at[node > 0], node[node > 0]
            word = self.word[node]
            if (hit := word >= 0).any():
                yield self._rows(keys, rows, begin, at[hit], word[hit], surfaces)
            depth += 1

    def _rows(self, keys: pa.Array, rows: list[int], begin: np.ndarray, at: np.ndarray, word: np.ndarray, surfaces: pa.Array) -> pa.RecordBatch:
        text = np.searchsorted(begin, at, "right") - 1
        return pa.RecordBatch.from_arrays([keys.take(pa.array(np.array(rows)[text])), pa.array((at - begin[text]).astype(np.int32)), surfaces.take(pa.array(word))], self.names)


def islands(tokens: DataFrame, sentence: str, order: str, inside: Column) -> DataFrame:
    """Maximal runs of tokens that satisfy ``inside``, numbered within their sentence."""
    w = Window.partitionBy(sentence).orderBy(order)
    marked = tokens.withColumn("_in", inside).withColumn("island", F.sum(F.when(F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False)), 1).otherwise(0)).over(w))
    return marked.where("_in").drop("_in")
