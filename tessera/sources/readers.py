"""Readers of corpora, gold data and dictionaries. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions import text as text_functions
from ..schema import GOLD, NIKL


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text): trimmed lines; blank ones stay, so that results can be aligned with the file.

    Files are read in splits: a split's lines are numbered where they are read, from the lines of the splits before it
    in its file. The splits are counted first; only these counts, a row per split, are shuffled.
    """
    m = F.col("_metadata")
    read = spark.read.text(path).select(m["file_path"].alias("file"), m["file_block_start"].alias("_split"), F.monotonically_increasing_id().alias("_k"), "value")
    splits = read.groupBy("file", "_split").agg(F.min("_k").alias("_first"), F.count("*").alias("_lines"))
    before = F.sum("_lines").over(Window.partitionBy("file").orderBy("_split")) - F.col("_lines")
    placed = read.join(splits.select("file", "_split", (before - F.col("_first")).alias("_shift")), ["file", "_split"])
    return placed.select("file", (F.col("_k") + F.col("_shift")).alias("line"), F.trim("value").alias("text"))


def jsonl(spark: SparkSession, path: str | list[str], schema: str | StructType = GOLD) -> DataFrame:
    """JSON lines, gzip or not; a malformed line keeps its text in ``_corrupt``."""
    full = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    return spark.read.schema(full.add("_corrupt", "string")).option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path)


def bad_lines(df: DataFrame) -> int:
    return df.select(F.count_if(F.col("_corrupt").isNotNull()).alias("n")).first()["n"]


def gold(df: DataFrame) -> DataFrame:
    """Gold rows whose morphemes are pairs on disk, as structs; no domain means 'unknown'."""
    pairs = F.transform("morphemes", lambda m: F.struct(F.get(m, F.lit(0)).alias("form"), F.get(m, F.lit(1)).alias("pos")))
    return df.where("text is not null").withColumns({"morphemes": pairs, "domain": F.coalesce("domain", F.lit("unknown"))})


def nikl(spark: SparkSession, path: str | list[str], least: int = 5, most: int = 200) -> DataFrame:
    """(text, words, morphemes): sentences of a nested corpus, of ``least`` to ``most`` characters, blank forms left out."""
    s = spark.read.schema(NIKL).option("multiLine", True).json(path).select(F.explode("document").alias("d")).select(F.explode("d.sentence").alias("s"))
    ms = F.filter(F.coalesce("s.MP", "s.morpheme"), lambda m: F.trim(m["form"]) != "")
    ms = F.transform(ms, lambda m: F.struct(F.replace(m["form"], F.lit("_"), F.lit(" ")).alias("form"), m["label"].alias("pos"), m["word_id"].alias("word_id")))
    return s.select(F.col("s.form").alias("text"), F.col("s.word").alias("words"), ms.alias("morphemes")).where(F.length("text").between(least, most) & (F.size("morphemes") > 0))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(surface, pos, freq) from a TSV; lines of another shape and comments are dropped."""
    return spark.read.schema("surface string, pos string, freq bigint").option("sep", "\t").option("mode", "DROPMALFORMED").option("comment", "#").csv(path).where("surface is not null and pos is not null and freq is not null")


def flagged(spark: SparkSession, path: str, keep: Column) -> DataFrame:
    """A TSV with a header, filtered."""
    return spark.read.option("sep", "\t").option("header", True).csv(path).where(keep)


def corpus(spark: SparkSession, path: str, least: int = 5, most: int = 200) -> DataFrame:
    """Sentences of a plain corpus: no blank lines, no headings (=), lengths in bounds, each once."""
    t = spark.read.text(path).select(F.trim("value").alias("text"))
    return t.where(F.length("text").between(least, most) & ~F.col("text").startswith("=")).distinct()


def page_sentences(pages: DataFrame, key: str = "page_id", html: str = "html", korean: bool = True) -> DataFrame:
    """(key, idx, sentence) from the text of web pages, tags stripped."""
    s = pages.select(key, F.posexplode(text_functions.sentences(text_functions.strip_tags(F.col(html)))).alias("idx", "sentence"))
    return s.where(text_functions.is_korean_sentence(F.col("sentence"))) if korean else s


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in a seeded order; equal on every run and every cluster."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def sections(data: bytes, magic: bytes) -> Iterator[tuple[int, bytes]]:
    """(kind, bytes) of a model container: magic, version, then kind, length and content of each section."""
    if data[: len(magic)] != magic:
        raise ValueError("not a model container")
    at = len(magic) + 4
    while at < len(data):
        size = int.from_bytes(data[at + 1 : at + 5], "little")
        if at + 5 + size > len(data):
            raise ValueError("the container is cut off")
        yield data[at], data[at + 5 : at + 5 + size]
        at += 5 + size


class _Pages(DataSourceReader):
    def __init__(self, fetch: Callable[[int, int], list[tuple]], first: int, size: int, most: int):
        self.fetch, self.first, self.size, self.most = fetch, first, size, most

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.first + k * self.size) for k in range(-(-self.most // self.size))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.fetch(partition.value, self.size)


def paged_source(name: str, schema: str, fetch: Callable[[int, int], list[tuple]], size: int = 100, most: int = 1000) -> type[DataSource]:
    """A data source over a paged service: page starts are partitions, and an empty page gives no rows.

    ``fetch(start, size)`` runs in the tasks; it holds the service's address and keys, and may raise.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Pages(fetch, 1, size, most)

    return Paged


