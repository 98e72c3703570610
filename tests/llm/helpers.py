import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
CLASH = ["rk", "key", "new", "cut", "h", "g", "d", "p", "n", "root", "out", "quality_score", "ids", "decoded", "bits_per_byte", "toxic", "toxic_windows", "windows", "window_id", "n_tokens", "words", "runs", "spans", "band", "w"]


def prose(n, seed, vocab=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocab):03d}" for _ in range(n))


def docs(spark, rows, extra=False):
    """rows: (doc_id, text) or (doc_id, text, source). extra: adds columns with names that operators may use."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(3)
    if extra:
        from pyspark.sql import functions as F

        for k, c in enumerate(CLASH):
            df = df.withColumn(c, F.lit(k))
    return df


def odd_rows():
    """Nulls, empty and blank texts, repeated rows, a null id, one very long text."""
    same = prose(80, 5) + "\n" + prose(3, 6) + "\nx\ny"
    return [(1, None), (2, ""), (3, " \n\t "), (4, same), (4, same), (5, same), (None, same), (6, "one"), (7, "one"), (8, prose(60_000, 7, 50_000)), (9, "!!! ..."), (10, "é" * 3000), (None, None)]
