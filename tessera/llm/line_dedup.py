"""Line dedup (operator 5): windows of three consecutive lines that occur earlier are removed.

Every overlapping window of ``width`` lines is hashed (128 bits); the earliest place of each hash, by
(doc_id, row key, line number), is kept, and every line that a later occurrence covers goes. All of it is
built-in expressions over one shuffle of (hash, place) rows; only documents that lose lines are rebuilt.

Defined cases: a text with fewer lines than a window, an empty text and a null text pass unchanged; a null
doc_id sorts first; rows that repeat doc_id and text share their places, so none of them counts as later than
the other and both lose the same lines; extra columns are passed through, whatever their names, and a column
``n_chars`` is set to the new length; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, row_key


def covered_lines(docs: DataFrame, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(rk, cut): for each row key the line numbers, from 0, that later occurrences cover."""
    # a lambda's variable holds the lines, else every use of them would split the text again; inline_outer, as
    # Spark would compute the argument of inline a second time to filter by its size
    lines = ", ".join(f"get(l, p + {k})" for k in range(width))
    windows = f"transform(sequence(0, greatest(size(l) - {width}, 0)), p -> struct(p, xxhash64({lines}) as h, xxhash64('2', {lines}) as g, p + {width} <= size(l) as ok))"
    base = docs.select(col(doc_id).alias("d"), row_key(doc_id, text).alias("rk"), col(text).alias("text")).where("text is not null")
    places = base.select("d", "rk", F.expr(f"element_at(transform(array(split(text, '\\n')), l -> {windows}), 1)").alias("w")).select("d", "rk", F.expr("inline_outer(w)")).where("ok")
    # sums on the map side and a join, which AQE may split, in place of a window: a window of lines may be in any number of texts
    place = F.struct("d", "rk", "p")
    least = places.groupBy("h", "g").agg(F.min(place).alias("least"), F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("lh"), F.col("g").alias("lg"), "least")
    later = places.join(least, (F.col("h") == F.col("lh")) & (F.col("g") == F.col("lg"))).where(place > F.col("least"))
    return later.groupBy("rk").agg(F.array_distinct(F.flatten(F.collect_list(F.expr(f"sequence(p, p + {width - 1})")))).alias("cut"))


def line_dedup(docs: DataFrame, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the lines that later occurrences of repeated windows cover."""
    rk, cut, key = fresh(docs, "rk", "cut", "key")
    gone = covered_lines(docs, width, doc_id, text).select(F.col("rk").alias(key), F.col("cut").alias(cut))
    rest = lambda l: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(l) - 1), col(cut)), lambda i: F.get(l, i)), "\n")
    kept = F.element_at(F.transform(F.array(F.split(col(text), "\n")), rest), 1)
    new = F.when(col(cut).isNull(), col(text)).otherwise(kept)
    out = docs.withColumn(rk, row_key(doc_id, text)).join(gone, col(rk) == col(key), "left")
    changed = {text: new}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(col(cut).isNull(), col("n_chars")).otherwise(F.length(kept).cast(docs.schema["n_chars"].dataType))
    return out.select(*[changed[c].alias(c) if c in changed else col(c) for c in docs.columns])


#: DuckDB twin of line_dedup over documents (unique doc_ids), columns doc_id and text.
LINE_DEDUP_SQL = """
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p, unnest(string_split(text, chr(10))) AS line FROM documents),
w AS (SELECT doc_id, p, line AS a, lead(line, 1) OVER o AS b, lead(line, 2) OVER o AS c, lead(p, 2) OVER o AS e FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS k FROM w WHERE e IS NOT NULL),
cut AS (SELECT DISTINCT doc_id, p + x.i AS p FROM r, (VALUES (0), (1), (2)) x(i) WHERE k > 1),
kept AS (SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.p) FILTER (WHERE cut.p IS NULL), '') AS text
         FROM l LEFT JOIN cut ON l.doc_id = cut.doc_id AND l.p = cut.p GROUP BY l.doc_id)
SELECT doc_id, text FROM kept UNION ALL SELECT doc_id, text FROM documents WHERE text IS NULL
"""
