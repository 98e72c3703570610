"""Mixture-controlled packing (operator 9): deficit round-robin over one queue of tokens per source.

Tokens are runs of characters other than ASCII white space. A source's queue holds its texts in the order of
md5(doc_id), a fixed shuffle. In round r a queue is served floor(r q) - floor((r - 1) q) tokens, q being its share of
``window`` tokens: what rounding withholds is the deficit, carried to later rounds. Queues are visited in the order
of their names, an empty one is passed over, and the stream of served tokens is cut into windows of exactly
``window`` tokens (the last may be shorter), so each window but for a few tokens of rounding has the target
proportions of the sources not yet exhausted. As served totals have a closed form, no window waits for another: a
token's place follows from its rank in its queue, and ranks come from block sums, so hot sources are spread.

``targets`` gives weights by source (sources without one get 1); by default the weights, in parts of 100,000, lie
halfway between the sources' own token shares and equal ones. One row per source is collected.

Defined cases: null and empty texts have no tokens and appear nowhere; a null source is a queue of its own, visited
first; rows that repeat doc_id and text are packed each; a null doc_id sorts first in its queue, ties by doc_id are
ordered by text; a text longer than a window runs through several; other columns aren't returned; no tokens, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import word_runs
from .common import broadcast_if_small, col, stage

WINDOW, PARTS = 2048, 100_000
_SCHEMA = "window_id long, position int, source string, doc_id long, first_token int, n_tokens int, text string"


def n_tokens(text: str) -> Column:
    return F.regexp_count(text, F.lit("[^ \\t\\n\\u000b\\f\\r]+")).cast("bigint")


def shares(totals: list[tuple[str | None, int]], targets: dict[str | None, int] | None = None) -> list[tuple[str | None, int, int]]:
    """(source, total, weight) in the order of visits."""
    rows = sorted(((s, t) for s, t in totals if t), key=lambda x: (x[0] is not None, (x[0] or "").encode()))
    all_tokens = sum(t for _, t in rows)
    if targets is not None:
        return [(s, t, max(1, int(targets.get(s, 1)))) for s, t in rows]
    return [(s, t, max(1, PARTS // 2 * t // all_tokens + PARTS // 2 // len(rows))) for s, t in rows]


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows repeated for each integer from first to last; and these."""
    n = last - first + 1
    begin = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(np.arange(len(n)), n), np.arange(begin[-1]) - np.repeat(begin[:-1] - first, n)


def places(x0: np.ndarray, x1: np.ndarray, k: np.ndarray, queues: list[tuple[str | None, int, int]], window: int) -> tuple[np.ndarray, ...]:
    """Pieces of texts that are tokens x0 to x1 of queue k: text, first token in it, tokens, window, place in it."""
    total = np.array([t for _, t, _ in queues])
    quantum = np.array([w * window for _, _, w in queues])
    parts = sum(w for _, _, w in queues)
    q = quantum[k]
    row, r = _spread(-(-(x0 + 1) * parts // q), -(-x1 * parts // q))
    q, k = q[row], k[row]
    begin = (r - 1) * q // parts
    a, z = np.maximum(x0[row], begin), np.minimum(x1[row], r * q // parts)
    p = a - begin
    rounds, at = np.unique(r, return_inverse=True)
    step = max(1, (1 << 21) // len(queues))
    before = np.empty(len(r), np.int64)
    order = np.argsort(at, kind="stable")
    for lo in range(0, len(rounds), step):
        own = rounds[lo : lo + step, None]
        past, now = np.minimum(total, (own - 1) * quantum // parts), np.minimum(total, own * quantum // parts)
        turns = np.concatenate([past.sum(1)[:, None], now - past], axis=1).cumsum(1)  # where each queue's turn begins
        mine = order[np.searchsorted(at[order], lo) : np.searchsorted(at[order], lo + step)]
        before[mine] = turns[at[mine] - lo, k[mine]]
    p += before
    ok = z > a
    row, a, z, p = row[ok], a[ok], z[ok], p[ok]
    piece, w = _spread(p // window, (p + z - a - 1) // window)
    row, a, z, p = row[piece], a[piece], z[piece], p[piece]
    s, e = np.maximum(p, w * window), np.minimum(p + z - a, (w + 1) * window)
    return row, a - x0[row] + s - p, e - s, w, s - w * window


def _pieces(queues: list[tuple[str | None, int, int]], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x0, x1, k = (batch.column(c).to_numpy() for c in (3, 4, 5))
            for lo, hi, words in word_runs(batch.column(2)):
                row, first, n, w, at = places(x0[lo:hi], x1[lo:hi], k[lo:hi], queues, window)
                i = words.first[row] + first
                body = words.body.tobytes()
                text = [body[s:e] for s, e in zip(words.starts[i].tolist(), words.ends[i + n - 1].tolist())]
                take = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w), pa.array(at.astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(text, pa.binary()).cast(pa.string())],
                    names=["window_id", "position", "source", "doc_id", "first_token", "n_tokens", "text"],
                )

    return run


def pack(docs: DataFrame, window: int = WINDOW, targets: dict[str | None, int] | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(window_id, position, source, doc_id, first_token, n_tokens, text): the pieces that fill the windows.

    A piece's text is the part of its document from its first token to the end of its last.
    """
    spark = docs.sparkSession
    base = docs.where(col(text).isNotNull()).select(col(source).cast("string").alias("source"), col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.md5(col(doc_id).cast("string")), F.lit("")).alias("o"), col(text).alias("text"))
    base = base.select("source", "doc_id", "o", "text", n_tokens("text").alias("n")).where("n > 0")
    blocks = stage(base.groupBy("source", F.substring("o", 1, 3).alias("b")).agg(F.sum("n").alias("t")), "blocks")
    queues = shares([tuple(r) for r in blocks.groupBy("source").agg(F.sum("t").alias("t")).collect()], targets)
    if not queues:
        return spark.createDataFrame([], _SCHEMA)
    before = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    turn = F.broadcast(spark.createDataFrame([(s, k) for k, (s, _, _) in enumerate(queues)], "qs string, k long"))
    offsets = blocks.select(F.col("source").alias("bs"), "b", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("off")).join(turn, F.col("bs").eqNullSafe(F.col("qs")))
    within = Window.partitionBy("source", "bb").orderBy("o", F.col("doc_id").asc_nulls_first(), "text").rowsBetween(Window.unboundedPreceding, 0)
    ranked = base.withColumn("bb", F.substring("o", 1, 3)).withColumn("upto", F.sum("n").over(within))
    placed = ranked.join(broadcast_if_small(offsets), F.col("source").eqNullSafe(F.col("bs")) & (F.col("bb") == F.col("b"))).selectExpr("source", "doc_id", "text", "off + upto - n as x0", "off + upto as x1", "k")
    return placed.mapInArrow(_pieces(queues, window), _SCHEMA)


PACK_SQL = f"""
WITH d AS (SELECT source, doc_id, md5(doc_id::VARCHAR) AS o, text, regexp_extract_all(text, '\\S+\\s*') AS w FROM documents),
n AS (SELECT *, sum(len(w)) OVER (PARTITION BY source ORDER BY o, doc_id, text ROWS UNBOUNDED PRECEDING)::BIGINT AS x1 FROM d WHERE len(w) > 0),
t AS (SELECT source, sum(len(w))::BIGINT AS t FROM n GROUP BY source),
q AS (SELECT source, t, greatest(1, {PARTS // 2} * t // (sum(t) OVER ())::BIGINT + {PARTS // 2} // count(*) OVER ()) AS wt FROM t),
c AS (SELECT *, (sum(wt) OVER ())::BIGINT AS b, wt * {WINDOW} AS q FROM q),
p AS (SELECT n.source, doc_id, w, x1 - len(w) AS x0, x1, q, b, unnest(range(((x1 - len(w) + 1) * b + q - 1) // q, (x1 * b + q - 1) // q + 1)) AS r FROM n JOIN c USING (source)),
rr AS (SELECT DISTINCT r FROM p),
served AS (SELECT r, source, least(t, (r - 1) * q // b) AS lo, least(t, r * q // b) AS hi FROM rr, c),
base AS (SELECT r, source, (sum(lo) OVER (PARTITION BY r) + coalesce(sum(hi - lo) OVER (PARTITION BY r ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS p0 FROM served),
a AS (SELECT p.*, greatest(x0, (r - 1) * q // b) AS a, least(x1, r * q // b) AS z, p0 FROM p JOIN base USING (r, source)),
g AS (SELECT *, p0 + a - (r - 1) * q // b AS p FROM a WHERE z > a),
u AS (SELECT *, unnest(range(p // {WINDOW}, (p + z - a - 1) // {WINDOW} + 1)) AS window_id FROM g),
s AS (SELECT *, greatest(p, window_id * {WINDOW}) AS s, least(p + z - a, (window_id + 1) * {WINDOW}) AS e FROM u)
SELECT window_id, (s - window_id * {WINDOW})::INT AS position, source, doc_id, (a - x0 + s - p)::INT AS first_token, (e - s)::INT AS n_tokens,
       regexp_replace(array_to_string(w[a - x0 + s - p + 1 : a - x0 + e - p], ''), '\\s+$', '') AS text FROM s
"""
