"""Suffix-array dedup (operator 2): every maximal repeat of at least ``least`` words, with all its occurrences, as a tree.

A maximal repeat is a word sequence whose occurrences are not all preceded by the same word and not all followed by
the same word. They are the left-diverse nodes of the interval tree of an enhanced suffix array. Sorting every
suffix of the corpus is not needed for that, and nothing but these exact steps leaves suffixes out:

1. The minimizer of a start is the least hash of an ``anchor``-word gram within the ``least`` words from there.
   Starts with one minimizer form a run. Equal ``least``-grams have equal minimizers at equal distance, so runs
   whose minimizer occurs once hold no repeat; where all runs of a minimizer show the same words from the word
   before the run to the minimizer's end, no start in them is preceded by different words.
2. For the starts of the other runs the same test is made with the whole gram of ``least`` words.
3. The suffixes of what remains, up to where an unrepeated gram ends the repeat or no occurrence after another word
   goes on, are sorted by Spark (external sort), and one pass over each sorted partition computes
   common prefixes of neighbours, scans them with a stack
   and tests each closed interval for left-extension diversity. The first ``least`` words are compared by 192 bits of
   hashes, which stand for them in the shuffle, all later words as such.

Words are runs of characters other than ASCII white space. A text's begin and end differ from everything.

Defined cases: null and empty texts, and texts of fewer than ``least`` words, hold no repeat and pass unchanged;
rows that repeat doc_id and text are two occurrences; a null doc_id sorts first; overlapping occurrences within
one text count; an empty table gives an empty table; extra columns pass through, whatever their names.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .blocks import Words, chunks, mix, pair, shifted, signed, text_buffers, window_hash, word_runs
from .common import col, fresh, row_key, stage

LEAST, ANCHOR = 50, 20
#: Sorted suffixes go to the scan in pieces of this many bytes: Spark counts rows, so a batch of whole ones has no bound.
PIECE = 2048
#: Bytes of text whose words are hashed at a time; the arrays for them take about 50 times as much.
RUN = 1 << 19


def _runs(least: int, anchor: int):
    span = least - anchor + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for lo, _, w in word_runs(batch.column(1), most=RUN):
                n = np.diff(w.first)
                long = np.flatnonzero(n >= least)
                if not len(long):
                    continue
                gram = window_hash(w.hashes, anchor)
                bits = max(1, int(len(gram)).bit_length())
                low = np.uint64((1 << bits) - 1)
                best = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
                size, done, out, left, power = 1, 0, None, span, best
                while left:  # least of each window of ``span`` grams, by doubling
                    if left & 1:
                        part = shifted(power, done)
                        out = part if out is None else np.minimum(out, part)
                        done += size
                    left >>= 1
                    if left:
                        power = np.minimum(power, shifted(power, size))
                        size *= 2
                count = n[long] - least + 1
                begin = np.zeros(len(count) + 1, np.int64)
                np.cumsum(count, out=begin[1:])
                start = np.repeat(w.first[:-1][long] - begin[:-1], count) + np.arange(begin[-1])
                at = (out[start] & low).astype(np.int64)
                head = np.ones(len(start), bool)
                head[1:] = at[1:] != at[:-1]
                head[begin[:-1]] = True
                heads = np.flatnonzero(head)
                i1, m = start[heads], at[heads]
                length = np.diff(np.append(heads, len(start)))
                owner = long[np.searchsorted(begin, heads, "right") - 1]
                first = i1 == w.first[:-1][owner]
                # hash of the words from before the run to the minimizer's end, by prefix sums of scattered terms
                place = mix(np.arange(least + 2, dtype=np.uint64) + np.uint64(17)) | np.uint64(1)
                lead = np.maximum(i1 - 1, 0)
                link = np.zeros(len(i1), np.uint64)
                for k in range(span + 1):
                    inside = lead + k < m
                    link[inside] += w.hashes[(lead + k)[inside]] * place[k]
                link = pair(link, pair(gram[m], (m - i1).astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(mix(gram[m]))),
                        pa.array(signed(link), mask=first),
                        keys.take(pa.array(owner + lo)),
                        pa.array((i1 - w.first[:-1][owner]).astype(np.int32)),
                        pa.array(length.astype(np.int32)),
                    ],
                    names=["g", "link", "rk", "i", "n"],
                )

    return run


def _starts(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            runs = batch.column(2)
            each = runs.flatten()
            ri, rn, rd = (each.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            off = np.zeros(len(batch) + 1, np.int64)
            np.cumsum(runs.value_lengths().to_numpy(zero_copy_only=False), out=off[1:])
            for lo, hi, w in word_runs(batch.column(1), most=RUN):
                gram = window_hash(w.hashes, least)
                cols: list[list[np.ndarray]] = [[], [], [], [], []]
                for k in range(lo, hi):
                    n_words = int(w.first[k - lo + 1] - w.first[k - lo])
                    i, at = np.unique(ri[off[k] : off[k + 1]], return_index=True)
                    n, diverse = rn[off[k] : off[k + 1]][at].astype(np.int64), rd[off[k] : off[k + 1]][at].astype(bool)
                    i = i.astype(np.int64)
                    ok = i + n + least - 1 <= n_words
                    i, n, diverse = i[ok], n[ok], diverse[ok]
                    if not diverse.any():
                        continue
                    # where a chain of adjoining runs ends, so does every repeat that begins in it
                    last = np.append(i[1:] != (i + n)[:-1], True)
                    ends = (i + n - 1 + least)[last]
                    reach = ends[np.searchsorted(np.flatnonzero(last), np.arange(len(i)))]
                    i, n, reach = i[diverse], n[diverse], reach[diverse]
                    skip = np.zeros(len(n), np.int64)
                    np.cumsum(n[:-1], out=skip[1:])
                    starts = np.repeat(i - skip, n) + np.arange(int(n.sum()))
                    base = int(w.first[k - lo])
                    cols[0].append(gram[base + starts])
                    cols[1].append(np.where(starts > 0, w.hashes[base + np.maximum(starts - 1, 0)], np.uint64(0)))
                    cols[2].append(np.full(len(starts), k))
                    cols[3].append(starts)
                    cols[4].append(np.repeat(reach, n))
                if not cols[0]:
                    continue
                h, prev, k, s, r = (np.concatenate(c) for c in cols)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(h)), pa.array(signed(prev), mask=s == 0), keys.take(pa.array(k)), pa.array(s.astype(np.int32)), pa.array(r.astype(np.int32))],
                    names=["h", "prev", "rk", "i", "r"],
                )

    return run


def _suffixes(least: int):
    """rk, doc_id, text, starts[(i, r, h, prev)] -> a digest of the suffix's first words, then the others with a space each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _suffix_rows(batch, least)

    return run


def _suffix_rows(batch: pa.RecordBatch, least: int) -> Iterator[pa.RecordBatch]:
    lists = batch.column(3)
    each = lists.flatten()
    si, sr = (each.field(k).to_numpy(zero_copy_only=False) for k in range(2))
    off = np.zeros(len(batch) + 1, np.int64)
    np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), out=off[1:])
    body, at = text_buffers(batch.column(2))
    for lo, hi in chunks(at, RUN):
        w = Words(body[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        pick, words, held = [], [], 0

        def flush(pick: list, words: list, batch: pa.RecordBatch = batch, each: pa.StructArray = each) -> pa.RecordBatch:
            row = np.array([p[0] for p in pick])
            one = each.take(pa.array([p[1] for p in pick]))
            return pa.RecordBatch.from_arrays([one.field(2), pa.array(words, pa.binary()), batch.column(1).take(pa.array(row)), batch.column(0).take(pa.array(row)), one.field(0), one.field(3)], names=["h", "suffix", "doc_id", "rk", "i", "prev"])

        for k in range(lo, hi):
            base, n_words = int(w.first[k - lo]), int(w.first[k - lo + 1] - w.first[k - lo])
            a = min(int(si[off[k] : off[k + 1]].min(initial=n_words)), n_words)
            tokens = bytes(w.body[w.starts[base + a] : w.ends[base + n_words - 1]]).split() if a < n_words else []
            lens = np.zeros(len(tokens) + 1, np.int64)
            np.cumsum([len(t) + 1 for t in tokens], out=lens[1:]) if tokens else None
            joined = b" ".join(tokens) + b" "
            seen = set()
            for j in range(int(off[k]), int(off[k + 1])):
                i, r = int(si[j]), int(sr[j])
                if i in seen or r > n_words:
                    continue
                seen.add(i)
                pick.append((k, j))
                head = lens[i - a + least]
                words.append(xxh3_128_digest(joined[lens[i - a] : head]) + joined[head : lens[r - a]])
                held += len(words[-1])
                if held > 4 << 20:
                    yield flush(pick, words)
                    pick, words, held = [], [], 0
        if pick:
            yield flush(pick, words)


def common_words(a: bytes, b: bytes, least: int) -> int:
    """Words in the common prefix of two suffixes: ``least`` for an equal digest, and later ones, which end with a space."""
    if a[:16] != b[:16]:
        return 0
    n = min(len(a), len(b))
    if a[16:n] == b[16:n]:
        return least + a.count(b" ", 16, n)
    lo, hi = 16, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return least + a.count(b" ", 16, lo)


class Scan:
    """The stack scan of one first gram. Leaves come in suffix order; closed nodes are (depth, first leaf), up to the last.

    Only the stack and the places where left words change are held, whatever the number of leaves.
    """

    def __init__(self, least: int):
        self.least = least
        self.hash = None
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.change = self.head = -1  # the last leaf with another left word than its neighbour, and with none
        self.stack: list = [(0, 0)]
        self.suffix, self.prev = b"", None

    def diverse(self, first: int) -> bool:
        """Whether the leaves from ``first`` to the last aren't all preceded by the same word."""
        return self.change > first or self.head >= first

    def close_to(self, depth: int) -> Iterator[tuple[int, int]]:
        """Close nodes deeper than ``depth`` that end at the last leaf; then open one at ``depth`` if needed."""
        first = self.n - 1
        while self.stack[-1][0] > depth:
            deep, first = self.stack.pop()
            yield deep, first
        if self.stack[-1][0] < depth:
            self.stack.append((depth, first))

    def add(self, suffix: bytes, prev) -> None:
        """The next leaf; what it closes must have been closed by close_to."""
        if prev is None:
            self.head = self.n
        elif self.n and prev != self.prev:
            self.change = self.n
        self.n += 1
        self.suffix, self.prev = suffix, prev


def _pieces(rows: DataFrame) -> DataFrame:
    """Each suffix in rows of at most ``PIECE`` bytes, in order; ``last`` tells the last one."""
    # the number goes along and not the suffix, which would be copied to each piece's row
    cut = rows.withColumn("n", F.ceil(F.length("suffix") / PIECE).cast("int"))
    parts = F.transform(F.sequence(F.lit(1), "n"), lambda k: F.substring("suffix", (k - 1) * PIECE + 1, F.lit(PIECE)))
    # none is empty; for an inner explode Spark would add a filter that cuts each suffix once more
    cut = cut.select("h", F.posexplode_outer(parts).alias("k", "piece"), "doc_id", "rk", "i", "prev", "n")
    return cut.select("h", "piece", "doc_id", "rk", "i", "prev", (F.col("k") + 1 == F.col("n")).alias("last"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(h, suffix, doc_id, rk, i, prev): suffixes put together from their pieces, one at a time."""
    begun: list[bytes] = []
    for batch in batches:
        body, at = text_buffers(batch.column(1))
        ends = np.flatnonzero(batch.column(6).to_numpy(zero_copy_only=False))
        lo = 0
        for hi, h, *others in zip(at[ends + 1].tolist(), *(batch.column(k).take(pa.array(ends)).to_pylist() for k in (0, 2, 3, 4, 5))):
            suffix = body[lo:hi].tobytes()
            if begun:
                suffix = b"".join([*begun, suffix])
                begun.clear()
            lo = hi
            yield h, suffix, *others
        if lo < len(body):
            begun.append(body[lo:].tobytes())


def _groups(least: int, most: int = 1 << 18):
    names = ["group_id", "parent_id", "n_words", "n_occurrences", "doc_id", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan(least)
        docs, starts, null = array("q"), array("i"), set()  # of the leaves of this gram: 12 bytes each
        loose = array("q")  # leaves in no closed group yet
        below: list[tuple] = []  # groups without a parent yet: first leaf, id, n_words, n_occurrences, leaves
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            size = [len(x[4]) for x in rows]
            out = [np.repeat(np.array([x[k] or 0 for x in rows], t), size) for k, t in enumerate((np.int64, np.int64, np.int32, np.int32))]
            top = np.repeat([x[1] is None for x in rows], size)
            docs_of, starts_of, gone = (np.concatenate([x[k] for x in rows]) for k in (4, 5, 6))
            rows.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1], mask=top), *map(pa.array, out[2:]), pa.array(docs_of, mask=gone), pa.array(starts_of)], names=names)

        def settle(first: int, parent: int | None) -> Iterator[pa.RecordBatch]:
            """The groups that begin at ``first`` or later have this parent."""
            nonlocal held
            while below and below[-1][0] >= first:
                _, own, n_words, n, leaves = below.pop()
                for lo in range(0, len(leaves), most):
                    part = leaves[lo : lo + most]
                    gone = np.array([x in null for x in part], bool) if null else np.zeros(len(part), bool)
                    rows.append((own, parent, n_words, n, np.array([docs[x] for x in part]), np.array([starts[x] for x in part], np.int32), gone))
                    held += len(part)
                    if held > most:
                        yield flush()

        def close(depth: int) -> Iterator[pa.RecordBatch]:
            for deep, first in scan.close_to(depth):
                if not scan.diverse(first):
                    continue
                own = xxh3_64_intdigest(f"{scan.hash} {first} {deep}".encode()) - (1 << 63)
                yield from settle(first, own)
                at = bisect_left(loose, first)
                leaves = loose[at:]
                del loose[at:]
                if not leaves or leaves[0] != first:
                    leaves.insert(0, first)
                below.append((first, own, deep, scan.n - first, leaves))

        for h, suffix, doc, _, start, prev in _rows(batches):
            if h != scan.hash:
                yield from close(0)
                yield from settle(0, None)
                scan.clear()
                scan.hash = h
                docs, starts, loose = array("q"), array("i"), array("q")
                null.clear()
            elif scan.n:
                yield from close(common_words(scan.suffix, suffix, least))
            if doc is None:
                null.add(scan.n)
            docs.append(doc or 0)
            starts.append(start)
            loose.append(scan.n)
            scan.add(suffix, prev)
        yield from close(0)
        yield from settle(0, None)
        if rows:
            yield flush()

    return run


def _spans(least: int, most: int = 1 << 17):
    """For each leaf the longest repeat in which another occurrence comes first: rk, i, n words to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan(least)
        # of each open node the first occurrence so far, and the latest leaf: (leaf, its place in the order, key, start)
        free: list[tuple] = []
        out: list[tuple] = []

        def fold(depth: int, first: int) -> None:
            """Of the leaves from ``first``, whose deepest open node has this depth, all but the first occurrence lose it."""
            while len(free) > 1 and free[-2][0] >= first:
                b, a = free.pop(), free.pop()
                if b[1] < a[1]:
                    a, b = b, a
                if a[1] != b[1]:
                    out.append((b[2], b[3], depth))
                free.append((min(a[0], b[0]), *a[1:]))

        def close(depth: int) -> None:
            for deep, first in scan.close_to(depth):
                fold(deep, first)
            if scan.stack[-1][0]:
                fold(*scan.stack[-1])

        def flush() -> pa.RecordBatch:
            key, start, n = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32())], names=["rk", "i", "n"])

        for h, suffix, doc, key, start, prev in _rows(batches):
            if h != scan.hash:
                close(0)
                scan.clear()
                scan.hash = h
                free.clear()
            elif scan.n:
                close(common_words(scan.suffix, suffix, least))
            free.append((scan.n, (doc is not None, doc or 0, key, start), key, start))
            scan.add(suffix, prev)
            if len(out) > most:
                yield flush()
        close(0)
        if out:
            yield flush()

    return run


def sorted_suffixes(docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts that hold repeats, and in each partition the sorted suffixes that can begin one, in the rows of ``_pieces``."""
    if not 0 < anchor < least:
        raise ValueError("anchor must be less than least")
    base = docs.where(col(text).isNotNull()).select(row_key(doc_id, text).alias("rk"), col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"))
    runs = base.select("rk", "text").mapInArrow(_runs(least, anchor), "g long, link long, rk long, i int, n int")
    same = Window.partitionBy("g")
    repeated = runs.select("rk", "i", "n", F.count("*").over(same).alias("c"), ((F.min("link").over(same) != F.max("link").over(same)) | (F.count("link").over(same) < F.count("*").over(same))).alias("diverse")).where("c > 1")
    wanted = repeated.groupBy("rk").agg(F.collect_list(F.struct("i", "n", F.coalesce("diverse", F.lit(True)).alias("diverse"))).alias("runs")).where("exists(runs, x -> x.diverse)")
    held = stage(base.join(wanted, "rk").select("rk", "text", "runs", "doc_id"), "repeats")
    starts = held.select("rk", "text", "runs").mapInArrow(_starts(least), "h long, prev long, rk long, i int, r int")
    gram = Window.partitionBy("h")
    size = F.col("r") - F.col("i")
    tested = starts.select("*", F.count("*").over(gram).alias("c"), F.count("prev").over(gram).alias("p"), F.min("prev").over(gram).alias("a"), F.max("prev").over(gram).alias("b"), F.max(F.struct(size.alias("n"), "prev")).over(gram).alias("top")).where("c > 1 and (p < c or a <> b)")
    # a repeat that is to be told has occurrences after different words: it is no longer than the second longest of
    # the longest suffixes after each word (a text's begin is like no other), and no suffix need be longer than that
    second = F.max(F.when(~F.col("prev").eqNullSafe(F.col("top.prev")), size)).over(gram)
    tested = tested.select("rk", "i", "h", "prev", F.least("r", F.col("i") + F.when(F.col("top.prev").isNull() & (F.col("c") - F.col("p") > 1), F.col("top.n")).otherwise(second)).alias("r"))
    # a table of its own, so that the shuffle of all tested starts is gone before suffixes are shuffled
    by_doc = stage(tested.groupBy("rk").agg(F.collect_list(F.struct("i", "r", "h", "prev")).alias("starts")), "starts")
    rows = held.join(by_doc, "rk").select("rk", "doc_id", "text", "starts").mapInArrow(_suffixes(least), "h long, suffix binary, doc_id long, rk long, i int, prev long")
    # suffixes are long rows: more and smaller partitions keep a task's sort in little memory
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return held, _pieces(rows.repartition(parts, "h").sortWithinPartitions("h", "suffix", "doc_id", "i"))


def repeats(docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(group_id, parent_id, n_words, n_occurrences, doc_id, start): the maximal repeats as an interval tree.

    A group's parent is the longest group that its repeat begins with. A place (start counts words from 0) is in a row
    of the longest group that begins there, and each group has its first place in suffix order besides, so a group's
    ``n_occurrences`` places are those of its rows and of all groups below it. Spelled out for each group they would
    grow with the square of a cluster of near copies; ``occurrences`` does it.
    """
    _, rows = sorted_suffixes(docs, least, anchor, doc_id, text)
    return rows.mapInArrow(_groups(least), "group_id long, parent_id long, n_words int, n_occurrences int, doc_id long, start int")


def occurrences(tree: DataFrame) -> DataFrame:
    """(group_id, doc_id, start): every place of every group of ``repeats``; repeated rows' places are told apart no more.

    Places move up to the parent, level by level, until no group has one; each level is written to the shared folder.
    """
    up = stage(tree.where("parent_id is not null").select("group_id", "parent_id").distinct(), "parents")
    now = stage(tree.select("group_id", "doc_id", "start").distinct(), "places")
    out = now
    while not now.isEmpty():
        now = stage(now.join(up, "group_id").select(F.col("parent_id").alias("group_id"), "doc_id", "start").distinct(), "places")
        out = out.union(now)
    return out.distinct()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rk, text, spans[(i, n)] -> rk, the text without the words of the spans."""
    for batch in batches:
        new = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            body = text.encode()
            w = Words(np.frombuffer(body, np.uint8), np.array([0, len(body)]))
            gone = np.zeros(len(w) + 1, np.int64)
            for s in spans:
                if s["i"] + s["n"] <= len(w):
                    gone[s["i"]] += 1
                    gone[s["i"] + s["n"]] -= 1
            out = np.cumsum(gone)[:-1] > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
            parts, at = [], 0
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                parts.append(body[at : w.starts[a]])
                at = int(w.starts[b]) if b < len(w) else len(body)
            new.append((b"".join(parts) + body[at:]).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["rk", "text"])


def suffix_dedup(docs: DataFrame, least: int = LEAST, anchor: int = ANCHOR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every repeat of ``least`` words or more left only where it occurs first, by (doc_id, place).

    All rows stay; a text that is a later copy from end to end becomes empty, and ``n_chars``, where there is such a
    column, is the new length.
    """
    rk, key, new = fresh(docs, "rk", "key", "new")
    held, rows = sorted_suffixes(docs, least, anchor, doc_id, text)
    spans = rows.mapInArrow(_spans(least), "rk long, i int, n int").groupBy("rk").agg(F.collect_set(F.struct("i", "n")).alias("spans"))
    cut = held.select("rk", "text").dropDuplicates(["rk"]).join(spans, "rk").select("rk", "text", "spans").mapInArrow(_cut, "rk long, text string")
    met = docs.withColumn(rk, row_key(doc_id, text)).join(cut.select(F.col("rk").alias(key), F.col("text").alias(new)), col(rk) == col(key), "left")
    done = {text: F.coalesce(col(new), col(text))}
    if "n_chars" in docs.columns:
        done["n_chars"] = F.when(col(new).isNull(), col("n_chars")).otherwise(F.length(col(new)).cast(docs.schema["n_chars"].dataType))
    return met.select(*[done[c].alias(c) if c in done else col(c) for c in docs.columns])
