"""SentencePiece encoding and decoding (operator 1) by a forward pass shared among words with common prefixes.

A text is cut into marked words (a run of blanks and what follows; a line feed stands alone), whose segmentations
are independent because no piece holds a mark after another character. The distinct marked words of each run of
rows are sorted, which is the depth-first order of their trie, and the forward table of a word goes on from where
the word before it branched off. For a unigram model the table holds the best score of each prefix (Viterbi). For a
BPE model scores aren't additive: there the one path to a prefix that merging would give survives, namely that whose
last two pieces merging leaves as they are; so the ids equal those of merging. Characters without a piece become
byte pieces. Ids are those of the sentencepiece library for the same file.

Models must have the identity normaliser, the leading mark, kept white space and byte fallback, and no user-defined
pieces; others are refused. U+2581 in a text is the mark itself, so it decodes as a blank.

Defined cases: a null text has null ids, an empty one none, and the reverse; repeated and very long texts are encoded
whole; bytes that form no character decode as U+FFFD each; ids outside the vocabulary raise an error; control pieces
decode as nothing; equal texts have equal ids; an empty table gives an empty table; extra columns pass through, and one
that has the new column's name stays, the new name getting an underscore before it.
"""

from __future__ import annotations

import codecs
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import chunks, text_buffers
from .common import added, col

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_MOST_WORDS, _MOST_PAIRS, _MOST_STEPS = 300_000, 400_000, 400_000

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value = data[at : at + size]
            at += size
        yield key >> 3, value


class Pieces:
    """A SentencePiece model file: pieces, scores, kind of model."""

    def __init__(self, data: bytes):
        self.strings: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.bpe, fallback, norm = False, False, {}
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.strings.append(piece.get(1, b"").decode())
                scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                spec = dict(_fields(value))
                self.bpe, fallback = spec.get(3, 1) == 2, bool(spec.get(35, 0))
                if spec.get(3, 1) not in (1, 2):
                    raise ValueError("neither a unigram nor a BPE model")
            elif field == 3:
                norm = dict(_fields(value))
        if norm.get(2) or not norm.get(3, 1) or norm.get(4, 1) or not norm.get(5, 1) or not fallback or USER in self.kinds:
            raise ValueError("the model needs the identity normaliser with a leading mark, kept white space, byte fallback and no user-defined pieces")
        self.ids = {s: k for k, (s, kind) in enumerate(zip(self.strings, self.kinds)) if kind in (NORMAL,)}
        if any(MARK in s.lstrip(MARK) for s in self.ids):
            raise ValueError("a piece has a mark after another character")
        self.scores = {s: scores[k] for s, k in self.ids.items()}
        self.byte_ids = {int(s[3:5], 16): k for k, (s, kind) in enumerate(zip(self.strings, self.kinds)) if kind == BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.missing = min(self.scores.values(), default=0.0) - 10.0
        self.start: dict | None = None

    def merge(self, word: str) -> list[str]:
        """Plain BPE: again and again the adjacent pair of best score, the leftmost of equals."""
        parts, get = list(word), self.scores.get
        none = -math.inf
        pairs = [get(a + b, none) for a, b in pairwise(parts)]
        while pairs and (best := max(pairs)) != none:
            k = pairs.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = get(parts[k - 1] + parts[k], none)
            if k < len(pairs):
                pairs[k] = get(parts[k] + parts[k + 1], none)
        return parts

    def automaton(self) -> dict:
        """The start state of a machine that reads words and knows which pieces end at each place.

        A state is a dictionary of the next states by character; besides, at 0 the state of its longest proper suffix
        and at 1 the pieces that end here, the longest first, as (characters, id).
        """
        if self.start is None:
            start: dict = {0: None, 1: ()}
            for piece, k in self.ids.items():
                state = start
                for ch in piece:
                    state = state.setdefault(ch, {1: ()})
                state[1] = ((len(piece), k),)
            level = [start]
            while level:
                below = []
                for state in level:
                    for ch in [c for c in state if c.__class__ is str]:
                        after, up = state[ch], state[0]
                        while up is not None and ch not in up:
                            up = up[0]
                        after[0] = start if up is None else up[ch]
                        after[1] += after[0][1]
                        below.append(after)
                level = below
            # numbers of what has no piece follow the vocabulary's
            self.sizes = [len(s) for s in self.strings]
            self.odd: dict[str, int] = {}
            self.names = list(self.strings)
            self.pairs: dict[int, bool] = {}
            self.known_steps = 0
            self.start = start
        return self.start

    def step(self, state: dict, ch: str) -> dict:
        """The state after ``ch`` where the trie has none, kept for the next time."""
        up = state[0]
        while up is not None and ch not in up:
            up = up[0]
        after = self.start if up is None else up[ch]
        if up is not None and self.known_steps < _MOST_STEPS:
            self.known_steps += 1
            state[ch] = after
        return after

    def stays(self, a: int, b: int, key: int) -> bool:
        """Whether merging the pieces a + b gives these two."""
        if len(self.pairs) > _MOST_PAIRS:
            self.pairs.clear()
        one, two = self.names[a], self.names[b]
        found = self.pairs[key] = self.merge(one + two) == [one, two]
        return found

    def odd_one(self, ch: str) -> int:
        """The number of a character without a piece."""
        k = self.odd.get(ch)
        if k is None:
            k = self.odd[ch] = len(self.names)
            self.names.append(ch)
            self.sizes.append(1)
        return k

    def to_ids(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            k = self.ids.get(p)
            out.append(k) if k is not None else out.extend(self.byte_ids[b] for b in p.encode())
        return out

    def encode_sorted(self, words: list[str]) -> list[list[int]]:
        """Ids of marked words in sorted order."""
        return self._bpe(words) if self.bpe else self._unigram(words)

    def _bpe(self, words: list[str]) -> list[list[int]]:
        start, step, stays, odd_one, names, sizes = self.automaton(), self.step, self.stays, self.odd_one, self.names, self.sizes
        n_pieces, pairs = len(self.strings), self.pairs
        states, last = [start], [0]  # of each prefix of the word: the machine's state and the last piece
        before, out = "", []
        for word in words:
            if word[:2] == MARK * 2:  # runs of marks have equal scores, and so an order of their own
                out.append(self.to_ids(self.merge(word)))
                continue
            n = len(word)
            k, most = 0, min(n, len(before))
            while k < most and word[k] == before[k]:
                k += 1
            del last[k + 1 :], states[k + 1 :]
            state, i = states[k], k
            for ch in word[k:]:
                i += 1
                state = state.get(ch) or step(state, ch)
                piece = -1
                for size, piece in state[1]:
                    if size == i:
                        break
                    key = last[i - size] << 32 | piece
                    known = pairs.get(key)
                    if known or (known is None and stays(last[i - size], piece, key)):
                        break
                else:
                    if piece < 0 or size > 1:
                        piece = odd_one(ch)
                last.append(piece)
                states.append(state)
            before = word
            parts = []
            while i:
                piece = last[i]
                parts.append(piece)
                i -= sizes[piece]
            parts.reverse()
            out.append(parts if max(parts) < n_pieces else self.to_ids([names[p] for p in parts]))
        return out

    def _unigram(self, words: list[str]) -> list[list[int]]:
        scores, longest = self.scores, self.longest
        best: list[float] = [0.0]
        back: list[int] = [0]
        before, out = "", []
        for word in words:
            n = len(word)
            k, most = 0, min(n, len(before), len(best) - 1)
            while k < most and word[k] == before[k]:
                k += 1
            del best[k + 1 :], back[k + 1 :]
            for i in range(k + 1, n + 1):
                top, frm = (best[i - 1] + self.missing, i - 1) if word[i - 1] not in scores else (None, 0)
                for j in range(max(0, i - longest), i):
                    s = scores.get(word[j:i])
                    if s is not None and (top is None or best[j] + s > top):
                        top, frm = best[j] + s, j
                best.append(top)
                back.append(frm)
            before = word
            parts, i = [], n
            while i:
                parts.append(word[back[i] : i])
                i = back[i]
            out.append(self.to_ids(parts[::-1]))
        return out


@lru_cache(maxsize=1)
def loaded(data: bytes) -> Pieces:
    """The model, read once by each Python worker."""
    return Pieces(data)


class Encoder:
    """Pieces with a bounded table of words met before, and how often."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.at = np.zeros(1, np.int64)
        self.used = np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keep the half of the table that texts used most, lately above all."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: _MOST_WORDS // 2])
        words = list(self.rows)
        self.rows = {words[k]: n for n, k in enumerate(keep.tolist())}
        size = np.diff(self.at)[keep]
        at = np.concatenate([[0], np.cumsum(size)])
        self.flat = self.flat[np.repeat(self.at[keep] - at[:-1], size) + np.arange(at[-1])]
        self.at, self.used = at, self.used[keep] // 2

    def lookup(self, words: list[bytes], times: np.ndarray) -> np.ndarray:
        """Row of each distinct word in the table, which gets the new ones."""
        new = [w for w in words if w not in self.rows]
        if new and len(self.rows) + len(new) > _MOST_WORDS:
            self.forget()
            if len(self.rows) + len(new) > 2 * _MOST_WORDS:
                self.clear()
            new = [w for w in words if w not in self.rows]
        rows = self.rows
        if new:
            new.sort()
            ids = self.pieces.encode_sorted([w.decode().replace(" ", MARK) for w in new])
            rows.update(zip(new, range(len(rows), len(rows) + len(new))))
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(size)])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        found = np.fromiter(map(rows.__getitem__, words), np.int64, len(words))
        self.used[found] += times
        return found

    def encode(self, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts whose leading mark is there already, as a blank, and where each text's ids begin."""
        if not len(body):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        blank, feed = body == 32, body == 10
        head = feed.copy()
        head[0] = True
        head[1:] |= blank[1:] & ~blank[:-1]
        head[1:] |= feed[:-1]
        head[at[:-1][np.diff(at) > 0]] = True
        starts = np.flatnonzero(head)
        offsets = np.append(starts, len(body)).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))]).dictionary_encode()
        which = words.indices.to_numpy()
        rows = self.lookup(words.dictionary.to_pylist(), np.bincount(which))[which]
        size = self.at[rows + 1] - self.at[rows]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = self.flat[np.repeat(self.at[rows] - ends[:-1], size) + np.arange(ends[-1])]
        return flat, ends[np.searchsorted(starts, at)]


def _lists(ids: np.ndarray, ends: np.ndarray, missing: np.ndarray) -> pa.ListArray:
    out = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
    if missing.any():
        out = pa.ListArray.from_buffers(out.type, len(out), [pa.py_buffer(np.packbits(~missing, bitorder="little")), out.buffers()[1]], children=[out.values])
    return out


class Decoder:
    """Bytes of every id."""

    def __init__(self, pieces: Pieces):
        raw = [bytes([int(s[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else s.replace(MARK, " ").encode() for s, k in zip(pieces.strings, pieces.kinds)]
        self.at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.silent = np.array([k == CONTROL for k in pieces.kinds])
        self.marked = np.array([s.startswith(MARK) for s in pieces.strings])
        self.n = len(raw)

    def decode(self, ids: np.ndarray, cut: np.ndarray) -> list[bytes]:
        """The bytes that ids[cut[k] : cut[k + 1]] stand for, without the leading mark."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.n):
            raise ValueError("an id is outside the vocabulary")
        size = self.at[ids + 1] - self.at[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        body = self.flat[np.repeat(self.at[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        voiced = np.append(np.flatnonzero(~self.silent[ids]), len(ids))
        first = voiced[np.minimum(np.searchsorted(voiced, cut[:-1]), len(voiced) - 1)]
        lead = (first < cut[1:]) & self.marked[np.append(ids, 0)[first]] if len(cut) > 1 else np.zeros(0, bool)
        return [body[a:b] for a, b in zip((ends[cut[:-1]] + lead).tolist(), ends[cut[1:]].tolist())]


def _text(data: bytes) -> str:
    return data.decode("utf-8", "each_byte")


def _encoded(data: bytes, check: bool):
    """key, marked text[, text] -> key, ids[, whether the ids decode to the text], a few MB of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(loaded(data))
        decoder = Decoder(encoder.pieces)
        for batch in batches:
            body, at = text_buffers(batch.column(1))
            missing = np.asarray(batch.column(1).is_null())
            for lo, hi in chunks(at, 2 << 20):
                ids, cut = encoder.encode(body[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                out = [batch.column(0).slice(lo, hi - lo), _lists(ids, cut, missing[lo:hi])]
                if check:
                    own, off = text_buffers(batch.column(2).slice(lo, hi - lo))
                    own = own.tobytes()
                    out.append(pa.array([d == own[a:b] for d, (a, b) in zip(decoder.decode(ids, cut), pairwise(off.tolist()))], mask=missing[lo:hi]))
                yield pa.RecordBatch.from_arrays(out, names=["key", "ids", "round_trip"][: len(out)])

    return run


def _read(model: str) -> bytes:
    """The file's bytes, read by the driver; tasks get them with the function, a few hundred KB."""
    with open(model, "rb") as f:
        return f.read()


def _marked(text: str) -> Column:
    return F.when(col(text) == "", "").otherwise(F.concat(F.lit(" "), F.replace(col(text), F.lit(MARK), F.lit(" "))))


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids."""
    data = _read(model)

    def coded(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(loaded(data))
        for column in columns:
            body, at = text_buffers(column)
            parts = [encoder.encode(body[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]) for lo, hi in chunks(at, 2 << 20)]
            ends = np.concatenate([[0], *[np.diff(cut) for _, cut in parts]]).cumsum()
            yield _lists(np.concatenate([np.zeros(0, np.int32), *[i for i, _ in parts]]), ends, np.asarray(column.is_null()))

    return added(docs, {ids: F.arrow_udf(coded, "array<int>")(_marked(text))})


def encode_checked(docs: DataFrame, key: str = "doc_id", model: str = MODEL, text: str = "text") -> DataFrame:
    """(key, ids, round_trip): ids of every text, decoded again and compared with it (a mark in it counts as a blank)."""
    # three columns under names of their own: others can't clash with them
    rows = docs.select(col(key).alias("key"), _marked(text), F.replace(col(text), F.lit(MARK), F.lit(" ")))
    return rows.mapInArrow(_encoded(_read(model), True), f"key {docs.schema[key].dataType.simpleString()}, ids array<int>, round_trip boolean").withColumnRenamed("key", key)


def decode(docs: DataFrame, model: str = MODEL, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with a column of the texts that the ids stand for."""
    data = _read(model)

    def texts(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(loaded(data))
        for column in columns:
            cut = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())])
            own = column.flatten().to_numpy(zero_copy_only=False)
            out = [x for lo, hi in chunks(cut, 1 << 20) for x in decoder.decode(own[cut[lo] : cut[hi]], cut[lo : hi + 1] - cut[lo])]
            yield pa.array(list(map(_text, out)), pa.string(), mask=np.asarray(column.is_null()))

    return added(docs, {text: F.arrow_udf(texts, "string")(col(ids))})
