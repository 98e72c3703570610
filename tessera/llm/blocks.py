"""Vectorised words and hashes over Arrow text columns, without a Python loop per row or word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 1024, dtype=np.uint64) | np.uint64(1)
_C1, _C2, _C3 = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15))
_S29, _S32, _S33 = np.uint64(29), np.uint64(32), np.uint64(33)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space and ASCII punctuation.
BREAK = SPACE.copy()
BREAK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches the high bits."""
    x = x ^ (x >> _S33)
    x *= _C1
    x ^= x >> _S29
    x *= _C2
    x ^= x >> _S32
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _C3 + b)


def shifted(a: np.ndarray, by: int) -> np.ndarray:
    """``a[i + by]`` at i, 0 past the end."""
    if not by:
        return a
    out = np.zeros_like(a)
    if by < len(a):
        out[:-by] = a[by:]
    return out


def window_hash(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of ``words[i : i + width]`` at each i, by doubling; the last width - 1 values mean nothing."""
    out, done, power, size, left = None, 0, words, 1, width
    while left:
        if left & 1:
            part = shifted(power, done)
            out = part if out is None else pair(out, part)
            done += size
        left >>= 1
        if left:
            power = pair(power, shifted(power, size))
            size *= 2
    return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each text begins in them (one more at the end); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def chunks(at: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``most`` bytes each; a longer text is a run by itself."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """Words of a run of texts: byte spans, owner offsets and 64-bit hashes."""

    def __init__(self, body: np.ndarray, at: np.ndarray, breaks: np.ndarray = SPACE):
        self.body, self.at = body, at
        inside = ~breaks[body]
        before = np.zeros(len(body), bool)
        before[1:] = inside[:-1]
        heads = at[:-1][at[:-1] < len(body)]
        before[heads] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(body), bool)
        after[:-1] = inside[1:]
        tails = at[1:][at[1:] > 0] - 1
        after[tails] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        #: Words of text k are first[k] : first[k + 1].
        self.first = np.searchsorted(self.starts, at)
        lens = self.ends - self.starts
        if len(lens):
            heads = np.zeros(len(lens), np.int64)
            np.cumsum(lens[:-1], out=heads[1:])
            places = (np.arange(int(lens.sum())) - np.repeat(heads, lens)) & 1023
            self.hashes = mix(np.add.reduceat(_BYTE[body[inside]] * _PLACE[places], heads))
        else:
            self.hashes = np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.starts)


def word_runs(column: pa.Array, breaks: np.ndarray = SPACE, most: int = 4 << 20) -> Iterator[tuple[int, int, Words]]:
    """(first row, row past the last, words) for runs of rows of a text column."""
    body, at = text_buffers(column)
    for lo, hi in chunks(at, most):
        yield lo, hi, Words(body[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], breaks)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
