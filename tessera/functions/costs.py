"""Costs, quantisers and hashes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CONTENT


def word_cost(surface: Column, pos: Column, freq: Column, max_freq: float, length_bonus: float = 1.5, single: float = 3.5, oov: float = 4.75) -> Column:
    n, base = F.length(surface), F.log(F.lit(float(max_freq)) / freq)
    known = F.when(n > 1, base - length_bonus * (n - 1)).when(pos.isin(*sorted(CONTENT)), base + single).otherwise(base)
    return F.when(freq > 0, known).otherwise(F.lit(oov))


def suffix_cost(key: Column, n_morphemes: Column, freq: Column, max_freq: float, penalty: float = 0.25, length_bonus: float = 1.5) -> Column:
    base = F.log(F.lit(float(max_freq)) / F.greatest(freq, F.lit(1))) + penalty * n_morphemes
    return F.when(F.length(key) > 1, base - length_bonus * (F.length(key) - 1)).otherwise(base)


def freq_from_score(score: Column, max_freq: float) -> Column:
    return (F.lit(float(max_freq)) * F.exp(-score)).cast("bigint")


def backoff(trigram: Column, bigram: Column, default: float) -> Column:
    """A missing trigram takes the bigram's cost, a missing bigram the default, each with 2 added."""
    return F.coalesce(F.nullif(trigram, F.lit(0.0)), F.nullif(bigram, F.lit(0.0)) + 2, F.lit(default + 2.0))


def quantize_linear(freq: Column, top: Column) -> Column:
    """16 bits in proportion to the greatest frequency, at least 1."""
    return F.greatest(F.lit(1), F.least(F.lit(65535), F.floor(freq / top * 65535 + 0.5))).cast("int")


def quantize_log(freq: Column, top: Column) -> Column:
    """8 bits of log frequency."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.log(F.greatest(freq, F.lit(1))) / F.log(top) * 255 + 0.5))).cast("int")


def quantize_range(x: Column, low: Column, high: Column) -> Column:
    """8 bits between the least and greatest value; 0 stands for absent, so values start at 1."""
    return (F.lit(1) + F.floor((x - low) / (high - low) * 254 + 0.5)).cast("int")


def bonus(shift: Column) -> Column:
    """A context rule's bonus: eight times its shift, at most 5, in steps of 1/25."""
    return F.round(F.least(F.lit(5.0), shift * 8) * 25) / 25


def feature_bucket(feature: Column, bits: int = 20) -> Column:
    """FNV-1a of the UTF-8 bytes modulo 2^bits (bits up to 24): low bits of the product need no more than low bits."""
    mask = (1 << bits) - 1
    bytes_ = F.transform(F.sequence(F.lit(1), F.octet_length(feature)), lambda i: F.conv(F.hex(F.substring(F.encode(feature, "UTF-8"), i, F.lit(1))), 16, 10).cast("bigint"))
    seed = 0xCBF29CE484222325 & mask
    return F.when(F.octet_length(feature) == 0, F.lit(seed)).otherwise(F.aggregate(bytes_, F.lit(seed).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * F.lit(0x100000001B3 & mask)).bitwiseAND(F.lit(mask))))
