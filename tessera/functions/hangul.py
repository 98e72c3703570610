"""Hangul syllable arithmetic as Column expressions. A syllable is 0xAC00 + (onset * 21 + vowel) * 28 + coda."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ONSETS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
CODAS = " ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
FIRST, LAST = 0xAC00, 0xD7A3
#: Conjoining forms and the compatibility letters they look like.
JOINING_ONSETS = "".join(map(chr, range(0x1100, 0x1113)))
JOINING_VOWELS = "".join(map(chr, range(0x1161, 0x1176)))
JOINING_CODAS = "".join(map(chr, range(0x11A8, 0x11C3)))
SINGLE_CODAS = "ㄱㄲㄴㄷㄹㅁㅂㅅㅆㅇㅈㅊㅋㅌㅍㅎ"


def code_point(c: Column) -> Column:
    return F.ascii(c)


def from_code_point(cp: Column) -> Column:
    """The character of a code point from U+0800 to U+FFFF (``chr`` is modulo 256), by its three UTF-8 bytes."""
    byte = lambda lead, shift, mask: F.hex((F.lit(lead) + F.shiftright(cp, shift).bitwiseAND(F.lit(mask))).cast("bigint"))
    return F.decode(F.unhex(F.concat(byte(224, 12, 15), byte(128, 6, 63), byte(128, 0, 63))), "UTF-8")


def is_syllable(c: Column) -> Column:
    return (F.length(c) == 1) & code_point(c).between(FIRST, LAST)


def decompose(c: Column) -> Column:
    """struct(onset, vowel, coda) of a syllable, coda '' where it has none; null for anything else."""
    off = code_point(c) - FIRST
    letter = lambda letters, k: F.substring(F.lit(letters), (k + 1).cast("int"), F.lit(1))
    coda = F.trim(letter(CODAS, off % 28))
    return F.when(is_syllable(c), F.struct(letter(ONSETS, F.floor(off / 588)).alias("onset"), letter(VOWELS, F.floor(off % 588 / 28)).alias("vowel"), coda.alias("coda")))


def compose(onset: Column, vowel: Column, coda: Column) -> Column:
    """The syllable of three letters ('' or null for no coda); null where one is not such a letter."""
    place = lambda letters, c: F.instr(F.lit(letters), c)
    o, v = place(ONSETS, onset), place(VOWELS, vowel)
    k = F.when(F.coalesce(coda, F.lit("")) == "", F.lit(1)).otherwise(place(CODAS, coda))
    ok = (F.length(onset) == 1) & (F.length(vowel) == 1) & (F.length(F.coalesce(coda, F.lit(""))) <= 1) & (o > 0) & (v > 0) & (k > 0)
    return F.when(ok, from_code_point(FIRST + ((o - 1) * 21 + v - 1) * 28 + k - 1))


def split_coda(c: Column) -> Column:
    """struct(open, coda) of a syllable with a single-letter coda; null otherwise."""
    d = decompose(c)
    return F.when((d["coda"] != "") & (F.instr(F.lit(SINGLE_CODAS), d["coda"]) > 0), F.struct(compose(d["onset"], d["vowel"], F.lit("")).alias("open"), d["coda"].alias("coda")))


def attach_coda(c: Column, coda: Column) -> Column:
    """An open syllable with a coda put on; null where the syllable is closed or the coda isn't one."""
    d = decompose(c)
    return F.when((d["coda"] == "") & (F.length(coda) == 1) & (F.instr(F.lit(CODAS.strip()), coda) > 0), compose(d["onset"], d["vowel"], coda))


def to_compat(c: Column) -> Column:
    """All conjoining letters as compatibility letters."""
    return F.translate(c, JOINING_ONSETS + JOINING_VOWELS + JOINING_CODAS, ONSETS + VOWELS + CODAS.strip())


def codas_to_compat(c: Column) -> Column:
    """Conjoining single codas as compatibility letters; clusters stay."""
    singles = "".join(j for j, k in zip(JOINING_CODAS, CODAS.strip()) if k in SINGLE_CODAS)
    return F.translate(c, singles, SINGLE_CODAS)


def lead_to_joining(c: Column) -> Column:
    """A leading compatibility coda as the conjoining one."""
    return F.concat(F.translate(F.substring(c, 1, 1), CODAS.strip(), JOINING_CODAS), F.substring(c, F.lit(2), F.length(c)))
