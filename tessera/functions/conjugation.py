"""Conjugated forms of stems for the suffix codebook, as Column expressions over a small table of endings.

A stem row meets nine endings; each class of irregular stems gives the surface of stem and ending, or null where the
class has none. All of it is syllable arithmetic: 0xAC00 + (onset * 21 + vowel) * 28 + coda.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hangul import FIRST, LAST, code_point, from_code_point

#: Endings and their tags; of two tags the first takes one character.
ENDINGS = [("어", "EC"), ("어서", "EC"), ("어야", "EC"), ("었", "EP"), ("었다", "EP+EF"), ("은", "ETM"), ("을", "ETM"), ("으니", "EC"), ("으면", "EC")]
DIGEUT = ("걷", "듣", "묻", "싣", "깨닫", "일컫", "걷잡")
SIOT = ("짓", "젓", "긋", "낫", "붓")
HIEUT = ("빨갛", "파랗", "노랗", "하얗", "까맣", "그렇", "이렇", "저렇", "어떻", "아무렇", "누렇", "허옇", "시뻘겋", "뻘겋", "벌겋", "발갛", "새빨갛", "시퍼렇", "퍼렇")
_A, _AE, _EO, _YEO, _O, _WA, _U, _WO, _EU, _I = 0, 1, 4, 6, 8, 9, 13, 14, 18, 20
_N, _D, _R, _B, _S, _SS, _H = 4, 7, 8, 17, 19, 20, 27
_BRIGHT = (_A, _O, _WA)


def _at(s: Column, back: int) -> Column:
    """The character ``back`` from the end; '' before the start."""
    return F.when(F.length(s) >= back, F.substring(s, -back, 1)).otherwise("")


def _parts(c: Column) -> tuple[Column, Column, Column]:
    """Onset, vowel and coda numbers, null for no syllable."""
    off = F.when(code_point(c).between(FIRST, LAST), code_point(c) - FIRST)
    return F.floor(off / 588), F.floor(off % 588 / 28), off % 28


def _syllable(onset: Column, vowel: Column | int, coda: Column | int = 0) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    return from_code_point((FIRST + (onset * 21 + lit(vowel)) * 28 + lit(coda)).cast("bigint"))


def irregular(stem: Column, pos: Column, ending: Column) -> dict[str, Column]:
    """Surface of stem and ending by class of stem; null where the class doesn't apply."""
    n, e, rest = F.length(stem), F.substring(ending, 1, 1), F.substring(ending, F.lit(2), F.length(ending))
    o, v, k = _parts(_at(stem, 1))
    o2, v2, k2 = _parts(_at(stem, 2))
    head, head2 = F.substring(stem, F.lit(1), n - 1), F.substring(stem, F.lit(1), n - 2)
    bright, bright2 = v.isin(*_BRIGHT), F.coalesce(v2.isin(*_BRIGHT), F.lit(False))
    adjective = pos == "VA"
    eo, eot, eu = e == "어", e == "었", e.isin("은", "을", "으")
    short = F.concat(head, _syllable(o, v))  # without its coda
    rounded = stem.isin("곱", "돕")
    b = (
        F.when(eo, F.concat(short, F.when(rounded, "와").otherwise("워"), rest)).when(e == "은", F.concat(short, F.lit("운"), rest)).when(e == "을", F.concat(short, F.lit("울"), rest))
        .when(e == "으", F.concat(short, F.lit("우"), rest)).when(eot, F.concat(short, F.when(rounded, "왔").otherwise("웠"), rest))
    )
    with_r = F.concat(head, _syllable(o, v, _R))
    d = F.when(eot & ~stem.isin("듣", "묻"), F.concat(with_r, F.when(bright, "았").otherwise("었"), rest)).when(~eot, F.concat(with_r, ending))
    s = F.when(eo, F.concat(short, F.when(bright, "아").otherwise("어"), rest)).when(eot, F.concat(short, F.when(bright, "았").otherwise("었"), rest)).otherwise(F.concat(short, ending))
    doubled = F.concat(head2, _syllable(o2, v2, _R))
    r = F.when(eo, F.concat(doubled, F.when(bright2, "라").otherwise("러"), rest)).when(eot, F.concat(doubled, F.when(bright2, "랐").otherwise("렀"), rest)).otherwise(F.concat(stem, ending))
    new = F.when((n >= 2) & bright2, F.lit(_A)).otherwise(F.lit(_EO))
    u = F.when(eo, F.concat(head, _syllable(o, new), rest)).when(eot, F.concat(head, _syllable(o, new, _SS), rest)).otherwise(F.concat(stem, ending))
    h = (
        F.when(eo, F.concat(head, _syllable(o, _AE), rest)).when(eot, F.concat(head, _syllable(o, _AE), ending)).when(e == "은", F.concat(head, _syllable(o, v, _N), rest))
        .when(e == "을", F.concat(head, _syllable(o, v, _R), rest)).when(e == "으", F.concat(short, rest))
    )
    is_b, is_d, is_s = adjective & (k == _B), (k == _D) & stem.isin(*DIGEUT), (k == _S) & stem.isin(*SIOT)
    is_r = (n >= 2) & (k == 0) & (v == _EU) & (o == 5)
    is_u = (k == 0) & (v == _EU) & (o != 5)
    is_h = adjective & (k == _H) & stem.isin(*HIEUT)
    return {"b": F.when(is_b, b), "d": F.when(is_d, d), "s": F.when(is_s, s), "r": F.when(is_r & (k2 == 0), r), "u": F.when(is_u, u), "h": F.when(is_h, h)}


def contracted(stem: Column, freq: Column, ending: Column) -> Column:
    """Open stems of two syllables or more whose last vowel fuses with 어 or 었; rare stems have none."""
    n, e, rest = F.length(stem), F.substring(ending, 1, 1), F.substring(ending, F.lit(2), F.length(ending))
    o, v, k = _parts(_at(stem, 1))
    fused = F.when(v == _I, F.lit(_YEO)).when(v == _U, F.lit(_WO)).when(v == _O, F.lit(_WA))
    coda = F.when(e == "었", F.lit(_SS)).otherwise(F.lit(0))
    ok = (n >= 2) & (freq >= F.when(n >= 3, 5).otherwise(30)) & (k == 0) & e.isin("어", "었") & fused.isNotNull()
    return F.when(ok, F.concat(F.substring(stem, F.lit(1), n - 1), _syllable(o, fused, coda), rest))


def conjugations(stems: DataFrame) -> DataFrame:
    """(surface, stem, pos, ending, freq) of every conjugated form of stems (stem, pos VV or VA, freq).

    A stem with several rows counts with its most frequent one. Freq is at least 100; of equal forms the greatest stays.
    """
    best = stems.where(F.col("pos").isin("VV", "VA") & (F.length("stem") > 0)).groupBy("stem").agg(F.max_by("pos", F.struct("freq", F.expr("pos = 'VV'"))).alias("pos"), F.max("freq").alias("freq"))
    endings = F.explode(F.array(*map(F.lit, [e for e, _ in ENDINGS]))).alias("ending")
    rows = best.select("stem", "pos", "freq", endings)
    forms = [*irregular(F.col("stem"), F.col("pos"), F.col("ending")).values(), contracted(F.col("stem"), F.col("freq"), F.col("ending"))]
    made = rows.select("stem", "pos", "ending", F.greatest("freq", F.lit(100)).alias("freq"), F.explode(F.array_compact(F.array(*forms))).alias("surface"))
    return made.groupBy("surface", "stem", "pos", "ending").agg(F.max("freq").alias("freq"))


def readings(made: DataFrame) -> DataFrame:
    """Conjugations as codebook rows: (surface, morphemes, freq)."""
    e = F.col("ending")
    one = lambda form, tag: F.struct(form.alias("form"), F.lit(tag).alias("pos"))
    tags = {x: t for x, t in ENDINGS}
    after = F.when(e == "었다", F.array(one(F.lit("었"), "EP"), one(F.lit("다"), "EF")))
    for x, t in tags.items():
        if x != "었다":
            after = after.when(e == x, F.array(one(e, t)))
    return made.select("surface", F.concat(F.array(F.struct(F.col("stem").alias("form"), F.col("pos").alias("pos"))), after).alias("morphemes"), "freq")


def merged_codebook(old: DataFrame, new: DataFrame) -> DataFrame:
    """Codebook rows of both; of equal (surface, morphemes) the greater frequency."""
    return old.unionByName(new).groupBy("surface", "morphemes").agg(F.max("freq").alias("freq"))


def frequent(codebook: DataFrame, least: int = 75, least_with_letters: int = 5) -> DataFrame:
    """Rows frequent enough; endings that are or hold single letters need less."""
    letters = F.exists("morphemes", lambda m: m["form"].rlike("[ㄱ-ㅎᆨ-ᇂ]"))
    return codebook.where((F.col("freq") >= least) | ((F.col("freq") >= least_with_letters) & letters))
