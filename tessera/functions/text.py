"""Text functions as Column expressions: character classes, words, normalisation, cleaning, tag maps."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import TAGS

#: Tag of a character that no dictionary knows, tried in this order.
_CLASSES = [
    ("SF", "[.!?]"),
    ("SP", "[,;:/·]"),
    ("SE", "…"),
    ("SO", "[~\\-–−]"),
    ("SS", "[()\\[\\]{}\"'‘’“”<>―—「」『』〈〉《》]"),
    ("SL", "[A-Za-z]"),
    ("SN", "[0-9]"),
    ("NNG", "[가-힣]"),
    ("SH", "[一-鿿㐀-䶿豈-﫿]"),
]


#: White space in Unicode's sense, as (?U)\\s takes it; that of Python's \\s has separators of records more.
_BLANK = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def char_class(c: Column) -> Column:
    return reduce(lambda w, k: w.when(c.rlike("^" + k[1] + "$"), k[0]), _CLASSES[1:], F.when(c.rlike("^" + _CLASSES[0][1] + "$"), _CLASSES[0][0])).otherwise("SW")


def eojeols(text: Column) -> Column:
    """Words between white space in Unicode's sense."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def collapse_key(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s", "")


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def hangul_ratio(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit("[가-힣]")) / F.length(text)).otherwise(F.lit(0.0))


def is_korean_sentence(text: Column) -> Column:
    n = F.length(F.trim(text))
    return n.between(5, 200) & (hangul_ratio(F.trim(text)) >= 0.6)


def is_wiki_sentence(text: Column) -> Column:
    return (F.length(text) >= 20) & text.rlike("[.!?]$") & (hangul_ratio(text) >= 0.5)


_SENTENCE_END = re.compile(f"([.!?…][{_BLANK}]+)(?=[가-힣A-Z\"'(\\[{{])")


def segments(text: Column) -> Column:
    """array<struct<text, start>>: trimmed sentences, and where each begins in the text, blanks included, in characters.

    A sentence ends at terminators before white space and Hangul, a capital, a quote or an opening bracket. One pass over
    the text: column functions would cut it and add up lengths again for each sentence.
    """
    return F.arrow_udf(_segments, "array<struct<text:string,start:int>>")(text)


def _segments(texts: pa.Array) -> pa.Array:
    found: list[str | None] = []
    starts: list[int] = []
    offsets = [0]
    for t in texts.to_pylist():
        at = 0
        for s in () if t is None else _SENTENCE_END.sub("\\1\x01", t).split("\x01"):
            if x := s.strip(_BLANK):
                found.append(x)
                starts.append(at)
            at += len(s)
        if len(found) == offsets[-1]:
            found.append(None if t is None else t.strip(_BLANK))
            starts.append(0)
        offsets.append(len(found))
    rows = pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(starts, pa.int32())], ["text", "start"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)


def composed(text: Column) -> Column:
    """Unicode's composed form (NFC); Spark has no built-in for it."""

    @F.arrow_udf("string")
    def nfc(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in column.to_pylist()], pa.string())

    # what is ASCII is composed already and never leaves the JVM
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(nfc(text))


def sentences(text: Column) -> Column:
    """Trimmed parts after a terminator and a blank, or after a polite ending before Hangul."""
    parts = F.split(text, r"(?<=[.!?])\s+|(?<=[다요죠])\s+(?=[가-힣])")
    return F.filter(F.transform(parts, F.trim), lambda s: s != "")


#: Chat abbreviations and dialect forms that ``normalize`` can expand.
ABBREVIATIONS = dict(zip("ㄱㅅ ㅊㅋ ㄴㄴ ㅂㅂ ㅈㅅ ㄱㅊ ㅇㅈ ㅎㅇ ㄹㅇ ㅇㅋ ㅁㄹ ㅅㄱ ㅊㅊ ㅍㅌ ㄷㄷ".split(), "감사 축하 노노 바이바이 죄송 괜찮 인정 하이 리얼 오케이 모름 수고 추천 파이팅 덜덜".split()))
DIALECT = dict(zip("워디 와케 우예 긍게 워메 가유 허유".split(), "어디 왜이렇게 어떻게 그러니까 어머 가요 해요".split()))


def normalize(text: Column, letters: bool = True, abbreviations: bool = False, dialect: bool = False) -> Column:
    """Runs of three or more equal letters become two; listed abbreviations apart from Hangul, and dialect forms, are replaced."""
    if letters:
        text = F.regexp_replace(text, r"([ㄱ-ㅣ])\1{2,}", "$1$1")
    for short, full in ABBREVIATIONS.items() if abbreviations else ():
        text = F.regexp_replace(text, f"(?<![가-힣ㄱ-ㅣ]){short}(?![가-힣ㄱ-ㅣ])", full)
    for form, standard in DIALECT.items() if dialect else ():
        text = F.regexp_replace(text, form, standard)
    return text


#: Other analyzers' tags as tags of the common set.
TAG_MAPS = {
    "kkma": dict(OH="SH", OL="SL", ON="SN", NNM="NNB", JKM="JKB", VXV="VX", VXA="VX", MDT="MM", MDN="MM", ETD="ETM", UN="UNKNOWN", **{"EF" + x: "EF" for x in "NIQOAR"}, **{"EP" + x: "EP" for x in "THP"}, **{"EC" + x: "EC" for x in "DES"}),
    "kiwi": {"SSO": "SS", "SSC": "SS"},
    "mecab": {"SY": "SW", "SSO": "SS", "SSC": "SS", "SC": "SP", "NNBC": "NNB"},
}


def first_tag(tag: Column) -> Column:
    """The first of joined tags."""
    return F.substring_index(tag, "+", 1)


def map_tag(tag: Column, table: dict[str, str], fallback: Column | None = None) -> Column:
    keys = F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) if table else F.lit(None)
    return F.coalesce(F.element_at(keys, tag) if table else F.lit(None).cast("string"), tag if fallback is None else fallback)


#: Tags of the nested corpora that the common set writes otherwise.
CORPUS_TAGS = {"MMD": "MM", "MMN": "MM", "MMA": "MM", "NA": "NNG", "NAP": "NNG", "NF": "NNG", "NV": "VV"}


def corpus_tag(tag: Column, listed: bool = True, by_letter: bool = True) -> Column:
    """A corpus tag in the common set: as it is, listed, up to a hyphen, by its first letter, else SW."""
    base = F.substring_index(tag, "-", 1)
    w = F.when(tag.isin(*TAGS), tag)
    for k, v in CORPUS_TAGS.items() if listed else ():
        w = w.when(tag == k, v)
    w = w.when(base.isin(*TAGS), base)
    for k, v in zip("VNJEX", ("VV", "NNG", "JX", "EF", "XR")) if by_letter else ():
        w = w.when(tag.startswith(k), v)
    return w.otherwise("SW")
