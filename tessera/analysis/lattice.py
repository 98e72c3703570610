"""Candidate arcs of a text.

What a stem can look like on the surface is described by derivations: each says which dictionary form may stand from a
place to another, and which letters the endings' key gains because of it. One loop joins every derivation with the
endings that follow.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

from ..functions.hangul import CODAS, FIRST, LAST, ONSETS, SINGLE_CODAS, VOWELS
from ..schema import CONTENT, FUNCTIONAL
from .model import Model

VERBS = frozenset({"VV", "VA", "VX"})
RUN = re.compile(r"(?P<SL>[A-Za-z](?:[A-Za-z0-9.\-]*[A-Za-z0-9])?)|(?P<SN>(?:(?<!\d)\d{4}|(?<!\d)\d{2})\.\d{1,2}\.(?:0\d|[12]\d|3[01]|\d)|\d+(?:[.,]\d+)*)", re.A)
#: Those runs, and single characters between them.
_PIECE = re.compile(RUN.pattern.replace(r"\d", "[0-9]") + r"|(?P<one>\S)")
_TYPES = {"SF": ".!?", "SP": ",;:/·", "SE": "…", "SO": "~-–−", "SS": "()[]{}\"'‘’“”<>―—「」『』〈〉《》"}
_KIND = {c: t for t, cs in _TYPES.items() for c in cs}
#: Letters taken for one another by mistake: places in the lists of onsets, vowels and codas.
_SLIPS = ([(0, 1), (3, 4), (7, 8), (9, 10), (12, 13)], [(1, 5), (3, 7), (10, 15), (10, 11)], [(1, 2), (19, 20)])
_ENDS = frozenset(".!?…")
_NO_SPAN = re.compile("만[한하해]|[는한건텐]데|을만|뿐이|수있|것[같이]|[어]줘|오너|이다가|이며|이라[고는]|이지만|였다|거[야예]|[봐줘]라|봐봐|줘줘|[봐줘래]요")


class Arc(NamedTuple):
    start: int
    end: int
    morphemes: tuple[tuple[str, str], ...]
    cost: float
    source: str


def parts(c: str) -> tuple[int, int, int] | None:
    """Places of a syllable's onset, vowel and coda."""
    off = ord(c) - FIRST
    return (off // 588, off % 588 // 28, off % 28) if FIRST <= ord(c) <= LAST else None


def whole(o: int, v: int, k: int = 0) -> str:
    return chr(FIRST + (o * 21 + v) * 28 + k)


def bright(v: int) -> bool:
    return VOWELS[v] in "ㅏㅗ"


def is_letter(c: str) -> bool:
    return "ㄱ" <= c <= "ㅣ"


def char_class(c: str) -> str:
    if c in _KIND:
        return _KIND[c]
    if c.isascii() and c.isalpha():
        return "SL"
    if c.isascii() and c.isdigit():
        return "SN"
    if "가" <= c <= "힣":
        return "NNG"
    return "SH" if "一" <= c <= "鿿" or "㐀" <= c <= "䶿" or "豈" <= c <= "﫿" else "SW"


def ascii_runs(text: str) -> list[tuple[int, int, str]]:
    """Latin and digit runs; a date is one run whose day takes two digits only where they are a day."""
    return [(m.start(), m.end(), m.lastgroup) for m in RUN.finditer(text)]


def pieces(word: str) -> list[tuple[int, int, str, str]]:
    """A word without Hangul or anything that a dictionary knows: (start, end, tag, kind of arc) of its only path."""
    return [(*m.span(), _class(m[0]), "oov") if m.lastgroup == "one" else (*m.span(), m.lastgroup, "run") for m in _PIECE.finditer(word)]


_class = lru_cache(1 << 12)(char_class)


class Derivation(NamedTuple):
    """A dictionary form from i to j. ``keys``: (what the endings' key begins with, place of its next character, least tail)."""

    lookup: str
    end: int
    tags: frozenset[str]
    keys: tuple[tuple[str, int, int], ...]
    mode: str = "word"  # how the stem is priced: its word cost, or bare with a credit for the whole arc
    source: str = ""


class Lattice:
    def __init__(self, model: Model, text: str, user: dict[str, tuple[str, int]] | None = None):
        self.m, self.text, self.n, self.user = model, text, len(text), user or {}

    def derivations(self, i: int) -> Iterator[Derivation]:
        text, n, words = self.text, self.n, self.m.words
        for j in range(i + 1, min(n, i + 8) + 1):
            head, p = text[i : j - 1], parts(text[j - 1])
            if p is None:
                continue
            o, v, k = p
            if k and (letter := CODAS[k]) in SINGLE_CODAS:  # a coda that begins the ending
                keys = [(letter, j, 0)]
                if letter == "ㅆ":
                    keys.append(("았" if bright(v) else "었", j, 0))
                yield Derivation(head + whole(o, v), j, CONTENT, tuple(keys), "word", "coda")
            back = None  # a vowel that holds stem and ending
            if ONSETS[o] == "ㅎ" and VOWELS[v] == "ㅐ" and CODAS[k] in (" ", "ㅆ"):
                back = ("하", "았" if k else "아")
            elif VOWELS[v] == "ㅕ" and CODAS[k] in (" ", "ㅆ"):
                back = (whole(o, 20), "었" if k else "어")
            if back and (k or j - i >= 2):
                yield Derivation(head + back[0], j, VERBS, ((back[1], j, 0),), "word", "vowel")
            if not k and j < n and (q := parts(text[j])) and ONSETS[q[0]] in "ㄴㅅ":  # a dropped ㄹ
                stem = head + whole(o, v, 8)
                if stem in words and not any(t in VERBS for t, _ in words.get(text[i:j], ())):
                    yield Derivation(stem, j, VERBS, (("", j, 1),), "bare", "drop")

    def endings(self, key: str, at: int, least: int) -> Iterator[tuple[str, int, tuple, float]]:
        """Codebook readings of key + the characters from ``at``: (whole key, end, morphemes, cost)."""
        m = self.m
        for tail in range(least, min(m.longest_suffix - len(key), self.n - at) + 1):
            whole_key = key + self.text[at : at + tail]
            for ms, freq in m.suffixes.get(whole_key, ()):
                yield whole_key, at + tail, ms, m.suffix_cost(whole_key, ms, freq)

    def keys_after(self, j: int) -> Iterator[tuple[str, int, int, str]]:
        """Ways an ending can begin after a plain stem that ends at j."""
        yield "", j, 1, "suffix"
        p = parts(self.text[j - 1])
        if p and not p[2]:
            yield ("아" if bright(p[1]) else "어"), j, 1, "contracted"
        q = parts(self.text[j])
        if q and q[2] and CODAS[q[2]] in SINGLE_CODAS:
            yield whole(q[0], q[1]) + CODAS[q[2]], j + 1, 0, "split"

    def helpers_at(self, j: int) -> Iterator[tuple[str, str, int, str]]:
        """A one-syllable verb fused with its ending at j: (form, tag, frequency, the ending's first syllable)."""
        q = parts(self.text[j])
        pair = q and {"ㅘ": ("ㅗ", "아", "았"), "ㅝ": ("ㅜ", "어", "었"), "ㅙ": ("ㅚ", "어", "었")}.get(VOWELS[q[1]])
        if pair and CODAS[q[2]] in (" ", "ㅆ"):
            form = whole(q[0], VOWELS.index(pair[0]))
            for t, f in self.m.words.get(form, ()):
                if t in VERBS:
                    yield form, t, f, pair[2] if q[2] else pair[1]

    def at(self, i: int) -> list[Arc]:
        """Arcs of dictionary words and endings from place i."""
        m, text, n, out = self.m, self.text, self.n, []
        for j in range(i + 1, min(n, i + m.longest_word) + 1):
            word = text[i:j]
            for pos, freq in m.words.get(word, ()):
                if pos not in CONTENT:
                    continue
                cost, stem = m.word_cost(word, pos, freq), ((word, pos),)
                out.append(Arc(i, j, stem, cost, "word"))
                out += [Arc(i, j, ((word, t),), m.word_cost(word, t, f), "ambiguity") for t, f in m.ambiguity.get(word, ()) if t != pos]
                if j == n:
                    continue
                for key, at, least, source in self.keys_after(j):
                    out += [Arc(i, end, stem + ms, cost + c, source) for _, end, ms, c in self.endings(key, at, least)]
                for form, t, f, ending in self.helpers_at(j):
                    out += [Arc(i, end, stem + ((form, t),) + ms, cost + m.bare_cost(f) + c, "helper") for _, end, ms, c in self.endings(ending, j + 1, 0)]
        for d in self.derivations(i):
            for pos, freq in m.words.get(d.lookup, ()):
                if pos not in d.tags:
                    continue
                for key, at, least in d.keys:
                    for _, end, ms, c in self.endings(key, at, least):
                        stem_cost = m.word_cost(d.lookup, pos, freq) if d.mode == "word" else m.bare_cost(freq) - m.bonus * (end - i - 1)
                        if d.source == "coda" and d.end == i + 1 and key[0] == "ㄹ" and text[d.end : d.end + 1] == "만":
                            c -= 5.0
                        out.append(Arc(i, end, ((d.lookup, pos),) + ms, stem_cost + c, d.source))
        if not any(a.morphemes[0][1] in CONTENT for a in out):
            out += self.slips(i)
        for _, end, ms, c in self.endings("", i, 1):
            tags = [t for _, t in ms]
            if all(t in FUNCTIONAL for t in tags):
                out.append(Arc(i, end, ms, c, "functional"))
            elif len(ms) > 1 and not all(t in CONTENT for t in tags):
                out.append(Arc(i, end, ms, c, "mixed"))
        return out

    def slips(self, i: int) -> Iterator[Arc]:
        """Words with one letter taken for another, three dearer."""
        m, text = self.m, self.text
        for j in range(i + 1, min(self.n, i + 6) + 1):
            for k in range(i, j):
                p = parts(text[k])
                for slot, pairs in enumerate(_SLIPS if p else ()):
                    for other in [b if p[slot] == a else a for a, b in pairs if p[slot] in (a, b)]:
                        word = text[i:k] + whole(*p[:slot], other, *p[slot + 1 :]) + text[k + 1 : j]
                        for e in range(1, len(word) + 1):
                            for pos, freq in m.words.get(word[:e], ()):
                                if pos in CONTENT:
                                    cost = m.word_cost(word[:e], pos, freq) + 3.0
                                    if e == len(word):
                                        yield Arc(i, j, ((word, pos),), cost, "slip")
                                    for ms, f in m.suffixes.get(word[e:], ()) if e < len(word) else ():
                                        yield Arc(i, j, ((word[:e], pos),) + ms, cost + m.suffix_cost(word[e:], ms, f), "slip")
                        for ms, f in m.suffixes.get(word, ()):
                            yield Arc(i, j, ms, m.suffix_cost(word, ms, f) + 3.0, "slip")

    def arcs(self) -> list[Arc]:
        m, text, n = self.m, self.text, self.n
        out: list[Arc] = []
        for a, b, tag in ascii_runs(text):
            run = text[a:b]
            out.append(Arc(a, b, ((run, tag),), m.word_cost(run, tag, 1000), "run"))
            if (known := m.words.get(run)) and known[0][0] != tag:
                out.append(Arc(a, b, ((run, known[0][0]),), m.word_cost(run, known[0][0], max(100, known[0][1])), "run"))
        for i in range(n):
            if "가" <= text[i] <= "힣" or text[i] in m.first:  # nothing else can begin a word or an ending
                out += self.at(i)
        out += [Arc(k.start(), k.end(), (("이", "VCP"), ("ㅂ니" + k.group()[2], "EF")), -1.0, "copula") for k in re.finditer("입니[다까]", text)]
        out += self.finals(out)
        for w in re.finditer(r"\S+", text):
            if 3 <= len(w.group()) <= 7 and all("가" <= c <= "힣" for c in w.group()) and not _NO_SPAN.search(w.group()):
                out.append(Arc(w.start(), w.end(), ((w.group(), "NNG"),), m.oov * 2.8 * math.sqrt(len(w.group())), "span"))
            for word in self.user and {w.group()[a:b] for a in range(len(w.group())) for b in range(a + 1, len(w.group()) + 1)} & self.user.keys():
                pos, freq = self.user[word]
                out += [Arc(w.start() + k.start(), w.start() + k.start() + len(word), ((word, pos),), m.word_cost(word, pos, freq), "user") for k in re.finditer(f"(?={re.escape(word)})", w.group())]
        begun = {a.start for a in out}
        out += [Arc(i, i + 1, ((c, char_class(c)),), m.oov, "oov") for i, c in enumerate(text) if i not in begun and not c.isspace()]
        best: dict[tuple, Arc] = {}
        for a in out:
            key = a[:3]
            if key not in best or a.cost < best[key].cost:
                best[key] = a
        return list(best.values()) + self.cached()

    def finals(self, arcs: list[Arc]) -> list[Arc]:
        """Connecting endings before the end of a sentence as final ones, half a unit cheaper."""
        text = self.text
        last = len(text.rstrip())
        stops = {i for i, c in enumerate(text) if c in _ENDS or is_letter(c)}
        out = []
        for a in arcs:
            form, tag = a.morphemes[-1]
            if tag == "EC" and (a.end in stops or (a.end == last and form in ("어", "아"))):
                out.append(a._replace(morphemes=a.morphemes[:-1] + ((form, "EF"),), cost=a.cost - 0.5, source="final"))
        return out

    def cached(self) -> list[Arc]:
        """Readings of whole words; a connecting ending is a weak one at the end of the sentence."""
        out = []
        for w in re.finditer(r"\S+", self.text):
            if ms := self.m.cache.get(w.group()):
                at_end = all(c in _ENDS or is_letter(c) or c.isspace() for c in self.text[w.end() :])
                out.append(Arc(w.start(), w.end(), ms, -0.5 if at_end and ms[-1][1] == "EC" else -2.0, "cache"))
        return out
