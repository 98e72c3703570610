"""Correction rules as data: a pattern over neighbouring tokens, where it must stand, and what it becomes.

A pattern is a string of items ``forms/tags`` (alternatives by ``|``, ``*`` for any). Items stand next to each other.
``word``: tokens of the pattern in one word, from item ``a`` to item ``b``. ``opens`` / ``closes``: the first / last of
those begins / ends its word (a final mark may follow for ``closes='mark'``). The result lists new tokens: ``@k`` keeps
item k, ``@k/TAG`` retags it, ``form/TAG`` is new and takes the span of the items replaced.
Rules work from left to right on the tokens as rewritten so far.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

from ..functions.hangul import CODAS
from .lattice import bright, parts


class Token(NamedTuple):
    text: str
    pos: str
    start: int
    end: int


NOUN = "NNG|NNP|NNB|NR|NP"
NOMINAL = NOUN + "|SN|SL"
SUBJECT = NOMINAL + "|XSN"
VERB = "VV|VA|VX"

_KEPT = re.compile(r"@(\d+)(?:/(\w+))?")
Item = tuple[frozenset[str] | None, frozenset[str] | None]


def _item(text: str) -> Item:
    forms, _, tags = text.rpartition("/")
    return (None if forms in ("", "*") else frozenset(forms.split("|")), None if tags == "*" else frozenset(tags.split("|")))


@dataclass
class Rule:
    name: str
    pattern: str
    result: str
    word: tuple[int, int] | None = None
    opens: bool = False
    closes: str | None = None
    when: Callable[[list[Token], int], bool] | None = None
    optional: bool = False  # whether the last item may be missing at the end of the text

    def __post_init__(self):
        self.items = [_item(x) for x in self.pattern.split()]
        self.new = self.result.split()
        #: What a text must hold for the rule to apply at all: forms of one item, or tags where no item names forms.
        self.needs = min((forms for forms, _ in self.items if forms), key=len, default=None)
        self.needs_tags = min((tags for _, tags in self.items if tags), key=len, default=None)

    def possible(self, forms: set[str], tags: set[str]) -> bool:
        return (self.needs is None or not self.needs.isdisjoint(forms)) and (self.needs_tags is None or not self.needs_tags.isdisjoint(tags))

    def fits(self, t: list[Token], i: int) -> bool:
        n = len(self.items)
        if i + n > len(t):
            return False
        for (forms, tags), x in zip(self.items, t[i : i + n]):
            if (tags is not None and x.pos not in tags) or (forms is not None and x.text not in forms):
                return False
        a, b = self.word or (0, 0)
        if self.word and any(t[i + k].start != t[i + a].start for k in range(a, b + 1)):
            return False
        if self.opens and i + a > 0 and t[i + a - 1].start == t[i + a].start:
            return False
        e = i + b + 1
        if self.closes and e < len(t) and t[e].start == t[i + b].start and not (self.closes == "mark" and t[e].pos == "SF"):
            return False
        return self.when is None or self.when(t, i)

    def at(self, t: list[Token], i: int) -> None:
        """Rewrite the tokens from place i, which the rule fits."""
        own = t[i : i + len(self.items)]
        kept = {int(m[1]) for x in self.new if (m := _KEPT.fullmatch(x))}
        gone = [x for k, x in enumerate(own) if k not in kept] or own
        made = []
        for x in self.new:
            if m := _KEPT.fullmatch(x):
                made.append(own[int(m[1])]._replace(pos=m[2]) if m[2] else own[int(m[1])])
            else:
                form, _, tag = x.rpartition("/")
                if "@" in form:  # a form made of the items' forms
                    for k in range(len(own)):
                        form = form.replace(f"@{k}", own[k].text)
                made.append(Token(form, tag, gone[0].start, gone[-1].end))
        t[i : i + len(own)] = made

    def apply(self, t: list[Token]) -> bool:
        i, changed = 0, False
        while i < len(t):
            if self.fits(t, i):
                self.at(t, i)
                changed = True
            i += 1
        return changed


def _coda(form: str) -> str:
    p = parts(form[-1]) if form else None
    return CODAS[p[2]].strip() if p else "?"


def _harmony(form: str) -> str:
    p = parts(form[-1]) if form else None
    return "아" if p and bright(p[1]) else "어"


def _no_bright(t: list[Token], i: int) -> bool:
    return _harmony(t[i].text) == "어"


def _ends_text(t: list[Token], i: int) -> bool:
    return i == len(t) - 1 or (i == len(t) - 2 and t[i + 1].pos == "SF")


def _starts_clause(t: list[Token], i: int) -> bool:
    return i == 0 or t[i - 1].pos in ("SF", "SP", "SS", "SE")


def _after(tags: str, yes: bool = True) -> Callable[[list[Token], int], bool]:
    s = frozenset(tags.split("|"))
    return lambda t, i: (i > 0 and t[i - 1].pos in s) == yes


def _one(k: int, more: Callable[[list[Token], int], bool] | None = None) -> Callable[[list[Token], int], bool]:
    return lambda t, i: len(t[i + k].text) == 1 and (more is None or more(t, i))


def _own_length(n: int) -> Callable[[list[Token], int], bool]:
    return lambda t, i: t[i].end - t[i].start == n


R = Rule
_COPULA = {"이" + x: x for x in "다 야 에요 요 거든 거든요 랍니다 래요 고 며 라 면 지만 니 니까 라서 라고 란 든 든지 나 던".split()} | {"인": "ㄴ", "일": "ㄹ"}
_PLURAL = "수|것|데|바|번|개|군|줄|뿐|채|척|듯|리|셈|나름|탓|만큼|법|대로|따름"
_COUNTER = "년|일|명|원|월|개|위|시|번|분|개월|달러|차|회|퍼센트|석|주년|권|건|호선|프로|박|년대"
_NUMERAL = "한|두|세|네|다섯|여섯|일곱|여덟|아홉|열|스물|몇|여러"
_FOLLOW = "NNG|NNP|NNB|NR|XR"

RULES: dict[str, list[Rule]] = {
    "auxiliary": [
        R("aux", "고|어|아/EC 있|없/VV|VA", "@0 @1/VX"),
        R("aux", "지|고|어야|아야/EC 하/VV", "@0 @1/VX"),
        R("aux", "어|아/EC 보|주|지|오|가|내|나|버리|놓|두|가지|달|말|드리|치|대|못하/VV", "@0 @1/VX"),
    ],
    "conjunction": [R("conj", f"*/{NOMINAL} 과|와|이랑|랑|하고/JKB */{NOMINAL}", "@0 @1/JC @2")],
    "bound_noun": [
        R("bound", f"*/ETM {_PLURAL}/NNG|VV", "@0 @1/NNB"),
        R("counter", f"*/SN|NR {_COUNTER}/NNG|XSN|NNP", "@0 @1/NNB"),
        R("counter", f"{_NUMERAL}/MM {_COUNTER}/NNG|XSN|NNP", "@0 @1/NNB"),
    ],
    "affix": [R("suffix", "*/NNG 성|형|적|식|계|권|화|률|율|급/NNG", "@0 @1/XSN"), R("prefix", "비|재|초|무|탈|반|불/NNG */NNG", "@0/XPN @1")],
    "determiner": [R("this", f"이|저/NP|JKS */{_FOLLOW}", "@0/MM @1", when=_starts_clause), R("new", f"새|각|온/NNG */{_FOLLOW}", "@0/MM @1")],
    "complement": [R("compl", "가|이/JKS 되|아니/*", "@0/JKC @1"), R("compl", "가|이/JKS */VCN", "@0/JKC @1")],
    "or": [R("or", f"*/{NOMINAL} 나|이나/JX */{NOMINAL}", "@0 @1/JC @2")],
    "bound_without": [R("free", "이|말/NNB", "@0/NNG", when=_after("ETM", False))],
    "lone_prefix": [
        R("lone", f"저/XPN */{_FOLLOW}", "@0/MM @1", when=lambda t, i: t[i].start != t[i + 1].start),
        R("lone", "저/XPN", "@0/NP", word=(0, 0), closes="end"),
        R("lone", f"*/{NOUN}|XSN 제/XPN", "@0 @1/XSN", when=lambda t, i: t[i].end == t[i + 1].end and (i + 2 == len(t) or t[i + 2].start != t[i + 1].start)),
        R("lone", "*/XPN", "@0/NNG", word=(0, 0), closes="end"),
    ],
    "final": [
        R("final", "다|니|자|으니|지/EC", "@0/EF", when=_ends_text),
        R("final", f"*/{VERB}|EP 어|아/EC", "@0 @1/EF", when=lambda t, i: _ends_text(t, i + 1)),
        R("final", f"*/{VERB} 라/EC", "@0 아라/EF", when=lambda t, i: _ends_text(t, i + 1) and not _no_bright(t, i)),
        R("final", f"*/{VERB} 라/EC", "@0 어라/EF", when=lambda t, i: _ends_text(t, i + 1)),
        R("final", "라/EC", "@0/EF", when=lambda t, i: i > 0 and _ends_text(t, i)),
    ],
    "imperative": [
        R("imp", f"*/{VERB} 라/EF", "@0 아라/EF", when=lambda t, i: t[i].text != "하" and parts(t[i].text[-1]) is not None and not _no_bright(t, i)),
        R("imp", f"*/{VERB} 라/EF", "@0 어라/EF", when=lambda t, i: t[i].text != "하" and parts(t[i].text[-1]) is not None),
    ],
    "come": [
        R("come", "오너/NNG 라|어라|라고|어라고/EF|EC", "오/VV 너라/EF", word=(0, 1), opens=True, closes="end", when=_own_length(3)),
        R("come", "오너/NNG 래/*", "오/VV 너래/EF", word=(0, 1), opens=True, closes="end", when=_own_length(3)),
    ],
    "eat_honorific": [R("hon", "드시/VV|VX", "들/VV 시/EP")],
    "copula": [R("cop", f"*/{SUBJECT} {form}/{tag}", f"@0 이/VCP {rest}/{tag}") for form, rest in _COPULA.items() for tag in ("EF", "EC", "ETM", "ETN")],
    "question_copula": [R("inga", f"*/{SUBJECT} 인가/NNG", "@0 이/VCP ㄴ가/EF", word=(0, 1), closes="mark")],
    "present_copula": [R("da", f"*/{SUBJECT} 다/JX", "@0 이/VCP 다/EF", word=(0, 1), closes="end")],
    "past_copula": [R("it", f"*/{NOUN}|XSN 잇/VV */EP", "@0 이/VCP @2", word=(0, 1))],
    "my": [R("my", "제/NP", "저/NP")],
    "me": [R("me", "절/VV 는/ETM", "저/NP 는/JX", word=(0, 1), opens=True, closes="end")],
    "noun_back": [
        R("back", "이/VCP ㄴ지/EC|EF", "인지/NNG", word=(0, 1), opens=True),
        R("back", "이/VCP 면/EC", "이면/NNG", word=(0, 1), opens=True),
        R("back", "이/MM 면/NNG", "이면/NNG", word=(0, 1), opens=True),
    ],
    "nde": [R("nde", "*/XSA|VA|VV|VX ㄴ/ETM 데/NNB", "@0 ㄴ데/EC", word=(1, 2))],
    "haeyo": [R("haeyo", "*/NNG 해/NNG 요/JX", "@0 하/XSV 아요/EF", word=(0, 2), closes="mark"), R("yo", f"*/{VERB}|EP|XSV|XSA 어|아/EC 요/JX", "@0 @1@2/EF", word=(0, 2), closes="mark")],
    "polite": [R("polite", f"*/{VERB}|EP|XSV|XSA|VCP|NNG|NNP|NNB|EC|EF|XSN 거든|나|은데|네|께|니깐|잖아|으니까|군|다면서|을게|랄까/EC|EF 요/JX", "@0 @1@2/EF", word=(0, 2), closes="mark")],
    "ending_pairs": [
        R("pair", f"{a}/{p} {b}/{q}", f"{a}{b}/{r}", word=(0, 1))
        for a, p, b, q, r in (x.split() for x in "어 EC 도 JX EC;아 EC 도 JX EC;어야 EC 지 EC EF;다 EF 더라 EF EF;었 EP 었 EP EP;ㄴ가 EF 요 JX EF;어 EC 라 EF EF;지만 EC 은 JX EC;ㄹ게 EF 요 JX EF;더군 EF 요 JX EF;을래 EF 요 JX EF;지만 EC 요 JX EF;ㄴ다 EF 더라 EF EF".split(";"))
    ],
    "adverb_copula": [
        R("ya", "*/MAG 야/JX", "@0 이/VCP 야/EF", word=(0, 1), closes="mark"),
        R("ya", "별로|정말|진짜|당연|확실|분명/* 야/JX", "@0/MAG 이/VCP 야/EF", word=(0, 1), opens=True, closes="end"),
        R("ya", "별|정|진|당|확|분/* 로|말|짜|연|실|명/* 야/JX", "@0@1/MAG 이/VCP 야/EF", word=(0, 2), opens=True, closes="end", when=lambda t, i: t[i].text + t[i + 1].text in ("별로", "정말", "진짜", "당연", "확실", "분명")),
    ],
    "what_time": [R("when", "몇/MM|NR 시야/NNG", "@0 시/NNB 이/VCP 야/EF", word=(1, 1), closes="mark", when=lambda t, i: t[i].start != t[i + 1].start and _ends_text(t, i + 1))],
    "degree": [
        R("deg", "*/SN 도예/NNG 요/JX", "@0 도/NNB 이/VCP 예요/EF"),
        R("deg", "*/SN 도예/NNG 어요|아요/EF", "@0 도/NNB 이/VCP 예요/EF"),
        R("deg", "*/SN 도야/NNG", "@0 도/NNB 이/VCP 야/EF"),
        R("deg", "*/SN 도/JX */VCP", "@0 @1/NNB @2"),
    ],
    "one": [R("one", "하/VV|VX|XSV ㄴ/ETM */NNG|NNP|NNB|NR", "한/MM @2", word=(0, 1), opens=True, closes="end", when=lambda t, i: t[i + 1].end - t[i].start == 1)],
    "promise": [
        R("will", "*/VV|VX|XSV ㄹ/ETM 거/NNB 이/JKS|JX", "@0 ㄹ게/EF", word=(0, 3), opens=True, closes="mark", when=_one(0)),
        R("will", "*/VV|VX|XSV 을/ETM 거/NNB 이/JKS|JX", "@0 을게/EF", word=(0, 3), opens=True, closes="mark", when=_one(0)),
        R("will", "*/VV|VX 게/EC", "@0 ㄹ게/EF", word=(0, 1), opens=True, closes="mark", when=_one(0, lambda t, i: _coda(t[i].text) == "ㄹ")),
        R("will", "*/VV|VX 을/ETM 게/EC", "@0 을게/EF", word=(0, 2), opens=True, closes="mark", when=_one(0, lambda t, i: _coda(t[i].text) not in ("", "ㄹ", "?"))),
    ],
    "hither": [R("hither", "이리/NNP", "@0/MAG", word=(0, 0), opens=True, closes="end", when=lambda t, i: i + 1 == len(t) or t[i + 1].pos in ("VV", "VA", "VX", "MAG", "SF", "SP"))],
    "adverb_go": [R("go", "*/MAG 가/JKS", "@0 @1/VV", word=(0, 1), closes="end")],
    "adverb_come": [R("come", "*/MAG 와/JKB|JC", "@0 오/VV 아/EF", word=(0, 1), closes="end")],
    "try": [R("try", "*/JKS|EC|NNG 보/VV|VX 아|아도|아서|아야|아요/*", "@0/VV @1/VX @2", word=(0, 2), when=_one(0))],
    "determiners": [R("det", f"전|그런|이런|저런|어떤|새|헌|옛|온/NNG */{NOUN}|XPN", "@0/MM @1")],
    "such": [R("such", f"{stem}/{tag} ㄴ|ᆫ|은/ETM", f"{d}/MM", word=(0, 1)) for stem, tag, d in (x.split() for x in "그렇 VA 그런;그러 VV 그런;이렇 VA 이런;이러 VV 이런;저렇 VA 저런;저러 VV 저런;어떻 VA 어떤;어떠 VV 어떤".split(";"))],
    "honorific_yo": [R("seyo", "시/EP 아요|어요/EF", "세요/EF", word=(0, 1)), R("seyo", "으시/EP 아요|어요/EF", "으세요/EF", word=(0, 1))],
    "so": [R("so", "그렇/VA 아서|어서/EC", "그래서/MAJ", word=(0, 1)), R("so", "그렇/VA 아도|어도/EC", "그래도/MAJ", word=(0, 1))],
    "during": [R("si", "*/NNG|XSN 시/NNG", "@0 @1/NNB")],
    "quote": [R("quote", "*/SS 이/VCP 라고/EC", "@0 이라고/JKQ", word=(0, 2)), R("quote", "*/SS 고|라고|이라고/*", "@0 @1/JKQ", word=(0, 1))],
}
#: The order for the single best path, and that for candidates of the N best.
FIRST = "auxiliary conjunction bound_noun affix determiner complement or bound_without lone_prefix final imperative eat_honorific copula question_copula present_copula past_copula my me noun_back nde adverb_go adverb_come try determiners such honorific_yo so during quote".split()
SECOND = "auxiliary conjunction bound_noun affix determiner complement or bound_without lone_prefix final imperative come eat_honorific copula question_copula present_copula past_copula noun_back nde haeyo polite ending_pairs adverb_copula what_time degree one promise hither adverb_go adverb_come try determiners such honorific_yo my me so during quote".split()


#: Groups whose rules take turns at each token, with the item that stands on it.
_TURNS = {"affix": (1, 0)}


def _by_turns(out: list[Token], rules: list[Rule], items: tuple[int, ...]) -> None:
    for i in range(len(out)):
        for rule, item in zip(rules, items):
            if i >= item and rule.fits(out, i - item):
                rule.at(out, i - item)


@lru_cache(4096)
def _wanted(names: tuple[str, ...], tags: frozenset[str]) -> frozenset[str] | None:
    """Forms of which a text with these tags must have one for any of the rules to apply; None: one may apply without."""
    open_ = [r.needs for n in names for r in RULES[n] if r.needs_tags is None or not r.needs_tags.isdisjoint(tags)]
    return None if None in open_ else frozenset().union(*open_)


def correct(tokens: list[Token], names: list[str]) -> list[Token]:
    out = list(tokens)
    forms, tags = {t.text for t in out}, {t.pos for t in out}
    wanted = _wanted(tuple(names), frozenset(tags))
    if wanted is not None and wanted.isdisjoint(forms):
        return out
    for name in names:
        if name in _TURNS:
            if any(rule.possible(forms, tags) for rule in RULES[name]):
                _by_turns(out, RULES[name], _TURNS[name])
                tags = {t.pos for t in out}
            continue
        for rule in RULES[name]:
            if rule.possible(forms, tags) and rule.apply(out):
                forms, tags = {t.text for t in out}, {t.pos for t in out}
    return out


#: Verbs and adjectives from a noun or root with 하, and adjective roots; done while tokens still have their arcs' places.
DERIVED = [R("xsv", "*/NNG 하|되|시키/VV", "@0 @1/XSV"), R("xsa", "*/NNG 하/VA", "@0 @1/XSA"), R("xsa", "*/XR 하/VV|VA", "@0 @1/XSA")]


def derived(tokens: list[Token], roots: frozenset[str]) -> list[Token]:
    out = list(tokens)
    if not any(t.pos in ("VV", "VA", "XSV") for t in out):
        return out
    for rule in DERIVED:
        rule.apply(out)
    for i in range(1, len(out)):
        if out[i].text == "하" and out[i].pos == "XSV" and out[i - 1].pos in ("NNG", "XR") and out[i - 1].text in roots:
            out[i] = out[i]._replace(pos="XSA")
    return out


_MERGE = R("merge", "어|아/EC */EF", "@0@1/EF", word=(0, 1))


def merged_endings(tokens: list[Token]) -> list[Token]:
    """어/아 and a final ending of the same arc are one ending."""
    out = list(tokens)
    _MERGE.apply(out)
    return out


def merged_runs(tokens: list[Token]) -> list[Token]:
    out: list[Token] = []
    for t in tokens:
        if out and t.pos in ("SL", "SN", "SH") and out[-1].pos == t.pos and out[-1].end == t.start and 1 in (len(out[-1].text), len(t.text)):
            out[-1] = out[-1]._replace(text=out[-1].text + t.text, end=t.end)
        else:
            out.append(t)
    return out


def harmonized(tokens: list[Token], text: str) -> list[Token]:
    """Endings' vowels after what comes before: 았 and 아 after ㅏ and ㅗ, 어 after a past ending.

    Irregular stems in ㅂ, whose surface isn't the stem's, keep 어 but for 곱 and 돕.
    """
    out = list(tokens)
    for i in range(1, len(out)):
        stem, t = out[i - 1], out[i]
        p = parts(stem.text[-1]) if stem.text else None
        light = p is not None and bright(p[1])
        if t.pos == "EP" and t.text in ("었", "었었") and light:
            t = t._replace(text="았" + t.text[1:])
        elif t.pos in ("EC", "EF"):
            irregular = p is not None and CODAS[p[2]] == "ㅂ" and stem.pos in ("VV", "VA", "VX") and stem.text not in ("곱", "돕") and stem.start < stem.end and not text[stem.start : stem.end].startswith(stem.text)
            if t.text[:1] == "어" and stem.pos != "EP" and light and not irregular:
                t = t._replace(text="아" + t.text[1:])
            elif t.text[:1] == "아" and stem.pos == "EP":
                t = t._replace(text="어" + t.text[1:])
        out[i] = t
    return out
