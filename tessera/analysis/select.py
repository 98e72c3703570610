"""Choice among candidates: patterns that decide at once, context bonuses, a linear reranker, last corrections."""

from __future__ import annotations

from functools import lru_cache

from ..schema import PARTICLES
from . import rules
from .decode import n_best, single
from .model import Model
from .rules import Rule, Token

_R = Rule
_LAST = [
    _R("can", "*/ETM 수/NNB 있/VV|VA", "@0 @1 @2/VX", word=(0, 2)),
    _R("day", f"오늘|어제|지금/NNG|MAG */{'|'.join(sorted(PARTICLES))}", "@0/NNG @1"),
    _R("day", "오늘|어제|지금/NNG|MAG", "@0/MAG", when=lambda t, i: i + 1 == len(t) or t[i + 1].pos not in PARTICLES),
    _R("tomorrow", "내일/MAG", "@0/NNG"),
    _R("what", "뭐/IC */VV", "@0/NP @1"),
    _R("there", "저기/IC */NNG|NNP|VV|VA", "@0/NP @1"),
    _R("be", "*/JKS 있/VV */EC */VA|NNG", "@0 @1/VA @2 @3"),
]
#: A modifier, 만 and 하: before ㄴ데 the noun 데 is preferred to the ending.
_HEAD = "*/ETM 만/NNB 하/XSA"
_WITH_NOUN, _WITH_ENDING, _PLAIN = (Rule("man", p, "@0") for p in (_HEAD + " ㄴ/ETM 데/NNB", _HEAD + " ㄴ데/EC", _HEAD))


def _has(rule: Rule, t: list[Token]) -> bool:
    return any(x.text == "만" for x in t) and any(rule.fits(t, i) for i in range(len(t)))


def finish(t: list[Token], model: Model, roots: bool = True) -> list[Token]:
    out = rules.derived(t, model.adjective_roots) if roots else list(t)
    forms, tags = {x.text for x in out}, {x.pos for x in out}
    for r in _LAST:
        if r.possible(forms, tags):
            r.apply(out)
    return [x._replace(pos="NNG") if x.pos == "NNP" and x.text in model.hints else x for x in out]


def bonus(text: str, t: list[Token]) -> float:
    """Hand-set credits for readings that fit their surroundings."""
    asks = "?" in text or text.rstrip().endswith(("까", "냐"))
    noun = ("NNG", "NNP", "NP")
    total = 0.0
    for i, x in enumerate(t):
        nxt = t[i + 1] if i + 1 < len(t) else Token("", "", 0, 0)
        third = t[i + 2].pos if i + 2 < len(t) else ""
        total += 4 * (asks and x[:2] == ("뭐", "NP"))
        total += 2 * (x[:2] == ("오늘", "NNG") and nxt.pos in noun) + 2 * (x[:2] == ("오늘", "MAG") and nxt.pos in ("MAG", "VA", "VV")) + 3 * (x[:2] == ("오늘", "MAG") and nxt[:2] == ("너무", "MAG"))
        total += 5 * (x.pos in noun and nxt[:2] == ("있", "VA") and third == "EF")
        total += 4 * (x[:2] == ("냐", "EF")) + 4 * (x.text == "대박" and x.pos in ("NNG", "IC"))
        total += 3 * (x.pos == "NNG" and nxt[:2] == ("냐", "EF") and x.text + "냐" in text)
        total += 5 * (x[:2] == ("피곤", "NNG") and nxt[:2] == ("하", "XSA"))
        total += 3 * (x.pos in ("VV", "VA", "XSV", "XSA") and nxt.pos == "EF" and nxt.text in ("을게", "ㄹ게", "을까", "ㄹ까"))
    return total


@lru_cache(1 << 18)
def bucket(feature: str, bits: int = 20) -> int:
    h = 0xCBF29CE484222325
    for b in feature.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h & ((1 << bits) - 1)


def features(t: list[Token], delta: float, rank: int) -> list[tuple[str, float]]:
    out = [("bias", 1.0), ("score_delta", delta), (f"rank:{rank}", 1.0), ("ntok", float(len(t)))]
    a, b, form = "<s2>", "<s>", "<s>"
    for x in t:
        word = f"{x.text}/{x.pos}"
        out += [(f"u:{x.pos}", 1.0), (f"b:{b}|{x.pos}", 1.0), (f"t:{a}|{b}|{x.pos}", 1.0), (f"w:{word}", 1.0), (f"pw:{form}|{word}", 1.0)]
        a, b, form = b, x.pos, x.text
    out += [(f"b:{b}|</s>", 1.0), (f"t:{a}|{b}|</s>", 1.0)]
    if t:
        out.append((f"lw:{t[-1].text}/{t[-1].pos}|</s>", 1.0))
    out.append(("endc:" + next((x.pos for x in reversed(t) if not x.pos.startswith("S")), "<none>"), 1.0))
    return out


def rerank_score(model: Model, t: list[Token], delta: float, rank: int) -> float:
    return sum(model.weights.get(bucket(f), 0.0) * v for f, v in features(t, delta, rank))


def analyze(model: Model, text: str, user: dict | None = None) -> tuple[float, list[Token]]:
    """The chosen candidate's cost and tokens."""
    if not text.strip():
        return 0.0, []
    found = n_best(model, text, 10 if model.weights or "대박" in text else 5, user)
    if len(found) <= 1:
        cost, t = found[0] if found else single(model, text, user)
        return cost, finish(t, model)
    pick = next(((c, t) for c, t in found if _has(_WITH_NOUN, t)), None)
    if pick is None and any(_has(_WITH_ENDING, t) for _, t in found):
        pick = next(((c, t) for c, t in n_best(model, text, 12, user) if _has(_WITH_NOUN, t)), None)
    if pick is None and _has(_PLAIN, found[0][1]):
        pick = found[0]
    if pick:
        return pick[0], finish(pick[1], model, roots=False)
    best = min(range(len(found)), key=lambda k: (found[k][0] - bonus(text, found[k][1]), k))
    if model.weights:
        scores = [rerank_score(model, finish(t, model), c - found[0][0], k + 1) for k, (c, t) in enumerate(found)]
        top = max(range(len(found)), key=lambda k: (scores[k], -k))
        if scores[top] - scores[best] > model.margin:
            best = top
    cost, t = found[best]
    return cost, finish(t, model)
