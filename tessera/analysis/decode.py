"""Best paths through a lattice. A state is the last two tags; each keeps its k best ways of being reached."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from . import rules
from .lattice import RUN, Arc, Lattice, char_class, pieces
from .model import Model
from .rules import Token

Path = tuple[float, tuple, Arc | None, "Path | None"]  # type: ignore[misc]


#: (cost, forms, tags, starts, ends): tokens as columns.
Columns = tuple[float, list[str], list[str], list[int], list[int]]
_WORD = re.compile(r"\S+")
_MOST_SEEN = 1 << 15  # words kept
_LONGEST_SEEN = 64  # their characters, at most


def _keep(model: Model, word: str, found: tuple) -> tuple:
    """What was found for a word, kept for when it comes again."""
    if len(word) <= _LONGEST_SEEN:
        if len(model.seen) >= _MOST_SEEN:
            model.seen.clear()
        model.seen[word] = found
    return found


def plain(model: Model, text: str) -> Columns:
    """The only path of a text that ``Model.is_plain``: no lattice is built, and words are read once.

    No correction has anything to do there: each wants a tag that such tokens don't have, or a form in Hangul.
    """
    forms: list[str] = []
    tags: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    seen, moves = model.seen, model.moves
    cost, before, last = 0.0, "BOS", "BOS"
    for m in _WORD.finditer(text):
        word = m.group()
        own, bonuses, first, second, rest, f, t = seen.get(word) or _read(model, word)
        try:
            step = own + moves[before, last, first]
        except KeyError:
            step = own + _move(model, before, last, first)
        if bonuses:
            step += next((x for p, t, x in bonuses if p == last and t == first), 0.0)
        cost += step
        if second is None:
            before, last = last, first
        else:
            tag, own, bonus, before_, last_ = second
            cost += own + _move(model, last, first, tag) + bonus
            for step in rest:
                cost += step
            before, last = before_, last_
        forms += f
        tags += t
        lo, hi = m.span()
        if len(f) == 1:
            starts.append(lo)
            ends.append(hi)
        else:
            starts += [lo] * len(f)
            ends += [hi] * len(f)
    return cost + model.transition(before, last, "EOS"), forms, tags, starts, ends


def _move(model: Model, a: str, b: str, c: str) -> float:
    """``Model.transition`` between tags of plain words, kept: there are few."""
    found = model.moves.get((a, b, c))
    if found is None:
        found = model.moves[a, b, c] = model.transition(a, b, c)
    return found


def _read(model: Model, word: str) -> tuple:
    """A plain word: the first piece's cost, bonuses and tag; of the second (tag, cost, bonus, last two tags of the word);
    the costs of the steps from the third on; forms and tags. Only the first two steps depend on the words before."""
    own, order, raw = [], [], []
    for a, b, tag, kind in pieces(word):
        own.append(model.oov if kind == "oov" else model.word_cost(word[a:b], tag, 1000))
        order.append(tag)
        raw.append(Token(word[a:b], tag, a, b))
    bonus = [0.0] + [next((x for p, t, x in model.word_bigrams.get(w.text, ()) if p == v.pos and t == w.pos), 0.0) for v, w in zip(raw, raw[1:])] if model.word_bigrams else [0.0] * len(raw)
    second = (order[1], own[1], bonus[1], order[-2], order[-1]) if len(raw) > 1 else None
    rest = [own[k] + _move(model, order[k - 2], order[k - 1], order[k]) + bonus[k] for k in range(2, len(raw))]
    tokens = rules.merged_runs(raw) if "SN" in order or "SH" in order or "SL" in order else raw
    return _keep(model, word, (own[0], model.word_bigrams.get(raw[0].text), order[0], second, rest, [t.text for t in tokens], [t.pos for t in tokens]))


def arc_sums(model: Model, text: str, user: dict | None = None) -> dict[str, list]:
    """All candidate arcs of a text by their source: [number, sum of costs]."""
    out: dict[str, list] = {}
    if not model.is_plain(text, user):
        for a in Lattice(model, text, user).arcs():
            x = out.setdefault(a.source, [0, 0.0])
            x[0] += 1
            x[1] += a.cost
        return out
    runs, cost, single = 0, 0.0, 0
    for word in _WORD.findall(text):
        # runs begin in Latin letters and digits alone; characters that none begins at, those inside runs as well, are arcs
        own = [model.word_cost(m.group(), m.lastgroup, 1000) for m in RUN.finditer(word)]
        runs, cost, single = runs + len(own), cost + sum(own), single + len(word) - len(own)
    return ({"run": [runs, cost]} if runs else {}) | ({"oov": [single, single * model.oov]} if single else {})


def best_paths(model: Model, text: str, arcs: list[Arc], k: int) -> list[tuple[float, list[Arc]]]:
    """Up to 2k cheapest paths, ascending; of equals the one found first."""
    n = len(text)
    by_start: list[list[Arc]] = [[] for _ in range(n)]
    for a in arcs:
        by_start[a.start].append(a)
    at: list[dict[tuple[str, str], list]] = [{} for _ in range(n + 1)]
    at[0]["BOS", "BOS"] = [(0.0, None, None)]

    def push(end: int, state: tuple[str, str], cost: float, arc: Arc | None, back: tuple) -> None:
        kept = at[end].setdefault(state, [])
        if len(kept) == k and cost >= kept[-1][0]:
            return
        place = len(kept)
        while place and kept[place - 1][0] >= cost:
            place -= 1
        kept.insert(place, (cost, arc, back))
        del kept[k:]

    for i in range(n):
        if not at[i]:
            continue
        for a in by_start[i]:
            tags = [t for _, t in a.morphemes]
            form = a.morphemes[0][0]
            inner = sum(model.transition(tags[x - 2], tags[x - 1], tags[x]) for x in range(2, len(tags)))
            for (before, last), ways in at[i].items():
                step = a.cost + model.transition(before, last, tags[0]) + inner
                if len(tags) > 1:
                    step += model.transition(last, tags[0], tags[1])
                step += next((b for p, t, b in model.word_bigrams.get(form, ()) if p == last and t == tags[0]), 0.0)
                state = (tags[-2] if len(tags) > 1 else last, tags[-1])
                for way in ways:
                    push(a.end, state, way[0] + step, a, way)
        if text[i].isspace():
            for state, ways in at[i].items():
                for way in ways:
                    push(i + 1, state, way[0], None, way)
    ends = [(way[0] + model.transition(b, t, "EOS"), o, way) for o, ((b, t), ways) in enumerate(at[n].items()) for way in ways]
    ends.sort(key=lambda e: (e[0], e[1]))
    out = []
    for cost, _, way in ends[: 2 * k]:
        arcs_back = []
        while way is not None:
            if way[1] is not None:
                arcs_back.append(way[1])
            way = way[2]
        out.append((cost, arcs_back[::-1]))
    return out


def _tokens(path: list[Arc], text: str, model: Model) -> list[Token]:
    raw = [Token(f, t, a.start, a.end) for a in path for f, t in a.morphemes]
    return rules.merged_runs(rules.merged_endings(rules.derived(rules.harmonized(raw, text), model.adjective_roots)))


def _spans(tokens: list[Token], text: str) -> list[Token]:
    """Each token takes the places of the words that it touches."""
    words = [w.span() for w in _WORD.finditer(text)]
    begin, end = [w[0] for w in words], [w[1] for w in words]
    out = []
    for t in tokens:
        a, b = bisect_right(end, t.start), bisect_left(begin, t.end)  # the words from a up to b touch the token
        out.append(t._replace(start=begin[a], end=end[b - 1]) if a < b else t)
    return out


def _distinct(results: list[tuple[float, list[Token]]], k: int) -> list[tuple[float, list[Token]]]:
    seen, out = set(), []
    for cost, tokens in results:
        key = tuple((t.text, t.pos) for t in tokens)
        if key not in seen:
            seen.add(key)
            out.append((cost, tokens))
    return out[:k]


def single(model: Model, text: str, user: dict | None = None) -> tuple[float, list[Token]]:
    """The best path, corrected in the first order of rules."""
    if not text.strip():
        return 0.0, []
    if model.is_plain(text, user):
        cost, *columns = plain(model, text)
        return cost, list(map(Token, *columns))
    paths = best_paths(model, text, Lattice(model, text, user).arcs(), 1)
    if not paths:
        tokens = rules.merged_runs([Token(c, char_class(c), i, i + 1) for i, c in enumerate(text) if not c.isspace()])
        return model.oov * len(text), _spans(tokens, text)
    cost, path = paths[0]
    return cost, rules.correct(_spans(_tokens(path, text, model), text), rules.FIRST)


def n_best(model: Model, text: str, k: int, user: dict | None = None) -> list[tuple[float, list[Token]]]:
    """Distinct candidates, cheapest first, corrected in the second order; one of them goes the way of ``single``."""
    if k <= 0 or not text.strip():
        return [(0.0, [])]
    if k == 1 or model.is_plain(text, user):
        return [single(model, text, user)]
    paths = best_paths(model, text, Lattice(model, text, user).arcs(), k)
    if not paths:
        return [single(model, text, user)]
    decoded = _distinct([(c, _tokens(p, text, model)) for c, p in paths], k)
    return _distinct([(c, rules.correct(_spans(t, text), rules.SECOND)) for c, t in decoded], k)
