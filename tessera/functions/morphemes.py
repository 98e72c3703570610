"""Functions of morpheme arrays (array<struct<form, pos>>) as Column expressions: ordered folds and transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import hangul

_EMPTY = "array<struct<form:string,pos:string>>"


def morpheme(form: Column, pos: Column) -> Column:
    return F.struct(form.alias("form"), pos.alias("pos"))


def _last(acc: Column) -> Column:
    return F.get(acc, F.size(acc) - 1)


def _but_last(acc: Column) -> Column:
    return F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))


def joined_roots(ms: Column) -> Column:
    """A root and 하 after it are one verb or adjective."""
    step = lambda acc, m: F.when((_last(acc)["pos"] == "XR") & (m["form"] == "하") & m["pos"].isin("XSA", "XSV"), F.concat(_but_last(acc), F.array(morpheme(F.concat(_last(acc)["form"], F.lit("하")), F.when(m["pos"] == "XSA", "VA").otherwise("VV"))))).otherwise(F.concat(acc, F.array(m)))
    return F.aggregate(ms, F.array().cast(_EMPTY), step)


def comparable(ms: Column) -> Column:
    """The form in which two analyses are compared: fused past endings apart, leading letters conjoining, one vowel of
    harmonic pairs, brackets and quotes of one kind."""
    apart = lambda m: F.when((m["form"] == "했") & (m["pos"] == "XSV+EP"), F.array(morpheme(F.lit("하"), F.lit("XSV")), morpheme(F.lit("았"), F.lit("EP")))).when((m["form"] == "였") & (m["pos"] == "VCP+EP"), F.array(morpheme(F.lit("이"), F.lit("VCP")), morpheme(F.lit("었"), F.lit("EP")))).otherwise(F.array(m))

    def one(m: Column) -> Column:
        form = hangul.lead_to_joining(m["form"])
        bright = F.concat(F.translate(F.substring(form, 1, 1), "어었워웠여였", "아았와왔아았"), F.substring(form, F.lit(2), F.length(form)))
        form = F.when(m["pos"].isin("EC", "EP", "EF"), bright).when(m["pos"].isin("SS", "SSO", "SSC"), F.translate(form, "‘’“”", "''\"\"")).otherwise(form)
        return morpheme(form, F.when(m["pos"].isin("SSO", "SSC"), "SS").otherwise(m["pos"]))

    return F.transform(F.flatten(F.transform(joined_roots(ms), apart)), one)


def unified_past(ms: Column) -> Column:
    """Past endings 았/었/였 as their stem wants: 였 after 하, else by the last vowel of the form before; unsure ones stay."""
    stem = lambda i: F.get(ms, i - 1)["form"]
    syllables = lambda s: F.filter(F.split(s, ""), lambda c: hangul.is_syllable(c))

    def one(m: Column, i: Column) -> Column:
        own = syllables(stem(i))
        vowel = hangul.decompose(F.get(own, F.size(own) - 1))["vowel"]
        form = F.when(stem(i) == "하", "였").when(vowel.isin(*"ㅏㅑㅗㅛㅘㅙ"), "았").when(vowel.isNotNull(), "었").otherwise(m["form"])
        return F.when((i > 0) & (m["pos"] == "EP") & m["form"].isin("았", "었", "였"), morpheme(form, m["pos"])).otherwise(m)

    return F.transform(ms, one)


def converged(candidates: Column) -> Column:
    """The one reading that all candidates share once past endings are unified; null where they differ."""
    all_ = F.transform(candidates, unified_past)
    return F.when(F.size(F.array_distinct(all_)) == 1, F.get(all_, F.lit(0)))


#: Noun suffixes that the 2025 convention writes with their noun.
NOUN_SUFFIXES = "적 성 화 권 율 률 치 급 층 력 계 생 상 형 님 별".split()
NOUNS = ("NNG", "NNP", "XR")


def _pick(form: Column, pos: Column | str, takes_next: bool) -> Column:
    return F.struct(form.alias("form"), (F.lit(pos) if isinstance(pos, str) else pos).alias("pos"), F.lit(takes_next).alias("two"))


def _quotes(w: Column | None, m: Column, nxt: Column) -> Column:
    """Clauses for reported speech: an ending and its clitic, and quoting particles, are one ending."""
    clitic = ((nxt["form"] == "고") & (nxt["pos"] == "JKQ")) | ((nxt["form"] == "며") & (nxt["pos"] == "EC")) | ((nxt["form"] == "는") & (nxt["pos"] == "ETM"))
    quote = lambda forms: (m["pos"] == "JKQ") & m["form"].isin(*forms)
    when = F.when if w is None else w.when
    w = when((m["pos"] == "EF") & clitic, _pick(F.concat(m["form"], nxt["form"]), F.when(nxt["pos"] == "ETM", "ETM").otherwise("EC"), True))
    w = w.when(quote(["라고", "이라고"]), _pick(F.lit("라고"), "EC", False))
    for form, pos in (("며", "EC"), ("는", "ETM"), ("고", "EC")):
        w = w.when(quote(["라", "이라"]) & (nxt["form"] == form) & (nxt["pos"] == pos), _pick(F.lit("라" + form), pos, True))
    return w


def _taken(ms: Column, pick) -> Column:
    """From left to right, what ``pick`` makes of each morpheme and the next; a pair that became one is passed over."""
    picks = F.transform(ms, lambda m, i: pick(m, F.get(ms, i + 1)))
    start = F.struct(F.array().cast(_EMPTY).alias("out"), F.lit(False).alias("skip"))
    step = lambda a, p: F.when(a["skip"], F.struct(a["out"].alias("out"), F.lit(False).alias("skip"))).otherwise(F.struct(F.concat(a["out"], F.array(morpheme(p["form"], p["pos"]))).alias("out"), p["two"].alias("skip")))
    return F.aggregate(picks, start, step, lambda a: a["out"])


def without_joints(ms: Column) -> Column:
    """Compounds joined by '_' as their parts."""
    return F.flatten(F.transform(ms, lambda m: F.transform(F.filter(F.split(m["form"], "_"), lambda x: (x != "") | ~m["form"].contains("_")), lambda x: morpheme(x, m["pos"]))))


def merged_derivations(ms: Column) -> Column:
    """The coarser 2025 convention: compounds apart; noun or root and a verbal suffix are one verb or adjective, with a
    listed noun suffix one noun; auxiliary 되 is a verb; reported speech is one ending. Each morpheme is used once."""

    def pick(m: Column, nxt: Column) -> Column:
        noun = m["pos"].isin(*NOUNS)
        both = F.concat(m["form"], nxt["form"])
        w = F.when(noun & nxt["pos"].isin("XSV", "XSA"), _pick(both, F.when(nxt["pos"] == "XSV", "VV").otherwise("VA"), True)).when((m["form"] == "되") & (m["pos"] == "VX"), _pick(m["form"], "VV", False))
        w = w.when(noun & (nxt["pos"] == "XSN") & nxt["form"].isin(*NOUN_SUFFIXES), _pick(both, "NNG", True))
        return _quotes(w, m, nxt).otherwise(_pick(m["form"], m["pos"], False))

    return _taken(without_joints(ms), pick)


#: Verbal suffixes that may be cut off, the longest first.
VERBALIZERS = ("시키", "당하", "받", "되", "하")


def split_derivations(ms: Column, nouns: list[str], whole: list[str] = ()) -> Column:
    """Back from the 2025 convention to the 2021 one: verbs made of a known noun and a verbal suffix come apart, but for
    those in ``whole``; compounds of nouns come apart, other joints are dropped; reported speech becomes one ending."""
    nominal = ("NNG", "NNP", "NNB", "NR", "SL", "SH", "SN")

    def joints(m: Column) -> Column:
        parts = F.filter(F.split(m["form"], "_"), lambda x: x != "")
        return F.when(~m["form"].contains("_"), F.array(morpheme(m["form"], m["pos"]))).when(m["pos"].isin(*nominal) & (F.size(parts) >= 2), F.transform(parts, lambda x: morpheme(x, m["pos"]))).otherwise(F.array(morpheme(F.replace(m["form"], F.lit("_"), F.lit("")), m["pos"])))

    def apart(m: Column) -> Column:
        w = F.when(~m["pos"].isin("VV", "VA") | m["form"].isin(*whole), F.array(morpheme(m["form"], m["pos"])))
        for suffix in VERBALIZERS:
            base = F.substring(m["form"], F.lit(1), F.length(m["form"]) - len(suffix))
            w = w.when(m["form"].endswith(suffix) & (F.length(m["form"]) > len(suffix)) & base.isin(*nouns), F.array(morpheme(base, F.lit("NNG")), morpheme(F.lit(suffix), F.when(m["pos"] == "VA", "XSA").otherwise("XSV"))))
        return w.otherwise(F.array(morpheme(m["form"], m["pos"])))

    quoted = _taken(F.flatten(F.transform(ms, joints)), lambda m, nxt: _quotes(None, m, nxt).otherwise(_pick(m["form"], m["pos"], False)))
    return F.flatten(F.transform(quoted, apart))


def settled(ms: Column) -> Column:
    """Conjoining letters as compatibility ones, and the endings that 하 takes: 였 and 여."""
    plain = F.transform(ms, lambda m: morpheme(hangul.codas_to_compat(m["form"]), m["pos"]))
    after = lambda i: (i > 0) & (F.get(plain, i - 1)["form"] == "하")
    form = lambda m, i: F.when(after(i) & (m["pos"] == "EP") & m["form"].isin("았", "었", "였"), "였").when(after(i) & (m["pos"] == "EC") & m["form"].isin("아", "어", "여"), "여").otherwise(m["form"])
    return F.transform(plain, lambda m, i: morpheme(form(m, i), m["pos"]))


def leading_run(ms: Column, pos: str = "NNG") -> Column:
    """The morphemes of one tag that an analysis begins with."""
    other = F.array_position(F.transform(ms, lambda m: m["pos"] != pos), True).cast("int")
    return F.when(other > 0, F.slice(ms, F.lit(1), other - 1)).otherwise(ms)


def failure_signatures(gold: Column, pred: Column) -> Column:
    """What sets a prediction apart from gold: the last tag, tags missing or extra, the number of morphemes."""
    tags = lambda x: F.array_distinct(F.transform(x, lambda m: m["pos"]))
    last = lambda x: F.coalesce(F.get(x, F.size(x) - 1)["pos"], F.lit(""))
    named = lambda name, x: F.transform(x, lambda t: F.concat(F.lit(name + ": "), t))
    one = lambda cond, text: F.when(cond, F.array(text)).otherwise(F.array().cast("array<string>"))
    versus = lambda name, a, b: F.concat(F.lit(name + ": gold="), a.cast("string"), F.lit(" pred="), b.cast("string"))
    found = F.concat(
        one(last(gold) != last(pred), versus("last tag", last(gold), last(pred))), named("missing tag", F.array_except(tags(gold), tags(pred))), named("extra tag", F.array_except(tags(pred), tags(gold))),
        one(F.size(gold) != F.size(pred), versus("morphemes", F.size(gold), F.size(pred))),
    )
    return F.when(F.size(gold) > 0, found).otherwise(F.array().cast("array<string>"))


def syllable_labels(word: Column, ms: Column) -> Column:
    """A B- or I- tag for each character of a word; where forms don't spell it, they get shares of its length."""
    n, total = F.length(word), F.aggregate(ms, F.lit(0), lambda a, m: a + F.length(m["form"]))
    exact = F.array_join(F.transform(ms, lambda m: m["form"]), "") == word
    # halves to even
    share = lambda m: F.when(exact, F.length(m["form"])).otherwise(F.greatest(F.lit(1), F.bround(F.length(m["form"]) / total * n).cast("int")))
    labels = F.flatten(F.transform(ms, lambda m: F.transform(F.sequence(F.lit(1), F.greatest(share(m), F.lit(1))), lambda k: F.when(k > share(m), None).when(k == 1, F.concat(F.lit("B-"), m["pos"])).otherwise(F.concat(F.lit("I-"), m["pos"])))))
    labels = F.slice(F.filter(labels, lambda x: x.isNotNull()), F.lit(1), F.greatest(n, F.lit(0)))
    rest = F.concat(F.lit("I-"), F.get(ms, F.size(ms) - 1)["pos"])
    full = F.concat(labels, F.array_repeat(rest, n - F.size(labels)))
    return F.when((total == 0) | (F.size(ms) == 0), F.array_repeat(F.lit("O"), n)).otherwise(full)


def fits_key(key: Column, ms: Column) -> Column:
    """Whether what comes before the first particle or ending is no longer than the key."""
    stem = F.aggregate(ms, F.struct(F.lit(0).alias("n"), F.lit(True).alias("open")), lambda a, m: F.struct(F.when(a["open"] & ~m["pos"].rlike("^[JE]"), a["n"] + F.length(m["form"])).otherwise(a["n"]).alias("n"), (a["open"] & ~m["pos"].rlike("^[JE]")).alias("open")))
    return stem["n"] <= F.length(key)


def correction_value(gold: Column, pred: Column) -> Column:
    """Morphemes of either side that the other lacks."""
    return F.size(F.array_except(gold, pred)) + F.size(F.array_except(pred, gold))


def compound_split(single: Column, double: Column) -> Column:
    """struct(surface, first, second) where one analysis begins with one noun and the other with the same cut in two."""
    a, b = leading_run(single), leading_run(double)
    ok = (F.size(a) == 1) & (F.size(b) == 2) & (F.get(a, F.lit(0))["form"] == F.concat(F.get(b, F.lit(0))["form"], F.get(b, F.lit(1))["form"]))
    return F.when(ok, F.struct(F.get(a, F.lit(0))["form"].alias("surface"), F.get(b, F.lit(0))["form"].alias("first"), F.get(b, F.lit(1))["form"].alias("second")))


_MARKS = ".,!?:;\"'()[]《》「」『』【】…·—–−~"


def aligned_words(words: Column, ms: Column) -> Column:
    """array<struct<word, morphemes>>: morphemes dealt to words from left to right as long as their forms spell the word,
    marks at its edges or not; words that take none are left out."""
    pattern = "^[" + "".join("\\" + c if c in "[]^-\\" else c for c in _MARKS) + "]+|[" + "".join("\\" + c if c in "[]^-\\" else c for c in _MARKS) + "]+$"
    kind = "struct<at:int,out:array<struct<word:string,morphemes:array<struct<form:string,pos:string>>>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<word:string,morphemes:array<struct<form:string,pos:string>>>>").alias("out")).cast(kind)

    def word(acc: Column, w: Column) -> Column:
        bare = F.regexp_replace(w, pattern, "")
        rest = F.slice(ms, acc["at"] + 1, F.greatest(F.size(ms) - acc["at"], F.lit(0)))
        first = F.struct(F.lit("").alias("built"), F.lit(0).alias("n"), F.lit(True).alias("go"))

        def take(a: Column, m: Column) -> Column:
            built = F.concat(a["built"], m["form"])
            ok = a["go"] & (w.startswith(built) | bare.startswith(built))
            return F.struct(F.when(ok, built).otherwise(a["built"]).alias("built"), (a["n"] + ok.cast("int")).alias("n"), (ok & (built != w) & (built != bare)).alias("go"))

        n = F.aggregate(rest, first, take, lambda a: a["n"])
        taken = F.when(n > 0, F.array(F.struct(w.alias("word"), F.slice(ms, acc["at"] + 1, n).alias("morphemes")))).otherwise(F.array().cast("array<struct<word:string,morphemes:array<struct<form:string,pos:string>>>>"))
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], taken).alias("out")).cast(kind)

    return F.aggregate(words, start, word, lambda a: a["out"])
