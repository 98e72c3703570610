"""Queries over Korean rows made from the documents table: each document deals out fragments by arithmetic on its id.

The fragments' expected results are worked out by hand and joined by the SQL twin with the same arithmetic; what each
query returns is computed from the dealt text alone. Syllables are dealt by code point and checked against SQL arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..analysis import api
from ..analysis.seed import seed_model
from ..functions import conjugation, hangul, morphemes, text
from .relational import read, spread

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def ids(spark, d) -> DataFrame:
    return spread(read(spark, d, "documents").select("doc_id"))


def dealt(options: list[str], slot: int, salt: int = 0) -> Column:
    """One of ``options`` for each doc_id and slot."""
    n = len(options)
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.col("doc_id") * 31 + F.floor(F.col("doc_id") / 7) + slot * 17 + salt, F.lit(n)) + 1).cast("int"))


def dealt_sql(options: list[str], slot: int, salt: int = 0) -> str:
    quoted = ", ".join("'" + o.replace("'", "''") + "'" for o in options)
    return f"([{quoted}])[((doc_id * 31 + doc_id // 7 + {slot * 17 + salt}) % {len(options)} + 1)::INT]"


def joined(columns: list[Column], by: str = " ") -> Column:
    return F.concat_ws(by, *columns)


def joined_sql(parts: list[str], by: str = " ") -> str:
    return f"concat_ws('{by}', {', '.join(parts)})"


def _split(pairs: list[str]) -> tuple[list[str], list[str]]:
    return [p.split(":")[0] for p in pairs], [p.split(":")[1] for p in pairs]


#: Sentences: a subject, an adverbial, an object and a verb, each with its analysis.
PARTS = [
    _split("저는:저/NP 는/JX|친구가:친구/NNG 가/JKS|그 사람은:그/MM 사람/NNG 은/JX|사람들이:사람/NNG 들/XSN 이/JKS|한국은:한국/NNP 은/JX|오늘:오늘/MAG|내일:내일/NNG|너는:너/NP 는/JX".split("|")),
    _split("너무:너무/MAG|정말:정말/MAG|학교에서:학교/NNG 에서/JKB|집에:집/NNG 에/JKB|서울에서:서울/NNP 에서/JKB|매우:매우/MAG|학교에:학교/NNG 에/JKB|그리고:그리고/MAJ|잘:잘/MAG".split("|")),
    _split("밥을:밥/NNG 을/JKO|책을:책/NNG 을/JKO|물을:물/NNG 을/JKO|사과를:사과/NNG 를/JKO|하늘을:하늘/NNG 을/JKO|책도:책/NNG 도/JX|물만:물/NNG 만/JX".split("|")),
    _split("먹었다:먹/VV 었/EP 다/EF|먹었어요:먹/VV 었/EP 어요/EF|마셨다:마시/VV 었/EP 다/EF|읽었다:읽/VV 었/EP 다/EF|읽고:읽/VV 고/EC|먹는다:먹/VV 는다/EF|갔다:가/VV 았/EP 다/EF|보았다:보/VV 았/EP 다/EF|좋다:좋/VA 다/EF|있다:있/VA 다/EF|먹습니다:먹/VV 습니다/EF|맑다:맑/VA 다/EF|공부했다:공부/NNG 하/XSV 았/EP 다/EF|생각한다:생각/NNG 하/XSV ㄴ다/EF".split("|")),
]


def sentences(spark, d) -> DataFrame:
    """(doc_id, sentence), one per document."""
    return ids(spark, d).select("doc_id", joined([dealt(p[0], k, k * k) for k, p in enumerate(PARTS)]).alias("sentence"))


def _expected(of=lambda m: m) -> str:
    """SQL for what is expected of each sentence's morphemes."""
    return joined_sql([f"nullif({dealt_sql([' '.join(x for x in map(of, a.split()) if x) for a in p[1]], k, k * k)}, '')" for k, p in enumerate(PARTS)])


def _shown(tokens: Column, form: str = "text") -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.concat(t[form], F.lit("/"), t["pos"])), " ")


def _analyzed(spark, d) -> DataFrame:
    return sentences(spark, d).select("doc_id", "sentence", api.Analyzer(seed_model()).analyze(F.col("sentence")).alias("a"))


@query(f"SELECT doc_id, {_expected()} AS analysis FROM documents")
def analyze_tokens(spark, d):
    return _analyzed(spark, d).select("doc_id", _shown(F.col("a.tokens")).alias("analysis"))


@query(f"SELECT doc_id, {_expected(lambda m: m.split('/')[0] if m.split('/')[1] in ('NNG', 'NNP') else '')} AS nouns FROM documents")
def nouns(spark, d):
    return _analyzed(spark, d).select("doc_id", F.array_join(api.nouns(F.col("a.tokens")), " ").alias("nouns"))


@query(f"SELECT doc_id, {_expected(lambda m: m.split('/')[0] if m.split('/')[1] in api.SEARCH_TAGS and m.split('/')[0] != '물' else '')} AS terms FROM documents")
def search_terms(spark, d):
    return _analyzed(spark, d).select("doc_id", F.array_join(api.search_terms(F.col("a.tokens"), stop=("물",)), " ").alias("terms"))


@query(f"WITH s AS (SELECT {joined_sql([dealt_sql(p[0], k, k * k) for k, p in enumerate(PARTS)])} AS s, string_split({_expected()}, ' ') AS ms FROM documents), m AS (SELECT unnest(ms) AS m FROM s) SELECT string_split(m, '/')[2] AS pos, count(*) AS n, count(DISTINCT string_split(m, '/')[1]) AS forms FROM m GROUP BY 1")
def analyzed_pos_counts(spark, d):
    """Tokens by tag over the dealt sentences."""
    rows = api.token_rows(_analyzed(spark, d), "doc_id", "a")
    return rows.groupBy("pos").agg(F.count("*").alias("n"), F.countDistinct("text").alias("forms"))


def _place_sql() -> str:
    eojeols = joined_sql([dealt_sql(p[0], k, k * k) for k, p in enumerate(PARTS)])
    return f"WITH s AS (SELECT doc_id, {eojeols} AS s FROM documents) SELECT doc_id, length(s) AS chars, list_sum(list_transform(string_split(s, ' '), lambda w: length(w)))::BIGINT AS covered, 0::BIGINT AS outside FROM s"


@query(_place_sql())
def token_places(spark, d):
    """Places of tokens: all characters but blanks lie in some token, and no token reaches outside the sentence."""
    a = _analyzed(spark, d).select("doc_id", "sentence", F.col("a.tokens").alias("t"))
    inside = F.flatten(F.transform("t", lambda t: F.sequence(t["start"], F.greatest(t["end"] - 1, t["start"]))))
    letters = F.filter(F.array_distinct(inside), lambda i: F.substring("sentence", i + 1, F.lit(1)) != " ")
    return a.select("doc_id", F.length("sentence").cast("bigint").alias("chars"), F.size(letters).cast("bigint").alias("covered"), F.size(F.filter("t", lambda t: (t["start"] < 0) | (t["end"] > F.length("sentence")) | (t["end"] < t["start"]))).cast("bigint").alias("outside"))


@query(f"SELECT doc_id, {_expected()} AS analysis, true AS among, true AS ordered, true AS distinct_readings FROM documents")
def nbest_covers(spark, d):
    """Five candidates per sentence: scores ascend, readings differ, and the expected reading is among them."""
    out = sentences(spark, d).select("doc_id", "sentence", api.Analyzer(seed_model()).n_best(F.col("sentence"), 5).alias("c"), api.Analyzer(seed_model()).analyze(F.col("sentence")).alias("a"))
    shown = F.transform("c", lambda x: _shown(x["tokens"]))
    scores = F.transform("c", lambda x: x["score"])
    best = _shown(F.col("a.tokens"))
    return out.select("doc_id", best.alias("analysis"), F.array_contains(shown, best).alias("among"), (F.array_sort(scores) == scores).alias("ordered"), (F.size(F.array_distinct(shown)) == F.size(shown)).alias("distinct_readings"))


@query("SELECT doc_id, '탄소중립/NNP 목표/NNG' AS with_words, '탄소/NNG 중립/NNG 목표/NNG' AS crossing FROM documents")
def user_words(spark, d):
    """A user word wins, and never crosses a space."""
    base = api.Analyzer(seed_model())
    mine, across = base.with_user_words({"탄소중립": ("NNP", 5000)}), base.with_user_words({"중립목표": ("NNP", 5000)})
    # a sentence per document, so that the words travel with every task
    df = ids(spark, d).select("doc_id", F.concat(F.lit("탄소중립 "), F.lit("목표")).alias("s"))
    return df.select("doc_id", *[_shown(x.analyze(F.col("s"))["tokens"]).alias(n) for x, n in ((mine, "with_words"), (across, "crossing"))])


# --- syllables by code point

_C = "(44032 + (doc_id * 7919 + {k} * 263) % 11172)::INT"
_SYL = "WITH s AS (SELECT doc_id, unnest(range(0, 8)) AS k FROM documents), c AS (SELECT DISTINCT (44032 + (doc_id * 7919 + k * 263) % 11172)::INT AS cp FROM s), x AS (SELECT cp, cp - 44032 AS o FROM c)"
_LETTERS = f"'{hangul.ONSETS}'[o // 588 + 1] AS onset, '{hangul.VOWELS}'[o % 588 // 28 + 1] AS vowel, CASE WHEN o % 28 = 0 THEN '' ELSE '{hangul.CODAS}'[o % 28 + 1] END AS coda"


def syllables(spark, d) -> DataFrame:
    """Distinct syllables, eight dealt to each document."""
    cp = (F.lit(hangul.FIRST) + F.pmod(F.col("doc_id") * 7919 + F.col("k") * 263, F.lit(11172))).cast("bigint")
    return ids(spark, d).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).select(hangul.from_code_point(cp).alias("c")).distinct()


@query(f"{_SYL} SELECT chr(cp) AS c, {_LETTERS} FROM x")
def hangul_decompose(spark, d):
    return syllables(spark, d).select("c", hangul.decompose(F.col("c")).alias("x")).select("c", "x.onset", "x.vowel", "x.coda")


@query(f"{_SYL}, l AS (SELECT cp, {_LETTERS} FROM x) SELECT chr(cp) AS c, chr(cp) AS again, CASE WHEN coda = '' THEN chr(cp + 4) END AS attached, CASE WHEN coda <> '' AND contains('{hangul.SINGLE_CODAS}', coda) THEN chr(cp - (cp - 44032) % 28) END AS open FROM l")
def hangul_compose(spark, d):
    """Letters put together again; an open syllable with ㄴ put on; a single coda taken off."""
    x = syllables(spark, d).select("c", hangul.decompose(F.col("c")).alias("x"))
    return x.select("c", hangul.compose(F.col("x.onset"), F.col("x.vowel"), F.col("x.coda")).alias("again"), hangul.attach_coda(F.col("c"), F.lit("ㄴ")).alias("attached"), hangul.split_coda(F.col("c"))["open"].alias("open"))


@query(f"""{_SYL}, l AS (SELECT cp, {_LETTERS}, o FROM x) SELECT chr(cp) AS c, concat(onset, vowel, coda) AS compat, CASE WHEN coda = '' THEN onset WHEN contains('{hangul.SINGLE_CODAS}', coda) THEN concat(onset, coda) ELSE concat(onset, chr(4519 + o % 28)) END AS single FROM l""")
def hangul_letters(spark, d):
    """Conjoining letters as compatibility letters: all of them, or single codas only."""
    off = hangul.code_point(F.col("c")) - hangul.FIRST
    jamo = lambda base, k: hangul.from_code_point((F.lit(base) + k).cast("bigint"))
    coda = F.when(off % 28 > 0, jamo(0x11A7, off % 28)).otherwise("")
    all_ = F.concat(jamo(0x1100, F.floor(off / 588)), jamo(0x1161, F.floor(off % 588 / 28)), coda)
    onset = F.substring(F.lit(hangul.ONSETS), (F.floor(off / 588) + 1).cast("int"), F.lit(1))
    return syllables(spark, d).select("c", hangul.to_compat(all_).alias("compat"), F.concat(onset, hangul.codas_to_compat(coda)).alias("single"))


@query(f"{_SYL} SELECT chr(cp) AS c, chr(cp) AS composed FROM x")
def nfc_composed(spark, d):
    """Decomposed syllables composed again."""
    off = hangul.code_point(F.col("c")) - hangul.FIRST
    jamo = lambda base, k: hangul.from_code_point((F.lit(base) + k).cast("bigint"))
    apart = F.concat(jamo(0x1100, F.floor(off / 588)), jamo(0x1161, F.floor(off % 588 / 28)), F.when(off % 28 > 0, jamo(0x11A7, off % 28)).otherwise(""))
    return syllables(spark, d).select("c", text.composed(apart).alias("composed"))


@query("SELECT doc_id, md5(nfc_normalize(text)) AS h FROM documents")
def nfc_documents(spark, d):
    return spread(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.md5(text.composed(F.col("text"))).alias("h"))


# --- text

_RAW = _split("ㅋㅋㅋㅋ 진짜:ㅋㅋ 진짜|ㅇㅋ 갈게:오케이 갈게|ㅠㅠ:ㅠㅠ|워디 가유:어디 가요|가ㄱㅅ:가ㄱㅅ|ㄱㅅ 합니다:감사 합니다|ㅎㅎㅎㅎㅎ:ㅎㅎ|ㅈㅅ 늦어서:죄송 늦어서|우예 된 거야:어떻게 된 거야|plain ㄴㄴ:plain 노노".split("|"))


@query(f"SELECT doc_id, {joined_sql([dealt_sql(_RAW[1], k) for k in range(3)])} AS clean FROM documents")
def text_normalize(spark, d):
    raw = joined([dealt(_RAW[0], k) for k in range(3)])
    return ids(spark, d).select("doc_id", text.normalize(raw, abbreviations=True, dialect=True).alias("clean"))


@query("""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?…]\\s+)([가-힣A-Z"''(\\[{])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS l FROM documents),
r AS (SELECT doc_id, generate_subscripts(l, 1) AS k, l, unnest(l) AS s FROM p), o AS (SELECT doc_id, k, coalesce(list_sum(list_transform(l[1:k - 1], lambda x: length(x))), 0)::BIGINT AS start, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS t FROM r)
SELECT doc_id, start, md5(t) AS h FROM o WHERE t <> ''""")
def sentence_segments(spark, d):
    """Sentences of all documents with their places."""
    s = spread(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.inline(text.segments(F.col("text")))).where("text <> ''")
    return s.select("doc_id", F.col("start").cast("bigint").alias("start"), F.md5("text").alias("h"))


_SENT = "안녕하세요.|반갑습니다!|또 봐요|그렇다면 가자.|책을 읽었다?|밥을 먹자!".split("|")


@query(f"WITH s AS (SELECT doc_id, unnest([0, 1, 2, 3]) AS k, unnest([{', '.join(dealt_sql(_SENT, k) for k in range(4))}]) AS s FROM documents), g AS (SELECT *, coalesce(sum((regexp_matches(prev, '[.!?]$') OR regexp_matches(prev, '[다요죠]$'))::INT) OVER (PARTITION BY doc_id ORDER BY k), 0) AS n FROM (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY k) AS prev FROM s)) SELECT doc_id, n::INT AS k, string_agg(s, ' ' ORDER BY g.k) AS sentence FROM g GROUP BY doc_id, n")
def sentence_split(spark, d):
    """Sentences after a terminator or a polite ending."""
    t = joined([dealt(_SENT, k) for k in range(4)])
    return ids(spark, d).select("doc_id", F.posexplode(text.sentences(t)).alias("k", "sentence"))


@query("""WITH s AS (SELECT doc_id, unnest(range(0, 6)) AS k FROM documents), t AS (SELECT doc_id, k, repeat('가', ((doc_id + k * 3) % 40)::INT) || repeat('x', ((doc_id * 7 + k) % 23)::INT) AS s FROM s), n AS (SELECT *, length(s) AS n, length(regexp_replace(s, '[^가-힣]', '', 'g')) AS h FROM t)
SELECT doc_id, k, CASE WHEN n > 0 THEN round(h / n, 6) ELSE 0 END AS ratio, n BETWEEN 5 AND 200 AND (CASE WHEN n > 0 THEN h / n ELSE 0 END) >= 0.6 AS keep FROM n""")
def korean_sentence_filter(spark, d):
    s = F.concat(F.repeat(F.lit("가"), F.pmod(F.col("doc_id") + F.col("k") * 3, F.lit(40)).cast("int")), F.repeat(F.lit("x"), F.pmod(F.col("doc_id") * 7 + F.col("k"), F.lit(23)).cast("int")))
    rows = ids(spark, d).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")).select("doc_id", F.col("k").cast("bigint").alias("k"), s.alias("s"))
    return rows.select("doc_id", "k", F.round(text.hangul_ratio(F.col("s")), 6).alias("ratio"), text.is_korean_sentence(F.col("s")).alias("keep"))


_TAGS = [("kkma", "EFN", "EF"), ("kkma", "NNG", "NNG"), ("mecab", "SC", "SP"), ("mecab", "EP+EF", "EP"), ("kiwi", "SSO", "SS"), ("kkma", "OL", "SL"), ("kkma", "ETD", "ETM"), ("mecab", "NNBC", "NNB"), ("mecab", "SY", "SW"), ("kiwi", "VV", "VV"), ("kkma", "EPT", "EP")]


@query(f"WITH x AS (SELECT {dealt_sql(['|'.join(t) for t in _TAGS], 0)} AS t FROM documents) SELECT string_split(t, '|')[1] AS analyzer, string_split(t, '|')[2] AS tag, string_split(t, '|')[3] AS common, count(*) AS n FROM x GROUP BY ALL")
def tag_maps(spark, d):
    rows = ids(spark, d).select(F.split(dealt(["|".join(t[:2]) for t in _TAGS], 0), r"\|").alias("t")).select(F.col("t")[0].alias("analyzer"), F.col("t")[1].alias("tag"))
    out = None
    for name, table in text.TAG_MAPS.items():
        mapped = text.map_tag(text.first_tag(F.col("tag")), table)
        out = F.when(F.col("analyzer") == name, mapped) if out is None else out.when(F.col("analyzer") == name, mapped)
    return rows.withColumn("common", out).groupBy("analyzer", "tag", "common").agg(F.count("*").alias("n"))


_CORPUS = "NNG:NNG:NNG|MMD:MM:SW|NA:NNG:SW|NV:VV:SW|VV-R:VV:VV|VX-I:VX:VX|EXX:EF:SW|NXY:NNG:SW|W_URL:SW:SW|JKX:JX:SW|XPX:XR:SW|VA:VA:VA".split("|")


@query(f"WITH x AS (SELECT {dealt_sql([c.replace(':', '|') for c in _CORPUS], 0)} AS t FROM documents) SELECT string_split(t, '|')[1] AS tag, string_split(t, '|')[2] AS common, string_split(t, '|')[3] AS strict, count(*) AS n FROM x GROUP BY ALL")
def corpus_tags(spark, d):
    """Tags of the nested corpora in the common set, with and without the fallbacks."""
    t = ids(spark, d).select(dealt([c.split(":")[0] for c in _CORPUS], 0).alias("tag"))
    return t.select("tag", text.corpus_tag(F.col("tag")).alias("common"), text.corpus_tag(F.col("tag"), listed=False, by_letter=False).alias("strict")).groupBy("tag", "common", "strict").agg(F.count("*").alias("n"))


# --- morphemes

def parsed(spark, d, options: list[str], slots: int) -> DataFrame:
    """(doc_id, ms): the morphemes of the fragments dealt to each document."""
    shown = joined([dealt(options, k) for k in range(slots)])
    ms = F.transform(F.split(shown, " "), lambda m: morphemes.morpheme(F.regexp_replace(m, "/[^/]*$", ""), F.regexp_extract(m, "/([^/]*)$", 1)))
    return ids(spark, d).select("doc_id", ms.alias("ms"))


def _folded(f, options: list[tuple[str, str]], slots: int, name: str):
    """Registers f over morphemes dealt from the first of each pair, which must become the second."""
    before, after = [a for a, _ in options], [b for _, b in options]

    def run(spark, d):
        return parsed(spark, d, before, slots).select("doc_id", _shown(f(F.col("ms")), "form").alias("result"))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT doc_id, {joined_sql([dealt_sql(after, k) for k in range(slots)])} AS result FROM documents"


# each fragment ends in a full stop, so none merges with the next
_folded(morphemes.merged_derivations, [
    ("방문/NNG 하/XSV 다/EF ./SF", "방문하/VV 다/EF ./SF"), ("건강/NNG 하/XSA ./SF", "건강하/VA ./SF"), ("사회/NNG 적/XSN 성/XSN ./SF", "사회적/NNG 성/XSN ./SF"), ("사회/NNG 화/XSN 하/XSV ./SF", "사회화/NNG 하/XSV ./SF"),
    ("학/NNG 생/XSN ./SF", "학생/NNG ./SF"), ("책임/NNG 감/XSN ./SF", "책임/NNG 감/XSN ./SF"), ("사람/NNG 들/XSN ./SF", "사람/NNG 들/XSN ./SF"), ("사업_분야/NNG 를/JKO ./SF", "사업/NNG 분야/NNG 를/JKO ./SF"),
    ("가/VV ㄴ다/EF 고/JKQ ./SF", "가/VV ㄴ다고/EC ./SF"), ("가/VV ㄴ다/EF 며/EC ./SF", "가/VV ㄴ다며/EC ./SF"), ("가/VV ㄴ다/EF 는/ETM ./SF", "가/VV ㄴ다는/ETM ./SF"), ("이라고/JKQ ./SF", "라고/EC ./SF"),
    ("이라/JKQ 며/EC ./SF", "라며/EC ./SF"), ("라/JKQ 는/ETM ./SF", "라는/ETM ./SF"), ("라/JKQ 고/EC ./SF", "라고/EC ./SF"), ("되/VX 었/EP ./SF", "되/VV 었/EP ./SF"), ("목적/NNG 이/JKS ./SF", "목적/NNG 이/JKS ./SF"),
    ("조용/XR 하/XSA 다/EF ./SF", "조용하/VA 다/EF ./SF"), ("한국/NNP 적/XSN ./SF", "한국적/NNG ./SF"), ("음주_운전/NNG 하/XSV ./SF", "음주/NNG 운전하/VV ./SF"),
], 4, "convention_2025")

_folded(lambda ms: morphemes.split_derivations(ms, ["생각", "공개", "행복", "주목", "부", "공부"], ["대하", "부되"]), [
    ("생각하/VV 았/EP 다/EF ./SF", "생각/NNG 하/XSV 았/EP 다/EF ./SF"), ("공개되/VV 었/EP 고/EC ./SF", "공개/NNG 되/XSV 었/EP 고/EC ./SF"), ("대하/VV ㄴ/ETM ./SF", "대하/VV ㄴ/ETM ./SF"), ("만들/VV ㄴ/ETM ./SF", "만들/VV ㄴ/ETM ./SF"),
    ("사업_분야/NNG 를/JKO ./SF", "사업/NNG 분야/NNG 를/JKO ./SF"), ("음주_운전하/VV 면/EC ./SF", "음주운전하/VV 면/EC ./SF"), ("행복하/VA 다/EF ./SF", "행복/NNG 하/XSA 다/EF ./SF"), ("주목받/VV 다/EF ./SF", "주목/NNG 받/XSV 다/EF ./SF"),
    ("가/VV ㄴ다/EF 고/JKQ ./SF", "가/VV ㄴ다고/EC ./SF"), ("이라/JKQ 는/ETM ./SF", "라는/ETM ./SF"), ("하/VV 다/EF ./SF", "하/VV 다/EF ./SF"), ("부되/VV ./SF", "부되/VV ./SF"), ("공부시키/VV ./SF", "공부/NNG 시키/XSV ./SF"),
], 4, "convention_2021")

_folded(morphemes.comparable, [
    ("했/XSV+EP 다/EF ./SF", "하/XSV 았/EP 다/EF ./SF"), ("첨예/XR 하/XSA 게/EC ./SF", "첨예하/VA 게/EC ./SF"), ("먹/VV 었/EP 어/EF ./SF", "먹/VV 았/EP 아/EF ./SF"), ("‘/SSO ㄴ다/EF ./SF", "'/SS ᆫ다/EF ./SF"), ("였/VCP+EP ./SF", "이/VCP 았/EP ./SF"), ("보/VV 아서/EC ./SF", "보/VV 아서/EC ./SF"), ("”/SSC ./SF", '"/SS ./SF'),
], 3, "comparable_morphemes")

_folded(morphemes.unified_past, [
    ("보/VV 었/EP 다/EF ./SF", "보/VV 았/EP 다/EF ./SF"), ("하/VV 았/EP 다/EF ./SF", "하/VV 였/EP 다/EF ./SF"), ("먹/VV 았/EP ./SF", "먹/VV 었/EP ./SF"), ("가/VV 었/EP ./SF", "가/VV 았/EP ./SF"), ("마시/VV 았/EP 다/EF ./SF", "마시/VV 었/EP 다/EF ./SF"),
], 3, "past_endings")

_folded(morphemes.settled, [
    ("하/VV 았/EP 다/EF ./SF", "하/VV 였/EP 다/EF ./SF"), ("하/XSV 어/EC ./SF", "하/XSV 여/EC ./SF"), ("먹/VV 었/EP ./SF", "먹/VV 었/EP ./SF"), ("가/VV ᆫ다/EF ./SF", "가/VV ㄴ다/EF ./SF"), ("하/VV 아서/EC ./SF", "하/VV 아서/EC ./SF"), ("가/VV ᆯ/ETM ./SF", "가/VV ㄹ/ETM ./SF"),
], 3, "settled_morphemes")

_RUNS = [("주유/NNG 비/NNG 가/JKS", "주유 비"), ("주유비/NNG 가/JKS", "주유비"), ("먹/VV 다/EF", ""), ("책/NNG", "책"), ("가/NNG 나/NNG 다/NNG", "가 나 다")]


@query(f"SELECT doc_id, {dealt_sql([b for _, b in _RUNS], 0)} AS run FROM documents")
def leading_runs(spark, d):
    """The nouns that a word's analysis begins with."""
    return parsed(spark, d, [a for a, _ in _RUNS], 1).select("doc_id", F.array_join(F.transform(morphemes.leading_run(F.col("ms")), lambda m: m["form"]), " ").alias("run"))


_LABELS = [("학교에|학교/NNG 에/JKB", "B-NNG I-NNG B-JKB"), ("갔다|가/VV 았/EP 다/EF", "B-VV B-EP"), ("먹었습니다|먹/VV 었/EP 습니다/EF", "B-VV B-EP B-EF I-EF I-EF"), ("가져왔다|가지/VV 어/EC 오/VV 았/EP 다/EF", "B-VV B-EC B-VV B-EP"), ("해|하/VV 아/EF", "B-VV")]


@query(f"SELECT doc_id, {dealt_sql([b for _, b in _LABELS], 0)} AS labels FROM documents")
def syllable_labels(spark, d):
    """A label for each character: exact where forms spell the word, else in proportion."""
    x = ids(spark, d).select("doc_id", F.split(dealt([a for a, _ in _LABELS], 0), r"\|").alias("x"))
    ms = F.transform(F.split(F.col("x")[1], " "), lambda m: morphemes.morpheme(F.substring_index(m, "/", 1), F.substring_index(m, "/", -1)))
    return x.select("doc_id", F.array_join(morphemes.syllable_labels(F.col("x")[0], ms), " ").alias("labels"))


_CONVERGE = [("하/VV 았/EP|하/VV 었/EP", "하/VV 였/EP"), ("하/VV 았/EP|하/XSV 았/EP", ""), ("먹/VV 았/EP|먹/VV 었/EP", "먹/VV 었/EP"), ("가/VV 다/EF|가/VV 다/EF", "가/VV 다/EF"), ("가/VV|나/VV", "")]


def _candidates(spark, d, slots: int) -> DataFrame:
    """(doc_id, idx, c): candidate readings of each dealt word."""
    x = ids(spark, d).select("doc_id", F.posexplode(F.array(*[dealt([a for a, _ in _CONVERGE], k) for k in range(slots)])).alias("idx", "x"))
    return x.select("doc_id", "idx", F.transform(F.split("x", r"\|"), lambda r: F.transform(F.split(r, " "), lambda m: morphemes.morpheme(F.substring_index(m, "/", 1), F.substring_index(m, "/", -1)))).alias("c"))


@query("SELECT doc_id, idx::INT AS idx, nullif(r, '') AS resolved FROM (SELECT doc_id, unnest([0, 1, 2]) AS idx, unnest([" + ", ".join(dealt_sql([b for _, b in _CONVERGE], k) for k in range(3)) + "]) AS r FROM documents)")
def candidate_convergence(spark, d):
    return _candidates(spark, d, 3).select("doc_id", "idx", _shown(morphemes.converged(F.col("c")), "form").alias("resolved"))


@query("WITH r AS (SELECT doc_id, unnest([0, 1, 2]) AS idx, unnest([" + ", ".join(dealt_sql([b for _, b in _CONVERGE], k) for k in range(3)) + "]) AS r FROM documents) SELECT doc_id, CASE WHEN count(*) FILTER (WHERE r = '') = 0 THEN 'normal' ELSE 'suspicious' END AS status, count(*) FILTER (WHERE r <> '') AS resolved, CASE WHEN count(*) FILTER (WHERE r = '') = 0 THEN string_agg(r, ' ' ORDER BY idx) END AS morphemes FROM r GROUP BY doc_id")
def resolve_sentences(spark, d):
    """Sentences whose unsure words all converge become normal, with their words in order; others stay, partly resolved."""
    r = _candidates(spark, d, 3).select("doc_id", "idx", _shown(morphemes.converged(F.col("c")), "form").alias("r"))
    whole = F.count_if(F.col("r").isNull()) == 0
    g = r.groupBy("doc_id").agg(whole.alias("whole"), F.count("r").alias("resolved"), F.array_sort(F.collect_list(F.struct("idx", "r"))).alias("m"))
    return g.select("doc_id", F.when(F.col("whole"), "normal").otherwise("suspicious").alias("status"), "resolved", F.when(F.col("whole"), F.array_join(F.transform("m", lambda x: x["r"]), " ")).alias("morphemes"))


_KEYS = [("했다|하/XSV 았/EP", "true"), ("했다|가나다/NNG 이/JKS", "false"), ("었다|었/EP 다/EF", "true"), ("갔|가/VV 았/EP", "true"), ("가|가나/VV 다/EF", "false")]


@query(f"SELECT doc_id, {dealt_sql([b for _, b in _KEYS], 0)}::BOOLEAN AS fits FROM documents")
def codebook_key_filter(spark, d):
    x = ids(spark, d).select("doc_id", F.split(dealt([a for a, _ in _KEYS], 0), r"\|").alias("x"))
    ms = F.transform(F.split(F.col("x")[1], " "), lambda m: morphemes.morpheme(F.substring_index(m, "/", 1), F.substring_index(m, "/", -1)))
    return x.select("doc_id", morphemes.fits_key(F.col("x")[0], ms).alias("fits"))


# --- conjugation

_STEMS = "돕:VA 곱:VA 가볍:VA 무겁:VA 걷:VV 듣:VV 깨닫:VV 짓:VV 낫:VV 흐르:VV 모르:VV 부르:VV 아프:VA 크:VA 쓰:VV 바쁘:VA 빨갛:VA 그렇:VA 누렇:VA 마시:VV 배우:VV 나오:VV 좋:VA 입:VV 뒤척이:VV".split()
_FORMS = {  # stem: surfaces of the nine endings, worked out by the rules of the language; '' where there is none
    "돕": "도와 도와서 도와야 도왔 도왔다 도운 도울 도우니 도우면", "곱": "고와 고와서 고와야 고왔 고왔다 고운 고울 고우니 고우면", "가볍": "가벼워 가벼워서 가벼워야 가벼웠 가벼웠다 가벼운 가벼울 가벼우니 가벼우면",
    "무겁": "무거워 무거워서 무거워야 무거웠 무거웠다 무거운 무거울 무거우니 무거우면", "걷": "걸어 걸어서 걸어야 걸었 걸었다 걸은 걸을 걸으니 걸으면", "듣": "들어 들어서 들어야 - - 들은 들을 들으니 들으면",
    "깨닫": "깨달어 깨달어서 깨달어야 깨달았 깨달았다 깨달은 깨달을 깨달으니 깨달으면", "짓": "지어 지어서 지어야 지었 지었다 지은 지을 지으니 지으면", "낫": "나아 나아서 나아야 나았 나았다 나은 나을 나으니 나으면",
    "흐르": "흘러 흘러서 흘러야 흘렀 흘렀다 흐르은 흐르을 흐르으니 흐르으면", "모르": "몰라 몰라서 몰라야 몰랐 몰랐다 모르은 모르을 모르으니 모르으면", "부르": "불러 불러서 불러야 불렀 불렀다 부르은 부르을 부르으니 부르으면",
    "아프": "아파 아파서 아파야 아팠 아팠다 아프은 아프을 아프으니 아프으면", "크": "커 커서 커야 컸 컸다 크은 크을 크으니 크으면", "쓰": "써 써서 써야 썼 썼다 쓰은 쓰을 쓰으니 쓰으면", "바쁘": "바빠 바빠서 바빠야 바빴 바빴다 바쁘은 바쁘을 바쁘으니 바쁘으면",
    "빨갛": "빨개 빨개서 빨개야 빨개었 빨개었다 빨간 빨갈 빨가니 빨가면", "그렇": "그래 그래서 그래야 그래었 그래었다 그런 그럴 그러니 그러면", "누렇": "누래 누래서 누래야 누래었 누래었다 누런 누럴 누러니 누러면",
    "마시": "마셔 마셔서 마셔야 마셨 마셨다 - - - -", "배우": "배워 배워서 배워야 배웠 배웠다 - - - -", "나오": "나와 나와서 나와야 나왔 나왔다 - - - -", "뒤척이": "뒤척여 뒤척여서 뒤척여야 뒤척였 뒤척였다 - - - -",
}


def _conjugated_sql() -> str:
    forms = ", ".join(f"('{s}', '{dict(x.split(':') for x in _STEMS)[s]}', {k}, '{f}')" for s, fs in _FORMS.items() for k, f in enumerate(fs.split()) if f != "-")
    return f"""WITH x AS (SELECT {dealt_sql(_STEMS, 0)} AS s FROM documents), n AS (SELECT string_split(s, ':')[1] AS stem, count(*) AS n FROM x GROUP BY 1),
f(stem, pos, k, surface) AS (VALUES {forms}) SELECT surface, f.stem, pos, ([{", ".join(f"'{e}'" for e, _ in conjugation.ENDINGS)}])[k + 1] AS ending, greatest(n, 100) AS freq FROM f JOIN n USING (stem)
WHERE stem NOT IN ('마시', '배우', '나오') OR n >= 30"""


@query(_conjugated_sql())
def conjugated_forms(spark, d):
    """Conjugated forms of the stems dealt to the documents, by the irregular classes and vowel contraction."""
    s = ids(spark, d).select(F.split(dealt(_STEMS, 0), ":").alias("x")).select(F.col("x")[0].alias("stem"), F.col("x")[1].alias("pos"))
    return conjugation.conjugations(s.groupBy("stem", "pos").agg(F.count("*").alias("freq")))


@query(f"""WITH x AS (SELECT {dealt_sql(['었다', 'ㄴ다', '에서', 'ᆯ', '고', 'ㅂ니다'], 0)} AS s, {dealt_sql([str(k) for k in range(23)], 1)}::INT AS w FROM documents), c AS (SELECT s || (w // 8) AS surface, s AS form, sum(w)::BIGINT AS freq FROM x GROUP BY ALL)
SELECT surface, freq FROM c WHERE freq >= 75 OR freq >= 5 AND regexp_matches(form, '[ㄱ-ㅎᆨ-ᇂ]')""")
def suffix_freq_filter(spark, d):
    """Codebook rows frequent enough; those that hold single letters need less."""
    x = ids(spark, d).select(dealt(["었다", "ㄴ다", "에서", "ᆯ", "고", "ㅂ니다"], 0).alias("s"), dealt([str(k) for k in range(23)], 1).cast("int").alias("w"))
    c = x.groupBy(F.concat("s", F.floor(F.col("w") / 8).cast("string")).alias("surface"), F.col("s").alias("form")).agg(F.sum("w").alias("freq"))
    return conjugation.frequent(c.select("surface", F.array(morphemes.morpheme(F.col("form"), F.lit("EF"))).alias("morphemes"), "freq")).select("surface", "freq")
