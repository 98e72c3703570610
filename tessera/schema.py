"""Types shared by the operators: tags, morphemes, tokens."""

from pyspark.sql import types as T

TAGS = "NNG NNP NNB NR NP VV VA VX VCP VCN MAG MAJ MM IC JKS JKC JKG JKO JKB JKV JKQ JX JC EP EF EC ETN ETM XPN XSN XSV XSA XR SF SP SS SE SO SW SH SL SN".split()
CONTENT = frozenset("NNG NNP NNB NR NP VV VA VX VCP VCN MAG MAJ MM IC XR".split())
PARTICLES = frozenset("JKS JKC JKG JKO JKB JKV JKQ JX JC".split())
FUNCTIONAL = PARTICLES | frozenset("EP EF EC ETN ETM XPN XSN XSV XSA".split())

MORPHEME = T.StructType([T.StructField("form", T.StringType()), T.StructField("pos", T.StringType())])
MORPHEMES = T.ArrayType(MORPHEME)
TOKEN = T.StructType([T.StructField("text", T.StringType()), T.StructField("pos", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
NIKL = "document array<struct<sentence array<struct<form string, word array<struct<id bigint, form string>>, MP array<struct<form string, label string, word_id bigint>>, morpheme array<struct<form string, label string, word_id bigint>>>>>>"
POOL = "surface string, normalized_pos string, votes struct<kiwi int, mecab int, kkma int, komoran int>, in_dict boolean, frequency bigint, source_domains array<string>"
GOLD = "text string, domain string, morphemes array<array<string>>, confidence string, source string"
