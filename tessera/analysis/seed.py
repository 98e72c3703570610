"""A small hand-made model for fixtures and examples; real ones come from ``Model.load``."""

from __future__ import annotations

from .model import Model

_WORDS = """
나 NP 9000;저 NP 6000;너 NP 4000;뭐 NP 3000;학교 NNG 5000;집 NNG 6000;책 NNG 6000;하늘 NNG 4000;새 NNG 2500;사과 NNG 3000;친구 NNG 5000;오늘 NNG 5000;내일 NNG 3000;날씨 NNG 3000;밥 NNG 4000;물 NNG 5000;사람 NNG 9000;사회 NNG 4000;
목표 NNG 3000;중립 NNG 1500;탄소 NNG 1500;서울 NNP 5000;한국 NNP 5000;공부 NNG 4000;생각 NNG 6000;깨끗 XR 1500;조용 XR 1500;행복 NNG 3000;시 NNG 800;년 NNB 6000;것 NNB 9000;수 NNB 9000;데 NNB 5000;
가 VV 8000;오 VV 7000;먹 VV 5000;보 VV 7000;하 VV 9000;되 VV 7000;읽 VV 3000;날 VV 2500;살 VV 4000;놀 VV 2500;마시 VV 2500;쓰 VV 3000;걷 VV 2500;있 VA 9000;없 VA 8000;좋 VA 6000;크 VA 4000;작 VA 3500;예쁘 VA 2500;아름답 VA 2500;맑 VA 2000;기쁘 VA 2000;
너무 MAG 5000;정말 MAG 5000;잘 MAG 6000;안 MAG 6000;매우 MAG 3000;그리고 MAJ 4000;새 MM 3000;이 MM 5000;그 MM 6000;한 MM 5000;두 MM 3500;이 NP 3000;네 IC 2000
"""
_SUFFIXES = """
이:이/JKS 9000;가:가/JKS 9000;을:을/JKO 9000;를:를/JKO 9000;은:은/JX 8000;는:는/JX 9000;는:는/ETM 8000;도:도/JX 6000;에:에/JKB 8000;에서:에서/JKB 6000;로:로/JKB 4000;으로:으로/JKB 4000;의:의/JKG 7000;와:와/JKB 4000;과:과/JKB 4000;만:만/JX 4000;
다:다/EF 9000;다:다/EC 1500;고:고/EC 8000;지:지/EC 5000;지만:지만/EC 3000;면:면/EC 4000;으면:으면/EC 3000;어:어/EC 6000;아:아/EC 6000;어요:어요/EF 5000;아요:아요/EF 5000;어서:어서/EC 4000;아서:아서/EC 4000;
었다:었/EP+다/EF 7000;았다:았/EP+다/EF 7000;었어요:었/EP+어요/EF 4000;았어요:았/EP+어요/EF 4000;었고:었/EP+고/EC 2500;았고:았/EP+고/EC 2500;었:었/EP 2000;았:았/EP 2000;
ㄴ:ㄴ/ETM 8000;은:은/ETM 7000;ㄹ:ㄹ/ETM 7000;을:을/ETM 5000;ㄴ다:ㄴ다/EF 6000;는다:는다/EF 6000;ㅂ니다:ㅂ니다/EF 5000;습니다:습니다/EF 5000;니다:니다/EF 500;니:니/EC 1500;는데:는데/EC 3000;ㄴ데:ㄴ데/EC 2500;
입니다:이/VCP+ㅂ니다/EF 6000;이다:이/VCP+다/EF 5000;하다:하/XSV+다/EF 4000;한다:하/XSV+ㄴ다/EF 5000;했다:하/XSV+았/EP+다/EF 5000;하는:하/XSV+는/ETM 5000;한:하/XSA+ㄴ/ETM 5000;해요:하/XSV+아요/EF 3000;적:적/XSN 2500;들:들/XSN 5000;들이:들/XSN+이/JKS 3000
"""
_FAVOURED = "NNG JKS;NNG JKO;NNG JX;NNG JKB;NNG JKG;NP JX;NP JKS;NP JKO;NNP JKB;NNP JX;NNG XSV;NNG XSA;XR XSA;VV EP;VA EP;VV EF;VA EF;VV EC;VA EC;VV ETM;VA ETM;EP EF;EP EC;ETM NNG;ETM NNB;JKS VV;JKS VA;JKO VV;JKB VV;MAG VV;MAG VA;MM NNG;EF SF;XSV EP;XSV EF;XSA EF;XSA ETM;NNG VCP;VCP EF;VCP EP;NNG XSN;XSN JKS;JX VV;JX VA;JX NNG;JX MAG;EC VV;EC VX".split(";")


def seed_model() -> Model:
    words: dict[str, list[tuple[str, int]]] = {}
    for entry in _WORDS.replace("\n", "").split(";"):
        surface, pos, freq = entry.split()
        words.setdefault(surface, []).append((pos, int(freq)))
    suffixes: dict[str, list] = {}
    for entry in _SUFFIXES.replace("\n", "").split(";"):
        reading, freq = entry.split()
        key, _, ms = reading.partition(":")
        suffixes.setdefault(key, []).append((tuple(tuple(m.rsplit("/", 1)) for m in ms.split("+")), int(freq)))
    return Model(
        words={k: sorted(v, key=lambda x: -x[1])[:2] for k, v in words.items()}, suffixes=suffixes, bigrams={tuple(p.split()): 1.5 for p in _FAVOURED},
        word_bigrams={"나": [("BOS", "NP", -2.0)]}, cache={"안녕하세요": (("안녕", "NNG"), ("하", "XSA"), ("세요", "EF"))}, params={"max_freq": 10_000, "max_suffix_freq": 10_000},
        adjective_roots=frozenset({"행복", "조용", "깨끗", "안녕"}),
    )
