"""Rule tables. They must be what they are for right results; all are in natural order."""

from __future__ import annotations

# Italian chat spellings.
IT_SAFE_ABBREV = {
    "cmq": "comunque", "cqm": "comunque", "nn": "non", "nnt": "niente", "nnt.": "niente", "ke": "che", "k": "che", "ki": "chi",
    "xke": "perché", "xké": "perché", "xkè": "perché", "xche": "perché", "xchè": "perché", "xché": "perché", "perke": "perché", "perké": "perché", "perkè": "perché",
    "xò": "però", "xo": "però", "grz": "grazie", "qnd": "quando", "qlc": "qualche", "qlcs": "qualcosa", "qlcn": "qualcuno", "dv": "dove", "cn": "con",
}
IT_CONTEXT_ABBREV = {
    "x": ["per"], "6": ["sei"], "c": ["ci"], "sn": ["sono"], "qst": ["questo", "questa", "questi", "queste"], "qsto": ["questo"], "qsta": ["questa"],
    "qsti": ["questi"], "qste": ["queste"], "tt": ["tutto", "tutta", "tutti", "tutte"], "tutti": ["tutti"],
}
IT_DIACRITIC_EXACT = {"e'": "è", "e`": "è", "e´": "è", "E'": "È", "E`": "È", "E´": "È", "c'e": "c'è", "c'e'": "c'è", "c`e": "c'è", "dov'e": "dov'è", "dov'e'": "dov'è"}
IT_DIACRITIC_LOWER = {
    "perche": "perché", "perche'": "perché", "perchè": "perché", "perké": "perché", "piu": "più", "piu'": "più", "puo": "può", "puo'": "può",
    "cosi": "così", "cosi'": "così", "pero": "però", "pero'": "però", "gia": "già", "gia'": "già", "citta": "città", "citta'": "città",
}
IT_APOSTROPHE_WORDS = ["po'", "po’", "un'", "un’", "l'", "l’", "dell'", "dell’", "all'", "all’", "nell'", "nell’", "sull'", "sull’"]
IT_SPLIT = {"vabbene": "va bene", "vabene": "va bene", "apposto": "a posto", "apparte": "a parte"}
IT_NONWORDS = ["lol", "omg", "rofl", "lmao", "tvb", "tvtb", "ahah", "ahaha", "ahahah", "eheh", "hehe", "boh", "mah", "beh", "bhe"]
IT_ACRONYMS = ["PD", "FI", "M5S", "UE", "USA", "ONU", "CISL", "CGIL", "UIL", "TV", "SMS", "NLP", "COVID"]
IT_QUESTO = {
    "ragazza": "questa", "cosa": "questa", "vita": "questa", "volta": "questa", "settimana": "questa", "ragazze": "queste", "cose": "queste", "volte": "queste",
    "ragazzo": "questo", "giorno": "questo", "mese": "questo", "anno": "questo", "momento": "questo", "giorni": "questi", "mesi": "questi", "anni": "questi", "momenti": "questi",
}
IT_TUTTO = {"i": "tutti", "gli": "tutti", "le": "tutte", "la": "tutta", "una": "tutta", "il": "tutto", "lo": "tutto", "un": "tutto"}
IT_AFTER_SEI = ["triste", "felice", "bello", "bella", "bravo", "brava", "grande"]
# Abbreviations and accents of the Italian ranker.
IT_RANKER_ABBREV = {
    "cmq": "comunque", "nn": "non", "nnt": "niente", "ke": "che", "ki": "chi", "xke": "perché", "xké": "perché", "xkè": "perché", "xche": "perché", "xchè": "perché", "xché": "perché",
    "perke": "perché", "perké": "perché", "perkè": "perché", "grz": "grazie", "qnd": "quando", "cn": "con", "dv": "dove", "x": "per",
}
IT_RANKER_DIACRITIC = {
    "e'": "è", "e`": "è", "e´": "è", "E'": "È", "E`": "È", "E´": "È", "perche": "perché", "perche'": "perché", "perchè": "perché", "perké": "perché", "piu": "più", "piu'": "più",
    "puo": "può", "puo'": "può", "cosi": "così", "cosi'": "così", "pero": "però", "pero'": "però", "gia": "già", "gia'": "già", "citta": "città", "citta'": "città",
}
# Italian abbreviations with several readings.
IT_ABBREV = {
    "nn": ["non"], "nnt": ["niente"], "cmq": ["comunque"], "Cmq": ["Comunque"], "qnd": ["quando"], "qst": ["questo", "questa", "questi", "queste"], "x": ["per"], "X": ["Per"],
    "xke": ["perché"], "xké": ["perché"], "xchè": ["perché"], "ke": ["che"], "k": ["che"], "sn": ["sono"], "dv": ["dove"], "tt": ["tutto", "tutti", "tutte"], "anke": ["anche"],
    "bn": ["bene"], "info": ["informazioni"], "e'": ["è"], "E'": ["È"], "perche'": ["perché"], "perchè": ["perché"], "piu'": ["più"], "li'": ["lì"], "po": ["po'"],
}

# Spanish abbreviations, words that an accent tells apart, and fused phrases.
ES_ABBREV = {
    "bn": ["bien"], "bno": ["bueno"], "bna": ["buena"], "bs": ["besos"], "bss": ["besos"], "bsss": ["besos"], "bsos": ["besos"], "bsoss": ["besos"], "bsits": ["besitos"],
    "cdo": ["cuando"], "cn": ["con"], "cmo": ["como"], "cm": ["como"], "d": ["de"], "dl": ["del"], "q": ["que"], "k": ["que"], "ke": ["que"], "qe": ["que"], "qé": ["qué"],
    "kiero": ["quiero"], "kieres": ["quieres"], "kiere": ["quiere"], "kieren": ["quieren"], "aki": ["aquí"], "akí": ["aquí"], "aqui": ["aquí"],
    "pk": ["porque"], "pq": ["porque"], "xq": ["porque"], "xk": ["porque"], "xke": ["porque"], "xque": ["porque"], "porq": ["porque"], "porqe": ["porque"], "sk": ["es_que"], "sq": ["es_que"],
    "tb": ["también"], "tmb": ["también"], "tp": ["tampoco"], "xfa": ["por_favor"], "xfavor": ["por_favor"], "x": ["por"], "pa": ["para"], "na": ["nada"], "toa": ["toda"], "to": ["todo"],
    "toy": ["estoy"], "toi": ["estoy"], "tas": ["estás"], "ta": ["está"], "tamos": ["estamos"], "dnd": ["donde"], "nd": ["nada"], "m": ["me"], "t": ["te"], "l": ["le"],
}
ES_ACCENTS = {
    "si": ["sí"], "tu": ["tú"], "el": ["él"], "mi": ["mí"], "mas": ["más"], "que": ["qué"], "quien": ["quién"], "cuando": ["cuándo"], "como": ["cómo"], "donde": ["dónde"],
    "esta": ["está", "ésta"], "estas": ["estás", "éstas"], "este": ["éste"], "estos": ["éstos"], "solo": ["sólo"], "se": ["sé"], "de": ["dé"], "te": ["té"], "aun": ["aún"],
    "ahi": ["ahí"], "alli": ["allí"], "aqui": ["aquí"], "dia": ["día"], "dias": ["días"], "tambien": ["también"], "despues": ["después"], "facil": ["fácil"], "dificil": ["difícil"],
    "ultimo": ["último"], "unica": ["única"], "republica": ["república"],
}
ES_FUSED = {"porfavor": "por_favor", "xfavor": "por_favor", "tequiero": "te_quiero", "tquiero": "te_quiero", "tkiero": "te_quiero", "mencanta": "me_encanta", "nose": "no_sé", "aver": "a_ver"}
# Spanish chat letters and what they stand for, replaced in this order.
ES_CHAT = [("k", "qu"), ("ke", "que"), ("ki", "qui"), ("x", "ch"), ("xq", "porque"), ("xk", "porque"), ("w", "gu"), ("w", "bu"), ("ao", "ado")]

# Korean spellings that are replaced, that are replaced on demand, and endings.
KO_DIRECT = {
    "낼": "내일", "낼모레": "내일모레", "담주": "다음주", "담달": "다음달", "담번": "다음번", "담에": "다음에", "낼봐": "내일 봐", "짐": "지금", "지금머해": "지금 뭐해",
    "걍": "그냥", "넘": "너무", "느무": "너무", "넘나": "너무나", "진짜루": "진짜로", "진쨔": "진짜", "진짜아": "진짜",
    "머": "뭐", "머해": "뭐해", "모해": "뭐해", "머함": "뭐함", "모함": "뭐함", "뭐하구": "뭐하고", "모하구": "뭐하고", "어케": "어떻게", "어캐": "어떻게", "어케해": "어떻게 해",
    "어카지": "어떡하지", "어카냐": "어떡하냐", "왤케": "왜 이렇게", "왜케": "왜 이렇게", "일케": "이렇게", "글케": "그렇게",
    "마니": "많이", "마니마니": "많이 많이", "조아": "좋아", "조앙": "좋아", "조아해": "좋아해", "조아용": "좋아요", "시러": "싫어", "시름": "싫음", "싫엉": "싫어",
    "마자": "맞아", "마쟈": "맞아", "맞앙": "맞아", "아냐": "아니야", "아뉘": "아니", "아니얌": "아니야", "안대": "안돼", "안되": "안돼", "안돼여": "안돼요", "돼게": "되게",
    "안뇽": "안녕", "안뇽하세여": "안녕하세요", "안냐세여": "안녕하세요", "안녕하세용": "안녕하세요", "방가": "반가워", "방가방가": "반가워", "하이루": "안녕", "바이루": "잘가",
    "굿밤": "좋은 밤", "굿모닝": "좋은 아침", "ㅇㅇ": "응", "ㅇㅋ": "오케이", "오키": "오케이", "오케": "오케이", "ㄴㄴ": "아니", "노노": "아니", "ㄱㄱ": "고고",
    "ㄱㅊ": "괜찮아", "괜춘": "괜찮아", "괜차나": "괜찮아", "ㄹㅇ": "레알", "ㅇㅈ": "인정", "ㅁㅈ": "맞아", "ㅅㄱ": "수고", "ㅊㅋ": "축하",
    "ㅈㅅ": "죄송", "ㅈㅅㅈㅅ": "죄송 죄송", "죄송여": "죄송해요", "미안해용": "미안해요", "ㄱㅅ": "감사", "ㄳ": "감사", "감사여": "감사해요", "고마워용": "고마워요",
    "개좋아": "정말 좋아", "개웃겨": "정말 웃겨", "개웃김": "정말 웃김", "짱좋아": "정말 좋아", "존맛": "정말 맛있다", "존맛탱": "정말 맛있다", "노잼": "재미없다", "꿀잼": "재미있다",
    "집가는중": "집 가는 중", "가는중": "가는 중", "하는중": "하는 중",
}
KO_AMBIGUOUS = {
    "근데": "그런데", "근대": "그런데", "글고": "그리고", "암튼": "아무튼", "쫌": "좀", "좀만": "조금만", "먼가": "뭔가", "몬가": "뭔가", "먼데": "뭔데", "머야": "뭐야", "모야": "뭐야", "머임": "뭐임", "모임": "뭐임",
}
KO_ENDINGS = [("해용", "해요"), ("에용", "예요"), ("이에용", "이에요"), ("네용", "네요"), ("거든용", "거든요"), ("잖아용", "잖아요")]
KO_CANDIDATES = {
    "낼": ["내일"], "넘": ["너무"], "걍": ["그냥"], "머": ["뭐"], "모해": ["뭐해"], "뭐해?": ["뭐해"], "마니": ["많이"], "조아": ["좋아"], "조앙": ["좋아"], "시러": ["싫어"], "싫엉": ["싫어"],
    "안뇽": ["안녕"], "방가": ["반가워"], "ㄱㅅ": ["감사", "고마워"], "ㅈㅅ": ["죄송", "미안"], "ㅇㅋ": ["오케이"], "ㄴㄴ": ["아니"], "ㅇㅇ": ["응"], "ㅁㅊ": ["미친"], "개웃겨": ["웃겨"],
}

# Japanese tokens whose form follows from the context, that may be deleted, and that end sentences.
JA_CONTEXT = ["ん", "って", "て", "で", "、", "。", "…", "...", "・・", "・・・", "です", "ます", "た", "だ", "ね", "よ", "か", "な", "わ", "〜", "~", "ー", "！", "!", "？", "?", "）", ")", "｣", "」"]
JA_DELETED = ["〜", "~", "！", "!", "ー", "っ", "ッ", "・", "。", "、", "…", "...", "w", "ww", "www", "笑", "え", "わ", "し"]
JA_ENDS = ["です", "ます", "た", "だ", "ね", "よ", "か", "な", "わ", "）", ")", "｣", "」", "…", "。", "、"]
JA_NOT_SURE = [*JA_CONTEXT, "てる", "でる"]
JA_LATIN_WORDS = ["RT", "TL", "DM", "GW", "OK", "SNS"]
JA_FINAL = {w: f"{w} 。" for w in ("です", "ね", "また")}

# Classes of Thai characters.
TH_LEADING, TH_TONES, TH_HANGING, TH_FOLLOWING = "เแโใไ", "่้๊๋", "ัิีึืุู็ํ", "ะาำๅ"
TH_BASE = "กขฃคฅฆงจฉชซฌญฎฏฐฑฒณดตถทธนบปผฝพฟภมยรลวศษสหฬอฮฯๆ"
TH_ZERO_WIDTH = "​‌‍﻿"

# Kinds of sources that need, or give, support.
WEAK_SOURCES = ["case", "key", "diacritic", "split", "split_case", "split_diacritic"]
STRONG_SOURCES = ["lookup", "mfr", "rule", "rule_lower", "repeat", "repeat_key", "repeat_case", "repeat_diacritic"]
