"""Registered queries of predicates, generators, features and policies, and their SQL.

Models are stood in for by numbers and texts of the word: a detector's
probability, a ranker's score and a generator's output that both dialects make.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions import protect as K
from lexweave.functions import tables as T
from lexweave.functions import text as X
from lexweave.functions import unicode as U
from lexweave.operators import candidates as C
from lexweave.operators import evaluate as E
from lexweave.operators import features as M
from lexweave.operators import models as H
from lexweave.operators import policies as D
from lexweave.operators import sampling as G
from lexweave.operators import stats as S
from lexweave.plans.queries import _EV, _J4, _KO, _LOW, _MFR, _Q, _SQL, _T, _TOTAL, _UP, _best, _class, _counts, _evaluated, _query, _train, _valid, _words
from lexweave.sources.artifacts import stored
from lexweave.sources.sentences import ACCENTED, BASE, document_sentences

# Letters beyond ASCII as single bytes, for a dialect that counts bytes.
_BYTES = "".join(chr(1 + i) for i in range(8)) + "".join(chr(14 + i) for i in range(13))


def _one_byte(x: str) -> str:
    return f"translate({x}, '{ACCENTED}ß', '{_BYTES}')"


def _lev(a: str, b: str) -> str:
    return f"levenshtein({_one_byte(a)}, {_one_byte(b)})"


def _coll(x: str, k: int) -> str:
    """Runs of one character cut to ``k``."""
    same = " AND ".join(f"c = substr({x}, i - {j}, 1)" for j in range(1, k + 1))
    return f"array_to_string(list_filter(string_split({x}, ''), lambda c, i: i <= {k} OR NOT ({same})), '')"


def _plain(x: str) -> str:
    return f"translate({x}, '’`´', '''''''')"


def _bare(x: str) -> str:
    return f"translate({x}, '{ACCENTED}', '{BASE}')"


def _key(x: str) -> str:
    return _coll(_bare(f"lower({_plain(x)})"), 2)


def _es_bare(x: str) -> str:
    return f"translate({x}, 'áéíóúüñÁÉÍÓÚÜÑ', 'aeiouunAEIOUUN')"


def _es_key(x: str) -> str:
    return _coll(_es_bare(f"lower({_plain(x)})"), 2)


_K1 = lambda x: rf"(trim({x}) = '' OR regexp_matches({x}, '^[@#]') OR regexp_matches({x}, '^https?://') OR regexp_matches({x}, '^\d+([.,:/-]\d+)*$') OR regexp_matches({x}, '^[^\p{{L}}\p{{N}}]+$'))"
_K2 = lambda x: rf"({_K1(x)} OR regexp_matches({x}, '^www\.') OR regexp_matches({x}, '^[A-ZÁÉÍÓÚÜÑ]{{2,5}}$'))"
_K3 = lambda x: rf"(regexp_matches({x}, '(?i)^(https?://|www\.)') OR regexp_matches({x}, '^@[\w\p{{L}}]+') OR regexp_matches({x}, '^#\S+') OR regexp_matches({x}, '^[^_\p{{L}}\p{{N}}]+$'))"
_K7 = lambda x: rf"({x} = '' OR regexp_matches({x}, '^(@|#|http)') OR regexp_matches({x}, '^[0-9]+([:.,/-][0-9]+)*$'))"
_NONWORDS = ", ".join(f"'{w}'" for w in T.IT_NONWORDS)
_K4 = lambda x: rf"({x} = '' OR {_K3(x)} OR regexp_matches({x}, '^[^@\s]+@[^@\s]+\.[^@\s]+$') OR lower({x}) IN ({_NONWORDS}) OR regexp_matches({x}, '(?i)^(a?ha)+h?$|^(e?he)+h?$|^x+d+$') OR {x} IN ({', '.join(repr(a) for a in T.IT_ACRONYMS)}) OR (length({x}) >= 2 AND {_UP(x)}))"
_TH_ADDRESS = r"^(https?://|www\.|[A-Za-z0-9_.-]+\.[A-Za-z]{2,}/?)"
_SHARE = lambda x, p: rf"coalesce(len(regexp_extract_all({x}, '{p}')) / nullif(length({x}), 0), 0)"
_K5 = lambda x: rf"({x} = '' OR regexp_matches({x}, '^[#@]') OR regexp_matches({x}, '{_TH_ADDRESS}') OR (NOT regexp_matches({x}, '[\x{{0E00}}-\x{{0E7F}}]') AND (regexp_matches({x}, '[A-Za-z]') OR regexp_matches({x}, '[0-9]'))) OR (regexp_matches({x}, '[0-9]') AND {_SHARE(x, '[A-Za-z]')} + {_SHARE(x, '[0-9]')} > 0.5))"
_K6 = lambda x: rf"({x} = '' OR regexp_matches({x}, '(?i)^(https?://|www\.)') OR regexp_matches({x}, '^[^@\s]+@[^@\s]+\.[^@\s]+$') OR regexp_matches({x}, '^[+-]?[0-9０-９]+([.,．][0-9０-９]+)?(%|％)?$') OR regexp_matches({x}, '^[0-9０-９]{{1,4}}[/-][0-9０-９]{{1,2}}([/-][0-9０-９]{{1,2}})?$') OR regexp_matches({x}, '^[@#＃]') OR (regexp_matches({x}, '^[A-Za-z][A-Za-z0-9_+.-]*$') AND upper({x}) NOT IN ('RT', 'TL', 'DM', 'GW', 'OK', 'SNS')))"


@_query(f"SELECT DISTINCT norm, {_K4('norm')} AS k4, {_K5('norm')} AS k5, {_K6('norm')} AS k6, {_K7('norm')} AS k7, ({_K7('norm')} OR regexp_matches(norm, '^[^\\p{{L}}\\p{{N}}]+$')) AS k8 FROM pairs")
def k4_protected(t):
    return t.select("norm").distinct().select("norm", *(f("norm").alias(k.lower()) for k, f in K.PROTECTED.items()))


@_query(rf"SELECT DISTINCT norm, regexp_matches(norm, '(?i)^(https?://|www\.)') AS address, regexp_matches(norm, '^[^@\s]+@[^@\s]+\.[^@\s]+$') AS email, regexp_matches(norm, '^@[\w\p{{L}}]+') AS mention, regexp_matches(norm, '^#\S+') AS hashtag, regexp_matches(norm, '^[^_\p{{L}}\p{{N}}]+$') AS signs, length(norm) >= 2 AND {_UP('norm')} AS acronym, length(norm) > 1 AND {_UP('substr(norm, 1, 1)')} AND NOT {_UP('norm')} AS entity, ends_with(norm, '.') OR length(norm) <= 4 AS abbreviation FROM pairs")
def f17_predicates(t):
    kinds = {"address": K.address, "email": K.email, "mention": K.mention, "hashtag": K.hashtag, "signs": K.signs_only, "acronym": K.acronym, "entity": K.named_entity, "abbreviation": K.thai_abbreviation}
    return t.select("norm").distinct().select("norm", *(f("norm").alias(k) for k, f in kinds.items()))


@_query(f"SELECT DISTINCT norm, {_coll(f'lower(strip_accents({_plain("norm")}))', 2)} AS key, len(regexp_extract_all(norm, '[{ACCENTED}]'))::INT AS marks FROM pairs")
def f10_diacritic_key(t):
    return t.select("norm").distinct().select("norm", U.diacritic_key("norm").alias("key"), U.count_marks("norm").alias("marks"))


_SHAPE = _coll("regexp_replace(regexp_replace(regexp_replace(norm, '\\p{Lu}', 'A', 'g'), '\\p{Ll}', 'a', 'g'), '\\p{Nd}', '0', 'g')", 2)
_SHAPE_JA = _coll("regexp_replace(regexp_replace(norm, '\\p{L}', 'a', 'g'), '\\p{Nd}', '0', 'g')", 2)
_CLASS = rf"CASE WHEN norm = '' THEN 'EMPTY' WHEN regexp_matches(norm, '(?i)^(https?://|www\.)') THEN 'URL' WHEN regexp_matches(norm, '^@[\w\p{{L}}]+') THEN 'MENTION' WHEN regexp_matches(norm, '^#\S+') THEN 'HASHTAG' WHEN regexp_matches(norm, '^[^_\p{{L}}\p{{N}}]+$') THEN 'PUNCT' WHEN {_UP('norm')} THEN 'ALLCAPS' WHEN {_LOW('norm')} THEN 'LOWER' WHEN {_UP('substr(norm, 1, 1)')} THEN 'TITLE' WHEN regexp_matches(norm, '[0-9]') THEN 'HASDIGIT' ELSE 'MIXED' END"


@_query(f"SELECT DISTINCT norm, {_SHAPE} AS es, {_SHAPE} AS marked, {_SHAPE_JA} AS ja, {_CLASS} AS class FROM pairs")
def f15_shapes(t):
    return t.select("norm").distinct().select("norm", X.shape_es("norm").alias("es"), X.shape_marked("norm").alias("marked"), X.shape_ja("norm").alias("ja"), X.shape_class("norm").alias("class"))


@_query(f"SELECT DISTINCT raw, norm, CASE WHEN {_UP('norm')} AND length(norm) > 1 THEN upper(raw) WHEN {_UP('substr(norm, 1, 1)')} THEN upper(substr(raw, 1, 1)) || substr(raw, 2) ELSE raw END AS like_norm FROM pairs")
def f16_like_case(t):
    return t.select("raw", "norm").distinct().withColumn("like_norm", X.like_case("norm", "raw"))


@_query("SELECT DISTINCT norm, CASE WHEN length(norm) <= 1 THEN '1' WHEN length(norm) <= 3 THEN '2-3' WHEN length(norm) <= 6 THEN '4-6' WHEN length(norm) <= 10 THEN '7-10' ELSE '11+' END AS bin, CASE WHEN length(norm) / 20 <= 0.1 THEN '<=0.100' WHEN length(norm) / 20 <= 0.5 THEN '<=0.500' ELSE '>0.500' END AS number FROM pairs")
def f23_bins(t):
    return t.select("norm").distinct().select("norm", X.short_length_bin("norm").alias("bin"), X.number_bin(F.length("norm") / 20, [0.1, 0.5]).alias("number"))


@_query("SELECT sent_id, pos, lang, next = '<EOS>' OR next IN ('。', '！', '!', '？', '?', '…', '...') OR (next IN ('」', '｣', '）', ')') AND coalesce(lead(raw, 2) OVER w, '<EOS>') = '<EOS>') AS near_end FROM pairs WINDOW w AS (PARTITION BY sent_id ORDER BY pos)")
def w6_near_end(t):
    return t.select("sent_id", "pos", "lang", K.near_sentence_end("next", "next2").alias("near_end"))


_Q["w7_caps_ratio"] = lambda spark, sf_dir: document_sentences(spark, sf_dir).where(F.size("norm") > 0).select("sent_id", "lang", F.round(K.caps_ratio("norm"), 6).alias("ratio"), X.ratio_bin(K.caps_ratio("norm")).alias("bin"))
_SQL["w7_caps_ratio"] = f"""WITH ws AS (SELECT doc_id, lang, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
l AS (SELECT doc_id, lang, list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}')) AS w FROM ws WHERE len(w) > 0), r AS (SELECT doc_id AS sent_id, lang, coalesce(len(list_filter(w, lambda x: {_UP('x')} AND length(x) > 1)) / nullif(len(w), 0), 0) AS r FROM l)
SELECT sent_id, lang, round(r, 6) AS ratio, CASE WHEN r = 0 THEN '0' WHEN r < 0.25 THEN 'low' WHEN r < 0.6 THEN 'mid' ELSE 'high' END AS bin FROM r"""


def f30_prompts(spark, sf_dir):
    """Every kind of prompt for each word of the conversations' turns."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w"))
    c = c.where(F.size("w") > 0).select("conv_id", "turn", "w", F.posexplode("w").alias("pos", "word"))
    kinds = ("natural", "sentinel", "marked_natural", "lexnorm", "indexed", "action")
    return c.select("conv_id", "turn", "pos", *(X.prompt("w", "pos", F.lit("en"), k).alias(k) for k in kinds), X.prompt("w", "pos", F.lit("en"), "natural", F.array(F.lower("word"))).alias("with_candidates"))


_Q["f30_prompts"] = f30_prompts
_SQL["f30_prompts"] = r"""WITH ws AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM conversations),
p AS (SELECT conv_id, turn, w, unnest(generate_series(0, len(w) - 1))::INT AS pos FROM ws WHERE len(w) > 0),
m AS (SELECT *, array_to_string(w, ' ') AS c, w[pos + 1] AS x, array_to_string(list_transform(w, lambda y, i: CASE WHEN i = pos + 1 THEN '<extra_id_0> ' || y || ' <extra_id_1>' ELSE y END), ' ') AS s FROM p)
SELECT conv_id, turn, pos, 'lang: en word: ' || x || ' context: ' || c AS "natural", s AS sentinel, 'normalize lang: en target: ' || x || ' context: ' || s AS marked_natural, 'lexnorm lang: en word: ' || x || ' context: ' || c AS lexnorm,
 'normalize en: word: ' || x || ' index: ' || pos || ' context: ' || c AS indexed, 'task: lexical_normalization lang: en target: ' || x || ' sentence: ' || s AS "action", 'lang: en word: ' || x || ' context: ' || c || ' candidates: ' || lower(x) AS with_candidates FROM m"""


# --- stand-ins for models ---

_P = "(length(raw) * 37 % 100) / 100"
_SC = "(length(raw) * 37 + length(cand) * 61) % 97 / 97"
_AZ, _CAPS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OUT = f"translate(substr(raw, 1, 1), '{_AZ}', '{_CAPS}') || substr(raw, 2)"


def _p():
    return F.pmod(F.length("raw") * 37, F.lit(100)) / 100


def _score():
    return F.round(F.pmod(F.length("raw") * 37 + F.length("cand") * 61, F.lit(97)) / 97, 6)


def _out():
    return F.concat(F.translate(F.substring("raw", 1, 1), _AZ, _CAPS), X.rest("raw"))


def _scored(t, counts=None):
    """Observed replacements of the training part and the word itself, in order of count, with scores."""
    return S.candidate_tables(_counts(t) if counts is None else counts).select("lang", "raw", "cand", "ord").withColumn("score", _score())


_KT = _KO.replace("FROM cnt", "FROM tr")
_PICK = _KT + f""", sc AS (SELECT lang, raw, cand, ord, round({_SC}, 6) AS score FROM ko), pk AS (SELECT lang, raw, arg_max(cand, score * 1000000 - ord / 1000) AS best, max(score) AS bs, max(CASE WHEN cand = raw THEN score END) AS cs,
 arg_max(cand, score * 1000000 - ord / 1000) FILTER (cand <> raw) AS other, max(score) FILTER (cand <> raw) AS os FROM sc GROUP BY ALL)
"""
_ES_COST = f"""CASE WHEN raw = out THEN 0.0 WHEN {_es_bare(f"lower({_plain('raw')})")} = {_es_bare(f"lower({_plain('out')})")} AND lower({_plain('raw')}) <> lower({_plain('out')}) THEN 0.3
 WHEN {_coll(f"lower({_plain('raw')})", 1)} = lower({_plain('out')}) OR {_coll(f"lower({_plain('raw')})", 2)} = lower({_plain('out')}) THEN 0.3 WHEN {_es_key('raw')} = {_es_key('out')} THEN 0.4 ELSE 9 END"""


@_query(f"SELECT sent_id, pos, lang, raw, {_OUT} AS pred, 'model' AS decision FROM pairs WHERE fold = 0")
def d2_direct(t):
    return D.direct(_valid(t), _out()).select("sent_id", "pos", "lang", "raw", "pred", "decision")


# The output differs from the word in case only, so its cost is never over the limit.
_SAFE_ES = "CASE WHEN NOT (trim(out) = '' OR regexp_matches(lower(out), 'lang:|word:|context:|target:|extra_id') OR length(out) > greatest(20, length(raw) * 3) OR contains(out, ' ')) THEN out END"


@_query(_PICK + f""", e AS (SELECT p.sent_id, p.pos, p.lang, p.raw, {_P.replace('raw', 'p.raw')} AS p, {_OUT.replace('raw', 'p.raw')} AS out, best, bs FROM pairs p LEFT JOIN pk USING (lang, raw) WHERE p.fold = 0),
f AS (SELECT *, {_SAFE_ES} AS made FROM e), d AS (SELECT *, CASE WHEN {_K2('raw')} THEN 'protected' WHEN p < 0.43 THEN 'detector_copy' WHEN best <> raw AND bs >= 0.25 THEN 'ranker' WHEN made IS NOT NULL THEN 'model' ELSE 'model_copy' END AS decision FROM f)
SELECT sent_id, pos, lang, raw, CASE decision WHEN 'ranker' THEN best WHEN 'model' THEN made ELSE raw END AS pred, decision FROM d""")
def d3_spanish_hybrid(t):
    return D.spanish_hybrid(_valid(t), _scored(t), _p(), _out()).select("sent_id", "pos", "lang", "raw", "pred", "decision")


@_query(_PICK + f""", e AS (SELECT p.sent_id, p.pos, p.lang, p.raw, {_P.replace('raw', 'p.raw')} AS p, round(os - coalesce(cs, 0), 6) AS lead, other, {_OUT.replace('raw', 'p.raw')} AS made, round(round({_SC.replace('raw', 'p.raw').replace('cand', 'p.raw')}, 6) - coalesce(cs, 0), 6) AS ml FROM pairs p LEFT JOIN pk USING (lang, raw) WHERE p.fold = 0),
d AS (SELECT *, CASE WHEN {_K2('raw')} THEN 'protected' WHEN lead >= 0.05 THEN 'ranker' WHEN p >= 0.5 AND made <> raw AND ml >= 0 THEN 'model' WHEN p >= 0.5 THEN 'model_copy' ELSE 'margin_copy' END AS decision FROM e)
SELECT sent_id, pos, lang, raw, CASE decision WHEN 'ranker' THEN other WHEN 'model' THEN made ELSE raw END AS pred, decision FROM d""")
def d4_spanish_margin(t):
    made = _valid(t).select("lang", "raw").distinct().withColumn("cand", _out()).withColumn("score", _score())
    return D.spanish_margin(_valid(t), _scored(t), _p(), made, gate=0.5).select("sent_id", "pos", "lang", "raw", "pred", "decision")


_SAFE_IT = rf"CASE WHEN NOT (({_K1('raw')} AND out <> raw) OR length(out) > greatest(length(raw) * 3, 20) OR contains(out, 'http') OR contains(out, 't.co') OR (regexp_matches(out, '^[@#]') AND out <> raw) OR (contains(out, ' ') AND NOT contains(out, '_')) OR (regexp_matches(raw, '^\p{{L}}+$') AND regexp_matches(out, '^\p{{L}}+$') AND length(raw) >= 4 AND length(out) <= 2)) THEN out END"


def _modes(mode: str) -> str:
    asked = "WHEN p < 0.7 THEN 'low_prob_copy' WHEN made IS NOT NULL THEN 'byt5_change' WHEN m <> raw THEN 'byt5_rejected_mfr' ELSE 'byt5_rejected_copy'"
    rest = {"detector_mfr_only": "WHEN m <> raw THEN 'mfr_change' ELSE 'mfr_no_candidate_copy'", "detector_mfr_byt5": f"WHEN m <> raw AND conf >= 0.65 THEN 'mfr_change' {asked}", "detector_byt5": asked}[mode]
    return f"""{_MFR}, e AS (SELECT p.sent_id, p.pos, p.lang, p.raw, {_P.replace('raw', 'p.raw')} AS p, coalesce(m.pred, p.raw) AS m, coalesce(round(m.best_count / m.total, 6), 0) AS conf, {_OUT.replace('raw', 'p.raw')} AS out FROM pairs p LEFT JOIN mfr m USING (lang, raw) WHERE p.fold = 0),
f AS (SELECT *, {_SAFE_IT} AS made FROM e), d AS (SELECT *, CASE WHEN {_K1('raw')} THEN 'protected_copy' WHEN p < 0.5 THEN 'detector_copy' {rest} END AS decision FROM f)
SELECT sent_id, pos, lang, raw, CASE WHEN decision IN ('mfr_change', 'byt5_rejected_mfr') THEN m WHEN decision = 'byt5_change' THEN made ELSE raw END AS pred, decision FROM d"""


def _mode_query(mode):
    def f(t):
        return D.detector_first(_valid(t), S.most_frequent(S.pair_counts(_train(t))), _p(), mode, output=_out()).select("sent_id", "pos", "lang", "raw", "pred", "decision")

    f.__name__ = f"d6_{mode}"
    return f


for _m in ("detector_mfr_only", "detector_mfr_byt5", "detector_byt5"):
    _query(_modes(_m))(_mode_query(_m))


_RANKED = "SELECT sent_id, pos, lang, raw, CASE WHEN decision = '{0}' THEN best ELSE raw END AS pred, decision FROM d"


@_query(_PICK + ", d AS (SELECT p.sent_id, p.pos, p.lang, p.raw, best, CASE WHEN best IS NULL OR best = p.raw THEN 'copy' WHEN bs < 0.3 THEN 'low_score' ELSE 'ranker' END AS decision FROM pairs p LEFT JOIN pk USING (lang, raw) WHERE p.fold = 0) " + _RANKED.format("ranker"))
def d8_italian_ranked(t):
    return D.italian_ranked(_valid(t), _scored(t)).select("sent_id", "pos", "lang", "raw", "pred", "decision")


@_query(_PICK + ", d AS (SELECT p.sent_id, p.pos, p.lang, p.raw, best, CASE WHEN best IS NULL OR best = p.raw THEN 'copy' WHEN bs < 0.2 THEN 'low_score' WHEN round(bs - coalesce(cs, 0), 6) < 0.1 THEN 'low_margin' ELSE 'changed' END AS decision FROM pairs p LEFT JOIN pk USING (lang, raw) WHERE p.fold = 0) " + _RANKED.format("changed"))
def d11_monoise_rank(t):
    return D.monoise_rank(_valid(t), _scored(t)).select("sent_id", "pos", "lang", "raw", "pred", "decision")


def _tool(mode: str) -> str:
    base = "CASE WHEN m <> raw THEN 'mfr' ELSE 'copy' END"
    allowed = ", ".join(repr(c) for c in D.TOOL_CATEGORIES.get(mode, ["-"]))
    decide = {
        "m0_mfr": base,
        "m1_monoise_only": "CASE WHEN tool <> raw THEN 'tool' ELSE 'copy' END",
        "m5_mfr_monoise_agreement_only": f"CASE WHEN tool = m AND m <> raw THEN 'agree' ELSE {base} END",
    }.get(mode, f"CASE WHEN m <> raw THEN 'mfr' WHEN tool <> raw AND category IN ({allowed}) THEN 'tool' WHEN tool <> raw THEN 'blocked' ELSE 'copy' END")
    # The tool's output stands for what it found: the gold word.
    return f"""{_MFR}, e AS (SELECT p.sent_id, p.pos, p.lang, p.raw, p.norm AS tool, coalesce(mfr.pred, p.raw) AS m FROM pairs p LEFT JOIN mfr USING (lang, raw) WHERE p.fold = 0), f AS (SELECT *, {_class('tool')} AS category FROM e),
d AS (SELECT *, {decide} AS decision FROM f) SELECT sent_id, pos, lang, raw, CASE WHEN decision IN ('mfr', 'agree') THEN m WHEN decision = 'tool' THEN tool ELSE raw END AS pred, decision FROM d"""


def _tool_query(mode):
    def f(t):
        return D.external_tool(_valid(t), S.most_frequent(S.pair_counts(_train(t))), F.col("norm"), mode).select("sent_id", "pos", "lang", "raw", "pred", "decision")

    f.__name__ = f"d10_{mode}"
    return f


for _m in ("m0_mfr", "m1_monoise_only", *D.TOOL_CATEGORIES, "m5_mfr_monoise_agreement_only"):
    _query(_tool(_m))(_tool_query(_m))


@_query(_KT + _MFR + f""", sc AS (SELECT lang, raw, cand, ord, round({_SC}, 6) AS p FROM ko), b AS (SELECT k.lang, k.raw, arg_max(cand, p * 1000000 - ord / 1000) AS over, max(p) AS p FROM sc k JOIN mfr USING (lang, raw) WHERE cand <> mfr.pred GROUP BY ALL),
e AS (SELECT p.sent_id, p.pos, p.lang, p.raw, coalesce(mfr.pred, p.raw) AS base, over, b.p FROM pairs p LEFT JOIN mfr USING (lang, raw) LEFT JOIN b USING (lang, raw) WHERE p.fold = 0),
d AS (SELECT *, CASE WHEN coalesce(p >= 0.7, false) THEN 'override_accept' WHEN base = raw THEN 'base_copy' ELSE 'base_mfr_change' END AS decision FROM e) SELECT sent_id, pos, lang, raw, CASE decision WHEN 'override_accept' THEN over WHEN 'base_mfr_change' THEN base ELSE raw END AS pred, decision FROM d""")
def d12_accept_override(t):
    mfr = S.most_frequent(S.pair_counts(_train(t)))
    cands = _scored(t).withColumn("sources", F.array(F.lit("lookup")))
    pairs = D.accept_pairs(cands, mfr).select("lang", "raw", "cand", "ord", F.col("score").alias("p"))
    return D.accept_override(_valid(t), mfr, pairs).select("sent_id", "pos", "lang", "raw", "pred", "decision")


@_query(f"SELECT sent_id, pos, lang, raw, CASE WHEN {_P} < 0.5 THEN raw ELSE {_OUT} END AS pred, CASE WHEN {_P} < 0.5 THEN 'gate_copy' ELSE 'model' END AS decision FROM pairs WHERE fold = 0")
def d13_gated_model(t):
    return D.gated_model(_valid(t), _p(), _out()).select("sent_id", "pos", "lang", "raw", "pred", "decision")


_INFO = ", im AS (" + _best("tr", _T["T2"]) + "), info AS (SELECT lang, raw, pred AS b, total, round(best_count / total, 6) AS br, round(copy / total, 6) AS rr FROM im)\n"


@_query(_INFO + f""", e AS (SELECT p.sent_id, p.pos, p.lang, p.raw, b, total, br, rr FROM pairs p LEFT JOIN info USING (lang, raw) WHERE p.fold = 0),
r AS (SELECT *, CASE WHEN {_K7('raw')} OR regexp_matches(raw, '^[^\\p{{L}}\\p{{N}}]+$') THEN 'protected' WHEN rr >= 0.7 THEN 'train_keep' WHEN b <> raw AND total >= 2 AND br >= 0.8 THEN 'train_change' WHEN total IS NOT NULL THEN 'train_unsure'
 WHEN length(raw) > 3 AND raw <> {_coll('raw', 1)} AND right(raw, 3) = repeat(right(raw, 1), 3) THEN 'syllables' ELSE 'copy' END AS decision FROM e)
SELECT sent_id, pos, lang, raw, CASE decision WHEN 'train_change' THEN b WHEN 'syllables' THEN substr(raw, 1, 1) || regexp_replace(substr(raw, 2), regexp_escape(right(raw, 1)) || '+$', right(raw, 1)) ELSE raw END AS pred, decision FROM r""")
def d16_korean_rules(t):
    return D.korean_rules(_valid(t), S.candidate_info(S.pair_counts(_train(t)))).select("sent_id", "pos", "lang", "raw", "pred", "decision")


@_query(_MFR + ", e AS (SELECT p.sent_id, p.pos, p.lang, p.raw, m.pred AS b FROM pairs p LEFT JOIN mfr m USING (lang, raw) WHERE p.fold = 0), d AS (SELECT *, CASE WHEN regexp_matches(raw, '^(@|#|http)') OR raw = '' THEN 'protected' WHEN b IS NOT NULL THEN 'mfr' ELSE 'copy' END AS decision FROM e) SELECT sent_id, pos, lang, raw, CASE WHEN decision = 'mfr' THEN b ELSE raw END AS pred, decision FROM d")
def d18_korean_rule_mfr(t):
    return D.korean_rule_mfr(_valid(t), S.most_frequent(S.pair_counts(_train(t))), T.KO_DIRECT).select("sent_id", "pos", "lang", "raw", "pred", "decision")


def _cascade_query(name):
    def f(t):
        counts = _counts(t)
        return D.cascade(_valid(t), counts, S.candidate_info(counts), _out(), name).select("sent_id", "pos", "lang", "raw", "pred", "decision")

    f.__name__ = f"{'d18' if name.endswith('v1') else 'd19'}_cascade_{name}"
    return f


_CLEAN = f"CASE WHEN {_K7('raw')} OR length(out) > length(raw) * 3 + 5 THEN raw ELSE out END"
_ROMAN = lambda a, b: f"least({_lev(f'lower({a})', f'lower({b})')}, {_lev(_bare(f'lower({a})'), _bare(f'lower({b})'))})"


def _cascade_sql(name: str) -> str:
    """The cascades without a vocabulary, and those with one for the words that training saw and the nearest words of the others."""
    rule = D.CASCADES[name]
    dist = _lev("out", "cand") if name == "general_v1" else _ROMAN("out", "cand")
    strong, medium = (f"total >= {n} AND br >= {s}" for n, s in (rule.strong, rule.medium))
    other = "cand <> raw" if rule.keep is not None else "true"
    head = f"""{_INFO}, w0 AS (SELECT DISTINCT lang, raw, {_OUT} AS out FROM pairs WHERE fold = 0), w AS (SELECT lang, raw, {_CLEAN} AS out, b, total, br, rr FROM w0 LEFT JOIN info USING (lang, raw)),
pr AS (SELECT w.lang, w.raw, (norm = out)::INT AS hit, {dist.replace('cand', 'norm')} AS dist, -n AS o, norm AS cand FROM w JOIN tr USING (lang, raw)), h AS (SELECT lang, raw, max(hit) AS hit FROM pr GROUP BY ALL),
nn AS (SELECT lang, raw, cand AS nc, dist AS nd FROM (SELECT *, row_number() OVER (PARTITION BY lang, raw ORDER BY dist, o, cand) AS rn FROM pr WHERE {other}) WHERE rn = 1)"""
    if rule.keep is not None:
        first = f"WHEN rr >= {rule.keep} THEN 'train_keep' WHEN b <> raw AND {strong} THEN 'sure'"
        fair = f"WHEN b <> raw AND {medium} AND rr < 0.5 THEN 'fair'"
    else:
        first, fair = f"WHEN {strong} THEN 'sure'", f"WHEN {medium} THEN 'fair'"
    last = "'model'" if rule.end != "copy" else "'copy'"
    return f"""{head}, d AS (SELECT *, CASE WHEN {_K7('raw')} THEN 'protected' {first} WHEN coalesce(hit, 0) = 1 THEN 'observed' WHEN nd <= 1 THEN 'near' {fair} ELSE {last} END AS decision FROM w LEFT JOIN h USING (lang, raw) LEFT JOIN nn USING (lang, raw)),
z AS (SELECT lang, raw, CASE WHEN decision IN ('sure', 'fair') THEN b WHEN decision IN ('observed', 'model') THEN out WHEN decision = 'near' THEN nc ELSE raw END AS pred, decision FROM d) SELECT p.sent_id, p.pos, p.lang, p.raw, z.pred, z.decision FROM pairs p JOIN z USING (lang, raw) WHERE p.fold = 0"""


# The stand-in differs from the word in case only, so for v3 and v4 no unseen word asks for the vocabulary.
for _m in D.CASCADES:
    _query(_cascade_sql(_m) if _m in ("general_v1", "v3", "v4") else None)(_cascade_query(_m))


_HC = _TOTAL.replace("cnt", "tr") + ", hm AS (" + _best("tr", _T["T3"]) + "), hc AS (SELECT lang, raw, pred AS sure FROM hm JOIN ent2 USING (lang, raw) WHERE total >= 3 AND pred <> raw AND best_count / total >= 0.75 AND 1 - copy / total >= 0.5 AND entropy <= 1.25 AND raw NOT IN (" + ", ".join(f"'{w}'" for w in T.JA_NOT_SURE) + "))\n"
_LIST = lambda ws: ", ".join(f"'{w}'" for w in ws)
_SIG = lambda x: f"CASE WHEN concat_ws('+', CASE WHEN regexp_matches({x}, '[A-Za-z]') THEN 'latin' END, CASE WHEN regexp_matches({x}, '[0-9]') THEN 'num' END) = '' THEN 'other' ELSE concat_ws('+', CASE WHEN regexp_matches({x}, '[A-Za-z]') THEN 'latin' END, CASE WHEN regexp_matches({x}, '[0-9]') THEN 'num' END) END"


@_query(_HC + f""", sn AS (SELECT lang, raw, max((raw <> norm)::INT) AS ch, max((length(replace(norm, ' ', '')) > greatest(12, 4 * length(replace(raw, ' ', ''))))::INT) AS lg FROM tr GROUP BY ALL),
nx AS (SELECT *, coalesce(lead(raw, 2) OVER w, '<EOS>') AS next2 FROM pairs WINDOW w AS (PARTITION BY sent_id ORDER BY pos)),
e AS (SELECT p.sent_id, p.pos, p.lang, p.raw, sure, coalesce(ch, 0) = 1 AS ch, coalesce(lg, 0) = 1 AS lg, {_OUT.replace('raw', 'p.raw')} AS out, next = '<EOS>' OR next IN ('。', '！', '!', '？', '?', '…', '...') OR (next IN ('」', '｣', '）', ')') AND next2 = '<EOS>') AS ne FROM nx p LEFT JOIN hc USING (lang, raw) LEFT JOIN sn USING (lang, raw) WHERE p.fold = 0),
d AS (SELECT *, CASE WHEN sure IS NOT NULL THEN 'sure' WHEN {_K6('raw')} THEN 'hard_keep' WHEN raw IN ({_LIST(T.JA_CONTEXT)}) OR ch OR (raw IN ({_LIST(T.JA_ENDS)}) AND ne) THEN 'model' ELSE 'copy' END AS decision FROM e)
SELECT sent_id, pos, lang, raw, CASE decision WHEN 'sure' THEN sure WHEN 'model' THEN CASE WHEN length(out) > 40 AND NOT lg THEN raw WHEN length(out) > greatest(12, 4 * length(raw)) AND NOT lg THEN raw WHEN NOT ch AND raw NOT IN ({_LIST(T.JA_CONTEXT)}) AND {_SIG('raw')} <> {_SIG('out')} AND {_SIG('out')} <> 'other' THEN raw WHEN {_K6('raw')} THEN raw ELSE out END ELSE raw END AS pred, decision FROM d""")
def d21_japanese_scheme(t):
    return D.japanese_scheme(_valid(t), _counts(t), _out()).select("sent_id", "pos", "lang", "raw", "pred", "decision")


@_query(f"SELECT sent_id, pos, lang, raw, CASE WHEN {_P} >= 0.7 AND norm <> raw AND len(list_intersect(string_split(raw, ''), string_split(norm, ''))) > 0 AND length(norm) <= length(raw) * 2.0 + 3 THEN norm ELSE raw END AS pred, CASE WHEN norm = raw THEN 'copy' WHEN {_P} >= 0.7 AND len(list_intersect(string_split(raw, ''), string_split(norm, ''))) > 0 AND length(norm) <= length(raw) * 2.0 + 3 THEN 'model' ELSE 'rejected' END AS decision FROM pairs WHERE fold = 0")
def d23_causal_fallback(t):
    return D.causal_fallback(_valid(t), F.col("norm"), _p()).select("sent_id", "pos", "lang", "raw", "pred", "decision")


_ACT = f"CASE WHEN {_P} < 0.4 THEN 'COPY' WHEN {_P} < 0.8 THEN 'NORM' ELSE 'MALFORMED' END"


def _actions(t):
    made = F.when(_p() < 0.4, "COPY").when(_p() < 0.8, F.concat(F.lit("NORM: "), F.col("norm"))).otherwise("no idea")
    return D.action_labels(_valid(t), made)


@_query(f"SELECT sent_id, pos, lang, raw, CASE WHEN {_ACT} = 'NORM' THEN norm ELSE raw END AS pred, {_ACT} AS decision FROM pairs WHERE fold = 0")
def d26_action_labels(t):
    return _actions(t).select("sent_id", "pos", "lang", "raw", "pred", "decision")


@_query(f", a AS (SELECT *, {_ACT} AS decision, CASE WHEN {_ACT} = 'NORM' THEN norm ELSE raw END AS pred FROM pairs WHERE fold = 0) SELECT lang, count(*) AS total, sum((raw <> norm)::INT)::BIGINT AS changed, sum((decision = 'MALFORMED')::INT)::BIGINT AS malformed, round(sum(((raw <> norm) = (decision = 'NORM'))::INT) / count(*), 6) AS decision_accuracy, round(coalesce(sum((raw <> norm AND decision = 'NORM')::INT) / nullif(sum((raw <> norm)::INT), 0), 0), 6) AS change_recall, round(coalesce(sum((raw <> norm AND decision = 'NORM' AND pred = norm)::INT) / nullif(sum((raw <> norm)::INT), 0), 0), 6) AS text_accuracy, round(coalesce(sum((raw = norm AND decision <> 'NORM')::INT) / nullif(sum((raw = norm)::INT), 0), 0), 6) AS copy_recall FROM a GROUP BY lang")
def e13_action_metrics(t):
    return E.action_metrics(_actions(t))


# --- SQL of queries that compare keys or distances ---

_CHAT = f"lower({_plain('raw')})"
for _a, _b in T.ES_CHAT:
    _CHAT = f"replace({_CHAT}, '{_a}', '{_b}')"


def _cost(raw: str, cand: str) -> str:
    r, k = f"lower({_plain(raw)})", f"lower({_plain(cand)})"
    return f"""CASE WHEN {raw} = {cand} THEN 0.0 WHEN {_es_bare(r)} = {_es_bare(k)} AND {r} <> {k} THEN 0.3 WHEN {_coll(r, 1)} = {k} OR {_coll(r, 2)} = {k} THEN 0.3
 WHEN {_es_key(raw)} = {_es_key(cand)} THEN 0.4 WHEN {_es_key(_CHAT.replace('raw', raw))} = {_es_key(cand)} THEN 0.6 ELSE {_lev(_es_key(raw), _es_key(cand))}::DOUBLE END"""


_WITH = _SQL["a1_pair_counts"][: _SQL["a1_pair_counts"].rindex("SELECT * EXCLUDE")]


def _sql(name: str, text: str) -> None:
    _SQL[name] = _WITH + text


_sql("f6_collapse", f"SELECT DISTINCT norm, {_coll('norm', 2)} AS two, {_coll('norm', 1)} AS one, {_key('norm')} AS key, {_es_key('norm')} AS es_key FROM pairs")
_sql("f4_unicode", f"SELECT DISTINCT norm, norm AS nfkc, strip_accents(norm) AS bare, {_coll('lower(norm)', 2)} AS ja_key, norm AS th FROM pairs")
_sql("f13_jamo", f"SELECT DISTINCT norm, norm AS jamo, 0.6::DOUBLE * {_lev('norm', 'reverse(norm)')} AS dist FROM pairs")
_sql("f12_edit_cost", f"SELECT DISTINCT lang, raw, norm, {_cost('raw', 'norm')} AS cost, {_ROMAN('raw', 'norm')}::INT AS roman, least({_lev('raw', 'norm')}, 5)::INT AS near FROM pairs WHERE raw <> norm")
_KEYED = f""", wk AS (SELECT DISTINCT lang, raw, {_key('raw')} AS key FROM cnt), kc AS (SELECT lang, key, norm, sum(n)::BIGINT AS n FROM cnt JOIN wk USING (lang, raw) GROUP BY ALL)
"""
_C5 = _KEYED + """, w AS (SELECT DISTINCT lang, raw FROM cnt), lk AS (SELECT *, row_number() OVER (PARTITION BY lang, raw ORDER BY n DESC, norm) AS r FROM cnt), kk AS (SELECT wk.lang, wk.raw, kc.norm, row_number() OVER (PARTITION BY wk.lang, wk.raw ORDER BY kc.n DESC, kc.norm) AS r FROM wk JOIN kc USING (lang, key)),
s AS (SELECT lang, raw, raw AS cand, 0 AS o, 'original' AS source, 1 AS r FROM w UNION ALL SELECT lang, raw, norm, 1, 'lookup', r FROM lk WHERE r <= 8 UNION ALL SELECT lang, raw, norm, 2, 'key', r FROM kk WHERE r <= 8 UNION ALL SELECT lang, raw, norm, 3, 'case', r FROM lk WHERE r <= 8)
SELECT lang, raw, cand, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, arg_min(source, o * 1000 + r) AS first_source, min(o * 1000 + r)::INT AS ord FROM s GROUP BY ALL"""
_sql("c5_candidates", _C5)
_sql("x2_provenance", _C5)
_sql("a19_merged_dictionary", _KEYED + """, every AS (SELECT lang, raw, norm AS cand, n::DOUBLE AS s, 'observed' AS src FROM cnt UNION ALL SELECT wk.lang, wk.raw, kc.norm, kc.n * 0.7::DOUBLE, 'normalized_key' FROM wk JOIN kc USING (lang, key)),
b AS (SELECT lang, raw, cand, sum(s) AS s, array_to_string(list_sort(list(DISTINCT src)), ',') AS sources FROM every GROUP BY ALL), c AS (SELECT * FROM b UNION ALL SELECT lang, raw, raw, 0.1, 'copy' FROM (SELECT DISTINCT lang, raw FROM cnt) w WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.lang = w.lang AND b.raw = w.raw AND b.cand = w.raw)),
r AS (SELECT lang, raw, cand, round(s, 6) AS score, sources, row_number() OVER (PARTITION BY lang, raw ORDER BY round(s, 6) DESC, cand)::INT AS ord FROM c) SELECT * FROM r WHERE ord <= 5""")
_sql("d25_dict_gates", ", m AS (" + _best("cnt", _T["T3"]) + f"""), e AS (SELECT lang, raw, pred AS cand, best_count AS bc, total, copy, {_lev(_bare('raw'), _bare('pred'))} / greatest(length(raw), length(pred), 1) AS d FROM m)
SELECT lang, raw, cand, CASE WHEN cand = raw THEN 'same_or_empty' WHEN {_K1('raw')} THEN 'protected' WHEN bc < 3 THEN 'low_pair_count' WHEN bc / total < 0.98 THEN 'low_pair_conf' WHEN (total - copy) / total < 0.9 THEN 'low_change_rate' WHEN d > 0.75 THEN 'far_edit' WHEN length(cand) > length(raw) * 2.0 + 3 THEN 'long_expansion' ELSE 'ok' END AS decision FROM e""")
_ORDERED = "regexp_matches(cand, '(?s)' || array_to_string(list_transform(string_split(raw, ''), lambda c: regexp_escape(c)), '.*'))"
_sql("m_pair_features", f""", c AS (SELECT lang, raw, norm AS cand, n FROM cnt) SELECT *, (raw = cand)::INT AS is_copy, {_lev('raw', 'cand')}::INT AS edit, round({_cost('raw', 'cand')}, 6) AS edit_cost, {_ROMAN('raw', 'cand')}::INT AS roman, (lower(raw) = lower(cand))::INT AS same_lower,
 ({_key('raw')} = {_key('cand')})::INT AS same_key, ({_bare('raw')} = {_bare('cand')})::INT AS same_accentless, (length(cand) - length(raw))::INT AS length_diff, round(length(cand) / greatest(length(raw), 1), 6) AS length_ratio, {_class('cand')} AS kind, {_ORDERED}::INT AS in_order FROM c""")
_SHAPE_RAW = _SHAPE.replace("norm", "raw")
_CASE_RAW = f"CASE WHEN {_LOW('raw')} THEN 'lower' WHEN {_UP('raw')} THEN 'upper' WHEN {_UP('substr(raw,1,1)')} AND {_LOW('substr(raw,2)')} THEN 'title' WHEN lower(raw) = upper(raw) THEN 'none' ELSE 'mixed' END"
_sql("m_detector_features", ", m AS (" + _best("tr", _T["T2"]) + rf"""), st AS (SELECT lang, raw, total, round((total - copy) / total, 6) AS cp, round(copy / total, 6) AS kp, round(best_count / total, 6) AS bp, (pred <> raw)::INT AS bc FROM m)
SELECT p.sent_id, p.pos, p.lang, p.raw, least(length(p.raw), 30)::INT AS length, len(regexp_extract_all(p.raw, '\p{{L}}'))::INT AS letters, len(regexp_extract_all(p.raw, '\p{{Nd}}'))::INT AS digits, len(regexp_extract_all(p.raw, '\p{{Lu}}'))::INT AS capitals,
 (length(p.raw) - length(regexp_replace(p.raw, '[^\x00-\x7F]', '', 'g')))::INT AS accents, ({_coll('p.raw', 2)} <> p.raw)::INT AS repeats, regexp_matches(lower(p.raw), '(ja){{2,}}|(ah|ha){{2,}}')::INT AS laughter, contains({_plain('p.raw')}, '''')::INT AS apostrophe, {_K1('p.raw')}::INT AS protected,
 {_UP('p.raw')}::INT AS upper, {_LOW('p.raw')}::INT AS lower, coalesce(cp, 0) AS change_prob, coalesce(kp, 0) AS copy_prob, coalesce(bp, 0) AS best_prob, coalesce(bc, 0)::DOUBLE AS best_changes, (prev = '<BOS>')::INT AS is_first, (next = '<EOS>')::INT AS is_last, ln(1 + coalesce(total, 0)) AS log_total,
 {_SHAPE_RAW.replace('raw', 'p.raw')} AS shape, {_CASE_RAW.replace('raw', 'p.raw')} AS "case", substr(lower(p.raw), 1, 3) AS prefix3, right(lower(p.raw), 3) AS suffix3, lower(prev) AS prev_low, lower(next) AS next_low, (p.raw <> p.norm)::INT::DOUBLE AS label FROM pairs p LEFT JOIN st USING (lang, raw) WHERE p.fold = 0""")
_U = lambda x: f"replace(upper({x}), 'ẞ', 'SS')"
_sql("c7_case_variants", f""", c AS (SELECT lang, raw, norm AS cand FROM cnt), v AS (SELECT DISTINCT lang, raw, unnest([lower(cand), {_U('cand')}, {_U('substr(cand, 1, 1)')} || lower(substr(cand, 2))]) AS cand FROM c)
SELECT lang, raw, cand, 'lookup' AS source FROM c UNION ALL SELECT lang, raw, cand, 'case_variant' FROM v WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = v.lang AND c.raw = v.raw AND c.cand = v.cand)""")
_A5 = lambda kind, key: f"SELECT '{kind}' AS kind, lang, key, total, pred AS best_norm, best_count, round(best_count / total, 6) AS best_prob FROM (" + _best(f"(SELECT lang, {key} AS key, '' AS raw, norm, sum(n)::BIGINT AS n FROM cnt GROUP BY ALL)", "n DESC, norm", "lang, key") + ")"
_sql("a5_key_counts", " UNION ALL ".join((_A5("plain", _key("raw")), _A5("es", _es_key("raw")), _A5("ja", _coll("lower(raw)", 2)))))


# --- conservative policy, generators, features, selections ---


def _values(name: str, cols: str, rows) -> str:
    q = lambda v: "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"{name} AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(q, r)) + ')' for r in rows)}) v({cols}))"


_ABBREV = _values("sa", "raw, cand", T.IT_SAFE_ABBREV.items())
_CONTEXT = _values("ca", "raw, cand", [(k, c) for k, cs in T.IT_CONTEXT_ABBREV.items() for c in cs])
_DIACRITIC = _values("di", "raw, cand", {**T.IT_DIACRITIC_LOWER, **{k: v for k, v in T.IT_DIACRITIC_EXACT.items() if k == k.lower()}}.items())
_LETTERS = "abcdefghijklmnopqrstuvwxyzäçèéêíñóöü"


def _runs(x: str, keep: int) -> str:
    """Runs of three or more of one letter cut to ``keep``."""
    for ch in _LETTERS:
        x = f"regexp_replace({x}, '{ch}{{3,}}', '{ch * keep}', 'g')"
    return x


@_query(", ex AS (" + _best("tr", _T["T2"]) + "), fo AS (" + _best("tr", _T["T6"]) + f"""), {_ABBREV}, {_CONTEXT}, {_DIACRITIC}, vo AS (SELECT lang, norm AS word, sum(n) AS n FROM tr GROUP BY ALL), w AS (SELECT DISTINCT lang, raw FROM pairs WHERE fold = 0),
x AS (SELECT w.lang, w.raw, ex.pred AS e, coalesce(ex.pred <> w.raw AND round(ex.best_count / ex.total, 6) >= 0.55, false) AS strong, round(ex.best_count / ex.total, 6) AS ec, fo.pred AS f, coalesce(fo.pred <> w.raw AND fo.best_count >= 2 AND round(fo.best_count / fo.total, 6) >= 0.7, false) AS slow, round(fo.best_count / fo.total, 6) AS fc, v.n AS nr, {_K4('w.raw')} AS prot
 FROM w LEFT JOIN ex USING (lang, raw) LEFT JOIN fo USING (lang, raw) LEFT JOIN vo v ON v.lang = w.lang AND v.word = w.raw),
rp AS (SELECT DISTINCT lang, raw, unnest([{_runs('raw', 1)}, {_runs('raw', 2)}]) AS cand FROM w),
c0 AS (SELECT lang, raw, 'exact_mfr' AS source, e AS cand, 6.0::DOUBLE + 3.0::DOUBLE * ec AS base, false AS iv FROM x WHERE strong UNION ALL SELECT lang, raw, 'casefold_mfr', f, 4.4::DOUBLE + 2.2::DOUBLE * fc, false FROM x WHERE slow UNION ALL SELECT x.lang, x.raw, 'diacritics', cand, 4.0, false FROM x JOIN di USING (raw)
 UNION ALL SELECT x.lang, x.raw, 'safe_abbrev', cand, 3.7, false FROM x JOIN sa USING (raw) UNION ALL SELECT x.lang, x.raw, 'context_abbrev', cand, 3.0, false FROM x JOIN ca USING (raw) UNION ALL SELECT lang, raw, 'repeat', cand, 2.7, true FROM rp WHERE cand <> raw),
c1 AS (SELECT c0.*, v.n AS nc, l.n AS nl, nr FROM c0 JOIN x USING (lang, raw) LEFT JOIN vo v ON v.lang = c0.lang AND v.word = c0.cand LEFT JOIN vo l ON l.lang = c0.lang AND l.word = lower(c0.cand) WHERE NOT prot AND (NOT iv OR v.n IS NOT NULL OR l.n IS NOT NULL)),
c2 AS (SELECT lang, raw, source, cand, base + CASE WHEN nc IS NOT NULL THEN 0.9 + least(1.2, ln(nc + 1) / 4) WHEN nl IS NOT NULL THEN 0.55 ELSE 0 END - CASE WHEN nr IS NOT NULL AND source NOT IN ('exact_mfr', 'casefold_mfr') THEN 1.25 ELSE 0 END - CASE WHEN contains(cand, ' ') AND source <> 'exact_mfr' THEN 2.5 ELSE 0 END AS score FROM c1),
cp AS (SELECT lang, raw, round(CASE WHEN nr IS NOT NULL THEN 1.55 + 0.45 ELSE 0 END, 6) AS copy FROM x),
tk AS (SELECT sent_id, pos, p.lang, p.raw, CASE WHEN prev = '<BOS>' THEN '' ELSE lower(prev) END AS pv, CASE WHEN next = '<EOS>' THEN '' ELSE lower(next) END AS nx, x.e, x.strong, x.prot, cp.copy FROM pairs p JOIN x USING (lang, raw) JOIN cp USING (lang, raw) WHERE p.fold = 0),
al AS (SELECT sent_id, pos, copy AS score, raw AS cand, 'copy' AS source FROM tk UNION ALL SELECT sent_id, pos, round(score + CASE WHEN tk.raw = 'x' THEN CASE WHEN regexp_matches(pv, '^[0-9]+$') OR regexp_matches(nx, '^[0-9]+$') THEN -2.0 ELSE 0.25 END WHEN tk.raw = '6' THEN CASE WHEN regexp_matches(pv, '^[0-9]+$') OR regexp_matches(nx, '^[0-9]+$') THEN -2.5 WHEN nx IN ({_LIST(T.IT_AFTER_SEI)}) THEN 1.0 ELSE 0.15 END WHEN tk.raw = 'c' AND cand = 'ci' AND regexp_matches(nx, '[oiae]$') THEN 0.2 ELSE 0 END, 6), cand, source FROM tk JOIN c2 USING (lang, raw)),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sent_id, pos ORDER BY score DESC, cand DESC, source DESC) AS rn FROM al) WHERE rn = 1),
d AS (SELECT tk.*, tp.cand, CASE WHEN prot THEN CASE WHEN strong THEN 'strong' ELSE 'protected' END WHEN tp.cand = tk.raw THEN 'copy' WHEN round(score - copy, 6) < 1.15 OR (contains(tp.cand, ' ') AND tp.source <> 'exact_mfr' AND round(score - copy, 6) < 2.15) THEN 'low_margin' ELSE 'change' END AS decision FROM tk JOIN tp USING (sent_id, pos))
SELECT sent_id, pos, lang, raw, CASE decision WHEN 'strong' THEN e WHEN 'change' THEN cand ELSE raw END AS pred, decision FROM d""")
def d7_italian_conservative(t):
    return D.italian_conservative(_valid(t), _counts(t)).select("sent_id", "pos", "lang", "raw", "pred", "decision")


def d17_korean_ranked(t):
    """Rows only: the least cost is over Korean distances to all words of a block; a test holds small cases."""
    counts = _counts(t)
    return D.korean_ranked(_valid(t), counts, S.candidate_info(counts), _p()).select("sent_id", "pos", "lang", "raw", "pred", "decision")


_query()(d17_korean_ranked)

_TH = ", m AS (" + _best("tr", _T["T3"]) + f"""), th AS (SELECT lang, raw, pred AS mfr, round(best_count / total, 6) AS conf, total FROM m), gd AS (SELECT DISTINCT lang, norm AS cand FROM tr), w AS (SELECT DISTINCT lang, raw FROM pairs WHERE fold = 0),
er AS (SELECT lang, raw, norm, n, sum(n) OVER (PARTITION BY lang, raw) AS errors, row_number() OVER (PARTITION BY lang, raw ORDER BY n DESC, norm) AS r FROM tr WHERE norm <> raw),
ru AS (SELECT lang, raw, cand, i FROM (SELECT lang, raw, unnest(fs) AS cand, generate_subscripts(fs, 1) AS i FROM (SELECT lang, raw, list_filter([{_coll('raw', 2)}, {_coll('raw', 1)}], lambda c: c <> raw AND c <> '') AS fs FROM w WHERE {_coll('raw', 2)} <> raw)))
"""


@_query(_TH + f""", kk AS (SELECT lang, raw, raw AS cand, 'keep' AS source, 0.0::DOUBLE AS score, 0 AS ord FROM w), q AS (SELECT lang, raw, arg_max(norm, n * 10000000000 + (norm = mfr)::INT * 100000000 + r) AS cand, max(n) AS n, any_value(errors) AS errors FROM (SELECT er.*, th.mfr, row_number() OVER (PARTITION BY er.lang, er.raw ORDER BY norm) AS r FROM (SELECT * EXCLUDE (r) FROM er) er JOIN th USING (lang, raw)) SEMI JOIN w USING (lang, raw) GROUP BY ALL),
al AS (SELECT * FROM kk UNION ALL SELECT lang, raw, mfr, 'mfr', 3 + 3 * conf + ln(1 + total) / 4, 1 FROM th SEMI JOIN w USING (lang, raw) WHERE mfr <> raw AND conf >= 0.8 AND total >= 2 UNION ALL SELECT lang, raw, cand, 'errdict', 2.8 + 2 * n / errors + ln(1 + n) / 4, 2 FROM q
 UNION ALL SELECT ru.lang, ru.raw, ru.cand, 'rule', 1.3 + (gd.cand IS NOT NULL)::INT + (ru.cand = coalesce(th.mfr, ru.raw))::INT - 0.15::DOUBLE * least({_lev('ru.raw', 'ru.cand')}, 9), 2 + i FROM ru LEFT JOIN gd ON gd.lang = ru.lang AND gd.cand = ru.cand LEFT JOIN th ON th.lang = ru.lang AND th.raw = ru.raw)
SELECT lang, raw, cand, source, score FROM (SELECT lang, raw, cand, source, round(score, 6) AS score, row_number() OVER (PARTITION BY lang, raw ORDER BY round(score, 6) DESC, ord) AS rn FROM al) WHERE rn = 1""")
def c9_thai_best(t):
    return C.thai_best(_words(t), _counts(t))


@_query(_TH + "SELECT lang, raw, cand, (i - 1)::INT AS ord FROM ru")
def c8_thai_rules(t):
    return C.thai_rules(_valid(t)).select("lang", "raw", "cand", "ord")


def d24_thai_two_stage(t):
    return D.thai_two_stage(_valid(t), _counts(t), _p()).select("sent_id", "pos", "lang", "raw", "pred", "decision")


# No word of the corpus is Thai: all with letters or digits are protected from rules.
_query(_TH + f""", a0 AS (SELECT lang, raw, mfr AS cand, 'mfr' AS source, 2.2 + 2.5 * conf + ln(1 + total) / 5 AS own, 0 AS ord FROM th WHERE mfr <> raw AND conf >= 0.8 AND total >= 2 UNION ALL SELECT lang, raw, norm, 'errdict', 2 + 2 * n / errors + ln(1 + n) / 5, r FROM er WHERE r <= 8 UNION ALL SELECT lang, raw, cand, 'rule', NULL, 99 + i FROM ru),
a1 AS (SELECT a0.*, (gd.cand IS NOT NULL)::INT AS ok, coalesce(mfr, a0.raw) AS mfr, least({_lev('a0.raw', 'a0.cand')}, 21) AS dist FROM a0 SEMI JOIN w USING (lang, raw) LEFT JOIN th ON th.lang = a0.lang AND th.raw = a0.raw LEFT JOIN gd ON gd.lang = a0.lang AND gd.cand = a0.cand),
a2 AS (SELECT *, round(0.7 * ok + 0.8 * (cand = mfr AND cand <> raw)::INT - 0.1::DOUBLE * dist - 0.05::DOUBLE * abs(length(cand) - length(raw)) + coalesce(CASE WHEN source = 'rule' THEN 1.35 + 0.8 * ok ELSE own END, 0), 6) AS score FROM a1 WHERE length(cand) <= greatest(2, length(raw) * 2 + 6) AND (source <> 'rule' OR NOT {_K5('raw')}) AND (source <> 'rule' OR dist / greatest(length(raw), length(cand), 1) <= 0.75)),
bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, raw ORDER BY score DESC, ord) AS rn FROM a2) WHERE rn = 1),
d AS (SELECT p.sent_id, p.pos, p.lang, p.raw, bs.cand, CASE WHEN bs.cand IS NULL THEN 'keep' WHEN NOT ({_P.replace('raw', 'p.raw')} >= 0.5 OR coalesce(th.mfr <> p.raw AND conf >= 0.93 AND total >= 2, false)) THEN 'detector_keep' WHEN round(score + 0.8 * ({_P.replace('raw', 'p.raw')}), 6) < 2.4 THEN 'low_score' ELSE bs.source END AS decision FROM pairs p LEFT JOIN th USING (lang, raw) LEFT JOIN bs USING (lang, raw) WHERE p.fold = 0)
SELECT sent_id, pos, lang, raw, CASE WHEN decision IN ('mfr', 'errdict', 'rule') THEN cand ELSE raw END AS pred, decision FROM d""")(d24_thai_two_stage)

@_query()
def c1_spanish_final(t):
    """Rows only: the SQL for it took minutes; a test holds small cases."""
    return C.spanish_final(_words(t), _counts(t))


_IT3 = ", m AS (" + _best("tr", _T["T2"]) + f"""), vo AS (SELECT DISTINCT lang, norm AS word FROM tr), w AS (SELECT DISTINCT lang, raw FROM pairs WHERE fold = 0), {_values("rd", "raw, cand", [(k, v) for k, v in T.IT_RANKER_DIACRITIC.items() if k == k.lower()])}, {_values("ra", "raw, cand", T.IT_RANKER_ABBREV.items())},
rp AS (SELECT lang, raw, cand, i FROM (SELECT lang, raw, unnest([{_runs('raw', 1)}, {_runs('raw', 2)}]) AS cand, unnest([0, 1]) AS i FROM w) z WHERE cand <> raw AND (EXISTS (SELECT 1 FROM vo WHERE vo.lang = z.lang AND vo.word = z.cand) OR EXISTS (SELECT 1 FROM vo WHERE vo.lang = z.lang AND vo.word = lower(z.cand)))),
al AS (SELECT lang, raw, raw AS cand, 'raw' AS source, 0 AS o FROM w UNION ALL SELECT lang, raw, pred, 'mfr', 1 FROM m SEMI JOIN w USING (lang, raw) WHERE NOT {_K3('raw')} UNION ALL SELECT w.lang, w.raw, cand, 'diacritic', 3 FROM w JOIN rd USING (raw) WHERE NOT {_K3('raw')} UNION ALL SELECT lang, raw, cand, 'repeat', 4 + i FROM rp WHERE NOT {_K3('raw')} UNION ALL SELECT w.lang, w.raw, cand, 'abbrev', 6 FROM w JOIN ra USING (raw) WHERE NOT {_K3('raw')}),
fi AS (SELECT lang, raw, cand, arg_min(source, o) AS source, min(o) AS o FROM al GROUP BY ALL)
SELECT lang, raw, cand, source, (row_number() OVER (PARTITION BY lang, raw ORDER BY o) - 1)::INT AS ord FROM fi"""


@_query(_IT3)
def c3_italian_ranker(t):
    """Words of the corpus are in lower case, so the case-folded dictionary repeats the exact one."""
    return C.italian_ranker(_words(t), _counts(t))


def c6_monoise(t):
    """Rows only: nine sources over four keys; each source has its own test."""
    return C.monoise(_words(t), _counts(t), extended=True).select("lang", "raw", "cand", F.array_join("sources", ",").alias("sources"), "ord")


def c12_korean_rules(t):
    return C.korean_rules(t)


def m4_italian_detector(t):
    return M.italian_detector(_valid(t), _counts(t))


def m5_italian_ranker(t):
    counts = _counts(t)
    tokens = _valid(t).withColumn("caps_ratio", F.lit(0.0))
    return M.italian_ranker(tokens, C.italian_ranker(tokens, counts), counts)


def m7_accept_pairs(t):
    counts = _counts(t)
    cands = stored(C.monoise(_words(t), counts), "candidates").withColumn("score", _score())
    return M.accept_features(D.accept_pairs(cands, S.most_frequent(counts)), counts).drop("sources", "base_sources")


def m9_japanese_detector(t):
    return M.japanese_detector(_valid(t), _counts(t))


def m10_thai_features(t):
    return M.thai_features(_valid(t), S.pair_counts(_train(t))).select("sent_id", "pos", "lang", "raw", *M.THAI_FEATURES)


def h2_text_classifier(t):
    """Probability that a word of the hold-out changes, from its letters."""
    rows = G.thin_unchanged(_train(t), 0.2).select(F.col("raw").alias("text"), (F.col("raw") != F.col("norm")).cast("double").alias("label"))
    score = H.fit_text_classifier(rows, features=1 << 12, positive=3.5)
    return score(_valid(t).select("lang", F.col("raw").alias("text")).distinct()).select("lang", "text", F.round("p", 6).alias("p"))


def g8_corrupted(t):
    return G.corrupt_thai(_valid(t).select("sent_id", "pos", "raw"))


for _f in (c6_monoise, c12_korean_rules, m4_italian_detector, m5_italian_ranker, m7_accept_pairs, m9_japanese_detector, m10_thai_features, h2_text_classifier, g8_corrupted):
    _query()(_f)


@_query(", m AS (" + _best("tr", _T["T2"]) + rf""") SELECT p.sent_id, p.pos, p.lang, p.raw, lower(p.raw) AS tok, lower(prev) AS prev1, lower(next) AS next1, lower(prev) || '|' || lower(p.raw) AS prev_bigram, lower(p.raw) || '|' || lower(next) AS next_bigram, length(p.raw)::INT AS len, round(p.pos / greatest(p.size - 1, 1), 6) AS pos_rel, {_LOW('p.raw')}::INT AS is_lower, {_UP('p.raw')}::INT AS is_upper,
 regexp_matches(p.raw, '\p{{L}}')::INT AS has_alpha, regexp_matches(p.raw, '\p{{Nd}}')::INT AS has_digit, regexp_matches(p.raw, '[^\p{{L}}\p{{N}}]')::INT AS has_punct, regexp_matches(lower(p.raw), 'http|www|\.com')::INT AS has_url_piece, ({_coll('p.raw', 1)} <> p.raw)::INT AS repeated_char, round(len(regexp_extract_all(p.raw, '\p{{L}}')) / greatest(length(p.raw), 1), 6) AS alpha_ratio,
 round(len(regexp_extract_all(p.raw, '[^\p{{L}}\p{{N}}]')) / greatest(length(p.raw), 1), 6) AS punct_ratio, (m.pred IS NOT NULL)::INT AS mfr_seen, coalesce((m.pred <> p.raw)::INT, 0) AS mfr_would_change, lower(coalesce(m.pred, p.raw)) AS mfr_pred, CASE WHEN length(p.raw) >= 4 THEN left(lower(p.raw), 4) END AS prefix4, CASE WHEN length(p.raw) >= 2 THEN right(lower(p.raw), 2) END AS suffix2 FROM pairs p LEFT JOIN m USING (lang, raw) WHERE p.fold = 0""")
def m8_croatian_detector(t):
    f = M.croatian_detector(_valid(t), S.most_frequent(S.pair_counts(_train(t))))
    return f.select("sent_id", "pos", "lang", "raw", "tok", "prev1", "next1", "prev_bigram", "next_bigram", "len", "pos_rel", "is_lower", "is_upper", "has_alpha", "has_digit", "has_punct", "has_url_piece", "repeated_char", "alpha_ratio", "punct_ratio", "mfr_seen", "mfr_would_change", "mfr_pred", "prefix4", "suffix2")


@_query(", m AS (" + _best("tr", _T["T2"]) + rf"""), ek AS (SELECT lang, raw, {_es_key('raw')} AS key FROM (SELECT DISTINCT lang, raw FROM pairs)), kc AS (SELECT lang, key, norm, sum(n)::BIGINT AS n, '' AS raw FROM tr JOIN ek USING (lang, raw) GROUP BY lang, key, norm), kb AS ({_best('kc', 'n DESC, norm', 'lang, key')})
SELECT p.sent_id, p.pos, p.lang, p.raw, p.raw AS raw_lower, ek.key, {_SHAPE_RAW.replace('raw', 'p.raw')} AS shape, least(length(p.raw), 30)::INT AS len, least(len(regexp_extract_all(p.raw, '\p{{L}}')), 30)::INT AS letters, least(len(regexp_extract_all(p.raw, '\p{{Nd}}')), 30)::INT AS digits, least(len(regexp_extract_all(p.raw, '[^\p{{L}}\p{{N}}]')), 30)::INT AS punct, {_K2('p.raw')}::INT AS is_protected, ({_coll('p.raw', 2)} <> p.raw)::INT AS has_long_repetition,
 {_LOW('p.raw')}::INT AS is_all_lower, regexp_matches(p.raw, '[kqxw]')::INT AS has_kqxw, (m.total IS NOT NULL)::INT AS raw_seen, least(coalesce(m.total, 0), 10)::BIGINT AS raw_total, coalesce(round((m.total - m.copy) / m.total, 6), 0) AS raw_change_prob, coalesce(round(m.copy / m.total, 6), 0) AS raw_copy_prob, coalesce((m.pred = p.raw)::INT, 0) AS raw_best_is_copy, coalesce(round(m.best_count / m.total, 6), 0) AS raw_best_prob,
 (kb.total IS NOT NULL)::INT AS key_seen, least(coalesce(kb.total, 0), 10)::BIGINT AS key_total, round(coalesce(kb.best_count / kb.total, 0), 6) AS key_best_prob, coalesce((kb.pred = p.raw)::INT, 0) AS key_best_is_raw, left(ek.key, 3) AS prefix3, right(ek.key, 1) AS suffix1 FROM pairs p JOIN ek USING (lang, raw) LEFT JOIN m USING (lang, raw) LEFT JOIN kb ON kb.lang = p.lang AND kb.key = ek.key WHERE p.fold = 0""")
def m1_spanish_detector(t):
    f = M.spanish_detector(_valid(t), S.pair_counts(_train(t)))
    names = "raw_lower key shape len letters digits punct is_protected has_long_repetition is_all_lower has_kqxw raw_seen raw_total raw_change_prob raw_copy_prob raw_best_is_copy raw_best_prob key_seen key_total key_best_prob key_best_is_raw prefix3 suffix1".split()
    return f.select("sent_id", "pos", "lang", "raw", *names)


_M6 = f""", w AS (SELECT DISTINCT lang, raw FROM pairs WHERE fold = 0), fr AS (SELECT * FROM w WHERE NOT {_K1('raw')}), ak AS (SELECT lang, raw, {_key('raw')} AS key FROM (SELECT DISTINCT lang, raw FROM pairs)), kt AS (SELECT lang, key, norm, sum(n) AS n FROM tr JOIN ak USING (lang, raw) GROUP BY ALL), ct AS (SELECT lang, lower(norm) AS key, norm, sum(n) AS n FROM tr GROUP BY ALL), vo AS (SELECT lang, norm, sum(n) AS n FROM tr GROUP BY ALL),
lk AS (SELECT *, row_number() OVER (PARTITION BY lang, raw ORDER BY n DESC, norm) AS r FROM tr), kr AS (SELECT *, row_number() OVER (PARTITION BY lang, key ORDER BY n DESC, norm) AS r FROM kt), cr AS (SELECT *, row_number() OVER (PARTITION BY lang, key ORDER BY n DESC, norm) AS r FROM ct),
{_values("ia", "raw, cand", [(k, c) for k, cs in T.IT_ABBREV.items() for c in cs])}, rp AS (SELECT DISTINCT lang, raw, unnest([{_coll('raw', 1)}, {_coll('raw', 2)}]) AS cand FROM fr),
al AS (SELECT lang, raw, raw AS cand, 'original' AS source FROM w UNION ALL SELECT lang, raw, norm, 'lookup' FROM fr JOIN lk USING (lang, raw) WHERE r <= 8 UNION ALL SELECT lang, raw, norm, 'mfr' FROM fr JOIN lk USING (lang, raw) WHERE r = 1 UNION ALL SELECT fr.lang, fr.raw, norm, 'key' FROM fr JOIN ak USING (lang, raw) JOIN kr USING (lang, key) WHERE r <= 8 UNION ALL SELECT fr.lang, fr.raw, norm, 'case' FROM fr JOIN cr ON cr.lang = fr.lang AND cr.key = lower(fr.raw) WHERE r <= 8
 UNION ALL SELECT fr.lang, fr.raw, cand, 'rule' FROM fr JOIN ia USING (raw) UNION ALL SELECT fr.lang, fr.raw, cand, 'rule_lower' FROM fr JOIN ia ON ia.raw = lower(fr.raw) UNION ALL SELECT rp.lang, rp.raw, rp.cand, 'repeat' FROM rp JOIN vo ON vo.lang = rp.lang AND vo.norm = rp.cand WHERE rp.cand <> rp.raw),
mo AS (SELECT lang, raw, cand, list_sort(list(DISTINCT source)) AS sources FROM al GROUP BY ALL)
"""


@_query(_M6 + "SELECT lang, raw, cand, array_to_string(sources, ',') AS sources FROM mo")
def c5_monoise(t):
    return C.monoise(_words(t), _counts(t)).select("lang", "raw", "cand", F.array_join("sources", ",").alias("sources"))


@_query(_M6 + f""", rt AS (SELECT lang, raw, sum(n) AS rt, sum(CASE WHEN norm = raw THEN n ELSE 0 END) AS cc FROM tr GROUP BY ALL), ks AS (SELECT lang, key, sum(n) AS kt FROM kt GROUP BY ALL), cs AS (SELECT lang, key, sum(n) AS ct FROM ct GROUP BY ALL),
j AS (SELECT mo.*, ak.key, rt, cc, tr.n AS pc, kt.n AS kc, ks.kt AS kk, ct.n AS lc, cs.ct AS lt, vo.n AS f FROM mo JOIN ak USING (lang, raw) LEFT JOIN rt USING (lang, raw) LEFT JOIN tr ON tr.lang = mo.lang AND tr.raw = mo.raw AND tr.norm = mo.cand LEFT JOIN kt ON kt.lang = mo.lang AND kt.key = ak.key AND kt.norm = mo.cand LEFT JOIN ks ON ks.lang = mo.lang AND ks.key = ak.key
 LEFT JOIN ct ON ct.lang = mo.lang AND ct.key = lower(mo.raw) AND ct.norm = mo.cand LEFT JOIN cs ON cs.lang = mo.lang AND cs.key = lower(mo.raw) LEFT JOIN vo ON vo.lang = mo.lang AND vo.norm = mo.cand)
SELECT lang, raw, cand, (raw = cand)::INT AS is_original, list_contains(sources, 'lookup')::INT AS from_lookup, (list_contains(sources, 'rule') OR list_contains(sources, 'rule_lower'))::INT AS from_rule, len(sources)::INT AS num_sources, coalesce(rt > 0, false)::INT AS raw_seen, round(ln(1 + coalesce(rt, 0)), 6) AS raw_total_log, round(ln(1 + coalesce(pc, 0)), 6) AS pair_count_log, round(coalesce(pc / rt, 0), 6) AS pair_conf, round(coalesce(cc / rt, 0), 6) AS copy_conf,
 round(ln(1 + coalesce(kc, 0)), 6) AS key_count_log, round(coalesce(kc / kk, 0), 6) AS key_conf, round(coalesce(lc / lt, 0), 6) AS case_conf, round(ln(1 + coalesce(f, 0)), 6) AS cand_freq_log, (key = {_key('cand')})::INT AS same_key, (lower({_bare('raw')}) = lower({_bare('cand')}))::INT AS same_accentless, least({_lev('lower(raw)', 'lower(cand)')}, 10)::INT AS edit_distance, least(abs(length(raw) - length(cand)), 40)::INT AS len_diff, {_ORDERED}::INT AS chars_order_preserved FROM j""")
def m6_monoise_features(t):
    counts = _counts(t)
    names = "is_original from_lookup from_rule num_sources raw_seen raw_total_log pair_count_log pair_conf copy_conf key_count_log key_conf case_conf cand_freq_log same_key same_accentless edit_distance len_diff chars_order_preserved".split()
    return M.monoise_features(C.monoise(_words(t), counts), counts).select("lang", "raw", "cand", *names)


@_query(_PICK + ", b AS (SELECT lang, raw, cand, source, score, ord FROM (SELECT lang, raw, cand, ord, score, CASE WHEN ord = 1 THEN 'first' ELSE 'other' END AS source FROM sc)) SELECT lang, raw, cand, source, score, ord FROM b WHERE cand <> raw")
def x4_max_score(t):
    """Each candidate twice, the second time with half its score: the higher stays; copies are taken out."""
    s = _scored(t).withColumn("source", F.when(F.col("ord") == 1, "first").otherwise("other"))
    twice = s.unionByName(s.withColumns({"score": F.col("score") / 2, "source": F.lit("half"), "ord": F.col("ord") + 100}))
    return C.without_copy(C.best_score(twice)).select("lang", "raw", "cand", "source", "score", "ord")


_SET = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"


@_query(_M6 + f"SELECT lang, raw, cand, len(sources)::INT AS num_sources, (len(list_filter(sources, lambda s: NOT list_contains({_SET(T.WEAK_SOURCES)}, s))) = 0)::INT AS weak_only, list_has_any(sources, {_SET(T.STRONG_SOURCES)})::INT AS has_strong, list_contains(sources, 'lookup')::INT AS has_lookup, list_contains(sources, 'mfr')::INT AS has_mfr, list_has_any(sources, ['rule', 'rule_lower'])::INT AS has_rule, list_contains(sources, 'repeat')::INT AS has_repeat, list_contains(sources, 'case')::INT AS has_case, list_contains(sources, 'key')::INT AS has_key, 0 AS has_diacritic FROM mo")
def x5_source_sets(t):
    c = C.monoise(_words(t), _counts(t))
    return c.select("lang", "raw", "cand", *(v.alias(k) for k, v in C.source_sets(F.col("sources")).items()))


@_query(_EV + ", k AS (SELECT *, CASE WHEN raw = norm AND pred <> raw THEN 'false' WHEN raw <> norm AND pred = raw THEN 'missed' END AS kind FROM ev), r AS (SELECT lang, kind, row_number() OVER (PARTITION BY lang, kind ORDER BY sent_id, pos)::INT AS rank, sent_id, pos, raw, norm, pred FROM k WHERE kind IS NOT NULL) SELECT * FROM r WHERE rank <= 20")
def l4_error_listing(t):
    return E.error_listing(_evaluated(t))


@_query(_EV + f", c AS (SELECT lang, raw, norm, pred, {_class('pred')} AS category FROM ev WHERE raw <> pred), n AS (SELECT lang, count(*) AS a FROM ev GROUP BY lang) SELECT c.lang, category, count(*) AS changed, sum((pred = norm)::INT)::BIGINT AS correct, round(count(*) / any_value(a), 6) AS share FROM c JOIN n USING (lang) GROUP BY c.lang, category")
def e9_change_summary(t):
    return E.change_summary(_evaluated(t))


@_query(", i AS (SELECT lang, 'raw' AS kind, raw AS item FROM pairs UNION ALL SELECT lang, 'norm', norm FROM pairs UNION ALL SELECT lang, 'change', raw || ' -> ' || norm FROM pairs WHERE raw <> norm), c AS (SELECT lang, kind, item, count(*) AS n FROM i GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang, kind ORDER BY n DESC, item)::INT AS rank FROM c) SELECT * FROM r WHERE rank <= 20")
def a20_top_words(t):
    return E.top_words(t)


@_query(_EV + ", f AS (SELECT lang, sent_id % 3 AS part, count(*) AS t, sum((raw = norm)::INT) AS s, sum((pred = norm)::INT) AS c FROM ev GROUP BY ALL) SELECT lang, count(*) AS folds, round(avg(round(s / t, 6)), 6) AS lai, round(avg(round(c / t, 6)), 6) AS accuracy, round(avg(round(coalesce((c - s) / nullif(t - s, 0), 0), 6)), 6) AS err FROM f GROUP BY lang")
def e14_fold_means(t):
    parts = _evaluated(t).withColumn("part", F.pmod("sent_id", F.lit(3)))
    return E.fold_means(E.metrics(parts, ("lang", "part")))


_GRID = [round(0.2 + 0.1 * i, 1) for i in range(8)]
_GRID_SQL = ", ".join(map(str, _GRID))


@_query(f", g AS (SELECT unnest([{_GRID_SQL}]::DOUBLE[]) AS threshold), s AS (SELECT lang, threshold, sum((raw <> norm AND {_P} >= threshold)::INT) AS tp, sum((raw = norm AND {_P} >= threshold)::INT) AS fp, sum((raw <> norm AND {_P} < threshold)::INT) AS fn FROM pairs, g WHERE fold = 0 GROUP BY ALL), f AS (SELECT lang, threshold, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM s) SELECT lang, threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, threshold) AS rn FROM f) WHERE rn = 1")
def h9_best_threshold(t):
    return E.best_threshold(E.threshold_sweep(_valid(t).withColumn("p", _p()), "p", _GRID))


_SWEEP = _EV + f", g AS (SELECT unnest([{_GRID_SQL}]::DOUBLE[]) AS threshold), x AS (SELECT *, CASE WHEN {_P} >= threshold THEN pred ELSE raw END AS p2 FROM ev, g), s AS (SELECT lang, threshold, count(*) AS total, sum((raw <> norm)::INT)::BIGINT AS changed, sum((p2 = norm)::INT)::BIGINT AS correct, sum((raw = norm AND p2 <> raw)::INT)::BIGINT AS false_pos FROM x GROUP BY ALL), z AS (SELECT *, round(coalesce((correct - (total - changed)) / nullif(changed, 0), 0), 6) AS err, round(correct / total, 6) AS accuracy FROM s)\n"


def _swept(t):
    return E.error_sweep(_evaluated(t).withColumn("p", _p()), "p", "pred", _GRID)


@_query(_SWEEP + "SELECT * FROM z")
def h10_error_sweep(t):
    return _swept(t)


@_query(_SWEEP + "SELECT lang, threshold, err FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY err DESC, accuracy DESC, false_pos, threshold) AS rn FROM z) WHERE rn = 1")
def h10_best_error_threshold(t):
    return E.best_error_threshold(_swept(t))


@_query(_EV + f", g AS (SELECT unnest([0.3, 0.5, 0.7]::DOUBLE[]) AS threshold), k AS (SELECT 'all' AS config UNION ALL SELECT 'short'), x AS (SELECT *, sent_id % 3 AS part, CASE WHEN {_P} >= threshold AND (config = 'all' OR length(raw) <= 6) THEN pred ELSE raw END AS p2 FROM ev, g, k), f AS (SELECT lang, config, threshold, part, count(*) AS t, sum((raw = norm)::INT) AS s, sum((p2 = norm)::INT) AS c FROM x GROUP BY ALL), m AS (SELECT lang, config, threshold, round(avg(round(coalesce((c - s) / nullif(t - s, 0), 0), 6)), 6) AS err, round(avg(round(c / t, 6)), 6) AS accuracy FROM f GROUP BY ALL) SELECT lang, config, threshold, err, accuracy FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY err DESC, accuracy DESC, config, threshold) AS rn FROM m) WHERE rn = 1")
def h11_select_config(t):
    base = _evaluated(t).withColumns({"p": _p(), "part": F.pmod("sent_id", F.lit(3))})
    out = None
    for config, ok in (("all", F.lit(True)), ("short", F.length("raw") <= 6)):
        for limit in (0.3, 0.5, 0.7):
            used = base.withColumn("pred", F.when((F.col("p") >= limit) & ok, F.col("pred")).otherwise(F.col("raw")))
            part = E.metrics(used, ("lang", "part")).withColumns({"config": F.lit(config), "threshold": F.lit(limit)})
            out = part if out is None else out.unionByName(part)
    return H.select_config(out)


@_query(_MFR + ", e AS (SELECT p.sent_id, p.pos, p.lang, p.raw, coalesce(m.pred, p.raw) AS m FROM pairs p LEFT JOIN mfr m USING (lang, raw) WHERE p.fold = 0) SELECT sent_id, pos, lang, raw, CASE WHEN lang = 'en' THEN raw ELSE m END AS pred, CASE WHEN lang = 'en' OR m = raw THEN 'copy' ELSE 'mfr' END AS decision, CASE WHEN lang = 'en' THEN 'copy' ELSE 'mfr' END AS policy FROM e")
def p6_registry(t):
    """English copies, Spanish asks for a hybrid without a detector and degrades, others have the default."""
    return D.run(_valid(t), D.Resources(S.pair_counts(_train(t))), {"en": "copy", "es": "hybrid"})


@_query(", x AS (SELECT sent_id, pos, lang, raw, norm, CASE WHEN prev = '<BOS>' THEN '' ELSE prev END || ' ' || raw || ' ' || CASE WHEN next = '<EOS>' THEN '' ELSE next END AS text FROM pairs) SELECT sent_id, pos, lang, text FROM x")
def m13_neighbour_text(t):
    return t.select("sent_id", "pos", "lang", M.neighbour_text(t).alias("text"))


@_query("SELECT sent_id, pos, lang, raw, CASE WHEN prev = '<BOS>' THEN '^' ELSE prev END AS prev, CASE WHEN next = '<EOS>' THEN '$' ELSE next END AS next FROM pairs WHERE lang IN ('de', 'fr')")
def p1_language_and_anchors(t):
    from lexweave.sources.sentences import of_language, with_sentinels

    return with_sentinels(of_language(t, "de", "fr"), "anchors").select("sent_id", "pos", "lang", "raw", "prev", "next")


@_query("SELECT sent_id, pos, lang, raw, coalesce(concat_ws(' ', lag(raw, 3) OVER w, lag(raw, 2) OVER w, lag(raw, 1) OVER w), '') AS \"left\", coalesce(concat_ws(' ', lead(raw, 1) OVER w, lead(raw, 2) OVER w, lead(raw, 3) OVER w), '') AS \"right\" FROM pairs WINDOW w AS (PARTITION BY sent_id ORDER BY pos)")
def w3_wide_context(t):
    """Three neighbours on each side, from the sentence's array by the window of its token."""
    from pyspark.sql import Window

    w = Window.partitionBy("sent_id").orderBy("pos")
    near = lambda f, ks: F.concat_ws(" ", *(f("raw", k).over(w) for k in ks))
    return t.select("sent_id", "pos", "lang", "raw", near(F.lag, (3, 2, 1)).alias("left"), near(F.lead, (1, 2, 3)).alias("right"))

# Their SQL equals them on the smallest tables but takes minutes on larger ones, so it is not given.
for _m in ("c5_monoise", "m6_monoise_features", "x5_source_sets"):
    del _SQL[_m]
