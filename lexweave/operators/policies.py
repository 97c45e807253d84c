"""Decision policies over tokens, and the registry that runs one for each language.

A policy takes tokens (``sent_id, pos, lang, raw`` and neighbours) and what it
has learned, and adds ``pred`` and ``decision``. Model scores are columns or
tables: whoever has a trained gate, ranker or generator passes its output,
others pass a constant. Words are joined to word-level tables, so candidates
are made and ranked once a word wherever the context plays no part.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import protect as K
from lexweave.functions import tables as T
from lexweave.functions import text as X
from lexweave.functions import unicode as U
from lexweave.operators import candidates as C
from lexweave.operators import stats as S
from lexweave.operators.predict import POLICIES as LOO_POLICIES
from lexweave.operators.predict import backoff, lookup, loo_decisions, mfr_first, rerank_decisions
from lexweave.operators.rules import master_map
from lexweave.sources.artifacts import stored

#: Decimals of scores that are compared, so that ties are ties on every engine.
DIGITS = 6


def _pick(tokens: DataFrame, candidates: DataFrame, keys: tuple[str, ...] = ("lang", "raw")) -> DataFrame:
    """Adds ``best, best_score, copy_score, other, other_score``: the best candidate (the first on ties), the word's own score, the best other one."""
    order = F.struct("score", -F.col("ord"))
    is_copy = F.col("cand") == F.col("raw")
    other = F.when(~is_copy, F.struct(F.col("score").alias("s"), (-F.col("ord")).alias("o"), F.col("cand").alias("c")))
    t = candidates.groupBy(*keys).agg(F.max_by("cand", order).alias("best"), F.max("score").alias("best_score"), F.max(F.when(is_copy, F.col("score"))).alias("copy_score"), F.max(other).alias("z"))
    return tokens.join(t.select(*keys, "best", "best_score", "copy_score", F.col("z.c").alias("other"), F.col("z.s").alias("other_score")), list(keys), "left")


def _decide(tokens: DataFrame, decision: Column, **preds: Column) -> DataFrame:
    """``decision`` and ``pred``: the column named like the decision, else the word."""
    t = tokens.withColumn("decision", decision)
    pred = F.col("raw")
    for name, value in preds.items():
        pred = F.when(F.col("decision") == name, value).otherwise(pred)
    return t.withColumn("pred", pred)


# --- outputs of generators ---


def safe_spanish(raw: Column, output: Column, underscore: bool = True) -> Column:
    """An output without marks of a prompt or spaces, not too long and not too far from the word; else null."""
    o = F.trim(output)
    far = (X.spanish_edit_cost(raw, o) > 4.0) & (X.spanish_key(raw) != X.spanish_key(o))
    bad = (o == "") | F.lower(o).rlike("lang:|word:|context:|target:|extra_id") | (F.length(o) > F.greatest(F.lit(20), F.length(raw) * 3)) | o.contains(" ") | far
    return F.when(~(bad if underscore else bad | o.contains("_")), o)


def safe_italian(raw: Column, output: Column) -> Column:
    """An output that changes no protected word, adds no address or tag and no space, and is not too long or a stump; else null."""
    o = F.trim(output)
    letters = lambda x: x.rlike(r"^\p{L}+$")
    bad = (
        (o == "")
        | X.protected_k1(raw) & (o != raw)
        | (F.length(o) > F.greatest(F.length(raw) * 3, F.lit(20)))
        | o.contains("http")
        | o.contains("t.co")
        | o.rlike("^[@#]") & (o != raw)
        | o.contains(" ") & ~o.contains("_")
        | letters(raw) & letters(o) & (F.length(raw) >= 4) & (F.length(o) <= 2)
    )
    return F.when(~bad, o)


def clean_output(raw: Column, output: Column) -> Column:
    """An output, or the word where the output is empty, a special token or too long, or the word is to be kept (K7)."""
    o = F.trim(output)
    return F.when(o.isNull() | (o == "") | o.isin("<unk>", "<pad>", "</s>") | (F.length(o) > F.length(raw) * 3 + 5) | K.protected_k7(raw), raw).otherwise(o)


def safe_japanese(raw: Column, output: Column, sure: Column, changeable: Column, long_allowed: Column, ratio: float = 4.0, most: int = 40) -> Column:
    """An output after checks, or the word. ``sure``: the learned replacement or null; ``changeable``, ``long_allowed``: what training saw of the word.

    Deletion needs a listed or learned word; long outputs and other scripts need a word that was seen so; protected words (K6) stay.
    """
    decoded = F.trim(output)
    o = F.when(decoded == "<DELETE>", "").otherwise(decoded)
    compact = lambda x: F.length(F.replace(x, F.lit(" "), F.lit("")))
    too_long = (compact(o) > most) | (compact(raw) > 0) & (compact(o) > F.greatest(F.lit(12), F.floor(ratio * compact(raw))))
    jump = (K.script_signature(raw) != K.script_signature(o)) & (K.script_signature(o) != "other")
    return (
        F.when(o.isNull(), raw)
        .when(o == raw, o)
        .when(o == "", F.when(raw.isin(T.JA_DELETED) | F.coalesce(sure == "", F.lit(False)), o).otherwise(raw))
        .when(too_long & ~long_allowed, raw)
        .when(~changeable & ~raw.isin(T.JA_CONTEXT) & jump, raw)
        .when(K.protected_k6(raw), raw)
        .otherwise(o)
    )


# --- policies ---


def direct(tokens: DataFrame, output: Column) -> DataFrame:
    """Every token takes the generator's output; an empty one copies."""
    o = F.trim(output)
    return _decide(tokens, F.when(o.isNull() | (o == ""), "empty_copy").otherwise("model"), model=o)


def spanish_hybrid(tokens: DataFrame, candidates: DataFrame, detector: Column, output: Column | None = None, gate: float = 0.43, accept: float = 0.25, keys: tuple[str, ...] = ("lang", "raw")) -> DataFrame:
    """Protected words (K2) and those under the detector's gate copy; the ranker's best candidate is taken if it scores enough and is another word; else the generator's safe output, or a copy.

    ``candidates``: ``keys, cand, score, ord``. Ties go to the first candidate.
    """
    made = safe_spanish(F.col("raw"), output if output is not None else F.lit(""))
    t = _pick(tokens, candidates, keys).withColumn("made", made)
    ranked = (F.col("best") != F.col("raw")) & (F.col("best_score") >= accept)
    decision = F.when(X.protected_k2("raw"), "protected").when(detector < gate, "detector_copy").when(ranked, "ranker").when(F.col("made").isNotNull(), "model").otherwise("model_copy")
    return _decide(t, decision, ranker=F.col("best"), model=F.col("made"))


def spanish_margin(tokens: DataFrame, candidates: DataFrame, detector: Column, output: DataFrame | None = None, margin: float = 0.05, gate: float = 0.9, output_margin: float = 0.0) -> DataFrame:
    """The best other candidate is taken if it leads the word by a margin; above the detector's gate the generator's output (``lang, raw, cand, score``) is ranked too, with a margin of its own."""
    t = _pick(tokens, candidates)
    lead = F.round(F.col("other_score") - F.coalesce("copy_score", F.lit(0.0)), DIGITS)
    if output is None:
        t = t.withColumns({"made": F.lit(None).cast("string"), "made_score": F.lit(None).cast("double")})
    else:
        t = t.join(output.select("lang", "raw", F.col("cand").alias("made"), F.col("score").alias("made_score")), ["lang", "raw"], "left")
    made_lead = F.round(F.col("made_score") - F.coalesce("copy_score", F.lit(0.0)), DIGITS)
    decision = (
        F.when(X.protected_k2("raw"), "protected")
        .when(lead >= margin, "ranker")
        .when((detector >= gate) & (F.col("made") != F.col("raw")) & (made_lead >= output_margin), "model")
        .when(detector >= gate, "model_copy")
        .otherwise("margin_copy")
    )
    return _decide(t, decision, ranker=F.col("other"), model=F.col("made"))


def detector_first(tokens: DataFrame, mfr: DataFrame, detector: Column, mode: str, threshold: float = 0.5, min_conf: float = 0.65, model_gate: float = 0.7, output: Column | None = None) -> DataFrame:
    """Protected words (K1) and those under the threshold copy; then by ``mode``: detector_mfr_only, detector_mfr_byt5 or detector_byt5. A rejected output falls back to the most frequent replacement."""
    t = tokens.join(S.with_confidence(mfr).select("lang", "raw", F.col("pred").alias("m"), "conf"), ["lang", "raw"], "left")
    t = t.withColumns({"m": F.coalesce("m", "raw"), "conf": F.coalesce("conf", F.lit(0.0)), "made": safe_italian(F.col("raw"), output if output is not None else F.lit(""))})
    changes = F.col("m") != F.col("raw")
    start = F.when(X.protected_k1("raw"), "protected_copy").when(detector < threshold, "detector_copy")
    if mode == "detector_mfr_only":
        decision = start.when(changes, "mfr_change").otherwise("mfr_no_candidate_copy")
    else:
        asked = detector >= model_gate
        rejected = F.when(F.col("made").isNotNull(), "byt5_change").when(changes, "byt5_rejected_mfr").otherwise("byt5_rejected_copy")
        if mode == "detector_mfr_byt5":
            start = start.when(changes & (F.col("conf") >= min_conf), "mfr_change")
        elif mode != "detector_byt5":
            raise ValueError(mode)
        decision = start.when(~asked, "low_prob_copy").otherwise(rejected)
    return _decide(t, decision, mfr_change=F.col("m"), byt5_change=F.col("made"), byt5_rejected_mfr=F.col("m")).drop("m", "conf", "made")


@dataclass(frozen=True)
class ItalianConfig:
    """Sources and numbers of the conservative policy."""

    capitalization: bool = False
    split: bool = False
    min_count_exact: int = 1
    min_conf_exact: float = 0.55
    min_count_casefold: int = 2
    min_conf_casefold: float = 0.70
    margin: float = 1.15
    standard_penalty: float = 1.25
    entity_penalty: float = 1.25
    multiword_penalty: float = 2.50


def italian_conservative(tokens: DataFrame, counts: DataFrame, config: ItalianConfig = ItalianConfig()) -> DataFrame:
    """Scored sources of candidates, of which the best is taken if it leads the copy by a margin (a phrase by 1 more).

    Protected words (K4) change by a strong replacement of their own only.
    Word-level scores are joined, what the neighbours add is an expression of the token.
    """
    words = tokens.select("lang", "raw").distinct().withColumn("low", F.lower("raw"))
    exact = S.with_confidence(S.most_frequent(counts)).select("lang", "raw", F.col("pred").alias("e"), F.col("best_count").alias("en"), F.col("conf").alias("ec"))
    folded = counts.groupBy("lang", F.lower("raw").alias("low"), "norm").agg(F.sum("n").alias("n"))
    folded = S.with_confidence(S.most_frequent(folded, ("lang", "low"), "T6", "low")).select("lang", "low", F.col("pred").alias("f"), F.col("best_count").alias("fn"), F.col("conf").alias("fc"))
    vocabulary = counts.groupBy("lang", F.col("norm").alias("word")).agg(F.sum("n").alias("n"))
    w = words.join(exact, ["lang", "raw"], "left").join(folded, ["lang", "low"], "left")
    w = C.known(C.known(w, "low", vocabulary, "n_low"), "raw", vocabulary, "n_raw")
    entity = K.named_entity("raw")
    w = w.withColumns({
        "strong": F.coalesce((F.col("e") != F.col("raw")) & (F.col("en") >= config.min_count_exact) & (F.col("ec") >= config.min_conf_exact), F.lit(False)),
        "strong_low": F.coalesce((F.col("f") != F.col("raw")) & ~entity & (F.col("fn") >= config.min_count_casefold) & (F.col("fc") >= config.min_conf_casefold), F.lit(False)),
        "protected": K.protected_k4("raw"),
        "copy": F.round(F.when(F.col("n_raw") > 0, 1.55).otherwise(0.0) + F.when(F.col("n_low") > 0, 0.45).otherwise(0.0) + F.when(entity, 0.50).otherwise(0.0) + F.when(K.acronym("raw", T.IT_ACRONYMS), 2.50).otherwise(0.0), DIGITS),
    })
    raw, low = F.col("raw"), F.col("low")
    stem = F.left(raw, F.length(raw) - 1)
    accent = C.mapped(F.lower(F.right(stem, F.lit(1))), dict(zip("aeiou", "àèìòù")))
    final_sign = F.when((F.length(raw) > 3) & raw.rlike("['`´’]$") & ~low.isin(T.IT_APOSTROPHE_WORDS), F.concat(F.left(stem, F.length(stem) - 1), accent))
    marks = F.coalesce(C.mapped(raw, T.IT_DIACRITIC_EXACT), X.like_case(raw, C.mapped(low, T.IT_DIACRITIC_LOWER)), final_sign)
    repeats = F.array_distinct(F.filter(F.array(C._repeat(raw, 1), C._repeat(raw, 2)), lambda x: x.isNotNull() & (x != raw)))
    sources = [
        ("exact_mfr", C.one(F.when(F.col("strong"), F.col("e"))), 6.0 + 3.0 * F.coalesce("ec", F.lit(0.0)), False),
        ("casefold_mfr", C.one(F.when(F.col("strong_low"), F.col("f"))), 4.4 + 2.2 * F.coalesce("fc", F.lit(0.0)), False),
        ("diacritics", C.one(marks), F.lit(4.0), False),
        ("safe_abbrev", C.one(X.like_case(raw, C.mapped(low, T.IT_SAFE_ABBREV))), F.lit(3.7), False),
        ("context_abbrev", C.listed(low, T.IT_CONTEXT_ABBREV), F.lit(3.0), False),
        ("repeat", repeats, F.lit(2.7), True),
    ]
    if config.capitalization:
        sources.append(("capitalization", C.one(F.when(X.is_upper(raw) & (F.length(raw) > 1), low)), F.lit(2.3), True))
        sources.append(("first_capital", C.one(F.when(X.is_lower(raw) & (F.length(raw) > 1), F.concat(F.upper(F.substring(raw, 1, 1)), X.rest(raw)))), F.lit(2.3), True))
    if config.split:
        sources.append(("split", C.one(C.mapped(low, T.IT_SPLIT)), F.lit(2.5), False))

    def rows(source, cands, base, asked):
        return F.transform(cands, lambda x: F.struct(F.lit(source).alias("source"), x.alias("cand"), base.cast("double").alias("base"), F.lit(asked).alias("in_vocabulary")))

    listed = F.concat(*(rows(*s) for s in sources))
    flat = w.where("not protected").select("lang", "raw", "n_raw", F.explode(listed).alias("z")).select("lang", "raw", "n_raw", "z.*").withColumn("cand_low", F.lower("cand"))
    flat = C.known(C.known(flat, "cand", vocabulary, "nc"), "cand_low", vocabulary, "nl")
    # first_capital asks for the candidate itself, repeats for it or its lower case
    flat = flat.where(~F.col("in_vocabulary") | (F.col("nc") > 0) | (F.col("nl") > 0) & (F.col("source") != "first_capital"))
    mfr = F.col("source").isin("exact_mfr", "casefold_mfr")
    fixed = (
        F.col("base")
        + F.when(F.col("nc") > 0, 0.90 + F.least(F.lit(1.20), F.log(F.col("nc") + 1) / 4.0)).when(F.col("nl") > 0, 0.55).otherwise(0.0)
        - F.when((F.col("n_raw") > 0) & ~mfr, config.standard_penalty).otherwise(0.0)
        - F.when(K.named_entity("raw") & ~mfr, config.entity_penalty).otherwise(0.0)
        - F.when(F.col("cand").contains(" ") & (F.col("source") != "exact_mfr"), config.multiword_penalty).otherwise(0.0)
    )
    scored = flat.groupBy("lang", "raw").agg(F.collect_list(F.struct(fixed.alias("score"), "cand", "source")).alias("cands"))
    word = w.select("lang", "raw", "low", "e", "strong", "protected", "copy").join(scored, ["lang", "raw"], "left")
    t = tokens.join(word, ["lang", "raw"], "left")
    mark = lambda x: F.when(F.col(x).isin("<BOS>", "<EOS>"), "").otherwise(F.lower(x))
    before, after = mark("prev"), mark("next")
    digit = before.rlike(r"^\p{Nd}+$") | after.rlike(r"^\p{Nd}+$")
    questo = F.when(after == "", "").otherwise(F.coalesce(C.mapped(after, T.IT_QUESTO), F.when(after.endswith("a"), "questa").when(after.endswith("i"), "questi").otherwise("")))
    tutto = F.when(before == "a", "tutti").otherwise(F.coalesce(C.mapped(after, T.IT_TUTTO), F.lit("")))
    expected = F.when(F.col("low").rlike("^qst[oaie]?$"), questo).when(F.col("low") == "tt", tutto).otherwise("")

    def bonus(cand):
        agrees = F.when(expected == "", 0.0).when(cand == expected, 1.2).otherwise(F.when(F.col("low") == "tt", -0.8).otherwise(-1.0))
        return (
            F.when(F.col("low") == "x", F.when(digit, -2.0).otherwise(0.25))
            .when(F.col("low") == "6", F.when(digit, -2.5).when(after.isin(T.IT_AFTER_SEI), 1.0).otherwise(0.15))
            .when((F.col("low") == "c") & (cand == "ci") & after.rlike("[oiae]$"), 0.20)
            .otherwise(agrees)
        )

    # Where the neighbours say which form fits, it is the only candidate of this source.
    fits = lambda z: (z.getField("source") != "context_abbrev") | ~F.col("low").isin("qst", "tt") | (expected == "") | (z.getField("cand") == expected)
    first = lambda z: (z.getField("source") != "first_capital") | (F.col("pos") == 0)
    kept = F.filter(F.coalesce("cands", F.array().cast("array<struct<score:double,cand:string,source:string>>")), lambda z: fits(z) & first(z))
    own = F.array(F.struct(F.col("copy").alias("score"), F.col("raw").alias("cand"), F.lit("copy").alias("source")))
    every = F.concat(own, F.transform(kept, lambda z: F.struct(F.round(z.getField("score") + bonus(z.getField("cand")), DIGITS).alias("score"), z.getField("cand").alias("cand"), z.getField("source").alias("source"))))
    t = t.withColumn("top", F.array_max(every))
    lead = F.round(F.col("top.score") - F.col("copy"), DIGITS)
    phrase = F.col("top.cand").contains(" ") & (F.col("top.source") != "exact_mfr")
    decision = (
        F.when(F.col("protected"), F.when(F.col("strong"), "strong").otherwise("protected"))
        .when(F.col("top.cand") == F.col("raw"), "copy")
        .when((lead < config.margin) | phrase & (lead < config.margin + 1.0), "low_margin")
        .otherwise("change")
    )
    return _decide(t, decision, strong=F.col("e"), change=F.col("top.cand")).drop("low", "e", "strong", "protected", "copy", "cands", "top")


def italian_ranked(tokens: DataFrame, candidates: DataFrame, threshold: float = 0.3, keys: tuple[str, ...] = ("lang", "raw")) -> DataFrame:
    """The candidate with the highest probability (the first on ties); another word needs the threshold."""
    t = _pick(tokens, candidates, keys)
    decision = F.when(F.col("best").isNull() | (F.col("best") == F.col("raw")), "copy").when(F.col("best_score") < threshold, "low_score").otherwise("ranker")
    return _decide(t, decision, ranker=F.col("best"))


# Categories in which an external tool's changes are taken.
TOOL_CATEGORIES = {
    "m2_mfr_preserve_unseen_safe": ["diacritic", "repeat", "sms_abbrev"],
    "m3_mfr_preserve_unseen_diacritic": ["diacritic"],
    "m4_mfr_or_monoise_agree": ["diacritic", "repeat", "sms_abbrev", "spelling_or_other"],
}


def external_tool(tokens: DataFrame, mfr: DataFrame, output: Column, mode: str) -> DataFrame:
    """What becomes of a tool's output: m0 most frequent only, m1 the tool only, m2 to m4 the tool in some categories where the most frequent replacement copies, m5 only where both agree."""
    t = lookup(tokens, mfr).withColumnRenamed("pred", "m").withColumn("tool", F.coalesce(output, "raw"))
    base = F.when(F.col("m") != F.col("raw"), "mfr").otherwise("copy")
    if mode == "m0_mfr":
        decision = base
    elif mode == "m1_monoise_only":
        decision = F.when(F.col("tool") != F.col("raw"), "tool").otherwise("copy")
    elif mode == "m5_mfr_monoise_agreement_only":
        decision = F.when((F.col("tool") == F.col("m")) & (F.col("m") != F.col("raw")), "agree").otherwise(base)
    else:
        allowed = X.mapping_class("raw", "tool").isin(TOOL_CATEGORIES[mode])
        decision = F.when(base == "mfr", base).when((F.col("tool") != F.col("raw")) & allowed, "tool").when(F.col("tool") != F.col("raw"), "blocked").otherwise("copy")
    return _decide(t, decision, mfr=F.col("m"), tool=F.col("tool"), agree=F.col("m")).drop("m", "tool")


def monoise_rank(tokens: DataFrame, candidates: DataFrame, min_score: float = 0.20, margin: float = 0.10, keys: tuple[str, ...] = ("lang", "raw")) -> DataFrame:
    """The ranker's best candidate if it is another word, scores enough and leads the word by a margin."""
    t = _pick(tokens, candidates, keys)
    lead = F.round(F.col("best_score") - F.coalesce("copy_score", F.lit(0.0)), DIGITS)
    decision = F.when(F.col("best").isNull() | (F.col("best") == F.col("raw")), "copy").when(F.col("best_score") < min_score, "low_score").when(lead < margin, "low_margin").otherwise("changed")
    return _decide(t, decision, changed=F.col("best"))


def accept_pairs(candidates: DataFrame, mfr: DataFrame) -> DataFrame:
    """Each candidate (``lang, raw, cand, sources, score, ord``) beside the word's base, its most frequent replacement: the rows that an accept model judges.

    A base that no source has comes with the source ``base_mfr`` and score 0.
    """
    base = S.with_confidence(mfr).select("lang", "raw", F.col("pred").alias("base"), "conf", "total")
    words = candidates.select("lang", "raw").distinct().join(base, ["lang", "raw"], "left").withColumns({"base": F.coalesce("base", "raw"), "conf": F.coalesce("conf", F.lit(0.0)), "total": F.coalesce("total", F.lit(0))})
    own = candidates.select("lang", "raw", F.col("cand").alias("base"), F.col("sources").alias("base_sources"), F.col("score").alias("base_score"))
    words = words.join(own, ["lang", "raw", "base"], "left").withColumns({"base_sources": F.coalesce("base_sources", F.array(F.lit("base_mfr"))), "base_score": F.coalesce("base_score", F.lit(0.0))})
    top = candidates.groupBy("lang", "raw").agg(F.max("score").alias("top_score"), F.max_by("cand", F.struct("score", -F.col("ord"))).alias("top"))
    return candidates.join(words, ["lang", "raw"]).join(top, ["lang", "raw"]).where("cand <> base").withColumn("is_best", (F.col("cand") == F.col("top")).cast("int")).drop("top")


def accept_override(tokens: DataFrame, mfr: DataFrame, accepted: DataFrame, threshold: float = 0.70, keys: tuple[str, ...] = ("lang", "raw")) -> DataFrame:
    """The most frequent replacement, overridden by the candidate of the highest accept probability (``keys, cand, p, ord``) from the threshold on; the first wins ties."""
    best = accepted.groupBy(*keys).agg(F.max(F.struct("p", (-F.col("ord")).alias("o"), "cand")).alias("z")).select(*keys, F.col("z.cand").alias("over"), F.col("z.p").alias("p"))
    t = lookup(tokens, mfr).withColumnRenamed("pred", "base").join(best, list(keys), "left")
    decision = F.when(F.coalesce(F.col("p") >= threshold, F.lit(False)), "override_accept").when(F.col("base") == F.col("raw"), "base_copy").otherwise("base_mfr_change")
    return _decide(t, decision, override_accept=F.col("over"), base_mfr_change=F.col("base")).drop("base", "over", "p")


def gated_model(tokens: DataFrame, detector: Column, output: Column, threshold: float = 0.5) -> DataFrame:
    """Above the threshold the generator's output, the word where that is empty; else a copy."""
    o = F.trim(output)
    return _decide(tokens, F.when(detector < threshold, "gate_copy").when(o.isNull() | (o == ""), "empty_copy").otherwise("model"), model=o)


def korean_rules(tokens: DataFrame, info: DataFrame, aggressive: bool = False, keep: float = 0.70, change: float = 0.80) -> DataFrame:
    """Kept words (K8) copy; words of the training part follow its gates, or the direct table where seen at most twice; others the tables, then emotes, syllables and endings.

    ``info``: ``lang, raw, pred, total, best_ratio, raw_ratio``.
    """
    t = tokens.join(info.withColumnRenamed("pred", "b"), ["lang", "raw"], "left")
    rule = C.mapped(F.col("raw"), T.KO_DIRECT)
    extra = C.mapped(F.col("raw"), T.KO_AMBIGUOUS) if aggressive else F.lit(None).cast("string")
    t = t.withColumns({"direct": rule, "ambiguous": extra, "emote": X.short_emote("raw"), "syllables": X.short_syllables("raw"), "ending": X.plain_ending("raw")})
    decision = (
        F.when(K.protected_k8("raw"), "protected")
        .when(F.col("raw_ratio") >= keep, "train_keep")
        .when((F.col("b") != F.col("raw")) & (F.col("total") >= 2) & (F.col("best_ratio") >= change), "train_change")
        .when(F.col("total").isNotNull() & ~(F.col("direct").isNotNull() & (F.col("total") <= 2)), "train_unsure")
    )
    for name in ("direct", "ambiguous", "emote", "syllables", "ending"):
        decision = decision.when(F.col(name).isNotNull(), name)
    made = {k: F.col(k) for k in ("direct", "ambiguous", "emote", "syllables", "ending")}
    return _decide(t, decision.otherwise("copy"), train_change=F.col("b"), **made).drop("b", "total", "best_ratio", "raw_ratio", *made)


def korean_ranked(tokens: DataFrame, counts: DataFrame, info: DataFrame, change_p: Column) -> DataFrame:
    """Training gates, then a classifier's gates, then the least cost of observed and near words.

    Cost: Korean distance, 0.8 for a word that was not observed, less 0.15 ln(1 + count) and half the probability, plus 0.15 a
    syllable of difference. A word that training does not know needs a probability of 0.75 and a distance of 1.2 (1.8 over three syllables).
    """
    t = tokens.withColumn("change_p", change_p).join(info.withColumnRenamed("pred", "b"), ["lang", "raw"], "left")
    gated = (
        F.when(K.protected_k7("raw"), "protected")
        .when(F.col("raw_ratio") >= 0.70, "train_keep")
        .when((F.col("b") != F.col("raw")) & (F.col("total") >= 2) & (F.col("best_ratio") >= 0.80) & (F.col("change_p") >= 0.35), "train_change")
        .when(F.col("change_p") < 0.60, "classifier_keep")
    )
    # Only words that pass the gates ask for candidates.
    words = t.where(gated.isNull()).select("lang", "raw").distinct()
    vocabulary = counts.groupBy("lang", F.col("norm").alias("word")).agg(F.sum("n").alias("n"))
    seen = counts.where("norm <> raw").join(words, ["lang", "raw"], "left_semi").select("lang", "raw", F.col("norm").alias("cand"), F.lit(0.0).alias("penalty"), "n", (-F.col("n")).alias("o"))
    near = C.near_vocabulary(words, vocabulary, "ko").select("lang", "raw", "cand", F.lit(0.8).alias("penalty"), F.lit(1).cast("long").alias("n"), F.col("r").cast("long").alias("o"))
    # An observed candidate stands for a near one of equal count or less.
    every = seen.unionByName(near).groupBy("lang", "raw", "cand").agg(F.max(F.struct("n", (-F.col("penalty")).alias("p"))).alias("z"), F.min(F.struct("penalty", "o")).alias("place"))
    every = every.select("lang", "raw", "cand", F.col("z.n").alias("n"), (-F.col("z.p")).alias("penalty"), "place").withColumn("dist", F.round(X.korean_distance("raw", "cand"), DIGITS))
    cost = F.round(F.col("dist") + F.col("penalty") - 0.15 * F.log1p("n") + 0.15 * F.abs(F.length("cand") - F.length("raw")), DIGITS)
    best = every.withColumn("cost", cost).groupBy("lang", "raw").agg(F.min(F.struct("cost", "place", "cand", "dist")).alias("z")).select("lang", "raw", F.col("z.cand").alias("c"), F.col("z.dist").alias("d"))
    t = t.join(best, ["lang", "raw"], "left")
    unseen = F.col("total").isNull()
    decision = (
        gated
        .when(F.col("c").isNull(), "no_candidate")
        .when(unseen & ((F.col("change_p") < 0.75) | (F.col("d") > F.when(F.length("raw") <= 3, 1.2).otherwise(1.8))), "unseen_keep")
        .otherwise("ranked")
    )
    return _decide(t, decision, train_change=F.col("b"), ranked=F.col("c")).drop("b", "total", "best_ratio", "raw_ratio", "c", "d", "change_p")


def korean_rule_mfr(tokens: DataFrame, mfr: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Tags and addresses copy; then the most frequent replacement of a known word, then a rule."""
    t = tokens.join(mfr.select("lang", "raw", F.col("pred").alias("b")), ["lang", "raw"], "left").withColumn("rule", C.mapped(F.col("raw"), rules))
    decision = F.when(F.col("raw").rlike("^(@|#|http)") | (F.col("raw") == ""), "protected").when(F.col("b").isNotNull(), "mfr").when(F.col("rule").isNotNull(), "rule").otherwise("copy")
    return _decide(t, decision, mfr=F.col("b"), rule=F.col("rule")).drop("b", "rule")


def guard(raw: Column, cand: Column, support: str) -> Column:
    """``cand`` if it is not too far from the word for its support (strong, medium or weak), else the word; kept words (K7) stay."""
    n, dist = F.length(raw), X.roman_distance(raw, cand)
    short, share = {"strong": (None, None), "medium": (2, 0.5), "weak": (1, 0.4)}[support]
    near = F.lit(True) if short is None else F.when(n <= 4, dist <= short).otherwise(dist <= F.greatest(F.lit(2), F.floor(n * share)))
    return F.when(K.protected_k7(raw), raw).when(near, cand).otherwise(raw)


@dataclass(frozen=True)
class Cascade:
    """One cascade over observed candidates, near words and a generator's output.

    ``distance``: of outputs and candidates. ``strong``, ``medium``: least count and share at which the most frequent replacement is taken.
    """

    distance: Callable[[Column, Column], Column] = X.roman_distance
    near: float = 1.0
    strong: tuple[int, float] = (3, 0.85)
    medium: tuple[int, float] = (2, 0.75)
    keep: float | None = 0.70
    rules: bool = False
    vocabulary: str = "strict"
    end: str = "copy"


# Thresholds of the cascades. v1: any language, Korean; v2 to v4: Spanish and Italian.
CASCADES = {
    "general_v1": Cascade(X.edit_distance, 1.0, (3, 0.90), (2, 0.70), None, False, "none", "model"),
    "korean_v1": Cascade(X.korean_distance, 1.2, (3, 0.90), (2, 0.70), None, True, "none", "model"),
    "v2": Cascade(X.roman_distance, 1.0, (3, 0.90), (2, 0.70), None, False, "open", "guarded"),
    "v3": Cascade(vocabulary="nearest"),
    "v4": Cascade(vocabulary="first"),
}


def cascade(tokens: DataFrame, counts: DataFrame, info: DataFrame, output: Column, name: str) -> DataFrame:
    """Kept words copy; a sure replacement; the output where it was observed, else the observed word nearest to it; for unseen words a near word of the vocabulary; a fairly sure replacement; then copy, model or guarded model.

    ``output``: the generator's text for the word; all tokens of a word have one. Decisions are made once a word.
    """
    rule = CASCADES[name]
    w = tokens.select("lang", "raw", output.alias("out")).groupBy("lang", "raw").agg(F.min("out").alias("out"))
    w = w.withColumn("out", clean_output(F.col("raw"), F.col("out"))).join(info.withColumnRenamed("pred", "b"), ["lang", "raw"], "left")
    w = stored(w, "words")
    seen = counts.select("lang", "raw", F.col("norm").alias("cand"), (-F.col("n")).alias("o"))
    if rule.rules:
        made = C.korean_rules(w).select("lang", "raw", "cand", F.col("ord").cast("long").alias("o"))
        w = w.join(made.groupBy("lang", "raw").agg(F.count("*").alias("rules"), F.min_by("cand", "o").alias("rule")), ["lang", "raw"], "left")
        seen = seen.unionByName(made).groupBy("lang", "raw", "cand").agg(F.min("o").alias("o"))
    pairs = w.select("lang", "raw", "out").join(seen, ["lang", "raw"]).withColumns({"hit": (F.col("cand") == F.col("out")).cast("int"), "dist": F.round(rule.distance(F.col("out"), F.col("cand")).cast("double"), DIGITS)})
    other = F.when(F.col("cand") != F.col("raw"), F.struct("dist", "o", "cand")) if rule.keep is not None else F.struct("dist", "o", "cand")
    w = w.join(pairs.groupBy("lang", "raw").agg(F.max("hit").alias("hit"), F.min(other).alias("near")), ["lang", "raw"], "left")
    sure = lambda k: (F.col("total") >= k[0]) & (F.col("best_ratio") >= k[1])
    known = F.col("total").isNotNull()
    decision = F.when(K.protected_k7("raw"), "protected")
    made = {"observed": F.col("out"), "near": F.col("near.cand"), "sure": F.col("b"), "fair": F.col("b")}
    if rule.keep is not None:
        differs = F.col("b") != F.col("raw")
        decision = decision.when(known & (F.col("raw_ratio") >= rule.keep), "train_keep").when(known & differs & sure(rule.strong), "sure")
    else:
        decision = decision.when(known & sure(rule.strong), "sure")
    decision = decision.when(F.coalesce(F.col("hit"), F.lit(0)) == 1, "observed").when(F.col("near.dist") <= rule.near, "near")
    if rule.rules:
        decision = decision.when((F.col("rules") == 1) & (F.coalesce("total", F.lit(0)) <= 1), "rule")
        made["rule"] = F.col("rule")
    if rule.vocabulary != "none":
        undecided = w.where(decision.isNull()) if rule.keep is None else w.where(decision.isNull() & ~known)
        w = w.join(_vocabulary_choice(undecided, counts, rule), ["lang", "raw"], "left")
        made["vocabulary"] = F.col("v")
        ok = F.col("v").isNotNull() & (F.col("v") != F.col("raw"))
        if rule.keep is not None:
            fair = known & (F.col("b") != F.col("raw")) & sure(rule.medium) & (F.col("raw_ratio") < 0.50)
            decision = decision.when(fair, "fair").when(~known & ok, "vocabulary")
        else:
            decision = decision.when(ok, "vocabulary").when(known & sure(rule.medium), "fair")
    else:
        decision = decision.when(known & sure(rule.medium), "fair")
    if rule.end != "copy":
        made["model"] = F.col("out") if rule.end == "model" else guard(F.col("raw"), F.col("out"), "weak")
    decided = _decide(w, decision.otherwise("model" if rule.end != "copy" else "copy"), **made)
    return tokens.join(decided.select("lang", "raw", "pred", "decision"), ["lang", "raw"], "left")


def _vocabulary_choice(words: DataFrame, counts: DataFrame, rule: Cascade) -> DataFrame:
    """``lang, raw, v``: the vocabulary word near the output or the word.

    ``open``: nearest to the output, then to the word, under the medium guard. ``nearest``: the same among words within one edit of the
    output and one (two over four letters) of the word, where the output differs at all. ``first``: the first of these by distance and count.
    """
    vocabulary = counts.groupBy("lang", F.col("norm").alias("word")).agg(F.sum("n").alias("n"))
    asked = words.select("lang", "raw", F.explode(F.array_distinct(F.array("raw", "out"))).alias("q"))
    near = C.near_vocabulary(asked.select("lang", F.col("q").alias("raw")), vocabulary, "roman").withColumnRenamed("raw", "q")
    found = asked.join(near, ["lang", "q"]).groupBy("lang", "raw", "cand").agg(F.min("dist").alias("dist"), F.max("n").alias("n"))
    found = found.join(words.select("lang", "raw", "out"), ["lang", "raw"]).withColumns({"to_out": X.roman_distance("cand", "out"), "to_raw": X.roman_distance("cand", "raw")})
    if rule.vocabulary == "open":
        best = found.groupBy("lang", "raw").agg(F.min(F.struct("to_out", "to_raw", F.length("cand").alias("l"), "cand")).alias("z"))
        return best.select("lang", "raw", guard(F.col("raw"), F.col("z.cand"), "medium").alias("v"))
    bare = lambda x: X.strip_accents(F.lower(F.col(x)))
    good = (bare("out") != bare("raw")) & (bare("cand") != bare("raw")) & (F.col("to_out") <= 1) & (F.col("to_raw") <= F.when(F.length("raw") <= 4, 1).otherwise(2))
    order = F.struct("to_out", "to_raw", F.length("cand").alias("l"), "cand") if rule.vocabulary == "nearest" else F.struct("dist", (-F.col("n")).alias("o"), "cand")
    return found.where(good).groupBy("lang", "raw").agg(F.min(order).alias("z")).select("lang", "raw", F.col("z.cand").alias("v"))


def japanese_scheme(tokens: DataFrame, counts: DataFrame, output: Column | None = None) -> DataFrame:
    """Sure replacements; hard-kept words (K6) copy; context words, changed words, final signs and drawn-out words take the generator's output after its safety checks; others copy."""
    sure = S.high_confidence(counts, exclude=tuple(T.JA_NOT_SURE)).select("lang", "raw", F.col("pred").alias("sure"))
    ratio = F.length(F.replace("norm", F.lit(" "), F.lit(""))) > F.greatest(F.lit(12), F.floor(4.0 * F.length(F.replace("raw", F.lit(" "), F.lit("")))))
    seen = counts.groupBy("lang", "raw").agg(F.max((F.col("raw") != F.col("norm")).cast("int")).alias("changes"), F.max(ratio.cast("int")).alias("long"))
    t = tokens.join(sure, ["lang", "raw"], "left").join(seen, ["lang", "raw"], "left")
    changes, long = (F.coalesce(F.col(c) == 1, F.lit(False)) for c in ("changes", "long"))
    raw = F.col("raw")
    asked = raw.isin(T.JA_CONTEXT) | changes | raw.isin(T.JA_ENDS) & K.near_sentence_end("next", "next2") | K.has_japanese(raw) & raw.rlike("[ー〜]|っ$")
    made = safe_japanese(raw, output if output is not None else F.lit(None).cast("string"), F.col("sure"), changes, long)
    decision = F.when(F.col("sure").isNotNull(), "sure").when(K.protected_k6(raw), "hard_keep").when(asked, "model").otherwise("copy")
    return _decide(t.withColumn("made", made), decision, sure=F.col("sure"), model=F.col("made")).drop("sure", "changes", "long", "made")


def causal_fallback(tokens: DataFrame, output: Column, p: Column, least: float = 0.70, longest: float = 2.0) -> DataFrame:
    """A classifier's or language model's replacement where it is sure, shares a character with the word and is not too long; else a copy."""
    o = F.trim(output)
    shared = F.size(F.array_intersect(F.split(F.col("raw"), ""), F.split(o, ""))) > 0
    ok = (o != "") & (p >= least) & shared & (F.length(o) <= F.length("raw") * longest + 3)
    return _decide(tokens, F.when(o == F.col("raw"), "copy").when(F.coalesce(ok, F.lit(False)), "model").otherwise("rejected"), model=o)


def thai_two_stage(tokens: DataFrame, counts: DataFrame, detector: Column, threshold: float = 0.5, output: DataFrame | None = None, min_conf: float = 0.80, min_count: int = 2, force: float = 0.93, accept: float = 2.40, max_ratio: float = 0.75, most: int = 8, bonus: float = 0.0) -> DataFrame:
    """Candidates of the most frequent replacement, error dictionary, rules and a generator (``lang, raw, cand``) that pass checks are scored; the best is taken from ``accept`` on where the detector or a very sure replacement allows a change.

    Validity and what does not depend on the detector are worked out once a word.
    """
    words = tokens.select("lang", "raw").distinct()
    mfr = S.with_confidence(S.most_frequent(counts, tie="T3")).select("lang", "raw", F.col("pred").alias("mfr"), "conf", "total")
    gold = counts.select("lang", F.col("norm").alias("cand")).distinct().withColumn("correct", F.lit(1))
    w = words.join(mfr, ["lang", "raw"], "left").withColumns({"mfr": F.coalesce("mfr", "raw"), "conf": F.coalesce("conf", F.lit(0.0)), "total": F.coalesce("total", F.lit(0))})
    errors = counts.where("norm <> raw")
    sums = errors.groupBy("lang", "raw").agg(F.sum("n").alias("errors"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("lang", "raw").orderBy(F.col("n").desc(), "norm"))
    none, zero = F.lit(None).cast("double"), F.lit(0.0)
    sure = w.where((F.col("mfr") != F.col("raw")) & (F.col("conf") >= min_conf) & (F.col("total") >= min_count)).select("lang", "raw", F.col("mfr").alias("cand"), F.lit("mfr").alias("source"), (2.2 + 2.5 * F.col("conf") + F.log1p("total") / 5.0).alias("own"), F.lit(0).alias("ord"))
    listed = errors.withColumn("r", rank).where(F.col("r") <= most).join(sums, ["lang", "raw"]).join(words, ["lang", "raw"], "left_semi")
    listed = listed.select("lang", "raw", F.col("norm").alias("cand"), F.lit("errdict").alias("source"), (2.0 + 2.0 * F.col("n") / F.col("errors") + F.log1p("n") / 5.0).alias("own"), F.col("r").alias("ord"))
    rules = C.thai_rules(words, most).select("lang", "raw", "cand", "source", none.alias("own"), (F.col("ord") + 100).alias("ord"))
    every = sure.unionByName(listed).unionByName(rules)
    if output is not None:
        every = every.unionByName(output.select("lang", "raw", F.trim("cand").alias("cand"), F.lit("byt5").alias("source"), none.alias("own"), F.lit(200).alias("ord")))
    c = every.join(w, ["lang", "raw"]).join(gold, ["lang", "cand"], "left")
    raw, cand, source = F.col("raw"), F.col("cand"), F.col("source")
    trusted, correct = source.isin("mfr", "errdict"), F.coalesce(F.col("correct"), F.lit(0))
    is_mfr = ((cand == F.col("mfr")) & (cand != raw)).cast("int")
    dist = C.thai_edit(U.thai_normal(raw), U.thai_normal(cand), 20)
    valid = (cand != "") & (cand != raw) & ~cand.rlike(r"\s") & (F.length(cand) <= F.greatest(F.lit(2), F.length(raw) * 2 + 6)) & (~raw.rlike(K.THAI) | cand.rlike(K.THAI)) & (trusted | ~K.protected_k5(raw)) & (trusted | (F.col("dist") / F.greatest(F.length(raw), F.length(cand), F.lit(1)) <= max_ratio))
    own = F.when(source == "rule", 1.35 + 0.8 * correct).when(source == "byt5", bonus + 1.2 * correct + 1.0 * is_mfr).otherwise(F.col("own"))
    score = 0.7 * correct + 0.8 * is_mfr - 0.10 * F.col("dist") - 0.05 * F.abs(F.length(cand) - F.length(raw)) + F.coalesce(own, zero)
    c = c.withColumn("dist", dist).where(valid).withColumn("score", F.round(score, DIGITS))
    best = C.best_score(c).groupBy("lang", "raw").agg(F.max_by(F.struct("cand", "source", "score"), F.struct("score", -F.col("ord"))).alias("z")).select("lang", "raw", F.col("z.cand").alias("c"), F.col("z.source").alias("source"), F.col("z.score").alias("s"))
    t = tokens.withColumn("change_p", detector).join(w, ["lang", "raw"], "left").join(best, ["lang", "raw"], "left")
    forced = (F.col("mfr") != F.col("raw")) & (F.col("conf") >= force) & (F.col("total") >= min_count)
    total = F.round(F.col("s") + 0.8 * F.col("change_p"), DIGITS)
    decision = F.when(F.col("c").isNull(), "keep").when(~((F.col("change_p") >= threshold) | forced), "detector_keep").when(total < accept, "low_score").otherwise(F.col("source"))
    t = t.withColumn("decision", decision).withColumn("pred", F.when(F.col("decision").isin("mfr", "errdict", "rule", "byt5"), F.col("c")).otherwise(F.col("raw")))
    return t.drop("mfr", "conf", "total", "c", "source", "s", "change_p")


def action_labels(tokens: DataFrame, output: Column) -> DataFrame:
    """A model that answers COPY or NORM and a text: anything else copies."""
    a = X.decode_action(output, "raw")
    t = tokens.withColumn("__a", a)
    return t.withColumns({"pred": F.col("__a.pred"), "decision": F.col("__a.action")}).drop("__a")


# --- registry ---


@dataclass
class Resources:
    """What policies take: pair counts of the training part, rule maps, score columns and a generator's output, each optional.

    ``detector`` and ``output``: columns of the tokens; ``candidates``: ``lang, raw, cand, score, ord`` of a ranker; ``accepted``: ``lang, raw, cand, p, ord`` of a model that accepts candidates.
    """

    counts: DataFrame
    training: DataFrame | None = None
    detector: Column | None = None
    output: Column | None = None
    candidates: DataFrame | None = None
    accepted: DataFrame | None = None
    master: dict[str, str] = field(default_factory=dict)
    macros: dict[str, str] = field(default_factory=dict)


def _mfr(tokens: DataFrame, r: Resources) -> DataFrame:
    t = lookup(tokens, S.most_frequent(r.counts))
    return t.withColumn("decision", F.when(F.col("pred") != F.col("raw"), "mfr").otherwise("copy"))


def _backoff(tokens: DataFrame, r: Resources) -> DataFrame:
    return backoff(tokens, S.context_tables(r.training), r.macros, T.JA_FINAL)


#: A policy by name: what it needs, and how it runs. Without what it needs a language falls back to ``mfr``.
REGISTRY: dict[str, tuple[tuple[str, ...], Callable[[DataFrame, Resources], DataFrame]]] = {
    "mfr": ((), _mfr),
    "copy": ((), lambda t, r: t.withColumns({"pred": F.col("raw"), "decision": F.lit("copy")})),
    "backoff": (("training",), _backoff),
    "master_map": ((), lambda t, r: master_map(t, r.master, S.most_frequent(r.counts))),
    "hybrid": (("detector", "candidates"), lambda t, r: spanish_hybrid(t, r.candidates, r.detector, r.output)),
    "generate": (("output",), lambda t, r: direct(t, r.output)),
    "gated": (("detector", "output"), lambda t, r: gated_model(t, r.detector, r.output)),
    "conservative": ((), lambda t, r: italian_conservative(t, r.counts)),
    "korean_rules": ((), lambda t, r: korean_rules(t, S.candidate_info(r.counts))),
    "japanese_scheme": ((), lambda t, r: japanese_scheme(t, r.counts, r.output)),
    "thai": (("detector",), lambda t, r: thai_two_stage(t, r.counts, r.detector)),
}



def _of_words(decided: Callable[[Resources], DataFrame]) -> Callable[[DataFrame, Resources], DataFrame]:
    """A policy whose decisions are one table of words; words it does not have copy."""

    def run_it(t: DataFrame, r: Resources) -> DataFrame:
        d = decided(r)
        decision = F.col("decision") if "decision" in d.columns else F.when(F.col("pred") != F.col("raw"), "change").otherwise("copy")
        out = t.join(d.select("lang", "raw", F.col("pred").alias("__pred"), decision.alias("decision")), ["lang", "raw"], "left")
        return out.withColumns({"pred": F.coalesce("__pred", "raw"), "decision": F.coalesce("decision", F.lit("copy"))}).drop("__pred")

    return run_it


def _best_of(r: Resources) -> DataFrame:
    return S.most_frequent(r.counts)


REGISTRY |= {
    "mfr_first": ((), lambda t, r: mfr_first(t, _best_of(r), detector=r.detector, generated=r.output)),
    "spanish_margin": (("detector", "candidates"), lambda t, r: spanish_margin(t, r.candidates, r.detector)),
    "detector_mfr_only": (("detector",), lambda t, r: detector_first(t, _best_of(r), r.detector, "detector_mfr_only")),
    "italian_ranked": (("candidates",), lambda t, r: italian_ranked(t, r.candidates)),
    "monoise_rank": (("candidates",), lambda t, r: monoise_rank(t, r.candidates)),
    "accept_override": (("accepted",), lambda t, r: accept_override(t, _best_of(r), r.accepted)),
    "korean_ranked": (("detector",), lambda t, r: korean_ranked(t, r.counts, S.candidate_info(r.counts), r.detector)),
    "korean_rule_mfr": ((), lambda t, r: korean_rule_mfr(t, _best_of(r), r.master)),
    "causal_fallback": (("detector", "output"), lambda t, r: causal_fallback(t, r.output, r.detector)),
    "rerank_prior": ((), _of_words(lambda r: rerank_decisions(S.candidate_tables(r.counts)))),
    **{mode: (("detector", "output"), lambda t, r, mode=mode: detector_first(t, _best_of(r), r.detector, mode, output=r.output)) for mode in ("detector_mfr_byt5", "detector_byt5")},
    **{f"tool_{mode}": (("output",), lambda t, r, mode=mode: external_tool(t, _best_of(r), r.output, mode)) for mode in ("m0_mfr", "m1_monoise_only", *TOOL_CATEGORIES, "m5_mfr_monoise_agreement_only")},
    **{f"cascade_{name}": (("output",), lambda t, r, name=name: cascade(t, r.counts, S.candidate_info(r.counts), r.output, name)) for name in CASCADES},
    **{f"loo_{name}": ((), _of_words(lambda r, name=name: loo_decisions(r.counts, name))) for name in LOO_POLICIES},
}

POLICY_BY_LANGUAGE = {"ja": "backoff", "ko": "master_map", "es": "hybrid"}


def resolve(name: str, resources: Resources) -> str:
    """The policy itself, or ``mfr`` where something it needs is missing or nobody knows it."""
    needs = REGISTRY[name][0] if name in REGISTRY else None
    return name if needs is not None and all(getattr(resources, k) is not None for k in needs) else "mfr"


def run(tokens: DataFrame, resources: Resources, policies: dict[str, str] | None = None, default: str = "mfr") -> DataFrame:
    """``sent_id, pos, lang, raw, pred, decision, policy`` of all tokens, each language by its policy. Policies with the same name share one plan."""
    names = {lang: resolve(name, resources) for lang, name in (POLICY_BY_LANGUAGE if policies is None else policies).items()}
    rest = resolve(default, resources)
    by_policy: dict[str, list[str]] = {}
    for lang, name in names.items():
        by_policy.setdefault(name, []).append(lang)
    out = None
    for name in dict.fromkeys([*by_policy, rest]):
        own = F.col("lang").isin(by_policy.get(name, []))
        mine = own | ~F.col("lang").isin(list(names)) if name == rest else own
        part = REGISTRY[name][1](tokens.where(F.coalesce(mine, F.lit(name == rest))), resources)
        part = part.select("sent_id", "pos", "lang", "raw", "pred", "decision", F.lit(name).alias("policy"))
        out = part if out is None else out.unionByName(part)
    return out
