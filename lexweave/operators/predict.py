"""Lookups, candidates and decision policies over tokens."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.operators import stats as S
from lexweave.sources.artifacts import stored
from lexweave.sources.sentences import EOS


def lookup(tokens: DataFrame, table: DataFrame, keys: tuple[str, ...] = ("lang", "raw")) -> DataFrame:
    """Adds the table's ``pred``, the word itself where it has none. Spark broadcasts the table below its own bound."""
    return tokens.join(table.select(*keys, "pred"), list(keys), "left").withColumn("pred", F.coalesce("pred", "raw"))


def backoff(tokens: DataFrame, tables: dict[str, DataFrame], macros: dict[str, str] | None = None, final: dict[str, str] | None = None) -> DataFrame:
    """Macro table, final-position rule, trigram, bigram, unigram, copy: the first that has the word.

    Tokens go by word and next word, as the tables of ``context_tables`` lie already, and serve the first two joins so: the session
    is set to take rows dealt by some of a join's keys as they are. Only words are exchanged again, for the last join.
    """
    tokens.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    # Most words are their own replacement; such are not carried along.
    same = F.col("norm").eqNullSafe(F.col("raw"))
    t = tokens.withColumn("norm", F.when(~same, F.struct("norm"))).repartition("lang", "raw", "next") if "norm" in tokens.columns else tokens.repartition("lang", "raw", "next")
    t = t.join(tables["trigram"].withColumnRenamed("pred", "p3"), ["lang", "prev", "raw", "next"], "left")
    t = t.join(tables["bigram"].withColumnRenamed("pred", "p2"), ["lang", "raw", "next"], "left")
    t = t.join(tables["unigram"].withColumnRenamed("pred", "p1"), ["lang", "raw"], "left")
    m = _mapped(F.col("raw"), macros)
    f = F.when(F.col("next") == EOS, _mapped(F.col("raw"), final))
    source = F.when(m.isNotNull(), "macro").when(f.isNotNull(), "final").when(F.col("p3").isNotNull(), "trigram").when(F.col("p2").isNotNull(), "bigram").when(F.col("p1").isNotNull(), "unigram").otherwise("copy")
    if "norm" in tokens.columns:
        t = t.withColumn("norm", F.when(F.col("norm").isNull(), F.col("raw")).otherwise(F.col("norm.norm")))
    return t.withColumns({"pred": F.coalesce(m, f, "p3", "p2", "p1", "raw"), "decision": source}).drop("p1", "p2", "p3")


def _mapped(x: Column, table: dict[str, str] | None) -> Column:
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*(F.lit(v) for p in table.items() for v in p)), x)


def without_blocked(candidates: DataFrame, blocked: DataFrame) -> DataFrame:
    return candidates.join(blocked, ["lang", "raw", "cand"], "left_anti")


def language_scores(triples: DataFrame, unigrams: DataFrame, bigrams: DataFrame, trigrams: DataFrame | None) -> DataFrame:
    """Adds add-one smoothed log probabilities of ``cand`` alone, after ``left``, before ``right`` and, given ``trigrams``, between both (``tri``)."""
    size = unigrams.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("total"))
    uni = unigrams.select("lang", "w1", "n")
    t = triples.join(F.broadcast(size), "lang")  # one row a language
    t = t.join(uni.select("lang", F.col("w1").alias("cand"), F.col("n").alias("nc")), ["lang", "cand"], "left")
    t = t.join(uni.select("lang", F.col("w1").alias("left"), F.col("n").alias("nl")), ["lang", "left"], "left")
    t = t.join(bigrams.select("lang", F.col("w1").alias("left"), F.col("w2").alias("cand"), F.col("n").alias("nlc")), ["lang", "left", "cand"], "left")
    t = t.join(bigrams.select("lang", F.col("w1").alias("cand"), F.col("w2").alias("right"), F.col("n").alias("ncr")), ["lang", "cand", "right"], "left")
    if trigrams is not None:
        t = t.join(trigrams.select("lang", F.col("w1").alias("left"), F.col("w2").alias("cand"), F.col("w3").alias("right"), F.col("n").alias("nt")), ["lang", "left", "cand", "right"], "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    v = F.col("v")
    return t.select(
        *triples.columns,
        F.round(F.log((n("nc") + 1) / (F.col("total") + v)), 6).alias("uni"),
        F.round(F.log((n("nlc") + 1) / (n("nl") + v)), 6).alias("bi_left"),
        F.round(F.log((n("ncr") + 1) / (n("nc") + v)), 6).alias("bi_right"),
        *([F.round(F.log((n("nt") + 1) / (n("nlc") + v)), 6).alias("tri")] if trigrams is not None else []),
    )


def split_candidates(words: DataFrame, vocabulary: DataFrame, most: int = 8) -> DataFrame:
    """``lang, raw, cand, ord``: cuts of unprotected words over three letters whose halves are both known, the first ``most`` by place."""
    cuts = words.where((F.length("raw") > 3) & ~X.protected_k1("raw")).select("lang", "raw", F.explode(F.sequence(F.lit(1), F.length("raw") - 1)).alias("at"))
    cuts = cuts.select("lang", "raw", "at", F.substr("raw", F.lit(1), "at").alias("a"), F.substr("raw", F.col("at") + 1).alias("b"))
    known = vocabulary.select("lang", "word").distinct()
    both = cuts.join(known.withColumnRenamed("word", "a"), ["lang", "a"], "left_semi").join(known.withColumnRenamed("word", "b"), ["lang", "b"], "left_semi")
    rank = Window.partitionBy("lang", "raw").orderBy("at")
    return both.withColumn("ord", F.row_number().over(rank)).where(F.col("ord") <= most).select("lang", "raw", F.concat_ws(" ", "a", "b").alias("cand"), "ord")


def _deletions(x: Column, most: int) -> Column:
    """The word and what is left of it without up to ``most`` letters."""
    one = lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))).otherwise(F.array().cast("array<string>"))
    found = F.array(x)
    for _ in range(most):
        found = F.array_distinct(F.concat(found, F.flatten(F.transform(found, one))))
    return found


def fuzzy_candidates(words: DataFrame, vocabulary: DataFrame, band: int = 1, most: int = 1, top: int = 5) -> DataFrame:
    """``lang, raw, cand, dist, n, ord``: known words with the same first letter, at most ``band`` longer or shorter, within ``most`` edits (1 or 2).

    Two words within k edits have a string in common that each gives by deleting
    up to k letters, so the join is an equality join on those strings and grows
    with the words, not with their pairs.
    """
    first = lambda x: F.substring(X.strip_accents(F.lower(F.col(x))), 1, 1)
    left = words.select("lang", "raw").distinct().withColumn("k", F.explode(_deletions(F.col("raw"), most)))
    right = vocabulary.select("lang", F.col("word").alias("cand"), "n").withColumn("k", F.explode(_deletions(F.col("cand"), most)))
    near = left.join(right, ["lang", "k"]).where((F.col("raw") != F.col("cand")) & (first("raw") == first("cand")) & (F.abs(F.length("raw") - F.length("cand")) <= band))
    near = near.select("lang", "raw", "cand", "n").distinct().withColumn("dist", F.levenshtein("raw", "cand", most)).where(F.col("dist") >= 0)
    rank = Window.partitionBy("lang", "raw").orderBy("dist", F.col("n").desc(), "cand")
    return near.withColumn("ord", F.row_number().over(rank)).where(F.col("ord") <= top).select("lang", "raw", "cand", "dist", "n", "ord")


def ranked(sources: list[tuple[str, DataFrame]], per_source: int = 8) -> DataFrame:
    """UNION of candidate sources (``lang, raw, cand, n``): the best ``per_source`` of each, one row a candidate with all its sources in order, and the first of them."""
    parts = []
    for i, (name, df) in enumerate(sources):
        order = Window.partitionBy("lang", "raw").orderBy(F.col("n").desc(), "cand")
        parts.append(df.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_source).select("lang", "raw", "cand", F.lit(i).alias("o"), F.lit(name).alias("source"), "r"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("lang", "raw", "cand").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.min_by("source", F.struct("o", "r")).alias("first_source"), F.min(F.struct("o", "r")).alias("z")).select("lang", "raw", "cand", "sources", "first_source", (F.col("z.o") * 1000 + F.col("z.r")).alias("ord"))


def observed_sources(tokens: DataFrame) -> list[tuple[str, DataFrame]]:
    """Identity, observed replacements, those of words with the same key, and those of words alike but for case."""
    counts = stored(S.pair_counts(tokens), "pair-counts")
    words = counts.select("lang", "raw").distinct()
    keyed = S.keyed_counts(counts, X.make_key("raw"))
    cased = S.keyed_counts(counts, F.lower("raw"))
    by = lambda table, key: words.withColumn("key", key).join(table, ["lang", "key"]).select("lang", "raw", F.col("norm").alias("cand"), "n")
    return [
        ("original", words.select("lang", "raw", F.col("raw").alias("cand"), F.lit(1).cast("long").alias("n"))),
        ("lookup", counts.select("lang", "raw", F.col("norm").alias("cand"), "n")),
        ("key", by(keyed, X.make_key("raw"))),
        ("case", by(cased, F.lower("raw"))),
    ]


def merged_dictionary(tokens: DataFrame, top: int = 5) -> DataFrame:
    """Exact counts and 0.7 of the counts of equal keys, and a copy of 0.1 where the word is none of them; the best ``top``."""
    counts = stored(S.pair_counts(tokens), "pair-counts")
    words = counts.select("lang", "raw").distinct()
    exact = counts.select("lang", "raw", F.col("norm").alias("cand"), F.col("n").cast("double").alias("s"), F.lit("observed").alias("src"))
    keyed = words.withColumn("key", X.make_key("raw")).join(S.keyed_counts(counts, X.make_key("raw")), ["lang", "key"]).select("lang", "raw", F.col("norm").alias("cand"), (F.col("n") * 0.7).alias("s"), F.lit("normalized_key").alias("src"))
    both = exact.unionByName(keyed).groupBy("lang", "raw", "cand").agg(F.sum("s").alias("s"), F.array_sort(F.collect_set("src")).alias("sources"))
    copy = words.select("lang", "raw", F.col("raw").alias("cand")).join(both.select("lang", "raw", "cand"), ["lang", "raw", "cand"], "left_anti").select("lang", "raw", "cand", F.lit(0.1).alias("s"), F.array(F.lit("copy")).alias("sources"))
    order = Window.partitionBy("lang", "raw").orderBy(F.col("score").desc(), "cand")
    out = both.unionByName(copy).withColumn("score", F.round("s", 6)).withColumn("ord", F.row_number().over(order))
    return out.where(F.col("ord") <= top).select("lang", "raw", "cand", "score", F.array_join("sources", ",").alias("sources"), "ord")


@dataclass(frozen=True)
class Gate:
    """Least count, share, and leave-one-out precisions of word, pair and category; each of the last three only from so many cases on."""

    count: int
    conf: float
    raw_total: int
    raw: float
    pair_total: int
    pair: float
    cat_total: int
    cat: float


@dataclass(frozen=True)
class LooPolicy:
    """``default`` None: categories not listed are blocked. ``plain``: nothing is."""

    default: Gate | None = None
    gates: dict[str, Gate] = field(default_factory=dict)
    plain: bool = False


_FREE = 999999
# Thresholds of the leave-one-out policies.
POLICIES = {
    "l0_mfr": LooPolicy(plain=True),
    "l1_loo_raw": LooPolicy(Gate(2, 0.60, 3, 0.60, 2, 0.50, 5, 0.50)),
    "l2_loo_category": LooPolicy(
        Gate(3, 0.80, 3, 0.60, 2, 0.60, 5, 0.60),
        {
            "diacritic": Gate(1, 0.50, _FREE, 0.0, _FREE, 0.0, 5, 0.50),
            "sms_abbrev": Gate(2, 0.70, 3, 0.55, 2, 0.55, 5, 0.55),
            "repeat": Gate(2, 0.75, 3, 0.55, 2, 0.55, 5, 0.55),
            "allcaps_lower": Gate(3, 0.90, 3, 0.70, 2, 0.70, 5, 0.70),
            "allcaps_title": Gate(3, 0.85, 3, 0.70, 2, 0.70, 5, 0.70),
            "title_lower": Gate(4, 0.85, 3, 0.70, 2, 0.70, 5, 0.70),
            "lower_title": Gate(4, 0.85, 3, 0.70, 2, 0.70, 5, 0.70),
            "expansion": Gate(4, 0.90, 3, 0.70, 2, 0.70, 5, 0.70),
            "short_expansion": Gate(3, 0.80, 3, 0.60, 2, 0.60, 5, 0.60),
            "spelling_or_other": Gate(3, 0.90, 3, 0.70, 2, 0.70, 5, 0.70),
        },
    ),
    "l3_cap_strict": LooPolicy(
        Gate(3, 0.90, 3, 0.70, 2, 0.70, 5, 0.70),
        {
            "diacritic": Gate(1, 0.50, _FREE, 0.0, _FREE, 0.0, 5, 0.50),
            "sms_abbrev": Gate(2, 0.75, 3, 0.60, 2, 0.60, 5, 0.60),
            "repeat": Gate(2, 0.80, 3, 0.60, 2, 0.60, 5, 0.60),
            "allcaps_title": Gate(5, 0.90, 3, 0.80, 2, 0.80, 5, 0.80),
        },
    ),
    "l4_accent_only": LooPolicy(gates={"diacritic": Gate(1, 0.50, _FREE, 0.0, _FREE, 0.0, 5, 0.50)}),
    "l5_high_precision": LooPolicy(Gate(3, 0.90, 2, 0.80, 2, 0.80, 5, 0.75), {"diacritic": Gate(1, 0.60, _FREE, 0.0, _FREE, 0.0, 5, 0.60)}),
}


def loo_decisions(counts: DataFrame, policy: str) -> DataFrame:
    """``lang, raw, pred, category, decision``: each word's best replacement, or the word where a gate of the policy blocks it.

    A word-level table, so a corpus of any size pays for it once per word.
    """
    rule = POLICIES[policy]
    pairs = S.leave_one_out(counts)
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    hit, own = F.col("winner") == F.col("norm"), (F.col("winner") == F.col("pred")) & (F.col("winner") != F.col("raw"))
    m = pairs.groupBy("lang", "raw").agg(F.first("pred").alias("pred"), F.first("best_count").alias("best_count"), F.sum("n").alias("total"), n(hit).alias("right"), n(own).alias("pt"), n(own & hit).alias("pair_right"))
    share = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 6)
    m = m.select("lang", "raw", "pred", "best_count", "total", F.col("total").alias("rt"), share("right", "total").alias("rp"), "pt", share("pair_right", "pt").alias("pp"), X.mapping_class("raw", "pred").alias("category"))
    m = m.join(F.broadcast(S.loo_category(counts).select("lang", "category", F.col("total").alias("ct"), F.col("precision").alias("cp"))), ["lang", "category"], "left")  # a dozen rows a language

    def gated(g: Gate | None) -> Column:
        if g is None:
            return F.lit("category_not_allowed")
        low = lambda t, p, n, x: (F.coalesce(t, F.lit(0)) >= n) & (F.coalesce(p, F.lit(0.0)) < x)
        return (
            F.when(F.col("best_count") < g.count, "count_below_threshold")
            .when(F.col("best_count") / F.col("total") < g.conf, "confidence_below_threshold")
            .when(low("rt", "rp", g.raw_total, g.raw), "raw_loo_below_threshold")
            .when(low("pt", "pp", g.pair_total, g.pair), "pair_loo_below_threshold")
            .when(low("ct", "cp", g.cat_total, g.cat), "category_loo_below_threshold")
            .otherwise("passed")
        )

    if rule.plain:
        decision = F.when(F.col("category") == "copy", "copy").otherwise("plain_mfr")
    else:
        decision = F.when(F.col("category") == "copy", "copy").when(F.col("category") == "protected", "protected")
        for name, gate in rule.gates.items():
            decision = decision.when(F.col("category") == name, gated(gate))
        decision = decision.otherwise(gated(rule.default))
    m = m.withColumn("decision", decision)
    return m.select("lang", "raw", F.when(F.col("decision").isin("copy", "plain_mfr", "passed"), F.col("pred")).otherwise(F.col("raw")).alias("pred"), "category", "decision")


def dictionary_gates(counts: DataFrame, min_pairs: int = 3, min_conf: float = 0.98, min_change: float = 0.90, max_ratio: float = 0.75, max_length: tuple[float, int] = (2.0, 3)) -> DataFrame:
    """``lang, raw, cand, decision``: the first gate that rejects a word's best replacement, or ``ok``."""
    e = S.most_frequent(counts, tie="T3").select("lang", "raw", F.col("pred").alias("cand"), "best_count", "total", "copy")
    distance = F.levenshtein(X.strip_accents("raw"), X.strip_accents("cand")) / F.greatest(F.length("raw"), F.length("cand"), F.lit(1))
    decision = (
        F.when(F.col("cand") == F.col("raw"), "same_or_empty")
        .when(X.protected_k1("raw"), "protected")
        .when(F.col("best_count") < min_pairs, "low_pair_count")
        .when(F.col("best_count") / F.col("total") < min_conf, "low_pair_conf")
        .when((F.col("total") - F.col("copy")) / F.col("total") < min_change, "low_change_rate")
        .when(distance > max_ratio, "far_edit")
        .when(F.length("cand") > F.length("raw") * max_length[0] + max_length[1], "long_expansion")
        .otherwise("ok")
    )
    return e.select("lang", "raw", "cand", decision.alias("decision"))


def rerank_decisions(tables: DataFrame, prior_weight: float = 0.25, bonus: float = 0.02, guard: float = 0.05, keep: float = 0.12, score: Column | None = None) -> DataFrame:
    """Best candidate by model score, weighted log prior and identity bonuses; ``score``: the model's column, 0 without one. The first wins ties."""
    same = F.col("cand") == F.col("raw")
    s = (score if score is not None else F.lit(0.0)) + prior_weight * F.log(F.greatest("prior", F.lit(1e-12)))
    s = s + F.when(same, bonus).otherwise(0.0) + F.when(same & (F.col("changed_total") / F.greatest("raw_total", F.lit(1)) < guard), keep).otherwise(0.0)
    t = tables.withColumn("score", F.round(s, 6))
    return t.groupBy("lang", "raw").agg(F.max_by("cand", F.struct("score", -F.col("ord"))).alias("pred"), F.max("score").alias("score"))


def mfr_first(tokens: DataFrame, mfr: DataFrame, min_conf: float = 0.65, detector: Column | None = None, threshold: float = 0.55, generated: Column | None = None) -> DataFrame:
    """Protected words copy; a sure replacement is taken; below the detector's threshold words copy; else the generator's output, or a copy."""
    t = tokens.join(S.with_confidence(mfr).select("lang", "raw", F.col("pred").alias("m"), "conf"), ["lang", "raw"], "left")
    sure = (F.col("m") != F.col("raw")) & (F.col("conf") >= min_conf)
    quiet = (detector if detector is not None else F.lit(0.0)) < threshold
    decision = F.when(X.protected_k1("raw"), "protected").when(sure, "mfr").when(quiet, "detector_copy").otherwise("model")
    made = generated if generated is not None else F.col("raw")
    return t.withColumn("decision", decision).withColumn("pred", F.when(F.col("decision") == "mfr", F.col("m")).when(F.col("decision") == "model", F.coalesce(safe_output(F.col("raw"), made), F.col("raw"))).otherwise(F.col("raw"))).drop("m", "conf")


def safe_output(raw: Column, output: Column, longest: int = 30, times: int = 4, max_cost: float = 4.0) -> Column:
    """A generator's output, or null where it is empty, too long, holds marks of the prompt, or is too far from the word."""
    o = F.trim(output)
    bad = (o == "") | (F.length(o) > F.greatest(F.lit(longest), F.length(raw) * times)) | o.rlike("<extra_id_|</?s>|normalize|context:") | (X.spanish_edit_cost(raw, o) > max_cost)
    return F.when(~bad, o)
