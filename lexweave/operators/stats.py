"""Dictionaries and statistics learned from tokens (``lang, raw, norm`` and context columns).

All are grouped aggregations with map-side partial results; best replacements
are taken by ``max_by`` or ``min_by`` of a struct, never by a sort of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.sources.artifacts import stored
from lexweave.sources.sentences import BOS, EOS


def pair_counts(tokens: DataFrame, keys: tuple[str, ...] = ("lang", "raw"), ordinals: bool = False) -> DataFrame:
    """``keys, norm, n``; with ``ordinals`` the place where the pair was first seen."""
    extra = [F.min(F.struct("sent_id", "pos")).alias("first")] if ordinals else []
    return tokens.groupBy(*keys, "norm").agg(F.count("*").alias("n"), *extra)


def _earliest(first: str) -> list[Column]:
    return [-F.col(f"{first}.sent_id"), -F.col(f"{first}.pos")]


def most_frequent(counts: DataFrame, keys: tuple[str, ...] = ("lang", "raw"), tie: str = "T2", identity: str = "raw") -> DataFrame:
    """``keys, pred, best_count, total, copy``: the best replacement under a tie rule.

    T1 identity, then first seen; T2 identity, then smallest; T3 identity, then
    largest; T4 first seen; T5 not identity, then first seen; T6 smallest.
    T1, T4 and T5 need counts with ordinals.
    """
    same = (F.col("norm") == F.col(identity)).cast("int")
    if tie in ("T2", "T6"):
        best = F.min_by("norm", F.struct(-F.col("n"), -same if tie == "T2" else F.lit(0), "norm"))
    else:
        order = {"T1": [same, *_earliest("first")], "T3": [same, F.col("norm")], "T4": _earliest("first"), "T5": [1 - same, *_earliest("first")]}[tie]
        best = F.max_by("norm", F.struct("n", *(e.alias(f"o{i}") for i, e in enumerate(order))))
    return counts.groupBy(*keys).agg(best.alias("pred"), F.max("n").alias("best_count"), F.sum("n").alias("total"), F.sum(F.when(F.col("norm") == F.col(identity), F.col("n")).otherwise(0)).alias("copy"))


def with_confidence(mfr: DataFrame) -> DataFrame:
    return mfr.withColumn("conf", F.round(F.col("best_count") / F.col("total"), 6))


def raw_stats(counts: DataFrame, keys: tuple[str, ...] = ("lang", "raw"), tie: str = "T2", identity: str = "raw") -> DataFrame:
    """Totals, copies, changes, their shares and the best replacement with its share."""
    m = most_frequent(counts, keys, tie, identity)
    return m.select(*keys, "total", "copy", (F.col("total") - F.col("copy")).alias("changed"), F.round((F.col("total") - F.col("copy")) / F.col("total"), 6).alias("change_prob"), F.round(F.col("copy") / F.col("total"), 6).alias("copy_prob"), F.col("pred").alias("best_norm"), "best_count", F.round(F.col("best_count") / F.col("total"), 6).alias("best_prob"))


def keyed_counts(counts: DataFrame, key: Column) -> DataFrame:
    """``lang, key, norm, n``: pair counts summed over the words of one key, so the key is worked out once a pair, not once a token."""
    return counts.withColumn("key", key).groupBy("lang", "key", "norm").agg(F.sum("n").alias("n"))


def case_stats(tokens: DataFrame) -> DataFrame:
    """Per lower-cased target: how often it stands in lower, upper, title or other case."""
    shape = X.case_shape("norm")
    return tokens.groupBy("lang", F.lower("norm").alias("key")).agg(F.count("*").alias("total"), *(F.sum((shape == s).cast("long")).alias(s) for s in ("lower", "upper", "title")))


def vocabulary(tokens: DataFrame, column: str = "norm") -> DataFrame:
    return tokens.groupBy("lang", F.col(column).alias("word")).agg(F.count("*").alias("n"))


def ngram_counts(tokens: DataFrame, order: int) -> DataFrame:
    """Counts of gold n-grams (w1..wn) of padded sentences: one mark at each end."""
    t = tokens
    sentence = Window.partitionBy("sent_id").orderBy("pos")
    if order == 1:
        body = t.select("lang", F.col("norm").alias("w1"))
        ends = t.where("pos = 0").select("lang", F.explode(F.array(F.lit(BOS), F.lit(EOS))).alias("w1"))
        rows = body.unionByName(ends)
    else:
        left = F.lag("norm", 1, BOS).over(sentence)
        right = F.lead("norm", 1, EOS).over(sentence)
        t = t.withColumns({"l": left, "r": right})
        if order == 2:
            rows = t.select("lang", F.col("l").alias("w1"), F.col("norm").alias("w2")).unionByName(t.where("pos = size - 1").select("lang", F.col("norm").alias("w1"), F.lit(EOS).alias("w2")))
        else:
            rows = t.select("lang", F.col("l").alias("w1"), F.col("norm").alias("w2"), F.col("r").alias("w3"))
    return rows.groupBy("lang", *(f"w{i + 1}" for i in range(order))).agg(F.count("*").alias("n"))


def _between(sentences: DataFrame) -> DataFrame:
    """``lang, w1, w2, w3, first, last``: each gold word (a null one is the word) between its neighbours, with marks beyond both ends. Neighbours come from the array."""
    size = F.when(F.col("norm").isNull(), F.size("raw")).otherwise(F.least(F.size("raw"), F.size("norm")))
    s = sentences.select("lang", F.col("raw").alias("__raw"), F.col("norm").alias("__norm"), size.alias("__n"))
    s = s.select("lang", "__n", "__raw", "__norm", F.posexplode(F.slice("__raw", 1, F.greatest(F.col("__n"), F.lit(0)))).alias("pos", "__word"))
    gold = lambda by: F.coalesce(F.get("__norm", F.col("pos") + by), F.get("__raw", F.col("pos") + by))
    beside = lambda by, edge: F.when(F.col("pos") + by < 0 if by < 0 else F.col("pos") + by >= F.col("__n"), edge).otherwise(gold(by))
    return s.select("lang", beside(-1, BOS).alias("w1"), F.coalesce(gold(0), "__word").alias("w2"), beside(1, EOS).alias("w3"), (F.col("pos") == 0).alias("first"), (F.col("pos") == F.col("__n") - 1).alias("last"))


def _cases(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy("lang", *keys).agg(F.count("*").alias("n"), F.sum(F.col("first").cast("long")).alias("firsts"), F.sum(F.col("last").cast("long")).alias("lasts"))


def gold_trigrams(sentences: DataFrame, dealt: tuple[str, ...] = ()) -> DataFrame:
    """``lang, w1, w2, w3, n, firsts, lasts``: counts of each gold word between its neighbours.

    ``firsts`` and ``lasts`` count the cases at a sentence's beginning and end.
    The only exchange is that of the counts, by the columns ``dealt`` where some are given.
    """
    rows = _between(sentences)
    return _cases(rows.repartition(*dealt) if dealt else rows, "w1", "w2", "w3")


def gold_words(sentences: DataFrame) -> DataFrame:
    """The n-grams of order 1 of ``marginals``, without trigrams."""
    return marginals(_cases(_between(sentences), "w2"), (1,))


def marginals(trigrams: DataFrame, orders: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``ord, lang, w1, w2, w3, n``: n-grams of several orders as sums over trigrams, padded by one mark at each end."""
    none = F.lit(None).cast("string")

    def row(order, n, a, b=none, c=none):
        return F.when(n > 0, F.struct(F.lit(order).alias("ord"), a.alias("w1"), b.alias("w2"), c.alias("w3"), n.alias("n")))

    w1, w2, w3, n = (F.col(c) for c in ("w1", "w2", "w3", "n"))
    firsts, lasts = F.col("firsts"), F.col("lasts")
    rows = {
        1: [row(1, n, w2), row(1, firsts, F.lit(BOS)), row(1, lasts, F.lit(EOS))],
        2: [row(2, n, w2, w3), row(2, firsts, F.lit(BOS), w2)],
        3: [row(3, n, w1, w2, w3)],
    }
    t = trigrams.select("lang", F.explode(F.array_compact(F.array(*(r for k in orders for r in rows[k])))).alias("z")).select("lang", "z.*")
    return t.groupBy("ord", "lang", "w1", "w2", "w3").agg(F.sum("n").alias("n"))


def trigram_scores(trigrams: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """``lang, left, cand, right, uni, bi_left, bi_right, tri``: add-one smoothed log probabilities of every trigram's middle word.

    Counts of both pairs are sums over the trigrams that share them; counts of
    ``words`` (``gold_words``) are joined. Rows go by their first word, then by
    their middle one: trigrams ``dealt`` by ``lang, w1`` are exchanged twice in all.
    """
    words = stored((marginals(trigrams, (1,)) if words is None else words).select("lang", F.col("w1").alias("word"), F.col("n").alias("k")), "words")
    size = words.groupBy("lang").agg(F.count("*").alias("v"), F.sum("k").alias("total"))
    beside = lambda *keys: F.sum("n").over(Window.partitionBy("lang", *keys))
    t = trigrams.join(words.select("lang", F.col("word").alias("w1"), F.col("k").alias("nl")), ["lang", "w1"])
    t = t.select("lang", "w1", "w2", "w3", "n", "nl", beside("w1", "w2").alias("nlc"))
    # A window over both words of a pair asks for rows by both; here they go by the word that the next join needs.
    t = t.repartition("lang", "w2").withColumn("ncr", beside("w2", "w3"))
    t = t.join(words.select("lang", F.col("word").alias("w2"), F.col("k").alias("nc")), ["lang", "w2"]).join(F.broadcast(size), "lang")  # one row a language
    log = lambda a, b: F.round(F.log((F.col(a) + 1) / b), 6)
    v = F.col("v")
    return t.select(
        "lang", F.col("w1").alias("left"), F.col("w2").alias("cand"), F.col("w3").alias("right"),
        log("nc", F.col("total") + v).alias("uni"), log("nlc", F.col("nl") + v).alias("bi_left"), log("ncr", F.col("nc") + v).alias("bi_right"), log("n", F.col("nlc") + v).alias("tri"),
    )


def context_tables(tokens: DataFrame, tie: str = "T2") -> dict[str, DataFrame]:
    """Best replacement by word, word and next word, and both neighbours; only where the neighbours exist.

    All three are sums over one count of words between their neighbours, dealt
    by word and next word, so tokens are exchanged once, without replacements
    that equal the word; only the counts of the word alone are exchanged again.
    """
    ordinals = tie in ("T1", "T4", "T5")
    seen = ["sent_id", "pos"] if ordinals else []
    # Most words are their own replacement: null stands for that, and a mark tells other ones from a missing one.
    norm = F.col("norm")
    brief = F.when(~norm.eqNullSafe(F.col("raw")), F.coalesce(F.concat(F.lit("="), norm), F.lit("")))
    whole = F.when(norm.isNull(), F.col("raw")).when(norm != "", F.substr(norm, F.lit(2)))
    # A neighbour that is missing counts as the sentence's end does. So none is null, and a join by it asks for no filter, which would go below the exchange as well.
    prev, after = F.coalesce("prev", F.lit(BOS)), F.coalesce("next", F.lit(EOS))
    rows = tokens.select("lang", prev.alias("prev"), "raw", after.alias("next"), brief.alias("norm"), *seen).repartition("lang", "raw", "next")
    every = pair_counts(rows.withColumn("norm", whole), ("lang", "prev", "raw", "next"), ordinals)
    # A filter on a key alone would go below the exchange, which could not be shared then.
    held = lambda c: F.when(F.col("n") > 0, F.col(c))
    both = every.where((held("prev") != BOS) & (held("next") != EOS))

    def summed(counts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        return counts.groupBy(*keys, "norm").agg(F.sum("n").alias("n"), *([F.min("first").alias("first")] if ordinals else []))

    keys = {"unigram": ("lang", "raw"), "bigram": ("lang", "raw", "next"), "trigram": ("lang", "prev", "raw", "next")}
    counts = {"unigram": summed(every, keys["unigram"]), "bigram": summed(every.where(held("next") != EOS), keys["bigram"]), "trigram": both}
    return {k: most_frequent(counts[k], keys[k], tie).select(*keys[k], "pred") for k in keys}


def neighbour_bigrams(tokens: DataFrame) -> DataFrame:
    """``side, neighbour, norm, n``: gold words beside lower-cased raw neighbours."""
    both = tokens.select("lang", F.explode(F.array(F.struct(F.lit("left").alias("side"), F.lower("prev").alias("neighbour")), F.struct(F.lit("right").alias("side"), F.lower("next").alias("neighbour")))).alias("s"), "norm")
    return both.groupBy("lang", "s.side", "s.neighbour", "norm").agg(F.count("*").alias("n"))


def entropy(counts: DataFrame, keys: tuple[str, ...] = ("lang", "raw"), base2: bool = False) -> DataFrame:
    """Entropy of a word's replacements: natural with 1e-12 added to each share, or of base two without."""
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    term = p * (F.log2(p) if base2 else F.log(p + F.lit(1e-12)))
    # + 0.0 turns a negative zero into zero
    return counts.join(total, list(keys)).groupBy(*keys).agg(F.round(F.sum(-term) + F.lit(0.0), 6).alias("entropy"))


def high_confidence(counts: DataFrame, min_count: int = 3, min_prob: float = 0.75, min_change: float = 0.5, max_entropy: float = 1.25, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Replacements that are frequent, sure and unlike the word (tie rule T3, entropy of base two)."""
    m = most_frequent(counts, tie="T3").where((F.col("total") >= min_count) & (F.col("pred") != F.col("raw")) & ~F.col("raw").isin(*exclude))
    m = m.where((F.col("best_count") / F.col("total") >= min_prob) & (1 - F.col("copy") / F.col("total") >= min_change))
    return m.join(entropy(counts, base2=True), ["lang", "raw"]).where(F.col("entropy") <= max_entropy).select("lang", "raw", "pred", "total", "entropy")


def candidate_tables(counts: DataFrame, alpha: float = 0.5) -> DataFrame:
    """``lang, raw, cand, n, raw_total, changed_total, ord, prior``: observed replacements and identity, most frequent first."""
    identity = counts.select("lang", "raw").distinct().select("lang", "raw", F.col("raw").alias("norm"), F.lit(0).cast("long").alias("n"))
    every = counts.select("lang", "raw", "norm", "n").unionByName(identity).groupBy("lang", "raw", "norm").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("lang", "raw")
    order = own.orderBy(F.col("n").desc(), (F.col("norm") != F.col("raw")).cast("int"), "norm")
    t = every.withColumns({"raw_total": F.sum("n").over(own), "changed_total": F.sum(F.when(F.col("norm") != F.col("raw"), F.col("n")).otherwise(0)).over(own), "k": F.count("*").over(own), "ord": F.row_number().over(order)})
    return t.select("lang", "raw", F.col("norm").alias("cand"), "n", "raw_total", "changed_total", "ord", F.round((F.col("n") + alpha) / (F.col("raw_total") + alpha * F.col("k")), 6).alias("prior"))


def error_dictionary(counts: DataFrame, tie: str = "T3") -> DataFrame:
    """Words whose best replacement is another word, with counts and rates."""
    return with_confidence(most_frequent(counts, tie=tie)).where("pred <> raw").select("lang", "raw", "pred", "best_count", "total", "conf", F.round(1 - F.col("copy") / F.col("total"), 6).alias("change_rate"))


def acronyms(tokens: DataFrame, least: int = 2) -> DataFrame:
    """Words of two or more capitals whose replacement is themselves at least ``least`` times."""
    return tokens.where(F.col("norm").rlike("^[A-ZÀ-ÖØ-Þ]{2,}$")).groupBy("lang", F.col("norm").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def candidate_info(counts: DataFrame) -> DataFrame:
    """``total, best_ratio, raw_ratio`` of each word."""
    m = most_frequent(counts, tie="T2")
    return m.select("lang", "raw", "pred", "total", F.round(F.col("best_count") / F.col("total"), 6).alias("best_ratio"), F.round(F.col("copy") / F.col("total"), 6).alias("raw_ratio"))


def leave_one_out(counts: DataFrame) -> DataFrame:
    """``lang, raw, norm, n, winner, pred, best_count``: the best replacement (T2) of the word without one occurrence of the pair; ``pred``: with all of them.

    Nothing is done per occurrence: all n of a pair share the answer. Without
    one of its own a pair competes with the best of the others, which are the
    word's two best pairs at most; a word left without pairs predicts itself.
    """
    t = _two_best(counts)
    own = F.when(F.col("n") > 1, _place(F.col("n") - 1))
    other = F.when(F.col("z") == F.col("z1"), F.col("z2")).otherwise(F.col("z1"))
    best = F.when(own.isNull(), other).when(other.isNull(), own).when(own < other, own).otherwise(other)
    return t.select("lang", "raw", "norm", "n", F.coalesce(best.getField("c"), F.col("raw")).alias("winner"), F.col("z1.c").alias("pred"), (-F.col("z1.a")).alias("best_count"))


def _place(n: Column) -> Column:
    """A pair's place by the second tie rule; less is better."""
    return F.struct((-n).alias("a"), (F.col("norm") != F.col("raw")).cast("int").alias("b"), F.col("norm").alias("c"))


def _two_best(counts: DataFrame) -> DataFrame:
    """Each pair beside its word's two best places ``z1`` and ``z2``: one exchange by word, whose pairs pass by in order and may spill."""
    every = Window.partitionBy("lang", "raw").orderBy("z").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.withColumn("z", _place(F.col("n"))).withColumns({"z1": F.first("z").over(every), "z2": F.nth_value("z", 2).over(every)})


def _precision(rows: DataFrame, *keys: str) -> DataFrame:
    hit = F.when(F.col("winner") == F.col("norm"), F.col("n")).otherwise(0)
    out = rows.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum(hit).alias("correct"))
    return out.withColumn("precision", F.round(F.col("correct") / F.col("total"), 6))


def loo_raw(counts: DataFrame) -> DataFrame:
    return _precision(leave_one_out(counts), "lang", "raw")


def loo_pair(counts: DataFrame) -> DataFrame:
    return _precision(leave_one_out(counts).where("winner <> raw").withColumn("cand", F.col("winner")), "lang", "raw", "cand")


def loo_category(counts: DataFrame) -> DataFrame:
    return _precision(leave_one_out(counts).where("winner <> raw").withColumn("category", X.mapping_class("raw", "winner")), "lang", "category")


def pair_shares(counts: DataFrame) -> DataFrame:
    """Count, total, share and entropy beside each pair."""
    total = counts.groupBy("lang", "raw").agg(F.sum("n").alias("total"))
    return counts.join(total, ["lang", "raw"]).join(entropy(counts), ["lang", "raw"]).select("lang", "raw", F.col("norm").alias("cand"), "n", "total", F.round(F.col("n") / F.col("total"), 6).alias("conf"), "entropy")


def summary(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("lang").agg(F.count("*").alias("tokens"), F.sum((F.col("raw") != F.col("norm")).cast("long")).alias("changed"), F.countDistinct("raw").alias("raw_types"), F.countDistinct("norm").alias("norm_types"))


def out_of_fold(tokens: DataFrame) -> DataFrame:
    """``lang, fold, raw, norm, n``: pair counts over all folds but one, as totals less the fold's own; zero ones are dropped."""
    own = tokens.groupBy("lang", "raw", "norm", "fold").agg(F.count("*").alias("m"))
    total = own.groupBy("lang", "raw", "norm").agg(F.sum("m").alias("n"))
    words = own.select("lang", "raw", "fold").distinct()
    t = words.join(total, ["lang", "raw"]).join(own, ["lang", "raw", "norm", "fold"], "left")
    return t.select("lang", "fold", "raw", "norm", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n")).where("n > 0")
