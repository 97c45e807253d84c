"""Rule candidates and score-based decisions.

Rule tables are parameters: a map from a lower-cased word to its candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.sources.sentences import BOS, EOS


def table(spark, rules: dict[str, list[str]], lang: str) -> DataFrame:
    """A rule table as rows ``lang, raw, cand, ord``."""
    rows = [(lang, raw, cand, i) for raw, cands in rules.items() for i, cand in enumerate(cands)]
    return spark.createDataFrame(rows, "lang string, raw string, cand string, ord int")


def table_candidates(words: DataFrame, rules: DataFrame) -> DataFrame:
    """Candidates of the words that a rule table has in lower case."""
    low = words.select("lang", "raw").distinct().withColumn("low", F.lower("raw"))
    return low.join(rules.withColumnRenamed("raw", "low"), ["lang", "low"]).select("lang", "raw", "cand", "ord")


def spanish_forms(raw: Column) -> Column:
    """Sorted distinct rewritings of chat spelling: ke, ki, k, x, initial w, -ao, -aos, apostrophes; the word itself excluded."""
    low = F.lower(X.plain_apostrophe(raw))
    n = F.length(low)
    forms = F.array(
        F.regexp_replace(low, r"(?U)\bke\b", "que"),
        F.regexp_replace(low, r"(?U)\bki", "qui"),
        F.replace(low, F.lit("k"), F.lit("qu")),
        F.replace(low, F.lit("x"), F.lit("ch")),
        F.when(low.startswith("w"), F.concat(F.lit("gu"), F.substr(low, F.lit(2)))),
        F.when(low.startswith("w"), F.concat(F.lit("bu"), F.substr(low, F.lit(2)))),
        F.when(low.endswith("ao") & (n > 3), F.concat(F.left(low, n - 2), F.lit("ado"))),
        F.when(low.endswith("aos") & (n > 4), F.concat(F.left(low, n - 3), F.lit("ados"))),
        F.replace(low, F.lit("'"), F.lit("")),
        F.replace(low, F.lit("'"), F.lit(" ")),
    )
    return F.array_sort(F.array_distinct(F.filter(forms, lambda x: x.isNotNull() & (x != "") & (x != low))))


def spanish_candidates(words: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``lang, raw, cand, source, ord``: copy, table rules, collapsed repeats and rewritings; the first source of a candidate wins."""
    w = words.select("lang", "raw").distinct()
    low = F.lower(X.plain_apostrophe("raw"))
    listed = F.concat(
        F.array(F.struct(F.lit("copy").alias("source"), F.col("raw").alias("cand"))),
        F.array(F.struct(F.lit("repeat2").alias("source"), X.collapse(low, 2).alias("cand")), F.struct(F.lit("repeat1").alias("source"), X.collapse(low, 1).alias("cand"))),
        F.transform(spanish_forms(F.col("raw")), lambda x: F.struct(F.lit("rewriting").alias("source"), x.alias("cand"))),
    )
    rows = w.select("lang", "raw", low.alias("low"), F.posexplode(listed).alias("ord", "z")).select("lang", "raw", "low", (F.col("ord") + 100).alias("ord"), "z.*")
    rows = rows.where(~F.col("source").isin("repeat1", "repeat2") | (F.col("cand") != F.col("low"))).withColumn("ord", F.when(F.col("source") == "copy", 0).otherwise(F.col("ord"))).drop("low")
    if rules is not None:
        rows = rows.unionByName(table_candidates(words, rules).select("lang", "raw", F.lit("rule").alias("source"), "cand", (F.col("ord") + 1).alias("ord")))
    return rows.groupBy("lang", "raw", "cand").agg(F.min_by("source", "ord").alias("source"), F.min("ord").alias("ord"))


def case_variants(candidates: DataFrame) -> DataFrame:
    """Adds each candidate in lower, upper and title case, marked ``case_variant``; known candidates keep their source."""
    shapes = F.array(F.lower("cand"), F.upper("cand"), F.concat(F.upper(F.substring("cand", 1, 1)), F.lower(F.substr("cand", F.lit(2)))))
    new = candidates.select("lang", "raw", F.explode(shapes).alias("cand"), F.lit("case_variant").alias("source")).distinct()
    new = new.join(candidates.select("lang", "raw", "cand"), ["lang", "raw", "cand"], "left_anti")
    return candidates.select("lang", "raw", "cand", "source").unionByName(new)


def accept_best(scored: DataFrame, keys: tuple[str, ...] = ("lang", "raw"), min_score: float = 0.20, margin: float = 0.10) -> DataFrame:
    """``keys, pred, best, copy_score, decision``: the best candidate (``cand, score, ord``) if it is not the word, scores enough, and leads the word's own score by a margin; else the word."""
    order = F.struct("score", -F.col("ord"))
    t = scored.groupBy(*keys).agg(F.max_by("cand", order).alias("best"), F.max("score").alias("s"), F.max(F.when(F.col("cand") == F.col("raw"), F.col("score"))).alias("c"))
    decision = F.when(F.col("best") == F.col("raw"), "copy").when(F.col("s") < min_score, "low_score").when(F.round(F.col("s") - F.coalesce("c", F.lit(0.0)), 6) < margin, "low_margin").otherwise("accept")
    return t.withColumn("decision", decision).select(*keys, F.when(F.col("decision") == "accept", F.col("best")).otherwise(F.col("raw")).alias("pred"), "best", F.col("c").alias("copy_score"), "decision")


def top_two(scored: DataFrame, keys: tuple[str, ...] = ("lang", "raw"), near: float = 0.10) -> DataFrame:
    """The two best candidates of each word, their distance, and whether it is borderline."""
    rank = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "ord")
    t = scored.withColumn("r", F.row_number().over(rank)).where("r <= 2").groupBy(*keys).agg(F.max(F.when(F.col("r") == 1, F.col("cand"))).alias("first"), F.max(F.when(F.col("r") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("r") == 2, F.col("cand"))).alias("second"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("s2"))
    gap = F.round(F.col("s1") - F.col("s2"), 6)
    return t.select(*keys, "first", "second", gap.alias("gap"), F.coalesce(gap < near, F.lit(False)).alias("borderline"))


def master_map(tokens: DataFrame, rules: dict[str, str], mfr: DataFrame) -> DataFrame:
    """A word of the master map gets its replacement, any other the most frequent one."""
    from lexweave.operators.predict import lookup

    m = F.try_element_at(F.create_map(*(F.lit(x) for p in rules.items() for x in p)), F.col("raw")) if rules else F.lit(None).cast("string")
    return lookup(tokens, mfr).withColumns({"decision": F.when(m.isNotNull(), "master").when(F.col("pred") == F.col("raw"), "copy").otherwise("mfr"), "pred": F.coalesce(m, "pred")})


def train_gates(info: DataFrame, keep: float = 0.70, change: float = 0.80, least: int = 2) -> DataFrame:
    """``lang, raw, pred, decision`` from ``candidate_info``: words mostly kept stay, words mostly changed change, others stay."""
    seen = F.col("total") >= least
    decision = F.when(seen & (F.col("raw_ratio") >= keep), "keep").when(seen & (F.col("pred") != F.col("raw")) & (F.col("best_ratio") >= change), "change").otherwise("uncertain")
    return info.withColumn("decision", decision).select("lang", "raw", F.when(F.col("decision") == "change", F.col("pred")).otherwise(F.col("raw")).alias("pred"), "decision")


def sure_then_copy(tokens: DataFrame, sure: DataFrame) -> DataFrame:
    """High-confidence replacements, everything else copied: the part of the scheme policy that needs no model."""
    from lexweave.operators.predict import lookup

    return lookup(tokens, sure).withColumn("decision", F.when(F.col("pred") != F.col("raw"), "mfr").otherwise("copy"))


def context_window(tokens: DataFrame, k: int = 2) -> DataFrame:
    """``left`` and ``right``: up to ``k`` raw neighbours on each side, joined by spaces. Above 2, tokens need ``words``, the sentence's array."""
    if k <= 2:
        # No lambda: its step would stand apart from the explode, which then hands on the sentence's array with every word and holds all rows of a sentence at once.
        word = lambda c: F.when(~F.col(c).isin(BOS, EOS), F.col(c))
        return tokens.withColumns({"left": F.concat_ws(" ", *map(word, ["prev2", "prev"][-k:])), "right": F.concat_ws(" ", *map(word, ["next", "next2"][:k]))})
    before = F.slice("words", F.greatest(F.col("pos") - k + 1, F.lit(1)), F.least(F.col("pos"), F.lit(k)))
    return tokens.withColumns({"left": F.array_join(before, " "), "right": F.array_join(F.slice("words", F.col("pos") + 2, F.lit(k)), " ")})


def fallback(tokens: DataFrame, dictionary: DataFrame, output: Column) -> DataFrame:
    """A generator's output, or the dictionary's best candidate where the output is empty, too long or holds marks."""
    o = F.trim(output)
    bad = o.isNull() | (o == "") | (F.length(o) > F.greatest(F.lit(30), F.length("raw") * 4)) | o.contains("<extra_id_")
    best = dictionary.groupBy("lang", "raw").agg(F.min_by("cand", "ord").alias("d"))
    return tokens.join(best, ["lang", "raw"], "left").withColumn("pred", F.when(bad, F.coalesce("d", "raw")).otherwise(o)).drop("d")
