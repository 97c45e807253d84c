"""Candidate generators: words to rows ``lang, raw, cand, source(s), ord``.

All work on distinct words, so a corpus pays for a word once. Membership in a
vocabulary and counts are equality joins on derived strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import protect as K
from lexweave.functions import tables as T
from lexweave.functions import text as X
from lexweave.functions import unicode as U
from lexweave.operators import stats as S
from lexweave.sources.artifacts import stored


def mapped(x: Column, table: dict[str, str]) -> Column:
    """The table's value of ``x``, null where it has none."""
    return F.try_element_at(F.create_map(*(F.lit(v) for p in table.items() for v in p)), x) if table else F.lit(None).cast("string")


def listed(x: Column, table: dict[str, list[str]]) -> Column:
    """The table's list for ``x``, empty where it has none."""
    none = F.array().cast("array<string>")
    if not table:
        return none
    return F.coalesce(F.try_element_at(F.create_map(*(v for k, cands in table.items() for v in (F.lit(k), F.array(*map(F.lit, cands))))), x), none)


def from_source(source: str, cands: Column) -> Column:
    """An array of (source, cand) from an array of candidates."""
    return F.transform(cands, lambda w: F.struct(F.lit(source).alias("source"), w.alias("cand")))


def one(cand: Column) -> Column:
    return F.filter(F.array(cand), lambda w: w.isNotNull())


def first_of_each(pairs: Column) -> Column:
    """An array of (source, cand) without candidates that stand before: the first source wins."""
    return F.filter(pairs, lambda p, i: ~F.array_contains(F.transform(F.slice(pairs, 1, i), lambda q: q.getField("cand")), p.getField("cand")) & p.getField("cand").isNotNull())


def known(words: DataFrame, column: str, vocabulary: DataFrame, name: str) -> DataFrame:
    """Adds the count of the word in ``column`` in a vocabulary (``lang, word, n``), 0 where it has none."""
    v = vocabulary.select("lang", F.col("word").alias(column), F.col("n").alias(name))
    return words.join(v, ["lang", column], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def by_key(words: DataFrame, table: DataFrame, key: Column, most: int) -> DataFrame:
    """``lang, raw, cand, n, r``: the ``most`` most frequent replacements (``lang, key, norm, n``) of the words' key; smallest first among equals."""
    order = Window.partitionBy("lang", "key").orderBy(F.col("n").desc(), "norm")
    top = table.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    return words.withColumn("key", key).join(top, ["lang", "key"]).select("lang", "raw", F.col("norm").alias("cand"), "n", "r")


def best_score(candidates: DataFrame, keys: tuple[str, ...] = ("lang", "raw", "cand")) -> DataFrame:
    """One row a candidate: its highest score and that score's source, the first in order on ties."""
    return candidates.groupBy(*keys).agg(F.max("score").alias("score"), F.max_by("source", F.struct("score", -F.col("ord"))).alias("source"), F.min("ord").alias("ord"))


def without_copy(candidates: DataFrame) -> DataFrame:
    return candidates.where("cand <> raw")


def source_sets(sources: Column) -> dict[str, Column]:
    """What a set of sources says: weak ones only, a strong one, their number and kinds."""
    weak, strong = (F.array(*map(F.lit, s)) for s in (T.WEAK_SOURCES, T.STRONG_SOURCES))
    has = lambda *names: F.arrays_overlap(sources, F.array(*map(F.lit, names))).cast("int")
    return {
        "num_sources": F.size(sources),
        "weak_only": ((F.size(sources) > 0) & (F.size(F.array_except(sources, weak)) == 0)).cast("int"),
        "has_strong": F.arrays_overlap(sources, strong).cast("int"),
        "has_lookup": has("lookup"),
        "has_mfr": has("mfr"),
        "has_rule": has("rule", "rule_lower"),
        "has_repeat": F.exists(sources, lambda s: s.startswith("repeat")).cast("int"),
        "has_case": has("case"),
        "has_key": has("key"),
        "has_diacritic": has("diacritic"),
    }


def spanish_final(words: DataFrame, counts: DataFrame, most_keys: int = 5) -> DataFrame:
    """Copy, most frequent replacement, key, chat rules: ``lang, raw, cand, source, ord``; the first source of a candidate wins.

    ``counts``: pair counts of the training part.
    """
    from lexweave.operators.rules import spanish_forms

    w = words.select("lang", "raw").distinct()
    mfr = S.most_frequent(counts).select("lang", "raw", F.col("pred").alias("mfr"))
    keyed = counts.select("lang", X.spanish_key("norm").alias("nkey"), X.spanish_key("raw").alias("key"), "norm", "n").groupBy("lang", "key", "norm").agg(F.sum("n").alias("n"))
    near = by_key(w, keyed, X.spanish_key("raw"), most_keys).groupBy("lang", "raw").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "cand"))), lambda z: z.getField("cand")).alias("near"))
    low = F.lower(X.plain_apostrophe("raw"))
    repeats = [F.when(X.collapse(low, k) != low, X.collapse(low, k)) for k in (2, 1)]
    rules = [
        from_source("abbrev", listed(low, T.ES_ABBREV)),
        from_source("accent_lexicon", listed(low, T.ES_ACCENTS)),
        from_source("repeat2", one(repeats[0])),
        from_source("repeat1", one(repeats[1])),
        from_source("cyber_rule", spanish_forms(F.col("raw"))),
        from_source("split_rule", one(mapped(low, T.ES_FUSED))),
        from_source("accent", listed(F.lower("raw"), T.ES_ACCENTS)),
    ]
    every = F.concat(from_source("copy", F.array("raw")), from_source("mfr", one(F.col("mfr"))), from_source("key", F.coalesce("near", F.array().cast("array<string>"))), *rules)
    t = w.join(mfr, ["lang", "raw"], "left").join(near, ["lang", "raw"], "left").select("lang", "raw", first_of_each(every).alias("z"))
    return t.select("lang", "raw", F.posexplode("z").alias("ord", "p")).select("lang", "raw", "p.cand", "p.source", "ord")


def _repeat(x: Column, keep: int) -> Column:
    letters = r"([A-Za-zÀ-ÖØ-öø-ÿ])\1{2,}"
    return F.when(x.rlike(letters), F.regexp_replace(x, letters, "$1" * keep))


def italian_ranker(words: DataFrame, counts: DataFrame, casefold: bool = True, diacritics: bool = True, repeat: bool = True, abbrev: bool = True) -> DataFrame:
    """Word, most frequent replacement, that of the lower-cased word, accents, repeats in the vocabulary, abbreviations; protected words (K3) only copy."""
    w = words.select("lang", "raw").distinct().withColumns({"low": F.lower("raw"), "one": _repeat(F.col("raw"), 1), "two": _repeat(F.col("raw"), 2)})
    w = w.withColumns({"one_low": F.lower("one"), "two_low": F.lower("two")})
    vocabulary = counts.groupBy("lang", F.col("norm").alias("word")).agg(F.sum("n").alias("n"))
    for name in ("one", "one_low", "two", "two_low"):
        w = known(w, name, vocabulary, f"n_{name}")
    w = w.join(S.most_frequent(counts).select("lang", "raw", F.col("pred").alias("mfr")), ["lang", "raw"], "left")
    folded = counts.groupBy("lang", F.lower("raw").alias("low"), "norm").agg(F.sum("n").alias("n"))
    w = w.join(S.most_frequent(folded, ("lang", "low"), "T2", "low").select("lang", "low", F.col("pred").alias("folded")), ["lang", "low"], "left")
    raised = lambda m: F.when(X.first_upper("raw"), F.concat(F.upper(F.substring(m, 1, 1)), X.rest(m))).otherwise(m)
    in_vocabulary = lambda k: F.when((F.col(k) != F.col("raw")) & ((F.col(f"n_{k}") > 0) | (F.col(f"n_{k}_low") > 0)), F.col(k))
    parts = [from_source("mfr", one(F.col("mfr")))]
    parts += [from_source("casefold", one(F.col("folded")))] if casefold else []
    parts += [from_source("diacritic", one(F.coalesce(mapped(F.col("raw"), T.IT_RANKER_DIACRITIC), raised(mapped(F.col("low"), T.IT_RANKER_DIACRITIC)))))] if diacritics else []
    parts += [from_source("repeat", F.filter(F.array(in_vocabulary("one"), in_vocabulary("two")), lambda x: x.isNotNull()))] if repeat else []
    parts += [from_source("abbrev", one(raised(mapped(F.col("low"), T.IT_RANKER_ABBREV))))] if abbrev else []
    every = F.concat(from_source("raw", F.array("raw")), *(F.when(~X.protected_k3("raw"), p).otherwise(F.slice(p, 1, 0)) for p in parts))
    return w.select("lang", "raw", F.posexplode(first_of_each(every)).alias("ord", "p")).select("lang", "raw", "p.cand", "p.source", "ord")


def monoise(words: DataFrame, counts: DataFrame, extended: bool = False, most: int = 8, cases: bool = False) -> DataFrame:
    """``lang, raw, cand, sources, ord``: word, lookup, most frequent, key, case, rules, repeats, with all sources of each candidate.

    ``extended`` adds words alike but for accents, other forms of repeats, and
    cuts into two known words; ``cases`` adds lower, upper and title case.
    Protected words (K1) only copy. ``ord``: place of the first source that has the candidate.
    """
    w = words.select("lang", "raw").distinct()
    free = w.where(~X.protected_k1("raw"))
    vocabulary = counts.groupBy("lang", F.col("norm").alias("word")).agg(F.sum("n").alias("n"))
    lookup = counts.select("lang", F.col("raw").alias("key"), "norm", "n")
    keyed = counts.groupBy("lang", X.make_key("raw").alias("key"), "norm").agg(F.sum("n").alias("n"))
    cased = counts.groupBy("lang", F.lower("norm").alias("key"), "norm").agg(F.sum("n").alias("n"))
    rule = lambda key: free.select("lang", "raw", F.posexplode(listed(key, T.IT_ABBREV)).alias("r", "cand"))
    parts = [
        ("original", w.select("lang", "raw", F.col("raw").alias("cand"), F.lit(0).alias("r"))),
        ("lookup", by_key(free, lookup, F.col("raw"), most)),
        ("mfr", by_key(free, lookup, F.col("raw"), 1)),
        ("key", by_key(free, keyed, X.make_key("raw"), most)),
        ("case", by_key(free, cased, F.lower("raw"), most)),
        ("rule", rule(F.col("raw"))),
        ("rule_lower", rule(F.lower("raw"))),
    ]
    short = free.select("lang", "raw", F.explode(F.array(X.collapse("raw", 1), X.collapse("raw", 2))).alias("cand")).where("cand <> raw").distinct()
    parts.append(("repeat", known(short, "cand", vocabulary, "n").where("n > 0").select("lang", "raw", "cand", F.lit(0).alias("r"))))
    if extended:
        bare = counts.groupBy("lang", U.diacritic_key("norm").alias("key"), "norm").agg(F.sum("n").alias("n"))
        parts.append(("diacritic", by_key(free, bare, U.diacritic_key("raw"), most).where("cand <> raw")))
        forms = short.withColumnRenamed("raw", "word").withColumnRenamed("cand", "raw")
        for name, table, key in (("repeat_case", cased, F.lower("raw")), ("repeat_key", keyed, X.make_key("raw")), ("repeat_diacritic", bare, U.diacritic_key("raw"))):
            found = by_key(forms.select("lang", "raw").distinct(), table, key, 3)
            parts.append((name, forms.join(found, ["lang", "raw"]).select("lang", F.col("word").alias("raw"), "cand", "r")))
        parts += [(name, splits.select("lang", "raw", "cand", "r")) for name, splits in _splits(free, vocabulary, cased, bare, most)]
    if cases:
        every = [p.select("lang", "raw", "cand") for _, p in parts]
        seen = every[0]
        for p in every[1:]:
            seen = seen.unionByName(p)
        free_cands = seen.distinct().where(~X.protected_k1("raw"))
        shapes = F.array(F.lower("cand"), F.upper("cand"), F.concat(F.upper(F.substring("cand", 1, 1)), F.lower(X.rest("cand"))))
        parts.append(("case_variant", free_cands.select("lang", "raw", F.explode(shapes).alias("new"), "cand").where("new <> cand").select("lang", "raw", F.col("new").alias("cand"), F.lit(0).alias("r")).distinct()))
    rows = None
    for i, (name, p) in enumerate(parts):
        p = p.where("cand <> ''").select("lang", "raw", "cand", F.lit(name).alias("source"), (F.lit(i) * 1000 + F.col("r")).alias("o"))
        rows = p if rows is None else rows.unionByName(p)
    return rows.groupBy("lang", "raw", "cand").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.min("o").cast("int").alias("ord"))


def _splits(words: DataFrame, vocabulary: DataFrame, cased: DataFrame, bare: DataFrame, most: int) -> list[tuple[str, DataFrame]]:
    """Cuts of words over three letters into two known ones: as they are, by lower case, without accents; the first ``most`` of a word in order of place, then kind.

    A left part of one letter is tried with an apostrophe, too.
    """
    cut = words.where(F.length("raw") > 3).select("lang", "raw", F.explode(F.sequence(F.lit(1), F.length("raw") - 1)).alias("at"))
    cut = cut.select("lang", "raw", "at", F.left("raw", F.col("at")).alias("a"), F.substr("raw", F.col("at") + 1).alias("b"))
    apostrophe = cut.where("at = 1").withColumn("a", F.concat("a", F.lit("'")))
    cut = cut.withColumn("v", F.lit(0)).unionByName(apostrophe.withColumn("v", F.lit(1)))
    best = lambda table: table.groupBy("lang", "key").agg(F.min_by("norm", F.struct(-F.col("n"), "norm")).alias("w"))
    exact = vocabulary.select("lang", F.col("word").alias("key"), F.col("word").alias("w"))

    def halves(rows, table, key):
        k = rows.withColumns({"ka": key(F.col("a")), "kb": key(F.col("b"))})
        return k.join(table.select("lang", F.col("key").alias("ka"), F.col("w").alias("wa")), ["lang", "ka"]).join(table.select("lang", F.col("key").alias("kb"), F.col("w").alias("wb")), ["lang", "kb"])

    # Words that are equal, or equal in lower case, are so without accents: only cuts known by that key go on.
    loose = stored(halves(cut, best(bare), U.diacritic_key).select("lang", "raw", "at", "v", "a", "b", "wa", "wb"), "cuts")
    known_cuts = loose.drop("wa", "wb")
    found = None
    for i, (name, k) in enumerate((("split", halves(known_cuts, exact, lambda x: x)), ("split_case", halves(known_cuts, best(cased), F.lower)), ("split_diacritic", loose))):
        k = k.select("lang", "raw", F.concat_ws(" ", "wa", "wb").alias("cand"), F.lit(name).alias("source"), F.struct("at", "v", F.lit(i).alias("i")).alias("place"))
        found = k if found is None else found.unionByName(k)
    order = Window.partitionBy("lang", "raw").orderBy("place")
    found = stored(found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most), "splits")
    return [(name, found.where(F.col("source") == name)) for name in ("split", "split_case", "split_diacritic")]


def thai_rules(words: DataFrame, most: int = 12) -> DataFrame:
    """Rewritings of Thai words by ``unicode.thai_rule_forms``, in order."""
    w = words.select("lang", "raw").distinct()
    return w.select("lang", "raw", F.posexplode(U.thai_rule_forms(F.col("raw"), most)).alias("ord", "cand")).select("lang", "raw", "cand", F.lit("rule").alias("source"), "ord")


def thai_edit(a: Column, b: Column, most: int) -> Column:
    """Edit distance, ``most`` + 1 beyond it."""
    return X.edit_distance(a, b, most)


def thai_best(words: DataFrame, counts: DataFrame, min_conf: float = 0.80, min_count: int = 2, most: int = 8) -> DataFrame:
    """``lang, raw, cand, source, score``: the best of most frequent replacement, error dictionary and rules; the word itself (``keep``, 0) without a better one.

    An earlier source wins ties. Scores: 3 + 3 share + ln(1 + total) / 4; 2.8 + 2 share among changes + ln(1 + count) / 4;
    1.3, 1 more for a word of the gold vocabulary and for the most frequent replacement, less 0.15 an edit.
    """
    w = words.select("lang", "raw").distinct()
    mfr = S.with_confidence(S.most_frequent(counts, tie="T3")).select("lang", "raw", F.col("pred").alias("mfr"), "conf", "total")
    w = w.join(mfr, ["lang", "raw"], "left")
    gold = counts.select("lang", F.col("norm").alias("cand")).distinct().withColumn("correct", F.lit(1))
    none = F.col("mfr").isNull()
    keep = w.select("lang", "raw", F.col("raw").alias("cand"), F.lit("keep").alias("source"), F.lit(0.0).alias("score"), F.lit(0).alias("ord"))
    sure = w.where((F.col("mfr") != F.col("raw")) & (F.col("conf") >= min_conf) & (F.col("total") >= min_count)).select("lang", "raw", F.col("mfr").alias("cand"), F.lit("mfr").alias("source"), (3.0 + 3.0 * F.col("conf") + F.log1p("total") / 4.0).alias("score"), F.lit(1).alias("ord"))
    errors = counts.where("norm <> raw")
    total = errors.groupBy("lang", "raw").agg(F.sum("n").alias("errors"))
    e = errors.join(total, ["lang", "raw"]).join(w.select("lang", "raw", "mfr"), ["lang", "raw"])
    e = e.groupBy("lang", "raw", "errors").agg(F.max(F.struct("n", (F.col("norm") == F.col("mfr")).alias("same"), "norm")).alias("z"))
    dictionary = e.select("lang", "raw", F.col("z.norm").alias("cand"), F.lit("errdict").alias("source"), (2.8 + 2.0 * F.col("z.n") / F.col("errors") + F.log1p("z.n") / 4.0).alias("score"), F.lit(2).alias("ord"))
    rules = thai_rules(w, most).join(gold, ["lang", "cand"], "left").join(w.select("lang", "raw", F.when(none, F.col("raw")).otherwise(F.col("mfr")).alias("mfr")), ["lang", "raw"])
    same = (F.col("cand") == F.col("mfr")).cast("int")
    rules = rules.select("lang", "raw", "cand", "source", (1.3 + F.coalesce("correct", F.lit(0)) + same - 0.15 * thai_edit(F.col("raw"), F.col("cand"), 8)).alias("score"), (F.col("ord") + 3).alias("ord"))
    every = keep.unionByName(sure).unionByName(dictionary).unionByName(rules).withColumn("score", F.round("score", 6))
    top = every.groupBy("lang", "raw").agg(F.max_by(F.struct("cand", "source", "score"), F.struct("score", -F.col("ord"))).alias("z"))
    return top.select("lang", "raw", "z.*")


def korean_rules(words: DataFrame) -> DataFrame:
    """Table candidates and shortened emotes of Korean words, in order."""
    w = words.select("lang", "raw").distinct()
    cands = F.array_distinct(F.concat(listed(F.col("raw"), T.KO_CANDIDATES), X.emote_candidates("raw")))
    return w.select("lang", "raw", F.posexplode(cands).alias("ord", "cand")).select("lang", "raw", "cand", F.lit("rule").alias("source"), "ord")


def _split_hot(left: DataFrame, right: DataFrame, keys: tuple[str, ...], spread: str, most: int) -> DataFrame:
    """The equality join of both on ``keys``; a key that more than ``most`` rows of ``right`` have is dealt to several tasks by a hash of ``spread``, beside each of which stand the rows of ``left``."""
    hot = right.groupBy(*keys).agg(F.ceil(F.count("*") / most).alias("__parts")).where(F.col("__parts") > 1)
    parts = F.coalesce("__parts", F.lit(1))
    r = right.join(hot, list(keys), "left").withColumn("__part", F.pmod(F.xxhash64(spread), parts)).drop("__parts")
    every = left.join(hot, list(keys), "left").withColumn("__n", parts)
    ell = every.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))).drop("__parts", "__n")
    return ell.join(r, [*keys, "__part"]).drop("__part")


def _without_one(x: Column) -> Column:
    """The word and what is left of it without one letter."""
    return F.concat(F.array(x), F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1))))


def _quarter(x: Column, n: Column, i: Column, shift: Column, *block: Column) -> Column:
    """Hash of a block, a length, the number of one of four parts of words of that length, and the letters of ``x`` in its place, moved by ``shift``."""
    begin, end = F.floor(n * i / 4), F.floor(n * (i + 1) / 4)
    return F.xxhash64(F.lit("q"), *block, n.cast("int"), i.cast("int"), F.substr(x, F.greatest(begin + 1 + shift, F.lit(1)).cast("int"), (end - begin).cast("int")))


def _quarters(x: Column, *block: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: _quarter(x, F.length(x), i, F.lit(0), *block))


#: Of two words within three edits, the longer by ``more`` letters, one part of the other stands in the first as it is, moved by ``shift``:
#: edits before the part move it, those behind it do the rest, and there is a part with no more edits before it than parts, nor behind it.
_PLACES = [(more, i, shift) for more in range(-3, 4) for i in range(4) for shift in range(-3, 4) if abs(shift) <= i and abs(shift - more) <= 3 - i]


def _quarters_of_others(x: Column, *block: Column) -> Column:
    """What ``_quarters`` of any word within three edits of ``x`` can be."""
    places = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.lit(s).alias("s")) for m, i, s in _PLACES))
    return F.transform(places, lambda p: _quarter(x, F.length(x) - p["m"], p["i"], p["s"], *block))


def near_korean(words: DataFrame, vocabulary: DataFrame, hot: int = 2000, most: int | None = None) -> DataFrame:
    """``lang, raw, cand, n, dist``: pairs with the same first letter of the first syllable, at most two syllables longer or shorter, within 1.2 (three syllables) or 1.8; each once.

    One syllable or one letter apart, both leave the same string when each loses
    one at most. Two or three letters apart, one of four parts of one word
    stands in the other as it is. So the joins are on strings, lose no pair, and
    tell distances before anything is exchanged again. A word with ``most``
    others within one syllable or letter is not looked for further: those
    beyond are farther than all of them.
    """
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: dealt to all tasks
    left = stored(words.select("lang", "raw").distinct().where("raw <> ''").repartition(parts, "lang", "raw").withColumns({"b": X.first_jamo("raw"), "j": X.jamo("raw")}), "asked")
    right = stored(vocabulary.select("lang", F.col("word").alias("cand"), "n").where("cand <> ''").repartition(parts, "lang", "cand").withColumns({"b": X.first_jamo("cand"), "k": X.jamo("cand")}), "known")
    # 1.8 is three letters at 0.6 or one syllable: distances beyond are not worked out.
    whole, letters = F.levenshtein("raw", "cand", 1), F.levenshtein("j", "k", 3)
    dist = F.round(F.least(F.when(whole >= 0, whole.cast("double")), F.when(letters >= 0, letters * 0.6)), 6)
    limit = F.when(F.length("raw") <= 3, 1.2).otherwise(1.8)

    def pairs(rows: DataFrame, limit: Column) -> DataFrame:
        near = rows.where((F.col("raw") != F.col("cand")) & (F.abs(F.length("raw") - F.length("cand")) <= 2) & (dist <= limit))
        return near.select("lang", "raw", "cand", "n", dist.alias("dist"))

    def each_once(rows: DataFrame) -> DataFrame:
        return rows.groupBy("lang", "raw", "cand").agg(F.first("n").alias("n"), F.first("dist").alias("dist"))

    lost = lambda x, j: F.explode(F.array_distinct(F.transform(F.concat(_without_one(F.col(x)), _without_one(F.col(j))), lambda w: F.xxhash64(w)))).alias("h")
    asked = stored(left.select("*", lost("raw", "j")), "asked-strings")  # its size tells Spark whether to broadcast it
    close = stored(each_once(pairs(asked.join(right.select("*", lost("cand", "k")), ["lang", "b", "h"]), F.lit(1.0))), "close")
    if most is not None:
        full = close.groupBy("lang", "raw").agg(F.count("*").alias("c")).where(F.col("c") >= most)
        left = left.join(full, ["lang", "raw"], "left_anti")
    quarters = right.select("*", F.explode(_quarters(F.col("k"))).alias("h"))
    far = _split_hot(left.select("*", F.explode(F.array_distinct(_quarters_of_others(F.col("j")))).alias("h")), quarters, ("lang", "b", "h"), "cand", hot)
    return each_once(pairs(far, limit).unionByName(close))


def near_vocabulary(words: DataFrame, vocabulary: DataFrame, language: str = "ko", most: int = 8) -> DataFrame:
    """``lang, raw, cand, dist, n, r``: vocabulary words near a word, nearest first, then most frequent.

    ``ko``: same first letter of the first syllable, at most two syllables
    longer or shorter, Korean distance up to 1.2 (three syllables) or 1.8.
    Others: same first letter without accents, one longer or shorter, one edit
    of the lower-cased words without accents; the join is on what both leave when a letter is deleted.
    """
    from lexweave.operators.predict import _deletions

    left = words.select("lang", "raw").distinct().where("raw <> ''")
    right = vocabulary.select("lang", F.col("word").alias("cand"), "n")
    if language == "ko":
        near = near_korean(left, vocabulary, most=most)
    else:
        bare = lambda x: X.strip_accents(F.lower(F.col(x)))
        near = left.withColumn("k", F.explode(_deletions(bare("raw"), 1))).join(right.withColumn("k", F.explode(_deletions(bare("cand"), 1))), ["lang", "k"])
        near = near.where((F.col("raw") != F.col("cand")) & (F.left(bare("raw"), F.lit(1)) == F.left(bare("cand"), F.lit(1))) & (F.abs(F.length("raw") - F.length("cand")) <= 1))
        near = near.select("lang", "raw", "cand", "n").distinct().withColumn("dist", X.roman_distance("raw", "cand")).where("dist <= 1")
    order = Window.partitionBy("lang", "raw").orderBy("dist", F.col("n").desc(), F.length("cand"), "cand")
    return near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("lang", "raw", "cand", "dist", "n", "r")
