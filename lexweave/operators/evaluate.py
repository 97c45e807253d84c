"""Metrics and diagnostics over predicted tokens (``lang, raw, norm, pred``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _n(x: Column) -> Column:
    return F.sum(x.cast("long"))


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)


def metrics(tokens: DataFrame, keys: tuple[str, ...] = ("lang",), ignore_case: bool = False) -> DataFrame:
    """Totals, leave-as-is accuracy, accuracy, error reduction, accuracy on changed and unchanged tokens, over-change.

    Error reduction is (accuracy - leave-as-is) / (1 - leave-as-is), 0 where nothing changed.
    """
    low = F.lower if ignore_case else (lambda x: F.col(x))
    raw, gold, pred = low("raw"), low("norm"), low("pred")
    t = tokens.groupBy(*keys).agg(F.count("*").alias("total"), _n(raw != gold).alias("changed"), _n(pred == gold).alias("correct"), _n((raw != gold) & (pred == gold)).alias("fixed"), _n((raw == gold) & (pred != gold)).alias("broken"))
    same = F.col("total") - F.col("changed")
    return t.select(
        *keys, "total", "changed", "correct",
        _ratio(same, F.col("total")).alias("lai"),
        _ratio(F.col("correct"), F.col("total")).alias("accuracy"),
        _ratio(F.col("correct") - same, F.col("changed")).alias("err"),
        _ratio(F.col("fixed"), F.col("changed")).alias("changed_acc"),
        _ratio(same - F.col("broken"), same).alias("unchanged_acc"),
        _ratio(F.col("broken"), same).alias("over_change"),
    )


def case_only_metrics(tokens: DataFrame) -> DataFrame:
    case = (F.col("raw") != F.col("norm")) & (F.lower("raw") == F.lower("norm"))
    return tokens.groupBy("lang").agg(_n(case).alias("case_gold"), _n(case & (F.col("pred") == F.col("norm"))).alias("case_correct"), _n((F.col("raw") == F.col("norm")) & (F.col("pred") != F.col("raw")) & (F.lower("pred") == F.lower("raw"))).alias("case_over"))


def detection_metrics(tokens: DataFrame) -> DataFrame:
    """Changes predicted against changes in gold: confusion, precision, recall, F1."""
    g, p = F.col("raw") != F.col("norm"), F.col("raw") != F.col("pred")
    t = tokens.groupBy("lang").agg(_n(g & p).alias("tp"), _n(~g & p).alias("fp"), _n(g & ~p).alias("fn"), _n(~g & ~p).alias("tn"))
    precision, recall = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return t.select("lang", "tp", "fp", "fn", "tn", F.round(F.coalesce(precision, F.lit(0.0)), 6).alias("precision"), F.round(F.coalesce(recall, F.lit(0.0)), 6).alias("recall"), _ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def decision_counts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("lang", "decision").agg(F.count("*").alias("n"), _n(F.col("pred") == F.col("norm")).alias("correct"))


def upper_bound(tokens: DataFrame, candidates: DataFrame) -> DataFrame:
    """Share of tokens whose gold is a candidate, of all and of changed ones, and candidates per token."""
    size = candidates.groupBy("lang", "raw").agg(F.count("*").alias("k"))
    t = tokens.join(size, ["lang", "raw"], "left").join(candidates.select("lang", "raw", F.col("cand").alias("norm"), F.lit(1).alias("hit")), ["lang", "raw", "norm"], "left")
    hit, changed = F.col("hit").isNotNull() | (F.col("k").isNull() & (F.col("raw") == F.col("norm"))), F.col("raw") != F.col("norm")
    t = t.groupBy("lang").agg(F.count("*").alias("total"), _n(hit).alias("hits"), _n(changed).alias("changed"), _n(hit & changed).alias("changed_hits"), F.sum(F.coalesce("k", F.lit(1))).alias("k"))
    return t.select("lang", "total", "hits", _ratio(F.col("hits"), F.col("total")).alias("bound"), "changed", _ratio(F.col("changed_hits"), F.col("changed")).alias("changed_bound"), _ratio(F.col("k"), F.col("total")).alias("per_token"))


def top_changes(tokens: DataFrame, n: int = 30) -> DataFrame:
    """The report of the ``n`` most frequent changes of each language."""
    counts = tokens.where("raw <> pred").groupBy("lang", "raw", "pred").agg(F.count("*").alias("n"))
    rank = Window.partitionBy("lang").orderBy(F.col("n").desc(), "raw", "pred")
    return counts.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n)


def quantiles(values: DataFrame, column: str, shares: tuple[float, ...] = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0), bins: int = 4096) -> DataFrame:
    """``lang, p, value``: exact lower nearest-rank quantiles of numbers, element int((n - 1) p) of the order; nulls are left out.

    A histogram of ``bins`` equal steps a language tells in which step a
    quantile lies; only that step's distinct values are ordered, so no window
    covers a language's rows.
    """
    c = values.where(F.col(column).isNotNull()).groupBy("lang", F.col(column).alias("value")).agg(F.count("*").alias("n"))
    span = c.groupBy("lang").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("n").alias("total"))
    step = F.floor((F.col("value") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0)) * bins)
    c = c.join(F.broadcast(span), "lang").withColumn("bin", F.least(F.coalesce(step, F.lit(0)), F.lit(bins - 1)))  # one row a language
    steps = c.groupBy("lang", "bin").agg(F.sum("n").alias("m"), F.first("total").alias("total"))
    to = F.sum("m").over(Window.partitionBy("lang").orderBy("bin"))  # of as many rows as there are steps
    asked = steps.withColumn("to", to).withColumn("p", F.explode(F.array(*(F.lit(s) for s in shares)))).withColumn("at", F.floor((F.col("total") - 1) * F.col("p")))
    asked = asked.where((F.col("at") < F.col("to")) & (F.col("at") >= F.col("to") - F.col("m"))).select("lang", "bin", "p", (F.col("at") - F.col("to") + F.col("m")).alias("at"))
    inner = c.join(F.broadcast(asked), ["lang", "bin"]).withColumn("upto", F.sum("n").over(Window.partitionBy("lang", "p").orderBy("value")))  # a row a language and share
    return inner.where((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("n"))).select("lang", "p", "value")


def threshold_sweep(tokens: DataFrame, score: str, thresholds: list[float]) -> DataFrame:
    """``lang, threshold, tp, fp, fn, f1``; a score is compared with all thresholds in one pass over the rows."""
    g = F.col("raw") != F.col("norm")
    aggs = []
    for i, t in enumerate(thresholds):
        p = F.col(score) >= t
        aggs += [_n(g & p).alias(f"tp{i}"), _n(~g & p).alias(f"fp{i}"), _n(g & ~p).alias(f"fn{i}")]
    wide = tokens.groupBy("lang").agg(*aggs)
    rows = wide.select("lang", F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn")) for i, t in enumerate(thresholds)))).alias("z")).select("lang", "z.*")
    return rows.withColumn("f1", _ratio(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold of the highest F1; the lowest wins ties."""
    return sweep.groupBy("lang").agg(F.max_by("threshold", F.struct("f1", -F.col("threshold"))).alias("threshold"), F.max("f1").alias("f1"))


def error_sweep(tokens: DataFrame, score: str, candidate: str, thresholds: list[float]) -> DataFrame:
    """``lang, threshold, total, changed, correct, false_pos, err, accuracy``: the candidate is taken where the score reaches the threshold; one pass for all."""
    g = F.col("raw") != F.col("norm")
    aggs = [F.count("*").alias("total"), _n(g).alias("changed")]
    for i, t in enumerate(thresholds):
        pred = F.when(F.col(score) >= t, F.col(candidate)).otherwise(F.col("raw"))
        aggs += [_n(pred == F.col("norm")).alias(f"c{i}"), _n(~g & (pred != F.col("raw"))).alias(f"f{i}")]
    wide = tokens.groupBy("lang").agg(*aggs)
    each = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"c{i}").alias("correct"), F.col(f"f{i}").alias("false_pos")) for i, t in enumerate(thresholds)))
    rows = wide.select("lang", "total", "changed", F.explode(each).alias("z")).select("lang", "z.threshold", "total", "changed", "z.correct", "z.false_pos")
    return rows.withColumns({"err": _ratio(F.col("correct") - (F.col("total") - F.col("changed")), F.col("changed")), "accuracy": _ratio(F.col("correct"), F.col("total"))})


def best_error_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold of the highest error reduction, then accuracy, then of the fewest false changes; the lowest wins ties."""
    order = F.struct("err", "accuracy", (-F.col("false_pos")).alias("f"), (-F.col("threshold")).alias("t"))
    return sweep.groupBy("lang").agg(F.max_by("threshold", order).alias("threshold"), F.max("err").alias("err"))


def action_metrics(tokens: DataFrame) -> DataFrame:
    """COPY and NORM decisions against gold changes: decisions right, recall of changes, changes with the right text, copies kept."""
    g, d = F.col("raw") != F.col("norm"), F.col("decision") == "NORM"
    t = tokens.groupBy("lang").agg(F.count("*").alias("total"), _n(g).alias("changed"), _n(g == d).alias("right"), _n(g & d).alias("found"), _n(g & d & (F.col("pred") == F.col("norm"))).alias("exact"), _n(~g & ~d).alias("kept"), _n(F.col("decision") == "MALFORMED").alias("malformed"))
    same = F.col("total") - F.col("changed")
    return t.select("lang", "total", "changed", "malformed", _ratio(F.col("right"), F.col("total")).alias("decision_accuracy"), _ratio(F.col("found"), F.col("changed")).alias("change_recall"), _ratio(F.col("exact"), F.col("changed")).alias("text_accuracy"), _ratio(F.col("kept"), same).alias("copy_recall"))


def fold_means(metrics_by_fold: DataFrame) -> DataFrame:
    """Mean leave-as-is accuracy, accuracy and error reduction of each language over its folds."""
    return metrics_by_fold.groupBy("lang").agg(F.count("*").alias("folds"), *(F.round(F.avg(c), 6).alias(c) for c in ("lai", "accuracy", "err")))


def error_listing(tokens: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` false and missed changes of each language in order of the text: a report."""
    kind = F.when((F.col("raw") == F.col("norm")) & (F.col("pred") != F.col("raw")), "false").when((F.col("raw") != F.col("norm")) & (F.col("pred") == F.col("raw")), "missed")
    rank = Window.partitionBy("lang", "kind").orderBy("sent_id", "pos")
    return tokens.withColumn("kind", kind).where("kind is not null").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= most).select("lang", "kind", "rank", "sent_id", "pos", "raw", "norm", "pred")


def change_summary(tokens: DataFrame) -> DataFrame:
    """``lang, category, changed, correct, share``: predicted changes by kind, and their part of all tokens of the language."""
    from lexweave.functions import text as X

    total = tokens.groupBy("lang").agg(F.count("*").alias("all"))
    t = tokens.where("raw <> pred").withColumn("category", X.mapping_class("raw", "pred")).groupBy("lang", "category").agg(F.count("*").alias("changed"), _n(F.col("pred") == F.col("norm")).alias("correct"))
    return t.join(F.broadcast(total), "lang").select("lang", "category", "changed", "correct", _ratio(F.col("changed"), F.col("all")).alias("share"))


def top_words(tokens: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most frequent words, replacements and changes of each language: a report."""
    kinds = F.array(F.struct(F.lit("raw").alias("kind"), F.col("raw").alias("item")), F.struct(F.lit("norm").alias("kind"), F.col("norm").alias("item")), F.when(F.col("raw") != F.col("norm"), F.struct(F.lit("change").alias("kind"), F.concat_ws(" -> ", "raw", "norm").alias("item"))))
    t = tokens.select("lang", F.explode(F.filter(kinds, lambda z: z.isNotNull())).alias("z")).groupBy("lang", "z.kind", "z.item").agg(F.count("*").alias("n"))
    rank = Window.partitionBy("lang", "kind").orderBy(F.col("n").desc(), "item")
    return t.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n)
