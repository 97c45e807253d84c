"""Gates and rankers with pyspark.ml, and the plug-in for text generators."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Binarizer, ElementwiseProduct, FeatureHasher, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.operators.features import NUMERIC, STRINGS
from lexweave.sources.artifacts import stored


def class_weights(rows: DataFrame, positive: float) -> DataFrame:
    return rows.withColumn("weight", F.when(F.col("label") == 1.0, positive).otherwise(1.0))


def fit_gate(rows: DataFrame, kind: str = "forest", positive: float = 3.5, features: int = 1 << 12, trees: int = 50, depth: int = 12, seed: int = 42) -> PipelineModel:
    """A change detector over ``label`` and the features of ``detector_rows``: hashed one-hots and numbers.

    ``kind``: ``forest`` or ``logistic``.
    """
    hasher = FeatureHasher(inputCols=[*NUMERIC, *STRINGS], outputCol="features", numFeatures=features)
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight"}
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **common) if kind == "forest" else LogisticRegression(regParam=1e-3, maxIter=50, **common)
    return Pipeline(stages=[hasher, model]).fit(class_weights(rows, positive))


def change_probability(model: PipelineModel, rows: DataFrame) -> DataFrame:
    out = model.transform(rows).withColumn("change_p", vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction", "probability", "prediction")


class Generator(Protocol):
    """A sequence-to-sequence model: prompts to texts, a batch at a time."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


def identity(prompts: list[str]) -> list[str]:
    """The generator of an installation without model weights: gives nothing, so policies fall back to the word."""
    return [""] * len(prompts)


def generate(rows: DataFrame, make: Callable[[], Generator] = lambda: identity, prompt: str = "prompt", output: str = "generated") -> DataFrame:
    """Adds the generator's outputs for a prompt column. ``make`` loads the model once a task; batches come by Arrow."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*rows.schema.fields, StructField(output, StringType())])

    def run(batches: Iterator) -> Iterator:
        model = make()
        for pdf in batches:
            yield pdf.assign(**{output: model(pdf[prompt].tolist())})

    return rows.mapInPandas(run, schema)


def char_ngrams(x, least: int = 2, most: int = 5, bounded: bool = True) -> Column:
    """Character n-grams of a text as an array with repeats; ``bounded``: within words that have a space at each end, as a whole where they are shorter."""
    words = F.transform(F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" "))) if bounded else F.array(F.lower(x))

    def grams(n):
        return lambda w: cut(w, n)

    def cut(w, n):
        size = F.length(w)
        parts = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substr(w, i, F.lit(n)))
        # A word shorter than n stands once, for the smallest n that exceeds it.
        return F.when(size >= n, parts).when((size < n) & (F.lit(n) == F.greatest(size, F.lit(least))), F.array(w)).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.concat(*(F.transform(words, grams(n)) for n in range(least, most + 1))))


def fit_text_classifier(rows: DataFrame, text: str = "text", least: int = 2, most: int = 5, features: int = 1 << 16, bounded: bool = True, positive: float = 1.0) -> Callable[[DataFrame], DataFrame]:
    """Logistic regression of ``label`` on hashed character n-grams: counts as they are, inverse document frequency, unit length. Returns what adds ``p``.

    Equal texts of one label are one row that weighs as many, in document frequencies and in the regression.
    """
    def prepared(df: DataFrame) -> DataFrame:
        grams = df.withColumn("__grams", char_ngrams(F.col(text), least, most, bounded))
        return HashingTF(inputCol="__grams", outputCol="__tf", numFeatures=features).transform(grams).drop("__grams")

    counted = class_weights(rows, positive).groupBy(text, "label", "weight").agg(F.count("*").cast("double").alias("__n"))
    train = stored(prepared(counted), "hashed-texts")
    held = Binarizer(threshold=0.0, inputCol="__tf", outputCol="__held").transform(train)
    w = F.col("weight") * F.col("__n")
    got = held.agg(Summarizer.mean(F.col("__held"), F.col("__n")).alias("share"), F.sum("__n").alias("n"), F.sum(w).alias("w"), F.sum(w * F.col("weight")).alias("single"), F.sum(w * w).alias("joint")).first()
    idf = [math.log((got["n"] + 1) / (round(x * got["n"]) + 1)) for x in got["share"].toArray()]
    # The regression's penalty goes by an unbiased variance, which takes rows of great weight for few: this undoes it.
    joint = (got["w"] - got["joint"] / got["w"]) / (got["w"] - got["single"] / got["w"])
    reg = 1e-3 * joint if joint > 0 else 1e-3
    stages = [ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="__tf", outputCol="__idf"), Normalizer(inputCol="__idf", outputCol="__x"), LogisticRegression(featuresCol="__x", labelCol="label", weightCol="weight", regParam=reg, maxIter=50)]
    pipeline = Pipeline(stages=stages).fit(train.withColumn("weight", w))

    def score(df: DataFrame) -> DataFrame:
        out = pipeline.transform(prepared(df)).withColumn("p", vector_to_array("probability")[1])
        return out.drop("__tf", "__idf", "__x", "rawPrediction", "probability", "prediction")

    return score


def select_config(results: DataFrame, keys: tuple[str, ...] = ("config", "threshold")) -> DataFrame:
    """The best configuration of ``lang, fold, err, accuracy`` and keys: highest mean error reduction, then accuracy; the smallest keys win ties."""
    means = results.groupBy("lang", *keys).agg(F.round(F.avg("err"), 6).alias("err"), F.round(F.avg("accuracy"), 6).alias("accuracy"))
    best = means.groupBy("lang").agg(F.min(F.struct((-F.col("err")).alias("a"), (-F.col("accuracy")).alias("b"), *keys)).alias("z"))
    return best.select("lang", *(F.col(f"z.{k}").alias(k) for k in keys), (-F.col("z.a")).alias("err"), (-F.col("z.b")).alias("accuracy"))
