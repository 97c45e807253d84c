"""The training-corpus pipeline: documents to packed sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``docs``, whatever these are called. A null text goes
with the first stage; a null or repeated ``doc_id`` is a document like others;
an empty table passes all stages and gives no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import decontamination, language_id, near_duplicates, packing, substring_dedup
from lexweave.llm.runtime import shared_dir

#: A language below this posterior is no decision.
MIN_LANGUAGE_SCORE = 0.5
#: Pieces of a generation that a worker's tokenizer remembers: less than by default, for the workers hold what earlier stages left as well.
CACHED_PIECES = 120_000


def _beside(docs: DataFrame, needed: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``stage`` makes of ``docs``, with the columns of ``docs``: those not ``needed`` pass under names that no operator uses, so that none is overwritten."""
    others = {c: f"__other_{i}" for i, c in enumerate(docs.columns) if c not in needed}
    made = stage(docs.withColumnsRenamed(others))
    return made.select(*(F.col(others.get(c, c)).alias(c) for c in docs.columns))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text is null, has no letter or has no language of a posterior over MIN_LANGUAGE_SCORE."""
    def stage(d):
        found = language_id.identify(d, language_id.train(d))
        return found.where((F.col("lang_pred") != "und") & (F.col("lang_score") > MIN_LANGUAGE_SCORE))

    return _beside(docs, ("doc_id", "text", "lang"), stage)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of near-duplicates."""
    return _beside(docs, ("doc_id", "text"), near_duplicates.deduplicate)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts windows of 13 words that a document with a smaller id has too; texts that lose nothing stay as they are, and ``n_chars`` follows."""
    def stage(d):
        kept = substring_dedup.substring_dedup(d, keep_layout=True)
        if "n_chars" in d.columns:
            kind = d.schema["n_chars"].dataType
            kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
        return kept

    return _beside(docs, ("doc_id", "text", "n_chars"), stage)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of ``benchmark``."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _beside(docs, ("doc_id", "text"), lambda d: decontamination.decontaminate(d, items))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, mixed by source."""
    return packing.pack(docs, cache_size=CACHED_PIECES)


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Language probabilities, sampled similarities and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; every stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
