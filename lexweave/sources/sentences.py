"""Sentences and tokens: schemas, readers, writers.

A sentence is ``raw array<string>``, ``norm array<string>`` (may hold nulls or
be null), ``lang`` and an explicit ``sent_id``. A token is one position of it.
"""

from __future__ import annotations

import json
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SENTENCES = "sent_id long, lang string, raw array<string>, norm array<string>"
BOS, EOS = "<BOS>", "<EOS>"

#: The accented letters of the document corpus and their base letters.
ACCENTED = "ÄÇÈÉÊÍÑÓÖÜäçèéêíñóöü"
BASE = "ACEEEINOOUaceeeinoou"


def read_sentences(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """Parquet sentences with the declared schema; ``fallback`` is read where ``path`` does not exist."""
    from pyspark.errors import AnalysisException

    from lexweave.sources.artifacts import missing_path

    try:
        return spark.read.schema(SENTENCES).parquet(path)
    except AnalysisException as error:
        if fallback is None or not missing_path(error):
            raise
        return spark.read.schema(SENTENCES).parquet(fallback)


def of_language(rows: DataFrame, *languages: str) -> DataFrame:
    """The rows of some languages; on a table that is partitioned by ``lang`` no other is read."""
    return rows.where(F.col("lang").isin(*languages))


#: Marks beyond both ends of a sentence.
SENTINELS = {"marks": (BOS, EOS), "anchors": ("^", "$"), "empty": ("", "")}


def with_sentinels(rows: DataFrame, kind: str) -> DataFrame:
    """Neighbour columns with other marks beyond the ends: ``anchors`` or ``empty``."""
    first, last = SENTINELS[kind]
    swap = lambda c: F.when(F.col(c) == BOS, first).when(F.col(c) == EOS, last).otherwise(F.col(c))
    return rows.withColumns({c: swap(c) for c in ("prev", "next", "prev2", "next2") if c in rows.columns})


def well_formed(sentences: DataFrame) -> DataFrame:
    """Sentences with words and as many replacements as words."""
    return sentences.where((F.size("raw") > 0) & (F.size("raw") == F.size("norm")))


def gold(raw: Column, norm: Column, policy: str = "N1") -> Column:
    """The replacement that counts where gold is missing. N1, N4: null is the word; N2: null and '' are the word; N3: null is ''; N5: null stays."""
    return {
        "N1": F.coalesce(norm, raw),
        "N2": F.coalesce(F.nullif(norm, F.lit("")), raw),
        "N3": F.coalesce(norm, F.lit("")),
        "N4": F.coalesce(norm, raw),
        "N5": norm,
    }[policy]


def shifted(words: Column, by: int, edge: str) -> Column:
    """``words`` with each element replaced by its neighbour ``by`` places on; ``edge`` beyond the ends."""
    pad = F.array_repeat(F.lit(edge), F.least(F.lit(abs(by)), F.size(words)))
    if by < 0:
        return F.concat(pad, F.slice(words, 1, F.greatest(F.size(words) + by, F.lit(0))))
    return F.concat(F.slice(words, by + 1, F.greatest(F.size(words) - by, F.lit(0))), pad)


def neighbour(words: str, pos: str, size: str, by: int, edge: str) -> Column:
    """The word ``by`` places from ``pos``; ``edge`` beyond the ends. Taken by its place, so that a plan that does not ask for it does not work it out."""
    at = F.col(pos) + by
    return F.when(at < 0 if by < 0 else at >= F.col(size), edge).otherwise(F.get(words, at))


def tokens(sentences: DataFrame, policy: str = "N1") -> DataFrame:
    """One row a word: ``sent_id, lang, pos, size, raw, norm, prev, next, prev2, next2`` and other columns.

    Neighbours come from the array, so no shuffle is needed. Words beyond the
    shorter of both arrays are cut; a null ``norm`` is one of nulls.
    """
    n = F.when(F.col("norm").isNull(), F.size("raw")).otherwise(F.least(F.size("raw"), F.size("norm")))
    rest = [c for c in sentences.columns if c not in ("raw", "norm")]
    s = sentences.select(*rest, F.col("raw").alias("__raw"), F.col("norm").alias("__norm"), n.alias("size"))
    # An array of no words has no rows. A filter on its size would be pushed down and make the arrays once more.
    s = s.select(*rest, "size", "__raw", "__norm", F.posexplode(F.slice("__raw", 1, F.greatest(F.col("size"), F.lit(0)))).alias("pos", "raw"))
    near = {"prev": (-1, BOS), "next": (1, EOS), "prev2": (-2, BOS), "next2": (2, EOS)}
    s = s.select(*rest, "size", "pos", "raw", F.get("__norm", F.col("pos")).alias("norm"), *(neighbour("__raw", "pos", "size", by, edge).alias(c) for c, (by, edge) in near.items()))
    return s.withColumn("norm", gold(F.col("raw"), F.col("norm"), policy))


def rebuilt(predictions: DataFrame) -> DataFrame:
    """``sent_id, lang, raw, pred`` with one array element a token, in order of ``pos``."""
    rows = predictions.groupBy("sent_id", "lang").agg(F.sort_array(F.collect_list(F.struct("pos", "raw", "pred"))).alias("z"))
    return rows.select("sent_id", "lang", F.col("z.raw").alias("raw"), F.col("z.pred").alias("pred"))


#: Bytes of a table that one task reads, and that one partition of an exchange stands for, at most.
SPLIT = 8 << 20


def bounded_tasks(spark: SparkSession, path: str) -> None:
    """Sets for the session that a task's share of ``path`` does not grow with it: partial sums over the words of a large split outgrow a task's memory and spill. Smaller splits and more partitions that are set stay."""
    from lexweave.sources.artifacts import bytes_below

    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")) > SPLIT:
        spark.conf.set("spark.sql.files.maxPartitionBytes", SPLIT)
    parts = bytes_below(spark, path) // SPLIT
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as sentences: gold is the white-space token, raw its lower-cased form without accents."""
    bounded_tasks(spark, f"{sf_dir}/documents.parquet")
    text = F.nullif(F.btrim("text", F.lit(" \t\n\x0b\f\r")), F.lit(""))  # what \s stands for
    words = lambda x: F.coalesce(F.split(x, r"\s+"), F.array().cast("array<string>"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("sent_id"), "lang", text.alias("text"))
    # Letters are replaced in the whole text, one kind after another: ``translate``, a word at a time, is most of the work.
    bare = reduce(lambda x, pair: F.replace(x, *map(F.lit, pair)), zip(ACCENTED[10:], BASE[10:]), F.lower("text"))
    return d.select("sent_id", "lang", words(bare).alias("raw"), words(F.col("text")).alias("norm"))


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of ``document_sentences`` with ``fold``, the fifth of the corpus that a sentence is in."""
    return tokens(document_sentences(spark, sf_dir)).withColumn("fold", F.pmod("sent_id", F.lit(5)))


def write_predictions(rows: DataFrame, path: str, name: str = "predictions.json") -> Path:
    """A ZIP with one JSON array of ``raw, pred, lang`` in order of ``sent_id``; rows are streamed, not collected."""
    target = Path(path)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z, z.open(name, "w") as f:
        f.write(b"[")
        for i, r in enumerate(rows.orderBy("sent_id").toLocalIterator()):
            f.write((", " if i else "").encode() + json.dumps({"raw": r["raw"], "pred": r["pred"], "lang": r["lang"]}, ensure_ascii=False).encode())
        f.write(b"]")
    return target


def read_predictions(spark: SparkSession, path: str, name: str = "predictions.json") -> DataFrame:
    """``sent_id, raw, pred, lang`` from a prediction ZIP or JSON file, whose one array is read on the driver, or from Parquet."""
    p = Path(path)
    if p.suffix == ".parquet":
        return spark.read.parquet(str(p))
    data = json.loads(zipfile.ZipFile(p).read(name) if p.suffix == ".zip" else p.read_bytes())
    return spark.createDataFrame([(i, x["raw"], x["pred"], x["lang"]) for i, x in enumerate(data)], "sent_id long, raw array<string>, pred array<string>, lang string")


def write_lines(sentences: DataFrame, path: str) -> None:
    """One line a sentence, words joined by a space, in files that keep the order of ``sent_id``."""
    sentences.orderBy("sent_id").select(F.concat_ws(" ", "raw").alias("value")).write.text(path)


def accept_lengths(predictions: DataFrame) -> DataFrame:
    """Predictions of another length than the words become copies of them."""
    return predictions.withColumn("pred", F.when(F.size("pred") == F.size("raw"), F.col("pred")).otherwise(F.col("raw")))


def order_mismatch(reference: DataFrame, predictions: DataFrame) -> DataFrame:
    """Sentences whose words differ between both, or that only one has."""
    r, p = reference.select("sent_id", F.col("raw").alias("ref_raw")), predictions.select("sent_id", F.col("raw").alias("pred_raw"))
    return r.join(p, "sent_id", "full").where(~F.col("ref_raw").eqNullSafe(F.col("pred_raw")))
