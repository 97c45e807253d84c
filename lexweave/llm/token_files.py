"""Token-ID output: Parquet files of id lists, in ascending document order.

Layout of a file: ``part`` (index of the file's range of ids), ``doc_id``,
``local_start`` (ids of the file before this document), ``n_tokens`` and
``ids`` (list of int32). Ids are dictionary-encoded and bit-packed, the other
columns delta-encoded, row groups and pages are bounded, and the writer adds
page indexes; a reader of ``metadata()`` never touches the ids, and a filter on
``doc_id`` skips row groups and pages.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokenization
from .runtime import bounded_batches, partitions, shared_dir

SCHEMA = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("local_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), containsNull=False)),
    ]
)
_LISTS = pa.list_(pa.field("element", pa.int32(), nullable=False))


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = 2,
    n_files: int | None = None,
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    page_rows: int = 2000,
) -> None:
    """Encode ``docs`` (``doc_id``, ``text``; other columns are not read) into token files at ``path``.

    Every document's ids end in ``end_id``. Null and empty texts have that id
    only. Rows of equal ``doc_id`` are separate documents, ordered by text; a
    null ``doc_id`` comes first. An empty table gives a folder without rows.
    """
    tokenizer = tokenizer or tokenization.default_path()
    n = n_files or partitions(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches):
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        enc = tokenization.encoder(tokenizer)
        names = SCHEMA.names
        for b in batches:
            for i in range(0, b.num_rows, 512):
                some = b.slice(i, 512)
                ids = [x + end for x in enc.encode_all(some.column(1).to_pylist())]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                offs = np.concatenate(([0], np.cumsum(sizes)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), part, np.int32)),
                        some.column(0),
                        pa.array(start + offs[:-1]),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), np.int32)), type=_LISTS),
                    ],
                    names,
                )
                start += int(offs[-1])

    plain = {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "local_start", "n_tokens")}
    ordered.mapInArrow(encode, SCHEMA).write.options(
        **{
            "compression": "zstd",
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.block.size": str(row_group_bytes),
            "parquet.page.size": str(page_bytes),
            "parquet.page.row.count.limit": str(page_rows),
            "parquet.dictionary.page.size": str(1 << 20),
            **plain,
        }
    ).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """``part, doc_id, start, n_tokens``: ``start`` counts the ids of all documents before. Reads no ids."""
    return _with_start(spark, path).select("part", "doc_id", "start", "n_tokens")


def _with_start(spark: SparkSession, path: str) -> DataFrame:
    """Adds the ids in all files before; one row a file is broadcast, and files are as many as the writer was told to make."""
    files = read_token_files(spark, path)
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    from pyspark.sql import Window

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return files.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("local_start"))


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""

    def digest(batches):
        for b in batches:
            ids = b.column(3)
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            cuts = np.concatenate(([0], np.cumsum(np.asarray(ids.value_lengths().fill_null(0)))))
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _with_start(spark, path).select("doc_id", "start", "n_tokens", "ids").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return token_digest(spark, path)
