"""Where operators of this subpackage put shared tables, and how wide they deal rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``. Where that is unset a local session (tests) takes a temporary folder; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif context.master.startswith("local"):
            base = tempfile.mkdtemp(prefix="lexweave-")
            context.setCheckpointDir(base)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base.rstrip('/')}/lexweave-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of whole texts hold at most ``rows`` of them from now on in this session: a batch is in memory several times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(key))
    if not 0 < held <= rows:
        spark.conf.set(key, str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes up to which a set of blocks is broadcast.
SMALL = 8 << 20


def beside(rows: DataFrame, key: str, blocks: DataFrame, size: int) -> DataFrame:
    """Every row beside every block, a pair a row. ``size``: the blocks' bytes, as counted.

    Up to SMALL bytes the blocks are broadcast. Beyond, rows are dealt to as many
    groups as there are shuffle partitions by a hash of ``key``, and each group
    gets all blocks by a shuffle. Column ``g`` is the group.
    """
    groups = 1 if size <= SMALL else partitions(rows.sparkSession)
    dealt = rows.withColumn("g", F.pmod(F.xxhash64(key), F.lit(groups)))
    every = blocks.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    return dealt.join(F.broadcast(every) if groups == 1 else every.hint("merge"), "g")
