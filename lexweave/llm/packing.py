"""Mixture-controlled packing of documents into token sequences.

Documents queue by source. A deficit round robin fills each window (one
sequence) towards target token shares: every window credits each source with
its share of the window, the source with the largest credit is served next and
pays for its tokens, and what is left over is carried to the next window. The
corpus is dealt into parts of bounded size that run apart; a part starts from
the credits that all parts before it leave in total, so deficits carry across
partitions as well.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokenization
from .runtime import bounded_batches, stored

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
_NO_SOURCE = "\0"


def encoded(docs: DataFrame, tokenizer: str, end_id: int, cache_size: int = tokenization.CACHE_SIZE) -> DataFrame:
    """``doc_id, source, salt, n_tokens, ids`` of each row; ids are little-endian, in two bytes each if all fit, else in four. ``salt`` differs for every row."""
    kept = [F.col(c).cast(t).alias(c) for c, t in (("doc_id", "long"), ("source", "string"), ("text", "string"))]

    def encode(batches):
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() << 33
        enc = tokenization.encoder(tokenizer, cache_size)
        narrow = enc.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for i in range(0, b.num_rows, 512):
                some = b.slice(i, 512)
                ids = [x + end for x in enc.encode_all(some.column(2).to_pylist())]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                if narrow:
                    ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
                salts = np.arange(salt, salt + len(ids))
                salt += len(ids)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1).fill_null(_NO_SOURCE), pa.array(salts), pa.array(sizes), pa.array(ids, pa.binary())], ["doc_id", "source", "salt", "n_tokens", "ids"])

    return docs.select(*kept).mapInArrow(encode, "doc_id long, source string, salt long, n_tokens long, ids binary")


def fill(queues: dict[str, deque], shares: dict[str, float], credits: dict[str, float], size: int):
    """Yield (document, start, length, sequence, offset) until the queues are empty.

    ``queues``: per source, (document, tokens) pairs. All sequences hold ``size``
    tokens but the last few, whose lengths are falling powers of two, so nothing
    needs padding. A document is cut only where a sequence ends.
    """
    names = sorted(queues)
    left = np.array([sum(n for _, n in queues[s]) for s in names], np.int64)
    share = np.array([shares.get(s, 0.0) for s in names])
    credit = np.array([credits.get(s, 0.0) for s in names])
    credit[left == 0] = -np.inf
    total, sequence, started = int(left.sum()), 0, [0] * len(names)
    live = left > 0
    norm = share[live].sum()
    while total:
        room = size if total >= size else 1 << (total.bit_length() - 1)
        credit[live] += room * (share[live] / norm if norm > 0 else 1 / live.sum())
        offset = 0
        while offset < room:
            s = int(np.argmax(credit))
            doc, n = queues[names[s]][0]
            take = min(room - offset, n - started[s])
            yield doc, started[s], take, sequence, offset
            offset += take
            credit[s] -= take
            started[s] += take
            left[s] -= take
            if started[s] == n:
                queues[names[s]].popleft()
                started[s] = 0
                if not left[s]:
                    credit[s] = -np.inf
                    live[s] = False
                    norm = share[live].sum()
        total -= room
        sequence += 1


def pack(
    docs: DataFrame,
    sequence_tokens: int = 1024,
    end_id: int = 0,
    targets: dict[str, float] | None = None,
    tokenizer: str | None = None,
    part_tokens: int = 4 << 20,
    cache_size: int = tokenization.CACHE_SIZE,
) -> DataFrame:
    """Pieces (see PIECES) of ``docs`` (``doc_id, text, source``; other columns are not read).

    ``targets``: token share of each source (a missing one gets what others
    leave over); the corpus's own shares if not given, which exhaust all queues
    together. Null and empty texts are documents of the end id alone; a null
    source has a queue of its own; rows of equal ``doc_id`` are separate
    documents. ``sequence_id`` is the part's number times 2^32 plus the
    sequence's in its part. An empty table gives no pieces. ``cache_size``
    bounds what a worker remembers of pieces; the result does not depend on it.
    """
    bounded_batches(docs.sparkSession)
    rows = stored(encoded(docs, tokenizer or tokenization.default_path(), end_id, cache_size), "ids")
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    n = max(1, -(-total // part_tokens))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("salt"), F.lit(n)).cast("int"))
    cells = rows.groupBy("part", "source").agg(F.sum("n_tokens").alias("tokens"))
    grid = cells.groupBy("part").agg(F.sum("tokens").alias("all"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("all", F.coalesce(F.sum("all").over(before), F.lit(0)))
    own = Window.partitionBy("source")
    if targets is None:
        share = F.sum("tokens").over(own) / F.lit(max(total, 1))
    else:
        scale = sum(targets.values())
        share = F.coalesce(F.create_map(*(F.lit(x) for s, v in targets.items() for x in (s, v / scale)))[F.col("source")], F.lit(0.0)) if targets else F.lit(0.0)
    served = F.coalesce(F.sum("tokens").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = cells.withColumns({"share": share, "served": served}).join(grid, "part")
    heads = heads.select("part", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), "source", F.lit(None).cast("long").alias("salt"), F.lit(None).cast("long").alias("n_tokens"), F.lit(None).cast("binary").alias("ids"), "share", (F.col("share") * F.col("all") - F.col("served")).alias("credit"))
    body = rows.select("part", F.lit(1).alias("kind"), "doc_id", "source", "salt", "n_tokens", "ids", F.lit(None).cast("double").alias("share"), F.lit(None).cast("double").alias("credit"))
    dealt = heads.unionByName(body).repartitionById(n, F.col("part")).sortWithinPartitions("part", "kind", "doc_id", "salt")  # a part is a task's work

    def emit(part, shares, credits, queues):
        out = [[] for _ in range(8)]
        for (doc, ids, source), start, length, sequence, offset in fill(queues, shares, credits, sequence_tokens):
            crc = zlib.crc32(ids[start : start + length].astype("<u4"))
            for col, v in zip(out, (doc, start, length, crc, len(ids), (part << 32) + sequence, offset, None if source == _NO_SOURCE else source)):
                col.append(v)
        names = [x.split()[0] for x in PIECES.split(", ")]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:7]), pa.array(out[7], pa.string())], names)

    def run(batches):
        now, shares, credits, queues = None, {}, {}, {}
        for b in batches:
            for part, kind, doc, source, size, ids, share, credit in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 3, 5, 6, 7, 8))):
                if part != now:
                    if queues:
                        yield from emit(now, shares, credits, queues)
                    now, shares, credits, queues = part, {}, {}, {}
                if kind == 0:
                    shares[source], credits[source] = share, credit
                else:
                    queues.setdefault(source, deque()).append(((doc, np.frombuffer(ids, f"<u{len(ids) // size}"), source), size))
        if queues:
            yield from emit(now, shares, credits, queues)

    return dealt.mapInArrow(run, PIECES)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
