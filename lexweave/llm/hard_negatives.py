"""Hard-negative mining: rows of other labels that score nearly as high as an anchor's positives.

Scores are integer inner products. Vectors are rotated onto the principal axes
of a bounded sample; a rotation leaves products as they are, so the product
over the leading axes, with the product of both residual norms (and rounding
slack) to either side, bounds the score. Products over ever more axes are
accumulated for blocks of anchors and rows; pairs whose bound falls short of
what the anchor has found so far, or which lie beyond the wanted range, are
discarded early, and the rest is verified by integer products. How well the
sample fits decides the work, never the result.

Anchors, in blocks, meet all rows, in blocks: a few megabytes of anchors are
broadcast, more are shuffled to groups of rows (an equality join on the group),
so memory is that of two blocks and the best rows of the anchors that a task
has met.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import beside, bounded_batches, stored

BLOCK = 1024
_SLICE = 256  # rows of a block that are compared at once, so that bounds tighten soon
_HELD = 200_000  # anchors whose best rows a task holds
_LOWEST = np.iinfo(np.int64).min
_BLOCKS = "block long, size int, dims int, uids binary, ids binary, labels binary, parts binary"


def prepare(rows: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``uid, vec_id, label, parts``: components as ``floor(scale * x)``, written to the shared folder.

    Rows with a null ``vec_id``, ``label`` or vector, or with a null or
    non-finite component, take no part. Other columns are not read. Rows of
    equal ``vec_id`` are rows of their own; ``uid`` tells them apart.
    """
    x = F.col(vector)
    finite = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    return stored(kept.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("parts")), "vectors")


def principal_axes(rows: DataFrame, sample_rows: int = 4096) -> np.ndarray:
    """Orthonormal columns, the leading axis first, of at most ``sample_rows`` rows chosen by a hash of ``uid``."""
    sample = rows.orderBy(F.xxhash64("uid"), "uid").limit(sample_rows).select("parts").toPandas()["parts"].tolist()
    dims = max(map(len, sample), default=0)
    x = np.zeros((len(sample), dims))
    for i, v in enumerate(sample):
        x[i, : len(v)] = v
    return np.linalg.eigh(x.T @ x)[1][:, ::-1].copy() if dims else np.zeros((0, 0))


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows in blocks of at most BLOCK; shorter vectors of a block are filled up with zeros."""

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                some = b.slice(i, BLOCK)
                sizes = np.asarray(some.column(3).value_lengths(), np.int64)
                parts = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
                parts[np.arange(parts.shape[1]) < sizes[:, None]] = some.column(3).flatten().to_numpy(zero_copy_only=False)
                held = [np.ascontiguousarray(some.column(c).to_numpy(zero_copy_only=False), np.int64).tobytes() for c in range(3)] + [parts.tobytes()]
                columns = [pa.array([block], pa.int64()), pa.array([len(sizes)], pa.int32()), pa.array([parts.shape[1]], pa.int32()), *(pa.array([x], pa.binary()) for x in held)]
                yield pa.RecordBatch.from_arrays(columns, ["block", "size", "dims", "uids", "ids", "labels", "parts"])
                block += 1

    return rows.select("uid", "vec_id", "label", "parts").mapInArrow(run, _BLOCKS)


class Block:
    """Vectors with what bounds their products. ``axes``: rotation of the first components; what lies beyond counts as residual."""

    def __init__(self, row: dict, axes: np.ndarray):
        n, dims = row["size"], row["dims"]
        self.uid, self.id, self.label = (np.frombuffer(row[c], np.int64) for c in ("uids", "ids", "labels"))
        self.parts = np.frombuffer(row["parts"], np.int64).reshape(n, dims)
        x = self.parts.astype(float)
        self.norm = np.sqrt((x * x).sum(1))
        shared = min(dims, len(axes))
        self.turned = x[:, :shared] @ axes[:shared]
        #: relative error of a product over rotated components, generously
        self.rounding = 8 * (max(dims, len(axes)) + 8) ** 1.5 * np.finfo(float).eps

    def residual(self, r: int) -> np.ndarray:
        lead = self.turned[:, :r]
        return np.sqrt(np.maximum(0, self.norm**2 - (lead * lead).sum(1)) + self.rounding * self.norm**2)


def _stages(d: int) -> list[int]:
    return sorted({max(1, d // 8), max(1, d // 4), max(1, d // 2)}) if d else [0]


def survivors(a: Block, x: Block, rows: slice, allowed: np.ndarray, least: np.ndarray, most: np.ndarray | None = None):
    """Pairs (anchor, row) of ``allowed`` whose score may lie from ``least`` to ``most`` of the anchor, with their integer scores."""
    stages = _stages(a.turned.shape[1])
    slack = max(a.rounding, x.rounding) * np.outer(a.norm, x.norm[rows]) + 1e-6
    least = least.astype(float)[:, None]
    done, product = 0, np.zeros(allowed.shape)
    for r in stages:
        product += a.turned[:, done:r] @ x.turned[rows, done:r].T
        done = r
        room = np.outer(a.residual(r), x.residual(r)[rows]) + slack
        allowed &= product + room >= least
        if most is not None:
            allowed &= product - room <= most.astype(float)[:, None]
        if np.count_nonzero(allowed) * 16 < allowed.size:
            break
    i, j = np.nonzero(allowed)
    j = j + rows.start
    shared = min(a.parts.shape[1], x.parts.shape[1])
    score = np.empty(len(i), np.int64)
    for k in range(0, len(i), 1 << 15):
        part = slice(k, k + (1 << 15))
        score[part] = np.einsum("ij,ij->i", a.parts[i[part], :shared], x.parts[j[part], :shared])
    return i, j, score


class Best:
    """The best ``k`` rows of each of ``n`` queries: higher scores first, then smaller ids, then smaller uids."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), _LOWEST)
        self.id = np.zeros((n, k), np.int64)
        self.uid = np.full((n, k), -1)

    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, query: np.ndarray, score: np.ndarray, row_id: np.ndarray, uid: np.ndarray) -> None:
        keep = score >= self.score[query, -1]
        query, score, row_id, uid = query[keep], score[keep], row_id[keep], uid[keep]
        if not len(query):
            return
        touched = np.unique(query)
        own, slot = np.nonzero(self.uid[touched] >= 0)
        own = touched[own]
        query = np.concatenate((query, own))
        score = np.concatenate((score, self.score[own, slot]))
        row_id = np.concatenate((row_id, self.id[own, slot]))
        uid = np.concatenate((uid, self.uid[own, slot]))
        order = np.lexsort((uid, row_id, ~score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        top = rank < self.k
        query, rank, order = query[top], rank[top], order[top]
        self.score[touched], self.uid[touched] = _LOWEST, -1
        self.score[query, rank], self.id[query, rank], self.uid[query, rank] = score[order], row_id[order], uid[order]


def _grid(anchors: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """Every block of anchors beside every block of rows."""
    a, x = anchors.select(F.struct(*anchors.columns).alias("a")), rows.select("block", F.struct(*rows.columns).alias("x"))
    return beside(x, "block", a, size).select("a", "x")


def _size(anchors: DataFrame) -> int:
    return 8 * (anchors.agg(F.sum(F.size("parts") + 4)).first()[0] or 0)


def _search(grid: DataFrame, axes: np.ndarray, schema: str, begin, compare, emit) -> DataFrame:
    """Runs over a grid with the state of each block of anchors; states beyond a bound are emitted, and begun anew if the block comes again."""

    def run(batches):
        states: dict = {}
        last, block, held = None, None, 0
        for b in batches:
            for row in b.to_pylist():
                key = row["a"]["block"]
                if key not in states:
                    if held > _HELD:
                        for state in states.values():
                            yield emit(state)
                        states, held = {}, 0
                    states[key] = begin(row["a"], Block(row["a"], axes))
                    held += row["a"]["size"]
                if row["x"]["block"] != last:
                    last, block = row["x"]["block"], Block(row["x"], axes)
                for i in range(0, len(block.id), _SLICE):
                    compare(states[key], block, slice(i, min(i + _SLICE, len(block.id))))
        for state in states.values():
            yield emit(state)

    return grid.mapInArrow(run, schema)


def _ranked(found: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "row_id", "row_uid")
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def positives(anchors: DataFrame, rows: DataFrame, axes: np.ndarray, k: int = 5) -> DataFrame:
    """``block, at, anchor_id, row_id, row_uid, score, place``: the best ``k`` other rows of an anchor's label."""

    def begin(_, a):
        return a, Best(len(a.id), k)

    def compare(state, x, rows):
        a, best = state
        allowed = (a.label[:, None] == x.label[rows]) & (a.uid[:, None] != x.uid[rows])
        i, j, score = survivors(a, x, rows, allowed, best.least())
        best.add(i, score, x.id[j], x.uid[j])

    def emit(state):
        a, best = state
        i, slot = np.nonzero(best.uid >= 0)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (a.uid[i], a.id[i], best.id[i, slot], best.uid[i, slot], best.score[i, slot])], ["anchor_uid", "anchor_id", "row_id", "row_uid", "score"])

    found = _search(_grid(_blocks(anchors), _blocks(rows), _size(anchors)), axes, "anchor_uid long, anchor_id long, row_id long, row_uid long, score long", begin, compare, emit)
    return _ranked(found, ["anchor_uid"], k, "place")


def negatives(anchors: DataFrame, rows: DataFrame, found: DataFrame, axes: np.ndarray, k: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """The best ``k`` rows of other labels for each anchor and positive in ``found``: ``low * positive <= 100 * negative <= high * positive``."""
    asked = found.groupBy("anchor_uid").agg(F.sort_array(F.collect_list(F.struct("place", "score", F.col("row_id").alias("id")))).alias("asked"))
    asking = anchors.join(asked.withColumnRenamed("anchor_uid", "uid"), "uid")
    blocks = _asking_blocks(asking)

    def begin(row, a):
        q = np.frombuffer(row["asked"], np.int64).reshape(-1, 4)  # anchor, place, score, id
        floor, ceiling = -(-low * q[:, 2] // 100), high * q[:, 2] // 100
        return a, q, floor, ceiling, Best(len(q), k)

    def compare(state, x, rows):
        a, q, floor, ceiling, best = state
        want = np.maximum(floor, best.least())
        least, most = np.full(len(a.id), np.iinfo(np.int64).max), np.full(len(a.id), _LOWEST)
        open_ = floor <= ceiling
        np.minimum.at(least, q[open_, 0], want[open_])
        np.maximum.at(most, q[open_, 0], ceiling[open_])
        allowed = (a.label[:, None] != x.label[rows]) & (most > _LOWEST)[:, None]
        i, j, score = survivors(a, x, rows, allowed, least, most)
        if not len(i):
            return
        # each pair for each question of its anchor; questions of an anchor are neighbours
        first, n = np.searchsorted(q[:, 0], i), np.searchsorted(q[:, 0], i, "right")
        pair = np.repeat(np.arange(len(i)), n - first)
        query = np.arange(len(pair)) - np.repeat(np.cumsum(n - first) - (n - first), n - first) + first[pair]
        fits = (score[pair] >= want[query]) & (score[pair] <= ceiling[query])
        pair, query = pair[fits], query[fits]
        best.add(query, score[pair], x.id[j[pair]], x.uid[j[pair]])

    def emit(state):
        a, q, _, _, best = state
        i, slot = np.nonzero(best.uid >= 0)
        at = q[i, 0]
        values = (a.uid[at], a.id[at], q[i, 1], q[i, 3], q[i, 2], best.id[i, slot], best.uid[i, slot], best.score[i, slot])
        return pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["anchor_uid", "anchor_id", "place", "positive_id", "positive_score", "row_id", "row_uid", "score"])

    schema = "anchor_uid long, anchor_id long, place long, positive_id long, positive_score long, row_id long, row_uid long, score long"
    return _ranked(_search(_grid(blocks, _blocks(rows), _size(anchors)), axes, schema, begin, compare, emit), ["anchor_uid", "place"], k, "rank")


def _asking_blocks(asking: DataFrame) -> DataFrame:
    """Blocks of anchors with their questions: rows (anchor, place, positive's score, positive's id) as ``asked``."""

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                some = b.slice(i, BLOCK).to_pylist()
                dims = max(len(r["parts"]) for r in some)
                parts = np.zeros((len(some), dims), np.int64)
                for at, r in enumerate(some):
                    parts[at, : len(r["parts"])] = r["parts"]
                asked = np.array([(at, q["place"], q["score"], q["id"]) for at, r in enumerate(some) for q in r["asked"]], np.int64)
                held = [np.array([r[c] for r in some], np.int64).tobytes() for c in ("uid", "vec_id", "label")] + [parts.tobytes(), asked.tobytes()]
                columns = [pa.array([block], pa.int64()), pa.array([len(some)], pa.int32()), pa.array([dims], pa.int32()), *(pa.array([x], pa.binary()) for x in held)]
                yield pa.RecordBatch.from_arrays(columns, ["block", "size", "dims", "uids", "ids", "labels", "parts", "asked"])
                block += 1

    return asking.select("uid", "vec_id", "label", "parts", "asked").mapInArrow(run, _BLOCKS + ", asked binary")


def mine(rows: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, sample_rows: int = 4096) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows of ``prepare`` that ``anchor`` marks.

    An anchor's positives are its best ``n_positives`` other rows of its label;
    equal scores go by smaller ``vec_id``, repeated rows of one id by their
    place. Repeated anchors are anchors each. Components that a shorter vector
    lacks count as 0. Anchors without positives, positives without negatives in
    range and empty tables give no rows. Products are exact while they fit 64
    bits.
    """
    bounded_batches(rows.sparkSession, 4096)
    axes, anchors = principal_axes(rows, sample_rows), rows.where(anchor)
    found = stored(positives(anchors, rows, axes, n_positives), "positives")
    best = negatives(anchors, rows, found, axes, n_negatives, low, high)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(prepare(rows.withColumn("label", label)), F.col("vec_id") % 50 == 0)


OP11_SQL = """
with kept as (
  select row_number() over () as uid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as (
  select a.uid as anchor_uid, a.vec_id as anchor_id, r.uid, r.vec_id, a.label = r.label as same, cast(list_inner_product(a.v, r.v) as bigint) as score
  from kept a join kept r on a.uid <> r.uid
  where a.vec_id % 50 = 0
), pos as (
  select anchor_uid, anchor_id, uid as positive_uid, vec_id as positive_id, score as positive_score
  from scored where same
  qualify row_number() over (partition by anchor_uid order by score desc, vec_id, uid) <= 5
)
select p.anchor_id, p.positive_id,
       cast(row_number() over (partition by p.anchor_uid, p.positive_uid order by n.score desc, n.vec_id, n.uid) as integer) as rank,
       n.vec_id as negative_id, p.positive_score, n.score as negative_score
from pos p join scored n on n.anchor_uid = p.anchor_uid and not n.same and 50 * p.positive_score <= 100 * n.score and 100 * n.score <= 95 * p.positive_score
qualify row_number() over (partition by p.anchor_uid, p.positive_uid order by n.score desc, n.vec_id, n.uid) <= 3
"""
