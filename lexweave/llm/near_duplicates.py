"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text's shingles are runs of five words; a shingle weighs its count in the
text times an inverse document frequency. Consistent weighted samples agree
between two texts with a probability equal to their weighted Jaccard
similarity; they are banded, texts in one bucket are compared with its leader
first, then, where it still holds several components, each with every one of
another component. Every link is verified by the weighted Jaccard similarity
of the whole texts. Linked texts form classes.

The inverse document frequency is flat below one document in a hundred: only
the frequent shingles need counts. Such a shingle is at least that frequent in
one batch of documents, so a first pass names the candidates and a second
counts them exactly over all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import bounded_batches, stored
from .words import column, doc_slices, hash_windows, hash_words, mix, whole

_U = np.uint64
_RNG = np.random.RandomState(20240)
_N = 1 << 16
_R = _RNG.gamma(2, 1, _N)
_LN_C = np.log(_RNG.gamma(2, 1, _N))
_BETA = _RNG.uniform(0, 1, _N)
#: Join sides with more rows are not broadcast.
BROADCAST_ROWS = 500_000
#: More candidates for frequent shingles are not broadcast but joined: 8 bytes each.
BROADCAST_SHINGLES = 2_000_000
#: Documents or shingles of a group that is counted by itself, and documents under which its counts are sent on: from there on one document alone makes no candidate at a share of 1 %.
GROUP_DOCS, GROUP_SHINGLES, LEAST_DOCS = 4000, 4_000_000, 200
#: Pairs with one leader that one task compares.
LEADER_PAIRS = 500
#: Bytes of text of a block of a bucket; every two blocks of it are compared in one task.
BLOCK_BYTES = 1 << 20


def shingle_counts(texts, size: int):
    """Yield (first document, number of documents, document, shingle, count) of slices of ``texts``; sorted by document and shingle."""
    data, offs = column(texts)
    for i, j in doc_slices(offs):
        w, _, _, first = hash_words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        h = hash_windows(w, size)
        fits, doc = whole(first, size, len(h))
        h, doc = h[fits], doc[fits]
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))) if len(h) else np.zeros(0, np.int64)
        yield i, j - i, doc[new], h[new], np.diff(np.concatenate((new, [len(h)])))


def _flushed(batches, size: int):
    """Yield (distinct shingles, documents that have each, documents) of groups of documents, cut by documents and shingles held."""
    held, n, m = [], 0, 0
    for b in batches:
        for _, docs, _, h, _ in shingle_counts(b.column(0), size):
            held.append(h)
            n, m = n + docs, m + len(h)
            if n >= GROUP_DOCS or m >= GROUP_SHINGLES:
                yield *np.unique(np.concatenate(held), return_counts=True), n
                held, n, m = [], 0, 0
    if n:
        yield *np.unique(np.concatenate(held), return_counts=True), n


def frequent_shingles(docs: DataFrame, size: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in at least ``share`` of the documents, and that part of them each is in.

    At most (mean shingles of a document) / ``share`` of them exist, and no more
    come to the driver. A frequent shingle is as frequent in one of any groups
    that the documents are cut into. Groups within a task name their candidates;
    those of few documents, in which all would be candidates, send their counts
    and are one group over all tasks. Candidates are then counted in all
    documents, by a broadcast if they are few enough, else by a join.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"))

    def local(batches):
        """(s, null) candidates; (s, n) counts and (null, n) documents of small groups."""
        for h, c, n in _flushed(batches, size):
            if n >= LEAST_DOCS:
                h = h[c >= share * n]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.nulls(len(h), pa.int64())], ["s", "n"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c, pa.int64())], ["s", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n], pa.int64())], ["s", "n"])

    seen = stored(texts.mapInArrow(local, "s long, n long"), "candidates")
    rest = seen.where("s is null").agg(F.sum("n")).first()[0] or 0
    small = seen.where("s is not null and n is not null").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= share * rest)
    names = stored(seen.where("s is not null and n is null").select("s").unionByName(small.select("s")).distinct(), "candidates")
    total = docs.count()
    if names.count() <= BROADCAST_SHINGLES:
        wanted = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in names.toLocalIterator()], np.int64).view(_U)))

        def count(batches):
            keys = wanted.value
            met = np.zeros(len(keys), np.int64)
            if len(keys):
                for b in batches:
                    for _, _, _, h, _ in shingle_counts(b.column(0), size):
                        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                        met += np.bincount(at[keys[at] == h], minlength=len(keys))
            some = np.flatnonzero(met)
            yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(met[some])], ["s", "n"])

        counts = texts.mapInArrow(count, "s long, n long")
    else:

        def every(batches):
            for h, c, _ in _flushed(batches, size):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c, pa.int64())], ["s", "n"])

        counts = texts.mapInArrow(every, "s long, n long").join(names, "s")
    rows = counts.groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= share * total).collect()
    keys = np.array([r[0] for r in rows], np.int64).view(_U)
    order = np.argsort(keys)
    return keys[order], np.array([r[1] for r in rows], float)[order] / max(total, 1)


class Weights:
    """Weight of a shingle: its count times 1 + ln(1/f) / ln(1/share), f its document frequency or ``share`` if that is more."""

    def __init__(self, keys: np.ndarray, frequency: np.ndarray, share: float):
        self.keys, self.idf = keys, 1 + np.log(1 / np.clip(frequency, share, 1)) / np.log(1 / share)

    def of(self, h: np.ndarray, count: np.ndarray) -> np.ndarray:
        idf = np.full(len(h), 2.0)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            idf[hit] = self.idf[at[hit]]
        return idf * count


def _draw(weight, at):
    """(ordered bits of ln a, t) of improved consistent weighted sampling, for random variates number ``at``."""
    r = _R[at]
    t = np.floor(np.log(weight) / r + _BETA[at])
    bits = (_LN_C[at] - r * (t - _BETA[at]) - r).astype(np.float32).view(np.uint32)
    bits = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))
    return bits.astype(_U) << _U(32), t.astype(np.int64).astype(_U) * _U(0x9E3779B9)


_PLAIN = _draw(np.full(_N, 2.0), np.arange(_N))


def samples(h: np.ndarray, weight: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """``n`` samples (32-bit names of a shingle and level) of each document; ``start``: its first shingle; none may be empty."""
    out = np.empty((len(start), n), np.uint32)
    odd = np.flatnonzero(weight != 2.0)
    for i in range(n):
        k = h * _U((0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF)
        k ^= k >> _U(29)
        at = (k >> _U(11)) & _U(_N - 1)
        a, t = _PLAIN[0][at], _PLAIN[1][at]
        if len(odd):
            a[odd], t[odd] = _draw(weight[odd], at[odd])
        k += t
        k &= _U(0xFFFFFFFF)
        k |= a
        out[:, i] = np.minimum.reduceat(k, start) & _U(0xFFFFFFFF)
    return out


def band_keys(docs: DataFrame, weights: Weights, size: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, copy`` (hash of the text; null without words) and ``keys`` (one a band; none if shorter than a shingle)."""
    b = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            keys = np.zeros((batch.num_rows, bands), np.int64)
            some = np.zeros(batch.num_rows, bool)
            for i, _, doc, h, count in shingle_counts(batch.column(2), size):
                if len(h):
                    start = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                    s = samples(h, b.value.of(h, count), start, bands * rows).astype(_U).reshape(len(start), bands, rows)
                    k = np.broadcast_to(np.arange(1, bands + 1, dtype=_U), s.shape[:2]).copy()
                    for r in range(rows):
                        k = mix(k * _U(0x9E3779B97F4A7C15) + s[:, :, r])
                    keys[doc[start] + i] = k.view(np.int64)
                    some[doc[start] + i] = True
            cuts = np.concatenate(([0], np.cumsum(some * bands))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(keys[some].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["doc_id", "copy", "keys"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.md5(text)).alias("copy"), text.alias("text")).mapInArrow(run, "doc_id long, copy string, keys array<long>")


def weighted_sets(texts, weights: Weights, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Shingles and their weights of each text."""
    out = []
    for _, n, doc, h, count in shingle_counts(texts, size):
        w = weights.of(h, count)
        cut = np.searchsorted(doc, np.arange(n + 1))
        out += [(h[x:y], w[x:y]) for x, y in zip(cut[:-1], cut[1:])]
    return out


def weighted_jaccard(a, b, weights: Weights, size: int) -> np.ndarray:
    """Similarity of each text of ``a`` with the one of ``b`` in its place."""
    result = []
    for (x, v), (y, w) in zip(weighted_sets(a, weights, size), weighted_sets(b, weights, size)):
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        least = np.minimum(v[i], w[j]).sum()
        total = v.sum() + w.sum() - least
        result.append(least / total if total else 0.0)
    return np.array(result)


def _bounded(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _linked(pairs: DataFrame, docs: DataFrame, weights, size: int, threshold: float) -> DataFrame:
    """The links (a, b) among ``pairs`` (leader, node) of at least ``threshold`` similarity.

    Joins deal each pair with both texts to some task; the text of a leader of
    many pairs goes to as many tasks as they fill.
    """
    nodes = pairs.select(F.col("leader").alias("node")).unionByName(pairs.select("node")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")).join(_bounded(stored(nodes, "nodes")), "node", "left_semi")
    texts = stored(texts.groupBy("node").agg(F.min("text").alias("text")), "texts")
    parts = stored(pairs.groupBy("leader").agg(F.ceil(F.count("*") / LEADER_PAIRS).cast("int").alias("parts")), "leaders")
    leading = texts.withColumnRenamed("node", "leader").join(parts, "leader").withColumn("part", F.explode(F.sequence(F.lit(1), "parts"))).select("leader", "part", F.col("text").alias("tl"))
    both = pairs.join(parts, "leader").withColumn("part", (F.pmod(F.xxhash64("node"), "parts") + 1).cast("int")).drop("parts").join(texts, "node").join(leading, ["leader", "part"])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                x = batch.slice(i, 500)
                ok = pa.array(weighted_jaccard(x.column(2), x.column(3), weights.value, size) >= threshold)
                yield pa.RecordBatch.from_arrays([x.column(0).filter(ok), x.column(1).filter(ok)], ["a", "b"])

    return both.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b"), "tl", "text").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node that each node of ``edges`` (a, b) is connected with.

    Each round takes the smallest label among neighbours and then that label's
    own label; it ends with a round that changes nothing.
    """
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = stored(step.join(jump, "label").select("node", "was", F.least("label", "next").alias("label")), "labels")
        moved = new.where("was <> label").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``buckets`` (key, node), with their ``label``, whose bucket holds nodes of several components."""
    placed = buckets.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    keys = placed.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    return placed.join(keys, "key").select("key", "node", "label")


def links_between(sets: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, cut: int, threshold: float) -> list[tuple[int, int]]:
    """Pairs (x, y) of ``sets`` of at least ``threshold`` similarity that connect all ``labels`` such pairs connect.

    Pairs have ``x`` before ``cut`` and ``y`` from it on; a ``cut`` of 0 means
    all pairs. No set may be empty. A pair that labels or earlier links connect is not compared.
    """
    sizes = np.array([len(h) for h, _ in sets])
    start = np.cumsum(sizes) - sizes
    names, at = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
    weight = np.concatenate([w for _, w in sets])
    total = np.add.reduceat(weight, start)
    own, labels, out = np.zeros(len(names)), labels.copy(), []
    for x in range(cut or len(sets) - 1):
        first = cut or x + 1
        if (labels[first:] == labels[x]).all():
            continue
        mine = slice(start[x], start[x] + sizes[x])
        own[at[mine]] = weight[mine]
        rest = start[first]
        least = np.add.reduceat(np.minimum(own[at[rest:]], weight[rest:]), start[first:] - rest)
        own[at[mine]] = 0
        for y in first + np.flatnonzero(least / (total[x] + total[first:] - least) >= threshold):
            if labels[x] != labels[y]:
                out.append((x, int(y)))
                labels[labels == labels[y]] = labels[x]
    return out


def _linked_in_buckets(mixed: DataFrame, docs: DataFrame, weights, size: int, threshold: float) -> DataFrame:
    """Links (a, b) of at least ``threshold`` among ``mixed`` (key, node, label): every two nodes of a bucket and different labels are compared, or connected by links found there.

    A bucket is cut into blocks by a hash of the node: the nodes of its largest
    class, which need no comparison with each other, and the rest. Every block
    of the rest goes with every block to some task, so no task holds more than
    two blocks, and work follows the size of the class times that of the rest.
    """
    nodes = stored(mixed.select("node").distinct(), "nodes")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")).join(_bounded(nodes), "node", "left_semi")
    texts = stored(texts.groupBy("node").agg(F.min("text").alias("text")), "texts")
    sized = mixed.join(texts.select("node", F.octet_length("text").alias("bytes")), "node")
    by_label = sized.groupBy("key", "label").agg(F.sum("bytes").alias("bytes"))
    blocks = by_label.groupBy("key").agg(F.max_by("label", F.struct("bytes", "label")).alias("main"), F.max("bytes").alias("most"), F.sum("bytes").alias("all"))
    fits = F.col("all") <= BLOCK_BYTES
    side, main = (F.ceil(c / BLOCK_BYTES).cast("int") for c in (F.col("all") - F.col("most"), F.col("most")))
    blocks = blocks.select("key", "main", F.when(fits, 1).otherwise(side).alias("side"), F.when(fits, 0).otherwise(main).alias("more"))
    dealt = sized.join(blocks, "key").withColumn("in_main", (F.col("label") == F.col("main")) & (F.col("more") > 0))
    dealt = dealt.withColumn("own", F.when(F.col("in_main"), F.col("side") + F.pmod(F.xxhash64("node"), "more")).otherwise(F.pmod(F.xxhash64("node"), "side")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("side") - 1 + F.when(F.col("in_main"), 0).otherwise(F.col("more")))))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "label")
    whole_texts = dealt.join(texts, "node").select("key", "i", "j", "own", "node", "label", "text")
    groups = whole_texts.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "own", "node")

    def found(rows):
        i, j = rows[0][0][1:]
        cut = sum(own == i for _, own, *_ in rows) if i < j else 0
        if len(rows) < 2 or cut == len(rows) or i < j and not cut:
            return []
        _, labels = np.unique([r[3] for r in rows], return_inverse=True)
        pairs = links_between([r[4] for r in rows], labels, cut, threshold)
        return [sorted((rows[x][2], rows[y][2])) for x, y in pairs]

    def run(batches):
        held, links = [], []
        for batch in batches:
            key, i, j, own, node, label = (batch.column(k).to_pylist() for k in range(6))
            sets = weighted_sets(batch.column(6), weights.value, size)
            for r in zip(zip(key, i, j), own, node, label, sets):
                if held and held[0][0] != r[0]:
                    links += found(held)
                    held = []
                held.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])
            links = []
        if held:
            links = found(held)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return groups.mapInArrow(run, "a long, b long")


def classes(
    docs: DataFrame,
    shingle: int = 5,
    threshold: float = 0.8,
    bands: int = 16,
    rows: int = 4,
    share: float = 0.01,
) -> DataFrame:
    """``doc_id, class_id`` of each row of ``docs`` (``doc_id, text``; other columns are not read).

    ``class_id`` is the smallest ``doc_id`` of the documents that equal texts
    and links of at least ``threshold`` connect. A text without words (null
    ones too) is a class of its own; one of fewer than ``shingle`` words has
    only equal texts in its class; a null ``doc_id`` takes part with none and
    has a null class. Rows of equal ``doc_id`` should have equal texts; else
    the smallest text stands for them. An empty table gives no rows.

    Equal texts are one node. First every node of a bucket is compared with its
    leader, the node with the largest buckets in all, which is near the middle
    of a group of copies. That only saves comparisons: in the buckets that hold
    several classes after it, all texts of different classes are compared, so
    no two texts that share a bucket stay apart without a comparison.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    weights = Weights(*frequent_shingles(docs, shingle, share), share)
    held = docs.sparkSession.sparkContext.broadcast(weights)
    signed = stored(band_keys(docs, weights, shingle, bands, rows), "bands")
    nodes = stored(signed.where("doc_id is not null and copy is not null").groupBy("copy").agg(F.min(F.struct("doc_id", "keys")).alias("m")).select("copy", F.col("m.doc_id").alias("node"), F.col("m.keys").alias("keys")), "nodes")
    members = nodes.where(F.size("keys") > 0).select("node", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = stored(members.join(shared, "key"), "buckets")
    degree = buckets.groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = buckets.join(degree, "node").withColumn("rank", F.struct(-F.col("degree"), F.col("node")))
    leaders = ranked.groupBy("key").agg(F.min("rank").alias("first")).select("key", F.col("first.node").alias("leader"))
    met = stored(ranked.select("key", "node").join(leaders, "key").where("node <> leader").select("leader", "node").distinct(), "pairs")
    edges = stored(_linked(met, docs, held, shingle, threshold), "links")
    labels = components(edges)
    mixed = stored(_mixed(buckets, labels), "mixed")
    if mixed.limit(1).count():
        labels = components(stored(edges.unionByName(_linked_in_buckets(mixed, docs, held, shingle, threshold)), "links"))

    # Only equal or linked texts need their class looked up.
    named = stored(nodes.join(labels, "node", "left").select("copy", F.coalesce("label", "node").alias("class_id")), "classes")
    plain = signed.select("doc_id", "copy")
    return plain.join(named, "copy", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose document is the smallest of its class; rows without ``doc_id`` stay."""
    gone = stored(classes(docs, **options).where("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct(), "copies")
    return docs.join(_bounded(gone), F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
