"""Ranked lexical search: exact top-k by a dual-sorted wavelet index.

Every shard of some megabytes of text holds, for each of its terms, the
documents that have it, highest impact first; all these lists in a row are the
sequence of a wavelet matrix over the shard's document numbers (numbered by
``doc_id``). A node of the matrix is a range of documents. A term's part of a
node is an interval whose first entry has the term's highest impact there, as
the matrix keeps the order of a list. So the intervals of an item's terms at a
node give an upper bound for every document below it, and at a leaf the score.
Nodes are taken best first, some at a time, and those whose bound falls short
of the item's k-th best score are left out: what remains is exact.

Terms are told by 64-bit hashes. The index is Parquet, a row for each shard:
lexicon, bit vectors and impacts; statistics of terms read the lexicon only.
Queries come in blocks, beside which Spark puts each shard: broadcast where
they are a few megabytes, else shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words
from .runtime import beside, bounded_batches, stored

SHARD_BYTES = 8 << 20
ITEMS = 256  # of a block of queries
_NODES = 48  # that are opened at once
_HELD = 100_000  # items whose best documents a task holds
_U = np.uint64
_INDEX = "shard long, n_docs int, levels int, docs binary, null_docs int, terms binary, starts binary, zeros binary, bits binary, impacts binary"


def _texts(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms with repeats."""

    def run(batches):
        for b in batches:
            data, offs = words.column(b.column(0))
            sep = words.TERM_SEP[data]
            head = ~sep
            head[1:] &= sep[:-1]
            inner = offs[:-1][offs[:-1] < len(data)]
            head[inner] = ~sep[inner]
            n = words.per_doc(head, offs)
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["n", "l"])

    sizes = _texts(docs, "doc_id").select("text").mapInArrow(run, "n long, l long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()
    return int(sizes[0]), int(sizes[1])


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term of weight 1 adds to the score of a document of ``n`` terms that has it ``tf`` times."""
    m = 75 + 25 * n * n_docs // max(n_terms, 1)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _postings(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Term, document and count of each pair of a document and its term; the number of terms of each document."""
    h, _, _, first = words.hash_terms(data, offs)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return h[at], doc[at], np.diff(np.append(at, len(h))), n


def _pack(bits: np.ndarray) -> np.ndarray:
    """Bits as 64-bit words, one word more than needed."""
    out = np.zeros(len(bits) // 64 + 1, "<u8")
    packed = np.packbits(bits, bitorder="little")
    out.view(np.uint8)[: len(packed)] = packed
    return out


def build_index(docs: DataFrame, n_docs: int, n_terms: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The shards of ``docs`` (``doc_id``, ``text``; other columns are not read), for a corpus of the size that ``corpus_size`` tells.

    Null and empty texts have no terms. Rows of equal ``doc_id`` are documents
    of their own; a null ``doc_id`` comes before all others. A document longer
    than ``shard_bytes`` has a shard to itself.
    """
    bounded_batches(docs.sparkSession, 1000)

    def shard(number: int, parts: list) -> pa.RecordBatch:
        sizes = [len(p[3]) for p in parts]
        base = np.cumsum([0, *sizes])
        term, tf = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
        doc = np.concatenate([p[1] + b for p, b in zip(parts, base)])
        n, ids = np.concatenate([p[3] for p in parts]), pa.concat_arrays([p[4] for p in parts])
        null = np.asarray(ids.is_null())
        ids = np.asarray(ids.fill_null(0), np.int64)
        order = np.lexsort((ids, ~null))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        value, seq = impact(tf, n[doc], n_docs, n_terms), rank[doc]
        by = np.lexsort((seq, -value, term))
        term, seq, value = term[by], seq[by].astype(np.int32), value[by].astype("<u4")
        starts = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        levels = max(1, int(len(ids) - 1).bit_length())
        bits, zeros = [], []
        for k in range(levels - 1, -1, -1):
            bit = (seq >> k) & 1 == 1
            order_ = np.concatenate((np.flatnonzero(~bit), np.flatnonzero(bit)))
            bits.append(_pack(bit))
            zeros.append(int(len(bit) - np.count_nonzero(bit)))
            seq, value = seq[order_], value[order_]
        held = [ids[order].tobytes(), int(null.sum()), term[starts].astype("<u8").tobytes(), np.append(starts, len(term)).astype("<i8").tobytes(), np.array(zeros, "<i8").tobytes(), np.concatenate(bits).tobytes(), value.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (number, len(ids))] + [pa.array([levels], pa.int32())] + [pa.array([x]) for x in held], _names)

    _names = [c.split()[0] for c in _INDEX.split(", ")]
    _kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), *[pa.binary()] * 5]

    def run(batches):
        from pyspark import TaskContext

        number, parts, size = TaskContext.get().partitionId() << 33, [], 0
        for b in batches:
            data, offs = words.column(b.column(1))
            for i, j in words.doc_slices(offs):
                h, doc, tf, n = _postings(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                parts.append((h, doc, tf, n, b.column(0).slice(i, j - i)))
                size += int(offs[j] - offs[i]) + 16 * (j - i)
                if size >= shard_bytes:
                    made = shard(number, parts)
                    yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(made.columns, _kinds)], _names)
                    number, parts, size = number + 1, [], 0
        if parts:
            made = shard(number, parts)
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(made.columns, _kinds)], _names)

    return _texts(docs, "doc_id").mapInArrow(run, _INDEX)


def query_terms(items: DataFrame) -> DataFrame:
    """``item, item_id, block, term, repeats`` of ``items`` (``item_id``, ``text``): hashes of their terms. ``item`` is unique; items without terms have no rows."""

    def run(batches):
        from pyspark import TaskContext

        item = TaskContext.get().partitionId() << 33
        for b in batches:
            data, offs = words.column(b.column(1))
            h, doc, tf, n = _postings(data, offs)
            at = item + doc
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(0).take(pa.array(doc)), pa.array(at // ITEMS), pa.array(h.view(np.int64)), pa.array(tf)], ["item", "item_id", "block", "term", "repeats"])
            item += len(n)

    return stored(_texts(items, "item_id").mapInArrow(run, "item long, item_id long, block long, term long, repeats long"), "query-terms")


def document_frequencies(index: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, df`` for the terms of ``query_terms``, from the shards' lexicons alone."""
    blocks = terms.groupBy("block").agg(F.collect_set("term").alias("asked"))
    size = 8 * terms.count()

    def run(batches):
        held: dict = {}
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pydict()
                if row["block"][0] not in held:
                    held.clear()
                    held[row["block"][0]] = np.sort(np.array(row["asked"][0], np.int64).view(_U))
                asked = held[row["block"][0]]
                lexicon, starts = np.frombuffer(row["terms"][0], "<u8"), np.frombuffer(row["starts"][0], "<i8")
                at = np.searchsorted(lexicon, asked)
                there = np.flatnonzero(lexicon[np.minimum(at, len(lexicon) - 1)] == asked) if len(lexicon) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(asked[there].view(np.int64)), pa.array(np.diff(starts)[at[there]]), pa.array(np.full(len(there), row["block"][0]))], ["term", "n", "block"])

    counted = beside(index.select("shard", "terms", "starts"), "shard", blocks, size).select("terms", "starts", "block", "asked").mapInArrow(run, "term long, n long, block long")
    # a term of several blocks is counted in each
    return counted.groupBy("block", "term").agg(F.sum("n").alias("df"))


class Shard:
    """A shard's matrix, with the impacts of the asked terms at every level. ``asked``: sorted hashes."""

    def __init__(self, row: dict, asked: np.ndarray):
        self.n, self.levels = row["n_docs"], row["levels"]
        self.ids, self.null = np.frombuffer(row["docs"], np.int64), row["null_docs"]
        lexicon, starts = np.frombuffer(row["terms"], "<u8"), np.frombuffer(row["starts"], "<i8")
        self.zeros = np.frombuffer(row["zeros"], "<i8")
        self.bits = np.frombuffer(row["bits"], "<u8")
        self.size = int(starts[-1])
        self.width = self.size // 64 + 1
        ones = np.bitwise_count(self.bits).astype(np.int64).reshape(self.levels, self.width)
        self.before = (np.cumsum(ones, axis=1) - ones).ravel()
        at = np.searchsorted(lexicon, asked)
        there = lexicon[np.minimum(at, max(len(lexicon) - 1, 0))] == asked if len(lexicon) else np.zeros(len(asked), bool)
        self.low = np.where(there, starts[np.minimum(at, len(starts) - 1)], 0)
        self.high = np.where(there, starts[np.minimum(at + 1, len(starts) - 1)], 0)
        # impacts stand by the leaves: each asked posting goes down to its own
        n = self.high - self.low
        place = np.repeat(self.low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        places = [place]
        for k in range(self.levels):
            place = self.down(np.full(len(place), k), place, self._bit(k, place))
            places.append(place)
        value = np.frombuffer(row["impacts"], "<u4")[place]
        self.impact = np.zeros((self.levels + 1, self.size), "<u4")
        for k, place in enumerate(places):
            self.impact[k, place] = value
        self.impact = self.impact.ravel()

    def _bit(self, k: int, at: np.ndarray) -> np.ndarray:
        return (self.bits[k * self.width + (at >> 6)] >> (at & 63).astype(_U)) & _U(1) == 1

    def ones_before(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = level * self.width + (at >> 6)
        below = (_U(1) << (at & 63).astype(_U)) - _U(1)
        return self.before[word] + np.bitwise_count(self.bits[word] & below)

    def down(self, level: np.ndarray, at: np.ndarray, one: np.ndarray) -> np.ndarray:
        """Where an entry stands one level below, by its bit."""
        ones = self.ones_before(level, at)
        return np.where(one, self.zeros[level] + ones, at - ones)

    def best(self, term: np.ndarray, weight: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(score, document number) of the documents that can be among the ``k`` best of ``least`` or more."""
        low, high = self.low[term], self.high[term]
        there = high > low
        low, high, weight = low[there], high[there], weight[there]
        score, doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(low):
            return score, doc
        level, number = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = np.array([int((weight * self.impact[low]).sum())])
        first = np.array([0, len(low)])  # of each node's intervals
        while len(level):
            open_ = np.flatnonzero(bound >= max(least, 1))
            if not len(open_):
                break
            some = open_[np.argsort(-bound[open_], kind="stable")[:_NODES]]
            rest = np.setdiff1d(open_, some, assume_unique=True)
            leaf = level[some] == self.levels
            if leaf.any():
                found = some[leaf]
                score, doc = np.append(score, bound[found]), np.append(doc, number[found])
                keep = np.lexsort((doc, -score))[:k]
                score, doc = score[keep], doc[keep]
                if len(score) == k:
                    least = max(least, int(score[-1]))
                some = some[~leaf]
            new = self._open(some, level, number, first, low, high, weight)
            old = self._kept(rest, first, low, high, weight)
            level = np.append(level[rest], new[0])
            number = np.append(number[rest], new[1])
            bound = np.append(bound[rest], new[2])
            first = np.append(old[0], old[0][-1] + new[3][1:])
            low, high, weight = np.append(old[1], new[4]), np.append(old[2], new[5]), np.append(old[3], new[6])
        return score, doc

    @staticmethod
    def _kept(nodes, first, low, high, weight):
        n = first[nodes + 1] - first[nodes]
        at = np.repeat(first[nodes] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.append(0, np.cumsum(n)), low[at], high[at], weight[at]

    def _open(self, nodes, level, number, first, low, high, weight):
        """The children of nodes: level, number, bound, first interval; and the intervals."""
        starts, low, high, weight = self._kept(nodes, first, low, high, weight)
        node = np.repeat(np.arange(len(nodes)), np.diff(starts))
        at = level[nodes][node]
        a, b = self.ones_before(at, low), self.ones_before(at, high)
        low = np.concatenate((low - a, self.zeros[at] + a))
        high = np.concatenate((high - b, self.zeros[at] + b))
        child = np.concatenate((2 * node, 2 * node + 1))
        weight, at = np.concatenate((weight, weight)), np.concatenate((at, at)) + 1
        there = high > low
        low, high, child, weight, at = low[there], high[there], child[there], weight[there], at[there]
        order = np.argsort(child, kind="stable")
        low, high, child, weight, at = low[order], high[order], child[order], weight[order], at[order]
        begins = np.flatnonzero(np.append(True, child[1:] != child[:-1])) if len(child) else np.zeros(0, np.int64)
        bound = np.add.reduceat(weight * self.impact[at * self.size + low], begins) if len(begins) else np.zeros(0, np.int64)
        which = child[begins]
        return at[begins], 2 * number[nodes][which >> 1] + (which & 1), bound, np.append(begins, len(child)), low, high, weight


def search(index: DataFrame, terms: DataFrame, n_docs: int, k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item of ``query_terms`` (all that score above 0, if fewer); equal scores by ascending ``doc_id``, null first.

    A term's weight is ``floor(1000 ln((2N + 2) / (2 df + 1)))``. Repeated items
    are searched each; an empty index or no items give no rows.
    """
    df = document_frequencies(index, terms)
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighed = terms.join(df, ["block", "term"]).select("block", "item", "item_id", "term", (weight * F.col("repeats")).alias("weight"))
    blocks = stored(weighed.groupBy("block").agg(F.collect_list(F.struct("item", "item_id", "term", "weight")).alias("asked")), "query-blocks")
    columns = ["n_docs", "levels", "docs", "null_docs", "terms", "starts", "zeros", "bits", "impacts"]

    def run(batches):
        held, best = {}, {}  # a block's items; the best (score, null, doc_id) of each item

        def emit():
            rows = [(item, item_id, None if null else doc, score) for item, (item_id, some) in best.items() for score, null, doc in some]
            best.clear()
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item", "item_id", "doc_id", "score"])

        for b in batches:
            for i in range(b.num_rows):
                row = {c: x[0] for c, x in b.slice(i, 1).to_pydict().items()}
                if row["block"] not in held:
                    held.clear()
                    asked = row["asked"]
                    term = np.array([x["term"] for x in asked], np.int64).view(_U)
                    item, weight = np.array([x["item"] for x in asked], np.int64), np.array([x["weight"] for x in asked], np.int64)
                    known, at = np.unique(term, return_inverse=True)
                    ids = {x["item"]: x["item_id"] for x in asked}
                    held[row["block"]] = known, [(int(x), ids[int(x)], at[item == x], weight[item == x]) for x in np.unique(item)]
                known, items = held[row["block"]]
                shard = Shard(row, known)
                for item, item_id, term, weight in items:
                    some = best[item][1] if item in best else []
                    least = some[-1][0] if len(some) == k else 1
                    score, doc = shard.best(term, weight, k, least)
                    if len(score):
                        new = [(int(s), int(d) < shard.null, int(shard.ids[d])) for s, d in zip(score, doc)]
                        best[item] = item_id, sorted(some + new, key=lambda x: (-x[0], not x[1], x[2]))[:k]
                if len(best) > _HELD:
                    yield emit()
        yield emit()

    found = beside(index.select("shard", *columns), "shard", blocks, 40 * terms.count()).select(*columns, "block", "asked").mapInArrow(run, "item long, item_id long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n_docs, n_terms = corpus_size(docs)
    index = stored(build_index(docs, n_docs, n_terms), "lexical-index")
    return search(index, query_terms(spark.read.parquet(f"{sf_dir}/benchmark.parquet")), n_docs)


OP13_SQL = r"""
with docs as (
  select row_number() over () as uid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
), items as (
  select row_number() over () as item, item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from benchmark
), size as (select count(*) as n, cast(sum(len(terms)) as bigint) as l from docs where len(terms) > 0),
postings as (
  select d.uid, d.doc_id, t.term, count(*) as tf, 75 + ((25 * any_value(len(d.terms)) * any_value(size.n)) // any_value(size.l)) as m
  from docs d, unnest(d.terms) as t(term), size
  group by all
), asked as (select i.item, i.item_id, t.term, count(*) as repeats from items i, unnest(i.terms) as t(term) group by all),
weights as (
  select term, cast(floor(1000 * ln((2.0 * any_value(size.n) + 2) / (2.0 * count(*) + 1))) as bigint) as w from postings, size group by term
), scored as (
  select a.item, a.item_id, p.uid, p.doc_id, cast(sum(a.repeats * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * p.m))) as bigint) as score
  from asked a join weights w using (term) join postings p using (term)
  group by all
)
select item_id, cast(row_number() over (partition by item order by score desc, doc_id nulls first, uid) as integer) as rank, doc_id, score
from scored where score > 0
qualify row_number() over (partition by item order by score desc, doc_id nulls first, uid) <= 20
"""
