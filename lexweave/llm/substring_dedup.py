"""Substring de-duplication behind a count-min prefilter.

Documents are dealt into chunks once. Every chunk sends a count-min sketch of
its word windows in sparse form: per sketch row, its distinct cells in order.
Owners of cell ranges merge the sketches of all chunks and answer which cells
are met again; counts of cells are never below those of windows, so no repeated
window is lost. A second pass sends only the windows whose cells are repeated in
every row, by their 96-bit hash; owners of hash ranges group them exactly and
answer with the smallest document that has each. A chunk sends each window
once however often it has it, so a window that half the corpus holds has no
more rows than there are chunks. The dealt-out documents are one exchange, which
the three uses share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import partitions
from .words import column, doc_slices, hash_windows, hash_words, mix, whole

_U = np.uint64
_MAX = np.iinfo(np.int64).max
DEPTH = 2


def _pack(a: np.ndarray) -> bytes:
    """Integers as byte planes, compressed; small ones cost little."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), 1)


def _unpack(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _pack_sorted(a: np.ndarray) -> bytes:
    return _pack(np.diff(a, prepend=_U(0)))


def _unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, _U), dtype=_U)


class _Windows:
    """Hashes, documents and word positions of a chunk's windows."""

    def __init__(self, table: pa.Table, size: int):
        ids = table["__id"].to_numpy()
        data, offs = column(table["text"])
        h, g, doc, at = [], [], [], []
        self.n_words = np.zeros(len(ids), np.int64)
        for i, j in doc_slices(offs):
            w, _, _, first = hash_words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            self.n_words[i:j] = np.diff(first)
            a = hash_windows(w, size)
            fits, d = whole(first, size, len(a))
            h.append(a[fits])
            g.append((hash_windows(w, size, 1)[fits] >> _U(32)).astype(np.uint32))
            d = d[fits]
            doc.append((d + i).astype(np.int32))
            at.append((np.flatnonzero(fits) - first[d]).astype(np.int32))
        cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.high, self.low, self.doc, self.at = cat(h, _U), cat(g, np.uint32), cat(doc, np.int32), cat(at, np.int32)
        self.ids = ids
        self.id = ids[self.doc] if len(self.doc) else np.zeros(0, np.int64)

    def cells(self, row: int, bits: int):
        return np.unique(mix(self.high * _U(2 * row + 1) + _U(row)) >> _U(64 - bits), return_inverse=True, return_counts=True)


def _bounds(n_ranges: int, bits: int) -> np.ndarray:
    return np.array([(r << bits) // n_ranges for r in range(n_ranges + 1)], object)


def _split(a: np.ndarray, n_ranges: int, bits: int) -> np.ndarray:
    inner = np.array([int(x) for x in _bounds(n_ranges, bits)[1:-1]], _U)
    return np.concatenate(([0], np.searchsorted(a, inner), [len(a)]))


def _binary(values):
    return pa.array(values, pa.binary())


def substring_dedup(docs: DataFrame, window: int = 13, chunk_bytes: int = 4 << 20, keep_layout: bool = False) -> DataFrame:
    """``docs`` with ``text`` replaced by its kept words, and ``n_words, n_removed``.

    A word goes if a window of ``window`` words that covers it also starts in a
    document with a smaller ``doc_id``; windows are those of the input. Kept
    words are joined by one space; with ``keep_layout`` a text that loses
    nothing stays as it is. A null text has no words and stays null with
    ``keep_layout``, else becomes empty. A null ``doc_id`` counts as larger than
    any other. Rows of equal ``doc_id`` count as one document: they remove
    nothing from each other. Other columns are carried, but for clashing
    ``n_words`` and ``n_removed``, which are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_removed")
    names = docs.columns
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    n_chunks = max(1, -(-size // chunk_bytes))
    n_parts = max(partitions(spark), n_chunks // 3)
    n_ranges = n_parts
    bits = min(44, max(10, int(size // 5).bit_length() + 3))  # at least eight cells a window

    rows = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_MAX)), "text": F.col("text").cast("string")})
    rows = rows.withColumn("__chunk", F.pmod(F.xxhash64("__id", "text"), F.lit(n_chunks)).cast("int")).repartition(n_parts, "__chunk")

    def sketch(key, table):
        w, chunk = _Windows(table, window), key[0].as_py()
        blobs = []
        for d in range(DEPTH):
            cells, _, _ = w.cells(d, bits)
            cut = _split(cells, n_ranges, bits)
            blobs.append([_pack_sorted(cells[a:b]) if b > a else None for a, b in zip(cut[:-1], cut[1:])])
        some = [r for r in range(n_ranges) if any(x[r] for x in blobs)]
        return pa.table({"range": pa.array(some, pa.int32()), "chunk": pa.array([chunk] * len(some), pa.int32()), **{f"cells{d}": _binary([blobs[d][r] for r in some]) for d in range(DEPTH)}})

    def merge(table):
        out = {"__chunk": table["chunk"], "range": table["range"]}
        for d in range(DEPTH):
            own = [_unpack_sorted(x.as_py()) if x.is_valid else np.zeros(0, _U) for x in table[f"cells{d}"]]
            a = np.sort(np.concatenate(own)) if own else np.zeros(0, _U)
            again = np.unique(a[1:][a[1:] == a[:-1]])
            bit = []
            for x in own:
                at = np.minimum(np.searchsorted(again, x), max(len(again) - 1, 0))
                bit.append(zstandard.compress(np.packbits(again[at] == x if len(again) else np.zeros(len(x), bool)).tobytes(), 1))
            out[f"again{d}"] = _binary(bit)
        return pa.table(out)

    def candidates(table, answers):
        empty = pa.table({"range": pa.array([], pa.int32()), "chunk": pa.array([], pa.int32()), "keys": _binary([])})
        if not table.num_rows:
            return empty
        w, chunk = _Windows(table, window), table["__chunk"][0].as_py()
        picked = np.ones(len(w.high), bool)
        ranges = answers["range"].to_pylist()
        for d in range(DEPTH):
            cells, back, count = w.cells(d, bits)
            cut = _split(cells, n_ranges, bits)
            again = count > 1
            for r, blob in zip(ranges, answers[f"again{d}"].to_pylist()):
                n = cut[r + 1] - cut[r]
                again[cut[r] : cut[r + 1]] |= np.unpackbits(np.frombuffer(zstandard.decompress(blob), np.uint8), count=n).astype(bool)
            picked &= again[back]
        high, low, ids = w.high[picked], w.low[picked], w.id[picked]
        if not len(high):
            return empty
        order = np.lexsort((ids, low, high))
        high, low, ids = high[order], low[order], ids[order]
        first = np.flatnonzero(np.concatenate(([True], (high[1:] != high[:-1]) | (low[1:] != low[:-1]))))
        last = np.concatenate((first[1:], [len(high)])) - 1
        several = (ids[first] != ids[last]).astype(np.uint8)
        high, low, least = high[first], low[first], ids[first]
        cut = _split(high, n_ranges, 64)
        some = [r for r in range(n_ranges) if cut[r + 1] > cut[r]]
        keys = [_join(_pack_sorted(high[a:b]), _pack(low[a:b]), _pack(least[a:b]), _pack(several[a:b])) for r in some for a, b in [(cut[r], cut[r + 1])]]
        return pa.table({"range": pa.array(some, pa.int32()), "chunk": pa.array([chunk] * len(some), pa.int32()), "keys": _binary(keys)})

    def group(table):
        parts = [_cut(x.as_py()) for x in table["keys"]]
        highs = [_unpack_sorted(p[0]) for p in parts]
        high = np.concatenate(highs)
        low = np.concatenate([_unpack(p[1], np.uint32) for p in parts])
        least = np.concatenate([_unpack(p[2], np.int64) for p in parts])
        several = np.concatenate([_unpack(p[3], np.uint8) for p in parts])
        order = np.lexsort((low, high))
        new = np.concatenate(([True], (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])))
        start = np.flatnonzero(new)
        smallest = np.empty(len(high), np.int64)
        smallest[order] = np.minimum.reduceat(least[order], start)[np.cumsum(new) - 1]
        told = (least > smallest) | (several > 0)
        out, chunks, end = [], table["chunk"].to_pylist(), 0
        for own in highs:
            i = np.flatnonzero(told[end : end + len(own)]) + end
            end += len(own)
            out.append(_join(_pack_sorted(high[i]), _pack(low[i]), _pack(smallest[i])) if len(i) else None)
        some = [k for k, x in enumerate(out) if x]
        return pa.table({"__chunk": pa.array([chunks[k] for k in some], pa.int32()), "range": pa.array([table["range"][k].as_py() for k in some], pa.int32()), "keys": _binary([out[k] for k in some])})

    out_schema = T.StructType([*(f for f in docs.schema if f.name != "text"), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    carried = [c for c in names if c != "text"]

    def cut_out(table, answers):
        w = _Windows(table, window)
        answers = answers.sort_by("range")
        parts = [_cut(x.as_py()) for x in answers["keys"]]
        if parts and len(w.high):
            high = np.concatenate([_unpack_sorted(p[0]) for p in parts])
            low = np.concatenate([_unpack(p[1], np.uint32) for p in parts])
            least = np.concatenate([_unpack(p[2], np.int64) for p in parts])
            at = np.minimum(np.searchsorted(high, w.high), len(high) - 1)
            gone = (high[at] == w.high) & (low[at] == w.low) & (least[at] < w.id)
        else:
            gone = np.zeros(len(w.high), bool)
        base = np.concatenate(([0], np.cumsum(w.n_words)))
        edge = np.zeros(base[-1] + 1, np.int32)
        start = base[w.doc[gone]] + w.at[gone]
        np.add.at(edge, start, 1)
        np.add.at(edge, start + window, -1)
        kept = np.cumsum(edge)[:-1] == 0
        n_removed = w.n_words - np.diff(np.concatenate(([0], np.cumsum(kept)))[base])
        texts = []
        for k, t in enumerate(table["text"]):
            t = t.as_py()
            if keep_layout and not n_removed[k]:
                texts.append(t)
            else:
                words = (t or "").encode().split()
                texts.append(b" ".join(words if not n_removed[k] else [x for x, y in zip(words, kept[base[k] : base[k + 1]].tolist()) if y]).decode())
        return pa.table({**{c: table[c] for c in carried}, "text": pa.array(texts, pa.string()), "n_words": pa.array(w.n_words), "n_removed": pa.array(n_removed)})

    sketches = rows.groupBy("__chunk").applyInArrow(sketch, "range int, chunk int, " + ", ".join(f"cells{d} binary" for d in range(DEPTH)))
    again = sketches.groupBy("range").applyInArrow(merge, "__chunk int, range int, " + ", ".join(f"again{d} binary" for d in range(DEPTH)))
    found = rows.groupBy("__chunk").cogroup(again.groupBy("__chunk")).applyInArrow(candidates, "range int, chunk int, keys binary")
    exact = found.groupBy("range").applyInArrow(group, "__chunk int, range int, keys binary")
    return rows.groupBy("__chunk").cogroup(exact.groupBy("__chunk")).applyInArrow(cut_out, out_schema).select(*names, "n_words", "n_removed")


def _join(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _cut(b: bytes) -> list[bytes]:
    out, i = [], 0
    while i < len(b):
        n = int.from_bytes(b[i : i + 4], "little")
        out.append(b[i + 4 : i + 4 + n])
        i += 4 + n
    return out


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: The same rows, window by window. Removed words are found by the windows' first words.
OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w WHERE len(ws) >= 13)),
m AS (SELECT k, min(doc_id) AS least FROM s GROUP BY k),
g AS (SELECT DISTINCT s.doc_id, unnest(generate_series(s.i, s.i + 12)) AS p FROM s JOIN m USING (k) WHERE m.least < s.doc_id),
r AS (SELECT doc_id, list(p) AS gone, count(*) AS n FROM g GROUP BY doc_id),
x AS (SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, ws, gone FROM w LEFT JOIN r USING (doc_id)),
y AS (SELECT doc_id, unnest(ws) AS wd, unnest(generate_series(1, len(ws))) AS p FROM w),
z AS (SELECT y.doc_id, string_agg(y.wd, ' ' ORDER BY y.p) AS kept FROM y ANTI JOIN g ON y.doc_id = g.doc_id AND y.p = g.p GROUP BY y.doc_id)
SELECT x.doc_id, CAST(x.n_words AS BIGINT) AS n_words, CAST(x.n_removed AS BIGINT) AS n_removed, sha256(coalesce(z.kept, '')) AS kept_sha256
FROM x LEFT JOIN z USING (doc_id)
"""
