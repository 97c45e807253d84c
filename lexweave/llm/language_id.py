"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities over the pieces of a fixed public vocabulary.
A word's probability is the sum over all its segmentations into pieces, by the
forward algorithm, however long word and pieces are; a text's is the product over its
words. The probabilities are learned by expectation maximisation with the
backward algorithm beside it. Both run on byte matrices of distinct words.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import bounded_batches, stored
from .words import column, doc_slices, hash_words, per_doc

_U = np.uint64
_K = 0x9E6C63D0876A9A47
#: Bytes of words whose probability is no smaller than a float can be; longer ones take steps with a running scale.
SHORT = 32
_KEEP = np.full(256, 0x20, np.uint8)
_KEEP[0x61:0x7B] = np.arange(0x61, 0x7B)
_KEEP[0x80:] = np.arange(0x80, 0x100)
_UNKNOWN = 1e-7
_ROWS = 8_000  # words of one length that go side by side: about 2 MB a language
_vocabularies: dict[str, "Vocabulary"] = {}


class Vocabulary:
    """Pieces of a sentencepiece model, lower-cased, and every single byte; found by hash. ``longest``: bytes of the longest one."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {bytes([b]) for b in range(256)}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                p = model.id_to_piece(i).replace("▁", " ").lower().encode()
                if b" " not in p[1:]:
                    found.add(p)
        self.pieces = sorted(found)
        self.longest = max(map(len, self.pieces))
        keys = np.zeros(len(self.pieces), _U)
        for k, p in enumerate(self.pieces):
            h = 0
            for b in p:
                h = (h * _K + b + 1) & 0xFFFFFFFFFFFFFFFF
            keys[k] = h
        self.keys = keys
        # Two direct tables over different bits; what still collides is put into the third, which is searched.
        self.tables, rest = [], np.arange(len(keys))
        for shift in (44, 20):
            table = np.full(1 << 20, -1, np.int32)
            at = (keys[rest] >> _U(shift)) & _U(0xFFFFF)
            _, first = np.unique(at, return_index=True)
            table[at[first]] = rest[first]
            self.tables.append((shift, table))
            rest = np.delete(rest, first)
        self.rest = rest[np.argsort(keys[rest])]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, or -1."""
        out = np.full(h.shape, -1, np.int32)
        for shift, table in self.tables:
            k = table[(h >> _U(shift)) & _U(0xFFFFF)]
            hit = (k >= 0) & (self.keys[k] == h)
            out[hit] = k[hit]
        if len(self.rest):
            k = self.rest[np.minimum(np.searchsorted(self.keys[self.rest], h), len(self.rest) - 1)]
            hit = self.keys[k] == h
            out[hit] = k[hit]
        return out


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def distinct_words(data: np.ndarray, offs: np.ndarray):
    """Distinct words of texts that are lower-cased already: runs of letters.

    Returns (bytes, first byte and length of each distinct word, index of each
    word of the texts in them, first word of each text).
    """
    clean = _KEEP[data]
    h, starts, ends, first = hash_words(clean, offs)
    _, pick, back = np.unique(h, return_index=True, return_inverse=True)
    return clean, starts[pick], (ends - starts)[pick], back, first


def _matrix(clean: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    m = np.full((len(starts), size + 1), 0x20, np.uint8)
    m[:, 1:] = clean[starts[:, None] + np.arange(size)]
    return m


def _edges(m: np.ndarray, vocab: Vocabulary):
    """Yield (start, length, piece index of each word) for every place and length at which some word has a piece."""
    n = m.shape[1]
    for i in range(n):
        h = np.zeros(len(m), _U)
        for k in range(1, min(vocab.longest, n - i) + 1):
            h = h * _U(_K) + (m[:, i + k - 1].astype(_U) + _U(1))
            found = vocab.find(h)
            if k == 1 or (found >= 0).any():
                yield i, k, found


@dataclass
class Model:
    """``prob``: pieces by languages, with a last row of zeros that index -1 reads."""

    languages: list[str]
    prob: np.ndarray
    vocabulary: str

    def word_log_probs(self, clean: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        vocab = vocabulary(self.vocabulary)
        out = np.zeros((len(starts), len(self.languages)))
        long = np.flatnonzero(sizes > SHORT)
        long = long[np.argsort(sizes[long])]
        for i in range(0, len(long), _WIDE):
            r = long[i : i + _WIDE]
            out[r] = long_log_probs([clean[x : x + y] for x, y in zip(starts[r], sizes[r])], vocab, self.prob)
        for size in np.unique(sizes[sizes <= SHORT]):
            rows = np.flatnonzero(sizes == size)
            for i in range(0, len(rows), _ROWS):
                r = rows[i : i + _ROWS]
                out[r] = np.log(forward(_matrix(clean, starts[r], int(size)), vocab, self.prob)[:, -1])
        return out

    def score(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Best language and its posterior, under equal priors, of each text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        data, offs = column(pc.utf8_lower(texts))
        best, share, some = [], [], []
        for i, j in doc_slices(offs, 4 << 20):
            o = offs[i : j + 1] - offs[i]
            clean, starts, sizes, back, first = distinct_words(data[offs[i] : offs[j]], o)
            lp = self.word_log_probs(clean, starts, sizes)
            total = np.stack([per_doc_float(lp[back, k], first) for k in range(lp.shape[1])], 1)
            best.append(total.argmax(1))
            share.append(1 / np.exp(total - total.max(1, keepdims=True)).sum(1))
            some.append(per_doc((clean >= 0x61) & (clean < 0x7B), o) > 0)
        if not best:
            return [], np.zeros(0)
        best, share, some = np.concatenate(best), np.concatenate(share), np.concatenate(some)
        lettered = [bool(s) or any(c.isalpha() for c in texts[k].as_py()) for k, s in enumerate(some)]
        return [self.languages[b] if s else "und" for b, s in zip(best, lettered)], np.where(lettered, share, 0.0)


def per_doc_float(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0.0], np.cumsum(values)))
    return c[first[1:]] - c[first[:-1]]


def forward(m: np.ndarray, vocab: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """alpha[word, end, language]: probability of the first ``end`` bytes, over all segmentations."""
    a = np.zeros((len(m), m.shape[1] + 1, prob.shape[1]))
    a[:, 0] = 1
    for i, k, found in _edges(m, vocab):
        a[:, i + k] += a[:, i] * prob[found]
    return a


#: Long words that go side by side, and their bytes in one step.
_WIDE, _STEP = 64, 256


def long_log_probs(words: list[np.ndarray], vocab: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """Log probability of each word (bytes, without the leading space) and language, over all segmentations.

    Forward probabilities of as many places as the longest piece has bytes are
    held at a time, divided now and then by the present one, whose logarithm is kept.
    """
    reach, n_langs = vocab.longest, prob.shape[1]
    size = np.array([len(w) + 1 for w in words])
    m = np.zeros((len(words), size.max() + reach), np.uint8)
    for k, w in enumerate(words):
        m[k, 0], m[k, 1 : len(w) + 1] = 0x20, w
    out = np.zeros((len(words), n_langs))
    ahead = np.zeros((len(words), reach + 1, n_langs))  # of the present place and those a piece can reach
    ahead[:, 0] = 1
    scale = np.zeros((len(words), n_langs))
    for at in range(0, size.max(), _STEP):
        width = min(_STEP, size.max() - at)
        place = np.arange(at, at + width)
        edge = np.empty((len(words), width, reach), np.int32)
        h = np.zeros((len(words), width), _U)
        for k in range(reach):
            h = h * _U(_K) + (m[:, at + k : at + k + width].astype(_U) + _U(1))
            edge[:, :, k] = np.where(place[None, :] + k < size[:, None], vocab.find(h), -1)
        a = np.concatenate((ahead, np.zeros((len(words), width, n_langs))), 1)
        for i in range(width):
            if i % 8 == 0:
                now = np.where(a[:, i] > 0, a[:, i], 1.0)
                a[:, i : i + reach + 1] /= now[:, None]
                scale += np.log(now)
            a[:, i + 1 : i + 1 + reach] += a[:, i, None] * prob[edge[:, i]]
            done = np.flatnonzero(size == at + i + 1)
            if len(done):
                out[done] = np.log(a[done, i + 1]) + scale[done]
        ahead = a[:, width : width + reach + 1]
    return out


def _parts(raw: bytes) -> list[bytes]:
    """``raw`` in parts of at most SHORT bytes, cut before whole characters."""
    out = []
    while len(raw) > SHORT:
        k = next((k for k in range(SHORT, SHORT - 4, -1) if raw[k] & 0xC0 != 0x80), SHORT)
        out.append(raw[:k])
        raw = raw[k:]
    return [*out, raw]


def learn(words: dict[str, Counter], vocab_path: str, steps: int = 4, smooth: float = 0.02) -> Model:
    """Piece probabilities of each language from counts of its words (lower-case, letters only).

    Expected counts of pieces come from forward and backward probabilities, of
    words over SHORT bytes part by part; at the end a share ``smooth`` goes to
    the average of all languages, and every piece keeps a small floor. Without
    words the model knows no language.
    """
    if not words:
        return Model([], np.zeros((0, 0)), vocab_path)
    vocab = vocabulary(vocab_path)
    langs = sorted(words)
    n = len(vocab.pieces)
    prob = np.full((n + 1, len(langs)), 1.0 / n)
    prob[n] = 0
    single = np.array([len(p) == 1 for p in vocab.pieces])
    for li, lang in enumerate(langs):
        by_size: dict[int, tuple[list[bytes], list[int]]] = {}
        for w, c in sorted(words[lang].items()):
            for part in _parts(w.encode()):
                ws, cs = by_size.setdefault(len(part), ([], []))
                ws.append(part)
                cs.append(c)
        lattices = []
        for size, (ws, cs) in by_size.items():
            m = np.full((len(ws), size + 1), 0x20, np.uint8)
            m[:, 1:] = np.frombuffer(b"".join(ws), np.uint8).reshape(len(ws), size)
            lattices.append((m, np.array(cs, float), list(_edges(m, vocab))))
        p = prob[:, li].copy()
        for _ in range(steps):
            counts = np.zeros(n + 1)
            for m, cs, edges in lattices:
                width = m.shape[1]
                a, b = np.zeros((len(m), width + 1)), np.zeros((len(m), width + 1))
                a[:, 0] = b[:, width] = 1
                for i, k, found in edges:
                    a[:, i + k] += a[:, i] * p[found]
                for i, k, found in reversed(edges):
                    b[:, i] += b[:, i + k] * p[found]
                weight = cs / np.maximum(a[:, width], 1e-300)
                for i, k, found in edges:
                    counts += np.bincount(np.where(found < 0, n, found), weight * a[:, i] * p[found] * b[:, i + k], n + 1)
            counts[n] = 0
            p = (counts + 1e-3 * np.append(single, 0)) / (counts.sum() + 1e-3 * single.sum())
        prob[:, li] = p
    mean = prob.mean(1, keepdims=True)
    prob = (1 - smooth) * prob + smooth * mean
    prob[:n] = np.maximum(prob[:n], _UNKNOWN * np.where(single, 1.0, 1e-2)[:, None])
    prob[n] = 0
    return Model(langs, prob, vocab_path)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, max_docs: int = 400, vocab: str | None = None) -> Model:
    """A model from a bounded sample: the whole texts of ``max_docs`` documents a non-null language that are not held out, in the order of a hash of ``doc_id``."""
    from pyspark.sql import Window

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where("lang is not null and doc_id is not null").where(~held_out())
    # A cut of the hash leaves about eight times the wanted rows of a language, so none of them meet in one task.
    sizes = stored(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    share = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / F.lit(1 << 30)
    few = known.join(sizes, "lang").where(share * F.col("n") < 8 * max_docs)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id")
    picked = stored(few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_docs).select("doc_id").distinct(), "sample")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).join(picked, "doc_id").where("lang is not null")
    words: dict[str, Counter] = {}
    for r in rows.orderBy("lang", "doc_id", "text").toLocalIterator():
        clean = bytes(_KEEP[np.frombuffer((r["text"] or "").lower().encode(), np.uint8)])
        words.setdefault(r["lang"], Counter()).update(clean.decode(errors="ignore").split())
    return learn(words, vocab or default_path())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``lang_pred, lang_score`` (these names replace clashing ones).

    ``lang_pred`` is ``und`` and the score 0 where the text is null or has no
    letter, and everywhere if the model knows no language. Ties go to the first
    language in order.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "lang_score")
    at = docs.columns.index("text")
    spec = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])

    def run(batches):
        for b in batches:
            if model.languages:
                names, share = model.score(b.column(at).cast(pa.string()))
            else:
                names, share = ["und"] * b.num_rows, np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(share, pa.float64())], [*b.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, spec)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
