"""Toxicity by a weighted lexicon.

Texts are folded (lower case, look-alike letters, digits for letters) and
matched by an Aho-Corasick automaton of words and word beginnings. Hits inside
an exception phrase do not count; the weighted sum is normalised by length and
mapped to a probability.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import bounded_batches

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = dict(zip("аАеЕоОрРсСхХуУіІјЈѕЅԁһнНкКмМтТвВαΑεΕοΟρΡιΙκΚνΝτΤυΥχΧβΒηΗμΜζΖıɡⅼ", "aaeeooppccxxyyiijjssdhhhkkmmttbbaaeeooppiikkvvttyyxxbbhhmmzziɡl"))
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_INVISIBLE = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))
_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()} | {0xFF01 + i: chr(0x21 + i).lower() for i in range(94)} | _INVISIBLE
_LEET = re.compile(r"(?<=[^\W\d_])[0134578@$](?=[^\W_]|[0134578@$])|[0134578@$](?=[^\W\d_])|(?<=[^\W\d_])!(?=[^\W\d_])|(?<=[^\W\d_])[013457](?![^\W_])")
_LEET_SIGN = re.compile(r"[0134578@$!]")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str | None) -> str:
    """Lower case, look-alike letters to Latin, and digits and signs within words to the letters they stand for."""
    t = (text or "").lower()
    if not t.isascii():
        t = t.translate(_FOLD)
    if _LEET_SIGN.search(t):
        t = _LEET.sub(lambda m: LEET[m[0]], t)
    return t


@dataclass
class Lexicon:
    """``weights``: a word, or with a final ``*`` a word's beginning. ``exceptions``: folded phrases within which nothing counts."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    slope: float = 1.0
    intercept: float = -0.5
    length_power: float = 0.25

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for w, v in self.weights.items():
            key = w.removesuffix("*")
            found.add_word(key, (*(found.get(key, ())), (len(key), w.endswith("*"), v)))
        for e in self.exceptions:
            found.add_word(e, (*(found.get(e, ())), (len(e), False, None)))
        found.make_automaton()
        return found


def hits(folded: str, automaton) -> tuple[float, int]:
    """Weighted and plain number of lexicon hits outside exception phrases."""
    if not len(automaton):
        return 0.0, 0
    found, shields = [], []
    n = len(folded)
    for end, entries in automaton.iter(folded):
        for size, prefix, weight in entries:
            start = end + 1 - size
            if start and folded[start - 1].isalpha() or not prefix and end + 1 < n and folded[end + 1].isalpha():
                continue
            (shields if weight is None else found).append((start, end, weight or 0.0))
    # A hit is shielded if, of the shields that begin no later, the one that reaches farthest covers it.
    best: dict[int, float] = {}
    found.sort()
    shields.sort()
    k, reach = 0, -1
    for start, end, weight in found:
        while k < len(shields) and shields[k][0] <= start:
            reach = max(reach, shields[k][1])
            k += 1
        if end > reach:
            best[start] = max(best.get(start, 0.0), weight)
    return sum(best.values()), len(best)


def _normal(weight: float, folded: str, power: float) -> float:
    return weight / max(1, folded.count(" ") + folded.count("\n") + 1) ** power


def _terms(folded: str) -> set[str]:
    """Words, and their beginnings of 3 to 8 letters with a star."""
    own = set(_WORD.findall(folded))
    return own | {f"{w[:k]}*" for w in own for k in range(3, min(9, len(w) + 1))}


def learn(rows: list[tuple[str | None, int]], prior: float, least: int = 3, precision: float = 0.9, max_terms: int = 2000) -> Lexicon:
    """A lexicon from (text, label) rows. ``prior``: share of label 1 in the population.

    Words and word beginnings of 3 to 8 letters are candidates. Again and again the
    one that covers most uncovered toxic texts is taken, if it covers ``least`` and
    its precision, at equal class sizes, is at least ``precision``; weights are log
    odds. Word pairs around a taken term that occur in clean texts only become
    exceptions.
    """
    distinct: dict[tuple[int, bytes], tuple[str, int]] = {}
    for t, y in rows:  # texts that are equal once folded count once
        t = fold(t)
        distinct.setdefault((y, hashlib.md5(t.encode()).digest()), (t, y))
    folded = [t for t, _ in distinct.values()]
    labels = np.array([y for _, y in distinct.values()], int)
    pos, neg = int(labels.sum()), int((1 - labels).sum())
    if not pos or not neg:
        return Lexicon({}, slope=0.0, intercept=math.log((pos + 0.5) / (neg + 0.5)))
    # Terms of a text are made when they are counted; only those of enough toxic texts are kept.
    yes = Counter()
    for i in np.flatnonzero(labels):
        yes.update(_terms(folded[i]))
    yes = Counter({x: n for x, n in yes.items() if n >= least})
    no = Counter()
    for i in np.flatnonzero(1 - labels):
        no.update(x for x in _terms(folded[i]) if x in yes)
    rate = lambda x: ((yes[x] + 0.5) / (pos + 1), (no[x] + 0.5) / (neg + 1))
    strong = {x for x, n in yes.items() if n >= least and (r := rate(x))[0] / (r[0] + r[1]) >= precision and no[x] <= max(0.1 * n, 1)}
    holds: dict[str, list[int]] = {}
    for i in np.flatnonzero(labels):
        for x in _terms(folded[i]) & strong:
            holds.setdefault(x, []).append(i)
    # Gains only fall, so a term whose renewed gain still leads the heap is the best; whole words and longer beginnings win ties.
    heap = [(-len(own), no[x] > 0, x.endswith("*"), -len(x), x) for x, own in holds.items()]
    heapq.heapify(heap)
    covered: set[int] = set()
    picked: dict[str, float] = {}
    while heap and len(picked) < max_terms:
        _, *rest = heapq.heappop(heap)
        new = [i for i in holds[rest[-1]] if i not in covered]
        if len(new) < least:
            continue
        if heap and (-len(new), *rest) > heap[0]:
            heapq.heappush(heap, (-len(new), *rest))
            continue
        a, b = rate(rest[-1])
        picked[rest[-1]] = math.log(a / b)
        covered.update(new)
    # A term that many toxic texts and no clean one have is one even where a taken term covers them, unless its texts have a taken relative.
    for x in sorted(holds, key=lambda x: (-yes[x], not x.endswith("*"), -len(x), x)):
        if yes[x] < max(3 * least, 0.02 * pos) or len(picked) >= max_terms:
            break
        stem = x.removesuffix("*")
        own = set(holds[x]).difference(*(holds[p] for p in picked if p.startswith(stem) or p.endswith("*") and stem.startswith(p[:-1])))
        if not no[x] and len(own) >= max(3 * least, 0.02 * pos):
            a, b = rate(x)
            picked[x] = math.log(a / b)
    lex = Lexicon(picked)
    lex = Lexicon(picked, _exceptions(folded, labels, lex), length_power=lex.length_power)
    auto = lex.automaton()
    z = np.array([_normal(hits(t, auto)[0], t, lex.length_power) for t in folded])
    w = np.where(labels == 1, prior / pos, (1 - prior) / neg) * len(folded)
    lex.slope, lex.intercept = _platt(z, labels, w)
    return lex


def _exceptions(folded: list[str], labels: np.ndarray, lex: Lexicon, least: int = 2) -> tuple[str, ...]:
    auto, clean, toxic = lex.automaton(), Counter(), Counter()
    if not len(auto):
        return ()
    for t, y in zip(folded, labels):
        seen = set()
        for end, entries in auto.iter(t):
            for size, _, _ in entries:
                start = end + 1 - size
                a = t.rfind(" ", 0, max(start - 1, 0)) + 1
                b = re.compile(r"\W|\Z").search(t, end + 1).start()
                c = re.compile(r"\W|\Z").search(t, min(b + 1, len(t))).start()
                seen |= {t[a:b], t[start:c]} if start == 0 or not t[start - 1].isalpha() else set()
        (toxic if y else clean).update(x for x in seen if " " in x)
    return tuple(sorted(x for x, n in clean.items() if n >= least and not toxic[x]))


def _platt(z: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Weighted logistic regression of one feature by damped Newton steps, slightly regularised."""
    a, b = 1.0, -1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([np.sum(w * (p - y) * z) + 1e-2 * a, np.sum(w * (p - y)) + 1e-3 * b])
        s = w * p * (1 - p) + 1e-9
        h = np.array([[np.sum(s * z * z) + 1e-2, np.sum(s * z)], [np.sum(s * z), np.sum(s) + 1e-3]])
        d = np.linalg.solve(h, g)
        d *= min(1.0, 2.0 / max(np.abs(d).max(), 1e-12))
        a, b = a - d[0], b - d[1]
    return float(a), float(b)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_clean: int = 5000, max_toxic: int = 2000) -> tuple[list[tuple[str, int]], float]:
    """(text, label) rows to learn from, and the share of label 1 among all of them.

    A bounded sample: in the order of a hash of ``doc_id``, ``max_clean`` and
    ``max_toxic`` labelled documents that are not held out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    order = F.xxhash64("doc_id")
    picked = known.where("toxic = 0").orderBy(order, "doc_id").limit(max_clean).unionByName(known.where("toxic = 1").orderBy(order, "doc_id").limit(max_toxic))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(picked), "doc_id").orderBy("doc_id", "text").toLocalIterator()
    return [(r["text"], r["toxic"]) for r in rows], float(share)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, score, n_hits`` of each row; a null or empty text has no hits and the score of a text without."""

    def run(batches):
        auto = lexicon.automaton()
        for b in batches:
            out, number = [], []
            for t in b.column(1):
                t = fold(t.as_py())
                w, n = hits(t, auto)
                z = lexicon.slope * _normal(w, t, lexicon.length_power) + lexicon.intercept
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                number.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64()), pa.array(number, pa.int64())], ["doc_id", "score", "n_hits"])

    bounded_batches(docs.sparkSession)
    kept = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return docs.select(*kept).mapInArrow(run, "doc_id long, score double, n_hits long")


def toxicity(docs: DataFrame, labels: DataFrame, **sample) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_hits`` of each row of ``docs`` (``doc_id, text`` are read).

    ``labels``: ``doc_id, toxic``; null labels are not used, of repeated ones the
    largest. Without labels of both classes every text gets one score.
    """
    rows, share = training_rows(docs, labels, **sample)
    scored = score(docs, learn(rows, min(max(share, 0.01), 0.99)))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
