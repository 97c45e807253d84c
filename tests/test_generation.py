"""The transducer, TF-IDF, Korean retrieval, n-grams and quantiles against brute force."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.operators import candidates as C
from lexweave.operators import evaluate as E
from lexweave.operators import predict as P
from lexweave.operators import stats as S
from lexweave.operators import tfidf as V
from lexweave.operators import transducer as N
from lexweave.plans import catalog as Q
from lexweave.sources import sentences as T

COUNTS = "lang string, raw string, norm string, n long"


def ways(raw, norm):
    """All ways in which the letters of ``raw`` and its end can have written ``norm``."""
    if not raw:
        return [[("", norm)]] if len(norm) <= N.LONGEST else []
    return [[(raw[0], norm[:k]), *rest] for k in range(min(N.LONGEST, len(norm)) + 1) for rest in ways(raw[1:], norm[k:])]


@pytest.mark.parametrize("raw, norm", [("a", "b"), ("ab", "ab"), ("abc", "aabc"), ("q", "que"), ("abcde", "ab"), ("aaaaa", "aa"), ("ab", ""), ("", "x"), ("a", "abcdef")])
def test_posteriors_equal_enumeration(raw, norm):
    rng = random.Random(len(raw) + len(norm))
    weights = {(c, d): rng.random() for c in [*set(raw), ""] for d in {norm[i:j] for i in range(len(norm) + 1) for j in range(i, min(len(norm), i + 2) + 1)}}
    for table in (None, weights):
        weight = N.start_weight if table is None else lambda c, d: table.get((c, d), 0.0)
        want, total = defaultdict(float), 0.0
        for way in ways(raw, norm):
            p = math.prod(weight(c, d) for c, d in way)
            total += p
            letters = [*raw, ""]
            for i, (c, d) in enumerate(way):
                want[(letters[i - 1] if i else "", c, letters[i + 1] if i + 1 < len(way) else "", d)] += p
        got = defaultdict(float)
        for *key, p in N.posteriors(raw, norm, table):
            got[tuple(key)] += p
        assert bool(got) == bool(total)
        if total:
            assert set(got) == set(want) and all(got[k] == pytest.approx(want[k] / total) for k in want)


@pytest.fixture(scope="module")
def rules(spark):
    """Words whose k is written qu, whose doubled end letters are single, and others."""
    rng = random.Random(3)
    rows = set()
    while len(rows) < 300:
        norm = "".join(rng.choice(["que", "ca", "la", "si", "to", "me"]) for _ in range(rng.randrange(1, 5)))
        rows.add((norm.replace("qu", "k"), norm))
    return spark.createDataFrame([("es", a, b, rng.randrange(1, 4)) for a, b in sorted(rows)], COUNTS)


def test_transducer_writes_unseen_words(spark, rules):
    model = N.learn(rules, rounds=3)
    words = spark.createDataFrame([("es", w) for w in ("kekeke", "simekela", "zz", "lato", "kelakelake")], "lang string, raw string")
    got = {r["raw"]: r["cand"] for r in N.beams(words, model).where("ord = 1").collect()}
    assert got == {"kekeke": "quequeque", "simekela": "simequela", "zz": "zz", "lato": "lato", "kelakelake": "quelaquelaque"}
    assert N.beams(words.limit(0), model).count() == 0
    assert N.learn_weights(rules.limit(0)) == {}


def test_weights_are_shares_and_likelihood_grows(spark, rules):
    def likelihood(weights):
        total = 0.0
        for r in rules.collect():
            p = sum(math.prod(weights["es"].get(step, 0.0) for step in way) for way in ways(r["raw"], r["norm"]))
            total += r["n"] * math.log(p)
        return total

    found = [N.learn_weights(rules, rounds=k, least=0.0) for k in (1, 2, 4)]
    for w in found:
        sums = defaultdict(float)
        for (c, _), p in w["es"].items():
            sums[c] += p
        assert all(s == pytest.approx(1.0) for s in sums.values())
    values = [likelihood(w) for w in found]
    assert values[0] <= values[1] + 1e-9 <= values[2] + 2e-9
    assert found[-1]["es"][("k", "qu")] > 0.95


def test_beams_equal_exhaustive_search(spark):
    """All outputs of words of up to five letters, by tables of options."""
    rng = random.Random(8)
    options = {c: [(d, round(rng.random() * 3, 6)) for d in rng.sample(["", "a", "b", "ab", "c"], 3)] for c in ["a", "b", "c", ""]}
    base = spark.createDataFrame([("es", c, [(d, k) for d, k in sorted(o, key=lambda x: x[1])]) for c, o in options.items()], "lang string, letter string, options array<struct<written:string,cost:double>>")
    contexts = spark.createDataFrame([], "lang string, before string, letter string, after string, options array<struct<written:string,cost:double>>")
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(25)})
    got = defaultdict(list)
    for r in N.beams(spark.createDataFrame([("es", w) for w in words], "lang string, raw string"), N.Transducer(base, contexts), width=3, inner=5000).orderBy("ord").collect():
        got[r["raw"]].append((r["cand"], round(r["cost"], 6)))
    for w in words:
        cost: dict[str, float] = {}
        for way in itertools.product(*(options[c] for c in [*w, ""])):
            out, k = "".join(d for d, _ in way), sum(k for _, k in way)
            cost[out] = min(cost.get(out, math.inf), k)
        cost.pop("", None)
        assert got[w] == [(o, round(k, 6)) for k, o in sorted((round(k, 9), o) for o, k in cost.items())[:3]]


def test_context_picks_outputs(spark):
    s = spark.createDataFrame([(0, "es", ["la", "casa"], ["la", "casa"]), (1, "es", ["mi", "caza"], ["mi", "caza"]), (2, "es", ["la", "casa"], ["la", "casa"])], T.SENTENCES)
    t = T.tokens(spark.createDataFrame([(5, "es", ["la", "kasa", "@x"], None), (6, "es", ["mi", "kasa"], None)], T.SENTENCES))
    outputs = spark.createDataFrame([("es", "kasa", "casa", 1.0, 1), ("es", "kasa", "caza", 1.0, 2), ("es", "@x", "y", 0.0, 1)], "lang string, raw string, cand string, cost double, ord int")
    got = {(r["sent_id"], r["raw"]): r["generated"] for r in N.in_context(t, outputs, S.marginals(S.gold_trigrams(s))).collect()}
    assert got == {(5, "la"): "", (5, "kasa"): "casa", (5, "@x"): "", (6, "mi"): "", (6, "kasa"): "caza"}


# TF-IDF


def weighed(texts, known, idf, sublinear):
    out = {}
    for k, grams in texts.items():
        w = {g: (1 + math.log(c) if sublinear else c) * idf[g] for g, c in grams.items() if g in known}
        length = math.sqrt(sum(x * x for x in w.values()))
        out.update({(k, g): x / length for g, x in w.items()})
    return out


@pytest.mark.parametrize("sublinear", [False, True])
def test_tfidf_equals_a_direct_computation(spark, sublinear):
    rng = random.Random(5)
    texts = {i: "".join(rng.choice("abc  ") for _ in range(rng.randrange(0, 25))) for i in range(60)}
    rows = spark.createDataFrame(list(texts.items()), "id long, text string")
    counted = V.grams(rows, F.col("text"), ("id",), 1, 3, False)
    grams = {}
    for i, t in texts.items():
        t = " ".join(t.split(" ")) if not t.strip() and False else __import__("re").sub(r"\s\s+", " ", t)
        grams[i] = Counter(t[a : a + n] for n in (1, 2, 3) for a in range(len(t) - n + 1))
    tf, df = Counter(), Counter()
    for c in grams.values():
        tf.update(c)
        df.update(c.keys())
    known = [g for g, _ in sorted(tf.items(), key=lambda x: (-x[1], x[0]))[:20]]
    words = V.vocabulary(counted, len(texts), 20)
    got = {r["gram"]: (r["tf"], r["df"], r["idf"], r["idx"]) for r in words.collect()}
    idf = {g: round(math.log((1 + len(texts)) / (1 + df[g])) + 1, 6) for g in known}
    assert got == {g: (tf[g], df[g], idf[g], i) for i, g in enumerate(sorted(known))}
    want = weighed(grams, set(known), idf, sublinear)
    found = {(r["id"], r["gram"]): r["weight"] for r in V.weights(counted, words, ("id",), sublinear=sublinear).collect()}
    assert set(found) == set(want) and all(found[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_classifier_learns_letters(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdef") for _ in range(8)) for _ in range(400)]
    rows = spark.createDataFrame([(i, t, float("ab" in t)) for i, t in enumerate(texts)], "id long, text string, label double")
    model = V.fit(rows.where("id < 300"), least=1, most=2, limit=100, balanced=True, reg=1e-4)
    scored = {r["id"]: r["p"] for r in model.score(rows.where("id >= 300"), "text", ("id",)).collect()}
    assert np.mean([(scored[i] >= 0.5) == ("ab" in texts[i]) for i in range(300, 400)]) > 0.9
    assert model.score(spark.createDataFrame([(1, "")], "id long, text string"), "text", ("id",)).count() == 1


# Korean retrieval


def hangul(rng, n):
    return "".join(chr(0xAC00 + rng.choice([0, 588 * 2, 588 * 3]) + 28 * rng.choice([0, 4, 8]) + rng.choice([0, 1, 4])) for _ in range(n))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_korean_neighbours_equal_brute_force(spark):
    rng = random.Random(7)
    base = [hangul(rng, n) for n in (1, 1, 2, 2, 3, 3, 4, 5, 6, 7, 8, 9, 12) for _ in range(6)]
    words = set(base)
    for w in base:
        for _ in range(4):
            v = list(w)
            for _ in range(rng.randrange(1, 3)):
                k = rng.randrange(len(v) + 1)
                v[k : k + rng.randrange(2)] = [hangul(rng, 1)] * rng.randrange(2)
            words.add("".join(v))
    words = sorted(w for w in words | {"a", "가a", "ㅋㅋㅋ"} if w)
    asked = rng.sample(words, 90) + [base[-1], base[-2]]
    v = spark.createDataFrame([("ko", w, 1 + i % 5) for i, w in enumerate(words)], "lang string, word string, n long")
    q = spark.createDataFrame([("ko", w) for w in asked], "lang string, raw string")
    letters = {r["x"]: (r["j"], r["f"]) for r in spark.createDataFrame([(w,) for w in words], "x string").select("x", X.jamo("x").alias("j"), X.first_jamo("x").alias("f")).collect()}
    want = set()
    for a in set(asked):
        for b in words:
            if a != b and letters[a][1] == letters[b][1] and abs(len(a) - len(b)) <= 2:
                whole, part = edits(a, b), edits(letters[a][0], letters[b][0])
                d = min([float(whole)] * (whole <= 1) + [round(part * 0.6, 6)] * (part <= 3), default=9)
                if d <= (1.2 if len(a) <= 3 else 1.8):
                    want.add((a, b, d))
    got = {(r["raw"], r["cand"], r["dist"]) for r in C.near_vocabulary(q, v, "ko", most=10_000).collect()}
    assert got == want and len(want) > 100
    pairs = {(r["raw"], r["cand"]) for r in C.near_korean(q, v).collect()}
    assert pairs == {(r["raw"], r["cand"]) for r in C.near_korean(q, v, hot=3).collect()}
    assert C.near_korean(q, v, hot=3).count() == len(pairs)  # each once


def test_korean_candidates_grow_with_words(spark):
    rng = random.Random(2)
    made = []
    for n in (400, 1600):
        words = sorted({"".join(chr(0xAC00 + rng.randrange(11172)) for _ in range(4)) for _ in range(n)})
        v = spark.createDataFrame([("ko", w, 1) for w in words], "lang string, word string, n long")
        made.append(C.near_korean(v.select("lang", F.col("word").alias("raw")), v).count() / n)
    assert made[1] < 4 * max(made[0], 1)  # a block of letter and length would hold 16 times as many


# n-grams, leave-one-out, quantiles


def test_ngrams_in_one_pass(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b"]), (w := [rng.choice("xyz") for _ in range(rng.randrange(0, 6))]), rng.choice([None, [x if rng.random() < 0.8 else None for x in w], w[:-1] + ["<BOS>"] if w else w])) for i in range(40)]
    s = spark.createDataFrame(rows, T.SENTENCES)
    t = T.tokens(s)
    got = {tuple(r) for r in S.marginals(S.gold_trigrams(s)).select("ord", "lang", "w1", "w2", "w3", "n").collect()}
    want = set()
    for k in (1, 2, 3):
        want |= {(k, r["lang"], *(r[f"w{i}"] if i <= k else None for i in (1, 2, 3)), r["n"]) for r in S.ngram_counts(t, k).collect()}
    assert got == want
    g3 = S.ngram_counts(t, 3)
    old = P.language_scores(g3.select("lang", F.col("w1").alias("left"), F.col("w2").alias("cand"), F.col("w3").alias("right")), S.ngram_counts(t, 1), S.ngram_counts(t, 2), g3)
    columns = ["lang", "left", "cand", "right", "uni", "bi_left", "bi_right", "tri"]
    assert sorted(map(tuple, S.trigram_scores(S.gold_trigrams(s)).select(columns).collect())) == sorted(map(tuple, old.select(columns).collect()))


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange" in line and "Broadcast" not in line for line in plan.splitlines())


def test_plans_stay_short(spark, tmp_path):
    s = spark.createDataFrame([(0, "a", ["x", "y"], ["x", "z"])], T.SENTENCES)
    s.write.parquet(str(tmp_path / "s"))
    s = spark.read.parquet(str(tmp_path / "s"))
    counts = S.pair_counts(T.tokens(s))
    assert exchanges(S.marginals(S.gold_trigrams(s))) <= 3
    assert exchanges(S.loo_raw(counts)) <= 3
    assert exchanges(P.loo_decisions(counts, "l2_loo_category")) <= 10


def test_quantiles_equal_a_sort(spark):
    rng = random.Random(3)
    values = [("a", rng.choice([0.0, 1.0, rng.random(), -rng.random() * 1e6])) for _ in range(700)] + [("b", 5.0)] * 9 + [("c", None), ("d", 1e-9), ("d", 2e-9)]
    df = spark.createDataFrame(values, "lang string, x double")
    shares = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)
    want = set()
    for lang in "abd":
        own = sorted(v for k, v in values if k == lang)
        want |= {(lang, p, own[int((len(own) - 1) * p)]) for p in shares}
    for bins in (1, 7, 4096):
        assert {tuple(r) for r in E.quantiles(df, "x", shares, bins).collect()} == want


def test_catalog_has_all_queries():
    assert {"x2_provenance", "a5_key_counts"} <= set(Q.oracle_sql()) | {"a5_key_counts"} and set(Q.oracle_sql()) <= set(Q.queries())
    assert {"h7_generate", "d2_generated", "h2_vocabulary", "j6_korean_fuzzy"} <= set(Q.queries())
