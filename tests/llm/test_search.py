"""Byte-level BPE, hard negatives and lexical search against brute force, and on hard tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lexweave.llm import byte_pairs, hard_negatives, lexical_search, runtime

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, term string, block long, item long, ids string, score double"


def documents(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, "en", "x", 1, 2, "y", 0.5) for i, t in texts], DOCS).repartition(parts)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)] + ["Éa", "éa", "it's", "I'LL", "x  y", "\n\n", "\t", "123,456", "\U0001f600", "a b", "日本語", "don't."]
    found = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 90)))) for i in range(70)]
    found += [(100, None), (101, ""), (102, " "), (103, "  a"), (104, "a  "), (105, "..."), (106, "W1 w1 W1"), (None, "w1 w2"), (None, None)]
    found += [(5, found[5][1]), (107, found[3][1]), (108, "a" * 5000), (109, "".join(rng.choice("abcd") for _ in range(3000))), (110, "w1 w2 w3 " * 3000)]
    return found


# op12


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def pair(request):
    import public_tokenizers as P
    import tiktoken

    ranks = byte_pairs.read_ranks(P.path(request.param))
    return byte_pairs.codec(P.path(request.param), P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_equals_the_library(pair):
    own, library = pair
    rng = random.Random(2)
    kinds = ["ab", "abc", "the and ing", "aeiou ñáéß", "0123 .,\n\t  ", "你好 мир", "".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(128, 0x3000), rng.randrange(0x1F300, 0x1F600)))) for _ in range(200))]
    some = ["".join(rng.choice(kind) for _ in range(rng.randrange(100))) for kind in kinds for _ in range(60)] + ["a" * 3000, "ab" * 900, "  x", "a \x1c b", "x\x85 y"]
    got = [np.frombuffer(x, "<u4") for x in own.encode(some)]
    assert [x.tolist() for x in got] == [library.encode_ordinary(t) for t in some]
    flat, offs = np.concatenate(got), np.concatenate(([0], np.cumsum([len(x) for x in got])))
    out, cuts = own.decode(flat, offs)
    assert [out[i:j].tobytes().decode() for i, j in zip(cuts[:-1], cuts[1:])] == some
    with pytest.raises(ValueError):
        own.decode(np.array([own.n]), np.array([0, 1]))


def merged(piece, ranks):
    """Ids of a piece by the merges one after another."""
    parts = [bytes([b]) for b in piece]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@pytest.mark.parametrize("seed", range(4))
def test_codec_equals_merges_of_small_vocabularies(seed):
    """Random vocabularies, in which some tokens are made by no merge."""
    rng = random.Random(seed)
    ranks = {bytes([b]): b for b in range(256)}
    known = [b"a", b"b", b"c"]
    for k in range(256, 300):
        token = rng.choice(known) + rng.choice(known)
        if token not in ranks:
            ranks[token] = k
            known.append(token)
    ranks[b"abcabcacbb"] = 999  # hardly reached by merges
    own = byte_pairs.Codec(ranks, "[abc]+|[^abc]+")
    some = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 90))) for _ in range(300)] + ["abcabcacbb", "abcabcacbba"]
    want = [[ranks[t.encode()]] if t.encode() in ranks else merged(t.encode(), ranks) for t in some]
    if len(own.made) == len(ranks):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(some)] == want
    else:  # a token that no merge makes can still be met by its own rank: only whole pieces are compared
        assert [np.frombuffer(own.encode([t])[0], "<u4").tolist() for t in some if t.encode() in ranks] == [w for t, w in zip(some, want) if t.encode() in ranks]


def test_byte_pairs(spark, texts, pair):
    _, library = pair
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    rows = byte_pairs.digest(byte_pairs.decode(byte_pairs.encode(documents(spark, texts)))).collect()
    ids = byte_pairs.codec(path, P.PATTERN)
    want = []
    for i, t in texts:
        raw = ids.encode([t])[0]
        want.append((i, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    assert byte_pairs.digest(byte_pairs.decode(byte_pairs.encode(documents(spark, texts[:0], 1)))).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, [])], byte_pairs.ENCODED)
    assert sorted((r.doc_id, r.decoded) for r in byte_pairs.decode(nulls).collect()) == [(1, None), (2, b"")]


def test_byte_pairs_take_one_worker_a_task(spark, texts):
    """The codec and its words would otherwise come to lie in the workers of three operators."""
    docs = documents(spark, texts)
    whole = byte_pairs.round_trip(docs)
    assert whole._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    apart = byte_pairs.digest(byte_pairs.decode(byte_pairs.encode(docs)))
    key = lambda r: tuple(map(str, r))
    assert whole.columns == apart.columns and sorted(whole.collect(), key=key) == sorted(apart.collect(), key=key)
    assert byte_pairs.round_trip(documents(spark, texts[:0], 1)).collect() == []


# op11


def vectors(n, dims=12, labels=4, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels * 2, dims))
    x = (centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dims)) * 0.6).astype(np.float32) * 0.4
    return [(i, [float(v) for v in x[i]], int(rng.integers(0, labels))) for i in range(n)]


def mined(rows, anchor, positives=5, negatives=3, low=50, high=95):
    held = []
    for uid, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            held.append((uid, i, label, [math.floor(256 * c) for c in v]))
    out = []
    for uid, i, label, v in held:
        if not anchor(i):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, u, other) for u, j, other, w in held if u != uid))
        for s, j, _, _ in [x for x in scored if x[3] == label][:positives]:
            fits = [(n, k) for n, k, _, other in scored if other != label and low * -s <= 100 * -n <= high * -s]
            out += [(i, j, rank + 1, k, -s, -n) for rank, (n, k) in enumerate(fits[:negatives])]
    return sorted(out)


def run_mine(spark, rows, modulus, **options):
    table = spark.createDataFrame([(*r, 1, "x", 7) for r in rows], "vec_id long, embedding array<float>, label int, uid int, parts string, score int").repartition(4)
    return sorted(map(tuple, hard_negatives.mine(hard_negatives.prepare(table), table_mod(modulus), **options).collect()))


def table_mod(modulus):
    from pyspark.sql import functions as F

    return F.col("vec_id") % modulus == 0


@pytest.mark.parametrize("dims", [1, 12, 70])
def test_mines_like_brute_force(spark, dims, monkeypatch):
    if dims == 12:  # anchors are shuffled instead of broadcast
        monkeypatch.setattr(runtime, "SMALL", 0)
    rows = vectors(700, dims)
    assert run_mine(spark, rows, 20) == mined(rows, lambda i: i % 20 == 0)


def test_mines_hard_tables(spark):
    rng = random.Random(1)
    rows = vectors(60, 5)
    bad = [(None, [1.0] * 5, 1), (900, None, 1), (910, [1.0] * 5, None), (920, [1.0, None, 0.0, 0.0, 0.0], 1), (930, [float("nan")] + [0.0] * 4, 1), (940, [float("inf")] + [0.0] * 4, 1)]
    copies = [(200 + i, rows[0][1], rng.randrange(4)) for i in range(40)]  # ties
    short = [(300, rows[1][1][:2], 1), (310, [], 2), (320, [0.0] * 5, 3)]
    table = rows + bad + copies + short
    assert run_mine(spark, table, 10) == mined(table, lambda i: i % 10 == 0)
    assert run_mine(spark, table, 10, sample_rows=3, n_positives=2, n_negatives=1, low=80) == mined(table, lambda i: i % 10 == 0, 2, 1, 80)
    assert run_mine(spark, [], 10) == []
    assert run_mine(spark, bad, 10) == []
    twice = rows[:30] + rows[:1]  # a row is met by its copy, which is a positive of it
    got = run_mine(spark, twice, 7)
    assert [r for r in got if r[0] == 0] and got == mined(twice, lambda i: i % 7 == 0)


def test_bounds_discard_but_lose_nothing():
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(size=(500, 32)) * (300 / np.arange(1, 33))).astype(np.int64)
    axes = np.linalg.eigh((x[:200].T @ x[:200]).astype(float))[1][:, ::-1]
    row = lambda part: {"size": len(part), "dims": 32, "uids": np.arange(len(part)).tobytes(), "ids": np.arange(len(part)).tobytes(), "labels": np.zeros(len(part), np.int64).tobytes(), "parts": part.tobytes()}
    a, b = hard_negatives.Block(row(x[:50]), axes), hard_negatives.Block(row(x), axes)
    exact = x[:50] @ x.T
    least, most = np.quantile(exact, 0.97, axis=1).astype(np.int64), np.quantile(exact, 0.99, axis=1).astype(np.int64)
    allowed = np.ones((50, 500), bool)
    i, j, score = hard_negatives.survivors(a, b, slice(0, 500), allowed, least, most)
    assert (score == exact[i, j]).all()
    found = set(zip(i.tolist(), j.tolist()))
    wanted = set(zip(*(v.tolist() for v in np.nonzero((exact >= least[:, None]) & (exact <= most[:, None])))))
    assert wanted <= found and len(found) < 0.2 * exact.size


# op13


def ranked(texts, items, k=20):
    docs = [(i, Counter(words), len(words)) for i, t in texts for words in [terms(t)]]
    n_docs, total = sum(n > 0 for *_, n in docs), sum(n for *_, n in docs)
    df = Counter(w for _, c, _ in docs for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in docs:
            m = 75 + 25 * n * n_docs // max(total, 1)
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * m)) for w, r in Counter(terms(text)).items() if c[w])
            if score > 0:
                scores.append((-score, i is not None, i or 0))
        out += [(item, rank + 1, d if there else None, -s) for rank, (s, there, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


@pytest.mark.parametrize("shard_bytes", [1, 3000, 1 << 23])
def test_search_equals_brute_force(spark, texts, shard_bytes, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEMS", 4)
    monkeypatch.setattr(lexical_search, "_NODES", 3)
    if shard_bytes == 3000:  # queries are shuffled instead of broadcast
        monkeypatch.setattr(runtime, "SMALL", 0)
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice([t for _, t in texts if t])[:60] for _ in range(2))) for i in range(9)]
    items += [(20, None), (21, ""), (22, "nowhere to be seen"), (23, "w1"), (23, "w1 w1 W1 w2"), (None, "w3 éa Éa")]
    docs = documents(spark, texts)
    table = spark.createDataFrame([(i, t, "x", 3) for i, t in items], "item_id long, text string, term string, item int").repartition(2)
    n_docs, n_terms = lexical_search.corpus_size(docs)
    assert n_docs == sum(bool(terms(t)) for _, t in texts) and n_terms == sum(len(terms(t)) for _, t in texts)
    index = lexical_search.build_index(docs, n_docs, n_terms, shard_bytes).cache()
    got = lexical_search.search(index, lexical_search.query_terms(table), n_docs).collect()
    assert sorted(map(tuple, got), key=str) == ranked(texts, items)


def test_search_of_empty_tables(spark, texts):
    docs, none = documents(spark, texts[:5]), documents(spark, [], 1)
    items = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    assert lexical_search.corpus_size(none) == (0, 0)
    assert lexical_search.search(lexical_search.build_index(none, 0, 0), lexical_search.query_terms(items), 0).collect() == []
    size = lexical_search.corpus_size(docs)
    assert lexical_search.search(lexical_search.build_index(docs, *size), lexical_search.query_terms(items.limit(0)), size[0]).collect() == []


def test_search_of_one_large_shard():
    """Random postings: the matrix's ranges, impacts and best documents, at several numbers of documents."""
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 64, 65, 1000):
        tf = rng.integers(0, 4, (n, 30)) * (rng.random((n, 30)) < 0.5)
        texts_ = [" ".join(f"t{w}" for w in range(30) for _ in range(tf[d, w])) for d in range(n)]
        items = [" ".join(f"t{w}" for w in rng.integers(0, 32, 6)) for _ in range(10)]
        assert ranked(list(enumerate(texts_)), list(enumerate(items)), 3) == _one_shard(texts_, items, 3)


def _one_shard(texts_, items, k):
    import pyarrow as pa
    from types import SimpleNamespace

    from lexweave.llm import words

    terms_ = [terms(t) for t in texts_]
    n_docs, total = sum(bool(t) for t in terms_), sum(map(len, terms_))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts_)), pa.int64()), pa.array(texts_)], ["doc_id", "text"])
    held = {}

    class Frame:
        sparkSession = SimpleNamespace(conf=SimpleNamespace(get=lambda key: "100", set=lambda *a: None))

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            held["run"] = run

    import pyspark

    with pytest.MonkeyPatch.context() as m:
        m.setattr(lexical_search, "_texts", lambda docs, key: docs)
        m.setattr(pyspark.TaskContext, "get", staticmethod(lambda: SimpleNamespace(partitionId=lambda: 0)))
        lexical_search.build_index(Frame(), n_docs, total)
        row = next(iter(held["run"](iter([batch])))).to_pylist()[0]
    out = []
    for item, text in enumerate(items):
        count = Counter(terms(text))
        df = {w: sum(w in t for t in terms_) for w in count}
        asked = {}
        for w in count:
            data, offs = words.column(pa.array([w]))
            asked[int(words.hash_terms(data, offs)[0][0])] = count[w] * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
        known = np.array(sorted(asked), np.uint64)
        shard = lexical_search.Shard(row, known)
        score, doc = shard.best(np.arange(len(known)), np.array([asked[int(x)] for x in known]), k, 1)
        out += [(item, rank + 1, int(shard.ids[d]), int(s)) for rank, (s, d) in enumerate(sorted(zip(score, doc), key=lambda x: (-x[0], x[1])))]
    return sorted(out, key=str)
