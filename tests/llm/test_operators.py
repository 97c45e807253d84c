"""Each operator against brute force on small tables, and on hard ones: nulls, empty and long texts, repeats, ties, empty tables, clashing columns."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lexweave.llm import (
    decontamination,
    html_text,
    language_id,
    near_duplicates,
    packing,
    quality_model,
    quality_rules,
    substring_dedup,
    token_files,
    tokenization,
    toxicity,
    words,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, part int, keys string, label string"


def prose(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def hard():
    """Documents with every hard case; the last columns clash with names used inside."""
    rng = random.Random(5)
    texts = [prose(rng, 60) for _ in range(12)]
    shared = prose(rng, 30, 10_000)
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3]) for i, t in enumerate(texts)]
    rows += [(20, None, None, None), (21, "", "en", "a"), (22, " \n\t ", "en", "a"), (23, "one", "en", "b"), (24, "éß \U0001f600 x y", "de", "b")]
    rows += [(30, texts[0], "en", "a"), (31, texts[0] + " tail", "en", "a"), (None, texts[1], "en", "a"), (None, None, None, None)]
    rows += [(40, texts[2] + " " + shared, "en", "a"), (41, shared + " " + texts[3], "en", "b"), (5, texts[5], "en", "b")]
    rows += [(50, prose(rng, 30_000), "en", "a"), (51, "a" * 300_000, "en", "b"), (52, "a b c d e " * 40, "en", "b"), (53, "a  b\n\n c <|endoftext|> d ", "en", "b")]
    return [(d, t, lang, s, len(t or ""), 0.5, 1, "k", "l") for d, t, lang, s in rows]


@pytest.fixture(scope="module")
def docs(spark, hard):
    return spark.createDataFrame(hard, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(text):
    enc = tokenization.encoder(tokenization.default_path())
    return enc.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_word_hashes_follow_the_words(hard):
    texts = [r[1] for r in hard]
    data, offs = words.column(pa.array(texts))
    h, starts, ends, first = words.hash_words(data, offs)
    raw = data.tobytes()
    found = [raw[a:b] for a, b in zip(starts, ends)]
    expected = [w.encode() for t in texts for w in WORD.findall(t or "")]
    assert found == expected
    assert list(np.diff(first)) == [len(WORD.findall(t or "")) for t in texts]
    by_word = {}
    for w, x in zip(found, h):
        assert by_word.setdefault(w, x) == x
    assert len(set(by_word.values())) == len(by_word)


def test_encoder_equals_the_library():
    texts = ["", "a", " a", "a b\nc", "a  b", "x ", "it's, isn't it? 12 345", "été ß", "tab\tand \n mix", "a <|endoftext|> b", None] * 3
    got = list(tokenization.Encoder(tokenization.default_path()).encode_all(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ids_of(t) for t in texts]


def test_encoder_remembers_what_it_is_told_to():
    """The pipeline's workers have little room: less is remembered there, with the same ids."""
    small, large = tokenization.Encoder(tokenization.default_path(), cache_size=100), tokenization.Encoder(tokenization.default_path())
    for k in range(12):
        texts = [" ".join(f"w{k}x{i}" for i in range(50)), "a b w0x1"]
        assert list(small.encode_all(texts)) == list(large.encode_all(texts))
    assert len(small.young) + len(small.old) <= 2 * (100 + 52) < len(large.young)
    assert corpus_pipeline.CACHED_PIECES < tokenization.CACHE_SIZE


def test_token_files_round_trip(spark, docs, hard, empty, tmp_path):
    path = str(tmp_path / "t")
    token_files.write_token_files(docs, path, n_files=3, row_group_bytes=1 << 20)
    got = token_files.token_digest(spark, path).collect()
    order = sorted(hard, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    expected, start = [], 0
    for d, t, *_ in order:
        ids = ids_of(t) + [2]
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    import pyarrow.parquet as pq

    some = next((tmp_path / "t").glob("part-*"))
    chunk = {c["path_in_schema"]: c for c in (pq.ParquetFile(some).metadata.row_group(0).column(i).to_dict() for i in range(5))}
    ids = next(c for k, c in chunk.items() if k.startswith("ids"))
    assert any("DICTIONARY" in e for e in ids["encodings"]) and "DELTA_BINARY_PACKED" in chunk["doc_id"]["encodings"]
    plan = token_files.metadata(spark, path)._jdf.queryExecution().toString()
    assert "ids:array" not in plan.split("ReadSchema")[1]
    token_files.write_token_files(empty, str(tmp_path / "e"))
    assert token_files.token_digest(spark, str(tmp_path / "e")).count() == 0


def test_packing_covers_every_token_once(docs, hard, empty):
    pieces = packing.pack(docs, part_tokens=20_000).collect()
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0
    got = Counter((p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces)
    total = 0
    for d, t, *_ in hard:
        ids, at = np.array(ids_of(t) + [0], "<u4"), 0
        total += len(ids)
        while at < len(ids):
            own = [k for k in got if k[0] == d and k[1] == at and k[4] == len(ids) and k[3] == zlib.crc32(ids[at : at + k[2]].tobytes())]
            assert own
            got[own[0]] -= 1
            got += Counter()
            at += own[0][2]
    assert not got and sum(p["length"] for p in pieces) == total
    assert packing.pack(empty).count() == 0


def test_packing_keeps_to_the_target_shares(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(20, 600)), "a" if i % 3 else "b") for i in range(600)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), targets={"a": 1, "b": 1}, part_tokens=1 << 30).orderBy("sequence_id").collect()
    n = Counter()
    for k, p in enumerate(pieces):
        n[p["source"]] += p["length"]
        if n["a"] + n["b"] > 50_000:
            break
    assert abs(n["a"] - n["b"]) <= 2 * 1024


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header class="site-header"><a href=/>Home</a></header>
<nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id=main><h1>Head &amp; line</h1><p>First <b>bo</b>ld paragraph   with
 many words in it, and more of them.<p>Second&nbsp;one, not closed<br>after break, with enough words to count.
<script>var x = "<p>no</p>";</script><!-- <p>no</p> --><form><input name=q>Search</form></div>
<aside>Side links and things</aside><div class="comments"><p>Reader says a very long thing that goes on and on, longer than all the text of the page, to be sure of it.</p></div><footer>Foot</footer></body></html>"""


def test_html_text(spark):
    assert html_text.main_text(PAGE) == "Head & line First bold paragraph with many words in it, and more of them. Second one, not closed after break, with enough words to count."
    for bad in (None, "", "<", "<p", "<!--", "<script>x", "plain", "<a b='", "&#xD800; &#0; &bogus;", "<div>" * 3000 + "deep" + "</div>" * 10):
        assert isinstance(html_text.main_text(bad), str)
    assert html_text.main_text("plain &lt;text&gt;") == "plain <text>"
    assert html_text.main_text("<article><p>a" + "<p>b" * 3 + "</article><div>other text outside of it</div>") == "a b b b"
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "", "y")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"] == len(r["text"])) for r in got) == [(0, True), (1, True), (1, True), (2, True)]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


PARAGRAPH = "<p>A paragraph of running text, long enough to be one of an article, with <i>some</i> words in it.</p>"
PLAIN = "A paragraph of running text, long enough to be one of an article, with some words in it."


def test_html_text_without_names(monkeypatch):
    """No tag, role or class helps here: menu, notice, side links and footer go by their density."""
    for names in ("_BAD_TAG", "_BAD_ROLE", "_BAD_NAME", "_WEAK_NAME", "_SITE_HEAD", "_CONTENT"):
        monkeypatch.setattr(html_text, names, set())
    page = f"""<body><div><a href=1>Home</a> <a href=2>News</a> <a href=3>About us</a></div><div>Sunny today.</div>
    <div><h2>Head</h2>{PARAGRAPH * 3}<p>Short.</p><div><a href=1>More</a> <a href=2>Even more of it</a></div>{PARAGRAPH}</div><div>Copyright 2020 Some Firm</div></body>"""
    assert html_text.main_text(page) == " ".join(["Head", PLAIN, PLAIN, PLAIN, "Short.", PLAIN])
    assert html_text.main_text("<div><a href=1>Home</a> <a href=2>News</a></div><div>" + "Long text without a further element in it. " * 5 + "</div><div>Copyright 2020</div>") == ("Long text without a further element in it. " * 5).strip()
    nested = f"<body><table><tr><td><a href=1>One</a><a href=2>Two</a></td><td><div>{PARAGRAPH * 4}</div><div>{PARAGRAPH * 4}</div></td></tr></table></body>"
    assert html_text.main_text(nested) == " ".join([PLAIN] * 8)
    listed = f"<body><div>{PARAGRAPH * 4}</div><div>{'<div>One item</div>' * 20}</div></body>"
    assert html_text.main_text(listed) == " ".join([PLAIN] * 4)
    flat = lambda *a: float(a[0] > 0)
    monkeypatch.setattr(html_text, "composite_density", flat)
    assert html_text.main_text(listed) != " ".join([PLAIN] * 4)


def test_html_names_are_a_prior():
    wrapped = f"<form><div class='legal notice'>{PARAGRAPH * 2}</div></form><div class='notice'>We use cookies.</div>"
    assert html_text.main_text(wrapped) == f"{PLAIN} {PLAIN}"
    assert html_text.main_text(f"<article>{PARAGRAPH}<div class=comments>{PARAGRAPH * 5}</div></article>") == PLAIN
    assert html_text.main_text(f"<div>{PARAGRAPH}<div hidden>{PARAGRAPH}</div></div>") == PLAIN
    assert html_text.main_text("<p>" + "İ" * 60 + "</p><SCRIPT>x='</p>'</Script ><p>after the script</p>") == "İ" * 60 + " after the script"


def test_html_densities_are_those_of_whole_subtrees():
    import math

    rng = random.Random(9)
    for _ in range(30):
        source, open_tags = [], []
        for _ in range(40):
            if open_tags and rng.random() < 0.4:
                source.append(f"</{open_tags.pop()}>")
            elif rng.random() < 0.5:
                open_tags.append(rng.choice(["div", "section", "a", "span"]))
                source.append(f"<{open_tags[-1]}>")
            else:
                source.append("x" * rng.randrange(1, 30))
        page = html_text._Page("".join(source))
        got, n = html_text._Densities(page), len(page.tag)
        below = lambda i: [j for j in range(n) if i <= j < page.end[j] and (i == 0 or j < page.end[i])]

        def up(i):
            return [i] + up(page.parent[i]) if i >= 0 else []

        length = lambda nodes, link: sum(len(t.strip()) for k, t in page.texts if t != "\n" and k in nodes and (not link or any(page.tag[x] == "a" for x in up(k))))
        whole = length(set(range(n)), True) / max(length(set(range(n)), False), 1)
        for i in range(n):
            nodes = {j for j in range(n) if i in up(j)}
            c, lc, t, lt = length(nodes, False), length(nodes, True), len(nodes), sum(page.tag[j] == "a" for j in nodes)
            base = max(2.0, math.log(c / max(c - lc, 1) * lc + whole * c + math.e))
            expected = c / t * math.log(max(1.0001, c / max(lc, 1) * t / max(lt, 1))) / math.log(base) if c else 0.0
            assert math.isclose(got.density[i], max(expected, 1e-9) if c else 0.0, rel_tol=1e-9)
            kids = [j for j in range(n) if page.parent[j] == i]
            assert math.isclose(got.sums[i], sum(got.density[j] for j in kids) or got.density[i], rel_tol=1e-9)


def test_html_trees_follow_open_and_close_tags():
    def tree(source):
        page = html_text._Page(source)
        return [(t, page.tag[p]) for t, p in zip(page.tag[1:], page.parent[1:])]

    assert tree("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == [("ul", "#root"), ("li", "ul"), ("li", "ul"), ("ul", "li"), ("li", "ul"), ("li", "ul")]
    assert tree("<table><tr><td>a<td>b<tr><td>c</table>x") == [("table", "#root"), ("tr", "table"), ("td", "tr"), ("td", "tr"), ("tr", "table"), ("td", "tr")]
    assert tree("<p>a<p>b<div>c</p></div>") == [("p", "#root"), ("p", "#root"), ("div", "#root")]
    assert tree("<b><div>x</b>y</div></b><i>z") == [("b", "#root"), ("div", "b"), ("i", "#root")]
    assert tree("<div></section></span>x<br/><img><p>y") == [("div", "#root"), ("img", "div"), ("p", "div")]


@pytest.mark.parametrize("shape", [("<div>", "</p></span>x"), ("<span>", "<p>x"), ("", "a <b "), ("<i><div>", "</i>"), ("<div>", "<div>x y z</div>")])
def test_html_time_is_linear(shape):
    import time

    def seconds(n):
        t = time.process_time()
        html_text.main_text(shape[0] * n + shape[1] * n)
        return time.process_time() - t

    seconds(200)
    assert seconds(16_000) < 12 * max(seconds(4_000), 0.02)


def test_toxicity(spark, docs, empty):
    assert toxicity.fold("1DІOT") == "idiot" and toxicity.fold("Ｉdiot 2020") == "idiot 2020" and toxicity.fold(None) == ""
    lex = toxicity.Lexicon({"idiot": 5.0, "scum*": 4.0}, ("scum line",), slope=4.0, intercept=-2.0)
    auto = lex.automaton()
    count = lambda t: toxicity.hits(toxicity.fold(t), auto)[1]
    assert [count(t) for t in ("an idiot", "idiotic", "midiot", "scummy 1d10t", "the scum line here", "")] == [1, 0, 0, 2, 0, 0]
    rng = random.Random(2)
    rows = [(i, prose(rng, 50) + (" nasty" + rng.choice(["er", "est", ""]) if i % 4 == 0 else "") + " " + prose(rng, 50)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(table, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 400 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert held and all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held)
    assert toxicity.toxicity(docs, labels).count() == docs.count() and toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).where("score is null").count() == 0


def test_near_duplicates(spark, docs, hard, empty):
    rng = random.Random(3)
    base = [prose(rng, 120, 50_000).split() for _ in range(25)]
    rows = list(enumerate(" ".join(b) for b in base))
    for k in range(120):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 3, 6])):
            b[rng.randrange(len(b))] = f"x{rng.randrange(10**6)}"
        rows.append((100 + k, " ".join(b)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.classes(table).collect()}
    weights = near_duplicates.Weights(*near_duplicates.frequent_shingles(table, 5, 0.01), 0.01)
    grams = {d: Counter(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for d, t in rows}
    df = Counter(g for c in grams.values() for g in c)
    idf = {g: 1 + np.log(1 / min(1, max(0.01, n / len(rows)))) / np.log(100) for g, n in df.items()}
    text = dict(rows)
    parent = {d: d for d in text}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for b, _ in rows[i + 1 :]:
            x, y = grams[a], grams[b]
            least = sum(idf[g] * min(n, y[g]) for g, n in x.items())
            j = least / (sum(idf[g] * n for g, n in x.items()) + sum(idf[g] * n for g, n in y.items()) - least)
            assert abs(j - near_duplicates.weighted_jaccard(pa.array([text[a]]), pa.array([text[b]]), weights, 5)[0]) < 1e-9 if i < 3 else True
            if j >= 0.8:
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    assert got == {d: find(d) for d in text}
    special = near_duplicates.classes(docs).collect()
    assert len(special) == len(hard) and near_duplicates.classes(empty).count() == 0
    named = {r["doc_id"]: r["class_id"] for r in special}
    assert named[30] == 0 and named[20] == 20 and named[21] == 21 and named[22] == 22 and named[None] is None
    assert near_duplicates.deduplicate(docs).columns == docs.columns


def test_near_duplicates_among_many_variants(spark):
    rng = random.Random(11)
    base = [f"t{i}" for i in range(204)]

    def edited(words, k):
        words = list(words)
        for i in rng.sample(range(5, 199), k):
            words[i] = f"x{rng.randrange(10**9)}"
        return words

    texts = [edited(base, 3) for _ in range(1000)]
    texts += [edited(rng.choice(texts[:1000]), 3) for _ in range(300)]
    rng.shuffle(texts)
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    weights = near_duplicates.Weights(*near_duplicates.frequent_shingles(table, 5, 0.01), 0.01)
    sets = near_duplicates.weighted_sets(pa.array([" ".join(t) for t in texts]), weights, 5)
    names, at = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
    shares = np.zeros((len(texts), len(names)), np.float32)
    shares[np.repeat(np.arange(len(texts)), [len(h) for h, _ in sets]), at] = np.sqrt(np.concatenate([w for _, w in sets]))
    least = shares @ shares.T
    total = np.diag(least)
    keys = {r["doc_id"]: r["keys"] for r in near_duplicates.band_keys(table, weights, 5, 16, 4).collect()}
    bands = np.array([keys[i] for i in range(len(texts))])
    linked = (least / (total[:, None] + total - least) >= 0.8) & (bands[:, None] == bands).any(2)
    label = np.arange(len(texts))
    while True:
        new = np.where(linked, label, len(texts)).min(1)
        if (new == label).all():
            break
        label = new
    assert len(set(label.tolist())) < 1300
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates.classes(table).collect()}
    assert got == dict(enumerate(label.tolist()))


@pytest.mark.parametrize("limits", [(4000, 4_000_000, 1000, 2_000_000), (3, 4_000_000, 1, 2_000_000), (3, 100, 1000, 2_000_000), (5, 4_000_000, 4, 0)])
def test_frequent_shingles_are_all_frequent_ones(spark, monkeypatch, limits):
    """However documents are dealt and grouped, counted by broadcast or by join."""
    for name, v in zip(("GROUP_DOCS", "GROUP_SHINGLES", "LEAST_DOCS", "BROADCAST_SHINGLES"), limits):
        monkeypatch.setattr(near_duplicates, name, v)
    rng = random.Random(12)
    common = [prose(rng, 8, 10_000) for _ in range(4)]
    texts = [" ".join([prose(rng, 20, 10_000), *(c for k, c in enumerate(common) if rng.random() < 0.05 * (k + 1))]) for _ in range(150)] + [None, ""]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    keys, freq = near_duplicates.frequent_shingles(table, 5, 0.1)
    df = Counter(h for _, _, doc, h, _ in near_duplicates.shingle_counts(pa.array(texts), 5) for h in h.tolist())
    expected = {h: n / len(texts) for h, n in df.items() if n >= 0.1 * len(texts)}
    assert expected and dict(zip(keys.tolist(), freq)) == expected


def test_links_between_are_those_of_all_pairs():
    rng = np.random.RandomState(4)
    sets = []
    for _ in range(40):
        h = np.sort(rng.choice(60, rng.randint(1, 50), replace=False)).astype(np.uint64)
        sets.append((h, rng.choice([1.0, 2.0, 1.3], len(h))))

    def similar(x, y):
        a, b = (dict(zip(h.tolist(), w)) for h, w in (sets[x], sets[y]))
        least = sum(min(w, b.get(k, 0)) for k, w in a.items())
        return least / (sum(a.values()) + sum(b.values()) - least)

    for cut in (0, 15):
        got = near_duplicates.links_between(sets, np.arange(40), cut, 0.4)
        assert got and all(similar(x, y) >= 0.4 for x, y in got)
        label = np.arange(40)
        for x, y in got:
            label[label == label[y]] = label[x]
        pairs = [(x, y) for x in range(cut or 40) for y in range(cut or x + 1, 40)]
        assert all(label[x] == label[y] for x, y in pairs if similar(x, y) >= 0.4)


def test_samples_estimate_weighted_jaccard():
    rng = np.random.RandomState(0)
    names = rng.randint(0, 2**62, 300).astype(np.uint64)
    a, b = np.sort(names[:220]), np.sort(names[60:])
    v, w = rng.choice([1.0, 2.0, 4.0, 1.3], len(a)), rng.choice([1.0, 2.0, 4.0, 1.3], len(b))
    s = near_duplicates.samples(a, v, np.array([0]), 2048)
    t = near_duplicates.samples(b, w, np.array([0]), 2048)
    x, y = dict(zip(a.tolist(), v)), dict(zip(b.tolist(), w))
    least = sum(min(x[k], y.get(k, 0)) for k in x)
    assert abs((s == t).mean() - least / (v.sum() + w.sum() - least)) < 0.04


def brute_substrings(rows, n=13):
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = {i + k for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < d for k in range(n)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("chunk_bytes", [200, 5_000, 1 << 20])
def test_substring_dedup(spark, docs, hard, empty, chunk_bytes):
    big = np.iinfo(np.int64).max
    rows = [(r[0] if r[0] is not None else big, r[1]) for r in hard if len(r[1] or "") < 100_000]
    table = docs.where("text is null or length(text) < 100000")
    got = substring_dedup.substring_dedup(table, chunk_bytes=chunk_bytes)
    assert got.columns == [*docs.columns, "n_words", "n_removed"]
    found = sorted((r["doc_id"] if r["doc_id"] is not None else big, r["n_words"], r["n_removed"], r["text"]) for r in got.collect())
    assert found == sorted(brute_substrings(rows))
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_substring_layout_stays(docs):
    kept = {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs, keep_layout=True).collect()}
    assert kept[20]["text"] is None and kept[22]["text"] == " \n\t " and kept[51]["text"] == "a" * 300_000 and kept[30]["text"] == ""


def test_decontamination(spark, docs, empty):
    rng = random.Random(4)
    items = [(i, prose(rng, n, 5_000)) for i, n in enumerate([5, 9, 20, 40, 60, 60])] + [(7, None), (8, "too short"), (9, "")]
    rows = []
    for d in range(80):
        t = prose(rng, rng.choice([3, 30, 300, 2000]), 5_000).split()
        if d % 3 == 0:
            w = items[d % 6][1].split()
            for _ in range(rng.choice([0, 0, 1, 4])):
                w[rng.randrange(len(w))] = "zz"
            k = rng.randrange(len(t))
            t[k:k] = [x.upper() + "," for x in w]
        rows.append((d, " ".join(t)))
    rows += [(None, items[3][1]), (500, items[3][1]), (500, items[3][1]), (501, None), (502, "")]
    gram = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"\w+", (t or "").lower())] for i in range(len(w) - 4)}
    expected = {(d, i) for d, t in rows for i, q in items if gram(q) and len(gram(q) & gram(t)) / len(gram(q)) >= 0.8}
    table = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated(table, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == expected and len(got) == len(expected)
    clean = decontamination.decontaminate(table, bench)
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in clean.collect()) == sorted((False, d) for d, _ in rows if d is not None and d not in {x for x, _ in expected})
    assert decontamination.decontaminate(docs, bench).count() == docs.count()
    mixed = [(None, items[3][1]), (None, "a clean text without an id, of some words"), (None, None), (7, items[4][1]), (7, "a clean text of the same id, of some words")]
    left = decontamination.decontaminate(spark.createDataFrame(mixed, "doc_id long, text string"), bench).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == sorted((d or 0, t or "") for k, (d, t) in enumerate(mixed) if k not in (0, 3))
    assert decontamination.contaminated(empty, bench).count() == 0 and decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_forward_sums_all_segmentations():
    vocab = language_id.vocabulary(language_id.default_path())
    rng = np.random.RandomState(0)
    prob = np.vstack((rng.dirichlet(np.ones(len(vocab.pieces)), 2).T, np.zeros((1, 2))))
    index = {p: k for k, p in enumerate(vocab.pieces)}

    def brute(w):
        if not w:
            return np.ones(2)
        return sum((prob[index[w[:k]]] * brute(w[k:]) for k in range(1, len(w) + 1) if w[:k] in index), np.zeros(2))

    for w in (b" the", b" zqx", " été".encode(), b" information"):
        m = np.frombuffer(w, np.uint8)[None, :]
        assert np.allclose(language_id.forward(m, vocab, prob)[0, -1], brute(w), rtol=1e-9)


def test_long_words_sum_all_segmentations():
    vocab = language_id.vocabulary(language_id.default_path())
    rng = np.random.RandomState(1)
    prob = np.vstack((np.maximum(rng.dirichlet(np.full(len(vocab.pieces), 0.1), 3).T, 1e-9), np.zeros((1, 3))))
    index = {p: k for k, p in enumerate(vocab.pieces)}

    def by_place(w):
        a = np.full((len(w) + 1, 3), -np.inf)
        a[0] = 0
        for e in range(1, len(w) + 1):
            from_ = [a[i] + np.log(prob[index[w[i:e]]]) for i in range(max(0, e - vocab.longest), e) if w[i:e] in index]
            a[e] = np.logaddexp.reduce(from_)
        return a[-1]

    letters = [*map(str, "etaoinshrdlu"), "é", "ñ", "中", "文"]
    some = ["".join(rng.choice(letters, n)).encode() for n in (5, 33, 40, 255, 256, 257, 700)] + [b"unterhaltungselektronik" * 30, b"a" * 2000]
    got = language_id.long_log_probs([np.frombuffer(w, np.uint8) for w in some], vocab, prob)
    assert np.allclose(got, [by_place(b" " + w) for w in some], rtol=1e-9)
    model = language_id.Model(["x", "y", "z"], prob, language_id.default_path())
    text = " ".join(w.decode() for w in some)
    data, offs = words.column(pa.array([text]))
    clean, starts, sizes, _, _ = language_id.distinct_words(data, offs)
    by_word = {bytes(clean[x : x + n]): v for x, n, v in zip(starts, sizes, model.word_log_probs(clean, starts, sizes))}
    assert set(by_word) == set(some) and all(np.allclose(by_word[w], by_place(b" " + w)) for w in some)
    assert all(len(p) <= language_id.SHORT for w in some for p in language_id._parts(w)) and all(b"".join(language_id._parts(w)) == w and [x.decode() for x in language_id._parts(w)] for w in some)


def test_language_id(spark, docs, empty):
    rng = random.Random(6)
    parts = {"xx": ["ka", "ri", "mo", "tel"], "yy": ["sch", "ung", "eit", "zu"], "zz": ["ño", "ción", "las", "que"]}
    rows = [(i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(rng.choice([4, 40]))), lang) for i in range(240) for lang in [list(parts)[i % 3]]]
    rows += [(900, None, "xx"), (901, "", "xx"), (902, "123 ... !", "yy"), (903, "中文", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(table)
    got = {r["doc_id"]: r for r in language_id.identify(table, model).collect()}
    assert len(got) == len(rows)
    assert all(got[d]["lang_pred"] == lang for d, _, lang in rows if d < 900)
    assert [got[d]["lang_pred"] for d in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] != "und"
    assert all(0 <= r["lang_score"] <= 1 for r in got.values())
    assert language_id.identify(docs, model).count() == docs.count() and language_id.identify(empty, language_id.train(empty)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, language_id.train(empty)).collect()} == {"und"}


def test_quality_model(spark, docs, empty):
    rng = random.Random(7)

    def text(grade):
        w = [f"{rng.choice('abcdefg')}{rng.choice('aeiou')}{rng.choice('klmn')}" for _ in range(60)]
        return " ".join(x + ("###" if rng.random() < (0.6, 0.25, 0.0)[grade] else "") for x in w)

    rows = [(i, text(i % 3)) for i in range(450)]
    model = quality_model.fit([t for _, t in rows[:300]], [i % 3 for i in range(300)], 3)
    assert (np.diff(model.thresholds) > 0).all()
    got = quality_model.rate(spark.createDataFrame(rows[300:], "doc_id long, text string"), model).collect()
    by = [np.mean([r["expected_grade"] for r in got if r["doc_id"] % 3 == g]) for g in range(3)]
    assert by[0] < by[1] < by[2]
    assert np.mean([r["kept"] == (r["doc_id"] % 3 > 0) for r in got]) > 0.95
    assert quality_model.rate(docs, model).count() == docs.count() and quality_model.rate(empty, model).count() == 0
    assert quality_model.fit([], [], 3).tails(np.zeros(1)).shape == (1, 2)


def test_quality_statistics(hard):
    texts = [r[1] for r in hard] + ["x\nx\n\n y\nx", "a b c d e a b c d e", "a|b $ %\n \n"]
    got = quality_rules.text_stats(pa.array(texts))
    for k, t in enumerate(texts):
        w = WORD.findall(t or "")
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {i + j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert [int(got[s][k]) for s in quality_rules.STATS] == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again)]


def test_quality_rules(spark, docs, hard, empty):
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(hard) and all(r["kept"] in (True, False) and not (r["kept"] and r["base_failed"]) for r in got)
    assert quality_rules.quality_rules(empty).count() == 0
    rng = np.random.RandomState(0)
    x = rng.multivariate_normal([0, 5], [[1, 0.9], [0.9, 1]], 600)
    x[:60] = [4, 1] + rng.normal(0, 0.1, (60, 2))
    rows = spark.createDataFrame([(i, "g", float(a), float(b)) for i, (a, b) in enumerate(x)] + [(1000, "few", 99.0, -99.0), (1001, None, 1.0, None)], "i int, g string, a double, b double")
    out = {r["i"]: r for r in quality_rules.mcd_outliers(rows, ["a", "b"], ["g"], cutoff=6.0).collect()}
    assert all(out[i]["outlier"] for i in range(60)) and not any(out[i]["outlier"] for i in range(60, 600))
    assert not out[1000]["outlier"] and not out[1001]["outlier"]
    few = spark.createDataFrame([(i, "g", "big", float(a), float(b)) for i, (a, b) in enumerate(x[60:])] + [(1000 + i, "g", "small", float(a), float(b)) for i, (a, b) in enumerate(x[60:80])] + [(2000, "g", "small", 9.0, -9.0), (2001, "h", None, 9.0, -9.0), (2002, "h", "small", 0.0, 5.0)], "i int, g string, s string, a double, b double")
    plain = {r["i"]: r for r in quality_rules.mcd_outliers(few, ["a", "b"], ["g", "s"], cutoff=6.0).collect()}
    wide = {r["i"]: r for r in quality_rules.mcd_outliers(few, ["a", "b"], ["g", "s"], cutoff=6.0, wider=(["g"], [])).collect()}
    assert len(wide) == 563 and {i for i, r in wide.items() if r["outlier"]} == {2000, 2001} and plain[2000]["outlier"] and not plain[2001]["outlier"]
    assert all(wide[i]["distance"] == plain[i]["distance"] for i in range(540))
    words_of = random.Random(8)
    mixed = [(i, prose(words_of, words_of.randrange(80, 120), 50_000), "en", "a" if i < 80 else "b") for i in range(100)]
    mixed.append((500, "Ja.&&& Lo%%% asdoci$$$ |||||| " * 2 + "###### <<<<<< >>>>>> $$$$$$ %%%%%% &&&&&&", "en", "b"))
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(mixed, "doc_id long, text string, lang string, source string")).collect()}
    assert not kept[500] and sum(kept.values()) == 100
    few_docs = [(i, prose(words_of, words_of.randrange(30, 300), 50_000), "en", "a") for i in range(9)] + [mixed[-1]]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(few_docs, "doc_id long, text string, lang string, source string")).collect()}
    assert not kept[500] and sum(kept.values()) == 9
    clean = x[60:]
    inv = np.linalg.inv(np.cov(clean.T))
    d = np.sqrt(np.einsum("ij,jk,ik->i", clean - clean.mean(0), inv, clean - clean.mean(0)))
    assert np.corrcoef(d, [out[i]["distance"] for i in range(60, 600)])[0, 1] > 0.97


def test_minimum_covariance_determinant_is_that_of_all_subsets(spark):
    """Small groups: the estimate's support has the least determinant of all subsets of its size; ties count in part."""
    from itertools import combinations

    rng = np.random.RandomState(5)
    rows, best = [], {}
    for g in range(6):
        x = rng.multivariate_normal([0, 0], [[1, 0.8], [0.8, 1]], 10)
        x[:2] += rng.choice([-1, 1], 2) * [6, 9]
        rows += [(g, float(a), float(b)) for a, b in x]
        subsets = [x[list(k)] for k in combinations(range(10), 8)]
        best[g] = min(np.linalg.det(np.cov(s.T, bias=True)) for s in subsets)
    rows += [(9, 1.0, 2.0)] * 6 + [(9, 2.0, 1.0)] * 6
    table = spark.createDataFrame(rows, "g int, a double, b double")
    got = quality_rules.mcd_outliers(table, ["a", "b"], ["g"], floors=[1e-6, 1e-6]).collect()
    for g in range(6):
        own = [r for r in got if r["g"] == g]
        x = np.array([(r["a"], r["b"]) for r in own])
        near = np.argsort([r["distance"] for r in own])[:8]
        assert np.isclose(np.linalg.det(np.cov(x[near].T, bias=True)), best[g], rtol=1e-6)
    assert len([r for r in got if r["g"] == 9]) == 12


@pytest.mark.parametrize("name", ["widget-content", "promo", "sidebar-main", "banner", "comment-thread"])
def test_no_name_takes_most_of_a_page(name):
    paragraph = "Several words of a long sentence that stands in a paragraph, with commas and more words."
    page = f"<html><body><div class='menu'><a href=1>a</a><a href=2>b</a></div><div class='{name}'>{f'<p>{paragraph}</p>' * 5}</div><div class='footer'>Copyright 2020</div></body></html>"
    assert html_text.main_text(page) == " ".join([paragraph] * 5)
    small = f"<html><body><div><p>{paragraph * 9}</p><p>{paragraph * 9}</p></div><div class='{name}'><p>{paragraph}</p></div></body></html>"
    assert html_text.main_text(small) == " ".join([paragraph * 9] * 2)
