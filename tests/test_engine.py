"""The normalization engine against hand-derived values and brute force."""

import math
import os
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.functions import unicode as U
from lexweave.operators import evaluate as E
from lexweave.operators import features as M
from lexweave.operators import predict as P
from lexweave.operators import sampling as G
from lexweave.operators import stats as S
from lexweave.plans import catalog as Q
from lexweave.sources import sentences as C

SF = "/root/testdata/sf0.001"


def sentences(spark, rows):
    return spark.createDataFrame([(i, lang, raw, norm) for i, (lang, raw, norm) in enumerate(rows)], C.SENTENCES)


def pairs(spark, counts, lang="es"):
    """Tokens of one sentence a pair occurrence, in the order of ``counts``: (raw, norm, n)."""
    rows = [(lang, [r], [n]) for r, n, k in counts for _ in range(k)]
    return C.tokens(sentences(spark, rows))


def evaluate(spark, expr, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("x")).first()[0]


@pytest.mark.parametrize(("norm", "expected"), [(None, {"N1": "w", "N2": "w", "N3": "", "N5": None}), ("", {"N1": "", "N2": "w", "N3": "", "N5": ""})])
def test_missing_gold(spark, norm, expected):
    for policy, value in expected.items():
        assert C.tokens(sentences(spark, [("es", ["w"], [norm])]), policy).first()["norm"] == value


def test_tokens_cut_to_the_shorter_array_and_keep_neighbours(spark):
    t = C.tokens(sentences(spark, [("es", ["a", "b", "c"], ["A", "B"]), ("es", ["x"], None), ("es", [], []), ("es", None, None)])).orderBy("sent_id", "pos").collect()
    assert [(r["raw"], r["norm"], r["prev"], r["next"], r["prev2"], r["next2"]) for r in t] == [("a", "A", "<BOS>", "b", "<BOS>", "<EOS>"), ("b", "B", "a", "<EOS>", "<BOS>", "<EOS>"), ("x", "x", "<BOS>", "<EOS>", "<BOS>", "<EOS>")]
    assert C.well_formed(sentences(spark, [("es", ["a"], ["A"]), ("es", ["a"], ["A", "B"]), ("es", [], [])])).count() == 1


@pytest.mark.parametrize(
    ("counts", "expected"),
    [
        ([("k", "che", 2), ("k", "k", 2)], ["k", "k", "k", "che", "che"]),
        ([("pk", "perché", 1), ("pk", "perche", 1)], ["perché", "perche", "perché", "perché", "perché"]),
        ([("ok", "ok", 3), ("ok", "okay", 1)], ["ok"] * 5),
    ],
)
def test_tie_rules(spark, counts, expected):
    c = S.pair_counts(pairs(spark, counts), ordinals=True)
    assert [S.most_frequent(c, tie=t).first()["pred"] for t in ("T1", "T2", "T3", "T4", "T5")] == expected


def test_metrics(spark):
    rows = spark.createDataFrame([("it", "a", "a", "a"), ("it", "b", "B", "B"), ("it", "c", "c", "x"), ("it", "d", "D", "d"), ("en", "q", "q", "q")], "lang string, raw string, norm string, pred string")
    got = {r["lang"]: r for r in E.metrics(rows).collect()}
    assert [got["it"][k] for k in ("total", "changed", "lai", "accuracy", "err", "changed_acc", "unchanged_acc", "over_change")] == [4, 2, 0.5, 0.5, 0.0, 0.5, 0.5, 0.5]
    assert got["en"]["err"] == 0.0 and got["en"]["changed_acc"] == 0.0
    d = {r["lang"]: r for r in E.detection_metrics(rows).collect()}["it"]
    assert (d["tp"], d["fp"], d["fn"], d["tn"], d["f1"]) == (1, 1, 1, 1, 0.5)


def test_entropy(spark):
    c = S.pair_counts(pairs(spark, [("q", "a", 2), ("q", "b", 1), ("q", "c", 1)]))
    assert abs(S.entropy(c).first()["entropy"] - 1.0397) < 1e-4 and S.entropy(c, base2=True).first()["entropy"] == 1.5


def brute_loo(counts):
    raws, pair = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    by = defaultdict(Counter)
    for r, n, k in counts:
        by[r][n] += k
    for r, c in by.items():
        for n, k in c.items():
            left = c - Counter([n])
            top = max(left.values(), default=0)
            best = [x for x, v in left.items() if v == top]
            w = r if not left or r in best else min(best)
            raws[r][0] += k
            raws[r][1] += k * (w == n)
            if w != r:
                pair[r, w][0] += k
                pair[r, w][1] += k * (w == n)
    return {k: tuple(v) for k, v in raws.items()}, {k: tuple(v) for k, v in pair.items()}


def test_leave_one_out(spark):
    rng = random.Random(0)
    cases = [[("q", "que", 3), ("q", "q", 1)], [("q", "que", 2), ("q", "q", 1)], [("z", "y", 1)]]
    cases += [[(r, n, k) for r in "abc" for n in ("a", "b", "x", "y") if (k := rng.randrange(4))] for _ in range(3)]
    for counts in cases:
        c = S.pair_counts(pairs(spark, counts))
        raws, by_pair = brute_loo(counts)
        assert {r["raw"]: (r["total"], r["correct"]) for r in S.loo_raw(c).collect()} == raws
        assert {(r["raw"], r["cand"]): (r["total"], r["correct"]) for r in S.loo_pair(c).collect()} == by_pair


@pytest.mark.parametrize(
    ("expr", "values", "expected"),
    [
        (lambda: X.collapse("a", 2), {"a": "graciaaas"}, "graciaas"),
        (lambda: X.collapse("a", 1), {"a": "aaaa"}, "a"),
        (lambda: X.collapse("a", 2), {"a": "book"}, "book"),
        (lambda: X.collapse("a", 1), {"a": "book"}, "bok"),
        (lambda: X.make_key("a"), {"a": "Però’"}, "pero'"),
        (lambda: X.spanish_key("a"), {"a": "NIÑOOOO"}, "ninoo"),
        (lambda: X.edit_distance("a", "b", 4), {"a": "abcdef", "b": "x"}, 5),
        (lambda: X.edit_distance("a", "b", 2), {"a": "abcdef", "b": "xyzdef"}, 3),
        (lambda: X.korean_distance("a", "b"), {"a": "가", "b": "각"}, 0.6),
        (lambda: X.roman_distance("a", "b"), {"a": "Perche", "b": "perché"}, 0),
        (lambda: X.shape_es("a"), {"a": "Hola123"}, "Aaa00"),
        (lambda: X.spanish_edit_cost("a", "b"), {"a": "kiero", "b": "quiero"}, 0.6),
        (lambda: X.spanish_edit_cost("a", "b"), {"a": "mas", "b": "más"}, 0.3),
        (lambda: X.keeps_order("a", "b"), {"a": "cmq", "b": "comunque"}, True),
        (lambda: X.keeps_order("a", "b"), {"a": "qmc", "b": "comunque"}, False),
        (lambda: X.decode_action("a", "b"), {"a": "COPY", "b": "w"}, ("w", "COPY")),
        (lambda: X.decode_action("a", "b"), {"a": "NORM x", "b": "w"}, ("x", "NORM")),
        (lambda: X.decode_action("a", "b"), {"a": "NORM:", "b": "w"}, ("w", "MALFORMED")),
        (lambda: X.script_ratio("a", "InThai"), {"a": "กa"}, 0.5),
        (lambda: U.nfkc(F.col("a")), {"a": "ﬁ①"}, "fi1"),
        (lambda: U.without_marks(F.col("a")), {"a": "Perché"}, "Perche"),
        (lambda: U.japanese_key(F.col("a")), {"a": "カタカナー"}, "かたかなー"),
        (lambda: U.thai_normal(F.col("a")), {"a": "เเก​"}, "แก"),
    ],
)
def test_scalars(spark, expr, values, expected):
    got = evaluate(spark, expr(), **values)
    assert (tuple(got) if isinstance(expected, tuple) else got) == expected


def test_mapping_classes(spark):
    cases = {
        ("CIAO", "ciao"): "allcaps_lower", ("ROMA", "Roma"): "allcaps_title", ("La", "la"): "title_lower", ("tokio", "Tokio"): "lower_title", ("tG", "TG"): "case_only", ("perche", "perché"): "diacritic",
        ("e'", "è"): "diacritic", ("ciaooo", "ciao"): "repeat", ("cmq", "comunque"): "sms_abbrev", ("tel", "telefono"): "expansion", ("ab", "abc"): "short_expansion", ("casa", "cosa"): "spelling_or_other",
        ("vabene", "va bene"): "multiword", ("@x", "y"): "protected", ("a", "a"): "copy",
    }
    df = spark.createDataFrame([(*k, v) for k, v in cases.items()], "raw string, cand string, kind string")
    assert [(r[0], r[1], r[2]) for r in df.select("raw", "kind", X.mapping_class("raw", "cand")).collect() if r[1] != r[2]] == []


def test_protected(spark):
    k1 = {"@a": True, "#b": True, "http://x": True, "12": True, "3.50": True, "10:30": True, "...": True, "_": True, " ": True, "a1": False, "www.x": False, "USA": False}
    df = spark.createDataFrame(list(k1.items()), "x string, y boolean")
    assert df.where(X.protected_k1("x") != F.col("y")).count() == 0
    assert [evaluate(spark, X.protected_k2("a"), a=a) for a in ("www.x", "USA", "USAAAA")] == [True, True, False]


def test_backoff(spark):
    train = C.tokens(sentences(spark, [("ja", ["x", "y", "z"], ["x", "Y", "z"])]))
    test = C.tokens(sentences(spark, [("ja", ["x", "y", "z"], None), ("ja", ["y", "z"], None), ("ja", ["y"], None), ("ja", ["u"], None), ("ja", ["m", "end"], None)]))
    got = P.backoff(test, S.context_tables(train), macros={"m": "M"}, final={"end": "END"})
    found = {(r["sent_id"], r["pos"]): (r["pred"], r["decision"]) for r in got.collect()}
    assert found[0, 1] == ("Y", "trigram") and found[1, 0] == ("Y", "bigram") and found[2, 0] == ("Y", "unigram") and found[3, 0] == ("u", "copy")
    assert found[4, 0] == ("M", "macro") and found[4, 1] == ("END", "final")


def test_fuzzy_candidates_equal_brute_force(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(2, 6)))
    raws, vocab = sorted({word() for _ in range(40)}), {word(): rng.randrange(1, 9) for _ in range(60)}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    expected = set()
    for r in raws:
        near = sorted((lev(r, v), -n, v) for v, n in vocab.items() if v != r and v[0] == r[0] and abs(len(v) - len(r)) <= 1 and lev(r, v) <= 1)
        expected |= {(r, v, d) for d, _, v in near[:5]}
    got = P.fuzzy_candidates(spark.createDataFrame([("es", r) for r in raws], "lang string, raw string"), spark.createDataFrame([("es", v, n) for v, n in vocab.items()], "lang string, word string, n long"))
    assert {(r["raw"], r["cand"], r["dist"]) for r in got.collect()} == expected


def test_merged_dictionary(spark):
    t = pairs(spark, [("que", "que", 3), ("q", "que", 2), ("queee", "que", 1), ("quee", "qué", 1)])
    got = {(r["raw"], r["cand"]): (r["score"], r["sources"]) for r in P.merged_dictionary(t).collect()}
    assert got["q", "que"] == (3.4, "normalized_key,observed") and got["q", "q"] == (0.1, "copy") and got["queee", "qué"] == (0.7, "normalized_key") and got["queee", "que"][0] == 1.7


def test_policies_and_gates(spark):
    counts = S.pair_counts(pairs(spark, [("q", "que", 5), ("@x", "y", 5), ("a", "a", 3), ("zz", "z z", 1)]))
    got = {(r["raw"]): (r["pred"], r["decision"]) for r in P.loo_decisions(counts, "l1_loo_raw").collect()}
    assert got == {"q": ("que", "passed"), "@x": ("@x", "protected"), "a": ("a", "copy"), "zz": ("zz", "count_below_threshold")}
    assert {r["raw"]: r["pred"] for r in P.loo_decisions(counts, "l0_mfr").collect()}["zz"] == "z z"
    gates = {r["raw"]: r["decision"] for r in P.dictionary_gates(counts).collect()}
    assert gates == {"q": "ok", "@x": "protected", "a": "same_or_empty", "zz": "low_pair_count"}
    t = C.tokens(sentences(spark, [("es", ["q", "w", "a"], None)]))
    d = P.mfr_first(t, S.most_frequent(counts), detector=F.when(F.col("raw") == "w", 0.9).otherwise(0.1), generated=F.lit("W")).orderBy("pos").collect()
    assert [(r["pred"], r["decision"]) for r in d] == [("que", "mfr"), ("W", "model"), ("a", "detector_copy")]


def test_oof_counts_equal_recounts(spark):
    rng = random.Random(2)
    t = C.tokens(sentences(spark, [("es", [rng.choice("ab") for _ in range(4)], [rng.choice("abc") for _ in range(4)]) for _ in range(40)])).withColumn("fold", F.col("sent_id") % 5)
    rows = t.collect()
    expected = set()
    for f in range(5):
        seen = {r["raw"] for r in rows if r["fold"] == f}
        c = Counter((r["raw"], r["norm"]) for r in rows if r["fold"] != f)
        expected |= {(f, r, n, k) for (r, n), k in c.items() if r in seen}
    assert {(r["fold"], r["raw"], r["norm"], r["n"]) for r in S.out_of_fold(t).collect()} == expected


def test_language_scores(spark):
    t = C.tokens(sentences(spark, [("es", ["a", "b", "a"], None), ("es", ["a", "c"], None)]))
    uni, bi, tri = (S.ngram_counts(t, k) for k in (1, 2, 3))
    got = P.language_scores(spark.createDataFrame([("es", "a", "b", "a")], 'lang string, left string, cand string, right string'), uni, bi, tri).first()
    assert {r["w1"]: r["n"] for r in uni.collect()} == {"a": 3, "b": 1, "c": 1, "<BOS>": 2, "<EOS>": 2}
    v, total = 5, 9
    expected = [math.log(2 / (total + v)), math.log(2 / (3 + v)), math.log(2 / (1 + v)), math.log(2 / (1 + v))]
    assert [round(x, 6) for x in expected] == [got[k] for k in ("uni", "bi_left", "bi_right", "tri")]


def test_features_and_sampling(spark):
    t = C.document_pairs(spark, SF) if os.path.isdir(SF) else pairs(spark, [("q", "que", 30), ("a", "a", 300)])
    rows = M.detector_rows(t, S.raw_stats(S.pair_counts(t)))
    assert rows.where(" or ".join(f"{c} is null" for c in [*M.NUMERIC, *M.STRINGS, "label"])).count() == 0
    few = G.limit_negatives(t, 2).groupBy("lang").agg(F.sum((F.col("raw") != F.col("norm")).cast("int")).alias("p"), F.count("*").alias("n")).collect()
    assert all(r["n"] <= 3 * r["p"] for r in few)
    a, b = G.holdout(t)
    assert a.count() + b.count() == t.count() and a.select("sent_id").intersect(b.select("sent_id")).count() == 0
    assert G.oversample_changed(t, 3).count() == t.count() + 2 * t.where("raw <> norm").count()


def test_files(spark, tmp_path):
    s = sentences(spark, [("es", ["a", "ñ"], ["a", "n"]), ("it", ["b"], None)])
    p = C.rebuilt(C.tokens(s).withColumn("pred", F.col("norm")))
    z = C.write_predictions(p, str(tmp_path / "p.zip"))
    back = C.read_predictions(spark, str(z))
    assert [tuple(r) for r in back.orderBy("sent_id").collect()] == [(0, ["a", "ñ"], ["a", "n"], "es"), (1, ["b"], ["b"], "it")]
    assert C.order_mismatch(p, back).count() == 0 and C.order_mismatch(p, back.where("sent_id = 0")).count() == 1
    C.write_lines(s, str(tmp_path / "lines"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "lines")).collect()] == ["a ñ", "b"]
    s.write.parquet(str(tmp_path / "s"))
    assert C.read_sentences(spark, str(tmp_path / "none"), str(tmp_path / "s")).count() == 2
    bad = back.withColumn("pred", F.when(F.col("sent_id") == 0, F.array(F.lit("x"))).otherwise(F.col("pred")))
    assert C.accept_lengths(bad).where("pred <> raw").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
@pytest.mark.parametrize("name", ["a2_mfr_first", "a14_ko_tables", "a18_loo_category", "d9_policy_l2_loo_category", "e1_err", "e12_quantiles", "j4_backoff_predict", "x2_provenance"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(Q.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = Q.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


def test_rule_candidates_and_margins(spark):
    from lexweave.operators import rules as R

    words = spark.createDataFrame([("es", w) for w in ("kiero", "wapo", "cansao", "holaaa", "xq", "d'acuerdo")], "lang string, raw string")
    got = defaultdict(list)
    for r in R.spanish_candidates(words, R.table(spark, {"xq": ["porque", "por qué"]}, "es")).orderBy("ord").collect():
        got[r["raw"]].append((r["cand"], r["source"]))
    assert got["kiero"] == [("kiero", "copy"), ("quiero", "rewriting")]
    assert ("guapo", "rewriting") in got["wapo"] and ("buapo", "rewriting") in got["wapo"] and ("cansado", "rewriting") in got["cansao"]
    assert got["holaaa"] == [("holaaa", "copy"), ("holaa", "repeat2"), ("hola", "repeat1")]
    assert got["xq"][:3] == [("xq", "copy"), ("porque", "rule"), ("por qué", "rule")]
    assert {c for c, _ in got["d'acuerdo"]} == {"d'acuerdo", "dacuerdo", "d acuerdo"}
    scored = spark.createDataFrame([("es", "a", "a", 0.3, 0), ("es", "a", "b", 0.45, 1), ("es", "c", "c", 0.4, 0), ("es", "c", "d", 0.45, 1), ("es", "e", "f", 0.1, 1), ("es", "g", "g", 0.5, 0), ("es", "g", "h", 0.5, 1)], "lang string, raw string, cand string, score double, ord int")
    assert {r["raw"]: (r["pred"], r["decision"]) for r in R.accept_best(scored).collect()} == {"a": ("b", "accept"), "c": ("c", "low_margin"), "e": ("e", "low_score"), "g": ("g", "copy")}
    t = C.tokens(sentences(spark, [("es", ["q", "zz"], None)]))
    d = spark.createDataFrame([("es", "q", "que", 1), ("es", "q", "qué", 2)], "lang string, raw string, cand string, ord int")
    assert [r["pred"] for r in R.fallback(t, d, F.lit("<extra_id_0>")).orderBy("pos").collect()] == ["que", "zz"]
    variants = R.case_variants(spark.createDataFrame([("es", "q", "Que", "lookup")], "lang string, raw string, cand string, source string"))
    assert {(r["cand"], r["source"]) for r in variants.collect()} == {("Que", "lookup"), ("que", "case_variant"), ("QUE", "case_variant")}


def test_stream_lookup(spark, tmp_path):
    from lexweave.streaming.normalize import normalized_tokens

    sentences(spark, [("es", ["q", "a"], None)]).write.parquet(str(tmp_path / "in"))
    table = spark.createDataFrame([("es", "q", "que")], "lang string, raw string, pred string")
    stream = normalized_tokens(spark.readStream.schema(C.SENTENCES).parquet(str(tmp_path / "in")), table)
    q = stream.writeStream.format("memory").queryName("normalized").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert sorted((r["raw"], r["pred"]) for r in spark.table("normalized").collect()) == [("a", "a"), ("q", "que")]
    finally:
        q.stop()
