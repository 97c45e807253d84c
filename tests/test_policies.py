"""Predicates, rules, generators and policies on small cases worked out by hand."""

from __future__ import annotations

import dataclasses
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexweave.functions import protect as K
from lexweave.functions import text as X
from lexweave.functions import unicode as U
from lexweave.operators import candidates as C
from lexweave.operators import evaluate as E
from lexweave.operators import features as M
from lexweave.operators import models as H
from lexweave.operators import policies as D
from lexweave.operators import sampling as G
from lexweave.operators import stats as S
from lexweave.sources import artifacts as A
from lexweave.sources import sentences as T

SENTENCES = "sent_id long, lang string, raw array<string>, norm array<string>"


def sentences(spark, rows):
    return spark.createDataFrame([(i, lang, raw, norm) for i, (lang, raw, norm) in enumerate(rows)], SENTENCES)


def tokens(spark, *words, lang="it"):
    return T.tokens(sentences(spark, [(lang, list(w), None) for w in words]))


def counts(spark, rows, lang="it"):
    return spark.createDataFrame([(lang, r, n, k) for r, n, k in rows], "lang string, raw string, norm string, n long")


def decided(df):
    return {(r["sent_id"], r["pos"]): (r["pred"], r["decision"]) for r in df.collect()}


def values(spark, words, *exprs):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, x string").select("i", *(e.alias(f"e{k}") for k, e in enumerate(exprs)))
    return [tuple(r[1:]) if len(exprs) > 1 else r[1] for r in df.orderBy("i").collect()]


def test_protected_kinds(spark):
    x = F.col("x")
    assert values(spark, ["www.a.it", "a@b.it", "boh", "ahahah", "xdd", "USA", "Ciao", "ciao", "", "@a"], K.protected_k4(x)) == [True] * 6 + [False, False, True, True]
    assert values(spark, ["#ก", "กข", "abc", "12", "ก1", "a.com", "กa1b2c3"], K.protected_k5(x)) == [True, False, True, True, False, True, True]
    assert values(spark, ["", "http://a", "１２", "2020/1/2", "＃a", "abc", "RT", "ok", "です"], K.protected_k6(x)) == [True] * 6 + [False, False, False]
    assert values(spark, ["12:30", "...", "http", "abc"], K.protected_k7(x), K.protected_k8(x)) == [(True, True), (False, True), (True, True), (False, False)]
    assert values(spark, ["Roma", "ROMA", "roma", "R"], K.named_entity(x)) == [True, False, False, False]
    assert values(spark, ["ひカ漢a1", "!", "カ"], K.script_signature(x)) == ["hira+kata+kanji+latin+num", "other", "kata"]


def test_shapes_and_cases(spark):
    x = F.col("x")
    assert values(spark, ["ひカ漢Ab12!!!", "カカカカ"], X.shape_ja(x)) == ["HKCaa00!!", "KK"]
    assert values(spark, ["", "http://a", "@a", "#b", "..", "USA", "abc", "Ab", "1a", "aB"], X.shape_class(x)) == ["EMPTY", "URL", "MENTION", "HASHTAG", "PUNCT", "ALLCAPS", "LOWER", "TITLE", "LOWER", "MIXED"]
    assert values(spark, ["CMQ", "Cmq", "cmq", "C"], X.like_case(x, F.lit("comunque"))) == ["COMUNQUE", "Comunque", "comunque", "Comunque"]
    assert values(spark, ["Unitààà", "E’"], U.diacritic_key(x), U.count_marks(x)) == [("unitaa", 3), ("e'", 0)]


def test_korean_rules(spark):
    x = F.col("x")
    assert values(spark, ["ㅋㅋㅋㅋ", "ㅋㅋㅋ", "ㅋㅎㅋㅎ"], X.short_emote(x)) == ["ㅋㅋ", None, None]
    assert values(spark, ["ㅠㅠㅠ", "ㅠㅠ", "가"], X.emote_candidates(x)) == [["ㅠㅠ", "ㅠ"], [], []]
    assert values(spark, ["좋아아아", "좋아아", "네ㅋㅋㅋ"], X.short_syllables(x)) == ["좋아", None, None]
    assert values(spark, ["안해용", "해용", "그네용"], X.plain_ending(x)) == ["안해요", None, "그네요"]
    assert values(spark, ["가다", "Ánd"], X.first_jamo(x)) == ["ᄀ", "a"]


def test_thai_rules(spark):
    x = F.col("x")
    assert values(spark, ["เเก", "กํา", "ก่ิ", "กก่่"], U.thai_normal(x)) == ["แก", "กำ", "กิ่", "กก่"]
    forms = values(spark, ["มากกกก", "เเก", "ab"], U.thai_rule_forms(x))
    assert forms == [["มากก", "มาก"], ["แก"], []]


def test_prompts(spark):
    df = spark.createDataFrame([(["a", "b"], 1, "es")], "w array<string>, p int, lang string")
    kinds = {
        "natural": "lang: es word: b context: a b", "sentinel": "a <extra_id_0> b <extra_id_1>", "marked_natural": "normalize lang: es target: b context: a <extra_id_0> b <extra_id_1>",
        "lexnorm": "lexnorm lang: es word: b context: a b", "indexed": "normalize es: word: b index: 1 context: a b", "action": "task: lexical_normalization lang: es target: b sentence: a <extra_id_0> b <extra_id_1>",
    }
    got = df.select(*(X.prompt("w", "p", "lang", k).alias(k) for k in kinds), X.prompt("w", "p", "lang", "natural", F.array(F.lit("B"), F.lit("v"))).alias("c")).first()
    assert all(got[k] == v for k, v in kinds.items()) and got["c"].endswith(" candidates: B | v")
    text = df.select(M.korean_change_text(F.col("w"), F.col("p")).alias("t")).first()["t"]
    assert text == "raw=b jamo=b prev=a next=<EOS> ctx=a <T> b </T>"


def test_spanish_generator_and_hybrid(spark):
    c = counts(spark, [("q", "que", 5), ("kasa", "casa", 2), ("casa", "casa", 9)], "es")
    got = {}
    for r in C.spanish_final(tokens(spark, ["q", "kasa", "xfavor"], lang="es"), c).orderBy("ord").collect():
        got.setdefault(r["raw"], []).append((r["cand"], r["source"]))
    assert got["q"] == [("q", "copy"), ("que", "mfr")]
    assert got["kasa"] == [("kasa", "copy"), ("casa", "mfr"), ("quasa", "cyber_rule")]
    assert got["xfavor"] == [("xfavor", "copy"), ("por_favor", "abbrev"), ("chfavor", "cyber_rule")]
    t = tokens(spark, ["USA", "a", "b", "c", "d"], lang="es")
    scores = spark.createDataFrame([("es", "b", "b", 0.2, 0), ("es", "b", "v", 0.9, 1), ("es", "c", "c", 0.9, 0), ("es", "c", "k", 0.5, 1), ("es", "d", "x", 0.2, 0)], "lang string, raw string, cand string, score double, ord int")
    p = F.when(F.col("raw") == "a", 0.42).otherwise(0.43)
    out = D.spanish_hybrid(t, scores, p, F.when(F.col("raw") == "c", "ca").otherwise("word: x"))
    assert decided(out) == {(0, 0): ("USA", "protected"), (0, 1): ("a", "detector_copy"), (0, 2): ("v", "ranker"), (0, 3): ("ca", "model"), (0, 4): ("d", "model_copy")}
    margin = D.spanish_margin(t, scores, F.lit(0.0), margin=0.05)
    assert decided(margin)[0, 2] == ("v", "ranker") and decided(margin)[0, 3] == ("c", "margin_copy")


def test_outputs_are_checked(spark):
    safe = lambda out, raw="casa": values(spark, [raw], D.safe_spanish(F.col("x"), F.lit(out)))[0]
    assert [safe(o) for o in ("caza", "", "a b", "word: a", "zyzyzyzyzy", "c" * 30)] == ["caza", None, None, None, None, None]
    it = lambda out, raw="casa": values(spark, [raw], D.safe_italian(F.col("x"), F.lit(out)))[0]
    assert [it(o) for o in ("caso", "ca", "@caso", "a b", "a_b c")] == ["caso", None, None, None, "a_b c"] and it("12a", "12") is None
    ja = lambda raw, out, **k: values(spark, [raw], D.safe_japanese(F.col("x"), F.lit(out), F.lit(k.get("sure")), F.lit(k.get("ch", False)), F.lit(k.get("long", False))))[0]
    assert [ja("ー", "<DELETE>"), ja("あ", "<DELETE>"), ja("あ", "<DELETE>", sure=""), ja("あ", "ア"), ja("あ", "ア", ch=True), ja("あ", "あ" * 13), ja("あ", "あ" * 13, long=True), ja("@a", "い")] == ["", "あ", "", "あ", "ア", "あ", "あ" * 13, "@a"]


def test_italian_conservative(spark):
    c = counts(spark, [("nn", "non", 3), ("ke", "che", 1), ("perche", "perche", 1), ("bello", "bello", 4), ("USA", "Usa", 2), ("per", "per", 5), ("sei", "sei", 3), ("questa", "questa", 2)])
    t = tokens(spark, ["nn", "USA", "perche", "bellooo", "x", "te"], ["x", "2"], ["qst", "cosa"], ["boh", "citta'", "6", "felice"])
    got = decided(D.italian_conservative(t, c))
    assert got[0, 0] == ("non", "change") and got[0, 1] == ("Usa", "strong")
    # In the vocabulary a word keeps: 4 - 1.25 for the accent against 2 for itself.
    assert got[0, 2] == ("perche", "low_margin")
    assert got[0, 3] == ("bello", "change") and got[0, 4] == ("per", "change") and got[1, 0] == ("per", "change")
    assert got[2, 0] == ("questa", "change") and got[3, 0] == ("boh", "protected") and got[3, 1] == ("città", "change") and got[3, 2] == ("sei", "change")
    assert got[0, 5] == ("te", "copy")


def test_italian_generators(spark):
    c = counts(spark, [("nn", "non", 3), ("Piu", "più", 1), ("ciao", "ciao", 2)])
    got = {}
    for r in C.italian_ranker(tokens(spark, ["nn", "Perche", "ciaooo", "@nn"]), c).orderBy("ord").collect():
        got.setdefault(r["raw"], []).append((r["cand"], r["source"]))
    assert got == {"nn": [("nn", "raw"), ("non", "mfr")], "Perche": [("Perche", "raw"), ("Perché", "diacritic")], "ciaooo": [("ciaooo", "raw"), ("ciao", "repeat")], "@nn": [("@nn", "raw")]}
    c = counts(spark, [("c'è", "c'è", 2), ("che", "che", 5), ("l'", "l'", 2), ("hanno", "hanno", 3), ("realta", "realtà", 2), ("va", "va", 1), ("bene", "bene", 1)])
    found = {(r["raw"], r["cand"]): r["sources"] for r in C.monoise(tokens(spark, ["lhanno", "Realta", "vabene", "cheee", "@a"]), c, extended=True).collect()}
    assert "split" in found["lhanno", "l' hanno"] and "split" in found["vabene", "va bene"] and found["cheee", "che"] == ["repeat", "repeat_case", "repeat_diacritic", "repeat_key"]
    assert found["Realta", "realtà"] == ["diacritic", "key"] and found["@a", "@a"] == ["original"]


def test_external_tool_and_modes(spark):
    mfr = S.most_frequent(counts(spark, [("a", "b", 2), ("perche", "perche", 1)]))
    t = tokens(spark, ["a", "perche", "zz"])
    tool = F.when(F.col("raw") == "a", "c").when(F.col("raw") == "perche", "perché").otherwise("long word")
    got = {m: [p for _, p in sorted(decided(D.external_tool(t, mfr, tool, m)).items())] for m in ("m1_monoise_only", "m2_mfr_preserve_unseen_safe", "m5_mfr_monoise_agreement_only")}
    assert [p for p, _ in got["m1_monoise_only"]] == ["c", "perché", "long word"]
    assert got["m2_mfr_preserve_unseen_safe"] == [("b", "mfr"), ("perché", "tool"), ("zz", "blocked")]
    assert [p for p, _ in got["m5_mfr_monoise_agreement_only"]] == ["b", "perche", "zz"]
    first = D.detector_first(t, mfr, F.lit(0.9), "detector_mfr_byt5", output=F.lit("x"))
    assert [p for _, p in sorted(decided(first).items())] == [("b", "mfr_change"), ("perche", "byt5_rejected_copy"), ("x", "byt5_change")]
    with pytest.raises(ValueError):
        D.detector_first(t, mfr, F.lit(0.9), "other")


def test_korean_policies(spark):
    c = counts(spark, [("낼", "낼", 7), ("낼", "내일", 3), ("넘", "너무", 4), ("마니", "마니", 1), ("마니", "많이", 1), ("좋아", "좋아", 3)], "ko")
    info = S.candidate_info(c)
    t = tokens(spark, ["낼", "넘", "마니", "걍", "ㅋㅋㅋㅋㅋ", "좋아아아", "안해용", "12", "근데"], lang="ko")
    got = [v for _, v in sorted(decided(D.korean_rules(t, info)).items())]
    assert got == [("낼", "train_keep"), ("너무", "train_change"), ("많이", "direct"), ("그냥", "direct"), ("ㅋㅋ", "emote"), ("좋아", "syllables"), ("안해요", "ending"), ("12", "protected"), ("근데", "copy")]
    assert decided(D.korean_rules(t, info, aggressive=True))[0, 8] == ("그런데", "ambiguous")
    ranked = decided(D.korean_ranked(tokens(spark, ["낼", "넘", "마니", "조아", "쪼아"], lang="ko"), c, info, F.when(F.col("raw") == "쪼아", 0.7).otherwise(0.8)))
    assert ranked[0, 0] == ("낼", "train_keep") and ranked[0, 1] == ("너무", "train_change") and ranked[0, 2] == ("많이", "ranked")
    assert ranked[0, 3][1] in ("no_candidate", "ranked") and ranked[0, 4][0] == "쪼아"
    rule = decided(D.korean_rule_mfr(t, S.most_frequent(c), {"걍": "그냥"}))
    assert rule[0, 3] == ("그냥", "rule") and rule[0, 1] == ("너무", "mfr") and rule[0, 7] == ("12", "copy")


def test_cascades(spark):
    c = counts(spark, [("q", "que", 3), ("w", "w", 3), ("m", "me", 1), ("m", "mi", 1), ("x", "porque", 3), ("x", "x", 2), ("hola", "hola", 4)], "es")
    info = S.candidate_info(c)
    t = tokens(spark, ["q", "w", "m", "x", "hols", "@a"], lang="es")
    out = F.when(F.col("raw") == "m", "mi").when(F.col("raw") == "x", "porquee").when(F.col("raw") == "hols", "holas").otherwise(F.col("raw"))
    v4 = [v for _, v in sorted(decided(D.cascade(t, c, info, out, "v4")).items())]
    assert v4 == [("que", "sure"), ("w", "train_keep"), ("mi", "observed"), ("porque", "near"), ("hola", "vocabulary"), ("@a", "protected")]
    v1 = [v for _, v in sorted(decided(D.cascade(t, c, info, out, "general_v1")).items())]
    assert v1[0] == ("que", "sure") and v1[2] == ("mi", "observed") and v1[4] == ("holas", "model")
    assert values(spark, ["casa", "ab", "@a"], D.guard(F.col("x"), F.lit("zz"), "weak"), D.guard(F.col("x"), F.lit("zz"), "strong")) == [("casa", "zz"), ("ab", "zz"), ("@a", "@a")]


def test_japanese_scheme_and_actions(spark):
    c = counts(spark, [("RT", "リツイート", 4), ("えー", "ええ", 2), ("えー", "えー", 2)], "ja")
    t = tokens(spark, ["RT", "abc", "えー", "本", "です"], lang="ja")
    got = [v for _, v in sorted(decided(D.japanese_scheme(t, c, F.when(F.col("raw") == "です", "です。").otherwise("ええ"))).items())]
    assert got == [("リツイート", "sure"), ("abc", "hard_keep"), ("ええ", "model"), ("本", "copy"), ("です。", "model")]
    a = [v for _, v in sorted(decided(D.action_labels(tokens(spark, ["a", "b", "c"]), F.when(F.col("raw") == "a", "NORM: z").when(F.col("raw") == "b", "COPY").otherwise("?"))).items())]
    assert a == [("z", "NORM"), ("b", "COPY"), ("c", "MALFORMED")]


def test_thai_two_stage(spark):
    c = counts(spark, [("มั้ย", "ไหม", 9), ("มากกก", "มากกก", 1), ("มาก", "มาก", 3)], "th")
    t = tokens(spark, ["มั้ย", "มากกกก", "abc"], lang="th")
    got = [v for _, v in sorted(decided(D.thai_two_stage(t, c, F.lit(0.9))).items())]
    assert got[0] == ("ไหม", "mfr") and got[1] == ("มาก", "rule") and got[2] == ("abc", "keep")
    assert [v for _, v in sorted(decided(D.thai_two_stage(t, c, F.lit(0.1))).items())][1] == ("มากกกก", "detector_keep")
    best = {r["raw"]: (r["cand"], r["source"]) for r in C.thai_best(t, c).collect()}
    assert best["มั้ย"] == ("ไหม", "mfr") and best["มากกกก"] == ("มาก", "rule") and best["abc"] == ("abc", "keep")
    f = M.thai_features(t, c).where("pos = 0").first()
    assert len(M.THAI_FEATURES) == 36 and f["mfr_changes"] == 1.0 and f["in_errors"] == 1.0 and f["has_thai"] == 1.0 and f["next_thai"] == 1.0 and f["n_errors"] == 1.0
    noisy = G.corrupt_thai(t)
    a, b = ([tuple(r) for r in noisy.select("sent_id", "pos", "raw", "corrupted").orderBy("pos").collect()] for _ in range(2))
    assert a == b and all(r[2] != r[3] for r in a)


def test_accept_override(spark):
    c = counts(spark, [("a", "b", 2), ("a", "c", 1)])
    mfr = S.most_frequent(c)
    cands = C.monoise(tokens(spark, ["a", "z"]), c).withColumn("score", F.when(F.col("cand") == "c", 0.9).otherwise(0.5))
    pairs = M.accept_features(D.accept_pairs(cands, mfr), c)
    row = pairs.where("raw = 'a' and cand = 'c'").first()
    assert row["base"] == "b" and row["is_best"] == 1 and row["score_delta_cand_base"] == 0.4 and row["cand_has_lookup"] == 1 and row["base_has_mfr"] == 1 and row["cand__pair_conf"] == 0.333333
    p = pairs.select("lang", "raw", "cand", "ord", F.col("score").alias("p"))
    assert decided(D.accept_override(tokens(spark, ["a", "z"]), mfr, p, 0.8)) == {(0, 0): ("c", "override_accept"), (0, 1): ("z", "base_copy")}
    assert decided(D.accept_override(tokens(spark, ["a"]), mfr, p, 0.95)) == {(0, 0): ("b", "base_mfr_change")}


def test_registry_degrades(spark):
    c = counts(spark, [("a", "b", 2)])
    t = T.tokens(sentences(spark, [("it", ["a"], None), ("es", ["a"], None), ("xx", ["a"], None), ("ja", ["です"], None)]))
    r = D.Resources(c)
    got = {x["lang"]: (x["pred"], x["policy"]) for x in D.run(t, r, {"es": "hybrid", "it": "conservative", "ja": "backoff", "de": "nobody"}, "copy").collect()}
    assert got == {"it": ("b", "conservative"), "es": ("a", "mfr"), "xx": ("a", "copy"), "ja": ("です", "mfr")}
    full = dataclasses.replace(r, training=T.tokens(sentences(spark, [("ja", ["x"], ["y"])])), detector=F.lit(1.0), candidates=spark.createDataFrame([("es", "a", "A", 0.9, 0)], "lang string, raw string, cand string, score double, ord int"))
    got = {x["lang"]: (x["pred"], x["policy"]) for x in D.run(t, full).collect()}
    assert got["es"] == ("A", "hybrid") and got["ja"] == ("です 。", "backoff") and D.run(t, full).count() == 4


def test_registry_knows_all_policies(spark):
    """Each policy by its name: what it needs, its columns, and one decision a token."""
    t = T.tokens(sentences(spark, [("it", ["a", "zz"], None)]))
    scores = spark.createDataFrame([("it", "a", "A", 0.9, 1.0, 0)], "lang string, raw string, cand string, score double, p double, ord int")
    r = D.Resources(counts(spark, [("a", "b", 4), ("a", "a", 1)]), training=t, detector=F.lit(0.9), output=F.upper("raw"), candidates=scores.drop("p"), accepted=scores.drop("score"))
    assert len(D.REGISTRY) > 30
    for name, (needs, policy) in D.REGISTRY.items():
        assert D.resolve(name, r) == name and (not needs or D.resolve(name, D.Resources(r.counts)) == "mfr")
        assert {"sent_id", "pos", "lang", "raw", "pred", "decision"} <= set(policy(t, r).columns), name
    want = {"tool_m1_monoise_only": "A", "loo_l0_mfr": "b", "accept_override": "A", "mfr_first": "b", "cascade_v4": "b", "rerank_prior": "b", "detector_byt5": "A"}
    for name, pred in want.items():
        got = {x["raw"]: x["pred"] for x in D.run(t, r, {"it": name}).collect()}
        assert set(got) == {"a", "zz"} and got["a"] == pred, (name, got)


def test_artifacts(spark, tmp_path):
    assert A.merge({"a": 1, "b": {"c": 1, "d": 2}}, {"b": {"c": 5}}, None, {"e": 3}) == {"a": 1, "b": {"c": 5, "d": 2}, "e": 3}
    config = A.from_environment(D.ItalianConfig(), environment={"LEXWEAVE_SPLIT": "yes", "LEXWEAVE_MARGIN": "2.5", "LEXWEAVE_MIN_COUNT_EXACT": "4"})
    assert config.split and config.margin == 2.5 and config.min_count_exact == 4 and not config.capitalization
    s = sentences(spark, [("it", ["a", "b"], None), ("it", ["c"], None), ("es", ["d", "e"], None)])
    A.write_numbered_lines(s, str(tmp_path / "lines"))
    back = A.read_numbered_lines(s, str(tmp_path / "lines"))
    assert {(r["sent_id"], tuple(r["pred"]), r["status"]) for r in back.collect()} == {(0, ("a", "b"), "ok"), (1, ("c",), "ok"), (2, ("d", "e"), "ok")}
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "x.txt").write_text("0\tA\n1\tC\n1\tC\nnot a line\n")
    assert {r["sent_id"]: (r["pred"], r["status"]) for r in A.read_numbered_lines(s, str(tmp_path / "odd")).collect()} == {0: (["a", "b"], "length"), 1: (["c"], "doubled"), 2: (["d", "e"], "missing")}
    program = tmp_path / "tool.py"
    program.write_text("import sys\nopen(sys.argv[2], 'w').write(open(sys.argv[1]).read().upper())\n")
    upper = A.external(s, f"{sys.executable} {program} {{input}} {{output}}")
    assert sorted(tuple(r["pred"]) for r in upper.collect()) == [("A", "B"), ("C",), ("D", "E")]
    assert sorted(tuple(r["pred"]) for r in A.external(s, None).collect()) == [("a", "b"), ("c",), ("d", "e")]
    made = []
    build = lambda: made.append(1) or s
    for _ in range(2):
        assert A.cached(spark, str(tmp_path / "kept"), build).count() == 3
    assert len(made) == 1
    train, valid = A.save_splits(s, str(tmp_path / "split"))
    assert spark.read.parquet(train).count() + spark.read.parquet(valid).count() == 3
    assert A.load_model(str(tmp_path / "nothing")) is None
    with pytest.raises(Exception):
        T.read_sentences(spark, str(tmp_path / "none")).count()
    assert T.read_sentences(spark, str(tmp_path / "none"), str(tmp_path / "kept")).count() == 3


def test_sweeps_and_selection(spark):
    t = spark.createDataFrame([("it", "a", "b", "b", 0.9), ("it", "c", "c", "d", 0.4), ("it", "e", "f", "f", 0.5)], "lang string, raw string, norm string, pred string, p double")
    best = E.best_error_threshold(E.error_sweep(t, "p", "pred", [0.3, 0.5, 0.8])).first()
    assert best["threshold"] == 0.5 and best["err"] == 1.0
    results = spark.createDataFrame([("it", 0, "a", 0.3, 0.5, 0.9), ("it", 1, "a", 0.3, 0.3, 0.9), ("it", 0, "b", 0.3, 0.4, 0.9)], "lang string, fold int, config string, threshold double, err double, accuracy double")
    assert H.select_config(results).first()["config"] == "a"
    grams = spark.createDataFrame([("ab c",)], "x string").select(H.char_ngrams(F.col("x"), 2, 4).alias("g")).first()["g"]
    expected = Counter([" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "])
    assert Counter(grams) == expected


def test_negatives_are_cut_exactly(spark):
    rows = [("es", [f"w{i}" for i in range(400)], [f"w{i}" if i % 40 else "x" for i in range(400)])]
    kept = G.limit_negatives(T.tokens(sentences(spark, rows)), 6)
    assert kept.where("raw <> norm").count() == 10 and kept.where("raw = norm").count() == 60
    few = G.limit_negatives(T.tokens(sentences(spark, [("es", ["a", "b"], ["x", "b"])])), 6)
    assert few.count() == 2
