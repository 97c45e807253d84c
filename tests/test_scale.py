"""What plans must not do at size: work done twice, rows that grow faster than the input."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from lexweave.sources.sentences import document_pairs, document_sentences


def _documents(spark, folder, texts):
    rows = [(i, "de", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_texts_are_cut_once(spark, tmp_path):
    """A filter on the number of words was pushed down and cut every text again."""
    folder = _documents(spark, tmp_path, ["Ä b\x0b c ", " \t", "", None, "x"])
    t = document_pairs(spark, folder)
    assert [tuple(r) for r in t.select("sent_id", "pos", "raw", "norm", "prev", "next2").orderBy("sent_id", "pos").collect()] == [
        (0, 0, "a", "Ä", "<BOS>", "c"),
        (0, 1, "b", "b", "a", "<EOS>"),
        (0, 2, "c", "c", "b", "<EOS>"),
        (4, 0, "x", "x", "<BOS>", "<EOS>"),
    ]
    plan = t.groupBy("lang", "raw", "norm").agg(F.count("*"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2 and "Filter" not in plan
    assert "split(" in document_sentences(spark, folder)._jdf.queryExecution().optimizedPlan().toString()


def _reads_documents(spark, folder, query):
    from lexweave.plans import catalog

    return any("documents.parquet" in f for f in catalog.queries()[query](spark, folder).inputFiles())


def test_candidates_share_counts_and_words(spark, tmp_path):
    """Each of the sources read all documents and counted pairs anew."""
    folder = _documents(spark, tmp_path, ["Über der See", "der Seeweg über den See", "Überder See", "den Weg", "der Weg See", "Seeweg"])
    for query in ("c6_monoise", "m7_accept_pairs", "c9_thai_best"):
        assert not _reads_documents(spark, folder, query)


def test_cuts_known_in_one_form_only(spark):
    """Cuts go on by the key without accents, then as they are and in lower case."""
    from lexweave.operators import candidates as C

    counts = spark.createDataFrame([("fr", "la", "La", 3), ("fr", "ecole", "école", 2), ("fr", "l'", "l'", 4), ("fr", "ami", "ami", 1)], "lang string, raw string, norm string, n long")
    words = spark.createDataFrame([("fr", "laecole"), ("fr", "lami"), ("fr", "laami"), ("fr", "xyz")], "lang string, raw string")
    rows = C.monoise(words, counts, extended=True).where("exists(sources, s -> s like 'split%')")
    assert {(r["raw"], r["cand"], ",".join(r["sources"])) for r in rows.collect()} == {("laecole", "La école", "split_diacritic"), ("lami", "l' ami", "split,split_case,split_diacritic"), ("laami", "La ami", "split_case,split_diacritic")}


def test_equal_texts_are_learned_once(spark, monkeypatch):
    """Every token was a row of the regression."""
    from lexweave.operators import models as H

    rows = spark.createDataFrame([("ab", 1.0)] * 5 + [("abc", 0.0)] * 7 + [("ab", 0.0), ("xyz", 0.0), ("xy", 1.0)], "text string, label double")
    kept = []
    monkeypatch.setattr(H, "stored", lambda df, name: kept.append(df) or df)
    p = {r["text"]: r["p"] for r in H.fit_text_classifier(rows, features=64)(rows.select("text").distinct()).collect()}
    assert kept[0].count() == 5
    assert p["ab"] > 0.5 > p["abc"]


def test_frequencies_are_summed_within_rows(spark):
    """N-grams of every row were exchanged with the row's id to tell document frequencies."""
    from lexweave.operators import tfidf as V

    rows = spark.createDataFrame([(1, "aab"), (2, "b  a"), (3, "")], "id long, text string")
    old = V.grams(rows, F.col("text"), ("id",), 1, 2, False).groupBy("gram").agg(F.sum("c").alias("tf"), F.count("*").alias("df"))
    new = V.frequencies(rows, F.col("text"), 1, 2, False)
    assert new._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(gram") == 1
    assert sorted(map(tuple, old.collect())) == sorted(map(tuple, new.collect()))


def test_contexts_of_pairs_need_no_trigrams(spark):
    """Outputs in a sentence were joined with all trigrams, whose score nothing asked for."""
    from lexweave.operators.predict import language_scores

    triples = spark.createDataFrame([("de", "a", "b", "c")], "lang string, left string, cand string, right string")
    n = spark.createDataFrame([("de", "a", None, 1), ("de", "b", None, 2), ("de", "a", "b", 1)], "lang string, w1 string, w2 string, n long")
    scored = language_scores(triples, n.where("w2 is null"), n.where("w2 is not null"), None)
    assert scored.columns[-3:] == ["uni", "bi_left", "bi_right"] and scored.count() == 1


def test_korean_pairs_are_near_and_few(spark):
    """All pairs that share a string were exchanged before distances were told, and words with enough near ones were looked for further."""
    from lexweave.operators import candidates as C

    known = [f"단어{x}" for x in "가나다라마바사아자"] + ["단차가", "달어가나", "담머기디"]
    v = spark.createDataFrame([("ko", w, 1) for w in known], "lang string, word string, n long")
    q = spark.createDataFrame([("ko", "단어카"), ("ko", "담머기도")], "lang string, raw string")
    every = {(r["raw"], r["cand"]): r["dist"] for r in C.near_korean(q, v).collect()}
    assert max(every.values()) <= 1.8 and ("단어카", "달어가나") not in every
    few = {(r["raw"], r["cand"]): r["dist"] for r in C.near_korean(q, v, most=8).collect()}
    assert few == {k: d for k, d in every.items() if k[0] != "단어카" or d <= 1.0}
    assert C.near_vocabulary(q, v, "ko").where("raw = '단어카'").count() == 8


def test_trigrams_are_exchanged_twice(spark):
    """Trigrams went by their three words, by both pairs and by two words, and were counted twice."""
    from lexweave.operators import stats as S

    rows = [(0, "de", ["a", "b", "a", "b"], ["A", "b", None, "b"]), (1, "de", ["b"], None), (2, "de", [], []), (3, "fr", ["<BOS>", "a"], ["<BOS>", "a"])]
    s = spark.createDataFrame(rows, "sent_id long, lang string, raw array<string>, norm array<string>")
    of = lambda words: sorted((r["lang"], r["w1"], r["n"]) for r in words.collect())
    assert of(S.gold_words(s)) == of(S.marginals(S.gold_trigrams(s), (1,)))
    new = S.trigram_scores(S.gold_trigrams(s, dealt=("lang", "w1")), S.gold_words(s))
    plan = new._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, new.collect()))
    assert got == sorted(map(tuple, S.trigram_scores(S.gold_trigrams(s)).collect())) and len(got) == 7
    assert plan.count("REPARTITION_BY_COL") == 2 and plan.count("Exchange hashpartitioning") <= 4  # the others are those of words


def test_keys_are_worked_out_once_a_pair(spark, tmp_path):
    """Each kind of key was worked out for every token, over a reading of all documents of its own."""
    folder = _documents(spark, tmp_path, ["Über den See", "über der SEE", "den Weg"])
    for query in ("a5_key_counts", "a19_merged_dictionary", "x2_provenance", "c5_candidates"):
        assert not _reads_documents(spark, folder, query)
    from lexweave.operators import stats as S

    counts = spark.createDataFrame([("de", "a", "A", 2), ("de", "a.", "A", 3), ("de", "b", "B", 1)], "lang string, raw string, norm string, n long")
    assert sorted(map(tuple, S.keyed_counts(counts, F.substring("raw", 1, 1)).collect())) == [("de", "a", "A", 5), ("de", "b", "B", 1)]


def test_order_check_reads_sentences(spark, tmp_path):
    """Arrays were made into tokens, exchanged word by word and gathered to the same arrays again."""
    from lexweave.plans import catalog

    folder = _documents(spark, tmp_path, ["a b", "c", " ", None, "d", "e", "f", "Ä g", "h", "i", "j", "k l"])
    assert _reads_documents(spark, folder, "p10_order_check")
    assert sorted(r["sent_id"] for r in catalog.queries()["p10_order_check"](spark, folder).collect()) == [0, 7, 11]


def test_contexts_are_exchanged_once(spark):
    """Each of the three tables exchanged its own counts of all tokens, and then again by its keys."""
    from lexweave.operators import stats as S

    rows = [("de", "<BOS>", "a", "b", "A"), ("de", "a", "b", "<EOS>", "b"), ("de", "<BOS>", "a", "b", None), ("de", "x", "a", "b", None), ("de", "x", "a", "b", None), ("de", "x", "a", "c", ""), ("de", "y", None, "c", None), ("de", "y", "e", "c", "=e")]
    t = spark.createDataFrame([(i, 0, *r) for i, r in enumerate(rows)], "sent_id long, pos int, lang string, prev string, raw string, next string, norm string")
    for tie in ("T1", "T2"):
        tables = S.context_tables(t, tie)
        for name, keys in {"unigram": ("lang", "raw"), "bigram": ("lang", "raw", "next"), "trigram": ("lang", "prev", "raw", "next")}.items():
            inner = t.where({"unigram": "true", "bigram": "next <> '<EOS>'", "trigram": "next <> '<EOS>' and prev <> '<BOS>'"}[name])
            plain = S.most_frequent(S.pair_counts(inner, keys, True), keys, tie).select(*keys, "pred")
            order = lambda r: tuple(str(x) for x in r)
            assert sorted(map(tuple, tables[name].collect()), key=order) == sorted(map(tuple, plain.collect()), key=order)
        fresh = S.context_tables(t, tie)
        assert [fresh[k]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for k in ("trigram", "bigram", "unigram")] == [1, 1, 3]


def test_tasks_are_bounded(spark, tmp_path, monkeypatch):
    """A task read up to 128 MB of texts, whose words' partial sums outgrew its memory."""
    from lexweave.sources import sentences as T

    folder = _documents(spark, tmp_path, ["a b"])
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], "128m")
        monkeypatch.setattr(T, "SPLIT", 100)
        document_sentences(spark, folder)
        assert int(spark.conf.get(keys[0])) == 100 and int(spark.conf.get(keys[1])) > int(before[1])
        spark.conf.set(keys[0], "50b")
        spark.conf.set(keys[1], "1000")
        document_sentences(spark, folder)
        assert [spark.conf.get(k) for k in keys] == ["50b", "1000"]
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def test_cascades_share_counts_and_words(spark, tmp_path):
    """Each join of a cascade's words, and each use of the pair counts, read all documents anew; now they are read once for the tokens of each policy."""
    from lexweave.plans import catalog

    folder = _documents(spark, tmp_path, ["Über der See", "der Weg über den See"])
    plan = lambda q: catalog.queries()[q](spark, folder)._jdf.queryExecution().optimizedPlan().toString().count("posexplode(")
    assert plan("d19_cascade_v4") == 1 and plan("p6_policies") == 5


def test_distances_are_of_whole_words(spark):
    """Only the first 64 letters were compared."""
    from lexweave.operators import features as M

    start = "a" * 64
    counts = spark.createDataFrame([("it", start + "bcd", start + "bxy", 1)], "lang string, raw string, norm string, n long")
    row = M.monoise_features(counts.select("lang", "raw", F.col("norm").alias("cand"), F.array(F.lit("lookup")).alias("sources")), counts).first()
    assert (row["edit_distance"], row["norm_edit_distance"]) == (2, round(2 / 67, 6))


def test_context_is_worked_out_with_the_explode(spark, tmp_path):
    """A lambda parted the steps: each word's row held its sentence's array, and all rows of a sentence were held at once."""
    from lexweave.operators import rules as R

    folder = _documents(spark, tmp_path, ["a b d c", "x"])
    t = R.context_window(document_pairs(spark, folder)).select("sent_id", "pos", "left", "right")
    assert [tuple(r)[1:] for r in t.orderBy("sent_id", "pos").collect()] == [(0, "", "b d"), (1, "a", "d c"), (2, "a b", "c"), (3, "b d", ""), (0, "", "")]
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert all("*(" in line for line in plan.splitlines() if "Project" in line)


def test_detectors_work_on_words(spark, tmp_path):
    """Functions in Python stood beside the explode and were handed a sentence's array with every word; tokens were exchanged for each table."""
    from lexweave.operators import features as M
    from lexweave.operators import stats as S
    from lexweave.sources.artifacts import stored

    t = document_pairs(spark, _documents(spark, tmp_path, ["Über der See", "der See"])).withColumn("lang", F.when(F.col("sent_id") == 0, F.col("lang")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for detector in (M.japanese_detector, M.italian_detector):
            rows = detector(t, stored(S.pair_counts(t), "pair-counts"))
            lines = rows._jdf.queryExecution().executedPlan().toString().splitlines()
            for i, line in enumerate(lines):
                if "EvalPython" in line:
                    assert "Generate" not in "\n".join(itertools.takewhile(lambda x: "Exchange" not in x, lines[i:]))
            got = {(r["sent_id"], r["pos"]): (r["len"], r["raw_seen"]) for r in rows.collect()}
            assert got == {(0, 0): (4, 1), (0, 1): (3, 1), (0, 2): (3, 1), (1, 0): (3, 0), (1, 1): (3, 0)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_backoff_shares_exchanges(spark, tmp_path):
    """Each table asked for other filters below the exchange, so tokens were exchanged for each, and the tables again for the joins."""
    from lexweave.operators import predict as P
    from lexweave.operators import stats as S

    t = document_pairs(spark, _documents(spark, tmp_path, ["A b c", "a b c d", "Ä b", "x", "a b c"]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # The mark of a null: a neighbour that is missing stands in no table of neighbours, and its word is counted.
        odd = t.withColumns({"prev": F.when(F.col("pos") != 1, F.col("prev")), "next": F.when(F.col("sent_id") != 2, F.col("next"))})
        tables = {k: {tuple(r) for r in v.collect()} for k, v in S.context_tables(odd).items()}
        assert tables["unigram"] == {("de", "a", "a"), ("de", "b", "b"), ("de", "c", "c"), ("de", "d", "d"), ("de", "x", "x")}
        assert tables["bigram"] == {("de", "a", "b", "a"), ("de", "b", "c", "b"), ("de", "c", "d", "c")} and tables["trigram"] == {("de", "b", "c", "d", "c")}
        out = P.backoff(t.where("fold = 0"), S.context_tables(t.where("fold <> 0")))
        got = [tuple(r) for r in out.select("pos", "norm", "pred", "decision").orderBy("pos").collect()]
        assert got == [(0, "A", "a", "bigram"), (1, "b", "b", "trigram"), (2, "c", "c", "unigram")]
        rows = out._jdf
        rows.collectToPython()
        plan = rows.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert sum(" Exchange hashpartitioning" in line and "Reused" not in line for line in plan.splitlines()) <= 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
