"""The pipeline on a small corpus: every stage against what it must keep, the last one against all tokens."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from lexweave.llm import queries, tokenization

from .test_operators import brute_substrings

PARTS = {"xx": ["ka", "ri", "mo", "tel", "bu"], "yy": ["sch", "ung", "eit", "zu", "ach"], "zz": ["ño", "ción", "las", "que", "es"]}


def words_of(rng, lang, n):
    return ["".join(rng.choices(PARTS[lang], k=rng.choice([2, 3, 4]))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    texts = {i: words_of(rng, list(PARTS)[i % 3], 120) for i in range(150)}
    item = words_of(rng, "xx", 30)
    passage = words_of(rng, "yy", 60)
    texts[200] = list(texts[3])  # an exact copy
    texts[201] = [*texts[4][:60], "kabu", *texts[4][61:]]  # a near one
    texts[202] = [*texts[150 - 7][:40], *item, *words_of(rng, "xx", 40)]  # a leak
    for i in (203, 204):
        texts[i] = words_of(rng, "yy", 70) + passage + words_of(rng, "yy", 70)
    rows = [(i, " ".join(w), list(PARTS)[i % 3] if i < 150 else None, ["a", "b"][i % 2], 0) for i, w in texts.items()]
    rows += [(300, None, "xx", "a", 0), (301, "", "yy", "b", 0), (302, "12 34 !", "zz", None, 0), (None, " ".join(words_of(rng, "zz", 90)), "zz", "a", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts, item, passage


def stages(spark, path):
    docs, out = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        out[name] = docs.cache()
    return out


def test_stages_keep_what_they_must(spark, corpus):
    path, texts, item, passage = corpus
    kept = stages(spark, path)
    columns = spark.read.parquet(f"{path}/documents.parquet").columns
    assert all(df.columns == columns for df in kept.values())
    ids = {name: {r["doc_id"] for r in df.collect()} for name, df in kept.items()}
    assert ids["language_id"] == {*texts, None}
    assert ids["near_duplicates"] == {*texts, None} - {200, 201}
    assert ids["substring_dedup"] == ids["near_duplicates"]
    before = [(r["doc_id"] if r["doc_id"] is not None else 1 << 62, r["text"]) for r in kept["near_duplicates"].collect()]
    after = {r["doc_id"] if r["doc_id"] is not None else 1 << 62: r["text"] for r in kept["substring_dedup"].collect()}
    for d, _, removed, text in brute_substrings(before):
        assert after[d] == text if removed else after[d] == dict(before)[d]
    assert " ".join(passage) in after[203] and " ".join(passage) not in after[204]
    assert ids["decontamination"] == ids["substring_dedup"] - {202}


def test_run_packs_all_tokens_of_what_is_left(spark, corpus):
    path = corpus[0]
    enc = tokenization.encoder(tokenization.default_path())
    left = stages(spark, path)["decontamination"].collect()
    pieces = {}
    for p in corpus_pipeline.run(spark, path).collect():
        pieces.setdefault(p["doc_id"], []).append(p)
    assert set(pieces) == {r["doc_id"] for r in left}
    for r in left:
        ids, at = np.array(enc.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4"), 0
        for p in sorted(pieces[r["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)


def test_queries_have_the_columns_they_promise(spark, corpus, tmp_path):
    """Thin queries: their columns and one row a document, over whole tables."""
    path, texts, *_ = corpus
    found = queries.queries()
    n = spark.read.parquet(f"{path}/documents.parquet").count()
    spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "u", "<article><p>Some text of a page.</p></article>"), (None, None, None)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    promised = {
        "op1_token_files": "doc_id start n_tokens ids_crc32", "op2_toxicity": "doc_id held_out score predicted", "op7_language_id": "doc_id held_out lang_pred score", "op8_substring_dedup": "doc_id n_words n_removed kept_sha256",
        "op10_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op4_near_duplicates": "doc_id class_id", "op6_quality_model": "doc_id held_out expected_grade tail kept",
    }
    for name, columns in promised.items():
        df = found[name](spark, path)
        assert set(columns.split()) <= set(df.columns) and df.count() == n, name
    assert found["op3_html_text"](spark, path).select("page_id", "url", "text", "n_chars").count() == 2
    assert {r["doc_id"] for r in found["op5_decontamination"](spark, path).collect()} == {202}
    pieces = found["op9_packing"](spark, path)
    assert set("doc_id start length ids_crc32 doc_tokens sequence_id offset".split()) <= set(pieces.columns)
    assert re.fullmatch("[0-9a-f]{64}", found["op8_substring_dedup"](spark, path).first()["kept_sha256"])


def test_stages_keep_columns_of_any_name(spark, corpus):
    """Columns that operators use themselves come through as they were; an empty table passes all stages."""
    from pyspark.sql import functions as F

    path = corpus[0]
    names = ("lang_pred", "lang_score", "n_words", "n_removed", "class_id", "part", "k", "t", "keys")
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in names})
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, empty = stage(spark, docs, path).cache(), stage(spark, empty, path)
        assert docs.columns == empty.columns and set(names) <= set(docs.columns) and empty.count() == 0
        for r in docs.select("doc_id", *names).collect():
            assert all(r[c] == f"{c} of {'none' if r['doc_id'] is None else r['doc_id']}" for c in names)
    assert corpus_pipeline.STAGES[-1][1](spark, empty, path).count() == 0
