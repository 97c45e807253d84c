"""Features of tokens and candidates as plain numeric and string columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import protect as K
from lexweave.functions import tables as T
from lexweave.functions import text as X
from lexweave.functions import unicode as U
from lexweave.operators import stats as S
from lexweave.sources.sentences import BOS, EOS


def position(tokens: DataFrame) -> DataFrame:
    """Share of the sentence before the token, thirds of it, and whether it is first or last."""
    f = F.round(F.col("pos") / F.greatest(F.col("size") - 1, F.lit(1)), 6)
    return tokens.withColumns({"position": f, "bucket": F.when(F.col("pos") == 0, "first").when(F.col("pos") == F.col("size") - 1, "last").otherwise("middle")})


def token_features(x: str = "raw") -> dict[str, Column]:
    """Surface features that all detectors share."""
    c = F.col(x)
    low = F.lower(c)
    return {
        "length": F.least(F.length(c), F.lit(30)),
        "letters": F.regexp_count(c, F.lit(r"\p{L}")),
        "digits": F.regexp_count(c, F.lit(r"\p{Nd}")),
        "capitals": F.regexp_count(c, F.lit(r"\p{Lu}")),
        "accents": (F.length(c) - F.length(F.regexp_replace(c, r"[^\x00-\x7F]", ""))),
        "repeats": c.rlike(r"(.)\1{2,}").cast("int"),
        "laughter": low.rlike("(ja){2,}|(ah|ha){2,}").cast("int"),
        "apostrophe": X.plain_apostrophe(c).contains("'").cast("int"),
        "protected": X.protected_k1(c).cast("int"),
        "upper": X.is_upper(c).cast("int"),
        "lower": X.is_lower(c).cast("int"),
        "shape": X.shape_es(c),
        "case": X.case_shape(c),
        "prefix3": F.substring(low, 1, 3),
        "suffix3": F.right(low, F.lit(3)),
    }


def detector_rows(tokens: DataFrame, stats: DataFrame) -> DataFrame:
    """Tokens with surface features, neighbours and what is known of the word; ``label`` is 1 where gold differs."""
    s = stats.select("lang", "raw", "total", "change_prob", "copy_prob", "best_prob", (F.col("best_norm") != F.col("raw")).cast("int").alias("best_changes"))
    t = tokens.join(s, ["lang", "raw"], "left")
    known = {k: F.coalesce(F.col(k).cast("double"), F.lit(0.0)) for k in ("total", "change_prob", "copy_prob", "best_prob", "best_changes")}
    ends = {"is_first": (F.col("prev") == BOS).cast("int"), "is_last": (F.col("next") == EOS).cast("int"), "prev_low": F.lower("prev"), "next_low": F.lower("next")}
    return t.withColumns(token_features() | known | ends | {"label": (F.col("raw") != F.col("norm")).cast("double"), "log_total": F.log1p(F.coalesce(F.col("total"), F.lit(0)))})


NUMERIC = ["length", "letters", "digits", "capitals", "accents", "repeats", "laughter", "apostrophe", "protected", "upper", "lower", "change_prob", "copy_prob", "best_prob", "best_changes", "is_first", "is_last", "log_total"]
STRINGS = ["shape", "case", "prefix3", "suffix3", "prev_low", "next_low"]


def pair_features(candidates: DataFrame, raw: str = "raw", cand: str = "cand") -> DataFrame:
    """Candidate against word: distances, key and case agreement, lengths, kind of change."""
    r, k = F.col(raw), F.col(cand)
    return candidates.withColumns({
        "is_copy": (r == k).cast("int"), "edit": F.levenshtein(r, k), "edit_cost": F.round(X.spanish_edit_cost(r, k), 6), "roman": X.roman_distance(r, k),
        "same_lower": (F.lower(r) == F.lower(k)).cast("int"), "same_key": (X.make_key(r) == X.make_key(k)).cast("int"), "same_accentless": (X.strip_accents(r) == X.strip_accents(k)).cast("int"),
        "length_diff": F.length(k) - F.length(r), "length_ratio": F.round(F.length(k) / F.greatest(F.length(r), F.lit(1)), 6), "kind": X.mapping_class(r, k), "in_order": X.keeps_order(r, k).cast("int"),
    })


def rerank_text(words: Column, pos: Column, cand: Column, window: int = 3) -> Column:
    """Tagged text of a candidate in its context, for text classifiers."""
    left = F.slice(words, F.greatest(pos - window + 1, F.lit(1)), F.least(pos, F.lit(window)))
    right = F.slice(words, pos + 2, F.lit(window))
    return F.concat_ws(" ", F.concat(F.lit("RAW="), F.get(words, pos)), F.concat(F.lit("CAND="), cand), F.concat(F.lit("LEFT="), F.concat_ws("_", left)), F.concat(F.lit("RIGHT="), F.concat_ws("_", right)))


def _count(x: Column, pattern: str, most: int | None = None) -> Column:
    n = F.regexp_count(x, F.lit(pattern))
    return n if most is None else F.least(n, F.lit(most))


def _title(x: Column) -> Column:
    """Each run of letters begins with a capital and goes on in lower case."""
    return x.rlike(r"\p{Lu}") & ~x.rlike(r"\p{L}\p{Lu}") & ~x.rlike(r"(?<!\p{L})\p{Ll}")


def _affixes(x: Column, longest: int) -> dict[str, Column]:
    out = {f"prefix{k}": F.left(x, F.lit(k)) for k in range(1, longest + 1)}
    return out | {f"suffix{k}": F.right(x, F.lit(k)) for k in range(1, longest + 1)}


def _seen(tokens: DataFrame, counts: DataFrame, key: Column | None = None) -> DataFrame:
    """What training knows of the word and of its key: seen, totals up to 10, shares, and whether the best replacement is the word."""
    raw = S.raw_stats(counts).select("lang", "raw", "total", "change_prob", "copy_prob", "best_prob", "best_norm")
    t = tokens.join(raw, ["lang", "raw"], "left")
    known = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    t = t.withColumns({
        "raw_seen": F.col("total").isNotNull().cast("int"), "raw_total": F.least(F.coalesce("total", F.lit(0)), F.lit(10)), "raw_change_prob": known("change_prob"), "raw_copy_prob": known("copy_prob"),
        "raw_best_is_copy": F.coalesce((F.col("best_norm") == F.col("raw")).cast("int"), F.lit(0)), "raw_best_prob": known("best_prob"),
    }).drop("total", "change_prob", "copy_prob", "best_prob", "best_norm")
    if key is None:
        return t
    keyed = counts.withColumn("key", key).groupBy("lang", "key", "norm").agg(F.sum("n").alias("n"))
    ks = S.most_frequent(keyed, ("lang", "key"), "T6", "key").select("lang", "key", F.col("total").alias("kt"), (F.col("best_count") / F.col("total")).alias("kp"), F.col("pred").alias("kn"))
    t = t.withColumn("key", key).join(ks, ["lang", "key"], "left")
    return t.withColumns({
        "key_seen": F.col("kt").isNotNull().cast("int"), "key_total": F.least(F.coalesce("kt", F.lit(0)), F.lit(10)), "key_best_prob": F.round(F.coalesce("kp", F.lit(0.0)), 6),
        "key_best_is_raw": F.coalesce((F.col("kn") == F.col("raw")).cast("int"), F.lit(0)),
    }).drop("kt", "kp", "kn")


def _beside(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Tokens with the columns that depend on ``lang, raw`` alone, from a table of distinct words: tokens are exchanged once, as narrow as they come, and a column is worked out once a word."""
    w = words.withColumnsRenamed({"lang": "__lang", "raw": "__raw"})
    return tokens.join(w, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("raw").eqNullSafe(F.col("__raw")), "left").drop("__lang", "__raw")


def spanish_detector(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """Detector features of Spanish tokens: keys of word and neighbours, affixes of the key, counts, and what training knows of word and key."""
    raw, low = F.col("raw"), F.lower("raw")
    t = _seen(tokens, counts, X.spanish_key("raw"))
    return t.withColumns({
        "raw_lower": low, "shape": X.shape_es(raw), "left_key": X.spanish_key("prev"), "right_key": X.spanish_key("next"),
        "len": F.least(F.length(raw), F.lit(30)), "letters": _count(raw, r"\p{L}", 30), "digits": _count(raw, r"\p{Nd}", 30), "punct": _count(raw, r"[^\p{L}\p{N}]", 30),
        "is_protected": X.protected_k2(raw).cast("int"), "has_long_repetition": raw.rlike(r"(?s)(.)\1{2,}").cast("int"), "has_accent": (X.deaccent_spanish(raw) != raw).cast("int"),
        "is_all_lower": X.is_lower(raw).cast("int"), "is_all_upper": X.is_upper(raw).cast("int"), "has_kqxw": low.rlike("[kqxw]").cast("int"),
    } | _affixes(F.col("key"), 3))


def italian_detector(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """Detector features of Italian tokens: as the Spanish ones on lower-cased words, with marks of tags, apostrophes and laughter, and the case statistics of the lower-cased word."""
    raw, low = F.col("raw"), F.lower("raw")
    case = counts.withColumn("case", X.case_shape("norm")).groupBy("lang", F.lower("norm").alias("key")).agg(F.sum("n").alias("total"), *(F.sum(F.when(F.col("case") == s, F.col("n")).otherwise(0)).alias(s) for s in ("lower", "upper", "title")))
    t = _seen(tokens.select("lang", "raw").distinct(), counts, X.make_key("raw"))
    t = t.withColumns({
        "raw_lower": low, "shape": X.shape_es(raw),
        "len": F.least(F.length(raw), F.lit(30)), "letters": _count(raw, r"\p{L}", 30), "digits": _count(raw, r"\p{Nd}", 30), "punct": _count(raw, r"[^\p{L}\p{N}]", 30),
        "is_protected": X.protected_k1(raw).cast("int"), "starts_at": raw.startswith("@").cast("int"), "starts_hash": raw.startswith("#").cast("int"), "starts_http": raw.rlike("^https?://").cast("int"),
        "is_digit_like": raw.rlike(r"^\p{Nd}+([.,:/-]\p{Nd}+)*$").cast("int"), "has_long_repetition": raw.rlike(r"(?s)(.)\1{2,}").cast("int"), "has_laughter": low.rlike("(ah|ha){2,}").cast("int"),
        "has_accent": (X.strip_accents(raw) != raw).cast("int"), "has_apostrophe": X.plain_apostrophe(raw).contains("'").cast("int"), "is_all_lower": X.is_lower(raw).cast("int"), "is_all_upper": X.is_upper(raw).cast("int"),
        "is_title": _title(raw).cast("int"), "has_qkx": low.rlike("[qkx]").cast("int"), "has_underscore": raw.contains("_").cast("int"),
    } | _affixes(low, 3))
    share = lambda c: F.round(F.coalesce(F.col(c) / F.col("case_all"), F.lit(0.0)), 6)
    case = case.select("lang", F.col("key").alias("raw_lower"), F.col("total").alias("case_all"), F.col("lower").alias("cl"), F.col("upper").alias("cu"), F.col("title").alias("ct"))
    t = t.join(case, ["lang", "raw_lower"], "left")
    t = t.withColumns({"case_seen": F.col("case_all").isNotNull().cast("int"), "case_total": F.least(F.coalesce("case_all", F.lit(0)), F.lit(10)), "case_lower": share("cl"), "case_upper": share("cu"), "case_title": share("ct")}).drop("case_all", "cl", "cu", "ct")
    return _beside(tokens, t).withColumns({"left_lower": F.lower("prev"), "right_lower": F.lower("next")})


def croatian_detector(tokens: DataFrame, mfr: DataFrame) -> DataFrame:
    """Detector features of Croatian tokens: two neighbours on each side, pairs with them, character shares, affixes of one to four, and the most frequent replacement."""
    raw, low = F.col("raw"), F.lower("raw")
    near = {k: F.lower(c) for k, c in (("prev1", "prev"), ("prev2", "prev2"), ("next1", "next"), ("next2", "next2"))}
    n = F.greatest(F.length(raw), F.lit(1))
    share = lambda p: F.round(_count(raw, p) / n, 6)
    t = tokens.join(mfr.select("lang", "raw", F.col("pred").alias("m")), ["lang", "raw"], "left").withColumns(near)
    return t.withColumns({
        "tok": low, "prev_bigram": F.concat_ws("|", "prev1", low), "next_bigram": F.concat_ws("|", low, "next1"), "len": F.length(raw), "sent_len": F.col("size"), "pos_abs": F.col("pos"),
        "pos_rel": F.round(F.col("pos") / F.greatest(F.col("size") - 1, F.lit(1)), 6), "is_lower": X.is_lower(raw).cast("int"), "is_upper": X.is_upper(raw).cast("int"), "is_title": _title(raw).cast("int"),
        "has_alpha": raw.rlike(r"\p{L}").cast("int"), "has_digit": raw.rlike(r"\p{Nd}").cast("int"), "has_punct": raw.rlike(r"[^\p{L}\p{N}]").cast("int"), "has_at": raw.contains("@").cast("int"), "has_hash": raw.contains("#").cast("int"),
        "has_url_piece": low.rlike(r"http|www|\.com").cast("int"), "repeated_char": raw.rlike(r"(?s)(.)\1").cast("int"), "digit_ratio": share(r"\p{Nd}"), "upper_ratio": share(r"\p{Lu}"), "punct_ratio": share(r"[^\p{L}\p{N}]"), "alpha_ratio": share(r"\p{L}"),
        "mfr_seen": F.col("m").isNotNull().cast("int"), "mfr_would_change": F.coalesce((F.col("m") != raw).cast("int"), F.lit(0)), "mfr_pred": F.lower(F.coalesce("m", raw)),
    } | {k: F.when(F.length(low) >= int(k[-1]), v) for k, v in _affixes(low, 4).items()}).drop("m")


def japanese_detector(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """Detector features of Japanese tokens: keys, shapes and counts by script, and what training knows of word and key."""
    raw = F.col("raw")
    t = _seen(tokens.select("lang", "raw").distinct().withColumn("nfkc", U.nfkc("raw")), counts, U.japanese_key("raw"))
    n = {"hira": r"[\x{3040}-\x{309F}]", "kata": r"[\x{30A0}-\x{30FF}]", "kanji": r"[\x{4E00}-\x{9FFF}]", "digits": r"\p{Nd}", "latin": "[A-Za-z]", "punct": r"[^\p{L}\p{N}]"}
    t = t.withColumns({k: _count(raw, p) for k, p in n.items()})
    some = lambda k: (F.col(k) > 0).cast("int")
    t = t.withColumns({
        "shape": X.shape_ja(raw), "len": F.least(F.length(raw), F.lit(30)), "is_protected": K.protected_k6(raw).cast("int"),
        "has_hiragana": some("hira"), "has_katakana": some("kata"), "has_kanji": some("kanji"), "has_kana": ((F.col("hira") + F.col("kata")) > 0).cast("int"), "has_long_repetition": raw.rlike(r"(?s)(.)\1{2,}").cast("int"),
        "nfkc_changed": (raw != F.col("nfkc")).cast("int"), "kata_to_hira_changed": (U.hiragana("nfkc") != F.col("nfkc")).cast("int"),
        "all_katakana": ((F.col("kata") > 0) & (F.col("hira") + F.col("kanji") == 0)).cast("int"), "all_hiragana": ((F.col("hira") > 0) & (F.col("kata") + F.col("kanji") == 0)).cast("int"),
        "mixed_script": (some("hira") + some("kata") + some("kanji") + some("latin") >= 2).cast("int"),
    } | _affixes(F.col("key"), 3))
    t = t.withColumns({k: F.least(F.col(k), F.lit(30)) for k in n})
    # After the exchange: a function in Python beside the explode is handed the sentence's array with every word.
    return _beside(tokens, t).withColumns({"left_key": U.japanese_key("prev"), "right_key": U.japanese_key("next")})


#: The numbers of a Thai token, in order.
THAI_FEATURES = (
    "len log_total thai_ratio latin_ratio digit_ratio has_thai has_latin has_digit is_url is_hashtag is_mention mostly_thai mixed_script n_tone n_hanging n_leading n_following "
    "has_repeat has_repeat_mark normal_changes normal_edit in_gold in_errors in_mfr mfr_changes mfr_conf mfr_change_rate mfr_log_total n_errors n_rules prev_thai next_thai prev_sure next_sure pos_ratio log_size"
).split()


def thai_features(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """THAI_FEATURES of each token, as columns; word-level numbers are joined, those of the neighbours too."""
    raw = F.col("raw")
    m = S.with_confidence(S.most_frequent(counts, tie="T3")).select("lang", "raw", F.col("pred").alias("m"), "conf", "total", (1 - F.col("copy") / F.col("total")).alias("rate"))
    gold = counts.select("lang", F.col("norm").alias("raw"), F.lit(1).alias("gold")).distinct()
    errors = counts.where("norm <> raw").groupBy("lang", "raw").agg(F.count("*").alias("errors"))
    w = tokens.select("lang", "raw").distinct().join(m, ["lang", "raw"], "left").join(gold, ["lang", "raw"], "left").join(errors, ["lang", "raw"], "left")
    flag = lambda c: c.cast("double")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    tr, lr, dr, normal = K.thai_ratio(raw), K.latin_ratio(raw), K.digit_ratio(raw), U.thai_normal(raw)
    marks = f"[{T.TH_TONES}{T.TH_HANGING}]"
    w = w.withColumns({
        "len": flag(F.length(raw)), "log_total": F.log1p(zero("total")), "thai_ratio": tr, "latin_ratio": lr, "digit_ratio": dr, "has_thai": flag(tr > 0), "has_latin": flag(raw.rlike("[A-Za-z]")), "has_digit": flag(raw.rlike("[0-9]")),
        "is_url": flag(K.thai_address(raw)), "is_hashtag": flag(raw.startswith("#")), "is_mention": flag(raw.startswith("@")), "mostly_thai": flag(tr >= 0.95), "mixed_script": flag((tr > 0) & ((lr > 0) | (dr > 0))),
        "n_tone": flag(_count(raw, f"[{T.TH_TONES}]")), "n_hanging": flag(_count(raw, f"[{T.TH_HANGING}]")), "n_leading": flag(_count(raw, f"[{T.TH_LEADING}]")), "n_following": flag(_count(raw, f"[{T.TH_FOLLOWING}]")),
        "has_repeat": flag(raw.rlike(r"(?s)(.)\1")), "has_repeat_mark": flag(raw.rlike(rf"({marks})\1")), "normal_changes": flag(normal != raw), "normal_edit": flag(X.edit_distance(raw, normal, 6)),
        "in_gold": zero("gold"), "in_errors": flag(F.col("errors").isNotNull()), "in_mfr": flag(F.col("m").isNotNull()), "mfr_changes": flag(F.coalesce(F.col("m") != raw, F.lit(False))), "mfr_conf": zero("conf"), "mfr_change_rate": zero("rate"),
        "mfr_log_total": F.log1p(zero("total")), "n_errors": zero("errors"), "n_rules": flag(F.size(U.thai_rule_forms(raw))), "sure": flag(F.coalesce((F.col("m") != raw) & (F.col("conf") >= 0.8), F.lit(False))),
    }).drop("m", "conf", "total", "rate", "gold", "errors")
    sure = w.select("lang", "raw", "sure")
    t = tokens.join(w.drop("sure"), ["lang", "raw"], "left")
    for side in ("prev", "next"):
        t = t.join(sure.withColumnRenamed("raw", side).withColumnRenamed("sure", f"{side}_sure"), ["lang", side], "left")
        # A neighbour that is no word of these tokens has nothing that training is sure of.
        t = t.withColumns({f"{side}_sure": zero(f"{side}_sure"), f"{side}_thai": flag(F.col(side).rlike(K.THAI))})
    return t.withColumns({"pos_ratio": F.when(F.col("size") > 1, F.col("pos") / (F.col("size") - 1)).otherwise(0.0), "log_size": F.log1p(F.col("size").cast("double"))})


def italian_ranker(tokens: DataFrame, candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """A row for each token and candidate with identity, context, shape, position, sentence, vocabulary and edit features.

    ``tokens`` need ``caps_ratio``, the sentence's share of capitals (``protect.caps_ratio`` of its words).
    """
    shares = S.pair_shares(counts).select("lang", "raw", "cand", F.col("n").alias("mfr_n"), F.col("total").alias("mfr_t"), "conf", "entropy")
    top = S.most_frequent(counts).select("lang", "raw", F.col("pred").alias("m"))
    seen = counts.groupBy("lang", "raw").agg(F.sum("n").alias("raw_n"))
    gold = counts.groupBy("lang", F.col("norm").alias("cand")).agg(F.sum("n").alias("cand_n"))
    lows = counts.select("lang", F.lower("norm").alias("cand_lower"), F.lit(1).alias("low_seen")).distinct()
    c = candidates.select("lang", "raw", "cand").distinct().withColumn("cand_lower", F.lower("cand"))
    c = c.join(shares, ["lang", "raw", "cand"], "left").join(top, ["lang", "raw"], "left").join(seen, ["lang", "raw"], "left").join(gold, ["lang", "cand"], "left").join(lows, ["lang", "cand_lower"], "left")
    raw, cand = F.col("raw"), F.col("cand")
    zero = lambda x: F.coalesce(F.col(x).cast("double"), F.lit(0.0))
    bare = F.translate(raw, "'`´", "")
    c = c.withColumns({
        "raw_lower": F.lower(raw), "pair": F.concat_ws("->", F.lower(raw), "cand_lower"), "raw_shape": X.shape_class(raw), "cand_shape": X.shape_class(cand), "is_copy": (raw == cand).cast("int"), "is_changed": (raw != cand).cast("int"),
        "is_cap_only": X.case_only(raw, cand).cast("int"), "is_diacritic_like": ((F.lower(bare) != F.lower(raw)) | F.concat(raw, cand).rlike("[àèéìòùÀÈÉÌÒÙ]")).cast("int"), "is_protected": X.protected_k3(raw).cast("int"),
        "mfr_conf": zero("conf"), "mfr_count_log": F.log(zero("mfr_n") + 1), "mfr_total_log": F.log(zero("mfr_t") + 1), "mfr_entropy": zero("entropy"), "is_mfr_top": F.coalesce((F.col("m") == cand).cast("int"), F.lit(0)),
        "raw_seen_log": F.log(zero("raw_n") + 1), "cand_norm_seen_log": F.log(zero("cand_n") + 1), "cand_norm_lower_seen": F.coalesce("low_seen", F.lit(0)), "edit_distance": X.edit_distance(raw, cand, 4),
        "length_delta": F.length(cand) - F.length(raw), "raw_len_bin": X.short_length_bin(raw), "cand_len_bin": X.short_length_bin(cand),
    }).drop("conf", "mfr_n", "mfr_t", "entropy", "m", "raw_n", "cand_n", "low_seen")
    t = tokens.join(c, ["lang", "raw"])
    prev, nxt = F.lower("prev"), F.lower("next")
    return t.withColumns({
        "prev_lower": prev, "next_lower": nxt, "prev_shape": X.shape_class("prev"), "next_shape": X.shape_class("next"), "prev_cand_bigram": F.concat_ws("_", prev, "cand_lower"), "cand_next_bigram": F.concat_ws("_", "cand_lower", nxt),
        "position_bucket": X.position_bin("pos", "size"), "is_first": (F.col("pos") == 0).cast("int"), "is_last": (F.col("pos") == F.col("size") - 1).cast("int"), "sent_allcaps_ratio_bin": X.ratio_bin("caps_ratio"),
    })


def monoise_features(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Numbers of candidates (``lang, raw, cand, sources``): sources, counts of word, key and case, frequencies, agreement and case of word and candidate."""
    raw, cand = F.col("raw"), F.col("cand")
    log = lambda x: F.round(F.log1p(F.coalesce(F.col(x).cast("double"), F.lit(0.0))), 6)
    share = lambda a, b: F.round(F.coalesce(F.col(a) / F.col(b), F.lit(0.0)), 6)
    total = counts.groupBy("lang", "raw").agg(F.sum("n").alias("rt"), F.sum(F.when(F.col("norm") == raw, F.col("n")).otherwise(0)).alias("cc"))
    c = candidates.withColumns({"key": X.make_key("raw"), "low": F.lower("raw")})
    c = c.join(total, ["lang", "raw"], "left").join(counts.select("lang", "raw", F.col("norm").alias("cand"), F.col("n").alias("pc")), ["lang", "raw", "cand"], "left")
    for key, expr, name in (("key", X.make_key("raw"), "k"), ("low", F.lower("norm"), "l")):
        table = counts.withColumn(key, expr).groupBy("lang", key, F.col("norm").alias("cand")).agg(F.sum("n").alias(f"{name}c"))
        c = c.join(table, ["lang", key, "cand"], "left").join(table.groupBy("lang", key).agg(F.sum(f"{name}c").alias(f"{name}t")), ["lang", key], "left")
    c = c.join(counts.groupBy("lang", F.col("norm").alias("cand")).agg(F.sum("n").alias("f")), ["lang", "cand"], "left")
    from_ = lambda *names: F.arrays_overlap("sources", F.array(*map(F.lit, names))).cast("int")
    i = lambda x: x.cast("int")
    dist, bare = F.levenshtein(F.lower(raw), F.lower(cand)), lambda x: F.lower(X.strip_accents(x))
    capped = lambda x, k: F.least(x, F.lit(k))
    return c.withColumns({
        "is_original": i(cand == raw), **{f"from_{s}": from_(s) for s in ("original", "lookup", "mfr", "key", "case")}, "from_rule": from_("rule", "rule_lower"), "from_repeat": from_("repeat"), "num_sources": F.size("sources"),
        "raw_seen": i(F.coalesce(F.col("rt") > 0, F.lit(False))), "raw_total_log": log("rt"), "pair_count_log": log("pc"), "pair_conf": share("pc", "rt"), "copy_count_log": log("cc"), "copy_conf": share("cc", "rt"), "key_count_log": log("kc"), "key_conf": share("kc", "kt"),
        "case_count_log": log("lc"), "case_conf": share("lc", "lt"), "cand_freq_log": log("f"), "same_lower": i(F.lower(raw) == F.lower(cand)), "same_key": i(F.col("key") == X.make_key("cand")), "same_accentless": i(bare(raw) == bare(cand)),
        "edit_distance": capped(dist, 10), "norm_edit_distance": F.round(dist / F.greatest(F.length(raw), F.length(cand), F.lit(1)), 6), "len_raw": capped(F.length(raw), 40), "len_cand": capped(F.length(cand), 40), "len_diff": capped(F.abs(F.length(raw) - F.length(cand)), 40),
        "chars_order_preserved": i(X.keeps_order("raw", "cand")), "contains_alpha_raw": i(raw.rlike(r"\p{L}")), "contains_alpha_cand": i(cand.rlike(r"\p{L}")), "raw_has_accent": i(X.strip_accents(raw) != raw), "cand_has_accent": i(X.strip_accents(cand) != cand),
        "accent_added_or_fixed": i((bare(raw) == bare(cand)) & (raw != cand)), "raw_has_apostrophe": i(X.plain_apostrophe(raw).contains("'")), "cand_has_apostrophe": i(X.plain_apostrophe(cand).contains("'")), "apostrophe_changed": i(X.plain_apostrophe(raw) != X.plain_apostrophe(cand)),
        "raw_all_upper": i(X.is_upper(raw)), "raw_all_lower": i(X.is_lower(raw)), "raw_title": i(_title(raw)), "cand_all_upper": i(X.is_upper(cand)), "cand_all_lower": i(X.is_lower(cand)), "cand_title": i(_title(cand)),
    }).drop("key", "low", "rt", "cc", "pc", "kc", "kt", "lc", "lt", "f")


#: The numbers of ``monoise_features``, which pairs carry for candidate and base.
MONOISE = (
    "is_original from_original from_lookup from_mfr from_key from_case from_rule from_repeat num_sources raw_seen raw_total_log pair_count_log pair_conf copy_count_log copy_conf key_count_log key_conf case_count_log case_conf cand_freq_log "
    "same_lower same_key same_accentless edit_distance norm_edit_distance len_raw len_cand len_diff chars_order_preserved contains_alpha_raw contains_alpha_cand raw_has_accent cand_has_accent accent_added_or_fixed raw_has_apostrophe "
    "cand_has_apostrophe apostrophe_changed raw_all_upper raw_all_lower raw_title cand_all_upper cand_all_lower cand_title"
).split()


def accept_features(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of ``policies.accept_pairs`` with the numbers of candidate and base (prefixes ``cand__``, ``base__``), of their sources and scores, and how word, base and candidate relate."""
    from lexweave.operators.candidates import source_sets

    cand = monoise_features(pairs, counts).select(*pairs.columns, *(F.col(k).alias(f"cand__{k}") for k in MONOISE))
    bases = pairs.select("lang", "raw", F.col("base").alias("cand"), F.col("base_sources").alias("sources")).distinct()
    base = monoise_features(bases, counts).select("lang", "raw", F.col("cand").alias("base"), *(F.col(k).alias(f"base__{k}") for k in MONOISE))
    t = cand.join(base, ["lang", "raw", "base"])
    sets = {f"cand_{k}": v for k, v in source_sets(F.col("sources")).items()} | {f"base_{k}": v for k, v in source_sets(F.col("base_sources")).items()}
    i = lambda x: x.cast("int")
    delta = F.round(F.col("score") - F.col("base_score"), 6)
    t = t.withColumns(sets).withColumns({
        "score_delta_cand_base": delta, "score_delta_cand_best": F.round(F.col("score") - F.col("top_score"), 6), "base_eq_raw": i(F.col("base") == F.col("raw")), "cand_eq_raw": i(F.col("cand") == F.col("raw")),
        "cand_lower_eq_base_lower": i(F.lower("cand") == F.lower("base")), "cand_lower_eq_raw_lower": i(F.lower("cand") == F.lower("raw")), "len_diff_cand_base": F.least(F.abs(F.length("cand") - F.length("base")), F.lit(40)),
        "raw_seen_total_log": F.round(F.log1p("total"), 6), "weak_only_and_low_mfr_conf": i((F.col("cand_weak_only") == 1) & (F.col("conf") < 0.8)), "strong_source_and_high_delta": i((F.col("cand_has_strong") == 1) & (delta > 0.05)),
        "case_key_only_risk": i(F.size(F.array_except("sources", F.array(*map(F.lit, ("case", "key", "diacritic"))))) == 0),
    })
    return t


def korean_change_text(words: Column, pos: Column, window: int = 3) -> Column:
    """Tagged text of a word for a change classifier: the word, its letters, neighbours and marked context."""
    raw = F.get(words, pos)
    left = F.slice(words, F.greatest(pos - window + 1, F.lit(1)), F.least(pos, F.lit(window)))
    context = F.array_join(F.concat(left, F.array(F.lit("<T>"), raw, F.lit("</T>")), F.slice(words, pos + 2, F.lit(window))), " ")
    return F.concat(F.lit("raw="), raw, F.lit(" jamo="), X.jamo(raw), F.lit(" prev="), F.coalesce(F.get(words, pos - 1), F.lit(BOS)), F.lit(" next="), F.coalesce(F.get(words, pos + 1), F.lit(EOS)), F.lit(" ctx="), context)


def neighbour_text(tokens: DataFrame) -> Column:
    """``prev raw next`` with empty strings beyond the ends."""
    inner = lambda x: F.when(F.col(x).isin(BOS, EOS), "").otherwise(F.col(x))
    return F.concat(inner("prev"), F.lit(" "), F.col("raw"), F.lit(" "), inner("next"))
