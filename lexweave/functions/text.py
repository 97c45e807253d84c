"""Token functions as Column expressions: keys, shapes, predicates, distances, taxonomy.

Java's ``\\w`` and ``\\d`` are ASCII unless ``(?U)`` says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions.tables import ES_CHAT, KO_ENDINGS

# Accented Latin letters and their base letters.
_LATIN = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćČčĎďĒēĖėĘęĚěĞğĪīŁłŃńŇňŌōŐőŘřŚśŞşŠšŤťŪūŮůŰűŹźŻżŽž"
_LATIN_BASE = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcDdEeEeEeEeGgIiŁłNnNnOoOoRrSsSsSsTtUuUuUuZzZzZz"
# Italian chat abbreviations.
SMS = "nn nnt cmq cqm ke ki x xke xké xkè xche xchè xché perke perké perkè grz qnd cn dv qst qsto qsta qsti qste tt sn sx dx info nov".split()


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_accents(x) -> Column:
    return F.translate(c(x), _LATIN, _LATIN_BASE)


def deaccent_spanish(x) -> Column:
    return F.translate(c(x), "áéíóúüñÁÉÍÓÚÜÑ", "aeiouunAEIOUUN")


def plain_apostrophe(x) -> Column:
    return F.translate(c(x), "’`´", "'''")


def collapse(x, most: int = 2) -> Column:
    """Runs of one character longer than ``most`` become ``most``."""
    return F.regexp_replace(c(x), r"(?s)(.)\1{%d,}" % most, "$1" * most)


def make_key(x) -> Column:
    return collapse(strip_accents(F.lower(plain_apostrophe(x))), 2)


def spanish_key(x) -> Column:
    return collapse(deaccent_spanish(F.lower(F.translate(plain_apostrophe(x), "“”", '""'))), 2)


def strip_marks(x) -> Column:
    """Without apostrophes and accents, in lower case."""
    return F.lower(strip_accents(F.replace(plain_apostrophe(x), F.lit("'"), F.lit(""))))


def is_lower(x) -> Column:
    return (c(x) == F.lower(c(x))) & (c(x) != F.upper(c(x)))


def is_upper(x) -> Column:
    return (c(x) == F.upper(c(x))) & (c(x) != F.lower(c(x)))


def first_upper(x) -> Column:
    return is_upper(F.substring(c(x), 1, 1))


def rest(x) -> Column:
    return F.substr(c(x), F.lit(2))


def protected_k1(x) -> Column:
    """Blank, mention, hashtag, address, digits or signs alone."""
    x = c(x)
    return (F.trim(x) == "") | x.rlike("^[@#]") | x.rlike("^https?://") | x.rlike(r"(?U)^\d+([.,:/-]\d+)*$") | x.rlike(r"(?U)^[\W_]+$")


def protected_k2(x) -> Column:
    return protected_k1(x) | c(x).rlike(r"^www\.") | c(x).rlike("^[A-ZÁÉÍÓÚÜÑ]{2,5}$")


def protected_k3(x) -> Column:
    return c(x).rlike(r"(?i)^(https?://|www\.)") | c(x).rlike(r"(?U)^@\w+") | c(x).rlike(r"^#\S+") | c(x).rlike(r"(?U)^[^\wÀ-ÖØ-öø-ÿ]+$")


def shape_es(x) -> Column:
    """A upper, a lower, 0 digit, other signs as they are; runs over two shortened to two."""
    s = F.regexp_replace(c(x), r"\p{Lu}", "A")
    s = F.regexp_replace(s, r"\p{Ll}", "a")
    return collapse(F.regexp_replace(s, r"\p{Nd}", "0"), 2)


# Kana that decompose into a letter and a voicing mark.
_VOICED = "がぎぐげござじずぜぞだぢづでどばびぶべぼぱぴぷぺぽゔゞガギグゲゴザジズゼゾダヂヅデドバビブベボパピプペポヴヷヸヹヺヾ"


def shape_marked(x, mark: str = "á") -> Column:
    """``shape_es`` with one sign for the letters without case that decompose: Hangul syllables and voiced kana."""
    return collapse(F.regexp_replace(shape_es(x), rf"[\x{{AC00}}-\x{{D7A3}}{_VOICED}]", mark), 2)


def shape_ja(x) -> Column:
    """H hiragana, K katakana, C kanji, 0 digit, a other letters, signs as they are; runs over two shortened to two."""
    s = F.regexp_replace(c(x), r"[\p{L}&&[^\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]]", "a")
    for pattern, sign in ((r"[\x{3040}-\x{309F}]", "H"), (r"[\x{30A0}-\x{30FF}]", "K"), (r"[\x{4E00}-\x{9FFF}]", "C"), (r"\p{Nd}", "0")):
        s = F.regexp_replace(s, pattern, sign)
    return collapse(s, 2)


def shape_class(x) -> Column:
    """One word for the look of a token: EMPTY, URL, MENTION, HASHTAG, PUNCT, ALLCAPS, LOWER, TITLE, HASDIGIT or MIXED; the first that holds."""
    x = c(x)
    return (
        F.when(x == "", "EMPTY")
        .when(x.rlike(r"(?i)^(https?://|www\.)"), "URL")
        .when(x.rlike(r"(?U)^@\w+"), "MENTION")
        .when(x.rlike(r"^#\S+"), "HASHTAG")
        .when(x.rlike(r"(?U)^[^\wÀ-ÖØ-öø-ÿ]+$"), "PUNCT")
        .when(is_upper(x), "ALLCAPS")
        .when(is_lower(x), "LOWER")
        .when(first_upper(x), "TITLE")
        .when(x.rlike(r"\p{Nd}"), "HASDIGIT")
        .otherwise("MIXED")
    )


def like_case(raw, cand) -> Column:
    """``cand`` in the case of ``raw``: capitals if it has several, a first capital if it has one."""
    r, k = c(raw), c(cand)
    title = F.concat(F.upper(F.substring(k, 1, 1)), rest(k))
    return F.when(is_upper(r) & (F.length(r) > 1), F.upper(k)).when(first_upper(r), title).otherwise(k)


def case_shape(x) -> Column:
    x = c(x)
    return F.when(is_lower(x), "lower").when(is_upper(x), "upper").when(first_upper(x) & is_lower(rest(x)), "title").when(F.lower(x) == F.upper(x), "none").otherwise("mixed")


def edit_distance(a, b, cutoff: int | None = None) -> Column:
    """Levenshtein distance; beyond ``cutoff`` it is cutoff + 1."""
    if cutoff is None:
        return F.levenshtein(c(a), c(b))
    d = F.levenshtein(c(a), c(b), cutoff)
    return F.when(d < 0, cutoff + 1).otherwise(d)


def roman_distance(a, b) -> Column:
    return F.least(F.levenshtein(F.lower(c(a)), F.lower(c(b))), F.levenshtein(strip_accents(F.lower(c(a))), strip_accents(F.lower(c(b)))))


def spanish_edit_cost(raw, cand) -> Column:
    """0 equal, 0.3 accents or repeats, 0.4 equal keys, 0.6 chat spelling, else the distance of keys."""
    r, k = F.lower(plain_apostrophe(raw)), F.lower(plain_apostrophe(cand))
    chat = reduce(lambda s, p: F.replace(s, F.lit(p[0]), F.lit(p[1])), ES_CHAT, r)
    return (
        F.when(c(raw) == c(cand), 0.0)
        .when((deaccent_spanish(r) == deaccent_spanish(k)) & (r != k), 0.3)
        .when((collapse(r, 1) == k) | (collapse(r, 2) == k), 0.3)
        .when(spanish_key(r) == spanish_key(k), 0.4)
        .when(spanish_key(chat) == spanish_key(k), 0.6)
        .otherwise(F.levenshtein(spanish_key(r), spanish_key(k)).cast("double"))
    )


def jamo(x) -> Column:
    """Hangul syllables taken apart into their letters, by code point arithmetic."""
    first, vowel, last = ("ᄀ", "ᅡ", "ᆨ")

    def part(ch):
        k = F.ascii(ch) - 0xAC00
        offset = lambda base, n: F.element_at(F.array(*(F.lit(chr(ord(base) + i)) for i in range(n[1]))), n[0] + 1)
        lead = offset(first, (F.floor(k / 588).cast("int"), 19))
        mid = offset(vowel, (F.floor((k % 588) / 28).cast("int"), 21))
        tail = F.when(k % 28 == 0, "").otherwise(offset(last, (F.greatest((k % 28).cast("int") - 1, F.lit(0)), 27)))
        return F.when((k >= 0) & (k < 11172), F.concat(lead, mid, tail)).otherwise(ch)

    return F.array_join(F.transform(F.split(c(x), ""), part), "")


def first_jamo(x) -> Column:
    """The first letter of a Hangul syllable, or the first character in lower case without accents."""
    return strip_accents(F.lower(F.substring(jamo(F.substring(c(x), 1, 1)), 1, 1)))


def emote_candidates(x) -> Column:
    """Two and one of the sign that a run of three or more of one Korean emote consists of; none for other tokens."""
    x = c(x)
    one = F.substring(x, 1, 1)
    return F.when(x.rlike(r"^([ㅋㅎㅠㅜ])\1{2,}$"), F.array(F.repeat(one, F.lit(2)), one)).otherwise(F.array().cast("array<string>"))


def short_emote(x) -> Column:
    """Two signs for a run of four or more of one Korean emote; null for other tokens."""
    return F.when(c(x).rlike(r"^([ㅋㅎㅠㅜ])\1{3,}$"), F.repeat(F.substring(c(x), 1, 1), F.lit(2)))


def short_syllables(x) -> Column:
    """A word without the repeats of its last syllable, of which there are three or more; null for other tokens and emotes."""
    x = c(x)
    pattern = r"^(.+?)(.)\2{2,}$"
    last = F.regexp_extract(x, pattern, 2)
    return F.when(x.rlike(pattern) & ~last.isin(*"ㅋㅎㅠㅜ"), F.concat(F.regexp_extract(x, pattern, 1), last))


def plain_ending(x) -> Column:
    """A word with a playful ending in its plain form, by the first ending that fits; null for other tokens."""
    x = c(x)
    forms = [F.when(x.endswith(old) & (F.length(x) > len(old)), F.concat(F.left(x, F.length(x) - len(old)), F.lit(new))) for old, new in KO_ENDINGS]
    return F.coalesce(*forms)


def korean_distance(a, b) -> Column:
    return F.least(F.levenshtein(c(a), c(b)).cast("double"), 0.6 * F.levenshtein(jamo(a), jamo(b)))


def keeps_order(raw, cand) -> Column:
    """All characters of ``raw`` occur in ``cand`` in their order."""
    step = lambda p, ch: F.when((p < 0) | (ch == ""), p).otherwise(F.coalesce(F.nullif(F.position(ch, c(cand), p + 1), F.lit(0)), F.lit(-1)))
    return F.aggregate(F.split(c(raw), ""), F.lit(0), step) >= 0


def repeat_mapping(raw, cand) -> Column:
    letters = r"([A-Za-zÀ-ÖØ-öø-ÿ])\1{2,}"
    return c(raw).rlike(letters) & ((c(cand) == F.regexp_replace(c(raw), letters, "$1")) | (c(cand) == F.regexp_replace(c(raw), letters, "$1$1")))


def case_only(raw, cand) -> Column:
    return (F.lower(c(raw)) == F.lower(c(cand))) & (c(raw) != c(cand))


def mapping_class(raw, cand) -> Column:
    """Kind of a replacement; the first that holds."""
    r, k = c(raw), c(cand)
    return (
        F.when(r == k, "copy")
        .when(protected_k3(r), "protected")
        .when(F.contains(k, F.lit(" ")), "multiword")
        .when(case_only(r, k) & is_upper(r) & is_lower(k), "allcaps_lower")
        .when(case_only(r, k) & is_upper(r) & first_upper(k) & is_lower(rest(k)), "allcaps_title")
        .when(case_only(r, k) & first_upper(r) & is_lower(k), "title_lower")
        .when(case_only(r, k) & is_lower(r) & first_upper(k), "lower_title")
        .when(case_only(r, k), "case_only")
        .when(strip_marks(r) == strip_marks(k), "diacritic")
        .when(repeat_mapping(r, k), "repeat")
        .when(F.lower(r).isin(SMS), "sms_abbrev")
        .when(F.length(k) >= F.length(r) + 4, "expansion")
        .when((F.length(r) <= 3) & (F.length(k) > F.length(r)), "short_expansion")
        .otherwise("spelling_or_other")
    )


def encode_target(x) -> Column:
    return F.when(c(x) == "", "<DELETE>").otherwise(c(x))


def decode_action(output, raw) -> Column:
    """struct(pred, action) of a model's COPY or NORM output; anything else copies."""
    o = F.trim(c(output))
    text = F.trim(F.regexp_extract(o, r"^NORM:?\s*(.*)$", 1))
    known = o.rlike(r"^NORM\b") & (text != "")
    action = F.when(o == "COPY", "COPY").when(known, "NORM").otherwise("MALFORMED")
    return F.struct(F.when(known, text).otherwise(c(raw)).alias("pred"), action.alias("action"))


def marked_prompt(words, pos, left: str = "<extra_id_0>", right: str = "<extra_id_1>") -> Column:
    """The sentence with the word at ``pos`` between two marks."""
    return F.array_join(F.transform(c(words), lambda w, i: F.when(i == c(pos), F.concat_ws(" ", F.lit(left), w, F.lit(right))).otherwise(w)), " ")


def script_ratio(x, block: str) -> Column:
    """Share of the characters in a Unicode block, such as ``InThai`` or ``IsLatin``."""
    return F.coalesce(F.regexp_count(c(x), F.lit(r"\p{%s}" % block)) / F.nullif(F.length(c(x)), F.lit(0)), F.lit(0.0))


def length_bin(x) -> Column:
    n = F.length(c(x))
    return F.when(n <= 3, F.concat(F.lit("len_"), n.cast("string"))).when(n <= 5, "len_4_5").when(n <= 8, "len_6_8").otherwise("len_9p")


def ratio_bin(x) -> Column:
    return F.when(c(x) == 0, "0").when(c(x) < 0.25, "low").when(c(x) < 0.60, "mid").otherwise("high")


def short_length_bin(x) -> Column:
    n = F.length(c(x))
    return F.when(n <= 1, "1").when(n <= 3, "2-3").when(n <= 6, "4-6").when(n <= 10, "7-10").otherwise("11+")


def number_bin(x, bins: list[float]) -> Column:
    """The first bound that a number does not exceed, as ``<=b``, or ``>last``."""
    found = F.lit(f">{bins[-1]:.3f}")
    for b in reversed(bins):
        found = F.when(c(x) <= b, f"<={b:.3f}").otherwise(found)
    return found


def position_bin(pos, size) -> Column:
    share = c(pos) / (c(size) - 1)
    return F.when(c(size) <= 1, "only").when(share < 0.2, "start").when(share < 0.8, "middle").otherwise("end")


def prompt(words, pos, lang, kind: str = "natural", candidates: Column | None = None) -> Column:
    """What a generator is asked for the word at ``pos``.

    ``kind``: natural, sentinel, marked_natural, lexnorm, indexed or action;
    ``candidates``: an array that the prompt names where it is not empty.
    """
    sentence, word = F.array_join(c(words), " "), F.get(c(words), c(pos))
    marked, lit = marked_prompt(words, pos), F.lit
    text = {
        "natural": F.concat(lit("lang: "), c(lang), lit(" word: "), word, lit(" context: "), sentence),
        "sentinel": marked,
        "marked_natural": F.concat(lit("normalize lang: "), c(lang), lit(" target: "), word, lit(" context: "), marked),
        "lexnorm": F.concat(lit("lexnorm lang: "), c(lang), lit(" word: "), word, lit(" context: "), sentence),
        "indexed": F.concat(lit("normalize "), c(lang), lit(": word: "), word, lit(" index: "), c(pos).cast("string"), lit(" context: "), sentence),
        "action": F.concat(lit("task: lexical_normalization lang: "), c(lang), lit(" target: "), word, lit(" sentence: "), marked),
    }[kind]
    return text if candidates is None else F.when(F.size(candidates) > 0, F.concat(text, lit(" candidates: "), F.array_join(candidates, " | "))).otherwise(text)
