"""Which tokens stay as they are, and what a token looks like: predicates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions import tables as T
from lexweave.functions.text import c, first_upper, is_upper, protected_k3

THAI = r"[\x{0E00}-\x{0E7F}]"
_THAI_ADDRESS = r"^(https?://|www\.|[A-Za-z0-9_.-]+\.[A-Za-z]{2,}/?)"


def address(x) -> Column:
    return c(x).rlike(r"(?i)^(https?://|www\.)")


def email(x) -> Column:
    return c(x).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")


def mention(x) -> Column:
    return c(x).rlike(r"(?U)^@\w+")


def hashtag(x) -> Column:
    return c(x).rlike(r"^#\S+")


def signs_only(x) -> Column:
    return c(x).rlike(r"(?U)^[^\wÀ-ÖØ-öø-ÿ]+$")


def italian_laughter(x) -> Column:
    return c(x).rlike("(?i)^(a?ha)+h?$|^(e?he)+h?$|^x+d+$")


def spanish_laughter(x) -> Column:
    return c(x).rlike("(?i)(ja){2,}")


def acronym(x, known: list[str] | None = None) -> Column:
    """Listed, or capitals of two characters or more."""
    listed = c(x).isin(known) if known else F.lit(False)
    return listed | (F.length(c(x)) >= 2) & is_upper(x)


def named_entity(x) -> Column:
    return (F.length(c(x)) > 1) & first_upper(x) & ~is_upper(x)


def thai_abbreviation(x) -> Column:
    return c(x).endswith(".") | (F.length(c(x)) <= 4)


def protected_k4(x, acronyms: list[str] | None = None) -> Column:
    """Italian: K3, mail, interjections, laughter and acronyms."""
    low = F.lower(c(x))
    return (c(x) == "") | protected_k3(x) | email(x) | low.isin(T.IT_NONWORDS) | italian_laughter(low) | acronym(x, acronyms or T.IT_ACRONYMS)


def _share(x, letters: str) -> Column:
    return F.coalesce(F.regexp_count(c(x), F.lit(letters)) / F.nullif(F.length(c(x)), F.lit(0)), F.lit(0.0))


def thai_ratio(x) -> Column:
    return _share(x, THAI)


def latin_ratio(x) -> Column:
    return _share(x, "[A-Za-z]")


def digit_ratio(x) -> Column:
    return _share(x, r"\p{Nd}")


def protected_k5(x) -> Column:
    """Thai: tags, addresses of any domain, Latin or digits without Thai, mixtures that are mostly Latin and digits."""
    digits = c(x).rlike("[0-9]")
    return (
        (c(x) == "")
        | c(x).rlike("^[#@]")
        | c(x).rlike(_THAI_ADDRESS)
        | ~c(x).rlike(THAI) & (c(x).rlike("[A-Za-z]") | digits)
        | digits & (latin_ratio(x) + digit_ratio(x) > 0.5)
    )


def thai_address(x) -> Column:
    return c(x).rlike(_THAI_ADDRESS)


def protected_k6(x) -> Column:
    """Japanese: empty, addresses, numbers and dates in either width, tags, ASCII words but a few."""
    number = c(x).rlike(r"^[+-]?[0-9０-９]+([.,．][0-9０-９]+)?(%|％)?$") | c(x).rlike("^[0-9０-９]{1,4}[/-][0-9０-９]{1,2}([/-][0-9０-９]{1,2})?$")
    word = c(x).rlike("^[A-Za-z][A-Za-z0-9_+.-]*$") & ~F.upper(c(x)).isin(T.JA_LATIN_WORDS)
    return (c(x) == "") | address(x) | email(x) | number | c(x).rlike("^[@#＃]") | word


def protected_k7(x) -> Column:
    """Empty, tags, addresses and groups of digits."""
    return c(x).isNull() | (c(x) == "") | c(x).rlike("^(@|#|http)") | c(x).rlike("^[0-9]+([:.,/-][0-9]+)*$")


def protected_k8(x) -> Column:
    return protected_k7(x) | c(x).rlike(r"(?U)^[\W_]+$")


PROTECTED = {"K4": protected_k4, "K5": protected_k5, "K6": protected_k6, "K7": protected_k7, "K8": protected_k8}


def near_sentence_end(next_word, after_next) -> Column:
    """The token is last, before a final sign, or before a closing bracket that is last. Null or ``<EOS>`` stands beyond the end."""
    over = lambda x: c(x).isNull() | (c(x) == "<EOS>")
    return over(next_word) | c(next_word).isin("。", "！", "!", "？", "?", "…", "...") | c(next_word).isin("」", "｣", "）", ")") & over(after_next)


def caps_ratio(words) -> Column:
    """Share of the sentence's words with a letter that are capitals of more than one character."""
    lettered = F.filter(c(words), lambda w: w.rlike(r"\p{L}"))
    caps = F.filter(lettered, lambda w: (w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) > 1))
    return F.coalesce(F.size(caps) / F.nullif(F.size(lettered), F.lit(0)), F.lit(0.0))


def has_japanese(x) -> Column:
    return c(x).rlike(r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]")


def script_signature(x) -> Column:
    """The scripts in a token joined by ``+``, ``other`` without any."""
    parts = [("hira", r"[\x{3040}-\x{309F}]"), ("kata", r"[\x{30A0}-\x{30FF}]"), ("kanji", r"[\x{4E00}-\x{9FFF}]"), ("latin", "[A-Za-zＡ-Ｚａ-ｚ]"), ("num", "[0-9０-９]")]
    found = F.concat_ws("+", *(F.when(c(x).rlike(p), name) for name, p in parts))
    return F.when(found == "", "other").otherwise(found)
