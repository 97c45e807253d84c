"""Full Unicode normalisation, which Spark has no function for: Arrow-batched UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from lexweave.functions import tables as T


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(StringType())
def without_marks(s: pd.Series) -> pd.Series:
    """NFD without nonspacing marks, for any script."""
    return s.map(lambda x: "".join(ch for ch in unicodedata.normalize("NFD", x) if unicodedata.category(ch) != "Mn"), na_action="ignore")


def hiragana(x):
    """Katakana as hiragana, by the shift of 96 code points between both blocks."""
    kata = "".join(chr(c) for c in range(0x30A1, 0x30F7))
    return F.translate(x, kata, "".join(chr(ord(ch) - 0x60) for ch in kata))


def japanese_key(x):
    from lexweave.functions.text import collapse

    return collapse(F.lower(hiragana(nfkc(x))), 2)


def diacritic_key(x):
    """Without accents and marks of any script, in lower case, runs over two shortened to two."""
    from lexweave.functions.text import collapse, plain_apostrophe

    return collapse(F.lower(without_marks(nfkc(plain_apostrophe(x)))), 2)


@F.pandas_udf(IntegerType())
def count_marks(s: pd.Series) -> pd.Series:
    return s.map(lambda x: sum(unicodedata.category(ch) == "Mn" for ch in unicodedata.normalize("NFD", x)), na_action="ignore")


_MARKS = f"[{T.TH_TONES}{T.TH_HANGING}]"


def thai_marks_once(x):
    return F.regexp_replace(x, f"({_MARKS})\\1+", "$1")


def thai_leading_e(x):
    return F.replace(x, F.lit("เเ"), F.lit("แ"))


def thai_sara_am(x):
    return F.replace(x, F.lit("ํา"), F.lit("ำ"))


def thai_mark_order(x):
    """Tone marks moved behind the consonant, the hanging vowel or before the following vowel they stand wrong of, once."""
    s = F.regexp_replace(x, f"([{T.TH_LEADING}])([{T.TH_TONES}])([{T.TH_BASE}])", "$1$3$2")
    s = F.regexp_replace(s, f"([{T.TH_BASE}])([{T.TH_TONES}])([{T.TH_HANGING}])", "$1$3$2")
    return F.regexp_replace(s, f"([{T.TH_BASE}])([{T.TH_FOLLOWING}])([{T.TH_TONES}])", "$1$3$2")


def thai_normal(x):
    """NFKC, no zero-width characters, doubled sara e as sara ae, sara am composed, repeated marks once, marks in order.

    Order, repeats and composition are gone over three times; a pass that changes nothing is followed by none that does.
    """
    s = thai_marks_once(thai_sara_am(thai_leading_e(F.translate(nfkc(x), T.TH_ZERO_WIDTH, ""))))
    for _ in range(3):
        s = thai_sara_am(thai_marks_once(thai_mark_order(s)))
    return s


def thai_rule_forms(x, most: int = 12):
    """Distinct rewritings of a Thai word in order: normal form, single steps of it, and runs shortened to two and one.

    None has a space, loses all Thai letters of the word or is longer than twice the word and three characters.
    """
    from lexweave.functions.protect import THAI
    from lexweave.functions.text import collapse

    runs = x.rlike(r"(?s)(.)\1{2,}")
    two, one = collapse(x, 2), collapse(x, 1)
    forms = [thai_normal(x), thai_marks_once(x), thai_leading_e(x), thai_sara_am(x), thai_mark_order(x)]
    forms += [F.when(runs, f) for f in (two, one, thai_normal(two), thai_normal(one))]
    good = lambda w: w.isNotNull() & (w != "") & (w != x) & ~w.rlike(r"\s") & (~x.rlike(THAI) | w.rlike(THAI)) & (F.length(w) <= F.greatest(F.lit(1), F.length(x) * 2 + 3))
    return F.slice(F.array_distinct(F.filter(F.array(*forms), good)), 1, most)
