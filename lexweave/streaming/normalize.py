"""Normalization of a stream of sentences against a static dictionary.

Stateless: a stream-static join per micro-batch, no watermark needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexweave.operators.predict import lookup
from lexweave.sources.sentences import tokens


def normalized_tokens(sentences: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Tokens of streamed ``sentences`` with the dictionary's ``pred``, the word itself where it has none."""
    return lookup(tokens(sentences), dictionary).select("sent_id", "lang", "pos", "raw", "pred")
