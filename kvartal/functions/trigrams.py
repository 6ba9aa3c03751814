"""Trigram sets of a text, as the trigram index of the streets table builds them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word, padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(
            F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, F.lit(3))
        )

    return F.array_distinct(F.flatten(F.transform(words, of_word)))
