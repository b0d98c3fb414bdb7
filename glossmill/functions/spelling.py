"""Native comparison of short spellings: one-edit distance and its equi-join keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmill.functions.text import let


def bigrams(word: Column) -> Column:
    """Padded character bigrams of a word as a set: repeats carry their number."""
    raw = let(F.concat(F.lit("^"), word, F.lit("$")), lambda padded: F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2))))
    return let(raw, lambda grams: F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda h: h == g)).cast("string"))))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance where swapping two neighbours counts 1, exact up to 1; larger values are upper bounds."""
    def swapped(wrong: Column) -> Column:
        first = F.get(wrong, F.lit(0))
        return (
            (F.size(wrong) == 2)
            & (F.get(wrong, F.lit(1)) == first + 1)
            & (F.substring(a, first, F.lit(1)) == F.substring(b, first + 1, F.lit(1)))
            & (F.substring(a, first + 1, F.lit(1)) == F.substring(b, first, F.lit(1)))
        )

    wrong = F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    two = F.when((F.length(a) == F.length(b)) & let(wrong, swapped), F.lit(1)).otherwise(F.lit(2))
    return let(F.levenshtein(a, b), lambda d: F.when(d == 2, two).otherwise(d))


def deletions(word: Column) -> Column:
    """The word and all spellings with one character left out.

    Two words within one edit (swaps included) share one of these, so an equi-join on
    them finds every such pair.
    """
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), cut))
