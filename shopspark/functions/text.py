"""Text expressions: trigram similarity, substring and case-blind matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: similarity from which two texts count as alike.
ALIKE = 0.3
CASE_BLIND = "UNICODE_CI"


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words of a text, each word padded two before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) + 1),
            lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)),
        ),
    )
    return F.array_distinct(F.flatten(grams))


def similarity(left: Column, right: Column) -> Column:
    """Shared trigrams over all trigrams of two trigram arrays, 0 to 1."""
    shared = F.size(F.array_intersect(left, right))
    every = F.size(left) + F.size(right) - shared
    return F.when(every == 0, F.lit(0.0)).otherwise(shared / every)


def contains(text: Column, part: str) -> Column:
    """Case-blind substring test."""
    return F.contains(F.lower(text), F.lit(part.lower()))


def case_blind(text: Column) -> Column:
    """The text under a collation that ignores case, for equality, grouping and distinct."""
    return F.collate(text, CASE_BLIND)
