"""Similarities of two columns; an empty side gives 0."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), _ratio(both, F.size(F.array_union(a, b)))).otherwise(0.0)


def jaccard_loose(a: Column, b: Column) -> Column:
    return _ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def dice(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), _ratio(2 * F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)))).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), _ratio(F.size(F.array_intersect(a, b)), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))).otherwise(0.0)


def ngram_jaccard(a: Column, b: Column, grams_a: Column, grams_b: Column) -> Column:
    """Of texts with their distinct grams, so that the union need not be made."""
    both, sum_ = F.size(F.array_intersect(grams_a, grams_b)), F.size(grams_a) + F.size(grams_b)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(F.when((F.size(grams_a) > 0) & (F.size(grams_b) > 0), _ratio(both, sum_ - both)).otherwise(0.0))


def length_difference(a: Column, b: Column) -> Column:
    return _ratio(F.abs(F.length(a) - F.length(b)), F.length(a) + F.length(b))


def prefix_ratio(a: Column, b: Column, prefix: Column) -> Column:
    return _ratio(prefix, F.greatest(F.length(a), F.length(b)))


def places_of(a: str) -> dict[str, int]:
    """Where each character stands, as the bits of a number."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    return places


def common_length(a: str, b: str, places: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence: one addition on a number of len(a) bits for each character of b. Who compares a often passes its places_of."""
    if places is None:
        places = places_of(a)
    every = free = (1 << len(a)) - 1
    for place in map(places.get, b):
        if place:  # bits that carry beyond len(a) never come back
            met = free & place
            free = free + met | free - met
    return len(a) - (free & every).bit_count()


@F.pandas_udf(DoubleType())
def _indel(a: pd.Series, b: pd.Series) -> pd.Series:
    def ratio(x: str, y: str) -> float | None:
        if x is None or y is None:
            return None
        if x == y:
            return 1.0
        return 2 * common_length(x, y) / (len(x) + len(y)) if x and y else 0.0

    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def indel_ratio(a: Column, b: Column) -> Column:
    """2 * LCS / (length of both); 1 if both are empty, null if one is null.

    The one similarity that no built-in expression has: texts go to Python in Arrow batches, several ratios of a row together.
    """
    return _indel(a, b)


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(text, " "), lambda w: w != "")), " ")


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda n, v: n + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)
