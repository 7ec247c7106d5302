"""Similarity of a reference and a candidate, as Column expressions over token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """``a / b`` as double; ``empty`` where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0))), F.lit(empty))


def jaccard(a: Column, b: Column) -> Column:
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def overlap_ref_set(ref: Column, cand: Column) -> Column:
    """Shared distinct tokens over the reference's distinct tokens."""
    return ratio(F.size(F.array_intersect(ref, cand)), F.size(F.array_distinct(ref)))


def overlap_len(ref: Column, cand: Column, of: Column) -> Column:
    """Shared distinct tokens over the length of ``of``, repeats included."""
    return ratio(F.size(F.array_intersect(ref, cand)), F.size(of))


def length_ratio(ref: Column, cand: Column) -> Column:
    return F.when(F.size(ref) == 0, F.when(F.size(cand) > 0, 0.0).otherwise(1.0)).otherwise(ratio(F.size(cand), F.size(ref)))


def length_similarity(r: Column) -> Column:
    return 1 / (1 + F.abs(r - 1))


def ngram_set(toks: Column, low: int = 3, high: int = 30) -> Column:
    """The distinct n-grams of ``low`` to ``high`` tokens, as strings joined by a unit separator."""
    n = F.size(toks)
    grams = F.when(
        n >= low,
        F.flatten(F.transform(F.sequence(F.lit(low), F.least(F.lit(high), n)), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(toks, i, k), "\x1f")))),
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(grams)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of equal length; 0 if one is all zeros or missing."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit_cosine(a: Column, b: Column) -> Column:
    """Cosine mapped from -1..1 to 0..1; 0 for a zero vector."""
    c = cosine(a, b)
    zero = lambda x: F.coalesce(F.forall(x, lambda v: v == 0), F.lit(True))
    return F.when(zero(a) | zero(b), 0.0).otherwise((c + 1) / 2)
