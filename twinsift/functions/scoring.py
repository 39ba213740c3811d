"""Scores made of cosine, overlap and length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """0 if both sets are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def length_penalty(a: Column, b: Column) -> Column:
    m = F.greatest(a, b)
    return F.when(m == 0, F.lit(0.0)).otherwise(F.exp(F.lit(-2.0) * F.abs(a - b) / F.greatest(m, F.lit(1))))


def hybrid(cosine: Column, overlap: Column, penalty: Column) -> Column:
    return cosine * (F.lit(0.5) + F.lit(0.5) * overlap) * penalty


def boilerplate_cap(score: Column, cosine: Column, overlap: Column) -> Column:
    return F.when((cosine > F.lit(0.985)) & (overlap < F.lit(0.08)), score * F.lit(0.85)).otherwise(score)


def uniqueness_percent(best: Column) -> Column:
    """100 if there is no match or none with a positive score."""
    return F.when(best > 0, (F.lit(1.0) - best) * F.lit(100.0)).otherwise(F.lit(100.0))


def blended(cosine: Column, overlap: Column, alpha: float = 0.7) -> Column:
    return F.lit(alpha) * cosine + F.lit(1 - alpha) * overlap


def length_ratio(candidate: Column, query: Column) -> Column:
    return candidate / F.greatest(query, F.lit(1))


def decision(score: Column, threshold: Column) -> Column:
    return F.when(score >= threshold, "Plagiarism").otherwise("OK")
