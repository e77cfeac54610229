"""Vector arithmetic on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, vectors of different lengths, and zero vectors."""
    norm = F.sqrt(inner_product(a, a)) * F.sqrt(inner_product(b, b))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(inner_product(a, b) / norm)


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def hybrid_score(semantic: Column, keyword: Column, weight: Column | float) -> Column:
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(weight) if not isinstance(weight, Column) else weight))
    return (1 - w) * semantic + w * keyword


def keyword_score(t: Column, terms: Column) -> Column:
    """The share of the terms that stand in a text as whole words."""
    found = F.filter(terms, lambda w: F.regexp_like(t, F.concat(F.lit(r"(?iU)(^|\W)"), w, F.lit(r"(\W|$)"))))
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.size(found) / F.size(terms))


def keyword_score_substring(t: Column, terms: Column) -> Column:
    found = F.filter(terms, lambda w: F.contains(F.lower(t), w))
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.size(found) / F.size(terms))
