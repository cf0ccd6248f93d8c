"""Scores over arrays of numbers, as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Raises on empty arrays, arrays of different length and values that aren't finite."""
    bad = (F.size(a) == 0) | (F.size(a) != F.size(b)) | _odd(a) | _odd(b)
    return F.when(bad, F.raise_error(F.lit("vectors must be of one length above zero, with finite values")).cast("double")).otherwise(
        F.when((norm(a) == 0) | (norm(b) == 0), F.lit(0.0)).otherwise(dot(a, b) / (norm(a) * norm(b)))
    )


def _odd(a: Column) -> Column:
    return F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is 1, scaled to length 1."""
    kept = F.filter(F.zip_with(vectors, mask, lambda v, m: F.when(m == 1, v)), lambda v: v.isNotNull())
    zero = F.transform(F.element_at(vectors, 1), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double")))
    # the sum has the direction of the mean; its length is computed once, as a field beside it
    held = F.element_at(F.transform(F.array(total), lambda t: F.struct(t.alias("v"), norm(t).alias("n"))), 1)
    return F.element_at(F.transform(F.array(held), lambda h: F.transform(h["v"], lambda x: F.when(h["n"] > 0, x / h["n"]).otherwise(F.lit(0.0)))), 1)


def token_probability(logits: Column, targets: Column) -> Column:
    """exp of the mean log probability of the targets (indices from 0), each row of logits normalised by log-sum-exp."""

    def log_p(row, target):
        top = F.array_max(row)
        total = F.aggregate(row, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - top))
        return F.element_at(row, target + 1).cast("double") - top - F.log(total)

    each = F.zip_with(logits, targets, log_p)
    return F.exp(F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x) / F.size(targets))
