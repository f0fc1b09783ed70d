"""Numeric array expressions: softmax, losses, distances, first-index argmin/argmax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Smallest probability that enters a logarithm.
PROBABILITY_FLOOR = 1e-15


def array_total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    exps = F.transform(logits, lambda x: F.exp(x - top))
    total = array_total(exps)
    return F.transform(exps, lambda e: e / total)


def log_softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    log_total = F.ln(array_total(F.transform(logits, lambda x: F.exp(x - top))))
    return F.transform(logits, lambda x: x - top - log_total)


def argmax(xs: Column) -> Column:
    """0-based index of the largest value, the first one on ties."""
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("int")


def argmin(xs: Column) -> Column:
    """0-based index of the smallest value, the first one on ties."""
    return (F.array_position(xs, F.array_min(xs)) - 1).cast("int")


def cross_entropy(probability: Column, index: Column) -> Column:
    """``-ln p[index]``, with p floored so that a zero stays finite; null where no probability exists."""
    return -F.ln(F.greatest(F.get(probability, index), F.lit(PROBABILITY_FLOOR)))


def soft_cross_entropy(target: Column, log_prob: Column) -> Column:
    """``Σ -q·log p`` for soft targets."""
    return array_total(F.zip_with(target, log_prob, lambda q, lp: -q * lp))


def kl_divergence(teacher: Column, log_student: Column) -> Column:
    """``Σ t·(ln t − log s)``; a zero teacher probability adds nothing."""
    return array_total(
        F.zip_with(teacher, log_student, lambda t, ls: F.when(t > 0, t * (F.ln(t) - ls)).otherwise(F.lit(0.0)))
    )


def squared_distance(a: Column, b: Column) -> Column:
    return array_total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def mix(a: Column, b: Column, lam: Column) -> Column:
    """``λ·a + (1 − λ)·b`` element by element."""
    return F.zip_with(a, b, lambda x, y: lam * x + (F.lit(1.0) - lam) * y)


def clamp01(x: Column) -> Column:
    """Into [0, 1]; a null stays null (``greatest`` and ``least`` alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
