"""Hashed keys and hashed uniforms: randomness that does not depend on partitioning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def order_key(seed: int, *parts) -> Column:
    """32 hex digits that put rows in a seeded random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_text(p) for p in parts]))


def hex_uniform(digits: Column, start: int, width: int) -> Column:
    """Uniform in [0, 1) from ``width`` hex digits beginning at 1-based ``start``."""
    return F.conv(F.substring(digits, start, width), 16, 10).cast("long") / F.lit(float(16**width))


def uniform(seed: int, *parts) -> Column:
    """Uniform in [0, 1) fixed by the seed and the parts (row id, position, …)."""
    return hex_uniform(order_key(seed, *parts), 1, 8)


def beta_draw(seed: int, row_id: Column, alpha: int) -> Column:
    """Exact Beta(alpha, alpha) draw for whole alpha: the middle of 2·alpha − 1 uniforms."""
    draws = [uniform(seed, row_id, i) for i in range(2 * alpha - 1)]
    return F.element_at(F.array_sort(F.array(*draws)), alpha)


def cache_key(question: Column, model: str | Column) -> Column:
    """SHA-256 of ``question:model``, the key of a cached reply (a null question counts as empty).

    Like :func:`text_key` it is never null: a join on it then needs no not-null filter, which
    would hash every text a second time.
    """
    return F.sha2(F.concat(F.coalesce(question, F.lit("")), F.lit(":"), F.coalesce(_text(model), F.lit(""))), 256)


def text_key(text: Column) -> Column:
    """Join key standing for a whole text (256 bits, so equal keys mean equal texts)."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


POSITION_PRIME = 2**31 - 1


def draw_coefficients(seed: int, *parts) -> Column:
    """Coefficients of a row's position hash, see :func:`position_uniforms`."""
    digits = order_key(seed, *parts)
    return F.array(
        *[F.conv(F.substring(digits, 1 + 8 * j, 8), 16, 10).cast("long") % F.lit(POSITION_PRIME) for j in range(3)]
    )


def position_uniforms(coefficients: np.ndarray, n: int) -> np.ndarray:
    """Uniforms in [0, 1) for the positions 0 … n − 1 of a row: a random quadratic modulo a prime.

    Draws of any three positions are independent, and one digest serves a whole row.
    """
    a, b, c = (int(x) for x in coefficients)
    i = np.arange(n, dtype=np.int64)
    return ((c * i + b) % POSITION_PRIME * i + a) % POSITION_PRIME / float(POSITION_PRIME)
