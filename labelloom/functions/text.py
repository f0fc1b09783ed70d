"""Text expressions: trimming, tokens, rendering a row as one string."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Python's str.strip/str.split whitespace, as a Java character class.
WHITESPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{WHITESPACE}+|{WHITESPACE}+\z", "")


def tokens(text: Column) -> Column:
    """Words between runs of white space; blank text has none."""
    return F.array_remove(F.split(text, f"{WHITESPACE}+"), "")


def head_tokens(words: Column, max_length: int = 512) -> Column:
    """The first ``max_length`` tokens, the most an encoder of that width accepts."""
    return F.slice(words, 1, max_length)


def float_text(x: Column) -> Column:
    """A double written positionally from 1e-4 up to 1e16 and as ``1e+16`` / ``1e-05`` beyond.

    Spark switches to ``1.0E7`` at 1e7 and below 1e-3, so the digits of its shortest form are
    laid out again where the two notations differ.
    """
    s = x.cast("string")
    sign = F.when(s.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    mantissa = F.regexp_extract(s, r"^-?([0-9.]+)E", 1)
    exponent = F.regexp_extract(s, r"E(-?[0-9]+)$", 1).cast("int")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"\.", "")
    whole = F.substring(F.rpad(digits, 17, "0"), F.lit(1), exponent + 1)
    tail = F.substring(digits, exponent + 2, F.lit(32))
    large = F.concat(sign, whole, F.lit("."), F.when(tail == "", F.lit("0")).otherwise(tail))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    exp_sign = F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+"))
    exp_text = F.concat(exp_sign, F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    exp_text = F.when(F.abs(exponent) >= 100, F.concat(exp_sign, F.abs(exponent).cast("string"))).otherwise(exp_text)
    scientific = F.concat(sign, F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e"), exp_text)
    return (
        F.when(F.isnan(x), F.lit("nan"))
        .when(s.isin("Infinity", "-Infinity"), F.concat(sign, F.lit("inf")))
        .when(~s.contains("E"), s)
        .when((exponent >= 7) & (exponent < 16), large)
        .when(exponent == -4, small)
        .otherwise(scientific)
    )


def value_text(name: str, dtype: T.DataType) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return float_text(c)
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).otherwise(F.lit("False"))
    return c.cast("string")


def row_as_text(df: DataFrame, columns: Sequence[str] | None = None, exclude_empty: bool = True) -> Column:
    """``"col: value, col: value"`` over the given columns (all by default).

    Nulls, NaN and empty strings are left out; with ``exclude_empty=False`` every column is
    written, a null as ``nan``.
    """
    parts = []
    for name in columns if columns is not None else df.columns:
        dtype = df.schema[name].dataType
        rendered = value_text(name, dtype)
        piece = F.concat(F.lit(f"{name}: "), rendered)
        c = F.col(f"`{name}`")
        if exclude_empty:
            present = c.isNotNull() & (rendered != F.lit(""))
            if isinstance(dtype, (T.DoubleType, T.FloatType)):
                present = present & ~F.isnan(c)
            parts.append(F.when(present, piece))
        else:
            parts.append(F.coalesce(piece, F.lit(f"{name}: nan")))
    return F.concat_ws(", ", *parts)
