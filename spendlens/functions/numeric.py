"""Null- and zero-aware arithmetic as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The denominator where a group's total is zero (signed share)
# or below it (clamped share).
SHARE_EPSILON = 1e-10
# The sign categories
ZERO, POSITIVE, MISSING, CHECKING = "0", ">0", "Missing", "Checking"


def zin(c: Column) -> Column:
    """Zero if null (the SQL ZEROIFNULL)."""
    return F.coalesce(c, F.lit(0))


def zin_sum(*cols: Column) -> Column:
    """Sum that treats null parts as 0: never null."""
    out = zin(cols[0])
    for c in cols[1:]:
        out = out + zin(c)
    return out


def guarded_log10(c: Column, zero_to_zero: bool = True, parity: bool = False) -> Column:
    """log10 with the zero rule of the analysis.

    ``zero_to_zero``: 0 maps to 0 (own revenue); otherwise 0 is -inf in
    parity mode (what numpy gives) or null (Spark's own log10).
    Negative input is null (numpy gives NaN, which we keep as null).
    """
    lg = F.when(c > 0, F.log10(c.cast("double")))
    if zero_to_zero:
        return F.when(c == 0, F.lit(0.0)).otherwise(lg)
    if parity:
        return F.when(c == 0, F.lit(float("-inf"))).otherwise(lg)
    return lg


def sign_category(c: Column) -> Column:
    """Zero, positive, missing, or (negative) to be checked."""
    return (F.when(c == 0, F.lit(ZERO)).when(c > 0, F.lit(POSITIVE))
            .when(c.isNull(), F.lit(MISSING)).otherwise(F.lit(CHECKING)))


def safe_ratio_pct(num: Column, den: Column, mode: str = "epsilon") -> Column:
    """100 * num / den with a guarded denominator (ANSI Spark raises on /0).

    epsilon: den if den != 0 else 1e-10 (signed share).
    clamp:   max(den, 1e-10) (share of a balanced sample).
    null:    null when den == 0.
    """
    num = num.cast("double")
    den = den.cast("double")
    if mode == "null":
        return F.when(den != 0, F.lit(100.0) * num / den)
    if mode == "epsilon":
        guarded = F.when(den != 0, den).otherwise(F.lit(SHARE_EPSILON))
    elif mode == "clamp":
        guarded = F.greatest(den, F.lit(SHARE_EPSILON))
    else:
        raise ValueError(f"unknown zero_den mode {mode!r}")
    return F.lit(100.0) * num / guarded
