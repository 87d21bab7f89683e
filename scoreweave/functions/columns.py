"""Scalar and aggregate Column builders.

Every aggregate here is a composition of Spark's own mergeable central-moment aggregates
(``covar_pop``, ``var_pop``, ``avg``...), so partial aggregation happens before the shuffle and a
hot key costs no more than any other key.  Ratios go through ``try_divide``: under ANSI mode a
plain ``corr`` over a constant series raises instead of returning NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The numeric floors of the scoring rules.
VARIANCE_FLOOR = 1e-8
CEILING_FLOOR = 1e-6
CLIP_R = 0.999999
CLOSE_RTOL = 1e-5
CLOSE_ATOL = 1e-8
MAD_TO_SD = 1.4826
TIE_OFFSET = 0.023


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: Column | str, digits: int = 6) -> Column:
    """Round for reporting; a negative zero becomes zero.

    The small offset moves exact decimal ties off the rounding boundary, where the last bit of a
    sum would otherwise decide.
    """
    rounded = F.round(col(c) + F.lit(TIE_OFFSET * 10.0**-digits), digits)
    return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)


def r6_of(c: Column | str, digits: int = 6) -> Column:
    """``r6`` of finite values below 10 ** (15 - digits) by double arithmetic, for tables of pairs: decimals cost more than a distance does."""
    scaled = (col(c) + F.lit(TIE_OFFSET * 10.0**-digits)) * F.lit(10.0**digits)
    whole = F.floor(F.abs(scaled) + F.lit(0.5))
    return F.when(scaled < 0, -whole).otherwise(whole) / F.lit(10.0**digits)


def finite_or_zero(c: Column | str, clip: float | None = None) -> Column:
    """NaN -> 0 and +-Inf -> +-1e6, then an optional clip to [-clip, clip]."""
    c = col(c)
    out = (
        F.when(F.isnan(c), F.lit(0.0))
        .when(c == F.lit(float("inf")), F.lit(1e6))
        .when(c == F.lit(float("-inf")), F.lit(-1e6))
        .otherwise(c)
    )
    return out if clip is None else F.greatest(F.least(out, F.lit(float(clip))), F.lit(-float(clip)))


def nan_to_null(c: Column | str) -> Column:
    """Missing values are NaN at the edge and NULL inside: ``avg`` skips NULL but keeps NaN."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def floor_ceiling(c: Column | str, floor: float = CEILING_FLOOR) -> Column:
    return F.greatest(col(c), F.lit(floor))


def sigmoid(c: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(c)))


def decide_binary(logit: Column | str) -> Column:
    return (sigmoid(logit) > 0.5).cast("int")


def decide_multiclass(logits: Column | str) -> Column:
    """Index of the largest entry; the first one wins a tie."""
    logits = col(logits)
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def spearman_brown(r: Column | str) -> Column:
    """2r / (1 + r); undefined (NULL) at r = -1."""
    r = col(r)
    return F.try_divide(2 * r, 1 + r)


def spearman_brown_clipped(r: Column | str) -> Column:
    """Correction for positive r only, with r held inside +-0.999999."""
    r = col(r)
    bounded = F.greatest(F.least(r, F.lit(CLIP_R)), F.lit(-CLIP_R))
    return F.when(r <= 0, r).otherwise(2 * bounded / (1 + bounded))


def both(x: Column | str, y: Column | str) -> tuple[Column, Column]:
    """The two columns restricted to rows where neither is NULL."""
    x, y = col(x), col(y)
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def pearson(x: Column | str, y: Column | str) -> Column:
    """Pearson r as an aggregate; NULL where either side is constant or empty."""
    x, y = both(x, y)
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def corrected_pearson(y: Column | str, p: Column | str) -> Column:
    """Corrected correlation scorer: n < 2 is undefined, a flat side scores 1 only on a match."""
    y, p = both(y, p)
    close = F.abs(y - p) <= F.lit(CLOSE_ATOL) + F.lit(CLOSE_RTOL) * F.abs(p)
    flat = (F.var_pop(y) < VARIANCE_FLOOR) | (F.var_pop(p) < VARIANCE_FLOOR)
    return (
        F.when(F.count(y) < 2, F.lit(None).cast("double"))
        .when(flat, F.when(F.bool_and(close), F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise(spearman_brown(pearson(y, p)))
    )


def clipped_pearson(y: Column | str, p: Column | str) -> Column:
    """Variant used when scoring trained predictors: a flat side scores 0, r <= 0 is kept."""
    y, p = both(y, p)
    flat = (F.stddev_pop(y) < VARIANCE_FLOOR) | (F.stddev_pop(p) < VARIANCE_FLOOR)
    return F.when(flat, F.lit(0.0)).otherwise(spearman_brown_clipped(pearson(y, p)))


def ss_res(y: Column | str, p: Column | str) -> Column:
    return F.sum(F.pow(col(y) - col(p), 2))


def ss_tot(y: Column | str, p: Column | str | None = None) -> Column:
    y = col(y) if p is None else both(y, p)[0]
    return F.var_pop(y) * F.count(y)


def r_squared(y: Column | str, p: Column | str) -> Column:
    """1 - SSres / SStot (not the squared correlation)."""
    return 1 - F.try_divide(ss_res(y, p), ss_tot(y, p))


def r_squared_guarded(y: Column | str, p: Column | str) -> Column:
    return F.when(ss_tot(y, p) <= VARIANCE_FLOOR, F.lit(0.0)).otherwise(r_squared(y, p))


def mse(y: Column | str, p: Column | str) -> Column:
    return F.avg(F.pow(col(y) - col(p), 2))


def concordance(y: Column | str, p: Column | str, eps: float = 1e-8) -> Column:
    """Concordance with the documented mixed denominators: covariance / n, variances / (n - 1)."""
    y, p = both(y, p)
    gap = F.avg(p) - F.avg(y)
    return F.try_divide(2 * F.covar_pop(p, y), F.var_samp(p) + F.var_samp(y) + gap * gap + F.lit(eps))


def correlation_with_norm_floor(y: Column | str, p: Column | str, floor: float = 1e-6) -> Column:
    """Correlation whose denominator (product of centred norms) is held above ``floor``."""
    y, p = both(y, p)
    n = F.count(y)
    norms = F.sqrt(F.var_pop(y) * n) * F.sqrt(F.var_pop(p) * n)
    return F.covar_pop(y, p) * n / F.greatest(norms, F.lit(floor))
