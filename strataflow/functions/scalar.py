"""Scalar expressions with the edge rules of the source semantics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: probabilities are clipped to [CLIP, 1 - CLIP] in the log loss,
# and scores outside that open interval are left out of transformed fits.
CLIP = 1e-15


def hours_between(start: Column, end: Column) -> Column:
    """Number of hour boundaries between two times (not elapsed hours)."""
    return F.timestamp_diff("HOUR", F.date_trunc("HOUR", start), F.date_trunc("HOUR", end))


def plus_hours(ts: Column, hours) -> Column:
    h = hours if isinstance(hours, Column) else F.lit(int(hours))
    return ts + F.make_dt_interval(F.lit(0), h.cast("int"))


def plus_days(ts: Column, days) -> Column:
    d = days if isinstance(days, Column) else F.lit(int(days))
    return ts + F.make_dt_interval(d.cast("int"))


def round_half_up(x: Column) -> Column:
    """Nearest integer, for casts that round instead of truncating."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def to_double(text: Column) -> Column:
    """Number of a text, NULL when it is none; NaN becomes NULL as well."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x), x)


def join_tags(*parts: Column) -> Column:
    """Parts joined with ``_``; NULL and empty parts are left out."""
    return F.concat_ws("_", *[F.nullif(p, F.lit("")) for p in parts])


def clog_log(x: Column) -> Column:
    return F.ln(-F.ln(1 - x))


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def softmax_positive(z0: Column, z1: Column) -> Column:
    """Probability of the second of two classes."""
    return sigmoid(z1 - z0)


def indicator(x: Column) -> Column:
    return F.when(x > 0, 1.0).when(x.isNotNull(), 0.0)


def logistic_surrogate(x: Column) -> Column:
    return F.log1p(F.exp(x)) / F.ln(F.lit(2.0))


def hinge_surrogate(x: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 + x)


def clip_probability(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))


def ratio(num: Column, den: Column) -> Column:
    """Quotient that is NULL for a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def remap(col: Column, mapping: Mapping, default=None) -> Column:
    """Value lookup as one CASE; values not listed keep themselves unless a default is given."""
    expr = None
    for old, new in mapping.items():
        hit = col == F.lit(old)
        expr = F.when(hit, F.lit(new)) if expr is None else expr.when(hit, F.lit(new))
    if expr is None:
        return col
    return expr.otherwise(col if default is None else F.lit(default))


def category_position(col: Column, order: Sequence[str]) -> Column:
    """Place of a value in a report order, values not listed last."""
    pos = F.array_position(F.array(*[F.lit(v) for v in order]), col)
    return F.when(pos > 0, pos).otherwise(F.lit(len(order) + 1)).cast("int")


def count_percent(n: Column, total: Column, digits: int = 0) -> Column:
    """``n (p%)``"""
    pct = ratio(n * 100.0, total)
    return F.format_string(f"%d (%.{digits}f%%)", n.cast("bigint"), pct)


def mean_sd(mean: Column, sd: Column) -> Column:
    """``mean±sd`` without decimals."""
    return F.format_string("%.0f±%.0f", mean, sd)


def interval_text(med: Column, low: Column, high: Column, flag: Column) -> Column:
    """``0.812* (0.790,0.833)``"""
    return F.format_string("%.3f%s (%.3f,%.3f)", med, flag, low, high)
