"""Numeric noise with a deterministic draw.

The draw is Laplace(0, scale) taken from a digest of the row's key, so a
retried task, a replayed batch and the stream all produce the same value.  It
is plain value distortion; no privacy budget is accounted for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .digests import TWO_52, digest52

SPREAD_SHARE = 0.1  # fixed value: noise scale as a share of the population deviation
SCALE_DIGITS = 6  # significant digits of the scale: a float sum depends on the order of partitions


def noise_scale(value: Column) -> Column:
    """Aggregate: the scale of one column over its finite values; 1.0 when it holds none."""
    return F.coalesce(significant(F.stddev_pop(finite(value)) * SPREAD_SHARE), F.lit(1.0))


def finite(value: Column) -> Column:
    """The value, or null if it is NaN or infinite."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def significant(value: Column, digits: int = SCALE_DIGITS) -> Column:
    """A positive number rounded to significant digits, whatever its size."""
    unit = F.concat(F.lit("1e"), (F.floor(F.log10(value)) - (digits - 1)).cast("string")).cast("double")
    return F.when(value == 0, F.lit(0.0)).otherwise(F.round(value / unit) * unit)


def uniform(text: Column) -> Column:
    """A number in the open interval (-0.5, 0.5) derived from the text."""
    return (digest52(text) + F.lit(0.5)) / F.lit(TWO_52) - F.lit(0.5)


def laplace(text: Column, scale: Column) -> Column:
    u = uniform(text)
    return -scale * F.signum(u) * F.ln(F.lit(1.0) - F.lit(2.0) * F.abs(u))


def precision_kind(pii_type: str | None, column_name: str) -> str:
    low = column_name.lower()
    if (pii_type or "").upper() == "FINANCIAL" or any(
        part in low for part in ("salary", "balance", "amount")
    ):
        return "cents"
    return "age" if "age" in low else "whole"


def add_noise(
    value: Column, text: Column, scale: Column, pii_type: str | None, column_name: str
) -> Column:
    noisy = finite(value) + laplace(text, scale)
    kind = precision_kind(pii_type, column_name)
    if kind == "cents":
        return F.round(noisy, 2)
    whole = F.round(noisy, 0)
    return F.greatest(whole, F.lit(0.0)) if kind == "age" else whole


def shift_date(value: Column, text: Column, days: float, timed: bool = False) -> Column:
    """Move a date, or with ``timed`` a timestamp at its time of day, by a Laplace draw of scale ``days``."""
    drawn = F.round(laplace(text, F.lit(float(days)))).cast("int")
    return value + F.make_dt_interval(drawn) if timed else F.date_add(value, drawn)


def fixed_factor(value: Column) -> Column:
    return F.round(value.cast("double") * F.lit(1.02), 2)


def preview_shift(value: Column, column_name: str) -> Column:
    """Review preview of a number: a shift between -10 % and +9 % fixed by the column name."""
    share = (sum(ord(ch) for ch in column_name) % 20 - 10) / 100
    return F.floor(value.cast("double") * F.lit(1 + share) + F.lit(0.5)).cast("double")
