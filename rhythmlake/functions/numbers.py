"""Rounding rules, formats and the normal distribution as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the approximation 7.1.26 of erf in Abramowitz and Stegun, Handbook of Mathematical Functions.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def half_even(x: Column, digits: int) -> Column:
    """Rounded to so many digits, ties to the even one."""
    return F.rint(x * 10.0**digits) / F.lit(10.0**digits)


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounded to so many digits, ties towards plus infinity."""
    return F.floor(x * 10.0**digits + 0.5) / F.lit(10.0**digits)


def whole(x: Column) -> Column:
    """The nearest whole number, ties towards plus infinity."""
    return F.floor(x + 0.5).cast("bigint")


def erf(x: Column) -> Column:
    a = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + ERF_P * a)
    poly = F.lit(0.0)
    for c in reversed(ERF_A):
        poly = (poly + c) * t
    return F.signum(x) * (F.lit(1.0) - poly * F.exp(-a * a))


def normal_cdf(z: Column) -> Column:
    return F.lit(0.5) * (F.lit(1.0) + erf(z / F.sqrt(F.lit(2.0))))


def duration_text(seconds: Column) -> Column:
    """`2h 05m`, `7m` or `42s`."""
    s = seconds.cast("bigint")
    h, m = F.call_function("div", s, F.lit(3600)), F.call_function("div", s % 3600, F.lit(60))
    return F.when(h > 0, F.format_string("%dh %02dm", h, m)).when(m > 0, F.format_string("%dm", m)).otherwise(F.format_string("%ds", s))


def clock_text(minute: Column) -> Column:
    """HH:MM of a minute of the day, kept within the day."""
    m = F.least(F.greatest(whole(minute), F.lit(0)), F.lit(1439))
    return F.format_string("%02d:%02d", F.call_function("div", m, F.lit(60)), m % 60)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
