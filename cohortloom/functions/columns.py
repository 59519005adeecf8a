"""Column expressions: intervals, rounding, suppression, periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The normal quantile of a 95 % interval, and the follow-up windows in days.
Z = 1.959964
WINDOWS = (30, 90, 180, 365, 730, 1095)
DAY_US = 86_400_000_000


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator as a double; null where the denominator is 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Wilson score interval clipped to [0, 1]; null where n is 0 (AG14)."""
    n = F.when(n > 0, n.cast("double"))
    p = k.cast("double") / n
    base = F.lit(1.0) + F.lit(z * z) / n
    mid = (p + F.lit(z * z) / (F.lit(2.0) * n)) / base
    half = F.lit(z) / base * F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(z * z) / (F.lit(4.0) * n * n))
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), mid - half)), F.when(n.isNotNull(), F.least(F.lit(1.0), mid + half))


def normal_interval(estimate: Column, error: Column, z: float = Z) -> tuple[Column, Column]:
    """Normal interval clipped to [0, 1] (AG15)."""
    return F.greatest(F.lit(0.0), estimate - F.lit(z) * error), F.least(F.lit(1.0), estimate + F.lit(z) * error)


def round6(value: Column) -> Column:
    """Six places, ties to even (AG16)."""
    return F.bround(value, 6)


def decimal_share(numerator: Column, denominator: Column) -> Column:
    """Exact decimal share at six places, ties to even; null where nothing counts (AG18)."""
    return F.when(denominator > 0, F.bround(numerator.cast("decimal(20,0)").cast("decimal(38,18)") / denominator.cast("decimal(20,0)"), 6).cast("decimal(9,6)"))


def suppression_reason(cohort: Column, threshold: int, expected: Column | None = None, least_expected: float = 5.0) -> Column:
    """Why a figure is withheld, or null: too few members first, then too few expected (AG13)."""
    out = F.when(cohort < threshold, F.lit("cohort_below_threshold"))
    return out if expected is None else out.when(expected < least_expected, F.lit("expected_below_minimum"))


def masked(figure: Column, suppressed: Column) -> Column:
    """The figure, null where it is suppressed (FI12)."""
    return F.when(~suppressed, figure)


def microseconds(start: Column, end: Column) -> Column:
    """end - start in microseconds: windows compare instants, never days."""
    return F.unix_micros(end) - F.unix_micros(start)


def days(n: Column) -> Column:
    """An interval of n days."""
    return F.make_dt_interval(n.cast("int"))
