"""Column expressions for velocities, shares, weeks and rounding."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from upswell.fixed_values import CONFIRMED, MIN_WEEKS


def monday(value: dt.date | str) -> dt.date:
    """A Python date that must already be a week start."""
    day = dt.date.fromisoformat(value) if isinstance(value, str) else value
    if day.weekday() != 0:
        raise ValueError(f"{day} is not a Monday")
    return day


def view_velocity(prev: Column, this: Column) -> Column:
    """Gain this week over gain last week; NULL without a positive baseline."""
    return F.when(prev > 0, this / prev)


def deriv_velocity(prev_sum: Column, this: Column, weeks: int = 4) -> Column:
    """Count this week over the mean of the previous ``weeks`` counts; NULL if that is 0."""
    return F.when(prev_sum != 0, this / (prev_sum / F.lit(weeks)))


def tag_share(n: Column, total: Column) -> Column:
    """Percent of ``total``; 0.0 for an empty total."""
    return F.when(total != 0, F.lit(100.0) * n / total).otherwise(F.lit(0.0))


def tag_share_delta(prev: Column, this: Column) -> Column:
    """Change in percentage points."""
    return this - prev


def is_coldstart(weeks: Column, min_weeks: int = MIN_WEEKS) -> Column:
    """Too few weeks of history to score."""
    return weeks < F.lit(min_weeks)


def week_start(day: Column) -> Column:
    """Monday of the ISO week, as a date."""
    return F.trunc(day, "week")


def ratio(num: Column, den: Column, digits: int = 3) -> Column:
    """Rounded quotient; 0.0 when the denominator is 0."""
    return F.when(den != 0, F.bround(num / den, digits)).otherwise(F.lit(0.0))


def round2(value: Column) -> Column:
    """Two decimals, half to even; NULL stays NULL."""
    return F.bround(value, 2)


def confirmed_canon(status: Column, canon: Column) -> Column:
    """Only tags with a confirmed canonical name enter the trend axis."""
    return status.isin(*CONFIRMED) & canon.isNotNull()


def effective_tag(status: Column, canon: Column, name: Column) -> Column:
    """Canonical name once confirmed, raw name before."""
    return F.when(confirmed_canon(status, canon), canon).otherwise(name)
