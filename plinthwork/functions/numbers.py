"""Number columns: decay, ladders, weighted means of what is present, and rounding that every engine shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(x, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(as_col(x)), use)[0]


def rounded(x, places: int = 4) -> Column:
    """Half-up rounding by floor, the same double arithmetic in Spark and in SQL engines."""
    k = float(10**places)
    return F.floor(as_col(x) * k + 0.5) / k


def decay(as_of: Column, date, half_life: float) -> Column:
    """exp(-ln 2 / half_life * years since); no date, or a future one: 1."""
    days = F.greatest(F.lit(0), F.datediff(as_of, as_col(date)))
    return F.coalesce(F.exp(-F.log(F.lit(2.0)) / half_life * days / 365.25), F.lit(1.0))


def clamp(x, low: float, high: float) -> Column:
    """Null stays null, unlike greatest and least, which skip nulls."""
    x = as_col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def ladder(x, steps: list[tuple[float, float]], otherwise=None) -> Column:
    """Value of the first (least, value) step that x reaches; steps go from high to low. Null: null."""
    x = as_col(x)
    out = F.when(x.isNull(), F.lit(None).cast("double"))
    for least, value in steps:
        out = out.when(x >= least, F.lit(float(value)))
    return out.otherwise(F.lit(otherwise).cast("double"))


def weighted_mean_present(parts: list[tuple]) -> Column:
    """Mean of the non-null (column, weight) parts; the weights of nulls drop out of the denominator."""
    top = [F.coalesce(as_col(c), F.lit(0.0)) * float(w) for c, w in parts]
    low = [F.when(as_col(c).isNotNull(), float(w)).otherwise(0.0) for c, w in parts]
    return reduce(Column.__add__, top) / F.nullif(reduce(Column.__add__, low), F.lit(0.0))


def present(*columns) -> Column:
    """How many of the columns are not null."""
    return reduce(Column.__add__, [as_col(c).isNotNull().cast("int") for c in columns])


def ratio(top, bottom) -> Column:
    """Quotient, null where the bottom is 0 or null."""
    return as_col(top) / F.nullif(as_col(bottom), F.lit(0))
