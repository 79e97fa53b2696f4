"""Vector arithmetic in double precision as Catalyst expressions, and ranking scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINMAX_EPSILON, NEUTRAL = 1e-8, 0.5


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """Unit vector; null for a vector of length below 1e-12."""
    size = norm(a)
    return F.when(size >= 1e-12, F.transform(a, lambda x: x.cast("double") / size))


def signed_round(x: Column, digits: int) -> Column:
    """Rounded half away from zero; the sign stays where nothing else is left of a number (-0.0), as SQL over floats has it."""
    return F.signum(x) * F.round(F.abs(x), digits)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def mean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): the mean of each key's vectors, position by position; partial sums combine before the shuffle."""
    each = rows.select(key, F.posexplode(vector).alias("position", "x"))
    means = each.groupBy(key, "position").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "x"))), lambda s: s["x"]).alias(vector))


def minmax_norm(value: Column, by: str) -> Column:
    """Values of a query scaled to 0..1; all equal: 0.5."""
    own = Window.partitionBy(by)
    low, high = F.min(value).over(own), F.max(value).over(own)
    return F.when(high == low, F.lit(NEUTRAL)).otherwise((value - low) / (high - low + MINMAX_EPSILON))


def rank_norm(value: Column, by: str) -> Column:
    """1 - average descending rank / (n - 1); ties share their mean rank; a single value: 0.5."""
    before = F.rank().over(Window.partitionBy(by).orderBy(F.desc_nulls_last(value))) - 1
    ties = F.count(F.lit(1)).over(Window.partitionBy(by, value))
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    return F.when(n == 1, F.lit(NEUTRAL)).otherwise(1 - (before + (ties - 1) / 2) / (n - 1))


def recency_decay(age_days: Column, half_life: float) -> Column:
    """Half for each half-life; a negative age is an error."""
    checked = F.when(age_days < 0, F.raise_error(F.lit("an age must not be negative"))).otherwise(age_days)
    return F.pow(F.lit(0.5), checked / half_life)


def age_days(now: Column, then: Column) -> Column:
    """Days since a timestamp, at least 0; null without one."""
    return F.when(then.isNotNull(), F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(then)) / F.lit(86_400e6)))
