"""Statistics of experiments: grouped moments in Spark, one row out."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaline.operators.percentiles import exact_percentiles
from tessaline.session import cut

SRM_ALERT = 0.001


def sample_ratio(counts: DataFrame, shares: DataFrame) -> DataFrame:
    """(experiment, chi2, df, p_value, alert) of (experiment, variant, n) against (experiment, variant, pct)."""
    total = counts.groupBy("experiment").agg(F.sum("n").alias("total"))
    rows = shares.join(total, "experiment").join(counts, ["experiment", "variant"], "left")
    want = F.col("total") * F.col("pct") / 100
    g = rows.groupBy("experiment").agg(F.sum((F.coalesce("n", F.lit(0)) - want) ** 2 / want).alias("chi2"), (F.count("*") - 1).alias("df"))
    tail = F.udf(chi2_tail, "double")  # one row for each experiment
    g = g.withColumn("p_value", tail("chi2", "df"))
    return g.withColumn("alert", F.col("p_value") < SRM_ALERT)


def two_proportions(rows: DataFrame, arm: str, hit: str, z: float = 1.959964) -> DataFrame:
    """(z, difference, low, high) of the share of hits in arm 1 against arm 0: z with a pooled variance, the interval of the difference without."""
    count = lambda value, what: F.count(F.when((F.col(arm) == value) & what, 1))
    g = rows.agg(count(0, F.lit(True)).alias("n0"), count(1, F.lit(True)).alias("n1"), count(0, F.col(hit)).alias("h0"), count(1, F.col(hit)).alias("h1"))
    p = (F.col("h0") + F.col("h1")) / (F.col("n0") + F.col("n1"))
    p0, p1 = F.col("h0") / F.col("n0"), F.col("h1") / F.col("n1")
    spread = F.sqrt(p0 * (1 - p0) / F.col("n0") + p1 * (1 - p1) / F.col("n1"))
    score = (p1 - p0) / F.sqrt(p * (1 - p) * (1 / F.col("n0") + 1 / F.col("n1")))
    return g.select(score.alias("z"), (p1 - p0).alias("difference"), (p1 - p0 - z * spread).alias("low"), (p1 - p0 + z * spread).alias("high"))


def welch(rows: DataFrame, arm: str, value: str, confidence: float = 0.95) -> DataFrame:
    """(t, df, difference, p_value, low, high) of the mean in arm 1 against arm 0: two-sided, with the interval of the difference; null where an arm has fewer than two rows or nothing varies."""
    of = lambda f, a: f(F.when(F.col(arm) == a, F.col(value)))
    g = rows.agg(*[of(f, a).alias(f"{n}{a}") for a in (0, 1) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    s0, s1 = F.try_divide("v0", "n0"), F.try_divide("v1", "n1")
    spread, difference = F.sqrt(s0 + s1), F.col("m1") - F.col("m0")
    df = F.try_divide((s0 + s1) ** 2, s0**2 / (F.col("n0") - 1) + s1**2 / (F.col("n1") - 1))
    g = g.filter("n0 > 1 AND n1 > 1").select(F.try_divide(difference, spread).alias("t"), df.alias("df"), difference.alias("difference"), spread.alias("_s"))
    tail, border = F.udf(lambda t, df: None if t is None or df is None else t_tail(t, df), "double"), F.udf(lambda df: None if df is None else t_border(confidence, df), "double")  # one row
    g = g.withColumn("p_value", tail("t", "df")).withColumn("_b", border("df") * F.col("_s"))
    return g.select("t", "df", "difference", "p_value", (F.col("difference") - F.col("_b")).alias("low"), (F.col("difference") + F.col("_b")).alias("high"))


def guardrails(rows: DataFrame, variant: str, failed: str, latency: str, limits: dict[str, float]) -> DataFrame:
    """(variant, n, error_rate, p95, breached): share of failures and 95th percentile of a latency for each variant, against limits (error_rate, p95)."""
    g = rows.groupBy(variant).agg(F.count("*").alias("n"), F.avg(F.col(failed).cast("double")).alias("error_rate"))
    p95 = exact_percentiles(rows, latency, [0.95], variant).select(F.col(variant).alias("_variant"), F.col("value").alias("p95"))
    g = g.join(p95, F.col(variant).eqNullSafe(F.col("_variant")), "left").drop("_variant")
    return g.withColumn("breached", (F.col("error_rate") > limits["error_rate"]) | (F.col("p95") > limits["p95"]))


def stability_index(rows: DataFrame, period: str, value: str, bins: int = 10, least: float = 1e-4) -> DataFrame:
    """(psi) of a value in period 1 against period 0: bins of equal width between the extremes of both; shares below least count as least."""
    ends = rows.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    at = F.least(F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1)).cast("int")
    binned = rows.crossJoin(F.broadcast(ends)).select(F.col(period).alias("period"), F.when(F.col("high") > F.col("low"), at).otherwise(0).alias("bin"))
    counts = binned.groupBy("bin").agg(F.count(F.when(F.col("period") == 0, 1)).alias("a"), F.count(F.when(F.col("period") == 1, 1)).alias("b"))
    totals = counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    share = lambda n, t: F.greatest(F.col(n) / F.col(t), F.lit(least))
    terms = counts.crossJoin(F.broadcast(totals)).select(((share("b", "tb") - share("a", "ta")) * F.log(share("b", "tb") / share("a", "ta"))).alias("x"))
    return terms.agg(F.sum("x").alias("psi"))


#: Long and short window of a burn-rate alert in hours, and the rate at which it fires.
BURN_ALERTS = ((1, 1 / 12, 14.4), (6, 0.5, 6.0), (72, 6, 3.0))


def burn_alerts(log: DataFrame, ts: str, failed: str, now: Column, budget: float = 0.005) -> DataFrame:
    """(window_hours, long_burn, short_burn, fires): errors over the error budget in a long and a short window before now; an alert needs both."""
    age = (F.unix_micros(now) - F.unix_micros(ts)) / 3600e6
    inside = lambda hours: (age >= 0) & (age < hours)
    burn = lambda hours: F.coalesce(F.avg(F.when(inside(hours), F.col(failed).cast("double"))) / budget, F.lit(0.0))
    g = log.agg(*[burn(h).alias(f"{kind}{i}") for i, (long, short, _) in enumerate(BURN_ALERTS) for kind, h in (("long", long), ("short", short))])
    rows = F.array(*[F.struct(F.lit(float(long)).alias("window_hours"), F.col(f"long{i}").alias("long_burn"), F.col(f"short{i}").alias("short_burn"), ((F.col(f"long{i}") >= rate) & (F.col(f"short{i}") >= rate)).alias("fires")) for i, (long, _, rate) in enumerate(BURN_ALERTS)])
    return g.select(F.explode(rows).alias("r")).select("r.*")


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, rate) of (score from 0 to 1, label 0 or 1)."""
    at = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("label").cast("double")).alias("rate"))


def area_under_curve(scored: DataFrame, *groups: str) -> DataFrame:
    """(groups, auc) of (groups, score, label): the chance that a 1 scores above a 0, ties by half; null for a group of one class. Distinct scores are dealt by ranges, of which each knows the zeros before it; no task ranks them all."""
    g = scored.groupBy(*groups, "score").agg(F.count(F.when(F.col("label") == 1, 1)).alias("ones"), F.count(F.when(F.col("label") == 0, 1)).alias("zeros"))
    g = cut(g.repartitionByRange(*groups, "score").withColumn("_part", F.spark_partition_id()))
    ranges = g.groupBy(*groups, "_part").agg(F.sum("zeros").alias("_zeros"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*groups, "_part", F.coalesce(F.sum("_zeros").over(earlier), F.lit(0)).alias("_before"))  # a row for each range and group
    own = Window.partitionBy("_part", *groups).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("_below", F.coalesce(F.sum("zeros").over(own), F.lit(0))).join(ranges, [*groups, "_part"])
    below = F.col("_before") + F.col("_below") + F.col("zeros") / 2
    return g.groupBy(*groups).agg(F.try_divide(F.sum(F.col("ones") * below), F.sum("ones") * F.sum("zeros")).alias("auc"))


def chi2_tail(x: float, df: int) -> float:
    """Chance of a chi-square value of x or more, by the series or the continued fraction of the incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def t_tail(t: float, df: float) -> float:
    """Two-sided chance of a t value of this size or more: the regularised incomplete beta function at df / (df + t^2), by its continued fraction."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1.0:
        return 1.0
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        x, a, b = 1 - x, b, a
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a if x > 0 else 0.0
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * h if swap else front * h


def t_border(confidence: float, df: float) -> float:
    """The t value that is exceeded in size with chance 1 - confidence."""
    low, high = 0.0, 1.0
    while t_tail(high, df) > 1 - confidence:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_tail(middle, df) > 1 - confidence else (low, middle)
    return (low + high) / 2


def p_value(z: float) -> float:
    """Two-sided, normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def exact_mean(value: str) -> Column:
    """Mean from a decimal sum to ten places, the same in any order of the rows, so that equal means compare equal; of doubles where a value is no such decimal (not finite, or 1e18 and more)."""
    exact = F.col(value).try_cast("decimal(28,10)")
    return F.when(F.count(exact) == F.count(value), F.avg(exact).cast("double")).otherwise(F.avg(value))


def holm(p_values: DataFrame, family: str, hypothesis: str, p: str, alpha: float = 0.05) -> DataFrame:
    """(family, hypothesis, p, rejected): Holm's step-down procedure within each family of hypotheses; equal p-values go in the order of their names."""
    order = Window.partitionBy(family).orderBy(p, hypothesis)
    left = F.count("*").over(Window.partitionBy(family)) - F.row_number().over(order) + 1
    rows = p_values.withColumn("_holds", F.col(p) <= F.lit(alpha) / left)
    return rows.withColumn("rejected", F.min("_holds").over(order.rowsBetween(Window.unboundedPreceding, 0))).select(family, hypothesis, p, "rejected")


def sample_size(base: Column, effect: Column, z_alpha: float = 1.959964, z_power: float = 0.841621) -> Column:
    """Rows per arm to see an absolute change of a rate; null where the changed rate is none."""
    other = base + effect
    n = F.ceil(F.lit((z_alpha + z_power) ** 2) * (base * (1 - base) + other * (1 - other)) / (effect * effect))
    return F.when(other.between(0, 1) & (effect != 0), n)
