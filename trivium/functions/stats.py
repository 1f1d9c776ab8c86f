"""Column means with t intervals, correlation and regression, histograms, column means."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def t_cdf(t: float, df: float) -> float:
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x == 0 or x == 1:
        tail = float(x)
    elif x < (a + 1) / (a + b + 2):
        tail = front * _beta_fraction(a, b, x) / a
    else:
        tail = 1 - front * _beta_fraction(b, a, 1 - x) / b
    return 1 - tail / 2 if t >= 0 else tail / 2


def t_quantile(p: float, df: float) -> float:
    """The t distribution's quantile, by bisection."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 1.0
    while t_cdf(high, df) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def column_cis(d: DataFrame, columns: list[str], level: float = 0.95) -> DataFrame:
    """(column, mean, lower_ci, upper_ci, n): mean and t interval of each column; a constant one has its mean thrice.

    One pass over the data makes three numbers a column; the quantile is computed once for each n.
    Raises for fewer than two rows or a null.
    """
    x = lambda c: F.col(f"`{c}`").cast("double")
    wide = d.agg(F.count("*").alias("rows"), *[f(x(c)).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_samp))]).first()
    if wide["rows"] <= 1:
        raise ValueError("more than one row is needed")
    out = []
    for i, c in enumerate(columns):
        n, m, s = (wide[f"{k}_{i}"] for k in "nms")
        if n < wide["rows"]:
            raise ValueError(f"column {c} has missing values")
        half = t_quantile((1 + level) / 2, n - 1) * s / math.sqrt(n) if s else 0.0
        out.append((c, m, m - half, m + half, n))
    return d.sparkSession.createDataFrame(out, "column string, mean double, lower_ci double, upper_ci double, n long")


def fit_line(d: DataFrame, x: str, y: str) -> DataFrame:
    """(r, slope, intercept, n) over complete pairs; a constant column leaves null what it makes undefined."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sums = d.where(a.isNotNull() & b.isNotNull()).agg(
        F.covar_pop(a, b).alias("c"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.count("*").alias("n"))
    zero = F.lit(0.0)
    slope = F.col("c") / F.nullif(F.col("va"), zero)
    r = F.col("c") / F.nullif(F.sqrt(F.col("va")) * F.sqrt(F.col("vb")), zero)
    return sums.select(r.alias("r"), slope.alias("slope"), (F.col("mb") - slope * F.col("ma")).alias("intercept"), "n")


def histogram(d: DataFrame, column: str, low: float, high: float, bins: int = 10) -> DataFrame:
    """(bin, n): bins of equal width, 1 to bins, the last closed; values outside aren't counted."""
    v = F.col(column).cast("double")
    number = F.least(F.width_bucket(v, F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins).cast("long"))
    return d.where((v >= low) & (v <= high)).groupBy(number.alias("bin")).agg(F.count("*").alias("n"))


def column_means(d: DataFrame, columns: list[str]) -> DataFrame:
    return d.agg(*[F.avg(F.col(f"`{c}`").cast("double")).alias(c) for c in columns])


def range_of(d: DataFrame, column: str) -> DataFrame:
    return d.agg(F.min(column).alias("low"), F.max(column).alias("high"))
