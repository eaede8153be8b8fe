"""Percentile rules, confidence intervals and summaries as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two-sided 95 % quantiles of Student's t by degrees of freedom, 1 to 30.  Fixed values.
T95 = (
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228,
    2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086,
    2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
)
NORMAL95 = 1.96


def percentile(x: Column, q: float, method: str = "linear") -> Column:
    """An exact percentile by one of three rules.

    ``linear`` interpolates; ``nearest`` takes the rank floor(q (n - 1) + 1/2); ``half_even`` rounds that rank half
    to even.  The rank rules gather the group's values, so use them where groups are small (``trials.tails`` elsewhere).
    """
    if method == "linear":
        return F.percentile(x, q)
    values = F.sort_array(F.collect_list(x))
    return F.get(values, rank_of(F.size(values), q, method).cast("int"))


def rank_of(n: Column, q: float, method: str) -> Column:
    """The rank, from 0, of a percentile of n values by ``nearest`` or ``half_even``."""
    place = (n - 1) * q
    return F.floor(place + 0.5) if method == "nearest" else F.bround(place, 0)


def t_quantile(n: Column, last: int = 30) -> Column:
    """The 95 % t quantile of a sample of n, the normal one above ``last`` degrees of freedom; null below two values."""
    table = F.array(*[F.lit(t) for t in T95[:last]])
    return F.when(n >= 2, F.coalesce(F.get(table, (n - 2).cast("int")), F.lit(NORMAL95)))


def spread(x: Column) -> Column:
    """Sample deviation, 0 for a single value, null for none."""
    return F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.stddev_samp(x))


def summary(x: Column, prefix: str = "") -> list[Column]:
    """Count, mean, median, quartiles and extremes."""
    return [
        F.count(x).alias(f"{prefix}n"),
        F.avg(x).alias(f"{prefix}mean"),
        F.percentile(x, 0.5).alias(f"{prefix}median"),
        F.percentile(x, 0.25).alias(f"{prefix}q25"),
        F.percentile(x, 0.75).alias(f"{prefix}q75"),
        F.min(x).alias(f"{prefix}min"),
        F.max(x).alias(f"{prefix}max"),
    ]


def interval(x: Column, prefix: str = "", last: int = 30) -> list[Column]:
    """Mean with its 95 % interval; a single value has itself as bounds and no width."""
    n, mean, std = F.count(x), F.avg(x), F.stddev_samp(x)
    half = F.when(n > 1, t_quantile(n, last) * std / F.sqrt(n))
    return [
        n.alias(f"{prefix}n"),
        mean.alias(f"{prefix}mean"),
        std.alias(f"{prefix}std"),
        (mean - F.coalesce(half, F.lit(0.0))).alias(f"{prefix}ci_low"),
        (mean + F.coalesce(half, F.lit(0.0))).alias(f"{prefix}ci_high"),
        half.alias(f"{prefix}ci_half"),
    ]
