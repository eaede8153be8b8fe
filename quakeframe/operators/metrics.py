"""Scores of picks and drift of probability traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeframe.functions import scalars as S
from quakeframe.functions import statistics as st
from quakeframe.operators.scans import with_quantiles

BUCKETS = (1, 5, 10)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall))


def phase_metrics(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, precision, recall, F1 and timing errors from ``kind`` and ``delta``.

    Duplicates stay out of the precision.  ``n_catalog`` counts stations with a pick, as in the reference semantics.
    """
    n = {k: F.count_if(F.col("kind") == k) for k in ("matched", "missing", "additional", "duplicated")}
    d, a = F.col("delta"), F.abs("delta")
    rows = judged.groupBy(*keys).agg(
        F.count_distinct("station").alias("n_catalog"),
        F.count_if(F.col("kind") != "missing").alias("n_detected"),
        *[c.alias(k) for k, c in n.items()],
        F.avg(d).alias("mean_dt"),
        st.spread(d).alias("std_dt"),
        *[F.avg((a <= b).cast("double")).alias(f"frac_within_{b}") for b in BUCKETS],
    )
    rows = with_quantiles(rows, judged, keys, {"d": d, "a": a}, {"d": [("median_dt", 0.5)], "a": [(f"p{q}_abs_dt", q / 100) for q in (50, 95, 99)]})
    precision = S.ratio(F.col("matched"), F.col("matched") + F.col("additional"))
    recall = S.ratio(F.col("matched"), F.col("matched") + F.col("missing"))
    return rows.withColumns({"precision": precision, "recall": recall}).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def detection_totals(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Totals over traces; duplicates count against the precision, and missing ratios are zero."""
    names = {"n_catalog": "total_catalog", "n_detected": "total_detected", "n_matched": "total_matched", "n_missing": "total_missing", "n_additional": "total_additional", "n_duplicates": "total_duplicates"}
    rows = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_traces"), *[F.sum(k).alias(v) for k, v in names.items()])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = rows.withColumns({"precision": zero(S.ratio(F.col("total_matched"), F.col("total_detected"))), "recall": zero(S.ratio(F.col("total_matched"), F.col("total_catalog")))})
    return rows.withColumn("f1", zero(f1(F.col("precision"), F.col("recall"))))


def delta_statistics(rows: DataFrame, keys: list[str], delta: str = "delta", rate_hz: float = 100.0) -> DataFrame:
    """Statistics of deltas in samples and milliseconds; population deviation; percentages within 1, 5 and 10."""
    d, a = F.col(delta).cast("double"), F.abs(F.col(delta).cast("double"))
    plain = rows.groupBy(*keys).agg(
        F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"),
        *[F.coalesce(F.avg((a <= b).cast("double")) * 100, F.lit(0.0)).alias(f"pct_within_{b}") for b in BUCKETS],
    )
    out = with_quantiles(plain, rows, keys, {"d": d, "a": a}, {"d": [("median", 0.5)], "a": [(f"p{q}", q / 100) for q in (50, 95, 99)]})
    stats = ("mean", "median", "std", "p50", "p95", "p99")
    return out.select(
        *keys, "n", *[F.col(k).alias(f"{k}_samples") for k in stats], *[(F.col(k) * (1000.0 / rate_hz)).alias(f"{k}_ms") for k in stats], *[f"pct_within_{b}" for b in BUCKETS]
    )


def probability_drift(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Mean and largest absolute error, root mean square and correlation over pairs of which both are finite.

    ``rows`` has one pair a row.  The correlation is null where either side is constant.
    """
    both = S.is_finite(F.col(a)) & S.is_finite(F.col(b))
    x, y = (F.when(both, F.col(c).cast("double")) for c in (a, b))
    e = x - y
    out = rows.groupBy(*keys).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.max(F.abs(e)).alias("max_abs_err"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.covar_pop(x, y).alias("cov"),
        F.stddev_pop(x).alias("sx"),
        F.stddev_pop(y).alias("sy"),
        F.count(e).alias("n_samples"),
    )
    return out.withColumn("pearson", F.when((F.col("sx") > 0) & (F.col("sy") > 0), F.col("cov") / (F.col("sx") * F.col("sy")))).drop("cov", "sx", "sy")


def exploded_pairs(a: DataFrame, b: DataFrame, keys: list[str], array: str) -> DataFrame:
    """One row per sample of two runs' arrays with the same keys."""
    both = a.select(*keys, F.col(array).alias("x")).join(b.select(*keys, F.col(array).alias("y")), keys)
    return both.select(*keys, F.posexplode(F.arrays_zip("x", "y")).alias("i", "z")).select(*keys, "i", F.col("z.x").alias("a"), F.col("z.y").alias("b"))


def pick_drift(sides: DataFrame, keys: list[str]) -> DataFrame:
    """From matched sides: pairs, those missing on either side, and the drift of the pairs."""
    d = F.col("a_value") - F.col("b_value")
    plain = sides.groupBy(*keys).agg(
        F.count_if(F.col("side") == "pair").alias("n_pairs"),
        F.count_if(F.col("side") == "a").alias("n_missing_b"),
        F.count_if(F.col("side") == "b").alias("n_missing_a"),
        F.avg(d).alias("mean_delta"),
        F.max(F.abs(d)).alias("max_abs_delta"),
    )
    return with_quantiles(plain, sides, keys, {"d": d, "a": F.abs(d)}, {"d": [("median_delta", 0.5)], "a": [("p95_abs_delta", 0.95)]})


def cumulative_share(rows: DataFrame, keys: list[str], delta: str = "delta", most: int = 50) -> DataFrame:
    """``tolerance, pct``: the share of deltas within each tolerance from 0 to ``most``.

    Deltas are counted once by the tolerance they need, then summed along the grid, so no row is repeated.
    """
    need = F.least(F.ceil(F.abs(F.col(delta))), F.lit(most + 1)).cast("int")
    counts = rows.filter(F.col(delta).isNotNull()).groupBy(*keys, need.alias("need")).agg(F.count(F.lit(1)).alias("n"))
    lists = counts.groupBy(*keys).agg(F.collect_list(F.struct("need", "n")).alias("c"), F.sum("n").alias("total"))
    grid = lists.select(*keys, "c", "total", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("tolerance"))
    within = F.aggregate(F.filter("c", lambda x: x["need"] <= F.col("tolerance")), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return grid.select(*keys, "tolerance", (within * 100.0 / F.col("total")).alias("pct"))


def histogram(rows: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """``bin, n`` of equal bins; the last is closed; empty bins have zero."""
    x = F.col(value)
    place = F.least(F.floor((x - low) * bins / (high - low)).cast("int"), F.lit(bins - 1))
    counts = rows.filter((x >= low) & (x <= high)).groupBy(*keys, place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = rows.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))) if keys else rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))
