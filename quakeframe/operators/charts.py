"""Tables behind the charts of a benchmark; drawing is left to the user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeframe.functions import scalars as S
from quakeframe.operators.scans import null_safe


def throughput_by_batch(df: DataFrame, keys: list[str], batch: str, stations: str, seconds: str, keep: Column | None = None) -> DataFrame:
    """Mean stations per second at each batch size, 0 for a run of no time; ``keep`` chooses the runs (one overlap, say)."""
    rate = F.when(F.col(seconds) > 0, F.col(stations) / F.col(seconds)).otherwise(0.0)
    return (df.filter(keep) if keep is not None else df).groupBy(*keys, batch).agg(F.avg(rate).alias("rate"))


def speedup_by_backend(df: DataFrame, keys: list[str], backend: str, seconds: str, is_baseline: Column, is_single: Column) -> DataFrame:
    """Mean baseline over the best time of each backend; null without a baseline or a positive time."""
    base = df.filter(is_baseline).groupBy(*keys).agg(F.avg(seconds).alias("baseline"))
    best = df.filter(is_single).groupBy(*keys, backend).agg(F.min(seconds).alias("best"))
    out = null_safe(best, base, keys, "left")
    return out.withColumn("speedup", F.when(F.col("best") > 0, S.ratio(F.col("baseline"), F.col("best"))))


def stage_breakdown(df: DataFrame, keys: list[str], backend: str, seconds: str, stages: str, order: list[str], is_baseline: Column, is_single: Column, name: str = "baseline_annotate") -> DataFrame:
    """Seconds by stage of each backend's fastest run, and of the fastest baseline under its own ``name``.

    ``stages`` is a map; a stage that a run lacks counts 0.  Of runs of equal time the one of smaller stages counts.
    """
    times = F.array(*[F.coalesce(F.try_element_at(stages, F.lit(s)), F.lit(0.0)) for s in order])
    rows = df.filter(is_single | is_baseline).withColumn("__b", F.when(is_baseline, F.lit(name)).otherwise(F.col(backend)))
    rows = rows.groupBy(*keys, F.col("__b").alias(backend)).agg(F.min(F.struct(F.col(seconds).alias("s"), times.alias("times"))).alias("best"))
    pairs = F.arrays_zip(F.array(*[F.lit(s) for s in order]).alias("stage"), F.col("best.times").alias("seconds"))
    return rows.select(*keys, backend, F.inline(pairs))


def one_and_two_devices(df: DataFrame, keys: list[str], seconds: str, is_single: Column, is_dual: Column) -> DataFrame:
    """Best time on one device and on two where both were run, and the gain."""
    best = df.groupBy(*keys).agg(F.min(F.when(is_single, F.col(seconds))).alias("one"), F.min(F.when(is_dual, F.col(seconds))).alias("two"))
    return best.filter("one IS NOT NULL AND two IS NOT NULL").withColumn("gain", S.ratio(F.col("one"), F.col("two")))
