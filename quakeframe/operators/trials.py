"""Analysis of benchmark trials: repeats, intervals, speedups, winners, elbows, pivots, audits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quakeframe.functions import scalars as S
from quakeframe.functions import statistics as st
from quakeframe.operators.runs import materialised
from quakeframe.operators.scans import carried, dealt, null_safe, quantiles, with_quantiles

MASK = (1 << 64) - 1


def present(df: DataFrame, names: list[str]) -> list[str]:
    """Those of the names that are columns; absent axes are skipped."""
    return [n for n in names if n in df.columns]


# --- repeats -----------------------------------------------------------------------------------------------------------


def collapse_repeats(df: DataFrame, axes: list[str], metrics: list[str]) -> DataFrame:
    """Median, extremes, deviation and count of each metric per group; null keys form groups."""
    axes, metrics = present(df, axes), present(df, metrics)
    aggs = []
    for m in metrics:
        x = F.col(m)
        aggs += [F.min(x).alias(f"{m}_min"), F.max(x).alias(f"{m}_max"), F.stddev_samp(x).alias(f"{m}_std"), F.count(x).alias(f"{m}_count")]
    plain = df.groupBy(*axes).agg(*aggs)
    return with_quantiles(plain, df, axes, {m: F.col(m) for m in metrics}, {m: [(f"{m}_median", 0.5)] for m in metrics}) if metrics else plain


def summarize_repeats(df: DataFrame, keys: list[str], metrics: list[str], success: str) -> DataFrame:
    """Least, mean and deviation (0 for one) of each metric over successful repeats, and the success rate."""
    ok = F.coalesce(F.col(success), F.lit(False))
    aggs = []
    for m in metrics:
        x = F.when(ok, F.col(m))
        aggs += [F.min(x).alias(f"{m}_min"), F.avg(x).alias(f"{m}_mean"), st.spread(x).alias(f"{m}_std")]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_repeats"), F.avg(ok.cast("double")).alias("success_rate"), *aggs)


def summarize_nested(df: DataFrame, keys: list[str], metrics: str) -> DataFrame:
    """Summary of each entry of a map column of metrics, one row per key and metric."""
    long = df.select(*keys, F.explode(metrics).alias("metric", "value"))
    return long.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), st.spread(F.col("value")).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n"))


def with_intervals(df: DataFrame, axes: list[str], metric: str, last: int = 30) -> DataFrame:
    return df.groupBy(*present(df, axes)).agg(*st.interval(F.col(metric), f"{metric}_", last))


def bootstrap_ratio(df: DataFrame, keys: list[str], top: str, bottom: str, draws: int = 10000, seed: int = 0) -> DataFrame:
    """Ratio of means with a 95 % interval from seeded resampling; columns ``top`` and ``bottom`` are arrays of a group's repeats.

    Groups are repeats of one cell, a handful of values; draws are folded inside the row, so nothing is shuffled.
    """

    def mean_of(values: Column, draw: Column, salt: int) -> Column:
        n = F.size(values)
        picked = F.transform(F.sequence(F.lit(1), n), lambda i: F.get(values, F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), draw, i), n).cast("int")))
        return F.aggregate(picked, F.lit(0.0), lambda a, x: a + x) / n

    plain = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)
    ratios = F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda d: mean_of(F.col(top), d, 1) / mean_of(F.col(bottom), d, 2)))
    rows = df.select(*keys, (plain(F.col(top)) / plain(F.col(bottom))).alias("ratio"), ratios.alias("r"))
    return rows.select(*keys, "ratio", F.get("r", F.lit(int(0.025 * draws))).alias("ci_low"), F.get("r", F.lit(int(0.975 * draws) - 1)).alias("ci_high"))


def bootstrap_pooled(df: DataFrame, keys: list[str], value: str, top: Column, bottom: Column, draws: int = 10000, seed: int = 0, block_rows: int = 8192) -> DataFrame:
    """As ``bootstrap_ratio``, for groups of any size: one row per repeat, of the side for which ``top`` or ``bottom`` is true.

    Every draw takes as many repeats as the side has, with replacement.  Repeats lie in blocks of about ``block_rows``;
    how many of a draw fall into each block is multinomial, and a block then draws its part by itself, so no task holds
    a side.  The blocks are the leaves of a binary tree: a node shares each draw's count between its halves by a
    binomial that is seeded by the node's place alone, so a block finds its own counts by going down from the root, and
    all blocks below a node agree on what it shared.  Blocks follow from the values alone: a seed gives the same draws
    however the input is split.
    """
    side = [*keys, "side"]
    rows = df.select(*keys, F.when(top, 1).when(bottom, 2).alias("side"), F.col(value).cast("double").alias("v")).filter("side IS NOT NULL AND v IS NOT NULL")
    counts = rows.groupBy(*side, "v").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy(*side).agg(F.sum("n").alias("total"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
    # a value of many repeats is cut into pieces, so that blocks stay bounded
    pieces = null_safe(counts, sizes, side, "inner").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / 1024))))
    n_blocks = F.ceil(F.col("total") / block_rows)
    pieces = pieces.withColumns({"c": F.least(F.lit(1024), F.col("n") - F.col("piece") * 1024).cast("int"), "block": F.pmod(F.xxhash64("v", "piece"), n_blocks), "levels": F.ceil(F.log2(n_blocks.cast("double"))).cast("int")})
    blocks = pieces.groupBy(*side, "block").agg(F.sort_array(F.collect_list(F.struct("v", "c"))).alias("values"), F.sum("c").alias("n"), F.max("levels").alias("levels"))
    blocks = materialised(blocks.withColumn("tree", F.xxhash64(F.lit(seed), *side)))

    above = blocks.select(*side, "block", "n", F.explode(F.sequence(F.lit(0), "levels")).alias("level")).withColumn("node", F.expr("shiftright(block, level)"))
    nodes = above.groupBy(*side, "level", "node").agg(F.sum("n").alias("held"))
    chains = null_safe(above, nodes, [*side, "level", "node"], "inner").groupBy(*side, "block").agg(F.array_sort(F.collect_list(F.struct("level", "held"))).alias("chain"))
    dealt = null_safe(blocks, chains, [*side, "block"], "inner").select(*side, "block", "tree", "values.v", "values.c", F.col("chain.held").alias("held"))

    def draw(batches):
        held = {}
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                v, c = (one.column(x).flatten().to_numpy(zero_copy_only=False) for x in ("v", "c"))
                tree, block, held_above = (one.column(x)[0].as_py() for x in ("tree", "block", "held"))
                rng = np.random.Generator(np.random.SFC64([tree & MASK, block, 2]))
                sums = _drawn_sums(np.repeat(v, c), _share_of_block(tree & MASK, block, held_above, draws), rng)
                of = tuple(one.column(k)[0].as_py() for k in side)
                if of in held:
                    held[of] = (held[of][0], held[of][1] + sums)
                else:
                    held[of] = (one.select(side), sums)
                if len(held) == 64:
                    yield from folded(held)
                    held = {}
        yield from folded(held)

    def folded(held):
        for of, sums in held.values():
            yield pa.RecordBatch.from_arrays([*of.columns, pa.array([sums], pa.list_(pa.float64()))], names=[*side, "sums"])

    sums = dealt.mapInArrow(draw, StructType([*dealt.select(*side).schema.fields, StructField("sums", ArrayType(DoubleType()))]))
    at = lambda x, c: F.when(F.col("side") == x, F.col(c))
    by_draw = sums.select(*side, F.posexplode("sums").alias("draw", "s")).groupBy(*keys, "draw").agg(F.sum(at(1, "s")).alias("a"), F.sum(at(2, "s")).alias("b"))
    plain = sizes.groupBy(*keys).agg(*[F.max(at(x, c)).alias(f"{c}{x}") for x in (1, 2) for c in ("mean", "total")])
    both = null_safe(by_draw, plain, keys, "inner").filter("total1 IS NOT NULL AND total2 IS NOT NULL")
    ratio = S.ratio(F.col("a") / F.col("total1"), F.col("b") / F.col("total2"))
    out = both.groupBy(*keys).agg(F.first(S.ratio(F.col("mean1"), F.col("mean2"))).alias("ratio"), F.array_sort(F.collect_list(ratio)).alias("r"))
    return out.select(*keys, "ratio", F.get("r", F.lit(int(0.025 * draws))).alias("ci_low"), F.get("r", F.lit(int(0.975 * draws) - 1)).alias("ci_high"))


def _share_of_block(tree: int, block: int, held: list[int], draws: int) -> np.ndarray:
    """How many of each draw's repeats fall into the block; ``held`` are the repeats of its nodes, from the leaf up to the root."""
    left = np.full(draws, held[-1], dtype=np.int64)
    for level in range(len(held) - 2, -1, -1):
        right = (block >> level) & 1
        first = held[level + 1] - held[level] if right else held[level]
        taken = np.random.default_rng([tree, level, block >> level + 1]).binomial(left, first / held[level + 1])
        left = left - taken if right else taken
    return left


def _drawn_sums(values: np.ndarray, drawn: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """For each entry of ``drawn``, the sum of so many values taken with replacement."""
    return np.array([values.take(rng.integers(0, len(values), m)).sum() for m in drawn.tolist()])


# --- baselines and speedups ------------------------------------------------------------------------------------------------


def speedup_vs_baseline(df: DataFrame, match_on: list[str], metric: str, is_baseline: Column, variant: list[str]) -> DataFrame:
    """Median and best speedup of every variant over the baseline of the same cell; null without one.

    Ordered by the match keys but the last, then the speedup, descending.
    """
    base = quantiles(df.filter(is_baseline), match_on, {"x": F.col(metric)}, {"x": [("baseline", 0.5)]})
    rest, keys = df.filter(~F.coalesce(is_baseline, F.lit(False))), [*match_on, *variant]
    other = with_quantiles(rest.groupBy(*keys).agg(F.min(metric).alias("best"), F.count(metric).alias("n_repeats")), rest, keys, {"x": F.col(metric)}, {"x": [("median", 0.5)]})
    out = null_safe(other, base, match_on, "left")
    out = out.withColumns({"speedup_median": S.ratio(F.col("baseline"), F.col("median")), "speedup_best": S.ratio(F.col("baseline"), F.col("best"))})
    return out.orderBy(*match_on[:-1], F.col("speedup_median").desc_nulls_last())


def baseline_of(kind: str = "baseline", variant: str | None = None, dual_backend: str = "baseline_annotate") -> Column:
    """Rows that are a baseline: of the given kind (and variant), or the dual-device run of the baseline's own backend."""
    single = F.col("kind") == kind
    if variant is not None:
        single = single & (F.col("variant") == variant)
    return F.coalesce(single, F.lit(False)) | F.coalesce((F.col("kind") == "dual_gpu") & (F.col("backend") == dual_backend), F.lit(False))


def significant_speedup(df: DataFrame, match_on: list[str], metric: str, is_baseline: Column, variant: list[str], last: int = 30) -> DataFrame:
    """Speedup of means with bounds from the interval ends; significant where the intervals do not overlap."""
    base = with_intervals(df.filter(is_baseline), match_on, metric, last).select(*match_on, *[F.col(f"{metric}_{c}").alias(f"baseline_{c}") for c in ("mean", "ci_low", "ci_high")])
    other = with_intervals(df.filter(~F.coalesce(is_baseline, F.lit(False))), [*match_on, *variant], metric, last)
    j = null_safe(other, base, match_on, "left")
    v = lambda c: F.col(f"{metric}_{c}")
    b = lambda c: F.col(f"baseline_{c}")
    return j.select(
        *match_on, *variant, b("mean").alias("baseline_mean"), v("mean").alias("variant_mean"),
        S.ratio(b("mean"), v("mean")).alias("speedup_mean"), S.ratio(b("ci_low"), v("ci_high")).alias("speedup_ci_low"), S.ratio(b("ci_high"), v("ci_low")).alias("speedup_ci_high"),
        (v("ci_high") < b("ci_low")).alias("is_significant"),
    )


def matched_ratio(df: DataFrame, keys: list[str], split: str, top, bottom, value: str, how: str = "inner") -> DataFrame:
    """One row per cell with the mean of ``value`` at two settings of ``split``, and their ratio."""
    at = lambda x: F.avg(F.when(F.col(split) == x, F.col(value)))
    out = df.filter(F.col(split).isin(top, bottom)).groupBy(*keys).agg(at(top).alias("top"), at(bottom).alias("bottom"))
    if how == "inner":
        out = out.filter("top IS NOT NULL AND bottom IS NOT NULL")
    return out.withColumn("ratio", S.ratio(F.col("top"), F.col("bottom")))


def relative_to_row(df: DataFrame, cell: list[str], axis: str, at, value: str) -> DataFrame:
    """Ratio of each row's value to that of the row where ``axis`` equals ``at`` in its cell."""
    w = Window.partitionBy(*cell)
    base = F.max(F.when(F.col(axis) == at, F.col(value))).over(w)
    return df.withColumn("relative", S.ratio(F.col(value), base))


# --- winners --------------------------------------------------------------------------------------------------------------


def best_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a full order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def best_variant(df: DataFrame, match_on: list[str], variant: list[str], metric: str) -> DataFrame:
    """Fastest variant per group by its median; ties by name."""
    keys = [*match_on, *variant]
    medians = with_quantiles(df.select(*keys).distinct(), df, keys, {"x": F.col(metric)}, {"x": [(metric, 0.5)]})
    return best_rows(medians, match_on, [F.col(metric).asc_nulls_last(), *map(F.col, variant)])


def worker_knee(df: DataFrame, keys: list[str], workers: str, metric: str, extra: list[str]) -> DataFrame:
    """Worker count of the fastest row per group; ties to fewer workers."""
    return best_rows(df.filter(F.col(metric).isNotNull()), keys, [F.col(metric), F.col(workers)]).select(*keys, workers, metric, *extra)


def elbow(df: DataFrame, keys: list[str], k: str, value: str, within: float = 0.10) -> DataFrame:
    """The smallest ``k`` whose value is within the share of its group's best."""
    best = F.min(value).over(Window.partitionBy(*keys))
    return df.withColumn("__best", best).filter(F.col(value) <= (1 + within) * F.col("__best")).groupBy(*keys).agg(F.min(k).alias(k))


def optimal_configurations(df: DataFrame, keys: list[str], runtime: str, ties: list[str]) -> DataFrame:
    """Fastest row per configuration."""
    return best_rows(df.filter(F.col(runtime).isNotNull()), keys, [F.col(runtime), *map(F.col, ties)])


def best_overall(df: DataFrame, cpus: str, stations: str, runtime: str) -> DataFrame:
    """One row: inside the middle half of CPU counts, most stations, then fastest; all rows if that half is empty."""
    band = df.agg(F.percentile(cpus, 0.25).alias("__low"), F.percentile(cpus, 0.75).alias("__high"))
    marked = df.join(F.broadcast(band)).withColumn("__in", F.col(cpus).between(F.col("__low"), F.col("__high")))
    rest = [F.col(c) for c in df.columns if c not in (cpus, stations, runtime)]
    return marked.orderBy(F.col("__in").desc(), F.col(stations).desc(), F.col(runtime).asc_nulls_last(), F.col(cpus), *rest).limit(1).drop("__low", "__high", "__in")


def find_configuration(df: DataFrame, runtime: str, **fixed) -> DataFrame:
    """The fastest stored row with the given settings."""
    for name, value in fixed.items():
        df = df.filter(F.col(name).eqNullSafe(F.lit(value)))
    return df.orderBy(F.col(runtime).asc_nulls_last()).limit(1)


def best_over_rest(df: DataFrame, keep: list[str], rest: list[str], value: str) -> DataFrame:
    """Means per cell, then the best cell over all parameters that are not kept."""
    cells = df.groupBy(*keep, *rest).agg(F.avg(value).alias(value))
    return best_rows(cells, keep, [F.col(value).asc_nulls_last(), *map(F.col, rest)])


def lookup_winners(requests: DataFrame, winners: DataFrame, keys: list[str]) -> DataFrame:
    """Winner of each request; raises, when run, on a request without one."""
    j = requests.join(winners, keys, "left")
    named = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    added = [c for c in winners.columns if c not in keys]
    return j.withColumn(added[0], F.when(F.col(added[0]).isNull(), F.raise_error(F.concat(F.lit("no winner for "), named)).cast(winners.schema[added[0]].dataType)).otherwise(F.col(added[0])))


# --- plans, skipping, merging ------------------------------------------------------------------------------------------------


def legacy_aliases() -> list[tuple[Column, dict[str, Column]]]:
    """Rows of older logs, and the columns under which they also count as done.

    Two-device rows without workers of their own were what is now called serial; CPU sweeps that kept only the resolved
    number of threads had asked for the automatic one, -1.
    """
    serial = (F.col("kind") == "dual_gpu") & ~F.col("backend").eqNullSafe("baseline_annotate") & (F.coalesce("n_cpu_workers_per_gpu", F.lit(-1)) == -1)
    resolved = (F.col("kind") == "cpu_worker_sweep") & F.col("device").startswith("cpu") & F.col("infer_num_threads_actual").isNull() & (F.col("infer_num_threads") > 0)
    return [(serial, {"kind": F.lit("dual_gpu_serial")}), (resolved, {"infer_num_threads": F.lit(-1)})]


def completed_cells(log: DataFrame, keys: list[str], retry_errors: bool = False, aliases: list[tuple[Column, dict[str, Column]]] | None = None) -> DataFrame:
    """The distinct ``keys`` that count as done: environment rows do not, errors only where they are not retried.

    A row that meets the condition of an alias counts under the alias' values too.
    """
    rows = log.filter(~F.col("kind").eqNullSafe("env"))
    if retry_errors:
        rows = rows.filter(~F.col("kind").eqNullSafe("error"))
    own = F.struct(*keys)
    others = [F.when(condition, F.struct(*[values[k].cast(dict(log.dtypes)[k]).alias(k) if k in values else F.col(k) for k in keys])) for condition, values in aliases or []]
    return rows.select(F.inline(F.array_compact(F.array(own, *others)))).distinct()


def remaining(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned trials without a finished one; null axes compare equal."""
    return null_safe(plan, done.select(*keys).distinct(), keys, "left_anti")


def not_nearly_tested(plan: DataFrame, tested: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Planned trials unless one with the same keys was tested within max(2, 5 %) of the value.

    Values are dealt by a scale on which that distance is one step at most: halves up to 40, logarithms above.
    """
    step = lambda v: F.floor(F.when(v <= 40, v / 2).otherwise(20 + F.log(v / 40) / 0.06)).cast("long")
    a = plan.withColumn("__step", step(F.col(value))).alias("a")
    near = tested.select(*keys, value).distinct().withColumn("__step", step(F.col(value)))
    b = near.withColumn("__step", F.explode(F.array(*[F.col("__step") + i for i in (-1, 0, 1)]))).alias("b")
    on = F.abs(F.col(f"a.{value}") - F.col(f"b.{value}")) <= F.greatest(F.lit(2), F.floor(F.col(f"a.{value}") * 0.05))
    for k in (*keys, "__step"):
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, on, "left_anti").drop("__step")


def capped_redundant(trials: DataFrame, keys: list[str], requested: str, achieved: str) -> DataFrame:
    """Trials that ask for more than a sibling that already stopped at a cap, and at least what it achieved."""
    capped = trials.filter(F.col(achieved) < F.col(requested)).groupBy(*keys).agg(F.min(F.struct(requested, achieved)).alias("__c"))
    j = trials.join(capped, keys)
    return j.filter((F.col(requested) > F.col(f"__c.{requested}")) & (F.col(requested) >= F.col(f"__c.{achieved}"))).drop("__c")


def missing_cells(results: DataFrame, axes: dict[str, list]) -> DataFrame:
    """Cells of the grid of all axis values without a result."""
    spark = results.sparkSession
    grid = spark.range(1)
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.drop("id").join(results.select(*axes).distinct(), list(axes), "left_anti")


def merge_by_priority(sources: list[DataFrame], keys: list[str], ties: list[str]) -> DataFrame:
    """Rows of all sources, one per key: of the first source that has it."""
    tagged = [s.withColumn("__p", F.lit(i)) for i, s in enumerate(sources)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t, allowMissingColumns=True)
    return best_rows(both, keys, [F.col("__p"), *map(F.col, ties)]).drop("__p")


def same_inventory(df: DataFrame, chunk: str, station: str) -> DataFrame:
    """One row: number of chunks, of distinct station lists, and whether they are all equal.

    A list is compared by an order-free digest of its distinct stations, so no chunk's list is gathered.
    """
    per = df.select(chunk, station).distinct().groupBy(chunk).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(station).cast("decimal(38,0)")).alias("h"))
    return per.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("n", "h").alias("n_lists")).withColumn("same", F.col("n_lists") <= 1)


def reduced_vs_full(df: DataFrame, cell: list[str], dtype: str, f1: str, picks: str, full: str = "fp32") -> DataFrame:
    """F1 change of each reduced row against the full one of its cell, with a status."""
    base = df.filter(F.col(dtype) == full).groupBy(*cell).agg(F.max(f1).alias("full_f1"))
    j = df.filter(F.col(dtype) != full).join(base, cell, "left")
    status = F.when(F.col("full_f1").isNull(), "unsupported").when(F.coalesce(F.col(picks), F.lit(0)) == 0, "no_picks").when(~S.is_finite(F.col(f1)), "invalid").otherwise("valid")
    return j.withColumns({"status": status, "delta_f1": F.when(status == "valid", F.col(f1) - F.col("full_f1"))})


# --- tables and audits ---------------------------------------------------------------------------------------------------------


def pivot_table(df: DataFrame, rows: list[str], column: str, values: list, value: str, agg: Callable[[str], Column] = F.avg) -> DataFrame:
    """Rows by the values of a column; one conditional aggregate per value."""
    return df.groupBy(*rows).agg(*[agg(F.when(F.col(column) == v, F.col(value))).alias(f"{column}_{v}") for v in values])


def progress(df: DataFrame, family: str, method: str, status: str, states: list[str]) -> DataFrame:
    """Status counts per family and method, with sub-totals and a grand total (nulls in the keys)."""
    return df.rollup(family, method).agg(*[F.count_if(F.col(status) == s).alias(s) for s in states], F.count(F.lit(1)).alias("total"))


def recent_completions(df: DataFrame, family: str, at: str, now: Column, hours: float = 1.0) -> DataFrame:
    recent = F.unix_micros(F.col(at)) > F.unix_micros(now) - int(hours * 3600e6)
    return df.groupBy(family).agg(F.count(F.lit(1)).alias("done"), F.count_if(recent).alias("recent"))


def unstable(df: DataFrame, keys: list[str], value: str, percent: float = 8.0, least: int = 3) -> DataFrame:
    """Groups whose coefficient of variation is above the limit with enough repeats."""
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (S.ratio(F.stddev_pop(value), F.avg(value)) * 100).alias("cv"))
    return out.filter((F.col("n") >= least) & (F.col("cv") > percent))


def cold_and_warm(df: DataFrame, keys: list[str], index: str, value: str, idle: str) -> DataFrame:
    """First feed apart; summary of the others; idle total."""
    warm = F.when(F.col(index) > 0, F.col(value))
    return df.groupBy(*keys).agg(
        F.max(F.when(F.col(index) == 0, F.col(value))).alias("cold"), F.avg(warm).alias("warm_mean"), F.min(warm).alias("warm_min"),
        F.max(warm).alias("warm_max"), st.spread(warm).alias("warm_std"), F.sum(idle).alias("idle_total"),
    )


def tails(df: DataFrame, keys: list[str], value: str, method: str = "nearest", deadlines: tuple[float, ...] = (10.0, 60.0)) -> DataFrame:
    """Upper percentiles of pooled samples by a rank rule, the maximum and the misses of each deadline.

    Values are counted, then dealt by ranges of (keys, value); the one at a rank follows from sums of ranges and sums
    within a range, so a busy group spreads over tasks.
    """
    x = F.col(value)
    plain = df.groupBy(*keys).agg(F.count(x).alias("n"), F.max(x).alias("max"), *[F.count_if(x > d).alias(f"over_{d:g}") for d in deadlines])
    counts = df.filter(x.isNotNull()).groupBy(*keys, x.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    dealt = materialised(counts.repartitionByRange(*keys, "__v").withColumn("__range", F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys, "__range").agg(F.sum("__n").alias("__sum")).withColumn("__offset", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)))
    inside = Window.partitionBy(*keys, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("__inside", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    rows = null_safe(null_safe(rows, sums, [*keys, "__range"], "inner"), plain.select(*keys, "n"), keys, "inner").withColumn("__before", F.col("__offset") + F.col("__inside"))

    def at(q: float) -> Column:
        rank = st.rank_of(F.col("n"), q, method)
        return F.max(F.when((F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__n")), F.col("__v")))

    found = rows.groupBy(*keys).agg(*[at(q / 100).alias(f"p{q}") for q in (90, 95, 99)])
    return null_safe(plain, found, keys, "left").select(*keys, "n", "p90", "p95", "p99", "max", *[f"over_{d:g}" for d in deadlines])


def latency_block(df: DataFrame, keys: list[str], ready: str, queued: str, returned: str) -> DataFrame:
    """Interpolated percentiles of finish - ready, start - ready and service, pooled over repeats."""
    parts = {"e2e": F.col(returned) - F.col(ready), "queue": F.col(queued) - F.col(ready), "service": F.col(returned) - F.col(queued)}
    aggs = [F.count(F.lit(1)).alias("n")]
    for name, x in parts.items():
        aggs += [F.min(x).alias(f"{name}_min"), F.avg(x).alias(f"{name}_mean"), F.max(x).alias(f"{name}_max")]
    return with_quantiles(df.groupBy(*keys).agg(*aggs), df, keys, parts, {name: [(f"{name}_p{q}", q / 100) for q in (50, 90, 95, 99)] for name in parts})


def arrival_percentiles(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Count, extremes, mean and interpolated percentiles."""
    plain = df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    return with_quantiles(plain, df, keys, {"x": value}, {"x": [(f"p{q}", q / 100) for q in (50, 90, 95, 99)]})


def summary_record(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, median, quartiles and extremes."""
    x = F.col(value)
    plain = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))
    return with_quantiles(plain, df, keys, {"x": x}, {"x": [("median", 0.5), ("q25", 0.25), ("q75", 0.75)]})


def check_stored(df: DataFrame, keys: list[str], value: str, stored: str, q: float = 0.95, tolerance: float = 1e-10) -> DataFrame:
    """Recomputed percentile beside the stored one, and whether they agree."""
    plain = df.groupBy(*keys).agg(F.count(value).alias("n"), F.max(stored).alias("stored"))
    out = with_quantiles(plain, df, keys, {"x": F.col(value)}, {"x": [("recomputed", q)]})
    return out.withColumn("agrees", F.abs(F.col("recomputed") - F.col("stored")) <= tolerance)


def makespan(df: DataFrame, keys: list[str], queued: str, returned: str, workers: int, ready: str) -> DataFrame:
    """Makespan from first ready and compute span from first queued to last returned, busy seconds, and the idle share of all workers in both."""
    busy = F.sum(F.col(returned) - F.col(queued))
    out = df.groupBy(*keys).agg((F.max(returned) - F.min(ready)).alias("makespan"), F.greatest(F.max(returned) - F.min(queued), F.lit(0.0)).alias("compute_span"), busy.alias("busy"), F.count(F.lit(1)).alias("n_tasks"))
    idle = lambda span: F.when(F.col(span) > 0, F.greatest(F.lit(0.0), 1 - F.col("busy") / (workers * F.col(span))))
    return out.withColumns({"idle_share": idle("makespan"), "idle_compute": idle("compute_span")})


def stations_per_chunk(df: DataFrame, keys: list[str], ready: str, chunk_s: float = 60.0) -> DataFrame:
    """How many stations became ready in each chunk of time."""
    return df.groupBy(*keys, S.chunk_index(F.col(ready), chunk_s).alias("ready_chunk")).agg(F.count(F.lit(1)).alias("n_stations"))


def soak_tails(df: DataFrame, keys: list[str], index: str, value: str, late: str, deadlines: tuple[float, ...] = (10.0, 60.0)) -> DataFrame:
    """Tails of a paced soak by rounded ranks, without each stream's first feed, with mean, median and lateness (null counts as 0)."""
    rows = df.filter(F.col(index) != 0)
    held = F.coalesce(F.col(late), F.lit(0.0))
    plain = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.avg(held).alias("late_mean"), F.max(held).alias("late_max"), F.count_if(held > 0).alias("late_nonzero"))
    plain = with_quantiles(plain, rows, keys, {"x": F.col(value)}, {"x": [("median", 0.5)]})
    return null_safe(tails(rows, keys, value, "half_even", deadlines), plain, keys, "left")


def run_spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), st.spread(F.col(value)).alias("std"), F.count(value).alias("n_runs"))


def device_difference(df: DataFrame, keys: list[str], run: str, device: str, pair: tuple[str, str], value: str) -> DataFrame:
    """Mean absolute difference between two devices over runs that have both."""
    wide = pivot_table(df, [*keys, run], device, list(pair), value)
    a, b = (F.col(f"{device}_{p}") for p in pair)
    return wide.filter(a.isNotNull() & b.isNotNull()).groupBy(*keys).agg(F.avg(F.abs(a - b)).alias("mean_abs_diff"), F.count(F.lit(1)).alias("n_runs"))


def device_spread(df: DataFrame, keys: list[str], device: str, values: list[str]) -> DataFrame:
    """Row counts by device, and the largest less the smallest that is not zero."""
    wide = df.groupBy(*keys).agg(*[F.count_if(F.col(device) == v).alias(f"n_{v}") for v in values])
    some = [F.when(F.col(f"n_{v}") > 0, F.col(f"n_{v}")) for v in values]
    return wide.withColumn("spread", F.coalesce(F.greatest(*some) - F.least(*some), F.lit(0)))


def stage_report(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    plain = df.groupBy(*keys).agg(F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))
    return with_quantiles(plain, df, keys, {"x": F.col(value)}, {"x": [("median", 0.5)]})


def stage_timings(df: DataFrame, keys: list[str], stages: list[str]) -> DataFrame:
    """Mean and sum of each stage; nulls ignored, 0 when there is none."""
    aggs = []
    for s in stages:
        aggs += [F.coalesce(F.avg(s), F.lit(0.0)).alias(f"{s}_avg"), F.coalesce(F.sum(s), F.lit(0.0)).alias(f"{s}_sum")]
    return df.groupBy(*keys).agg(*aggs)


def delay_summary(df: DataFrame, keys: list[str], ready: str, chunk_s: float = 60.0) -> DataFrame:
    r = F.col(ready)
    return df.groupBy(*keys).agg(
        F.count(r).alias("n_stations"), F.count_if(r > 0).alias("n_delayed"), F.count_if(r <= 0).alias("n_ready"), F.count_if(r >= chunk_s).alias("n_spill"),
        F.min(r).alias("delay_min"), F.max(r).alias("delay_max"), F.avg(r).alias("delay_mean"), F.count_distinct(S.chunk_index(r, chunk_s)).alias("n_chunks_touched"),
    )


def device_energy(df: DataFrame, keys: list[str], t: str, power: str, others: dict[str, str]) -> DataFrame:
    """Mean and peak of the given columns, and energy by the trapezoid rule over a device's samples."""
    rows = carried(dealt(df, keys, [t]), keys, [t], previous={"__p": F.col(power), "__u": F.col(t)})
    rows = rows.withColumn("__e", 0.5 * (F.col(power) + F.col("__p")) * (F.col(t) - F.col("__u")))
    return rows.groupBy(*keys).agg(F.coalesce(F.sum("__e"), F.lit(0.0)).alias("energy"), *[f(c).alias(f"{n}_{c}") for c in others for n, f in (("mean", F.avg), ("max", F.max))])


def resource_rollup(df: DataFrame, keys: list[str], t: str, cpu: str, counter: str, wrap: float) -> DataFrame:
    """CPU seconds and share of the wall clock, and a counter's gain with at most one wrap between samples."""
    rows = carried(dealt(df, keys, [t]), keys, [t], previous={"__p": F.col(counter)})
    gain = F.col(counter) - F.col("__p")
    rows = rows.withColumn("__g", F.when(gain < 0, gain + wrap).otherwise(gain))
    wall = F.max(t) - F.min(t)
    used = F.max(cpu) - F.min(cpu)
    return rows.groupBy(*keys).agg(wall.alias("wall"), used.alias("cpu_s"), S.ratio(used, wall).alias("cpu_share"), F.coalesce(F.sum("__g"), F.lit(0.0)).alias("gain"))


def resource_usage(df: DataFrame, keys: list[str], process: str, t: str, cores: int, wrap: float) -> DataFrame:
    """Use of a run from samples of its processes and its device, one row per run.

    ``df`` has ``cpu_user, cpu_system`` (seconds so far), ``read_bytes, write_bytes`` (so far), ``util`` (percent),
    ``power`` (watts) and ``energy`` (a counter in joules that starts anew at ``wrap``; null where there is none).  A
    process counts with its last sample.  Without an energy counter energy is the mean power over the wall clock.
    """
    counters = ("cpu_user", "cpu_system", "read_bytes", "write_bytes")
    last = df.groupBy(*keys, process).agg(F.max(F.struct(t, *counters)).alias("l")).groupBy(*keys).agg(*[F.sum(f"l.{c}").alias(c) for c in counters])
    counted = carried(dealt(df.filter("energy IS NOT NULL").select(*keys, t, "energy"), keys, [t, "energy"]), keys, [t, "energy"], previous={"__p": F.col("energy")})
    gain = F.col("energy") - F.col("__p")
    joules = counted.groupBy(*keys).agg(F.sum(F.when(gain < 0, gain + wrap).otherwise(gain)).alias("counted"))
    spans = df.groupBy(*keys).agg(
        (F.max(t) - F.min(t)).alias("wall_s"), F.avg("util").alias("util_mean"), F.max("util").alias("util_max"), F.avg("power").alias("power_mean"), F.max("power").alias("power_max")
    )
    out = null_safe(null_safe(spans, last, keys, "left"), joules, keys, "left")
    share = S.ratio(F.col("cpu_user") + F.col("cpu_system"), F.col("wall_s") * cores)
    return out.select(
        *keys, "wall_s", F.col("cpu_user").alias("cpu_user_s"), F.col("cpu_system").alias("cpu_system_s"), share.alias("cpu_share"), (F.col("read_bytes") / 1e6).alias("read_mb"),
        (F.col("write_bytes") / 1e6).alias("write_mb"), "util_mean", "util_max", "power_mean", "power_max", F.greatest(F.coalesce("counted", F.col("power_mean") * F.col("wall_s")), F.lit(0.0)).alias("energy_j"),
    )


def memory_delta(df: DataFrame, keys: list[str], when: str, before: str, after: str, value: str) -> DataFrame:
    at = lambda x: F.max(F.when(F.col(when) == x, F.col(value)))
    return df.groupBy(*keys).agg(at(before).alias("before"), at(after).alias("after")).withColumn("growth", F.col("after") - F.col("before"))


def requested_vs_actual(df: DataFrame, requested: str, actual: str, base: str) -> DataFrame:
    """Overhead, utilisation in percent and growth not below zero; null where nothing was requested."""
    req, act = F.col(requested), F.col(actual)
    some = req > 0
    return df.withColumns({
        "overhead": F.when(some, act - req), "utilisation": F.when(some, 100 * act / req), "growth": F.greatest(act - F.col(base), F.lit(0.0)),
    })
