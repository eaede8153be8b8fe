"""Matching of picks: tolerance joins with a greedy order, pick-set comparison, station names.

Greedy matching depends on order, but picks farther apart than the tolerance never meet.  Picks of a station are cut
into runs without a wider gap; the greedy rule folds over a short run inside the JVM, and long runs are settled by
stretches of time (``dense``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeframe.functions.scalars import let
from quakeframe.operators.dense import pair_up
from quakeframe.operators.runs import short_and_long, with_runs


def match_picks(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float, order: str = "sample", value: str = "sample") -> DataFrame:
    """Pair each pick of ``a`` in turn with the nearest unused pick of ``b`` within the tolerance, inclusive.

    Both hold ``keys`` and ``value``.  ``a`` is taken by ``order``, then value; ties of distance go to the earlier pick of
    ``b``.  Returns ``keys, a_value, b_value, side``: ``pair``, ``a`` (unmatched) or ``b`` (unmatched).  Null values
    and keys take no part.
    """
    # a column named after another side's order is unknown in b; only a's order matters
    left = a.select(*keys, F.col(value).cast("double").alias("v"), F.col(order).cast("double").alias("o"), F.lit(True).alias("is_a"))
    right = b.select(*keys, F.col(value).cast("double").alias("v"), F.lit(None).cast("double").alias("o"), F.lit(False).alias("is_a"))
    both = left.unionByName(right).filter(F.col("v").isNotNull())
    for k in keys:
        both = both.filter(F.col(k).isNotNull())
    short, long = short_and_long(with_runs(both, keys, "v", tolerance), keys)
    grouped = short.groupBy(*keys, "run").agg(
        F.array_sort(F.collect_list(F.when(F.col("is_a"), F.struct("o", "v")))).alias("a"),
        F.array_sort(F.collect_list(F.when(~F.col("is_a"), F.col("v")))).alias("b"),
    )
    folded = grouped.select(*keys, F.inline(_fold(F.col("a"), F.col("b"), tolerance)))
    if long is None:
        return folded
    far = F.isnan("v") | (F.abs("v") == float("inf"))  # within reach of nothing
    alone = long.filter(far).select(*keys, F.when(F.col("is_a"), F.col("v")).alias("a_value"), F.when(~F.col("is_a"), F.col("v")).alias("b_value"), F.when(F.col("is_a"), "a").otherwise("b").alias("side"))
    paired = pair_up(long.filter(~far).withColumn("w", F.lit(None).cast("double")), [*keys, "run"], tolerance)
    return folded.unionByName(alone).unionByName(paired.select(*keys, F.col("a_v").alias("a_value"), F.col("b_v").alias("b_value"), "side"))


def _fold(a: Column, b: Column, tolerance: float) -> Column:
    """Array of ``a_value, b_value, side`` of one run."""
    return let(F.transform(b, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda indexed: _fold_indexed(a, indexed, tolerance))


def _fold_indexed(a: Column, indexed: Column, tolerance: float) -> Column:
    def step(acc: Column, x: Column) -> Column:
        near = F.filter(indexed, lambda y: (F.abs(y["v"] - x["v"]) <= tolerance) & ~F.array_contains(acc["used"], y["i"]))
        return let(F.array_min(F.transform(near, lambda y: F.struct(F.abs(y["v"] - x["v"]).alias("d"), y["i"].alias("i"), y["v"].alias("v")))), lambda best: grown(acc, x, best))

    def grown(acc: Column, x: Column, best: Column) -> Column:
        row = F.struct(x["v"].alias("a_value"), best["v"].alias("b_value"), F.when(best.isNull(), "a").otherwise("pair").alias("side"))
        return F.struct(
            F.when(best.isNull(), acc["used"]).otherwise(F.array_append(acc["used"], best["i"])).alias("used"),
            F.array_append(acc["rows"], row).alias("rows"),
        )

    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<a_value:double,b_value:double,side:string>>").alias("rows"))

    def left_over(used: Column) -> Column:
        free = F.filter(indexed, lambda y: ~F.array_contains(used, y["i"]))
        return F.transform(free, lambda y: F.struct(F.lit(None).cast("double").alias("a_value"), y["v"].alias("b_value"), F.lit("b").alias("side")))

    return let(F.aggregate(a, start, step), lambda done: F.concat(done["rows"], left_over(done["used"])))


def compare_pick_sets(catalog: DataFrame, detected: DataFrame, tolerance: float, keys: list[str] | None = None) -> DataFrame:
    """``station, phase, kind, delta`` of every pick: matched (delta = detected - catalog), missing, additional, duplicated.

    A detection that is unmatched but near a catalog pick is a duplicate.  Detections where the catalog has no pick
    of that station and phase are left out, as in the reference semantics.
    """
    keys = keys or ["station", "phase"]
    known = detected.join(catalog.select(*keys).distinct(), keys, "left_semi")
    sides = match_picks(catalog, known, keys, tolerance)
    extra = sides.filter("side = 'b'").withColumn("bucket", F.floor(F.col("b_value") / tolerance))
    # equi-join on neighbouring buckets instead of a range join
    near = catalog.select(*keys, F.col("sample").cast("double").alias("c")).withColumn("bucket", F.explode(F.array(*[F.floor(F.col("c") / tolerance) + i for i in (-1, 0, 1)])))
    hits = extra.join(near, [*keys, "bucket"]).filter(F.abs(F.col("b_value") - F.col("c")) <= tolerance).select(*keys, "b_value").distinct().withColumn("dup", F.lit(True))
    judged = extra.drop("bucket").join(hits, [*keys, "b_value"], "left").select(*keys, F.when(F.col("dup"), "duplicated").otherwise("additional").alias("kind"), F.lit(None).cast("double").alias("delta"))
    others = sides.filter("side != 'b'").select(*keys, F.when(F.col("side") == "pair", "matched").otherwise("missing").alias("kind"), (F.col("b_value") - F.col("a_value")).alias("delta"))
    return others.unionByName(judged)


def first_hits(catalog: DataFrame, detected: DataFrame, key: str, tolerance: float) -> DataFrame:
    """One row per key of a single catalog pick against a list, in list order: the first hit matches, others duplicate.

    ``catalog`` has ``key, catalog`` (null: no pick), ``detected`` has ``key, pos, sample``.
    """
    d = F.col("sample") - F.col("catalog")
    hit = F.col("catalog").isNotNull() & (F.abs(d) <= tolerance)
    rows = catalog.join(detected, key, "left")
    out = rows.groupBy(key, "catalog").agg(
        F.count("sample").alias("n_detected"),
        F.count_if(hit).alias("n_hits"),
        F.min(F.when(hit, F.struct("pos", d.alias("delta"))))["delta"].alias("delta"),
    )
    some = F.col("catalog").isNotNull().cast("int")
    matched = F.least(F.lit(1), F.col("n_hits")).cast("int")
    return out.select(
        key,
        some.alias("n_catalog"),
        F.col("n_detected").cast("int").alias("n_detected"),
        matched.alias("n_matched"),
        (some - matched).alias("n_missing"),
        (F.col("n_detected") - F.col("n_hits")).cast("int").alias("n_additional"),
        F.greatest(F.col("n_hits") - 1, F.lit(0)).cast("int").alias("n_duplicates"),
        "delta",
    )


def station_keys(trace_id: Column) -> Column:
    """All names a trace may be asked for by: station, NET_STA, NET.STA, second token, pieces; upper-cased."""
    parts = F.split(F.upper(trace_id), r"\.")
    net, sta = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))
    return F.array_distinct(F.filter(F.concat(F.array(sta, F.concat_ws("_", net, sta), F.concat_ws(".", net, sta)), F.split(sta, "[-_]")), lambda x: x.isNotNull() & (x != "")))


def match_stations(traces: DataFrame, stations: DataFrame) -> DataFrame:
    """``trace_id, station``: traces of each station by any of their names; an equi-join over exploded names."""
    named = traces.select("trace_id", F.explode(station_keys(F.col("trace_id"))).alias("name"))
    wanted = stations.select("station", F.upper("station").alias("name"))
    return named.join(wanted, "name").select("trace_id", "station").dropDuplicates()


def agreement(picks: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """``method_a, method_b, pct``: how often two methods' deltas on the same trace lie within the tolerance; 100 with itself."""
    a, b = picks.alias("a"), picks.alias("b")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, on).groupBy(F.col("a.method").alias("method_a"), F.col("b.method").alias("method_b")).agg((F.avg((F.abs(F.col("a.delta") - F.col("b.delta")) <= tolerance).cast("double")) * 100).alias("pct"))
