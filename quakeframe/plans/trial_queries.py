"""Queries over benchmark trials and station events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quakeframe.functions import scalars as S
from quakeframe.functions import statistics as st
from quakeframe.operators import trials as T
from quakeframe.plans.stand_ins import STATION_EVENTS, TRIALS, rounded, station_events, table, trials

CELL = ["model", "n_stations", "device"]


def baseline():
    return F.col("kind") == "baseline"


def collapse(spark, sf_dir):
    return rounded(T.collapse_repeats(trials(spark, sf_dir), [*CELL, "variant", "absent"], ["wall_s", "f1"]))


def repeats(spark, sf_dir):
    return rounded(T.summarize_repeats(trials(spark, sf_dir), [*CELL, "variant"], ["wall_s", "cpus"], "success"))


def nested(spark, sf_dir):
    t = trials(spark, sf_dir).withColumn("metrics", F.create_map(F.lit("wall"), F.col("wall_s"), F.lit("f1"), F.col("f1"), F.lit("cpus"), F.col("cpus").cast("double")))
    return rounded(T.summarize_nested(t, ["model", "device"], "metrics"))


def intervals(spark, sf_dir):
    return rounded(T.with_intervals(trials(spark, sf_dir), [*CELL, "variant"], "wall_s"))


def intervals_short_table(spark, sf_dir):
    return rounded(T.with_intervals(trials(spark, sf_dir), [*CELL, "variant", "cpus"], "wall_s", last=9), finer=("wall_s_mean",))


def speedup(spark, sf_dir):
    return rounded(T.speedup_vs_baseline(trials(spark, sf_dir), CELL, "wall_s", baseline(), ["variant"]))


def significant(spark, sf_dir):
    return rounded(T.significant_speedup(trials(spark, sf_dir), CELL, "wall_s", baseline(), ["variant"]))


def precision_ratio(spark, sf_dir):
    return rounded(T.matched_ratio(trials(spark, sf_dir), [*CELL, "cpus"], "dtype", "fp32", "bf16", "wall_s"), finer=("top", "bottom"))


def strategy_ratio(spark, sf_dir):
    return rounded(T.matched_ratio(trials(spark, sf_dir), ["model", "n_stations", "cpus"], "device", "O", "F", "wall_s"))


def scaling_ratio(spark, sf_dir):
    return rounded(T.matched_ratio(trials(spark, sf_dir), ["model", "device", "variant"], "n_stations", 350, 50, "wall_s", how="left"))


def reduced_quality(spark, sf_dir):
    t = trials(spark, sf_dir).groupBy(*CELL, "variant", "dtype").agg(F.max("f1").alias("f1"), F.count(F.when(F.col("success"), 1)).alias("picks"))
    return rounded(T.reduced_vs_full(t, [*CELL, "variant"], "dtype", "f1", "picks"))


def relative(spark, sf_dir):
    t = trials(spark, sf_dir).groupBy(*CELL, "variant").agg(F.avg("wall_s").alias("wall_s"))
    return rounded(T.relative_to_row(t, CELL, "variant", 0, "wall_s"))


def best_variant(spark, sf_dir):
    return rounded(T.best_variant(trials(spark, sf_dir), CELL, ["variant"], "wall_s"))


def knee(spark, sf_dir):
    t = trials(spark, sf_dir).groupBy(*CELL, "cpus").agg(F.min("wall_s").alias("wall_s"), F.max("f1").alias("f1"))
    return rounded(T.worker_knee(t, CELL, "cpus", "wall_s", ["f1"]))


def elbows(spark, sf_dir):
    t = trials(spark, sf_dir).groupBy(*CELL, "cpus").agg(F.avg("wall_s").alias("wall_s"))
    return T.elbow(t, CELL, "cpus", "wall_s")


def optimal(spark, sf_dir):
    t = trials(spark, sf_dir).select("model", "device", "n_stations", "cpus", "wall_s", "repeat", "variant")
    return rounded(T.optimal_configurations(t, ["model", "device", "n_stations", "cpus"], "wall_s", ["repeat", "variant"]))


def overall(spark, sf_dir):
    t = trials(spark, sf_dir).groupBy("cpus", "n_stations").agg(F.min("wall_s").alias("wall_s"))
    return rounded(T.best_overall(t, "cpus", "n_stations", "wall_s"))


def stored_optimum(spark, sf_dir):
    t = trials(spark, sf_dir).groupBy("cpus", "n_stations", "device").agg(F.min("wall_s").alias("wall_s"))
    return rounded(T.find_configuration(t, "wall_s", cpus=20, n_stations=100))


def safe_winners(spark, sf_dir):
    t = trials(spark, sf_dir).filter(S.quality_safe(F.col("dtype"), F.col("f1")) & F.col("success"))
    return rounded(T.best_rows(t.select("model", "device", "cpus", "wall_s", "dtype", "repeat", "variant"), ["model", "device", "cpus"], [F.col("wall_s"), F.col("repeat"), F.col("dtype"), F.col("variant")]))


def over_rest(spark, sf_dir):
    return rounded(T.best_over_rest(trials(spark, sf_dir), ["model", "device"], ["cpus", "variant"], "wall_s"))


def fastest_native(spark, sf_dir):
    t = trials(spark, sf_dir)
    native = T.best_over_rest(t.filter(baseline()), ["model", "device"], ["cpus"], "wall_s").select("model", "device", F.col("wall_s").alias("native"))
    other = T.best_over_rest(t.filter(~baseline()), ["model", "device"], ["cpus"], "wall_s").select("model", "device", F.col("wall_s").alias("orchestrated"))
    return rounded(native.join(other, ["model", "device"]).withColumn("speedup", S.ratio(F.col("native"), F.col("orchestrated"))))


def summary_record(spark, sf_dir):
    return rounded(T.summary_record(trials(spark, sf_dir), ["model", "dtype"], "wall_s"))


def winner_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return T.lookup_winners(o, table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"])


def skip_done(spark, sf_dir):
    plan = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    return T.remaining(plan, table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")), ["k"])


def retry_and_legacy(spark, sf_dir):
    """What is left of a plan when errors are retried, and when they are not; older rows count under their new names."""
    of = lambda x, *names: F.element_at(F.array(*[F.lit(n) for n in names]), (x + 1).cast("int"))
    log = table(spark, sf_dir, "lineitem").select(
        of(F.col("l_suppkey") % 5, "env", "error", "dual_gpu", "cpu_worker_sweep", "single").alias("kind"), F.when(F.col("l_returnflag") == "A", "baseline_annotate").when(F.col("l_returnflag") == "N", "lean").alias("backend"),
        F.when(F.col("l_linenumber") % 2 == 1, F.col("l_linenumber")).alias("n_cpu_workers_per_gpu"), F.when(F.col("l_linestatus") == "O", "cpu").otherwise("gpu").alias("device"),
        F.when(F.col("l_tax") >= 0.04, 1).alias("infer_num_threads_actual"), (F.col("l_partkey") % 400).cast("int").alias("infer_num_threads"), (F.col("l_orderkey") % 50).cast("int").alias("n_stations"),
    )
    plan = table(spark, sf_dir, "part").select(
        "p_partkey", of(F.col("p_partkey") % 4, "dual_gpu_serial", "cpu_worker_sweep", "error", "single").alias("kind"), F.when(F.col("p_size") < 10, "gpu").otherwise("cpu").alias("device"),
        F.when(F.col("p_partkey") % 4 == 1, -1).otherwise(F.col("p_partkey") % 400).cast("int").alias("infer_num_threads"), F.col("p_size").cast("int").alias("n_stations"),
    )
    keys = ["kind", "device", "infer_num_threads", "n_stations"]
    left = [T.remaining(plan, T.completed_cells(log, keys, retry, T.legacy_aliases()), keys).select("p_partkey", F.lit(retry).alias("retry")) for retry in (True, False)]
    return left[0].unionByName(left[1])


def fuzzy_skip(spark, sf_dir):
    plan = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("n"), F.col("p_type").alias("kind"))
    tested = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") * 2).alias("n"), F.when(F.col("s_acctbal") > 5000, "ECONOMY").otherwise("SMALL").alias("kind"))
    return T.not_nearly_tested(plan, tested, ["kind"], "n")


def capped(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("asked"), F.least("l_quantity", F.lit(30.0) + F.col("l_suppkey") % 10).alias("got"))
    return T.capped_redundant(t, ["k"], "asked", "got")


def grid_gaps(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("s"), F.dayofmonth("o_orderdate").alias("m"), (F.col("o_custkey") % 100).cast("int").alias("c"))
    return T.missing_cells(t, {"s": ["F", "O", "P"], "m": list(range(1, 32)), "c": list(range(100))})


def merged_sources(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"), F.lit("orders").alias("src"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit("customer").alias("src"))
    return rounded(T.merge_by_priority([o.filter("v > 300000"), c], ["k"], ["v"]))


def inventory(spark, sf_dir):
    return T.same_inventory(table(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey")


def pivoted(spark, sf_dir):
    return rounded(T.pivot_table(trials(spark, sf_dir), ["model", "device"], "dtype", ["fp32", "bf16", "fp16"], "wall_s"))


def threads_table(spark, sf_dir):
    return rounded(T.pivot_table(trials(spark, sf_dir), ["cpus"], "model", ["A", "N", "R"], "wall_s", F.min))


def progress(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.year("o_orderdate").alias("y"), "o_orderstatus")
    return T.progress(o, "o_orderpriority", "y", "o_orderstatus", ["F", "O", "P"])


def completions(spark, sf_dir):
    e = station_events(spark, sf_dir).withColumn("family", F.pmod(F.col("event_id"), F.lit(7)))
    return T.recent_completions(e, "family", "seen", F.lit("2024-01-30 23:57:12").cast("timestamp"), 240.0)


def audit(spark, sf_dir):
    return rounded(T.unstable(trials(spark, sf_dir), [*CELL, "variant", "cpus"], "wall_s", 20.0), finer=("mean",))


def cold_warm(spark, sf_dir):
    e = station_events(spark, sf_dir).withColumn("feed", F.pmod("event_id", F.lit(10))).withColumn("busy", F.col("returned_s") - F.col("queued_s")).groupBy("station", "feed").agg(F.max("busy").alias("busy"))
    return rounded(T.cold_and_warm(e, ["station"], "feed", "busy", "busy"))


def warm_tails(spark, sf_dir):
    e = station_events(spark, sf_dir).withColumn("late", F.col("returned_s") - F.col("ready_s"))
    return rounded(T.tails(e, ["station"], "late", "nearest", (1.0, 2.0)))


def paced_tails(spark, sf_dir):
    e = station_events(spark, sf_dir).withColumn("late", F.col("returned_s") - F.col("ready_s"))
    e = e.withColumns({"feed_index": F.col("event_id") % 7, "over": F.greatest(F.col("late") - 1.0, F.lit(0.0))})
    return rounded(T.soak_tails(e, ["station"], "feed_index", "late", "over", (1.0, 2.0)))


def latency(spark, sf_dir):
    return rounded(T.latency_block(station_events(spark, sf_dir), ["station"], "ready_s", "queued_s", "returned_s"))


def stored_p95(spark, sf_dir):
    e = station_events(spark, sf_dir).withColumn("late", F.col("returned_s") - F.col("ready_s"))
    # what was stored: right for stations of an even number, 0.5 off for the others
    kept = e.groupBy("station").agg((F.percentile("late", 0.95) + F.substring("station", -1, 1).cast("int") % 2 * 0.5).alias("stored"))
    return rounded(T.check_stored(e.join(kept, "station"), ["station"], "late", "stored"))


def spans(spark, sf_dir):
    return rounded(T.makespan(station_events(spark, sf_dir), ["chunk"], "queued_s", "returned_s", 4, "ready_s"))


def ready_per_chunk(spark, sf_dir):
    return T.stations_per_chunk(station_events(spark, sf_dir), ["chunk"], "ready_s", 60.0)


def run_spread(spark, sf_dir):
    return rounded(T.run_spread(trials(spark, sf_dir).groupBy("model", "device", "cpus").agg(F.avg("f1").alias("f1")), ["model", "device"], "f1"))


def device_difference(spark, sf_dir):
    return rounded(T.device_difference(trials(spark, sf_dir), ["model"], "cpus", "device", ("F", "O"), "wall_s"))


def device_counts(spark, sf_dir):
    return T.device_spread(trials(spark, sf_dir), ["model", "dtype"], "device", ["F", "O"])


def stage_report(spark, sf_dir):
    return rounded(T.stage_report(station_events(spark, sf_dir).withColumn("s", F.col("returned_s") - F.col("queued_s")), ["station"], "s"))


def stage_timings(spark, sf_dir):
    e = station_events(spark, sf_dir).select("station", F.when(F.col("event_id") % 3 == 0, F.col("queued_s")).alias("load"), F.when(F.col("event_id") < 0, F.col("queued_s")).alias("never"))
    return rounded(T.stage_timings(e, ["station"], ["load", "never"]))


def delays(spark, sf_dir):
    e = station_events(spark, sf_dir).withColumn("ready", F.greatest(F.col("ready_s") - 600, F.lit(0.0)))
    return rounded(T.delay_summary(e, ["chunk"], "ready"), finer=("delay_mean",))


def energy(spark, sf_dir):
    e = station_events(spark, sf_dir).groupBy("station", "chunk").agg(F.max("queued_s").alias("t"), F.max("returned_s").alias("power"))
    e = e.withColumn("t", F.col("chunk") * 3600.0 + F.col("t"))
    return rounded(T.device_energy(e, ["station"], "t", "power", {"power": ""}), 3)


def resources(spark, sf_dir):
    e = station_events(spark, sf_dir).select("station", (F.col("chunk") * 3600.0 + F.col("ready_s")).alias("t"), F.col("queued_s").alias("cpu"), (F.col("event_id") % 1000).cast("double").alias("n"))
    return rounded(T.resource_rollup(e, ["station"], "t", "cpu", "n", 1000.0))


def memory(spark, sf_dir):
    return rounded(T.memory_delta(trials(spark, sf_dir), ["model", "cpus"], "device", "F", "O", "wall_s"))


def asked_vs_used(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") - 10).cast("double").alias("asked"), (F.col("p_retailprice") / 50).alias("used"), F.lit(19.0).alias("base"))
    return rounded(T.requested_vs_actual(t, "asked", "used", "base"))


def bootstrap(spark, sf_dir):
    return rounded(T.bootstrap_pooled(trials(spark, sf_dir), ["model", "device"], "wall_s", baseline(), ~baseline(), seed=42))


def throughput(spark, sf_dir):
    t = trials(spark, sf_dir)
    return rounded(t.groupBy("model", "variant").agg(F.avg(S.rate(F.col("n_stations"), F.col("wall_s"))).alias("stations_per_s"), F.max(S.rate(F.col("cpus"), F.col("wall_s"))).alias("best_cpus_per_s")))


def top_speedups(spark, sf_dir):
    t = T.speedup_vs_baseline(trials(spark, sf_dir), CELL, "wall_s", baseline(), ["variant"]).withColumn("speedup_median", F.round("speedup_median", 6))
    return t.orderBy(F.col("speedup_median").desc(), *CELL, "variant").limit(15).select(*CELL, "variant", "speedup_median")


def trial_ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    axes = [F.col("o_custkey"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), F.col("o_orderpriority")]
    return o.select("o_orderkey", S.trial_key(*axes).alias("key"), S.trial_uid(*axes).alias("uid"))


QUERIES = {
    "F12_collapse_repeats": collapse, "F7_repeat_summary": repeats, "F8_nested_summary": nested, "F9_intervals": intervals, "F10_short_table_intervals": intervals_short_table,
    "E6_speedup": speedup, "E7_significant_speedup": significant, "E8_precision_ratio": precision_ratio, "E9_strategy_ratio": strategy_ratio, "F24_scaling_ratio": scaling_ratio,
    "E10_reduced_quality": reduced_quality, "F23_relative_to_row": relative, "F13_best_variant": best_variant, "F14_worker_knee": knee, "F15_elbow": elbows,
    "F16_optimal_configurations": optimal, "F16_best_overall": overall, "F18_stored_optimum": stored_optimum, "F19_safe_winners": safe_winners, "F20_best_over_rest": over_rest,
    "F21_fastest_native": fastest_native, "F22_summary_record": summary_record, "E14_winner_lookup": winner_lookup, "E12_skip_done": skip_done, "E12_retry_and_legacy": retry_and_legacy, "E13_fuzzy_skip": fuzzy_skip,
    "E19_capped": capped, "E16_grid_gaps": grid_gaps, "E17_merged_sources": merged_sources, "E18_inventory": inventory, "F49_pivot": pivoted, "F48_threads_table": threads_table,
    "F31_progress": progress, "F32_completions": completions, "F36_audit": audit, "F33_cold_warm": cold_warm, "F34_warm_tails": warm_tails, "F35_paced_tails": paced_tails,
    "F39_latency": latency, "F40_stored_p95": stored_p95, "F41_makespan": spans, "F41_stations_per_chunk": ready_per_chunk, "F43_run_spread": run_spread, "F43_device_difference": device_difference, "F45_device_counts": device_counts,
    "F56_stage_report": stage_report, "F29_stage_timings": stage_timings, "F37_delays": delays, "F55_energy": energy, "F52_resources": resources, "F53_memory": memory,
    "F54_asked_vs_used": asked_vs_used, "F11_bootstrap": bootstrap, "B8_throughput": throughput, "H3_top_speedups": top_speedups, "B14_trial_ids": trial_ids,
}

W = f"WITH {TRIALS}"
V = f"WITH {STATION_EVENTS}"
_T = "[" + ", ".join(map(str, st.T95)) + "]"


def _ci(last: int, by: str) -> str:
    return f"""s AS (SELECT {by}, count(wall_s) AS n, avg(wall_s) AS mean, stddev_samp(wall_s) AS std FROM trials GROUP BY ALL),
 ci AS (SELECT *, CASE WHEN n > 1 THEN coalesce(CASE WHEN n - 1 <= {last} THEN {_T}[n - 1] END, 1.96)::DOUBLE * std / sqrt(n) END AS half FROM s)"""


def _one(by: str, alias: str) -> str:
    return f"round({by}, 6) AS {alias}"


def _p(x: str, prefix: str) -> str:
    return ", ".join(f"round(quantile_cont({x}, {q / 100}), 6) AS {prefix}_p{q}" for q in (50, 90, 95, 99))


def _lat(x: str, p: str) -> str:
    return f"round(min({x}), 6) AS {p}_min, round(avg({x}), 6) AS {p}_mean, round(max({x}), 6) AS {p}_max, {_p(x, p)}"


def _tails(rank: str) -> str:
    qs = ", ".join(f"round(v[1 + {rank.format(q=q / 100)}], 6) AS p{q}" for q in (90, 95, 99))
    return f"""{V}, s AS (SELECT station, list(returned_s - ready_s ORDER BY returned_s - ready_s) AS v FROM station_events GROUP BY 1)
 SELECT station, len(v)::BIGINT AS n, {qs}, round(v[len(v)], 6) AS max, len(list_filter(v, lambda x: x > 1))::BIGINT AS over_1, len(list_filter(v, lambda x: x > 2))::BIGINT AS over_2 FROM s"""


_RATIO = """{w}, r AS (SELECT {keys}, avg(wall_s) FILTER ({split} = {top}) AS top, avg(wall_s) FILTER ({split} = {bottom}) AS bottom FROM trials WHERE {split} IN ({top}, {bottom}) GROUP BY ALL)
 SELECT {keys}, round(top, 6) AS top, round(bottom, 6) AS bottom, round(top / nullif(bottom, 0), 6) AS ratio FROM r {where}"""

ORACLE_SQL = {
    "F12_collapse_repeats": W + " SELECT model, n_stations, device, variant, " + ", ".join(f"round(median({m}), 6) AS {m}_median, round(min({m}), 6) AS {m}_min, round(max({m}), 6) AS {m}_max, round(stddev_samp({m}), 6) AS {m}_std, count({m}) AS {m}_count" for m in ("wall_s", "f1")) + " FROM trials GROUP BY ALL",
    "F7_repeat_summary": W + ", ok AS (SELECT *, CASE WHEN success THEN wall_s END AS a, CASE WHEN success THEN cpus END AS b FROM trials) SELECT model, n_stations, device, variant, count(*) AS n_repeats, round(avg(success::INTEGER), 6) AS success_rate, round(min(a), 6) AS wall_s_min, round(avg(a), 6) AS wall_s_mean, round(CASE WHEN count(a) = 1 THEN 0 ELSE stddev_samp(a) END, 6) AS wall_s_std, min(b) AS cpus_min, round(avg(b), 6) AS cpus_mean, round(CASE WHEN count(b) = 1 THEN 0 ELSE stddev_samp(b) END, 6) AS cpus_std FROM ok GROUP BY ALL",
    "F8_nested_summary": W + ", l AS (SELECT model, device, unnest(['wall', 'f1', 'cpus']) AS metric, unnest([wall_s, f1, cpus::DOUBLE]) AS value FROM trials) SELECT model, device, metric, round(avg(value), 6) AS mean, round(CASE WHEN count(value) = 1 THEN 0 ELSE stddev_samp(value) END, 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, count(value) AS n FROM l GROUP BY ALL",
    "F9_intervals": f"{W}, {_ci(30, 'model, n_stations, device, variant')} SELECT model, n_stations, device, variant, n AS wall_s_n, round(mean, 6) AS wall_s_mean, round(std, 6) AS wall_s_std, round(mean - coalesce(half, 0), 6) AS wall_s_ci_low, round(mean + coalesce(half, 0), 6) AS wall_s_ci_high, round(half, 6) AS wall_s_ci_half FROM ci",
    "F10_short_table_intervals": f"{W}, {_ci(9, 'model, n_stations, device, variant, cpus')} SELECT model, n_stations, device, variant, cpus, n AS wall_s_n, round(mean, 9) AS wall_s_mean, round(std, 6) AS wall_s_std, round(mean - coalesce(half, 0), 6) AS wall_s_ci_low, round(mean + coalesce(half, 0), 6) AS wall_s_ci_high, round(half, 6) AS wall_s_ci_half FROM ci",
    "E6_speedup": W + ", b AS (SELECT model, n_stations, device, median(wall_s) AS baseline FROM trials WHERE kind = 'baseline' GROUP BY ALL), o AS (SELECT model, n_stations, device, variant, median(wall_s) AS median, min(wall_s) AS best, count(wall_s) AS n_repeats FROM trials WHERE kind <> 'baseline' GROUP BY ALL) SELECT o.model, o.n_stations, o.device, variant, round(median, 6) AS median, round(best, 6) AS best, n_repeats, round(baseline, 6) AS baseline, round(baseline / median, 6) AS speedup_median, round(baseline / best, 6) AS speedup_best FROM o LEFT JOIN b ON o.model IS NOT DISTINCT FROM b.model AND o.n_stations IS NOT DISTINCT FROM b.n_stations AND o.device IS NOT DISTINCT FROM b.device",
    "E7_significant_speedup": f"{W}, {_ci(30, 'model, n_stations, device, kind, variant')}, x AS (SELECT *, mean - coalesce(half, 0) AS lo, mean + coalesce(half, 0) AS hi FROM ci) SELECT o.model, o.n_stations, o.device, o.variant, round(b.mean, 6) AS baseline_mean, round(o.mean, 6) AS variant_mean, round(b.mean / o.mean, 6) AS speedup_mean, round(b.lo / o.hi, 6) AS speedup_ci_low, round(b.hi / o.lo, 6) AS speedup_ci_high, o.hi < b.lo AS is_significant FROM x o LEFT JOIN x b ON b.kind = 'baseline' AND o.model = b.model AND o.n_stations = b.n_stations AND o.device = b.device WHERE o.kind <> 'baseline'",
    "E8_precision_ratio": _RATIO.replace("round(top, 6)", "round(top, 9)").replace("round(bottom, 6)", "round(bottom, 9)").format(w=W, keys="model, n_stations, device, cpus", split="dtype", top="'fp32'", bottom="'bf16'", where="WHERE top IS NOT NULL AND bottom IS NOT NULL"),
    "E9_strategy_ratio": _RATIO.format(w=W, keys="model, n_stations, cpus", split="device", top="'O'", bottom="'F'", where="WHERE top IS NOT NULL AND bottom IS NOT NULL"),
    "F24_scaling_ratio": _RATIO.format(w=W, keys="model, device, variant", split="n_stations", top="350", bottom="50", where=""),
    "E10_reduced_quality": W + ", t AS (SELECT model, n_stations, device, variant, dtype, max(f1) AS f1, count(*) FILTER (success) AS picks FROM trials GROUP BY ALL), b AS (SELECT model, n_stations, device, variant, max(f1) AS full_f1 FROM t WHERE dtype = 'fp32' GROUP BY ALL), j AS (SELECT t.*, full_f1, CASE WHEN full_f1 IS NULL THEN 'unsupported' WHEN picks = 0 THEN 'no_picks' WHEN f1 IS NULL THEN 'invalid' ELSE 'valid' END AS status FROM t LEFT JOIN b ON t.model = b.model AND t.n_stations = b.n_stations AND t.device = b.device AND t.variant = b.variant WHERE dtype <> 'fp32') SELECT model, n_stations, device, variant, dtype, round(f1, 6) AS f1, picks, round(full_f1, 6) AS full_f1, status, CASE WHEN status = 'valid' THEN round(f1 - full_f1, 6) END AS delta_f1 FROM j",
    "F23_relative_to_row": W + ", t AS (SELECT model, n_stations, device, variant, avg(wall_s) AS wall_s FROM trials GROUP BY ALL) SELECT model, n_stations, device, variant, round(wall_s, 6) AS wall_s, round(wall_s / max(CASE WHEN variant = 0 THEN wall_s END) OVER (PARTITION BY model, n_stations, device), 6) AS relative FROM t",
    "F13_best_variant": W + ", t AS (SELECT model, n_stations, device, variant, median(wall_s) AS wall_s FROM trials GROUP BY ALL) SELECT model, n_stations, device, variant, round(wall_s, 6) AS wall_s FROM t QUALIFY row_number() OVER (PARTITION BY model, n_stations, device ORDER BY wall_s, variant) = 1",
    "F14_worker_knee": W + ", t AS (SELECT model, n_stations, device, cpus, min(wall_s) AS wall_s, max(f1) AS f1 FROM trials GROUP BY ALL) SELECT model, n_stations, device, cpus, round(wall_s, 6) AS wall_s, round(f1, 6) AS f1 FROM t QUALIFY row_number() OVER (PARTITION BY model, n_stations, device ORDER BY wall_s, cpus) = 1",
    "F15_elbow": W + ", t AS (SELECT model, n_stations, device, cpus, avg(wall_s) AS wall_s FROM trials GROUP BY ALL), b AS (SELECT *, min(wall_s) OVER (PARTITION BY model, n_stations, device) AS best FROM t) SELECT model, n_stations, device, min(cpus) AS cpus FROM b WHERE wall_s <= 1.1 * best GROUP BY ALL",
    "F16_optimal_configurations": W + " SELECT model, device, n_stations, cpus, round(wall_s, 6) AS wall_s, repeat, variant FROM trials QUALIFY row_number() OVER (PARTITION BY model, device, n_stations, cpus ORDER BY wall_s, repeat, variant) = 1",
    "F16_best_overall": W + ", t AS (SELECT cpus, n_stations, min(wall_s) AS wall_s FROM trials GROUP BY ALL), q AS (SELECT quantile_cont(cpus, 0.25) AS lo, quantile_cont(cpus, 0.75) AS hi FROM t) SELECT cpus, n_stations, round(wall_s, 6) AS wall_s FROM t, q ORDER BY (cpus BETWEEN lo AND hi) DESC, n_stations DESC, wall_s, cpus LIMIT 1",
    "F18_stored_optimum": W + ", t AS (SELECT cpus, n_stations, device, min(wall_s) AS wall_s FROM trials GROUP BY ALL) SELECT cpus, n_stations, device, round(wall_s, 6) AS wall_s FROM t WHERE cpus = 20 AND n_stations = 100 ORDER BY wall_s LIMIT 1",
    "F19_safe_winners": W + " SELECT model, device, cpus, round(wall_s, 6) AS wall_s, dtype, repeat, variant FROM trials WHERE (dtype = 'fp32' OR f1 >= 0.99) AND success QUALIFY row_number() OVER (PARTITION BY model, device, cpus ORDER BY wall_s, repeat, dtype, variant) = 1",
    "F20_best_over_rest": W + ", t AS (SELECT model, device, cpus, variant, avg(wall_s) AS wall_s FROM trials GROUP BY ALL) SELECT model, device, cpus, variant, round(wall_s, 6) AS wall_s FROM t QUALIFY row_number() OVER (PARTITION BY model, device ORDER BY wall_s, cpus, variant) = 1",
    "F21_fastest_native": W + ", t AS (SELECT model, device, kind, cpus, avg(wall_s) AS w FROM trials GROUP BY ALL), m AS (SELECT model, device, min(w) FILTER (kind = 'baseline') AS native, min(w) FILTER (kind <> 'baseline') AS orchestrated FROM t GROUP BY ALL) SELECT model, device, round(native, 6) AS native, round(orchestrated, 6) AS orchestrated, round(native / orchestrated, 6) AS speedup FROM m",
    "F22_summary_record": W + " SELECT model, dtype, count(wall_s) AS n, round(avg(wall_s), 6) AS mean, round(median(wall_s), 6) AS median, round(quantile_cont(wall_s, 0.25), 6) AS q25, round(quantile_cont(wall_s, 0.75), 6) AS q75, round(min(wall_s), 6) AS min, round(max(wall_s), 6) AS max FROM trials GROUP BY ALL",
    "E14_winner_lookup": "SELECT o_custkey AS c_custkey, o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    "E12_retry_and_legacy": """WITH log AS (SELECT (['env', 'error', 'dual_gpu', 'cpu_worker_sweep', 'single'])[(l_suppkey % 5 + 1)::INTEGER] AS kind, CASE l_returnflag WHEN 'A' THEN 'baseline_annotate' WHEN 'N' THEN 'lean' END AS backend,
   CASE WHEN l_linenumber % 2 = 1 THEN l_linenumber END AS workers, CASE WHEN l_linestatus = 'O' THEN 'cpu' ELSE 'gpu' END AS device, CASE WHEN l_tax >= 0.04 THEN 1 END AS actual, l_partkey % 400 AS threads, l_orderkey % 50 AS n FROM lineitem),
 done AS (SELECT kind, device, threads, n FROM log WHERE kind <> 'env'
   UNION SELECT 'dual_gpu_serial', device, threads, n FROM log WHERE kind = 'dual_gpu' AND backend IS DISTINCT FROM 'baseline_annotate' AND workers IS NULL
   UNION SELECT kind, device, -1, n FROM log WHERE kind = 'cpu_worker_sweep' AND device = 'cpu' AND actual IS NULL AND threads > 0),
 plan AS (SELECT p_partkey, (['dual_gpu_serial', 'cpu_worker_sweep', 'error', 'single'])[(p_partkey % 4 + 1)::INTEGER] AS kind, CASE WHEN p_size < 10 THEN 'gpu' ELSE 'cpu' END AS device,
   CASE WHEN p_partkey % 4 = 1 THEN -1 ELSE p_partkey % 400 END AS threads, p_size AS n FROM part)
 SELECT p_partkey, retry FROM plan, (VALUES (true), (false)) t(retry)
 WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.kind = plan.kind AND done.device = plan.device AND done.threads = plan.threads AND done.n = plan.n AND NOT (retry AND done.kind = 'error'))""",
    "E12_skip_done": "SELECT c_custkey AS k, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "E13_fuzzy_skip": "SELECT p_partkey, p_size AS n, p_type AS kind FROM part a WHERE NOT EXISTS (SELECT 1 FROM supplier b WHERE a.p_type = CASE WHEN s_acctbal > 5000 THEN 'ECONOMY' ELSE 'SMALL' END AND abs(a.p_size - s_nationkey * 2) <= greatest(2, floor(a.p_size * 0.05)))",
    "E19_capped": "WITH t AS (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey AS k, l_quantity AS asked, least(l_quantity, 30.0 + l_suppkey % 10) AS got FROM lineitem), c AS (SELECT k, min({'asked': asked, 'got': got}) AS m FROM t WHERE got < asked GROUP BY k) SELECT t.* FROM t JOIN c ON t.k = c.k WHERE asked > m.asked AND asked >= m.got",
    "E16_grid_gaps": "SELECT s, m::INTEGER AS m, c::INTEGER AS c FROM (VALUES ('F'), ('O'), ('P')) a(s), range(1, 32) b(m), range(100) d(c) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = s AND day(o_orderdate) = m AND o_custkey % 100 = c)",
    "E17_merged_sources": "WITH o AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders GROUP BY 1 HAVING max(o_totalprice) > 300000), u AS (SELECT k, v, 'orders' AS src, 0 AS p FROM o UNION ALL SELECT c_custkey, c_acctbal, 'customer', 1 FROM customer) SELECT k, round(v, 6) AS v, src FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY p, v) = 1",
    "E18_inventory": "WITH s AS (SELECT c_mktsegment, list(DISTINCT c_nationkey ORDER BY c_nationkey) AS l FROM customer GROUP BY 1) SELECT count(*) AS n_chunks, count(DISTINCT l) AS n_lists, count(DISTINCT l) <= 1 AS same FROM s",
    "F49_pivot": W + " SELECT model, device, " + ", ".join(f"round(avg(wall_s) FILTER (dtype = '{d}'), 6) AS dtype_{d}" for d in ("fp32", "bf16", "fp16")) + " FROM trials GROUP BY ALL",
    "F48_threads_table": W + " SELECT cpus, " + ", ".join(f"round(min(wall_s) FILTER (model = '{d}'), 6) AS \"model_{d}\"" for d in "ANR") + " FROM trials GROUP BY ALL",
    "F31_progress": "SELECT o_orderpriority, year(o_orderdate)::INTEGER AS y, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\", count(*) AS total FROM orders GROUP BY ROLLUP (o_orderpriority, y)",
    "F32_completions": V + " SELECT event_id % 7 AS family, count(*) AS done, count(*) FILTER (seen > TIMESTAMP '2024-01-20 23:57:12') AS recent FROM station_events GROUP BY 1",
    "F36_audit": W + ", t AS (SELECT model, n_stations, device, variant, cpus, count(wall_s) AS n, avg(wall_s) AS mean, 100 * stddev_pop(wall_s) / avg(wall_s) AS cv FROM trials GROUP BY ALL) SELECT model, n_stations, device, variant, cpus, n, round(mean, 9) AS mean, round(cv, 6) AS cv FROM t WHERE n >= 3 AND cv > 20",
    "F33_cold_warm": V + ", f AS (SELECT station, event_id % 10 AS feed, max(returned_s - queued_s) AS busy FROM station_events GROUP BY ALL) SELECT station, round(max(busy) FILTER (feed = 0), 6) AS cold, round(avg(busy) FILTER (feed > 0), 6) AS warm_mean, round(min(busy) FILTER (feed > 0), 6) AS warm_min, round(max(busy) FILTER (feed > 0), 6) AS warm_max, round(CASE WHEN count(*) FILTER (feed > 0) = 1 THEN 0 ELSE stddev_samp(busy) FILTER (feed > 0) END, 6) AS warm_std, round(sum(busy), 6) AS idle_total FROM f GROUP BY station",
    "F34_warm_tails": _tails("floor({q} * (len(v) - 1) + 0.5)::INTEGER"),
    "F35_paced_tails": f"""{_tails("round_even({q}::DOUBLE * (len(v) - 1), 0)::INTEGER").replace("FROM station_events GROUP BY 1", "FROM station_events WHERE event_id % 7 <> 0 GROUP BY 1").replace(" SELECT station, len(v)", ", t AS (SELECT station, len(v)", 1)}),
 p AS (SELECT station, returned_s - ready_s AS x FROM station_events WHERE event_id % 7 <> 0)
 SELECT t.*, m.* EXCLUDE (station) FROM t JOIN (SELECT station, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(avg(greatest(x - 1, 0)), 6) AS late_mean, round(max(greatest(x - 1, 0)), 6) AS late_max, count(*) FILTER (x > 1) AS late_nonzero FROM p GROUP BY station) m ON t.station = m.station""",
    "F39_latency": f"{V} SELECT station, count(*) AS n, {_lat('returned_s - ready_s', 'e2e')}, {_lat('queued_s - ready_s', 'queue')}, {_lat('returned_s - queued_s', 'service')} FROM station_events GROUP BY station",
    "F40_stored_p95": V + ", s AS (SELECT station, count(*) AS n, quantile_cont(returned_s - ready_s, 0.95) AS r FROM station_events GROUP BY 1) SELECT station, n, round(r, 6) AS recomputed, round(r + right(station, 1)::INTEGER % 2 * 0.5, 6) AS stored, right(station, 1)::INTEGER % 2 = 0 AS agrees FROM s",
    "F41_makespan": V + """, s AS (SELECT chunk, max(returned_s) - min(ready_s) AS makespan, greatest(max(returned_s) - min(queued_s), 0) AS compute_span, sum(returned_s - queued_s) AS busy, count(*) AS n_tasks FROM station_events GROUP BY 1)
 SELECT chunk, round(makespan, 6) AS makespan, round(compute_span, 6) AS compute_span, round(busy, 6) AS busy, n_tasks, CASE WHEN makespan > 0 THEN round(greatest(0, 1 - busy / (4 * makespan)), 6) END AS idle_share,
  CASE WHEN compute_span > 0 THEN round(greatest(0, 1 - busy / (4 * compute_span)), 6) END AS idle_compute FROM s""",
    "F41_stations_per_chunk": V + " SELECT chunk, greatest(0, floor(ready_s / 60))::INTEGER AS ready_chunk, count(*) AS n_stations FROM station_events GROUP BY ALL",
    "F43_run_spread": W + ", t AS (SELECT model, device, cpus, avg(f1) AS f1 FROM trials GROUP BY ALL) SELECT model, device, round(avg(f1), 6) AS mean, round(CASE WHEN count(f1) = 1 THEN 0 ELSE stddev_samp(f1) END, 6) AS std, count(f1) AS n_runs FROM t GROUP BY ALL",
    "F43_device_difference": W + ", t AS (SELECT model, cpus, avg(wall_s) FILTER (device = 'F') AS a, avg(wall_s) FILTER (device = 'O') AS b FROM trials GROUP BY ALL) SELECT model, round(avg(abs(a - b)), 6) AS mean_abs_diff, count(*) AS n_runs FROM t WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY model",
    "F45_device_counts": W + ", t AS (SELECT model, dtype, count(*) FILTER (device = 'F') AS f, count(*) FILTER (device = 'O') AS o FROM trials GROUP BY ALL) SELECT model, dtype, f AS \"n_F\", o AS \"n_O\", coalesce(greatest(nullif(f, 0), nullif(o, 0)) - least(nullif(f, 0), nullif(o, 0)), 0) AS spread FROM t",
    "F56_stage_report": V + " SELECT station, round(sum(returned_s - queued_s), 6) AS sum, round(avg(returned_s - queued_s), 6) AS mean, round(median(returned_s - queued_s), 6) AS median, round(min(returned_s - queued_s), 6) AS min, round(max(returned_s - queued_s), 6) AS max, count(*) AS n FROM station_events GROUP BY station",
    "F29_stage_timings": V + " SELECT station, round(coalesce(avg(queued_s) FILTER (event_id % 3 = 0), 0), 6) AS load_avg, round(coalesce(sum(queued_s) FILTER (event_id % 3 = 0), 0), 6) AS load_sum, 0.0::DOUBLE AS never_avg, 0.0::DOUBLE AS never_sum FROM station_events GROUP BY station",
    "F37_delays": V + ", r AS (SELECT chunk, greatest(ready_s - 600, 0) AS ready FROM station_events) SELECT chunk, count(ready) AS n_stations, count(*) FILTER (ready > 0) AS n_delayed, count(*) FILTER (ready <= 0) AS n_ready, count(*) FILTER (ready >= 60) AS n_spill, round(min(ready), 6) AS delay_min, round(max(ready), 6) AS delay_max, round(avg(ready), 9) AS delay_mean, count(DISTINCT floor(ready / 60)) AS n_chunks_touched FROM r GROUP BY chunk",
    "F55_energy": V + ", e AS (SELECT station, chunk, chunk * 3600.0::DOUBLE + max(queued_s) AS t, max(returned_s) AS power FROM station_events GROUP BY station, chunk), s AS (SELECT station, power, 0.5 * (power + lag(power) OVER w) * (t - lag(t) OVER w) AS e FROM e WINDOW w AS (PARTITION BY station ORDER BY t)) SELECT station, round(coalesce(sum(e), 0), 3) AS energy, round(avg(power), 3) AS mean_power, round(max(power), 3) AS max_power FROM s GROUP BY station",
    "F52_resources": V + ", e AS (SELECT station, chunk * 3600.0::DOUBLE + ready_s AS t, queued_s AS cpu, (event_id % 1000)::DOUBLE AS n FROM station_events), g AS (SELECT *, n - lag(n) OVER (PARTITION BY station ORDER BY t) AS d FROM e), s AS (SELECT station, max(t) - min(t) AS wall, max(cpu) - min(cpu) AS cpu_s, sum(CASE WHEN d < 0 THEN d + 1000 ELSE d END) AS gain FROM g GROUP BY 1) SELECT station, round(wall, 6) AS wall, round(cpu_s, 6) AS cpu_s, round(cpu_s / nullif(wall, 0), 6) AS cpu_share, round(coalesce(gain, 0), 6) AS gain FROM s",
    "F53_memory": W + ", t AS (SELECT model, cpus, max(wall_s) FILTER (device = 'F') AS before, max(wall_s) FILTER (device = 'O') AS after FROM trials GROUP BY ALL) SELECT model, cpus, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) AS growth FROM t",
    "F54_asked_vs_used": "WITH t AS (SELECT p_partkey, (p_size - 10)::DOUBLE AS asked, p_retailprice / 50 AS used, 19.0::DOUBLE AS base FROM part) SELECT p_partkey, asked, round(used, 6) AS used, base, CASE WHEN asked > 0 THEN round(used - asked, 6) END AS overhead, CASE WHEN asked > 0 THEN round(100 * used / asked, 6) END AS utilisation, round(greatest(used - base, 0), 6) AS growth FROM t",
    "B8_throughput": W + " SELECT model, variant, round(avg(n_stations / wall_s), 6) AS stations_per_s, round(max(cpus / wall_s), 6) AS best_cpus_per_s FROM trials GROUP BY ALL",
    "H3_top_speedups": W + ", b AS (SELECT model, n_stations, device, median(wall_s) AS baseline FROM trials WHERE kind = 'baseline' GROUP BY ALL), o AS (SELECT model, n_stations, device, variant, median(wall_s) AS m FROM trials WHERE kind <> 'baseline' GROUP BY ALL) SELECT o.model, o.n_stations, o.device, variant, round(baseline / m, 6) AS speedup_median FROM o JOIN b ON o.model = b.model AND o.n_stations = b.n_stations AND o.device = b.device ORDER BY 5 DESC, 1, 2, 3, 4 LIMIT 15",
    "B14_trial_ids": "WITH k AS (SELECT o_orderkey, o_custkey || '|' || CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE '' END || '|' || o_orderpriority AS key FROM orders) SELECT o_orderkey, key, substr(sha1(key), 1, 12) AS uid FROM k",
}
