"""Queries over charts' data, resource use, dual-device baselines and run summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quakeframe.functions import scalars as S
from quakeframe.operators import charts, reports
from quakeframe.operators import trials as T
from quakeframe.plans.record_queries import REPORTS, _summary
from quakeframe.plans.stand_ins import STATION_EVENTS, TRACES, TRIALS, rounded, station_events, table, traces, trials
from quakeframe.sources import readers

STAGES = ["merge_streams", "preprocess", "forward"]


def runs(spark, sf_dir):
    """Trials on one device, on two, and baselines of both."""
    t = trials(spark, sf_dir)
    dual = F.col("variant") == 1
    kind = F.when(F.col("variant") == 0, "baseline").when(dual, "dual_gpu").otherwise("single")
    backend = F.when(F.col("cpus") % 3 == 0, "baseline_annotate").otherwise(F.concat(F.lit("b"), (F.col("cpus") % 3).cast("string")))
    stages = F.create_map(F.lit("preprocess"), F.col("wall_s") * (1 - F.col("f1")), F.lit("forward"), F.col("wall_s") * F.col("f1") * 0.5)
    return t.withColumns({"kind": kind, "backend": backend, "stages": stages})


def dual_baseline(spark, sf_dir):
    return rounded(T.speedup_vs_baseline(runs(spark, sf_dir), ["model", "n_stations", "device"], "wall_s", T.baseline_of(), ["kind", "backend"]))


def batch_chart(spark, sf_dir):
    return rounded(charts.throughput_by_batch(runs(spark, sf_dir), ["model", "backend"], "cpus", "n_stations", "wall_s", F.col("kind") == "single"))


def backend_chart(spark, sf_dir):
    return rounded(charts.speedup_by_backend(runs(spark, sf_dir), ["model", "device", "n_stations"], "backend", "wall_s", F.col("kind") == "baseline", F.col("kind") == "single"))


def stage_chart(spark, sf_dir):
    return rounded(charts.stage_breakdown(runs(spark, sf_dir), ["model", "device", "n_stations"], "backend", "wall_s", "stages", STAGES, F.col("kind") == "baseline", F.col("kind") == "single"))


def device_chart(spark, sf_dir):
    return rounded(charts.one_and_two_devices(runs(spark, sf_dir), ["model", "backend", "n_stations"], "wall_s", F.col("kind") == "single", F.col("kind") == "dual_gpu"))


def usage(spark, sf_dir):
    """Three processes a station; stations whose number divides by 5 have no energy counter."""
    e = station_events(spark, sf_dir)
    spent = F.col("queued_s") - F.col("ready_s")
    number = F.substring("station", 2, 9).cast("int")
    rows = e.select(
        "station", (F.col("event_id") % 3).alias("process"), (F.col("chunk") * 3600.0 + F.col("ready_s")).alias("t"), spent.alias("cpu_user"), (spent / 2).alias("cpu_system"),
        (F.col("event_id") * 1000).alias("read_bytes"), (F.col("event_id") * 500).alias("write_bytes"), (F.col("event_id") % 101).cast("double").alias("util"),
        (F.col("event_id") % 250).cast("double").alias("power"), F.when(number % 5 != 0, (F.col("event_id") % 1000).cast("double")).alias("energy"),
    )
    return rounded(T.resource_usage(rows, ["station"], "process", "t", 4, 1000.0), 4)


def run_rows(spark, sf_dir):
    """Station rows of each chunk with what its run was set to: nations play runs."""
    n = table(spark, sf_dir, "nation")
    start = F.when(F.col("n_nationkey") % 2 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=F.col("n_nationkey").cast("int")))
    end = start + F.make_dt_interval(hours=F.lit(1))
    told = n.filter("n_nationkey <> 3").select(
        F.col("n_nationkey").cast("int").alias("chunk_id"), S.analysis_window(start, end, F.lit(None).cast("string"), F.col("n_nationkey") + 60).alias("window"),
        S.model_label(F.lit("Net"), F.lower("n_name")).alias("model"), S.threshold_label(F.col("n_regionkey") / 10, F.lit(0.3)).alias("thresholds"),
    )
    rows = reports.run_rows(_summary(spark, sf_dir).withColumn("chunk_id", F.col("chunk_id").cast("int")), told, ["chunk_id"])
    return rows.select("station", "chunk_id", "window", "n_p", "n_s", "model", "thresholds", "expected", "decoded", "text")


def trimmed_network(spark, sf_dir):
    t = traces(spark, sf_dir).select("trace", (F.col("trace") % 7000).cast("double").alias("p"), (F.col("trace") % 5000 + 100).cast("double").alias("s"), F.col("p").alias("samples"))
    out = readers.build_network(t, 50, 42, 20.0, 4000.0, trim=40)
    return rounded(out.select("trace", "p", "s", F.size("samples").alias("n"), F.element_at("samples", -1).alias("last")))


QUERIES = {
    "E6_dual_device_baseline": dual_baseline, "F51_throughput_by_batch": batch_chart, "F51_speedup_by_backend": backend_chart, "F51_stage_breakdown": stage_chart, "F51_one_and_two_devices": device_chart,
    "F52_resource_usage": usage, "F27_run_rows": run_rows, "A25_trimmed_network": trimmed_network,
}

R = f"""WITH {TRIALS}, runs AS (SELECT * REPLACE (CASE variant WHEN 0 THEN 'baseline' WHEN 1 THEN 'dual_gpu' ELSE 'single' END AS kind),
  CASE WHEN cpus % 3 = 0 THEN 'baseline_annotate' ELSE 'b' || (cpus % 3) END AS backend, wall_s * (1 - f1) AS preprocess, wall_s * f1 * 0.5::DOUBLE AS forward FROM trials)"""
TEXT = lambda x: rf"regexp_replace(regexp_replace(printf('%.6f', {x}), '0+$', ''), '\.$', '')"
CHART_KEYS = "model, device, n_stations"

ORACLE_SQL = {
    "E6_dual_device_baseline": R + """, base AS (SELECT model, n_stations, device, median(wall_s) AS baseline FROM runs WHERE kind = 'baseline' OR kind = 'dual_gpu' AND backend = 'baseline_annotate' GROUP BY ALL),
o AS (SELECT model, n_stations, device, kind, backend, min(wall_s) AS best, count(*) AS n_repeats, median(wall_s) AS median FROM runs WHERE NOT (kind = 'baseline' OR kind = 'dual_gpu' AND backend = 'baseline_annotate') GROUP BY ALL)
SELECT o.model, o.n_stations, o.device, kind, backend, round(best, 6) AS best, n_repeats, round(median, 6) AS median, round(baseline, 6) AS baseline, round(baseline / median, 6) AS speedup_median, round(baseline / best, 6) AS speedup_best
FROM o LEFT JOIN base USING (model, n_stations, device)""",
    "F51_throughput_by_batch": R + " SELECT model, backend, cpus, round(avg(CASE WHEN wall_s > 0 THEN n_stations / wall_s ELSE 0 END), 6) AS rate FROM runs WHERE kind = 'single' GROUP BY ALL",
    "F51_speedup_by_backend": R + f""", base AS (SELECT {CHART_KEYS}, avg(wall_s) AS baseline FROM runs WHERE kind = 'baseline' GROUP BY ALL), o AS (SELECT {CHART_KEYS}, backend, min(wall_s) AS best FROM runs WHERE kind = 'single' GROUP BY ALL)
SELECT model, device, n_stations, backend, round(best, 6) AS best, round(baseline, 6) AS baseline, round(baseline / best, 6) AS speedup FROM o LEFT JOIN base USING ({CHART_KEYS})""",
    "F51_stage_breakdown": R + f""", best AS (SELECT {CHART_KEYS}, CASE kind WHEN 'baseline' THEN 'baseline_annotate' ELSE backend END AS backend, min(struct_pack(s := wall_s, p := preprocess, f := forward)) AS b FROM runs WHERE kind <> 'dual_gpu' GROUP BY ALL)
SELECT {CHART_KEYS}, backend, 'merge_streams' AS stage, 0.0::DOUBLE AS seconds FROM best UNION ALL SELECT {CHART_KEYS}, backend, 'preprocess', round(b.p, 6) FROM best UNION ALL SELECT {CHART_KEYS}, backend, 'forward', round(b.f, 6) FROM best""",
    "F51_one_and_two_devices": R + """, b AS (SELECT model, backend, n_stations, min(wall_s) FILTER (kind = 'single') AS one, min(wall_s) FILTER (kind = 'dual_gpu') AS two FROM runs GROUP BY ALL)
SELECT model, backend, n_stations, round(one, 6) AS one, round(two, 6) AS two, round(one / two, 6) AS gain FROM b WHERE one IS NOT NULL AND two IS NOT NULL""",
    "F52_resource_usage": f"""WITH {STATION_EVENTS}, e AS (SELECT station, event_id % 3 AS process, chunk * 3600.0::DOUBLE + ready_s AS t, queued_s - ready_s AS spent, event_id, CASE WHEN substr(station, 2)::INTEGER % 5 <> 0 THEN (event_id % 1000)::DOUBLE END AS energy FROM station_events),
l AS (SELECT station, process, max(struct_pack(t := t, u := spent, i := event_id)) AS l FROM e GROUP BY ALL), p AS (SELECT station, sum(l.u) AS u, sum(l.i) AS i FROM l GROUP BY ALL),
g AS (SELECT station, energy - lag(energy) OVER (PARTITION BY station ORDER BY t, energy) AS d FROM e WHERE energy IS NOT NULL), j AS (SELECT station, sum(CASE WHEN d < 0 THEN d + 1000 ELSE d END) AS joules FROM g GROUP BY ALL),
s AS (SELECT station, max(t) - min(t) AS wall, avg(event_id % 101) AS um, max(event_id % 101) AS ux, avg(event_id % 250) AS pm, max(event_id % 250) AS px FROM e GROUP BY ALL)
SELECT station, round(wall, 4) AS wall_s, round(u, 4) AS cpu_user_s, round(u / 2, 4) AS cpu_system_s, round(u * 1.5::DOUBLE / nullif(wall * 4, 0), 4) AS cpu_share, round(i * 1000 / 1e6, 4) AS read_mb, round(i * 500 / 1e6, 4) AS write_mb,
  round(um, 4) AS util_mean, ux::DOUBLE AS util_max, round(pm, 4) AS power_mean, px::DOUBLE AS power_max, round(greatest(coalesce(joules, pm * wall), 0), 4) AS energy_j FROM s JOIN p USING (station) LEFT JOIN j USING (station)""",
    "F27_run_rows": f"""{REPORTS}, told AS (SELECT n_nationkey AS chunk_id, CASE WHEN n_nationkey % 2 = 0 THEN strftime(TIMESTAMP '2024-01-01' + to_hours(n_nationkey::BIGINT), '%Y-%m-%d %H:%M:%S') || ' to ' || strftime(TIMESTAMP '2024-01-01' + to_hours(n_nationkey::BIGINT + 1), '%Y-%m-%d %H:%M:%S')
  ELSE (n_nationkey + 60) || ' min' END AS run_window, 'Net/' || lower(n_name) AS model, CASE WHEN n_regionkey = 3 THEN '0.3' ELSE 'P ' || {TEXT("n_regionkey / 10.0::DOUBLE")} || ' / S 0.3' END AS thresholds FROM nation WHERE n_nationkey <> 3)
SELECT s.station, s.chunk_id::INTEGER AS chunk_id, coalesce(run_window, '') AS "window", n_p, n_s, coalesce(model, '') AS model, coalesce(thresholds, '') AS thresholds, coalesce(q.expected::VARCHAR, '') AS expected, coalesce(q.decoded::VARCHAR, '') AS decoded, s.text
FROM s JOIN q ON s.station = q.station AND s.chunk_id = q.chunk_id LEFT JOIN told ON told.chunk_id = s.chunk_id""",
    "A25_trimmed_network": f"WITH {TRACES}, t AS (SELECT trace, (trace % 7000)::DOUBLE AS p, (trace % 5000 + 100)::DOUBLE AS s, p AS x FROM traces) SELECT trace, p, s, len(x[:40])::INTEGER AS n, round(x[40], 6) AS last FROM t WHERE p >= 20 AND p < 4000 AND s >= 20 AND s < 4000 ORDER BY md5('42/' || trace), trace LIMIT 50",
}
