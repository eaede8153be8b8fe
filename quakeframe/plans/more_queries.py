"""Further queries: evaluation chains, fallbacks, pooled runs, labels, seeded choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from quakeframe.functions import scalars as S
from quakeframe.functions import statistics as st
from quakeframe.operators import matching, metrics, prep, reports
from quakeframe.operators import picks as K
from quakeframe.operators import trials as T
from quakeframe.plans.stand_ins import PICKS, STATION_EVENTS, TRACES, TRIALS, picks, rounded, station_events, table, traces, trials
from quakeframe.sources import readers, sinks

T0 = "2024-01-01"


def delta_rows(spark, sf_dir):
    """Delta in samples and milliseconds with flags; skipped rows and nulls dropped."""
    p = picks(spark, sf_dir).filter("run = 'catalog'")
    d = F.bround(F.col("prob") * 60 - 20, 0).cast("int")
    rows = p.select("event_id", "phase", F.when(F.col("event_id") % 11 != 0, d).alias("delta"))
    return rounded(rows.filter("delta IS NOT NULL").withColumns({"ms": F.col("delta") * 10.0, "within_5": F.abs("delta") <= 5, "early": F.col("delta") < 0}))


def usable(spark, sf_dir):
    t = trials(spark, sf_dir)
    ok = S.usable_trial(F.col("cpus") > 45, F.when(F.col("success"), 1.0).otherwise(0.5), F.col("wall_s"))
    return t.groupBy("model", "device").agg(F.count_if(ok).alias("usable"), F.count(F.lit(1)).alias("n"))


def families(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    path = F.concat(F.lit("/runs/"), F.when(F.col("o_orderkey") % 3 == 0, "orch_annotate").when(F.col("o_orderkey") % 3 == 1, "native").otherwise("stream"), F.lit("/"), F.col("o_orderpriority"))
    family = F.when(path.contains("orch"), "orchestrated").when(path.contains("native"), "native").otherwise("other")
    return o.groupBy(family.alias("family"), S.mapped(F.col("o_orderstatus"), {"F": "done", "O": "open"}).alias("state")).agg(F.count_if(reports.is_problem(F.col("o_orderpriority"))).alias("problems"))


def centring_chain(spark, sf_dir):
    """Centre a window on P twice, from raw to preprocessed to model; S is kept only if it stays inside."""
    t = traces(spark, sf_dir).withColumns({"p_at": (F.col("trace") * 7 % 80).cast("int"), "s_at": (F.col("trace") * 7 % 80 + 9).cast("int")})
    one = prep.centred_window(t, "p", "p_at", 40).select("trace", F.col("window").alias("w1"), F.col("pick_in_window").alias("p1"), (F.col("s_at") - F.col("w_start")).alias("s1"))
    two = prep.centred_window(one, "w1", "p1", 15)
    s2 = F.col("s1") - F.col("w_start")
    return two.select("trace", F.col("pick_in_window").alias("p2"), F.when((s2 >= 0) & (s2 < 15), s2).cast("int").alias("s2"), F.round(prep.total(F.col("window")), 6).alias("sum"))


def window_times(spark, sf_dir):
    t = traces(spark, sf_dir).withColumn("start", F.timestamp_micros(F.unix_micros(F.lit(T0).cast("timestamp")) + F.col("trace") * 60000000))
    w = K.window_pick_times(t, "p", "start", 0.2)
    return w.select("trace", F.date_format("pick_time", "yyyy-MM-dd HH:mm:ss.SS").alias("pick_time"), F.round("pick_prob", 3).alias("pick_prob"))


def normalised(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("SB.S"), F.col("user_id").cast("string"), F.lit("..HHZ"))).alias("trace_id"), F.when(F.col("event_id") % 9 == 0, F.lit("spare")).alias("station"),
        F.when(F.col("event_type") == "click", "p").when(F.col("event_type") == "view", "S").when(F.col("event_type") == "error", "x").alias("phase"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("peak_time"),
        F.when(F.col("event_id") % 3 == 1, F.col("event_id") + 1).alias("start_time"), F.when(F.col("event_id") % 5 == 0, F.col("event_id") + 2).alias("time"), F.col("value").alias("peak_value"),
    )
    return K.normalise_picks(rows).groupBy("station", "phase").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t"))


def trace_offsets(spark, sf_dir):
    """Onsets of annotation channels, counted from the first start of their station."""
    t = traces(spark, sf_dir).select("trace", "station", F.concat(F.lit("PN"), F.when(F.col("trace") % 2 == 0, "_P").otherwise("_S")).alias("cha"), (F.col("trace") * 3 % 50 + 100).cast("int").alias("begin"), "p")
    first = t.groupBy("station").agg(F.min("begin").alias("origin"))
    j = t.join(first, "station").withColumn("phase", K.channel_phase(F.col("cha")))
    return K.trace_picks(j, ["station", "trace", "phase"], "p", 0.1, 5, F.col("begin") - F.col("origin")).groupBy("station", "phase").agg(F.count(F.lit(1)).alias("n"), F.sum("sample").alias("total"))


def precision_evaluation(spark, sf_dir):
    """Argmax of every trace at two precisions; differences to the catalog and to full precision."""
    t = traces(spark, sf_dir).withColumn("catalog", (F.col("trace") % 64).cast("int"))
    reduced = t.withColumn("p", F.transform("p", lambda v: F.bround(v, 1))).withColumn("dtype", F.lit("bf16"))
    both = t.withColumn("dtype", F.lit("fp32")).unionByName(reduced)
    q = both.select("trace", "dtype", K.argmax_pick(F.col("p")).alias("argmax"), "catalog")
    wide = q.groupBy("trace", "catalog").agg(F.max(F.when(F.col("dtype") == "fp32", F.col("argmax"))).alias("full"), F.max(F.when(F.col("dtype") == "bf16", F.col("argmax"))).alias("reduced"))
    return wide.select("trace", (F.col("full") - F.col("catalog")).alias("delta_catalog"), (F.col("reduced") - F.col("full")).alias("delta_full"))


def network_comparison(spark, sf_dir):
    """Each station's single catalog pick against its saved picks; stations without picks stay."""
    p = picks(spark, sf_dir)
    cat = p.filter("run = 'catalog'").groupBy("station", "phase").agg(F.min("sample").alias("sample"))
    judged = matching.compare_pick_sets(cat, p.filter("run = 'detected'"), 900.0)
    return judged.groupBy("station", "phase").agg(F.count_if(F.col("kind") == "matched").alias("matched"), F.count_if(F.col("kind") == "missing").alias("missing"), F.round(F.min("delta"), 6).alias("delta"))


def path_fallback(spark, sf_dir):
    """Reference rows by the first of three layouts that has them."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus", F.col("o_totalprice").alias("v"))
    layers = [o.filter(F.col("o_orderstatus") == s).groupBy("k").agg(F.max("v").alias("v")).withColumn("layout", F.lit(s)) for s in ("P", "F", "O")]
    return rounded(T.merge_by_priority(layers, ["k"], ["v"]))


def quality_sweep(spark, sf_dir):
    """Probability drift, onset drift and speedup of reduced against full runs, by model, precision and compile flag."""
    t = traces(spark, sf_dir).withColumns({
        "model": F.when(F.col("trace") % 4 < 2, "A").otherwise("B"), "dtype": F.when(F.col("trace") % 3 == 0, "bf16").otherwise("fp16"), "compiled": F.col("trace") % 5 == 0,
    })
    key = ["model", "dtype", "compiled"]
    reduced = t.withColumn("p", F.transform("p", lambda v: F.bround(v, 1)))
    drift = metrics.probability_drift(metrics.exploded_pairs(t.select(*key, "trace", "p"), reduced.select(*key, "trace", "p"), [*key, "trace"], "p"), key, "a", "b").select(*key, "mae", "n_samples")
    on = lambda x: x.select(*key, "trace", F.explode(K.onsets(F.col("p"), 0.1, 5)).alias("sample"))
    timing = metrics.pick_drift(matching.match_picks(on(t), on(reduced), [*key, "trace"], 0.5), key).select(*key, "n_pairs", "n_missing_a", "n_missing_b")
    seconds = t.groupBy(*key).agg(S.ratio(F.sum(prep.total(F.transform("p", F.abs))), F.sum(prep.total(F.transform("p", lambda v: F.bround(F.abs(v), 1))))).alias("speedup"))
    return rounded(drift.join(timing, key, "left").join(seconds, key, "left"))


def gpu_optimum(spark, sf_dir):
    t = trials(spark, sf_dir).withColumn("gpus", S.int_list(F.concat(F.lit("["), (F.col("variant") % 3).cast("string"), F.when(F.col("device") == "F", ", 1]").otherwise("]"))))
    t = t.select("model", "gpus", "n_stations", "wall_s", "repeat", "cpus", "variant")
    best = T.optimal_configurations(t, ["model", "gpus", "n_stations"], "wall_s", ["repeat", "cpus", "variant"])
    return rounded(best.withColumn("gpus", F.concat_ws(",", F.col("gpus").cast("array<string>"))))


def arrival_percentiles(spark, sf_dir):
    e = station_events(spark, sf_dir).withColumn("x", F.col("returned_s") - F.col("ready_s"))
    return rounded(T.arrival_percentiles(e, ["chunk"], F.col("x")))


def pooled_runs(spark, sf_dir):
    """Results of three seeded runs pooled, then totalled as one."""
    p = picks(spark, sf_dir).withColumn("trace", F.concat_ws("/", "station", "phase", F.pmod("event_id", F.lit(3)).cast("string")))
    cat = p.filter("run = 'catalog'").groupBy("trace").agg(F.min("sample").alias("catalog"))
    hits = matching.first_hits(cat, p.filter("run = 'detected'").select("trace", F.col("event_id").alias("pos"), "sample"), "trace", 2000.0)
    return rounded(metrics.detection_totals(hits.withColumn("phase", F.get(F.split("trace", "/"), F.lit(1))), ["phase"]))


def chart_data(spark, sf_dir):
    """Throughput by batch, best stage share and worker sweep as one long table."""
    t = trials(spark, sf_dir).withColumn("rate", S.rate(F.col("n_stations"), F.col("wall_s")))
    by_batch = t.groupBy("model", F.col("n_stations").alias("x")).agg(F.avg("rate").alias("y")).withColumn("chart", F.lit("throughput"))
    sweep = t.groupBy("model", F.col("cpus").alias("x")).agg(F.min("wall_s").alias("y")).withColumn("chart", F.lit("workers"))
    return rounded(by_batch.unionByName(sweep))


def peak_memory(spark, sf_dir):
    t = trials(spark, sf_dir).filter(~(F.col("kind") == "baseline"))
    return rounded(T.pivot_table(t, ["model", "n_stations"], "device", ["F", "O"], "wall_s", F.max))


def seeded_choice(spark, sf_dir):
    """The same 20 stations for the same seed, whatever the partitioning."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return readers.seeded_subset(c, "c_custkey", 20, 7)


def windows_text(spark, sf_dir):
    p = picks(spark, sf_dir)
    hour = F.date_trunc("hour", "t")
    user = F.when(F.col("event_id") % 4 == 0, hour)
    chunk = F.when(F.col("event_id") % 4 == 2, S.chunk_id(hour, hour + F.expr("INTERVAL 1 HOUR")))
    return p.select("event_id", S.analysis_window(user, user + F.expr("INTERVAL 2 HOURS"), chunk, F.lit(60)).alias("text"))


def classify_file(spark, sf_dir):
    return rounded(sinks.classify_rows(picks(spark, sf_dir)))


def numbered(spark, sf_dir):
    r = table(spark, sf_dir, "supplier").select("s_suppkey", F.upper("s_name").alias("name"))
    return sinks.number_records(r, ["name", "s_suppkey"]).select("s_suppkey", F.col("trial_number").cast("int").alias("trial_number"))


def trial_rows(spark, sf_dir):
    """Trial records in the shape of the reader, derived from line items."""
    li = table(spark, sf_dir, "lineitem")
    raw = li.select(
        F.when(F.col("l_linenumber") == 1, "env").when(F.col("l_linenumber") == 2, "error").when(F.col("l_linenumber") == 3, "baseline").when(F.col("l_linenumber") < 7, "single").alias("kind"), F.col("l_returnflag").alias("backend"),
        F.lit("fp32").alias("dtype"), F.struct((F.col("l_linestatus") == "O").alias("compile")).alias("backend_extra"), (F.col("l_suppkey") % 3).cast("int").alias("n_cpu_workers"), F.lit(0).alias("infer_num_threads"),
        F.when(F.col("l_quantity") > 40, F.col("l_quantity")).alias("wall_time_s"), F.when(F.col("l_quantity") > 20, F.col("l_quantity") + 100).alias("total_s"), F.create_map(F.lit("total"), F.col("l_quantity") + 200).alias("stage_times_s"),
    )
    return rounded(readers.shape_trials(raw).groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.sum("wall_time_s").alias("wall"), F.count_if("is_error").alias("errors")))


def repeats_of_cells(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    res = li.groupBy("l_orderkey").agg(F.struct(F.collect_list(F.struct((F.col("l_discount") < 0.02).alias("success"), F.col("l_quantity").alias("inference_s"))).alias("repeats")).alias("timing"))
    rows = readers.result_repeats(res, ["l_orderkey"])
    return rounded(rows.groupBy("l_orderkey").agg(F.count_if("ok").alias("n_ok"), F.count(F.lit(1)).alias("rows"), F.sum("inference_s").alias("inference_s")))


def catalog_names(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("trace_P_arrival_sample"), (F.col("value") + 10).alias("trace_s_arrival_sample"))
    return rounded(readers.catalog_columns(e))


def equal_minutes(spark, sf_dir):
    """The minute of each event by its sample number at one hertz, and the time of that sample."""
    e = table(spark, sf_dir, "events").withColumns({"t": F.col("ts").cast("timestamp"), "t0": F.lit(T0).cast("timestamp")})
    sample = S.to_sample(F.col("t"), F.col("t0"), 1.0)
    return e.select("event_id", S.chunk_index(sample).alias("minute"), F.date_format(S.to_time(F.floor(sample), F.col("t0"), 1.0), "yyyy-MM-dd HH:mm:ss").alias("second"))


QUERIES = {
    "B7_delta_rows": delta_rows, "B11_usable": usable, "B13_B16_families": families, "C17_centring_chain": centring_chain, "D8_window_times": window_times, "D12_D13_normalised": normalised, "D10_trace_offsets": trace_offsets,
    "D16_precision_evaluation": precision_evaluation, "E3_network_comparison": network_comparison, "E11_path_fallback": path_fallback, "F6_quality_sweep": quality_sweep, "F17_gpu_optimum": gpu_optimum,
    "F38_arrival_percentiles": arrival_percentiles, "F44_pooled_runs": pooled_runs, "F51_chart_data": chart_data, "F50_peak_memory": peak_memory, "H4_seeded_choice": seeded_choice, "J6_windows_text": windows_text,
    "A20_classify_file": classify_file, "A23_numbered": numbered, "A9_trial_rows": trial_rows, "A12_repeats_of_cells": repeats_of_cells, "A16_catalog_names": catalog_names, "B9_equal_minutes": equal_minutes,
}

P, TR, TI, E = f"WITH {PICKS}", f"WITH {TRACES}", f"WITH {TRIALS}", f"WITH {STATION_EVENTS}"
RISES = """rises AS (SELECT trace, list(i ORDER BY i) AS r FROM (SELECT trace, p, unnest(range(1, len(p))) AS i FROM traces) WHERE p[i + 1] >= 0.1 AND p[i] < 0.1 GROUP BY trace),
 fold AS (SELECT trace, r, 1 AS k, [r[1]] AS kept FROM rises UNION ALL
   SELECT trace, r, k + 1, CASE WHEN r[k + 1] - kept[-1] >= 5 THEN list_append(kept, r[k + 1]) ELSE kept END FROM fold WHERE k < len(r))"""

F44 = f"""{P}, k AS (SELECT *, station || '/' || phase || '/' || event_id % 3 AS trace FROM picks), cat AS (SELECT trace, min(sample) AS catalog FROM k WHERE run = 'catalog' GROUP BY 1),
det AS (SELECT trace, sample FROM k WHERE run = 'detected'),
h AS (SELECT c.trace, count(sample) AS n_detected, count(*) FILTER (abs(sample - catalog) <= 2000) AS hits FROM cat c LEFT JOIN det d ON c.trace = d.trace GROUP BY c.trace),
t AS (SELECT split_part(trace, '/', 2) AS phase, count(*) AS n_traces, count(*) AS total_catalog, sum(n_detected)::BIGINT AS total_detected, sum(least(1, hits))::BIGINT AS total_matched, sum(1 - least(1, hits))::BIGINT AS total_missing,
 sum(n_detected - hits)::BIGINT AS total_additional, sum(greatest(hits - 1, 0))::BIGINT AS total_duplicates FROM h GROUP BY 1),
r AS (SELECT *, coalesce(total_matched / nullif(total_detected, 0)::DOUBLE, 0) AS p, coalesce(total_matched / nullif(total_catalog, 0)::DOUBLE, 0) AS q FROM t)
SELECT * EXCLUDE (p, q), round(p, 6) AS precision, round(q, 6) AS recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 6) AS f1 FROM r"""


def _onsets(name: str, x: str) -> str:
    """SQL of the onsets of an array column of ``src``: kept rises at least five samples apart."""
    return f"""{name}r AS (SELECT trace, list(i ORDER BY i) AS r FROM (SELECT trace, {x} AS p, unnest(range(1, len(p))) AS i FROM src) WHERE p[i + 1] >= 0.1 AND p[i] < 0.1 GROUP BY trace),
 {name}f AS (SELECT trace, r, 1 AS k, [r[1]] AS kept FROM {name}r UNION ALL SELECT trace, r, k + 1, CASE WHEN r[k + 1] - kept[-1] >= 5 THEN list_append(kept, r[k + 1]) ELSE kept END FROM {name}f WHERE k < len(r)),
 {name} AS (SELECT trace, unnest(kept) AS i FROM {name}f WHERE k = len(r))"""


F6 = f"""WITH RECURSIVE {TRACES}, src AS (SELECT *, list_transform(p, lambda v: round_even(v, 1)) AS q, CASE WHEN trace % 4 < 2 THEN 'A' ELSE 'B' END AS model, CASE WHEN trace % 3 = 0 THEN 'bf16' ELSE 'fp16' END AS dtype, trace % 5 = 0 AS compiled FROM traces),
 {_onsets("a", "p")}, {_onsets("b", "q")},
 d AS (SELECT model, dtype, compiled, avg(abs(x - y)) AS mae, count(*) AS n_samples FROM (SELECT model, dtype, compiled, unnest(p) AS x, unnest(q) AS y FROM src) GROUP BY ALL),
 m AS (SELECT coalesce(a.trace, b.trace) AS trace, a.i AS x, b.i AS y FROM a FULL JOIN b ON a.trace = b.trace AND a.i = b.i),
 t AS (SELECT model, dtype, compiled, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n_pairs, count(*) FILTER (x IS NULL) AS n_missing_a, count(*) FILTER (y IS NULL) AS n_missing_b FROM m JOIN src ON m.trace = src.trace GROUP BY ALL),
 s AS (SELECT model, dtype, compiled, sum(list_sum(list_transform(p, lambda v: abs(v)))) / sum(list_sum(list_transform(p, lambda v: round_even(abs(v), 1)))) AS speedup FROM src GROUP BY ALL)
 SELECT model, dtype, compiled, round(mae, 6) AS mae, n_samples, n_pairs, n_missing_a, n_missing_b, round(speedup, 6) AS speedup FROM d LEFT JOIN t USING (model, dtype, compiled) LEFT JOIN s USING (model, dtype, compiled)"""

ORACLE_SQL = {
    "B7_delta_rows": f"{P}, d AS (SELECT event_id, phase, round_even(prob * 60 - 20, 0)::INTEGER AS delta FROM picks WHERE run = 'catalog' AND event_id % 11 <> 0) SELECT *, delta * 10.0::DOUBLE AS ms, abs(delta) <= 5 AS within_5, delta < 0 AS early FROM d",
    "B11_usable": f"{TI} SELECT model, device, count(*) FILTER (cpus <= 45 AND success) AS usable, count(*) AS n FROM trials GROUP BY ALL",
    "B13_B16_families": "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'orchestrated' WHEN 1 THEN 'native' ELSE 'other' END AS family, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS state, count(*) FILTER (upper(trim(o_orderpriority)) NOT IN ('', 'OK', 'CLEAN', '-')) AS problems FROM orders GROUP BY ALL",
    "C17_centring_chain": f"{TR}, a AS (SELECT trace, p, trace * 7 % 80 AS pa, greatest(0, least(trace * 7 % 80 - 20, 24)) AS w FROM traces WHERE trace * 7 % 80 < 64), b AS (SELECT trace, p[w + 1 : w + 40] AS x, pa - w AS p1, pa + 9 - w AS s1 FROM a), c AS (SELECT *, greatest(0, least(p1 - 7, 25)) AS v FROM b) SELECT trace, (p1 - v)::INTEGER AS p2, CASE WHEN s1 - v >= 0 AND s1 - v < 15 THEN (s1 - v)::INTEGER END AS s2, round(list_sum(x[v + 1 : v + 15]), 6) AS sum FROM c",
    "D8_window_times": f"{TR}, i AS (SELECT trace, p, unnest(range(1, 63)) AS i FROM traces), b AS (SELECT trace, i, round_even(p[i + 1], 3) AS prob FROM i WHERE p[i + 1] - p[i] > 0 AND p[i + 2] - p[i + 1] <= 0 AND p[i + 1] >= 0.2), f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY trace ORDER BY prob DESC, i) = 1) SELECT traces.trace, left(strftime(make_timestamp(epoch_us(TIMESTAMP '{T0}') + traces.trace * 60000000 + f.i * 10000), '%Y-%m-%d %H:%M:%S.%f'), 22) AS pick_time, round(prob, 3) AS pick_prob FROM traces LEFT JOIN f ON traces.trace = f.trace",
    "D12_D13_normalised": "WITH r AS (SELECT CASE WHEN event_id % 4 <> 0 THEN 'S' || user_id WHEN event_id % 9 = 0 THEN 'spare' END AS station, CASE event_type WHEN 'click' THEN 'P' WHEN 'view' THEN 'S' WHEN 'error' THEN 'X' ELSE 'P' END AS phase, CASE WHEN event_id % 3 = 0 THEN event_id WHEN event_id % 3 = 1 THEN event_id + 1 WHEN event_id % 5 = 0 THEN event_id + 2 END AS t FROM events) SELECT station, phase, count(*) AS n, sum(t)::BIGINT AS t FROM r WHERE station IS NOT NULL AND t IS NOT NULL AND phase <> 'X' GROUP BY ALL",
    "D10_trace_offsets": f"WITH RECURSIVE {TRACES}, {RISES}, b AS (SELECT trace, station, CASE WHEN trace % 2 = 0 THEN 'P' ELSE 'S' END AS phase, trace * 3 % 50 + 100 AS begin, min(trace * 3 % 50 + 100) OVER (PARTITION BY station) AS origin FROM traces), o AS (SELECT trace, unnest(kept) AS i FROM fold WHERE k = len(r)) SELECT station, phase, count(*) AS n, sum(i + begin - origin)::BIGINT AS total FROM o JOIN b ON o.trace = b.trace GROUP BY ALL",
    "D16_precision_evaluation": f"{TR}, q AS (SELECT trace, list_position(p, list_max(p)) - 1 AS a, list_transform(p, lambda v: round_even(v, 1)) AS r FROM traces) SELECT trace, (a - trace % 64)::INTEGER AS delta_catalog, (list_position(r, list_max(r)) - 1 - a)::INTEGER AS delta_full FROM q",
    "E3_network_comparison": f"{P}, c AS (SELECT station, phase, min(sample) AS c FROM picks WHERE run = 'catalog' GROUP BY ALL), m AS (SELECT c.station, c.phase, arg_min(sample - c, struct_pack(d := abs(sample - c), s := sample)) AS delta FROM c JOIN picks p ON p.run = 'detected' AND p.station = c.station AND p.phase = c.phase AND abs(sample - c) <= 900 GROUP BY ALL) SELECT c.station, c.phase, count(delta) AS matched, 1 - count(delta) AS missing, round(min(delta), 6) AS delta FROM c LEFT JOIN m ON c.station = m.station AND c.phase = m.phase GROUP BY ALL",
    "E11_path_fallback": "WITH o AS (SELECT o_custkey AS k, o_orderstatus AS layout, max(o_totalprice) AS v FROM orders GROUP BY ALL) SELECT k, round(v, 6) AS v, layout FROM o QUALIFY row_number() OVER (PARTITION BY k ORDER BY CASE layout WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END) = 1",
    "F44_pooled_runs": F44,
    "F6_quality_sweep": F6,
    "F17_gpu_optimum": f"{TI} SELECT model, (variant % 3) || CASE WHEN device = 'F' THEN ',1' ELSE '' END AS gpus, n_stations, round(wall_s, 6) AS wall_s, repeat, cpus, variant FROM trials QUALIFY row_number() OVER (PARTITION BY model, gpus, n_stations ORDER BY wall_s, repeat, cpus, variant) = 1",
    "F38_arrival_percentiles": f"{E}, x AS (SELECT chunk, returned_s - ready_s AS x FROM station_events) SELECT chunk, count(x) AS n, round(min(x), 6) AS min, round(avg(x), 6) AS mean, round(max(x), 6) AS max, " + ", ".join(f"round(quantile_cont(x, {q / 100}), 6) AS p{q}" for q in (50, 90, 95, 99)) + " FROM x GROUP BY chunk",
    "F51_chart_data": f"{TI} SELECT model, n_stations AS x, round(avg(n_stations / wall_s), 6) AS y, 'throughput' AS chart FROM trials GROUP BY ALL UNION ALL SELECT model, cpus, round(min(wall_s), 6), 'workers' FROM trials GROUP BY ALL",
    "F50_peak_memory": f"{TI} SELECT model, n_stations, round(max(wall_s) FILTER (device = 'F'), 6) AS \"device_F\", round(max(wall_s) FILTER (device = 'O'), 6) AS \"device_O\" FROM trials WHERE kind <> 'baseline' GROUP BY ALL",
    "H4_seeded_choice": "SELECT c_custkey FROM customer ORDER BY md5('7/' || c_custkey), c_custkey LIMIT 20",
    "J6_windows_text": f"{P} SELECT event_id, CASE WHEN event_id % 4 = 0 THEN strftime(date_trunc('hour', t), '%Y-%m-%d %H:%M:%S') || ' to ' || strftime(date_trunc('hour', t) + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') WHEN event_id % 4 = 2 THEN strftime(date_trunc('hour', t), '%Y-%m-%d %H:%M:%S') || ' to ' || strftime(date_trunc('hour', t) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') ELSE '60 min' END AS text FROM picks",
    "A20_classify_file": f"{P} SELECT station, phase, strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS peak_time, round(prob, 6) AS peak_value FROM picks",
    "A23_numbered": "SELECT s_suppkey, row_number() OVER (ORDER BY upper(s_name), s_suppkey)::INTEGER AS trial_number FROM supplier",
    "A9_trial_rows": "WITH r AS (SELECT CASE WHEN l_linenumber = 3 THEN 'baseline' ELSE l_returnflag END || '/fp32' || CASE WHEN l_linestatus = 'O' THEN '/compiled' ELSE '' END || CASE WHEN l_suppkey % 3 > 0 THEN '/w' || (l_suppkey % 3) ELSE '' END AS variant, CASE WHEN l_quantity > 40 THEN l_quantity WHEN l_quantity > 20 THEN l_quantity + 100 ELSE l_quantity + 200 END AS w FROM lineitem WHERE l_linenumber BETWEEN 3 AND 6) SELECT variant, count(*) AS n, round(sum(w), 6) AS wall, 0::BIGINT AS errors FROM r GROUP BY variant",
    "A12_repeats_of_cells": "SELECT l_orderkey, count(*) FILTER (l_discount < 0.02) AS n_ok, greatest(1, count(*) FILTER (l_discount < 0.02)) AS rows, round(sum(l_quantity) FILTER (l_discount < 0.02), 6) AS inference_s FROM lineitem GROUP BY 1",
    "A16_catalog_names": "SELECT event_id, round(value, 6) AS p, round(value + 10, 6) AS s FROM events",
    "B9_equal_minutes": "SELECT event_id, ((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 60000000)::INTEGER AS minute, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS second FROM events",
}
