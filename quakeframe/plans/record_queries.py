"""Queries over records: scalar functions, reports, readers' and writers' frames, arrivals."""

from __future__ import annotations

from pyspark.sql import functions as F

from quakeframe.functions import scalars as S
from quakeframe.operators import prep, reports
from quakeframe.plans.stand_ins import PICKS, STATION_EVENTS, picks, rounded, station_events, table, traces
from quakeframe.sources import readers, sinks
from quakeframe.streaming import stations as K


def time_texts(spark, sf_dir):
    p = picks(spark, sf_dir)
    start = F.date_trunc("minute", "t")
    cid = S.chunk_id(start, start + F.expr("INTERVAL 1 MINUTE"))
    parsed = S.chunk_bounds(cid)
    return p.select(
        "event_id", cid.alias("chunk_id"), parsed["minutes"].alias("minutes"), (F.unix_micros(parsed["start"]) == F.unix_micros(start)).alias("same"),
        S.format_pick_time(F.col("t")).alias("text"), (F.unix_micros(S.parse_pick_time(S.format_pick_time(F.col("t")))) == F.unix_micros("t")).alias("back"),
        S.is_chunk_id(F.concat(F.col("station"), F.lit("_x"))).alias("not_chunk"), S.file_safe(F.concat(F.lit("a b:"), F.col("station"), F.lit("/c"))).alias("safe"),
    )


def durations(spark, sf_dir):
    p = picks(spark, sf_dir)
    return p.select("event_id", S.duration_text(F.floor(F.col("sample") * 60)).alias("text"), S.chunk_end(F.col("sample")).alias("chunk_end"), S.group_size(F.floor("sample").cast("int"), 7, F.col("phase") == "P").alias("group_size"))


def model_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    parts = S.resolve_model(F.when(F.col("p_partkey") % 3 == 0, "pn").otherwise(F.concat_ws("/", "p_type", "p_brand")), {"pn": ("PhaseNet", "stead")})
    return p.select("p_partkey", S.model_label(parts["parent"], F.when(F.col("p_partkey") % 2 == 0, parts["child"])).alias("label"), parts["child"].alias("child"), S.threshold_label(F.col("p_size") / 100, F.lit(0.3)).alias("threshold"), S.mapped(F.col("p_type"), {"ECONOMY": "cheap", "SMALL": "little"}, F.lit("other")).alias("kind"))


def json_cells(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 5 == 0, F.lit(" NaN ")).when(F.col("event_id") % 5 == 1, F.col("user_id").cast("string")).when(F.col("event_id") % 5 == 2, F.lit("True")).when(F.col("event_id") % 5 == 3, F.col("event_type"))
    gpus = F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit(", 1]"))
    return e.select("event_id", S.json_value(raw).alias("json"), F.concat_ws(",", S.int_list(gpus).cast("array<string>")).alias("gpus"), S.first_number(F.col("props"), ("$.missing", "$.k")).alias("k"))


def trial_labels(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    label = S.variant_label(F.when(F.col("l_linenumber") == 1, "baseline").otherwise("single"), F.col("l_returnflag"), F.lit("bf16"), (F.col("l_quantity") - 25).cast("int"), F.col("l_linenumber"), F.col("l_linestatus") == "O")
    split = S.stage_split(F.lit(10.0), F.col("l_quantity") / 10, F.lit(2.0), F.lit(1.0), F.col("l_discount"), F.col("l_tax"))
    out = S.trial_outcome(F.when(F.col("l_linenumber") == 7, F.lit("boom")), (F.col("l_quantity") / 2).cast("int"), F.lit(20), F.col("l_extendedprice"))
    return rounded(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", label.alias("label"), split["framework"].alias("framework"), split["inference"].alias("inference"), split["preprocess"].alias("preprocess"), out["ok"].alias("ok"), out["reason"].alias("reason"), S.window_regime((F.col("l_quantity") * 200).cast("int")).alias("regime")))


def trial_states(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_discount") < 0.05).alias("success"), F.col("l_quantity").alias("forward"), (F.col("l_quantity") + F.col("l_linenumber")).alias("wall"))).alias("repeats"))
    return rounded(o.select("l_orderkey", S.completion(F.col("repeats"), F.lit(3), F.col("l_orderkey") % 10 == 0).alias("state"), S.mean_utilisation(F.col("repeats")).alias("utilisation")))


def _reports(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    expected, decoded = F.when(F.col("l_partkey") % 11 != 0, F.lit(40)), F.when(F.col("l_quantity") > 3, F.col("l_quantity").cast("long")).otherwise(0)
    q = reports.read_quality(expected, decoded, F.col("l_tax") > 0.07)
    tags = F.array_compact(F.array(F.when(F.col("l_tax") > 0.07, "resync"), F.when(F.col("l_discount") > 0.08, "truncated")))
    return li.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("station"), F.col("l_linenumber").alias("chunk_id"), expected.alias("expected"), decoded.alias("decoded"), F.coalesce(q, F.lit("CLEAN")).alias("quality"), tags.alias("tags"))


def station_quality(spark, sf_dir):
    return reports.station_quality(_reports(spark, sf_dir), ["station", "chunk_id"]).withColumn("tags", F.array_join("tags", ","))


def run_quality(spark, sf_dir):
    return reports.run_quality(_reports(spark, sf_dir), ["chunk_id"])


def _summary(spark, sf_dir):
    q = reports.station_quality(_reports(spark, sf_dir), ["station", "chunk_id"])
    p = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("station"), F.col("l_linenumber").alias("chunk_id"), F.when(F.col("l_linestatus") == "O", "P").otherwise("S").alias("phase")).filter("chunk_id > 1")
    return reports.station_summary(p, q, ["station", "chunk_id"])


def station_summary(spark, sf_dir):
    return _summary(spark, sf_dir).select("station", "chunk_id", "n_p", "n_s", "text")


def executive_summary(spark, sf_dir):
    s = _summary(spark, sf_dir).withColumn("label", F.when(F.col("chunk_id") > 2, F.concat(F.lit("m"), F.col("chunk_id").cast("string"))).otherwise(""))
    return reports.executive_summary(s.withColumn("chunk", F.col("chunk_id").cast("string")), "station", "chunk", "label", "text")


def known_issues(spark, sf_dir):
    run = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("station"), F.col("o_orderstatus").alias("chunk_id"))
    registry = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("station"), F.lit("F").alias("chunk_id"), F.col("c_mktsegment").alias("issue"))
    return reports.known_issues(run, registry, ["station", "chunk_id"])


def unsupported(spark, sf_dir):
    plan = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("model"), F.col("p_brand").alias("dtype"))
    rules = spark.createDataFrame([("ECONOMY", "Brand#2", "no fp16"), (None, "Brand#4", "no playback")], "model string, dtype string, reason string")
    return reports.mark_unsupported(plan, rules, ["model", "dtype"])


def pick_file_rows(spark, sf_dir):
    p = picks(spark, sf_dir).select("station", F.when(F.col("phase") == "P", F.col("t")).alias("p_time"), F.when(F.col("phase") == "P", F.col("prob")).alias("p_prob"), F.when(F.col("phase") == "S", F.col("t")).alias("s_time"), F.when(F.col("phase") == "S", F.col("prob")).alias("s_prob"))
    return sinks.pick_rows(p, "SB")


def exported(spark, sf_dir):
    p = picks(spark, sf_dir)
    stations = table(spark, sf_dir, "supplier").select(F.format_string("S%04d", F.col("s_suppkey")).alias("station")).union(p.select("station")).distinct()
    return sinks.export_tree(p, stations).select("station", "rn", F.date_format("p_time", "yyyy-MM-dd HH:mm:ss").alias("p_time"), F.date_format("s_time", "yyyy-MM-dd HH:mm:ss").alias("s_time"))


def pick_lists(spark, sf_dir):
    j = sinks.picks_json(picks(spark, sf_dir).withColumn("sample", F.round("sample", 3)))
    return j.select("station", F.size("p").alias("n_p"), F.size("s").alias("n_s"), F.element_at("p", 1).alias("first_p"), F.element_at("s", -1).alias("last_s"))


def pick_log(spark, sf_dir):
    return sinks.pick_log(picks(spark, sf_dir)).select("station", F.col("place").cast("int").alias("place"), "line")


def merged_summary(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return rounded(sinks.upsert(old, new, ["k"]))


def patched_records(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trial"), (F.col("l_linenumber").cast("long") * 10000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("seq"), F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).alias("a"), F.when(F.col("l_tax") < 0.03, F.col("l_extendedprice")).alias("b"))
    return rounded(sinks.patched(rows.filter("seq < 20000000000"), rows.filter("seq >= 20000000000"), "trial", "seq"))


def catalog_lists(spark, sf_dir):
    j = picks(spark, sf_dir).groupBy("station").agg(F.to_json(F.create_map(F.first("station"), F.struct(F.sort_array(F.collect_list(F.when(F.col("phase") == "P", F.round("sample", 3)))).alias("p"), F.sort_array(F.collect_list(F.when(F.col("phase") == "S", F.round("sample", 3)))).alias("s")))).alias("text"))
    return j.select(F.inline(readers.picks_from_json(F.col("text"))))


def network_choice(spark, sf_dir):
    t = traces(spark, sf_dir).select("trace", (F.col("trace") % 7000).cast("double").alias("p"), (F.col("trace") % 5000 + 100).cast("double").alias("s"))
    return readers.build_network(t, 50, 42, 20.0, 4000.0)


def station_choice(spark, sf_dir):
    s = table(spark, sf_dir, "customer").select(F.col("c_name").alias("station"))
    return readers.select_stations(s, 20)


def duplicated(spark, sf_dir):
    s = traces(spark, sf_dir).select("trace", F.col("station").alias("sta"))
    return readers.duplicate_stations(s, 3)


def latencies(spark, sf_dir):
    e = station_events(spark, sf_dir)
    tasks = e.groupBy((F.floor(F.col("event_id") / 4)).alias("task_id")).agg(F.collect_list(F.col("event_id").cast("string")).alias("stations"), F.max("queued_s").alias("queued_s"), F.max("returned_s").alias("returned_s"), F.sum(F.col("returned_s") - F.col("queued_s")).alias("inference_s"))
    return rounded(K.station_latency(tasks, e.select(F.col("event_id").cast("string").alias("station"), "ready_s")))


def chunk_counts(spark, sf_dir):
    e = station_events(spark, sf_dir)
    c = K.stations_per_chunk(e, "seen", "1 hour")
    return c.select(F.date_format("chunk_start", "yyyy-MM-dd HH:mm:ss").alias("chunk_start"), "n_stations")


def arrival_split(spark, sf_dir):
    e = station_events(spark, sf_dir).withColumn("ready_s", F.greatest(F.col("ready_s") - 1800, F.lit(0.0)))
    on_time, late = K.split_on_time(e)
    return on_time.union(late).groupBy(K.pool_of(F.col("ready_s")).alias("pool"), K.chunk_of(F.col("ready_s")).alias("chunk")).agg(F.count(F.lit(1)).alias("n"))


def dealt(spark, sf_dir):
    return K.round_robin(table(spark, sf_dir, "customer").select(F.col("c_name").alias("station")), 7)


def paced(spark, sf_dir):
    e = station_events(spark, sf_dir)
    feeds = e.groupBy(F.col("station").alias("stream"), F.pmod("event_id", F.lit(12)).cast("int").alias("feed_index")).agg(F.max((F.col("returned_s") - F.col("queued_s")) * 20).alias("work_s"))
    return rounded(K.paced(feeds, 60.0))


def launch_groups(spark, sf_dir):
    """Groups of each hour's early and late stations: five of them, or eight seconds after the oldest, or by the minute's end."""
    e = station_events(spark, sf_dir).withColumns({"station": F.col("event_id").cast("string"), "ready_s": F.round("ready_s", 3)})
    e = e.withColumn("pool", F.concat_ws("/", K.pool_of(F.col("ready_s") - 1800), F.col("chunk").cast("string")))
    g = K.batch_groups(e, "pool", 5, 8.0, drain=True)
    return rounded(g.select("pool", "fire_s", "n"))


def launch_groups_from_first(spark, sf_dir):
    e = station_events(spark, sf_dir).withColumns({"station": F.col("event_id").cast("string"), "ready_s": F.round(F.col("ready_s") % 60, 3)}).withColumn("pool", F.floor(F.col("event_id") / 40).cast("string"))
    return rounded(K.batch_groups(e, "pool", 5, 8.0, from_first=True).select("pool", "fire_s", "n"))


def arrival_schedule(spark, sf_dir):
    s = table(spark, sf_dir, "customer").select(F.col("c_name").alias("station"))
    return K.ready_times(s, 0.3, 7)


def stations_kept(spark, sf_dir):
    e = picks(spark, sf_dir).select(F.col("station").alias("sta"), "event_id")
    return readers.network_segments(e, table(spark, sf_dir, "supplier").select(F.format_string("S%04d", F.col("s_suppkey")).alias("station")))


def stations_common(spark, sf_dir):
    p = picks(spark, sf_dir)
    return p.filter("run = 'catalog'").select("station", "phase").intersect(p.filter("run = 'detected'").select("station", "phase"))


def channels_missing(spark, sf_dir):
    p = picks(spark, sf_dir)
    return p.filter("run = 'catalog'").select("station", "phase").exceptAll(p.filter("run = 'detected'").select("station", "phase"))


def station_union(spark, sf_dir):
    p = picks(spark, sf_dir)
    return p.filter("run = 'catalog'").select("station").union(p.filter("run = 'detected'").select("station")).distinct()


def distinct_traces(spark, sf_dir):
    t = traces(spark, sf_dir)
    return t.groupBy("station").agg(F.count_distinct("trace").alias("n_traces"))


def single_windows(spark, sf_dir):
    return traces(spark, sf_dir).select("trace", F.round(prep.total(prep.single_window(F.col("p"), 80)), 6).alias("s"))


QUERIES = {
    "J1_J4_time_texts": time_texts, "J5_J11_J12_durations": durations, "J7_J8_B6_model_labels": model_labels, "J9_J13_json_cells": json_cells, "B5_B17_B18_B20_trial_labels": trial_labels,
    "B15_B19_trial_states": trial_states, "F25_station_quality": station_quality, "F26_run_quality": run_quality, "F27_station_summary": station_summary, "F28_executive_summary": executive_summary,
    "B12_known_issues": known_issues, "B21_unsupported": unsupported, "A17_pick_file_rows": pick_file_rows, "A18_exported": exported, "A19_pick_lists": pick_lists, "A21_pick_log": pick_log,
    "A22_merged_summary": merged_summary, "A24_patched_records": patched_records, "A15_catalog_lists": catalog_lists, "A25_network_choice": network_choice, "A2_station_choice": station_choice,
    "A27_duplicated": duplicated, "K7_latencies": latencies, "K2_chunk_counts": chunk_counts, "K5_I4_arrival_split": arrival_split, "K6_dealt": dealt, "K8_paced": paced, "K3_launch_groups": launch_groups,
    "K4_launch_groups_from_first": launch_groups_from_first, "K1_arrival_schedule": arrival_schedule, "I2_stations_kept": stations_kept, "I3_stations_common": stations_common, "I5_channels_missing": channels_missing,
    "I1_station_union": station_union, "F30_distinct_traces": distinct_traces, "C14_single_windows": single_windows,
}

P = f"WITH {PICKS}"
E = f"WITH {STATION_EVENTS}"
REPORTS = """WITH r0 AS (SELECT 'S' || l_suppkey AS station, l_linenumber AS chunk_id, CASE WHEN l_partkey % 11 <> 0 THEN 40 END AS expected, CASE WHEN l_quantity > 3 THEN l_quantity::BIGINT ELSE 0 END AS decoded, l_tax > 0.07 AS a, l_discount > 0.08 AS b FROM lineitem),
 r AS (SELECT *, CASE WHEN decoded = 0 THEN 'FAILED' WHEN a OR decoded < expected THEN 'RECOVERED' ELSE 'CLEAN' END AS quality FROM r0),
 q AS (SELECT station, chunk_id, sum(expected)::BIGINT AS expected, sum(decoded)::BIGINT AS decoded, count(expected) < count(*) AS partial, concat_ws(',', CASE WHEN bool_or(a) THEN 'resync' END, CASE WHEN bool_or(b) THEN 'truncated' END) AS tags,
   count(*) FILTER (quality = 'FAILED') AS failed, count(*) AS files FROM r GROUP BY ALL),
 qt AS (SELECT *, CASE WHEN failed = files THEN 'FAILED' WHEN tags <> '' THEN replace(tags, ',', '; ') ELSE 'OK' END AS text FROM q),
 pk AS (SELECT 'S' || l_suppkey AS station, l_linenumber AS chunk_id, count(*) FILTER (l_linestatus = 'O') AS n_p, count(*) FILTER (l_linestatus <> 'O') AS n_s FROM lineitem WHERE l_linenumber > 1 GROUP BY ALL),
 s AS (SELECT qt.station, qt.chunk_id, coalesce(n_p, 0) AS n_p, coalesce(n_s, 0) AS n_s, text FROM qt LEFT JOIN pk ON qt.station = pk.station AND qt.chunk_id = pk.chunk_id)"""

def _drawn(*of: str) -> str:
    """SQL of a draw by a digest: the seed with its salt, then a column."""
    return f"(('0x' || substr(md5('{of[0]}/' || {of[1]}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"


def _groups(pool: str, ready: str, start: str, last: str) -> str:
    """SQL of launch groups: a fold over the sorted stations of each pool and minute."""
    due = f"least({start}, (minute + 1) * 60.0::DOUBLE)"
    return f"""WITH RECURSIVE {STATION_EVENTS}, ev AS (SELECT {pool} AS pool, {ready} AS t, event_id::VARCHAR AS s FROM station_events),
 g AS (SELECT pool, floor(t / 60) AS minute, list(struct_pack(t := t, s := s) ORDER BY t, s) AS r FROM ev GROUP BY ALL), ends AS (SELECT pool, max(t) AS last FROM ev GROUP BY pool),
 f AS (SELECT pool, minute, r, 0 AS k, []::STRUCT(t DOUBLE, s VARCHAR)[] AS q, NULL::DOUBLE AS fire_s, 0 AS n FROM g UNION ALL
   SELECT pool, minute, r, k + 1, CASE WHEN len(q1) >= 5 THEN [] ELSE q1 END, CASE WHEN over THEN due WHEN len(q1) >= 5 THEN e.t END, CASE WHEN over THEN len(q) WHEN len(q1) >= 5 THEN len(q1) ELSE 0 END FROM (
     SELECT *, CASE WHEN over THEN [e] ELSE list_append(q, e) END AS q1 FROM (SELECT *, r[k + 1] AS e, {due} AS due, len(q) > 0 AND {due} <= r[k + 1].t AS over FROM f WHERE k < len(r)))),
 done AS (SELECT pool, fire_s, n FROM f WHERE n > 0 UNION ALL SELECT f.pool, {last.format(due=due)}, len(q) FROM f JOIN ends ON f.pool = ends.pool WHERE k = len(r) AND len(q) > 0)
 SELECT pool, round(fire_s, 6) AS fire_s, n::INTEGER AS n FROM done"""


ORACLE_SQL = {
    "J1_J4_time_texts": f"{P} SELECT event_id, strftime(date_trunc('minute', t), '%Y%m%dT%H%M%SZ') || '_' || strftime(date_trunc('minute', t) + INTERVAL 1 MINUTE, '%Y%m%dT%H%M%SZ') AS chunk_id, 1.0::DOUBLE AS minutes, true AS same, strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS text, true AS back, false AS not_chunk, 'a_b_' || station || '_c' AS safe FROM picks",
    "J5_J11_J12_durations": f"{P}, s AS (SELECT *, floor(sample * 60)::BIGINT AS x FROM picks) SELECT event_id, (x // 86400) || ' Days ' || (x % 86400 // 3600) || ' Hrs ' || (x % 3600 // 60) || ' Min ' || (x % 60) || ' Sec' AS text, (floor(sample / 60) + 1) * 60 AS chunk_end, CASE WHEN phase = 'P' THEN ceil(floor(sample) / 7) ELSE 1 END::INTEGER AS group_size FROM s",
    "J7_J8_B6_model_labels": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'PhaseNet' ELSE p_type END || CASE WHEN p_partkey % 2 = 0 THEN '/' || CASE WHEN p_partkey % 3 = 0 THEN 'stead' ELSE p_brand END ELSE '' END AS label, CASE WHEN p_partkey % 3 = 0 THEN 'stead' ELSE p_brand END AS child, CASE WHEN p_size = 30 THEN '0.3' ELSE 'P ' || regexp_replace(regexp_replace(printf('%.6f', p_size / 100.0::DOUBLE), '0+$', ''), '\\.$', '') || ' / S 0.3' END AS threshold, CASE p_type WHEN 'ECONOMY' THEN 'cheap' WHEN 'SMALL' THEN 'little' ELSE 'other' END AS kind FROM part",
    "J9_J13_json_cells": "SELECT event_id, CASE event_id % 5 WHEN 1 THEN user_id::VARCHAR WHEN 2 THEN 'true' WHEN 3 THEN '\"' || event_type || '\"' ELSE 'null' END AS json, user_id || ',1' AS gpus, (props->>'$.k')::DOUBLE AS k FROM events",
    "B5_B17_B18_B20_trial_labels": "WITH t AS (SELECT *, l_quantity / 10 AS picker, l_discount + l_tax AS busy, floor(l_quantity / 2)::INTEGER AS got FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws('/', CASE WHEN l_linenumber = 1 THEN 'baseline' ELSE l_returnflag END, 'bf16', CASE WHEN l_linestatus = 'O' THEN 'compiled' END, CASE WHEN l_quantity > 25 THEN 'w' || (l_quantity - 25)::INTEGER END, 't' || l_linenumber) AS label, round(greatest(0, 10 - picker - 3), 6) AS framework, round(CASE WHEN busy > 0 THEN picker * l_discount / busy ELSE picker END, 6) AS inference, round(CASE WHEN busy > 0 THEN picker * l_tax / busy ELSE 0 END, 6) AS preprocess, (l_linenumber <> 7 AND got >= 20) AS ok, CASE WHEN l_linenumber = 7 THEN 'boom' WHEN got = 0 THEN 'no stations returned' WHEN got < 20 THEN got || ' of 20 stations returned' END AS reason, CASE WHEN l_quantity * 200 >= 6000 THEN 'single' ELSE 'sliding' END AS regime FROM t",
    "B15_B19_trial_states": "SELECT l_orderkey, CASE WHEN l_orderkey % 10 = 0 THEN 'skipped' WHEN count(*) FILTER (l_discount < 0.05) >= 3 THEN 'complete' WHEN count(*) FILTER (l_discount < 0.05) > 0 THEN 'partial' ELSE 'empty' END AS state, round(100 * avg(l_quantity / (l_quantity + l_linenumber)), 6) AS utilisation FROM lineitem GROUP BY l_orderkey",
    "F25_station_quality": f"{REPORTS} SELECT station, chunk_id, expected, decoded, partial, tags, failed, files, text FROM qt",
    "F26_run_quality": f"{REPORTS} SELECT chunk_id, count(*) FILTER (quality = 'CLEAN') AS clean, count(*) FILTER (quality = 'RECOVERED') AS recovered, count(*) FILTER (quality = 'FAILED') AS failed, count(*) AS files, sum(decoded)::BIGINT AS decoded FROM r GROUP BY chunk_id",
    "F27_station_summary": f"{REPORTS} SELECT * FROM s",
    "F28_executive_summary": f"{REPORTS}, g AS (SELECT station, sum(n_p)::BIGINT AS n_p, sum(n_s)::BIGINT AS n_s, arg_min('m' || chunk_id, chunk_id) FILTER (chunk_id > 2) AS label, list(chunk_id::VARCHAR ORDER BY chunk_id::VARCHAR) FILTER (text <> 'OK') AS bad FROM s GROUP BY station) SELECT station, n_p, n_s, label, coalesce(array_to_string(bad[1:3], ', '), '') || CASE WHEN len(bad) > 3 THEN ' +' || (len(bad) - 3) || ' more' ELSE '' END AS bad_chunks FROM g",
    "B12_known_issues": "SELECT DISTINCT o_custkey AS station, o_orderstatus AS chunk_id, c_mktsegment AS issue FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_acctbal < 0",
    "B21_unsupported": "SELECT p_partkey, p_type AS model, p_brand AS dtype, CASE WHEN p_type = 'ECONOMY' AND p_brand = 'Brand#2' THEN 'no fp16' WHEN p_brand = 'Brand#4' THEN 'no playback' END AS skip_reason, CASE WHEN (p_type = 'ECONOMY' AND p_brand = 'Brand#2') OR p_brand = 'Brand#4' THEN 'skipped' ELSE 'planned' END AS benchmark_status FROM part",
    "A17_pick_file_rows": f"{P} SELECT station AS file_name, 'SB' AS network, station, '0' AS instrument_type, 0.0::DOUBLE AS station_lat, 0.0::DOUBLE AS station_lon, 0.0::DOUBLE AS station_elv, CASE WHEN phase = 'P' THEN strftime(t, '%Y-%m-%d %H:%M:%S.%f') ELSE '' END AS p_arrival_time, CASE WHEN phase = 'P' THEN printf('%.6f', prob) ELSE '' END AS p_probability, CASE WHEN phase = 'S' THEN strftime(t, '%Y-%m-%d %H:%M:%S.%f') ELSE '' END AS s_arrival_time, CASE WHEN phase = 'S' THEN printf('%.6f', prob) ELSE '' END AS s_probability FROM picks",
    "A18_exported": f"{P}, d AS (SELECT *, row_number() OVER (PARTITION BY station, phase ORDER BY t) AS rn FROM picks), b AS (SELECT coalesce(p.station, s.station) AS station, coalesce(p.rn, s.rn) AS rn, p.t AS p_time, s.t AS s_time FROM (SELECT * FROM d WHERE phase = 'P') p FULL JOIN (SELECT * FROM d WHERE phase = 'S') s ON p.station = s.station AND p.rn = s.rn), st AS (SELECT printf('S%04d', s_suppkey) AS station FROM supplier UNION SELECT station FROM d) SELECT st.station, rn::INTEGER AS rn, strftime(p_time, '%Y-%m-%d %H:%M:%S') AS p_time, strftime(s_time, '%Y-%m-%d %H:%M:%S') AS s_time FROM st LEFT JOIN b ON st.station = b.station",
    "A19_pick_lists": f"{P} SELECT station, count(*) FILTER (phase = 'P')::INTEGER AS n_p, count(*) FILTER (phase = 'S')::INTEGER AS n_s, round(min(sample) FILTER (phase = 'P'), 3) AS first_p, round(max(sample) FILTER (phase = 'S'), 3) AS last_s FROM picks GROUP BY station",
    "A21_pick_log": f"{P} SELECT station, row_number() OVER (PARTITION BY station ORDER BY t, phase)::INTEGER AS place, strftime(t, '%Y-%m-%d %H:%M:%S.%f') || phase AS line FROM picks",
    "A22_merged_summary": "SELECT c_custkey AS k, round(coalesce((SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey), c_acctbal), 6) AS v FROM customer",
    "A24_patched_records": "WITH r AS (SELECT l_orderkey AS trial, l_linenumber::BIGINT * 10000000000 + l_partkey * 10000 + l_suppkey AS seq, CASE WHEN l_discount > 0.05 THEN l_quantity END AS a, CASE WHEN l_tax < 0.03 THEN l_extendedprice END AS b FROM lineitem) SELECT trial, round(arg_max(a, seq) FILTER (a IS NOT NULL), 6) AS a, round(arg_max(b, seq) FILTER (b IS NOT NULL), 6) AS b FROM r GROUP BY trial",
    "A15_catalog_lists": f"{P} SELECT station, phase, round(sample, 3) AS sample FROM picks",
    "A25_network_choice": "WITH t AS (SELECT vec_id AS trace, (vec_id % 7000)::DOUBLE AS p, (vec_id % 5000 + 100)::DOUBLE AS s FROM embeddings) SELECT * FROM t WHERE p >= 20 AND p < 4000 AND s >= 20 AND s < 4000 ORDER BY md5('42/' || trace), trace LIMIT 50",
    "A2_station_choice": "SELECT c_name AS station FROM customer ORDER BY c_name LIMIT 20",
    "A27_duplicated": "SELECT vec_id AS trace, c::INTEGER AS copy, 'S000' || c AS sta FROM embeddings, range(3) g(c)",
    "K7_latencies": f"{E}, t AS (SELECT floor(event_id / 4) AS task_id, max(queued_s) AS q, max(returned_s) AS r, sum(returned_s - queued_s) AS inf, count(*) AS n FROM station_events GROUP BY 1) SELECT event_id::VARCHAR AS station, task_id::BIGINT AS task_id, n::INTEGER AS n_in_group, round(ready_s, 6) AS ready_s, round(r - ready_s, 6) AS e2e_s, round(q - ready_s, 6) AS queue_s, round(r - q, 6) AS service_s, round(inf / n, 6) AS inference_share_s FROM station_events JOIN t ON floor(event_id / 4) = task_id",
    "K2_chunk_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS chunk_start, count(*) AS n_stations FROM events GROUP BY 1",
    "K5_I4_arrival_split": f"{E}, r AS (SELECT greatest(ready_s - 1800, 0) AS x FROM station_events) SELECT CASE WHEN x <= 0 THEN 'ontime' ELSE 'delayed' END AS pool, floor(x / 60)::INTEGER AS chunk, count(*) AS n FROM r GROUP BY ALL",
    "K6_dealt": "SELECT c_name AS station, ((row_number() OVER (ORDER BY c_name) - 1) % 7)::INTEGER AS worker FROM customer",
    "K8_paced": f"""WITH RECURSIVE {STATION_EVENTS}, f AS (SELECT station AS stream, (event_id % 12)::INTEGER AS feed_index, max((returned_s - queued_s) * 20) AS work_s FROM station_events GROUP BY ALL),
 o AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY feed_index) AS k FROM f),
 g AS (SELECT stream, feed_index, k, feed_index * 60.0::DOUBLE AS due_s, feed_index * 60.0::DOUBLE AS start_s, feed_index * 60.0::DOUBLE + work_s AS end_s, 0.0::DOUBLE AS before FROM o WHERE k = 1
   UNION ALL SELECT o.stream, o.feed_index, o.k, o.feed_index * 60.0::DOUBLE, greatest(o.feed_index * 60.0::DOUBLE, g.end_s), greatest(o.feed_index * 60.0::DOUBLE, g.end_s) + o.work_s, g.end_s FROM g JOIN o ON o.stream = g.stream AND o.k = g.k + 1)
 SELECT stream, feed_index, due_s, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, round(greatest(due_s - before, 0), 6) AS wait_s, round(greatest(start_s - due_s, 0), 6) AS late_s FROM g""",
    "K1_arrival_schedule": f"SELECT c_name AS station, CASE WHEN {_drawn('7/late', 'c_name')} < 0.3::DOUBLE THEN [0, 5, 10, 15, 20, 25, 30, 60, 65, 90][floor({_drawn('7/delay', 'c_name')} * 10)::INTEGER + 1] ELSE 0 END::DOUBLE AS ready_s FROM customer",
    "K3_launch_groups": _groups("CASE WHEN round(ready_s, 3) <= 1800 THEN 'ontime' ELSE 'delayed' END || '/' || chunk", "round(ready_s, 3)", "q[1].t + 8", "least({due}, last)"),
    "K4_launch_groups_from_first": _groups("(event_id // 40)::VARCHAR", "round(ready_s % 60, 3)", "greatest(r[1].t + 8, q[1].t)", "{due}"),
    "I2_stations_kept": f"{P} SELECT station AS sta, event_id FROM picks WHERE station IN (SELECT printf('S%04d', s_suppkey) FROM supplier)",
    "I3_stations_common": f"{P} SELECT station, phase FROM picks WHERE run = 'catalog' INTERSECT SELECT station, phase FROM picks WHERE run = 'detected'",
    "I5_channels_missing": f"{P} SELECT station, phase FROM picks WHERE run = 'catalog' EXCEPT ALL SELECT station, phase FROM picks WHERE run = 'detected'",
    "I1_station_union": f"{P} SELECT station FROM picks WHERE run = 'catalog' UNION SELECT station FROM picks WHERE run = 'detected'",
    "F30_distinct_traces": "SELECT printf('S%04d', label) AS station, count(DISTINCT vec_id) AS n_traces FROM embeddings GROUP BY 1",
    "C14_single_windows": "SELECT vec_id AS trace, round(list_sum(embedding::DOUBLE[]), 6) AS s FROM embeddings",
}
