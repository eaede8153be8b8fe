"""Queries over picks and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from quakeframe.functions import scalars as S
from quakeframe.operators import matching, metrics
from quakeframe.plans.stand_ins import PICKS, TRACES, picks, rounded, table, traces

TOLERANCE = 600.0


def _sides(spark, sf_dir):
    p = picks(spark, sf_dir)
    return p.filter("run = 'catalog'"), p.filter("run = 'detected'")


def greedy_match(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return rounded(matching.match_picks(a, b, ["station", "phase"], TOLERANCE), 9)


def pick_sets(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    judged = matching.compare_pick_sets(a, b, TOLERANCE)
    return judged.groupBy("station", "phase", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("delta"), 6).alias("sum_delta"))


def pick_scores(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return rounded(metrics.phase_metrics(matching.compare_pick_sets(a, b, TOLERANCE), ["phase"]))


def pick_drift(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return rounded(metrics.pick_drift(matching.match_picks(a, b, ["station", "phase"], TOLERANCE), ["phase"]))


def _first_catalog(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    key = F.concat_ws("/", "station", "phase")
    catalog = a.groupBy(key.alias("trace")).agg(F.min("sample").alias("catalog"))
    listed = b.select(key.alias("trace"), F.col("event_id").alias("pos"), "sample")
    return catalog, listed


def catalog_first_hit(spark, sf_dir):
    return rounded(matching.first_hits(*_first_catalog(spark, sf_dir), "trace", 5 * TOLERANCE))


def trace_detection_totals(spark, sf_dir):
    hits = matching.first_hits(*_first_catalog(spark, sf_dir), "trace", 5 * TOLERANCE)
    return rounded(metrics.detection_totals(hits.withColumn("phase", F.substring_index("trace", "/", -1)), ["phase"]))


def _deltas(spark, sf_dir):
    p = picks(spark, sf_dir)
    return p.select("phase", "run", "station", ((F.col("prob") * 100) - 25).alias("delta"), "event_id")


def delta_statistics(spark, sf_dir):
    return rounded(metrics.delta_statistics(_deltas(spark, sf_dir), ["phase", "run"]))


def delta_cumulative(spark, sf_dir):
    return rounded(metrics.cumulative_share(_deltas(spark, sf_dir), ["phase"]))


def delta_histogram(spark, sf_dir):
    d = _deltas(spark, sf_dir).withColumn("ms", F.col("delta") * 10)
    return metrics.histogram(d, ["phase"], "ms", -500.0, 500.0, 50)


def station_name_match(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("nt."), F.lower("s_name"), F.lit("-"), F.col("s_nationkey").cast("string")).alias("trace_id"))
    wanted = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("station"))
    return matching.match_stations(s, wanted)


def method_agreement(spark, sf_dir):
    d = picks(spark, sf_dir).select("station", F.floor("sample").alias("minute"), F.concat_ws("/", "run", "phase").alias("method"), (F.col("prob") * 20).alias("delta"))
    one = d.groupBy("station", F.floor(F.col("minute") / 1440).alias("day"), "method").agg(F.avg("delta").alias("delta"))
    return rounded(matching.agreement(one, ["station", "day"], 2.0), 4)


def probability_drift(spark, sf_dir):
    t = traces(spark, sf_dir)
    a = t.select((F.col("trace") - F.col("trace") % 2).alias("pair"), "p", (F.col("trace") % 2).alias("side"))
    rows = metrics.exploded_pairs(a.filter("side = 0"), a.filter("side = 1"), ["pair"], "p")
    return rounded(metrics.probability_drift(rows, ["pair"], "a", "b"))


def pick_projection(spark, sf_dir):
    p = picks(spark, sf_dir)
    t0 = F.lit("2024-01-01").cast("timestamp")
    sample = S.to_sample(F.col("t"), t0, 100.0)
    return p.select(
        "event_id", F.round(sample, 4).alias("at_100_hz"), S.to_time(sample, t0, 100.0).cast("string").substr(1, 19).alias("back"), S.chunk_index(F.col("sample")).alias("chunk"),
        S.in_range(F.col("sample"), 1000.0, 30000.0).alias("usable"), S.finite_int(F.col("prob") * 1000).alias("milli"),
    )


def catalog_mask(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.try_divide(F.col("value"), F.col("user_id") % 3).alias("p"))
    return rounded(e.filter(S.is_finite(F.col("p"))))


QUERIES = {
    "E1_greedy_match": greedy_match, "E2_pick_sets": pick_sets, "pick_scores": pick_scores, "F5_pick_drift": pick_drift, "E4_catalog_first_hit": catalog_first_hit,
    "F2_detection_totals": trace_detection_totals, "F3_delta_statistics": delta_statistics, "F46_delta_cumulative": delta_cumulative, "F47_delta_histogram": delta_histogram,
    "E5_station_names": station_name_match, "E15_method_agreement": method_agreement, "F4_probability_drift": probability_drift, "B9_pick_projection": pick_projection, "B1_catalog_mask": catalog_mask,
}

#: The greedy rule, one catalog pick at a time in order, for each station and phase.
GREEDY = f"""WITH RECURSIVE {PICKS},
ga AS (SELECT station, phase, list(sample ORDER BY sample) AS a FROM picks WHERE run = 'catalog' GROUP BY ALL),
gb AS (SELECT station, phase, list(sample ORDER BY sample) AS b FROM picks WHERE run = 'detected' GROUP BY ALL),
g AS (SELECT coalesce(ga.station, gb.station) AS station, coalesce(ga.phase, gb.phase) AS phase, coalesce(a, []) AS a, coalesce(b, []) AS b
      FROM ga FULL JOIN gb ON ga.station = gb.station AND ga.phase = gb.phase),
fold AS (
  SELECT station, phase, a, b, 0 AS i, []::BIGINT[] AS used, NULL::DOUBLE AS a_value, NULL::BIGINT AS j FROM g
  UNION ALL
  SELECT station, phase, a, b, i + 1, CASE WHEN j IS NULL THEN used ELSE list_append(used, j) END, a_value, j FROM (
    SELECT f.station, f.phase, f.a, f.b, f.i, f.used, f.a[f.i + 1] AS a_value,
           (list_min(list_transform(list_filter(range(1, len(f.b) + 1), lambda k: abs(f.b[k] - f.a[f.i + 1]) <= {TOLERANCE} AND NOT list_contains(f.used, k)),
                                    lambda k: {{'d': abs(f.b[k] - f.a[f.i + 1]), 'k': k}}))).k AS j
    FROM fold f WHERE f.i < len(f.a))),
ends AS (SELECT station, phase, b, used FROM fold WHERE i = len(a)),
sides AS (SELECT station, phase, a_value, CASE WHEN j IS NULL THEN NULL ELSE b[j] END AS b_value, CASE WHEN j IS NULL THEN 'a' ELSE 'pair' END AS side FROM fold WHERE i > 0
          UNION ALL SELECT station, phase, NULL, b[k], 'b' FROM (SELECT station, phase, b, used, unnest(range(1, len(b) + 1)) AS k FROM ends) WHERE NOT list_contains(used, k))"""

JUDGED = f"""{GREEDY},
cat AS (SELECT station, phase, sample AS c FROM picks WHERE run = 'catalog'),
judged AS (SELECT s.station, s.phase, CASE side WHEN 'pair' THEN 'matched' WHEN 'a' THEN 'missing'
             ELSE CASE WHEN EXISTS (SELECT 1 FROM cat WHERE cat.station = s.station AND cat.phase = s.phase AND abs(cat.c - s.b_value) <= {TOLERANCE}) THEN 'duplicated' ELSE 'additional' END END AS kind,
             CASE WHEN side = 'pair' THEN b_value - a_value END AS delta
           FROM sides s WHERE side <> 'b' OR EXISTS (SELECT 1 FROM cat WHERE cat.station = s.station AND cat.phase = s.phase))"""

HITS = f"""WITH {PICKS},
cat AS (SELECT station || '/' || phase AS trace, min(sample) AS catalog FROM picks WHERE run = 'catalog' GROUP BY 1),
det AS (SELECT station || '/' || phase AS trace, event_id AS pos, sample FROM picks WHERE run = 'detected'),
hits AS (SELECT c.trace, 1 AS n_catalog, count(sample)::INTEGER AS n_detected, least(1, count(*) FILTER (abs(sample - catalog) <= {5 * TOLERANCE}))::INTEGER AS n_matched,
   (1 - least(1, count(*) FILTER (abs(sample - catalog) <= {5 * TOLERANCE})))::INTEGER AS n_missing,
   (count(sample) - count(*) FILTER (abs(sample - catalog) <= {5 * TOLERANCE}))::INTEGER AS n_additional,
   greatest(count(*) FILTER (abs(sample - catalog) <= {5 * TOLERANCE}) - 1, 0)::INTEGER AS n_duplicates,
   arg_min(sample - catalog, pos) FILTER (abs(sample - catalog) <= {5 * TOLERANCE}) AS delta
  FROM cat c LEFT JOIN det d ON c.trace = d.trace GROUP BY c.trace)"""

DELTAS = f"WITH {PICKS}, deltas AS (SELECT phase, run, station, prob * 100 - 25 AS delta, event_id FROM picks)"


def _stats(prefix: str, scale: str) -> str:
    return f"round(avg(delta) * {scale}, 6) AS mean_{prefix}, round(median(delta) * {scale}, 6) AS median_{prefix}, round(stddev_pop(delta) * {scale}, 6) AS std_{prefix}, " + ", ".join(
        f"round(quantile_cont(abs(delta), {q / 100}) * {scale}, 6) AS p{q}_{prefix}" for q in (50, 95, 99)
    )


ORACLE_SQL = {
    "E1_greedy_match": f"{GREEDY} SELECT station, phase, round(a_value, 9) AS a_value, round(b_value, 9) AS b_value, side FROM sides",
    "E2_pick_sets": f"{JUDGED} SELECT station, phase, kind, count(*) AS n, round(sum(delta), 6) AS sum_delta FROM judged GROUP BY ALL",
    "pick_scores": f"""{JUDGED}, m AS (SELECT phase, count(DISTINCT station) AS n_catalog, count(*) FILTER (kind <> 'missing') AS n_detected, count(*) FILTER (kind = 'matched') AS matched,
 count(*) FILTER (kind = 'missing') AS missing, count(*) FILTER (kind = 'additional') AS additional, count(*) FILTER (kind = 'duplicated') AS duplicated, round(avg(delta), 6) AS mean_dt,
 round(median(delta), 6) AS median_dt, round(CASE WHEN count(delta) = 1 THEN 0 ELSE stddev_samp(delta) END, 6) AS std_dt, round(quantile_cont(abs(delta), 0.5), 6) AS p50_abs_dt,
 round(quantile_cont(abs(delta), 0.95), 6) AS p95_abs_dt, round(quantile_cont(abs(delta), 0.99), 6) AS p99_abs_dt, round(avg(CASE WHEN abs(delta) <= 1 THEN 1.0 WHEN delta IS NOT NULL THEN 0.0 END), 6) AS frac_within_1,
 round(avg(CASE WHEN abs(delta) <= 5 THEN 1.0 WHEN delta IS NOT NULL THEN 0.0 END), 6) AS frac_within_5, round(avg(CASE WHEN abs(delta) <= 10 THEN 1.0 WHEN delta IS NOT NULL THEN 0.0 END), 6) AS frac_within_10
 FROM judged GROUP BY phase), r AS (SELECT *, matched / nullif(matched + additional, 0)::DOUBLE AS p, matched / nullif(matched + missing, 0)::DOUBLE AS q FROM m)
 SELECT * EXCLUDE (p, q), round(p, 6) AS precision, round(q, 6) AS recall, round(2 * p * q / nullif(p + q, 0), 6) AS f1 FROM r""",
    "F5_pick_drift": f"""{GREEDY} SELECT phase, count(*) FILTER (side = 'pair') AS n_pairs, count(*) FILTER (side = 'a') AS n_missing_b, count(*) FILTER (side = 'b') AS n_missing_a,
 round(avg(a_value - b_value), 6) AS mean_delta, round(median(a_value - b_value), 6) AS median_delta, round(quantile_cont(abs(a_value - b_value), 0.95), 6) AS p95_abs_delta,
 round(max(abs(a_value - b_value)), 6) AS max_abs_delta FROM sides GROUP BY phase""",
    "E4_catalog_first_hit": f"{HITS} SELECT * EXCLUDE (delta), round(delta, 6) AS delta FROM hits",
    "F2_detection_totals": f"""{HITS}, t AS (SELECT split_part(trace, '/', 2) AS phase, count(*) AS n_traces, sum(n_catalog)::BIGINT AS total_catalog, sum(n_detected)::BIGINT AS total_detected, sum(n_matched)::BIGINT AS total_matched,
 sum(n_missing)::BIGINT AS total_missing, sum(n_additional)::BIGINT AS total_additional, sum(n_duplicates)::BIGINT AS total_duplicates FROM hits GROUP BY 1),
 r AS (SELECT *, coalesce(total_matched / nullif(total_detected, 0)::DOUBLE, 0) AS p, coalesce(total_matched / nullif(total_catalog, 0)::DOUBLE, 0) AS q FROM t)
 SELECT * EXCLUDE (p, q), round(p, 6) AS precision, round(q, 6) AS recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 6) AS f1 FROM r""",
    "F3_delta_statistics": f"""{DELTAS} SELECT phase, run, count(delta) AS n, {_stats("samples", "1")}, {_stats("ms", "10")},
 {", ".join(f"round(avg(CASE WHEN abs(delta) <= {b} THEN 100.0 ELSE 0 END), 6) AS pct_within_{b}" for b in (1, 5, 10))} FROM deltas GROUP BY phase, run""",
    "F46_delta_cumulative": f"{DELTAS} SELECT phase, t::INTEGER AS tolerance, round(avg(CASE WHEN abs(delta) <= t THEN 100.0 ELSE 0 END), 6) AS pct FROM deltas, range(51) g(t) GROUP BY phase, t",
    "F47_delta_histogram": f"""{DELTAS}, grid AS (SELECT DISTINCT phase, b::INTEGER AS bin FROM deltas, range(50) g(b)),
 c AS (SELECT phase, least(floor((delta * 10 + 500) * 50 / 1000)::INTEGER, 49) AS bin, count(*) AS n FROM deltas WHERE delta * 10 BETWEEN -500 AND 500 GROUP BY ALL)
 SELECT grid.phase, grid.bin, coalesce(n, 0) AS n FROM grid LEFT JOIN c ON grid.phase = c.phase AND grid.bin = c.bin""",
    "E5_station_names": """WITH s AS (SELECT 'nt.' || lower(s_name) || '-' || s_nationkey AS trace_id, upper(lower(s_name) || '-' || s_nationkey) AS sta FROM supplier),
 names AS (SELECT trace_id, unnest([sta, 'NT_' || sta, 'NT.' || sta] || regexp_split_to_array(sta, '[-_]')) AS name FROM s)
 SELECT DISTINCT trace_id, s_name AS station FROM names JOIN supplier ON name = upper(s_name)""",
    "E15_method_agreement": f"""WITH {PICKS}, one AS (SELECT station, floor(floor(sample) / 1440) AS day, run || '/' || phase AS method, avg(prob * 20) AS delta FROM picks GROUP BY ALL)
 SELECT a.method AS method_a, b.method AS method_b, round(avg(CASE WHEN abs(a.delta - b.delta) <= 2 THEN 100.0 ELSE 0 END), 4) AS pct FROM one a JOIN one b ON a.station = b.station AND a.day = b.day GROUP BY ALL""",
    "F4_probability_drift": f"""WITH {TRACES}, s AS (SELECT trace - trace % 2 AS pair, trace % 2 AS side, unnest(p) AS v, unnest(range(len(p))) AS i FROM traces),
 z AS (SELECT a.pair, a.v AS x, b.v AS y FROM s a JOIN s b ON a.pair = b.pair AND a.i = b.i AND a.side = 0 AND b.side = 1 WHERE isfinite(a.v) AND isfinite(b.v))
 SELECT pair, round(avg(abs(x - y)), 6) AS mae, round(max(abs(x - y)), 6) AS max_abs_err, round(sqrt(avg((x - y) * (x - y))), 6) AS rmse, count(*) AS n_samples,
 round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) AS pearson FROM z GROUP BY pair""",
    "B9_pick_projection": f"""WITH {PICKS} SELECT event_id, round((epoch_us(t) - epoch_us(TIMESTAMP '2024-01-01')) / 10000.0::DOUBLE, 4) AS at_100_hz, strftime(t, '%Y-%m-%d %H:%M:%S') AS back,
 floor(sample / 60)::INTEGER AS chunk, (sample >= 1000 AND sample < 30000) AS usable, round_even(prob * 1000, 0)::INTEGER AS milli FROM picks""",
    "B1_catalog_mask": "SELECT event_id, round(value / (user_id % 3), 6) AS p FROM events WHERE user_id % 3 <> 0",
}
