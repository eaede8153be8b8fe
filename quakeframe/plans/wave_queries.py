"""Queries over waveforms, windows and probability traces; embeddings play traces of 64 samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from quakeframe.operators import conditioning as C
from quakeframe.operators import picks as K
from quakeframe.operators import prep as P
from quakeframe.plans.stand_ins import PICKS, START, TRACES, picks, rounded, table, traces
from quakeframe.streaming import stations as A


def _sum(c):
    return F.round(P.total(c), 6)


def segments(spark, sf_dir):
    """Segments of 6.4 s at 10 Hz; channels of a station start at slightly different times and overlap."""
    t = traces(spark, sf_dir)
    us = F.unix_micros(F.lit(START + " 00:00:00").cast("timestamp")) + F.col("trace") * 3000000 + (F.col("trace") % 3) * 100000
    letter = F.element_at(F.array(*[F.lit(x) for x in "ZNE12"]), (F.col("trace") % 5 + 1).cast("int"))
    return t.select(F.lit("SB").alias("net"), "station", F.col("station").alias("sta"), F.lit("").alias("loc"), F.concat(F.lit("HH"), letter).alias("cha"), F.timestamp_micros(us).alias("start"), F.lit(10.0).alias("sr"), F.col("p").alias("samples"), "trace")


def windows(spark, sf_dir):
    w = P.sliding_windows(traces(spark, sf_dir), "p", 25, 7)
    return w.select("trace", "win_idx", "w_start", _sum(F.col("window")).alias("s"), F.size("window").alias("n"))


def long_windows(spark, sf_dir):
    w = P.sliding_windows(traces(spark, sf_dir), "p", 100)
    return w.select("trace", "win_idx", "w_start", _sum(F.col("window")).alias("s"), F.size("window").alias("n"))


def window_counts(spark, sf_dir):
    return P.sliding_windows(traces(spark, sf_dir), "p", 25, 7).groupBy("station").agg(F.count(F.lit(1)).alias("n_windows"))


def stepped(spark, sf_dir):
    w = P.stepped_windows(traces(spark, sf_dir), "p", 20, 5.0, 1 / 60)
    return w.select("trace", "win_idx", "w_start", _sum(F.col("window")).alias("s"))


def centred(spark, sf_dir):
    t = traces(spark, sf_dir).withColumn("pick", (F.col("trace") * 7 % 80).cast("int"))
    return P.centred_window(t, "p", "pick", 21).select("trace", "w_start", "pick_in_window", _sum(F.col("window")).alias("s"))


def shaped(spark, sf_dir):
    t = traces(spark, sf_dir)
    at = lambda x, i: F.round(F.get(x, F.lit(i)), 6)
    return t.select(
        "trace", at(P.demean(F.col("p")), 5).alias("demeaned"), at(P.taper(F.col("p"), F.lit(2.0)), 3).alias("tapered"), _sum(P.taper(F.col("p"), F.lit(2.0))).alias("taper_sum"),
        at(P.normalise(F.col("p")), 7).alias("by_std"), at(P.normalise(F.col("p"), "max"), 7).alias("by_max"),
    )


def resampled(spark, sf_dir):
    r = P.resample(F.col("p"), F.lit(100.0), 40.0)
    return traces(spark, sf_dir).select("trace", F.size(r).alias("n"), F.round(F.get(r, F.lit(1)), 6).alias("second"), _sum(r).alias("s"))


def snr(spark, sf_dir):
    t = traces(spark, sf_dir).withColumn("pick", (F.col("trace") % 64).cast("int"))
    positive = F.transform("p", lambda v: F.abs(v) + 0.01)
    return t.withColumn("q", positive).select("trace", "pick", P.signal_to_noise(F.col("q"), F.col("pick"), 10).alias("snr"))


def aligned(spark, sf_dir):
    a = P.aligned_prediction(F.col("p"), (F.col("trace") % 40 - 20).cast("int"), 50)
    return traces(spark, sf_dir).select("trace", _sum(a).alias("s"), F.round(F.get(a, F.lit(0)), 6).alias("first"))


def chunk_grid(spark, sf_dir):
    s = picks(spark, sf_dir).groupBy("station").agg(F.date_trunc("hour", F.min("t")).alias("start"), F.date_trunc("hour", F.max("t")).alias("end"))
    g = P.chunk_grid(s, 720, 30)
    t0 = F.unix_micros(F.lit(START).cast("timestamp"))
    return g.select("station", "chunk_no", ((F.unix_micros("t_start") - t0) / 60000000).cast("long").alias("from_min"), ((F.unix_micros("t_end") - t0) / 60000000).cast("long").alias("to_min"))


def chunk_cut(spark, sf_dir):
    s = segments(spark, sf_dir)
    end = s.agg(F.max("start").alias("m"))
    grid = end.select(F.lit(START).cast("timestamp").alias("start"), (F.col("m") + F.expr("INTERVAL 10 SECONDS")).alias("end"))
    chunks = P.chunk_grid(grid, 1.0).select(F.col("chunk_no").alias("chunk_id"), "t_start", "t_end")
    c = P.cut_into_chunks(s, chunks, 1.0)
    return c.groupBy("sta", "chunk_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.size("samples")).alias("n"))


def merged(spark, sf_dir):
    s = segments(spark, sf_dir).withColumn("cha", F.lit("HHZ"))
    m = P.merge_segments(s, 30.0)
    t0 = F.unix_micros(F.lit(START).cast("timestamp"))
    return m.select("sta", ((F.unix_micros("start") - t0) / 100000).cast("long").alias("first"), F.size("samples").alias("n"), _sum(F.col("samples")).alias("s"))


def _stations(spark, sf_dir):
    s = segments(spark, sf_dir).withColumn("group", F.floor(F.col("trace") / 5))
    return s.withColumn("start", F.timestamp_micros(F.unix_micros(F.lit(START).cast("timestamp")) + (F.col("trace") % 3) * 100000))


def strict_common(spark, sf_dir):
    c = P.common_interval(P.strict_components(_stations(spark, sf_dir), ["group"]))
    t0 = F.unix_micros(F.lit(START).cast("timestamp"))
    return c.select("group", ((F.unix_micros("start") - t0) / 100000).cast("long").alias("first"), *[_sum(F.get("xs", F.lit(i))).alias(f"s{i}") for i in range(3)], F.size(F.get("xs", F.lit(0))).alias("n"))


def strict_union(spark, sf_dir):
    c = P.union_interval(P.strict_components(_stations(spark, sf_dir), ["group"], "ENZ"))
    return c.select("group", *[_sum(F.get("xs", F.lit(i))).alias(f"s{i}") for i in range(3)], F.size(F.get("xs", F.lit(0))).alias("n"))


def lenient(spark, sf_dir):
    letter = F.element_at(F.array(*[F.lit(x) for x in "ZNEZN"]), (F.col("trace") % 5 + 1).cast("int"))
    s = segments(spark, sf_dir).withColumns({"cha": F.concat(F.lit("HH"), letter), "group": F.floor(F.col("trace") / 3)})
    return P.lenient_components(s, ["group"])


def component_traces(spark, sf_dir):
    c = P.common_interval(P.strict_components(_stations(spark, sf_dir), ["group"]))
    return P.to_traces(c.select("group", "xs"), "xs").select("group", "cha", _sum(F.col("samples")).alias("s"))


def read_window(spark, sf_dir):
    """Minutes 1 to 10 of every hour."""
    s = segments(spark, sf_dir)
    hour = F.date_trunc("hour", "start")
    w = P.in_window(s, hour + F.expr("INTERVAL 1 MINUTE"), hour + F.expr("INTERVAL 10 MINUTES"))
    return w.select("trace", F.size("samples").alias("n"), _sum(F.col("samples")).alias("s"))


def span(spark, sf_dir):
    return rounded(P.archive_span(segments(spark, sf_dir)))


def filtered(spark, sf_dir):
    s = P.filter_parameters(segments(spark, sf_dir), segments(spark, sf_dir).select("sta").distinct().select("sta", F.when(F.col("sta") < "S0005", 0.5).alias("hp"), F.when(F.col("sta") < "S0007", 2.0).alias("lp")), 0.2, 4.0)
    return C.filter_waveforms(s).select("trace", "fmin", "fmax", F.round(F.get("samples", F.lit(9)), 6).alias("tenth"), _sum(F.transform("samples", F.abs)).alias("s"))


def antialiased(spark, sf_dir):
    t = traces(spark, sf_dir).select("trace", F.col("p").alias("samples"), F.lit(100.0).alias("sr"))
    return C.resample_waveforms(t, 40.0, zeros=4).select("trace", F.size("samples").alias("n"), F.round(F.get("samples", F.lit(1)), 6).alias("second"), _sum(F.transform("samples", F.abs)).alias("s"))


def three_channels(spark, sf_dir):
    """Segments of three channels a station: as read (Z), reversed in time (N), and without sign (E)."""
    s = segments(spark, sf_dir)
    kinds = F.array(*[F.struct(F.lit(c).alias("cha"), x.alias("samples")) for c, x in (("HHZ", F.col("samples")), ("HHN", F.reverse("samples")), ("HHE", F.transform("samples", F.abs)))])
    return s.select("net", "sta", "loc", "start", "sr", F.inline(kinds))


def prepared(spark, sf_dir):
    """Chunks of ten minutes, each conditioned as one trace over stretches of one minute."""
    p = C.prepare_chunks(three_channels(spark, sf_dir), None, 20.0, 600.0, low=0.5, high=4.0)
    origin = F.unix_micros(F.lit(START).cast("timestamp")) / 1e6 * 20.0
    sums = [F.round(F.aggregate(F.get("xs", F.lit(i)), F.lit(0.0), lambda a, v: a + F.abs(v)), 6).alias(f"s{i}") for i in range(3)]
    return p.select("sta", F.col("stretch").cast("long").alias("stretch"), (F.col("at") - origin).cast("long").alias("at"), F.size(F.get("xs", F.lit(0))).alias("n"), *sums)


def continuous(spark, sf_dir):
    """Fifty traces a station, each two samples over the next one's start, with a gap after the twenty-fifth."""
    k = F.col("trace") % 50
    t = traces(spark, sf_dir).select(F.format_string("S%04d", F.floor(F.col("trace") / 50)).alias("station"), (k * 62 + F.floor(k / 25) * 9).cast("long").alias("at"), F.col("p").alias("samples"))
    return A.continuous_picks(t, 200, 50, "stand-in/energy", 0.7, 40)


def onsets(spark, sf_dir):
    t = traces(spark, sf_dir).withColumn("i", K.onsets(F.col("p"), 0.1, 5))
    return t.select("trace", F.explode("i").alias("sample"))


def peaks(spark, sf_dir):
    return traces(spark, sf_dir).select("trace", F.explode(K.peaks(F.col("p"), height=0.1)).alias("sample"))


def spaced_peaks(spark, sf_dir):
    return traces(spark, sf_dir).select("trace", F.explode(K.peaks(F.col("p"), height=0.05, distance=6)).alias("sample"))


def best_picks(spark, sf_dir):
    t = traces(spark, sf_dir).withColumn("b", K.best_pick(F.col("p"), 0.15))
    return t.select("trace", F.col("b.sample").alias("sample"), F.round("b.prob", 3).alias("prob"))


def window_onsets(spark, sf_dir):
    w = P.sliding_windows(traces(spark, sf_dir), "p", 25, 7)
    return K.trace_picks(w, ["station", "trace", "win_idx"], "window", 0.1, 5)


def argmax_quality(spark, sf_dir):
    t = traces(spark, sf_dir).withColumn("catalog", (F.col("trace") % 64).cast("int"))
    return K.pick_quality(t, "p", "catalog", 0.1, 5).select("trace", "argmax", "onset", "delta_argmax", "delta_onset")


def paired(spark, sf_dir):
    p = picks(spark, sf_dir).select(F.col("run").alias("side"), "station", "phase", (F.col("sample") / 10).alias("t"), "prob")
    return rounded(K.pair_phases(p, ["side", "station"]))


def _component_windows(spark, sf_dir):
    c = P.common_interval(P.strict_components(_stations(spark, sf_dir), ["group"]))
    c = c.select("group", "xs", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("first_out"), F.size(F.get("xs", F.lit(0))).cast("long").alias("stop_out"))
    return C.windows_over_stretches(c, ["group"], 25, 7)


def annotated(spark, sf_dir):
    """Windows of three components as one tensor, P and S traces out of one pass."""
    a = K.annotate(_component_windows(spark, sf_dir), "window", (3, 25), "stand-in/three", 128, channels=("P", "S"), warm_up=1)
    return a.select("group", "win_idx", "w_start", *[f(F.col("prob")[c], n) for c in "PS" for f, n in ((lambda x, n: _sum(x).alias(n), f"{c.lower()}_sum"), (lambda x, n: F.round(F.array_max(x), 6).alias(n), f"{c.lower()}_max"))])


def _classified(spark, sf_dir, merged):
    w = _component_windows(spark, sf_dir).withColumn("station", F.format_string("G%04d", "group"))
    c = K.classify(w, "window", (3, 25), "stand-in/three", {"P": 0.6, "S": 0.55}, 5, 10.0, merged)
    return c.select("station", "phase", F.round(F.unix_micros("peak_time") / 1e6, 6).alias("peak_s"), F.round("peak_value", 6).alias("peak_value"))


def classified(spark, sf_dir):
    return _classified(spark, sf_dir, False)


def classified_network(spark, sf_dir):
    c = _classified(spark, sf_dir, True)
    return c.groupBy("station", "phase").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("peak_value"), 6).alias("highest"), F.round(F.sum("peak_s"), 4).alias("total_s"))


def network_pick(spark, sf_dir):
    """Every station, every chunk of ten minutes: prepare, windows across stretches, P and S in one pass, pick, pair, fill in empty stations."""
    s = three_channels(spark, sf_dir)
    w = C.windows_over_stretches(C.prepare_chunks(s, None, 20.0, 600.0, light=True), ["sta", "chunk"], 100, 20).withColumnRenamed("sta", "station")
    p = K.classify(w, "window", (3, 100), "stand-in/three", {"P": 0.8, "S": 0.8}, 10, 20.0, batch_size=256)
    p = p.select(F.col("station").alias("sta"), "phase", ((F.unix_micros("peak_time") - F.unix_micros(F.lit(START).cast("timestamp"))) / 1e6).alias("t"), F.col("peak_value").alias("prob"))
    return rounded(K.with_empty_stations(K.pair_phases(p, ["sta"]), s, ["sta"]))


QUERIES = {
    "C13_windows": windows, "C13_long_windows": long_windows, "C19_window_counts": window_counts, "C15_stepped_windows": stepped, "C16_centred_windows": centred, "C4_C5_C18_shaped": shaped,
    "C8_resampled": resampled, "C8_antialiased": antialiased, "C21_snr": snr, "C20_aligned": aligned, "C1_chunk_grid": chunk_grid, "C2_chunk_cut": chunk_cut, "C3_merged": merged, "C9_C11_strict_common": strict_common,
    "C10_strict_union": strict_union, "C12_lenient": lenient, "C22_component_traces": component_traces, "A7_read_window": read_window, "A8_span": span, "C6_C7_filtered": filtered, "C23_prepared": prepared,
    "D5_onsets": onsets, "D6_peaks": peaks, "D6_spaced_peaks": spaced_peaks, "D7_best_picks": best_picks, "D9_window_onsets": window_onsets, "D15_argmax_quality": argmax_quality, "D14_paired": paired,
    "K9_continuous_picks": continuous, "D1_annotated": annotated, "D2_classified": classified, "D2_classified_network": classified_network, "D3_network_pick": network_pick,
}

T = f"WITH {TRACES}"
STARTS = f"""{T}, w AS (SELECT trace, station, p, unnest(range(0, 64 - 25 + 1, 18) || CASE WHEN 36 + 25 < 64 THEN [64 - 25] ELSE [] END) AS w_start FROM traces),
 win AS (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY w_start) - 1 AS win_idx, p[w_start + 1 : w_start + 25] AS x FROM w)"""
SEG = f"""{T}, seg AS (SELECT trace, station AS sta, substr('ZNE12', (trace % 5 + 1)::INTEGER, 1) AS letter, trace * 30 + trace % 3 AS i0, p FROM traces)"""
RISES = """rises AS (SELECT trace, list(i ORDER BY i) AS r FROM (SELECT trace, p, unnest(range(1, len(p))) AS i FROM src) WHERE p[i + 1] >= 0.1 AND p[i] < 0.1 GROUP BY trace),
 fold AS (SELECT trace, r, 1 AS k, [r[1]] AS kept FROM rises UNION ALL
   SELECT trace, r, k + 1, CASE WHEN r[k + 1] - kept[-1] >= 5 THEN list_append(kept, r[k + 1]) ELSE kept END FROM fold WHERE k < len(r))"""
STATIONS = f"""{T}, s AS (SELECT trace // 5 AS g, substr('ZNE12', (trace % 5 + 1)::INTEGER, 1) AS letter, trace % 3 AS i0, p FROM traces),
 c AS (SELECT g, CASE letter WHEN '1' THEN 'E' WHEN '2' THEN 'N' ELSE letter END AS comp, letter IN ('1', '2') AS worse, i0, p FROM s QUALIFY row_number() OVER (PARTITION BY g, comp ORDER BY worse, i0) = 1),
 ok AS (SELECT g, max(i0) AS a, min(i0 + 63) AS b, min(i0) AS ua, max(i0 + 64) AS ub FROM c GROUP BY g HAVING count(*) = 3)"""

#: Two-corner Butterworth bandpasses of the corner frequencies in ``band (fmin, fmax)`` at 10 Hz, by hand: ``h`` (fmin, fmax, r), the response from its {n}-th value back.
RESPONSE = """warp AS (SELECT fmin, fmax, 20 * tan(pi() * fmin / 10) AS a, 20 * tan(pi() * fmax / 10) AS b FROM band),
 root AS (SELECT *, a * b AS c, (b - a) / 2 * sqrt(0.5) AS g, sqrt(sqrt((a * b) * (a * b) + ((b - a) * (b - a) / 4) * ((b - a) * (b - a) / 4))) AS m, atan2(-(b - a) * (b - a) / 4, -a * b) / 2 AS turn FROM warp),
 pole AS (SELECT *, -g + m * cos(turn) AS x1, g + m * sin(turn) AS y1, -g - m * cos(turn) AS x2, g - m * sin(turn) AS y2 FROM root),
 digital AS (SELECT *, -2 * (400 - x1 * x1 - y1 * y1) / ((20 - x1) * (20 - x1) + y1 * y1) AS p1, ((20 + x1) * (20 + x1) + y1 * y1) / ((20 - x1) * (20 - x1) + y1 * y1) AS p2,
   -2 * (400 - x2 * x2 - y2 * y2) / ((20 - x2) * (20 - x2) + y2 * y2) AS q1, ((20 + x2) * (20 + x2) + y2 * y2) / ((20 - x2) * (20 - x2) + y2 * y2) AS q2, 2 * atan(sqrt(c) / 20) AS w FROM pole),
 gained AS (SELECT *, sqrt(((1 + p1 * cos(w) + p2 * cos(2 * w)) ** 2 + (p1 * sin(w) + p2 * sin(2 * w)) ** 2) * ((1 + q1 * cos(w) + q2 * cos(2 * w)) ** 2 + (q1 * sin(w) + q2 * sin(2 * w)) ** 2)) / (4 * sin(w) ** 2) AS k FROM digital),
 pulse AS (SELECT fmin, fmax, p1 + q1 AS a1, p2 + q2 + p1 * q1 AS a2, p1 * q2 + p2 * q1 AS a3, p2 * q2 AS a4, k, 0 AS i, k AS v, 0.0::DOUBLE AS v1, 0.0::DOUBLE AS v2, 0.0::DOUBLE AS v3 FROM gained UNION ALL
   SELECT fmin, fmax, a1, a2, a3, a4, k, i + 1, CASE i + 1 WHEN 2 THEN -2 * k WHEN 4 THEN k ELSE 0 END - a1 * v - a2 * v1 - a3 * v2 - a4 * v3, v, v1, v2 FROM pulse WHERE i < {n} - 1),
 h AS (SELECT fmin, fmax, list(v ORDER BY i DESC) AS r FROM pulse GROUP BY ALL)"""


def bandpassed(x: str, n: int) -> str:
    """SQL for the forward pass of the list ``x`` with the response ``r`` of ``n`` values."""
    return f"list_transform(range(1, len({x}) + 1), lambda i: list_dot_product({x}[greatest(1, i - {n - 1}) : i], r[greatest(1, {n + 1} - i) : {n}]))"


#: P and S of the stand-in over lists ``z``, ``n`` and ``e``.
STAND_IN = """list_transform(range(1, len({x}) + 1), lambda i: (list_sum({x}[greatest(1, i - 2) : i]) / least(i, 3)) / (list_sum({x}[greatest(1, i - 29) : i]) / least(i, 30) + 1e-9))"""
SQUASHED = "list_transform({x}, lambda v: v / (1 + v))"
#: Onsets of ``src (id, p, thr)`` with their peaks: ``hits (id, onset, peak, value)``; a rise counts {sep} samples or more after the last one kept.
HITS = """rises AS (SELECT id, list(i ORDER BY i) AS r FROM (SELECT id, p, thr, unnest(range(1, len(p))) AS i FROM src) WHERE p[i + 1] >= thr AND p[i] < thr GROUP BY id),
 fold AS (SELECT id, r, 1 AS k, [r[1]] AS kept FROM rises UNION ALL
   SELECT id, r, k + 1, CASE WHEN r[k + 1] - kept[-1] >= {sep} THEN list_append(kept, r[k + 1]) ELSE kept END FROM fold WHERE k < len(r)),
 kept AS (SELECT id, unnest(kept) AS onset FROM fold WHERE k = len(r)),
 ends AS (SELECT kept.id, onset, p, coalesce(list_min(list_filter(range(onset, len(p)), lambda i: p[i + 1] < thr)), len(p)) AS stop FROM kept JOIN src ON kept.id = src.id),
 hits AS (SELECT id, onset, onset + list_position(p[onset + 1 : stop], list_max(p[onset + 1 : stop])) - 1 AS peak, list_max(p[onset + 1 : stop]) AS value FROM ends)"""
COMPONENT_WINDOWS = f"""{STATIONS}, xs AS (SELECT ok.g, (b - a + 1) AS t, z.p[a - z.i0 + 1 : b - z.i0 + 1] AS z, n.p[a - n.i0 + 1 : b - n.i0 + 1] AS n, e.p[a - e.i0 + 1 : b - e.i0 + 1] AS e
   FROM ok JOIN c z ON z.g = ok.g AND z.comp = 'Z' JOIN c n ON n.g = ok.g AND n.comp = 'N' JOIN c e ON e.g = ok.g AND e.comp = 'E'),
 ws AS (SELECT *, unnest(range(0, t - 24, 18) || CASE WHEN (t - 25) % 18 <> 0 THEN [t - 25] ELSE [] END) AS w FROM xs),
 sq AS (SELECT g, w, row_number() OVER (PARTITION BY g ORDER BY w) - 1 AS win_idx, list_transform(z[w + 1 : w + 25], lambda v: v * v) AS pz, list_transform(range(w + 1, w + 26), lambda i: n[i] * n[i] + e[i] * e[i]) AS ps FROM ws),
 pr AS (SELECT g, w, win_idx, {SQUASHED.format(x=STAND_IN.format(x="pz"))} AS p, {SQUASHED.format(x=STAND_IN.format(x="ps"))} AS s FROM sq)"""
CLASSIFIED = f"""{COMPONENT_WINDOWS.replace("WITH ", "WITH RECURSIVE ", 1)}, src AS (SELECT {{'g': g, 'w': w, 'phase': 'P'}} AS id, p, 0.6::DOUBLE AS thr FROM pr UNION ALL SELECT {{'g': g, 'w': w, 'phase': 'S'}}, s, 0.55::DOUBLE FROM pr), {HITS.format(sep=5)},
 found AS (SELECT printf('G%04d', id.g) AS station, id.phase AS phase, (id.w + peak) / 10.0::DOUBLE AS peak_s, max(value) AS peak_value FROM hits GROUP BY ALL)"""
#: Sample rows of the three channels merged on the grid (``best``), and the whole traces of ten-minute chunks (``chunks``: sta, chunk, first, x of each component), zero-filled.
CHUNKS = f"""{TRACES}, seg AS (SELECT trace, station AS sta, trace * 30 + trace % 3 AS i0, p FROM traces),
 smp AS (SELECT sta, i0, i0 + unnest(range(64)) AS i, unnest(p) AS z, unnest(list_reverse(p)) AS n, unnest(list_transform(p, lambda v: abs(v))) AS e FROM seg),
 best AS (SELECT sta, i, arg_max(z, i0) AS z, arg_max(n, i0) AS n, arg_max(e, i0) AS e FROM smp GROUP BY ALL),
 grid AS (SELECT sta, unnest(range(min(i), max(i) + 1)) AS i FROM best GROUP BY sta),
 whole AS (SELECT grid.sta, grid.i, grid.i // 6000 AS chunk, coalesce(z, 0) AS z, coalesce(n, 0) AS n, coalesce(e, 0) AS e FROM grid LEFT JOIN best ON grid.sta = best.sta AND grid.i = best.i),
 chunks AS (SELECT sta, chunk, min(i) AS first, [list(z ORDER BY i), list(n ORDER BY i), list(e ORDER BY i)] AS xs FROM whole GROUP BY ALL),
 one AS (SELECT sta, chunk, first, comp, xs[comp + 1] AS raw, list_avg(xs[comp + 1]) AS mean FROM (SELECT *, unnest([0, 1, 2]) AS comp FROM chunks))"""
#: A trace ``x`` from sample ``first`` on at 10 Hz, at 20 Hz from sample ``2 * first`` on.
DOUBLED = "list_transform(range(2 * len(x) - 1), lambda j: (x[j // 2 + 1] + x[(j + 1) // 2 + 1]) / 2)"

ORACLE_SQL = {
    "C13_windows": f"{STARTS} SELECT trace, win_idx::INTEGER AS win_idx, w_start::INTEGER AS w_start, round(list_sum(x), 6) AS s, len(x)::INTEGER AS n FROM win",
    "C13_long_windows": f"{T} SELECT trace, 0 AS win_idx, 0 AS w_start, round(list_sum(p), 6) AS s, 100 AS n FROM traces",
    "C19_window_counts": f"{STARTS} SELECT station, count(*) AS n_windows FROM win GROUP BY station",
    "C15_stepped_windows": f"{T}, w AS (SELECT trace, p, unnest(range(0, 64, 15)) AS w_start FROM traces) SELECT trace, (w_start // 15)::INTEGER AS win_idx, w_start::INTEGER AS w_start, round(list_sum(p[w_start + 1 : w_start + 20]), 6) AS s FROM w",
    "C16_centred_windows": f"{T}, q AS (SELECT trace, p, trace * 7 % 80 AS pick, greatest(0, least(trace * 7 % 80 - 10, 64 - 21)) AS w FROM traces) SELECT trace, w::INTEGER AS w_start, (pick - w)::INTEGER AS pick_in_window, round(list_sum(p[w + 1 : w + 21]), 6) AS s FROM q WHERE pick < 64",
    "C4_C5_C18_shaped": f"""{T}, m AS (SELECT trace, p, list_avg(p) AS a, list_max(p) AS top, sqrt(list_var_pop(p)) AS sd,
  list_transform(range(64), lambda i: CASE WHEN least(i, 63 - i) >= 10 THEN p[i + 1] ELSE p[i + 1] * 0.5 * (1 - cos(pi() * least(i, 63 - i) / 10)) END) AS t FROM traces)
 SELECT trace, round(p[6] - a, 6) AS demeaned, round(t[4], 6) AS tapered, round(list_sum(t), 6) AS taper_sum, round((p[8] - a) / sd, 6) AS by_std, round((p[8] - a) / (top - a), 6) AS by_max FROM m""",
    "C8_resampled": f"""{T}, r AS (SELECT trace, list_transform(range(26), lambda j: p[floor(j * 2.5)::INTEGER + 1] * (1 - (j * 2.5 - floor(j * 2.5))) + p[least(floor(j * 2.5)::INTEGER + 2, 64)] * (j * 2.5 - floor(j * 2.5))) AS x FROM traces)
 SELECT trace, len(x)::INTEGER AS n, round(x[2], 6) AS second, round(list_sum(x), 6) AS s FROM r""",
    "C21_snr": f"""{T}, q AS (SELECT trace, (trace % 64)::INTEGER AS pick, list_transform(p, lambda v: abs(v) + 0.01) AS x FROM traces),
 s AS (SELECT *, CASE WHEN pick >= 10 AND pick + 10 < 64 THEN 10 WHEN pick < 10 THEN pick WHEN pick + 10 > 64 THEN 64 - pick END AS w FROM q)
 SELECT trace, pick, CASE WHEN w > 0 AND pick > 0 THEN round_even(20 * log10(list_aggregate(x[pick + 1 : pick + w], 'quantile_cont', 0.95) / list_aggregate(x[pick - w + 1 : pick], 'quantile_cont', 0.95)), 1) + 0.0 END AS snr FROM s""",
    "C20_aligned": f"{T}, a AS (SELECT trace, list_transform(range(50), lambda j: p[greatest(0, least(j + trace % 40 - 20, 63)) + 1]) AS x FROM traces) SELECT trace, round(list_sum(x), 6) AS s, round(x[1], 6) AS first FROM a",
    "C1_chunk_grid": f"""WITH {PICKS}, s AS (SELECT station, (epoch_us(date_trunc('hour', min(t))) - epoch_us(TIMESTAMP '{START}')) // 60000000 AS a, (epoch_us(date_trunc('hour', max(t))) - epoch_us(TIMESTAMP '{START}')) // 60000000 AS b FROM picks GROUP BY 1),
 g AS (SELECT *, unnest(range(a, greatest(b, a + 1), 720)) AS x FROM s) SELECT station, ((x - a) // 720)::INTEGER AS chunk_no, x - 30 AS from_min, least(x + 720, b) AS to_min FROM g""",
    "C2_chunk_cut": f"""{SEG}, smp AS (SELECT sta, trace, i0 + unnest(range(64)) AS i FROM seg), pc AS (SELECT sta, trace, i // 600 AS chunk, count(*) AS n FROM smp GROUP BY ALL), lim AS (SELECT max(i0) + 100 AS m FROM seg)
 SELECT sta, chunk::INTEGER AS chunk_id, count(*) AS pieces, sum(n)::BIGINT AS n FROM pc GROUP BY ALL""",
    "C3_merged": f"""{SEG}, smp AS (SELECT sta, i0, i0 + unnest(range(64)) AS i, unnest(p) AS v FROM seg), best AS (SELECT sta, i, arg_max(v, i0) AS v FROM smp GROUP BY ALL),
 sp AS (SELECT sta, min(i) AS a, max(i) AS b FROM best GROUP BY sta), g AS (SELECT sta, a, b, unnest(range(a // 300, b // 300 + 1)) AS st FROM sp)
 SELECT g.sta, greatest(a, st * 300) AS first, (least(b + 1, (st + 1) * 300) - greatest(a, st * 300))::INTEGER AS n, round(coalesce((SELECT sum(v) FROM best WHERE best.sta = g.sta AND best.i // 300 = g.st), 0), 6) AS s FROM g""",
    "C9_C11_strict_common": f"""{STATIONS} SELECT ok.g AS "group", a AS first, round(list_sum(z.p[a - z.i0 + 1 : b - z.i0 + 1]), 6) AS s0, round(list_sum(n.p[a - n.i0 + 1 : b - n.i0 + 1]), 6) AS s1, round(list_sum(e.p[a - e.i0 + 1 : b - e.i0 + 1]), 6) AS s2, (b - a + 1)::INTEGER AS n
 FROM ok JOIN c z ON z.g = ok.g AND z.comp = 'Z' JOIN c n ON n.g = ok.g AND n.comp = 'N' JOIN c e ON e.g = ok.g AND e.comp = 'E'""",
    "C10_strict_union": f"""{STATIONS} SELECT ok.g AS "group", round(list_sum(e.p), 6) AS s0, round(list_sum(n.p), 6) AS s1, round(list_sum(z.p), 6) AS s2, (ub - ua)::INTEGER AS n
 FROM ok JOIN c z ON z.g = ok.g AND z.comp = 'Z' JOIN c n ON n.g = ok.g AND n.comp = 'N' JOIN c e ON e.g = ok.g AND e.comp = 'E'""",
    "C12_lenient": f"""{T}, s AS (SELECT trace // 3 AS g, 'HH' || substr('ZNEZN', (trace % 5 + 1)::INTEGER, 1) AS c FROM traces)
 SELECT g AS "group", max(CASE WHEN c = 'HHE' THEN c END) AS e, max(CASE WHEN c = 'HHN' THEN c END) AS n, max(CASE WHEN c = 'HHZ' THEN c END) AS z,
 concat_ws(',', CASE WHEN count(*) FILTER (c = 'HHE') = 0 THEN 'E' END, CASE WHEN count(*) FILTER (c = 'HHN') = 0 THEN 'N' END, CASE WHEN count(*) FILTER (c = 'HHZ') = 0 THEN 'Z' END) AS filled FROM s GROUP BY g""",
    "C22_component_traces": f"""{STATIONS} SELECT ok.g AS "group", 'HH' || c.comp AS cha, round(list_sum(c.p[a - c.i0 + 1 : b - c.i0 + 1]), 6) AS s FROM ok JOIN c ON c.g = ok.g""",
    "A7_read_window": f"{SEG}, h AS (SELECT *, i0 % 36000 AS j0 FROM seg), w AS (SELECT trace, p[greatest(0, 600 - j0) + 1 : least(64, 6000 - j0 + 1)] AS x FROM h WHERE j0 <= 6000 AND j0 + 63 >= 600) SELECT trace, len(x)::INTEGER AS n, round(list_sum(x), 6) AS s FROM w WHERE len(x) > 0",
    "A8_span": f"{SEG} SELECT round((max(i0 + 64) - min(i0)) / 600.0::DOUBLE, 6) AS minutes FROM seg",
    "D5_onsets": f"WITH RECURSIVE {TRACES}, src AS (SELECT trace, p FROM traces), {RISES} SELECT trace, unnest(kept)::INTEGER AS sample FROM fold WHERE k = len(r)",
    "D6_peaks": f"{T}, i AS (SELECT trace, p, unnest(range(1, 63)) AS i FROM traces) SELECT trace, i::INTEGER AS sample FROM i WHERE p[i + 1] - p[i] > 0 AND p[i + 2] - p[i + 1] <= 0 AND p[i + 1] >= 0.1",
    "D6_spaced_peaks": f"""WITH RECURSIVE {TRACES}, i AS (SELECT trace, p, unnest(range(1, 63)) AS i FROM traces),
 pk AS (SELECT trace, list(i ORDER BY p[i + 1] DESC, i DESC) AS r FROM i WHERE p[i + 1] - p[i] > 0 AND p[i + 2] - p[i + 1] <= 0 AND p[i + 1] >= 0.05 GROUP BY trace),
 fold AS (SELECT trace, r, 1 AS k, [r[1]] AS kept FROM pk UNION ALL
   SELECT trace, r, k + 1, CASE WHEN len(list_filter(kept, lambda x: abs(x - r[k + 1]) <= 6)) = 0 THEN list_append(kept, r[k + 1]) ELSE kept END FROM fold WHERE k < len(r))
 SELECT trace, unnest(kept)::INTEGER AS sample FROM fold WHERE k = len(r)""",
    "D7_best_picks": f"""{T}, i AS (SELECT trace, p, unnest(range(1, 63)) AS i FROM traces), b AS (SELECT trace, i, round_even(p[i + 1], 3) AS prob FROM i WHERE p[i + 1] - p[i] > 0 AND p[i + 2] - p[i + 1] <= 0 AND p[i + 1] >= 0.15),
 f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY trace ORDER BY prob DESC, i) = 1) SELECT traces.trace, f.i::INTEGER AS sample, round(prob, 3) AS prob FROM traces LEFT JOIN f ON traces.trace = f.trace""",
    "D9_window_onsets": f"""WITH RECURSIVE {STARTS[5:]}, src AS (SELECT trace * 100 + win_idx AS trace, x AS p FROM win), {RISES}
 SELECT station, win.trace, win_idx::INTEGER AS win_idx, (w_start + o)::INTEGER AS sample FROM (SELECT trace, unnest(kept) AS o FROM fold WHERE k = len(r)) f JOIN win ON f.trace = win.trace * 100 + win.win_idx""",
    "D15_argmax_quality": f"""WITH RECURSIVE {TRACES}, src AS (SELECT trace, p FROM traces), {RISES}, f AS (SELECT trace, kept[1] AS onset FROM fold WHERE k = len(r)),
 q AS (SELECT traces.trace, list_position(p, list_max(p)) - 1 AS argmax, onset, traces.trace % 64 AS c FROM traces LEFT JOIN f ON traces.trace = f.trace)
 SELECT trace, argmax::INTEGER AS argmax, onset::INTEGER AS onset, (argmax - c)::INTEGER AS delta_argmax, (onset - c)::INTEGER AS delta_onset FROM q""",
    "D14_paired": f"""WITH RECURSIVE {PICKS}, c AS (SELECT run, station, phase, sample / 10 AS t, prob FROM picks),
 ps AS (SELECT run, station, list({{'t': t, 'prob': prob}} ORDER BY t, prob) AS p FROM c WHERE phase = 'P' GROUP BY ALL), ss AS (SELECT run, station, list({{'t': t, 'prob': prob}} ORDER BY t, prob) AS s FROM c WHERE phase = 'S' GROUP BY ALL),
 g AS (SELECT coalesce(ps.run, ss.run) AS run, coalesce(ps.station, ss.station) AS station, p, coalesce(s, []) AS s FROM ps FULL JOIN ss ON ps.station = ss.station AND ps.run = ss.run),
 fold AS (SELECT run, station, p, s, 0 AS i, []::BIGINT[] AS used, NULL::BIGINT AS j FROM g UNION ALL
   SELECT run, station, p, s, i + 1, CASE WHEN j IS NULL THEN used ELSE list_append(used, j) END, j FROM (
     SELECT *  EXCLUDE (j), list_min(list_filter(range(1, len(s) + 1), lambda k: s[k].t - p[i + 1].t > 0 AND s[k].t - p[i + 1].t < 30 AND NOT list_contains(used, k))) AS j FROM fold WHERE i < coalesce(len(p), 0))),
 ends AS (SELECT * FROM fold WHERE i = coalesce(len(p), 0))
 SELECT run AS side, station, round(p[i].t, 6) AS p_time, round(p[i].prob, 6) AS p_prob, round(s[j].t, 6) AS s_time, round(s[j].prob, 6) AS s_prob FROM fold WHERE i > 0
 UNION ALL SELECT run, station, NULL, NULL, round(s[k].t, 6), round(s[k].prob, 6) FROM (SELECT *, unnest(range(1, len(s) + 1)) AS k FROM ends) WHERE NOT list_contains(used, k)""",
    "C6_C7_filtered": f"""WITH RECURSIVE {TRACES}, par AS (SELECT trace, p AS x, CASE WHEN station < 'S0005' THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS fmin, CASE WHEN station < 'S0007' THEN 2.0::DOUBLE ELSE 4.0::DOUBLE END AS fmax FROM traces),
 band AS (SELECT DISTINCT fmin, fmax FROM par), {RESPONSE.format(n=64)},
 f AS (SELECT trace, par.fmin, par.fmax, r, list_reverse({bandpassed("x", 64)}) AS y FROM par JOIN h ON par.fmin = h.fmin AND par.fmax = h.fmax),
 b AS (SELECT trace, fmin, fmax, list_reverse({bandpassed("y", 64)}) AS z FROM f)
 SELECT trace, fmin, fmax, round(z[10], 6) AS tenth, round(list_sum(list_transform(z, lambda v: abs(v))), 6) AS s FROM b""",
    "C8_antialiased": f"""WITH {TRACES}, w AS (SELECT 4 / 0.36::DOUBLE AS width), tap AS (SELECT ph, k, k - ph / 2.0::DOUBLE AS u FROM (SELECT unnest([0, 1]) AS ph), (SELECT unnest(range(-12, 13)) AS k)),
 raw AS (SELECT ph, k, CASE WHEN abs(u) >= width THEN 0 ELSE CASE WHEN u = 0 THEN 1 ELSE sin(pi() * 0.36 * u) / (pi() * 0.36 * u) END * 0.5 * (1 + cos(pi() * u / width)) END AS g FROM tap, w),
 taps AS (SELECT ph, list(g ORDER BY k) AS g, sum(g) AS whole FROM raw GROUP BY ph),
 r AS (SELECT trace, list(v ORDER BY j) AS x FROM (
   SELECT trace, j, list_dot_product((list_resize([]::DOUBLE[], 12, 0.0) || p || list_resize([]::DOUBLE[], 12, 0.0))[j * 5 // 2 + 1 : j * 5 // 2 + 25], g) / whole AS v
   FROM (SELECT trace, p, unnest(range(26)) AS j FROM traces) JOIN taps ON ph = j % 2) GROUP BY trace)
 SELECT trace, len(x)::INTEGER AS n, round(x[2], 6) AS second, round(list_sum(list_transform(x, lambda v: abs(v))), 6) AS s FROM r""",
    "C23_prepared": f"""WITH RECURSIVE {CHUNKS}, band AS (SELECT 0.5::DOUBLE AS fmin, 4.0::DOUBLE AS fmax), {RESPONSE.format(n=130)},
 tapered AS (SELECT sta, chunk, first, comp, len(raw) AS len, list_transform(range(len(raw)), lambda i: (raw[i + 1] - mean) * CASE WHEN least(i, len(raw) - 1 - i) >= least(50, len(raw) // 2) THEN 1
   ELSE 0.5 * (1 - cos(pi() * least(i, len(raw) - 1 - i) / greatest(1, least(50, len(raw) // 2)))) END) AS x FROM one),
 f AS (SELECT sta, chunk, first, comp, r, list_reverse({bandpassed("x", 130)}) AS y FROM tapered, h),
 b AS (SELECT sta, chunk, first, comp, list_reverse({bandpassed("y", 130)}) AS x FROM f),
 s AS (SELECT sta, comp, unnest(range(2 * first, 2 * first + 2 * len(x) - 1)) AS j, unnest({DOUBLED}) AS v FROM b)
 SELECT sta, (j // 1200 + (epoch(TIMESTAMP '{START}') // 60))::BIGINT AS stretch, min(j) AS at, (count(*) // 3)::INTEGER AS n, round(sum(abs(v)) FILTER (comp = 0), 6) AS s0, round(sum(abs(v)) FILTER (comp = 1), 6) AS s1, round(sum(abs(v)) FILTER (comp = 2), 6) AS s2
 FROM s GROUP BY sta, j // 1200""",
    "K9_continuous_picks": f"""WITH RECURSIVE {T.removeprefix('WITH ')}, seg AS (SELECT printf('S%04d', trace // 50) AS station, (trace % 50) * 62 + trace % 50 // 25 * 9 AS a0, p FROM traces),
s AS (SELECT *, max(a0 + len(p)) OVER (PARTITION BY station ORDER BY a0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ends FROM seg),
r AS (SELECT *, max(CASE WHEN ends IS NULL OR a0 > ends THEN a0 END) OVER (PARTITION BY station ORDER BY a0) AS run FROM s),
x AS (SELECT station, run, flatten(list(CASE WHEN ends > a0 THEN p[ends - a0 + 1:] ELSE p END ORDER BY a0)) AS x FROM r GROUP BY ALL HAVING sum(len(p)) >= 200),
w AS (SELECT station, run, k, x[k * 150 + 1:k * 150 + 200] AS w FROM x, unnest(range((len(x) - 200) // 150 + 1)) t(k)),
q AS (SELECT station, run, k, list_transform(range(1, 201), lambda i: (list_sum(list_transform(w[greatest(i - 2, 1):i], lambda v: v * v)) / least(i, 3)) / (list_sum(list_transform(w[greatest(i - 29, 1):i], lambda v: v * v)) / least(i, 30) + 1e-9)) AS q FROM w),
d AS (SELECT station, run, run + k * 150 + i - 1 AS sample, q[i] / (1 + q[i]) AS v FROM q, unnest(range(1, 201)) u(i) WHERE k = 0 OR i > 50),
b AS (SELECT *, lag(v) OVER (PARTITION BY station, run ORDER BY sample) AS b0 FROM d),
rises AS (SELECT station, sample FROM b WHERE v >= 0.7 AND b0 < 0.7),
kept AS (SELECT station, min(sample) AS sample FROM rises GROUP BY station
  UNION ALL SELECT station, (SELECT min(n.sample) FROM rises n WHERE n.station = kept.station AND n.sample >= kept.sample + 40) FROM kept WHERE sample IS NOT NULL)
SELECT station, sample::BIGINT AS sample FROM kept WHERE sample IS NOT NULL""",
    "D1_annotated": f"""{COMPONENT_WINDOWS} SELECT g AS "group", win_idx::INTEGER AS win_idx, w::INTEGER AS w_start, round(list_sum(p), 6) AS p_sum, round(list_max(p), 6) AS p_max, round(list_sum(s), 6) AS s_sum, round(list_max(s), 6) AS s_max FROM pr""",
    "D2_classified": f"{CLASSIFIED} SELECT station, phase, round(peak_s, 6) AS peak_s, round(peak_value, 6) AS peak_value FROM found",
    "D2_classified_network": f"{CLASSIFIED} SELECT 'NETWORK' AS station, phase, count(*) AS n, round(max(peak_value), 6) AS highest, round(sum(peak_s), 4) AS total_s FROM found GROUP BY phase",
    "D3_network_pick": f"""WITH RECURSIVE {CHUNKS}, centred AS (SELECT sta, chunk, first, comp, list_transform(raw, lambda v: v - mean) AS x FROM one),
 res AS (SELECT sta, chunk, first, max({DOUBLED}) FILTER (comp = 0) AS z, max({DOUBLED}) FILTER (comp = 1) AS n, max({DOUBLED}) FILTER (comp = 2) AS e FROM centred GROUP BY ALL),
 ws AS (SELECT *, len(z) AS t, unnest(CASE WHEN len(z) <= 100 THEN [0] ELSE range(0, len(z) - 99, 80) || CASE WHEN (len(z) - 100) % 80 <> 0 THEN [len(z) - 100] ELSE [] END END) AS w FROM res),
 sq AS (SELECT sta, chunk, first, w, list_transform(range(w + 1, w + 101), lambda i: coalesce(z[i] * z[i], 0)) AS pz, list_transform(range(w + 1, w + 101), lambda i: coalesce(n[i] * n[i] + e[i] * e[i], 0)) AS ps FROM ws),
 pr AS (SELECT sta, chunk, 2 * first + w AS origin, {SQUASHED.format(x=STAND_IN.format(x="pz"))} AS p, {SQUASHED.format(x=STAND_IN.format(x="ps"))} AS s FROM sq),
 src AS (SELECT {{'sta': sta, 'chunk': chunk, 'origin': origin, 'phase': 'P'}} AS id, p, 0.8::DOUBLE AS thr FROM pr UNION ALL SELECT {{'sta': sta, 'chunk': chunk, 'origin': origin, 'phase': 'S'}}, s, 0.8::DOUBLE FROM pr), {HITS.format(sep=10)},
 c AS (SELECT id.sta AS sta, id.phase AS phase, (id.origin + peak) / 20.0::DOUBLE AS t, max(value) AS prob FROM hits GROUP BY ALL),
 ps AS (SELECT sta, list({{'t': t, 'prob': prob}} ORDER BY t) AS p FROM c WHERE phase = 'P' GROUP BY ALL), ss AS (SELECT sta, list({{'t': t, 'prob': prob}} ORDER BY t) AS s FROM c WHERE phase = 'S' GROUP BY ALL),
 g AS (SELECT coalesce(ps.sta, ss.sta) AS sta, p, coalesce(s, []) AS s FROM ps FULL JOIN ss ON ps.sta = ss.sta),
 turn AS (SELECT sta, p, s, 0 AS i, []::BIGINT[] AS used, NULL::BIGINT AS j FROM g UNION ALL
   SELECT sta, p, s, i + 1, CASE WHEN j IS NULL THEN used ELSE list_append(used, j) END, j FROM (
     SELECT * EXCLUDE (j), list_min(list_filter(range(1, len(s) + 1), lambda k: s[k].t - p[i + 1].t > 0 AND s[k].t - p[i + 1].t < 30 AND NOT list_contains(used, k))) AS j FROM turn WHERE i < coalesce(len(p), 0))),
 done AS (SELECT * FROM turn WHERE i = coalesce(len(p), 0)),
 rows AS (SELECT sta, p[i].t AS p_time, p[i].prob AS p_prob, s[j].t AS s_time, s[j].prob AS s_prob FROM turn WHERE i > 0
   UNION ALL SELECT sta, NULL, NULL, s[k].t, s[k].prob FROM (SELECT *, unnest(range(1, len(s) + 1)) AS k FROM done) WHERE NOT list_contains(used, k))
 SELECT st.sta, round(p_time, 6) AS p_time, round(p_prob, 6) AS p_prob, round(s_time, 6) AS s_time, round(s_prob, 6) AS s_prob FROM (SELECT DISTINCT sta FROM one) st LEFT JOIN rows ON rows.sta = st.sta""",
}
