"""Hand-computed cases, properties, and streams against their batch twins."""

import datetime as dt
import json

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from quakeframe.functions import scalars as S
from quakeframe.functions import statistics as st
from quakeframe.operators import matching, metrics, picks, prep, trials
from quakeframe.operators.runs import with_runs
from quakeframe.plans import trial_queries
from quakeframe.sources import readers, sinks
from quakeframe.streaming import stations as K

T0 = dt.datetime(2024, 1, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def doubles(values):
    return F.array(*[F.lit(float(v)) for v in values]) if len(values) else F.array().cast("array<double>")


def match(spark, a, b, tolerance=50):
    make = lambda v: spark.createDataFrame([("s", "P", float(x), float(i)) for i, x in enumerate(v)], "station string, phase string, sample double, pos double")
    return make(a), make(b), tolerance


@pytest.mark.parametrize(
    "a,b,want",
    [
        ([100], [140, 90], [(100, 90, "pair"), (None, 140, "b")]),
        ([100, 104], [103], [(100, 103, "pair"), (104, None, "a")]),
        ([100], [150], [(100, 150, "pair")]),
        ([100], [90, 110], [(100, 90, "pair"), (None, 110, "b")]),
        ([], [5], [(None, 5, "b")]),
        ([5], [], [(5, None, "a")]),
    ],
)
def test_greedy_matching(spark, a, b, want):
    x, y, tol = match(spark, a, b)
    got = matching.match_picks(x, y, ["station", "phase"], tol).collect()
    assert sorted(((r["a_value"], r["b_value"], r["side"]) for r in got), key=str) == sorted(want, key=str)


def test_greedy_takes_a_in_the_given_order(spark):
    x, y, tol = match(spark, [104, 100], [103])
    got = matching.match_picks(x, y, ["station", "phase"], tol, order="pos").collect()
    assert {(r["a_value"], r["side"]) for r in got} == {(104.0, "pair"), (100.0, "a")}


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.integers(0, 400), max_size=12), hs.lists(hs.integers(0, 400), max_size=12))
def test_greedy_equals_a_plain_loop(spark, a, b):
    x, y, tol = match(spark, a, b, 20)
    got = matching.match_picks(x, y, ["station", "phase"], tol).filter("side = 'pair'").collect()
    free, want = sorted(b), []
    for v in sorted(a):
        near = min(free, key=lambda w: (abs(w - v), w), default=None)
        if near is not None and abs(near - v) <= 20:
            free.remove(near)
            want.append((v, near))
    assert sorted((r["a_value"], r["b_value"]) for r in got) == sorted(want)


@pytest.mark.parametrize("by", ["sample", "pos"])
def test_a_busy_station_is_matched_by_stretches(spark, by):
    rng = np.random.default_rng(3)
    a, b = [rng.integers(0, 2000, n).tolist() for n in (900, 950)]
    x, y, tol = match(spark, a, b, 20)
    x = x.unionByName(spark.createDataFrame([("quiet", "P", 5.0, 0.0)], x.schema))
    got = matching.match_picks(x, y, ["station", "phase"], tol, order=by).collect()
    free, want = sorted(b), [(5.0, None, "a")]
    for v in sorted(a) if by == "sample" else a:
        near = min(free, key=lambda w: (abs(w - v), w), default=None)
        if near is not None and abs(near - v) <= tol:
            free.remove(near)
            want.append((v, near, "pair"))
        else:
            want.append((v, None, "a"))
    want += [(None, v, "b") for v in free]
    assert sorted(((r["a_value"], r["b_value"], r["side"]) for r in got), key=str) == sorted([tuple(float(v) if isinstance(v, int) else v for v in w) for w in want], key=str)
    assert sum(w[2] == "pair" for w in want) > 700


def test_phases_of_a_busy_station_are_paired_by_stretches(spark):
    rng = np.random.default_rng(5)
    rows = [("s", str(rng.choice(["P", "S"])), float(t), None if i % 9 == 0 else float(rng.integers(0, 3))) for i, t in enumerate(rng.integers(0, 2000, 1500))]
    got = picks.pair_phases(spark.createDataFrame(rows, "station string, phase string, t double, prob double"), ["station"]).collect()
    key = lambda r: (r[0], r[1] is not None, r[1] or 0.0)
    free, want = sorted([r[2:] for r in rows if r[1] == "S"], key=key), []
    for p in sorted([r[2:] for r in rows if r[1] == "P"], key=key):
        hit = next((s for s in free if p[0] < s[0] < p[0] + 30), (None, None))
        if hit[0] is not None:
            free.remove(hit)
        want.append((*p, *hit))
    want += [(None, None, *s) for s in free]
    assert sorted((tuple(r)[1:] for r in got), key=str) == sorted(want, key=str)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.integers(-300, 300), max_size=25), hs.booleans())
def test_runs_equal_a_plain_loop(spark, values, inclusive):
    df = spark.createDataFrame([("k", float(v)) for v in values], "k string, v double")
    got = sorted((r["v"], r["run"]) for r in with_runs(df, ["k"], "v", 15.0, inclusive, width=40.0).collect())
    want, start, last = [], None, None
    for v in sorted(map(float, values)):
        if last is None or (v - last >= 15 if inclusive else v - last > 15):
            start = v
        want.append((v, start))
        last = v
    assert got == want


def test_scores(spark):
    cat = spark.createDataFrame([("s", "P", 100.0)], "station string, phase string, sample double")
    det = spark.createDataFrame([("s", "P", 90.0), ("s", "P", 140.0), ("s", "P", 400.0), ("t", "P", 5.0)], "station string, phase string, sample double")
    r = metrics.phase_metrics(matching.compare_pick_sets(cat, det, 50.0), ["phase"]).first()
    assert (r["matched"], r["missing"], r["additional"], r["duplicated"]) == (1, 0, 1, 1)
    assert (r["precision"], r["recall"], round(r["f1"], 4), r["mean_dt"], r["std_dt"]) == (0.5, 1.0, 0.6667, -10.0, 0.0)
    listed = spark.createDataFrame([("s", 0, 140.0), ("s", 1, 90.0), ("s", 2, 400.0)], "trace string, pos int, sample double")
    hits = matching.first_hits(spark.createDataFrame([("s", 100.0), ("u", None)], "trace string, catalog double"), listed, "trace", 50.0)
    h = {x["trace"]: x for x in hits.collect()}
    assert (h["s"]["n_matched"], h["s"]["n_duplicates"], h["s"]["n_additional"], h["s"]["delta"]) == (1, 1, 1, 40.0)
    assert (h["u"]["n_catalog"], h["u"]["n_missing"]) == (0, 0)
    assert round(metrics.detection_totals(hits.filter("trace = 's'").withColumn("m", F.lit(1)), ["m"]).first()["precision"], 4) == 0.3333


@pytest.mark.parametrize("p,thr,sep,want", [([0.1, 0.4, 0.4, 0.1, 0.5], 0.3, 50, [1]), ([0.9, 0.9, 0.1, 0.9], 0.3, 1, [3]), ([], 0.3, 1, []), ([0.5], 0.3, 1, [])])
def test_onsets(spark, p, thr, sep, want):
    assert one(spark, picks.onsets(doubles(p), thr, sep)) == want


def test_onsets_keep_distance_from_the_last_kept(spark):
    p = np.zeros(200)
    p[[10, 40, 61, 100, 149, 151]] = 1
    assert one(spark, picks.onsets(doubles(p), 0.5, 50)) == [10, 61, 149]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.integers(0, 4), min_size=0, max_size=30), hs.sampled_from([1, 3]), hs.sampled_from(["rising", "falling", "both", None]), hs.booleans())
def test_peaks_equal_a_plain_version(spark, values, distance, edge, same):
    x = [float(v) for v in values]
    found = []
    for i in range(1, len(x) - 1):
        up, down = x[i] - x[i - 1], x[i + 1] - x[i]
        if (edge is None and up > 0 > down) or (edge in ("rising", "both") and up > 0 >= down) or (edge in ("falling", "both") and up >= 0 > down):
            found.append(i)
    if distance > 1:
        kept = []
        for i in sorted(found, key=lambda i: (-x[i], -i)):
            if not any(abs(i - k) <= distance and (x[k] > x[i] or not same) for k in kept):
                kept.append(i)
        found = sorted(kept)
    assert one(spark, picks.peaks(doubles(x), distance=distance, edge=edge, keep_same=same)) == found


@pytest.mark.parametrize("size,n,overlap,want", [(6000, 3001, 0, [0, 2999]), (6000, 3001, 900, [0, 2101, 2999]), (2000, 3001, 0, [0]), (3001, 3001, 0, [0])])
def test_window_starts(spark, size, n, overlap, want):
    assert one(spark, prep.window_starts(F.lit(size), n, overlap)) == want


@pytest.mark.parametrize("pick,want", [(100, 0), (3000, 1500), (5990, 2999)])
def test_centred_start(spark, pick, want):
    assert one(spark, prep.centred_start(F.lit(pick), F.lit(6000), 3001)) == want


def test_chunk_grid(spark):
    def grid(hours, minutes, overlap):
        span = spark.createDataFrame([(T0 + dt.timedelta(hours=hours[0]), T0 + dt.timedelta(hours=hours[1]))], "start timestamp, end timestamp")
        return [(r["t_start"].strftime("%H:%M"), r["t_end"].strftime("%H:%M")) for r in prep.chunk_grid(span, minutes, overlap).orderBy("chunk_no").collect()]

    assert grid((0, 2), 60, 0) == [("00:00", "01:00"), ("01:00", "02:00")]
    assert grid((13, 14), 60, 2) == [("12:58", "14:00")]


def test_pairing(spark):
    def pair(rows):
        df = spark.createDataFrame([("s", p, float(t), 1.0) for p, t in rows], "station string, phase string, t double, prob double")
        return sorted(((r["p_time"], r["s_time"]) for r in picks.pair_phases(df, ["station"]).collect()), key=str)

    assert pair([("P", 0), ("P", 5), ("S", 4), ("S", 20)]) == [(0.0, 4.0), (5.0, 20.0)]
    assert pair([("P", 0), ("S", 30)]) == sorted([(0.0, None), (None, 30.0)], key=str)


def test_scalars(spark):
    assert one(spark, S.duration_text(F.lit(18750.0))) == "0 Days 5 Hrs 12 Min 30 Sec"
    assert [one(spark, S.chunk_index(F.lit(v))) for v in (59.9, 60.0, 90.0, -5.0)] == [0, 1, 1, 0]
    s = one(spark, S.stage_split(*[F.lit(float(v)) for v in (10, 6, 2, 1, 3, 1)]))
    assert (s["framework"], s["model_load"], s["warmup"], s["inference"], s["preprocess"]) == (1.0, 2.0, 1.0, 4.5, 1.5)
    assert [one(spark, S.parse_pick_time(F.lit(v))) is None for v in ("", "NaN", "na", "x", "2024-01-01 00:00:01", "2024-01-01T00:00:01.5Z")] == [True, True, True, True, False, False]
    assert one(spark, S.finite_int(F.lit("2.5"))) == 2 and one(spark, S.finite_int(F.lit("inf"))) is None
    assert one(spark, S.int_list(F.lit("(0, 12)"))) == [0, 12]


def test_percentiles(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "x double")
    got = df.agg(st.percentile(F.col("x"), 0.95).alias("a"), st.percentile(F.col("x"), 0.95, "nearest").alias("b"), st.percentile(F.col("x"), 0.5, "half_even").alias("c")).first()
    assert (round(got["a"], 6), got["b"], got["c"]) == (3.85, 4.0, 3.0)


def test_drift_of_a_constant_has_no_correlation(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (1, float("nan"), 3.0)], "k int, a double, b double")
    r = metrics.probability_drift(df, ["k"], "a", "b").first()
    assert (r["mae"], r["n_samples"], r["pearson"]) == (1.5, 2, None)


# --- readers and writers


def test_trials_round_trip(spark, tmp_path):
    good = {"kind": "single", "backend": "annotate", "dtype": "bf16", "total_s": 2.0, "n_stations": 5, "stage_times_s": {"load": 1.0}, "n_cpu_workers": 4}
    lines = [json.dumps(good), "", "{broken", json.dumps({"kind": "env", "host": "x"}), json.dumps({"kind": "error", "error": "boom"})]
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    rows = readers.read_trials(spark, str(tmp_path / "t.jsonl")).collect()
    assert [(r["wall_time_s"], r["is_error"], r["variant"]) for r in rows] == [(2.0, False, "annotate/bf16/w4")]
    assert readers.read_trials(spark, str(tmp_path / "t.jsonl"), include_errors=True, drop_env=False).count() == 3
    assert readers.env_rows(spark, str(tmp_path / "t.jsonl")).count() == 1


def test_results_and_manifest(spark, tmp_path):
    for cell, oks in (("a", [True, False]), ("b", [False])):
        d = tmp_path / "res" / f"model_{cell}"
        d.mkdir(parents=True)
        (d / "result.json").write_text(json.dumps({"schema_version": 3, "timing": {"n_repeats": len(oks), "repeats": [{"success": o, "inference_s": 1.5} for o in oks]}}))
    res = readers.read_results(spark, str(tmp_path / "res"), {"model": r"model_([a-z]+)"})
    rows = readers.result_repeats(res, ["model"]).orderBy("model").collect()
    assert [(r["model"], r["ok"], r["inference_s"]) for r in rows] == [("a", True, 1.5), ("b", False, None)]
    (tmp_path / "m.json").write_text(json.dumps({"meta": {"t0": "x"}, "stations": {"S1": {"p_sample": 0, "s_sample": 9}, "S2": {"p": [1, 2]}}}))
    got = {(r["station"], r["phase"], r["sample"]) for r in readers.manifest_catalog(readers.read_manifest(spark, str(tmp_path / "m.json"))).collect()}
    assert got == {("S1", "P", 0.0), ("S1", "S", 9.0), ("S2", "P", 1.0), ("S2", "P", 2.0)}


def test_pick_files_round_trip(spark, tmp_path):
    t = T0 + dt.timedelta(seconds=1, microseconds=5)
    paired = spark.createDataFrame([("A", t, 0.5, None, None), ("B", None, None, None, None)], "station string, p_time timestamp, p_prob double, s_time timestamp, s_prob double")
    rows = sinks.pick_rows(paired)
    sinks.write_picks(rows, str(tmp_path / "csv"))
    back = readers.read_picks(spark, str(tmp_path / "csv")).collect()
    assert [(r["station"], r["phase"], r["t"], r["prob"]) for r in back] == [("A", "P", t, 0.5)]
    sinks.write_picks(rows, str(tmp_path / "xml"), "xml")
    sinks.write_pick_log(spark.createDataFrame([("A", "S", t), ("A", "P", t), ("A", "P", None)], "station string, phase string, t timestamp"), str(tmp_path / "log"))
    assert [r["value"][-1] for r in spark.read.text(str(tmp_path / "log")).collect()] == ["P", "S"]


def test_trial_csv_and_columns(spark, tmp_path):
    (tmp_path / "t.csv").write_text('Number of CPUs,GPUs Used,Runtime (s)\n4,"[0, 1]",2.5\nbad,,x\n')
    got = readers.read_trial_csv(spark, str(tmp_path / "t.csv"), {"Number of CPUs": "cpus int", "GPUs Used": "gpus list", "Runtime (s)": "runtime double"}).collect()
    assert [tuple(r) for r in got] == [(4, [0, 1], 2.5), (None, [], None)]
    assert readers.catalog_columns(spark.createDataFrame([(1.0,)], "trace_P_arrival_sample double")).columns == ["p"]
    with pytest.raises(ValueError):
        readers.catalog_columns(spark.range(1))


def test_resolved_files(spark):
    files = spark.createDataFrame([("c", "a", "l1", True), ("c", "a", "p1", False), ("c", "b", "l2", True), ("c", "b", "p2", False), ("c", "d", "p3", False)], "chunk string, sta string, path string, local boolean")
    decoded = spark.createDataFrame([("l1", 5), ("p1", 9), ("l2", 0), ("p2", 4)], "path string, samples int")
    assert sorted(r["path"] for r in readers.resolve_files(files, decoded, ["chunk", "sta"]).collect()) == ["l1", "p2", "p3"]


def test_records_are_appended(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.0)], "trial int, wall double")
    for _ in range(2):
        sinks.append_records(rows, str(tmp_path / "r"), {"wall": "Runtime (s)"})
    back = spark.read.json(str(tmp_path / "r"))
    assert back.count() == 2 and "Runtime (s)" in back.columns and back.filter("recorded_at IS NULL").count() == 0
    meta = rows.select(sinks.result_struct(F.create_map(F.lit("a"), F.lit("b")), F.struct(F.col("wall")), F.struct(F.lit(1).alias("P"))).alias("x")).select("x.*")
    sinks.write_results(meta, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first()["schema_version"] == 3


def test_snapshots_keep_the_order_of_files_and_lines(spark, tmp_path):
    for name, first in (("b.jsonl", 50), ("a.jsonl", 0)):
        (tmp_path / name).write_text("".join(json.dumps({"kind": "env" if i % 3 else "single", "i": first + i}) + "\n\n{broken\n" for i in range(50)))
    assert [json.loads(r["value"])["i"] for r in readers.env_rows(spark, str(tmp_path)).collect()] == [i for i in range(100) if i % 50 % 3]
    (tmp_path / "none").write_text("")
    assert readers.env_rows(spark, str(tmp_path / "none")).count() == 0


def test_a_result_file_per_cell(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "model string, wall int")
    made = rows.select("model", sinks.result_struct(F.create_map(F.lit("wall"), F.col("wall").cast("string")), F.struct(F.lit(0).alias("n_repeats")), F.lit(None).cast("struct<P: map<string,double>>")).alias("r")).select("model", "r.*")
    sinks.write_results(made.repartition(1), str(tmp_path / "r"), ("model",))
    back = readers.read_results(spark, str(tmp_path / "r"), {"model": r"/model=([a-z]+)/"}, "*.json")
    assert sorted((r["model"], r["meta"]["wall"]) for r in back.collect()) == [("a", "1"), ("a", "2"), ("b", "3")]
    assert back.select("path").distinct().count() == 3


def test_pick_files_of_a_busy_station(spark, tmp_path):
    paired = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "busy").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("station"), F.timestamp_seconds(F.col("id")).alias("p_time"), F.lit(0.5).alias("p_prob"), F.lit(None).cast("timestamp").alias("s_time"), F.lit(None).cast("double").alias("s_prob"))
    sinks.write_picks(sinks.pick_rows(paired), str(tmp_path / "p"))
    back = readers.read_picks(spark, str(tmp_path / "p"))
    assert sorted((r["station"], r["t"]) for r in back.collect()) == sorted((r["station"], r["p_time"]) for r in paired.collect())


def test_bootstrap(spark):
    df = spark.createDataFrame([("k", [10.0, 11.0, 9.0, 10.0], [5.0, 5.5, 4.5, 5.0]), ("one", [4.0], [2.0])], "k string, a array<double>, b array<double>")
    got = {r["k"]: r for r in trials.bootstrap_ratio(df, ["k"], "a", "b", draws=500).collect()}
    assert got["k"]["ratio"] == 2.0 and 1.7 < got["k"]["ci_low"] < 2.0 < got["k"]["ci_high"] < 2.3
    assert (got["one"]["ci_low"], got["one"]["ci_high"]) == (2.0, 2.0)


@pytest.mark.parametrize("method", ["nearest", "half_even"])
def test_tails_of_a_busy_group_are_not_gathered(spark, method):
    values = [float(i * 37 % 1001) for i in range(3000)] + [7.0] * 500
    df = spark.createDataFrame([("k", v) for v in values] + [("k", None), (None, 3.0), ("none", None)], "k string, v double")
    out = trials.tails(df, ["k"], "v", method, (500.0,))
    assert "collect_list" not in out._jdf.queryExecution().toString()
    got, ordered = {r["k"]: r for r in out.collect()}, sorted(values)
    rank = (lambda q: int(q * (len(values) - 1) + 0.5)) if method == "nearest" else (lambda q: round(q * (len(values) - 1)))
    assert [got["k"][f"p{q}"] for q in (90, 95, 99)] == [ordered[rank(q / 100)] for q in (90, 95, 99)]
    assert (got["k"]["n"], got["k"]["max"], got["k"]["over_500"]) == (3500, 1000.0, sum(v > 500 for v in values))
    assert (got[None]["p99"], got["none"]["n"], got["none"]["p90"]) == (3.0, 0, None)


def test_pooled_bootstrap_draws_all_repeats(spark):
    a, b = [float(i % 97) for i in range(6000)], [50.0] * 3000 + [float(i % 31) for i in range(900)]
    rows = [("k", True, x) for x in a] + [("k", False, x) for x in b] + [(None, True, 4.0), (None, False, 2.0), ("half", True, 1.0), ("k", True, None)]
    df = spark.createDataFrame(rows, "k string, top boolean, v double")
    run = lambda d: {r["k"]: r for r in trials.bootstrap_pooled(d, ["k"], "v", F.col("top"), ~F.col("top"), draws=2000, block_rows=1000).collect()}
    got = run(df.repartition(7))
    ratio = np.mean(a) / np.mean(b)
    deviation = ratio * np.sqrt(np.var(a) / len(a) / np.mean(a) ** 2 + np.var(b) / len(b) / np.mean(b) ** 2)
    assert set(got) == {"k", None} and abs(got["k"]["ratio"] - ratio) < 1e-9
    assert abs((got["k"]["ci_high"] - got["k"]["ci_low"]) / (2 * 1.96 * deviation) - 1) < 0.1
    assert (got[None]["ratio"], got[None]["ci_low"], got[None]["ci_high"]) == (2.0, 2.0, 2.0)
    assert abs(run(df.coalesce(1))["k"]["ci_low"] - got["k"]["ci_low"]) < 1e-9


def test_bootstrap_query_is_of_all_repeats(spark):
    got = {(r["model"], r["device"]): r for r in trial_queries.bootstrap(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").toPandas()
    rows["base"] = rows.l_suppkey % 5 == 0
    for cell, x in rows.groupby(["l_returnflag", "l_linestatus"]):
        assert abs(x[x.base].l_extendedprice.mean() / x[~x.base].l_extendedprice.mean() - got[cell]["ratio"]) < 1e-5
        assert got[cell]["ci_low"] < got[cell]["ratio"] < got[cell]["ci_high"]


def test_files_of_an_archive(spark, tmp_path):
    for name in ("X/a.MSEED", "Y/b.mseed", "Y/c.txt", "20240101T000000Z_20240101T000100Z/d.sac"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    files = readers.waveform_files(readers.list_files(spark, str(tmp_path)))
    assert files.count() == 3
    assert [r["station"] for r in readers.stations_of(files).collect()] == ["X", "Y"]
    with pytest.raises(Exception, match="asked for 3"):
        readers.select_stations(readers.stations_of(files), 3).collect()


def test_synthetic_network_is_found_by_the_stand_in(spark):
    s = readers.synthetic_network(spark, 3, 600, 1)
    z = s.filter("cha = 'HHZ'").select("sta", "p_sample", F.col("samples").cast("array<double>").alias("x"))
    p = picks.annotate(z, "x", 600, "stand-in/energy").withColumn("i", picks.onsets(F.col("prob"), 0.85, 50))
    for r in p.collect():
        assert any(abs(i - r["p_sample"]) <= 30 for i in r["i"])
    named = readers.synthetic_network(spark, spark.createDataFrame([("S0001", 1), ("X", 2)], "sta string, other int"), 600, 1)
    both = [sorted((r["cha"], r["p_sample"], tuple(r["samples"])) for r in d.filter("sta = 'S0001'").collect()) for d in (s, named)]
    assert both[0] == both[1] and named.count() == 6


# --- streams


def test_launch_groups_rule():
    got = K.launch_groups([("a", 0.0), ("b", 1.0), ("c", 9.0)], 3, 5.0)
    assert got == [(5.0, ["a", "b"]), (14.0, ["c"])]
    assert K.launch_groups([("a", 58.0)], 3, 5.0) == [(60.0, ["a"])]
    assert [t for t, _ in K.launch_groups([("a", 3.0), ("b", 4.0)], 1, 5.0)] == [3.0, 4.0]


def test_streamed_groups_equal_their_batch_twin(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [("p" + str(i % 2), f"s{i:02d}", float(t)) for i, t in enumerate(np.sort(rng.uniform(0, 170, 40)).round(2))]
    for n in range(4):
        part = [(p, s, T0 + dt.timedelta(seconds=t), t + (T0 - dt.datetime(1970, 1, 1)).total_seconds()) for p, s, t in rows[n * 10 : n * 10 + 10]]
        spark.createDataFrame(part, "pool string, station string, ready timestamp, ready_s double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = [("p" + str(i), "end", T0 + dt.timedelta(seconds=9000), 9000 + (T0 - dt.datetime(1970, 1, 1)).total_seconds()) for i in range(2)]
    spark.createDataFrame(late, "pool string, station string, ready timestamp, ready_s double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("pool string, station string, ready timestamp, ready_s double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = K.stream_groups(source, 4, 8.0).writeStream.format("memory").queryName("groups").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["pool"], round(r["fire_s"], 3), tuple(sorted(r["stations"]))) for r in spark.table("groups").collect() if "end" not in r["stations"]}
    flat = spark.read.parquet(str(tmp_path / "in")).filter("station <> 'end'")
    want = {(r["pool"], round(r["fire_s"], 3), tuple(sorted(r["stations"]))) for r in K.batch_groups(flat, "pool", 4, 8.0).collect()}
    assert got == want


def test_streamed_chunks_equal_their_batch_twin(spark, tmp_path):
    rows = [(f"s{i}", T0 + dt.timedelta(seconds=7 * i)) for i in range(40)] + [("end", T0 + dt.timedelta(hours=2))]
    spark.createDataFrame(rows, "station string, ready timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("station string, ready timestamp").parquet(str(tmp_path / "in"))
    q = K.stations_per_chunk(source).writeStream.format("memory").queryName("chunks").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = K.stations_per_chunk(spark.read.parquet(str(tmp_path / "in")).filter("station <> 'end'"))
    assert {tuple(r) for r in spark.table("chunks").collect()} == {tuple(r) for r in batch.collect()}


def test_streamed_picks_equal_batch_picks(spark, tmp_path):
    s = readers.synthetic_network(spark, 2, 400, 3).select(F.concat("sta", "cha").alias("station"), F.col("samples").cast("array<double>").alias("samples"))
    s.write.parquet(str(tmp_path / "in"))
    q = K.stream_picks(spark, str(tmp_path / "in"), "station string, samples array<double>", 200, 50, "stand-in/energy", 0.6, 20)
    q = q.writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    w = prep.sliding_windows(spark.read.parquet(str(tmp_path / "in")), "samples", 200, 50)
    batch = picks.trace_picks(picks.annotate(w, "window", 200, "stand-in/energy"), ["station"], "prob", 0.6, 20)
    assert sorted(map(tuple, spark.table("found").collect())) == sorted(map(tuple, batch.collect()))
