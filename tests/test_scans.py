"""Ordered scans and quantiles against plain loops, with one key that holds most rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeframe.operators import metrics, scans, trials
from quakeframe.sources import sinks
from quakeframe.streaming import stations as K


@pytest.fixture(scope="module", autouse=True)
def many_ranges(spark):
    """Small tables keep all their ranges, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def busy(spark):
    """Rows (k, t, v): one key with two thirds of all rows, ties and nulls in v, a null key."""
    rng = np.random.default_rng(4)
    keys = ["busy"] * 2000 + ["other"] * 900 + ["single"] + [None] * 99
    rows = [(k, float(t), None if rng.random() < 0.1 else float(np.round(rng.normal(), 1))) for k, t in zip(keys, rng.permutation(3000) / 4, strict=True)]
    return rows, spark.createDataFrame(rows, "k string, t double, v double").repartition(5)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


def test_busy_keys_spread_over_ranges(spark, busy):
    rows, df = busy
    parts = scans.dealt(df, ["k"], ["t"])
    assert parts.filter("k = 'busy'").select("__range").distinct().count() >= 2
    assert parts.count() == len(rows)


def test_scan_equals_a_loop(spark, busy):
    rows, df = busy
    parts = scans.dealt(df, ["k"], ["t"])
    got = scans.carried(parts, ["k"], ["t"], {"total": F.col("v"), "place": F.lit(1)}, {"top": F.col("v")}, {"before": F.col("v"), "when": F.col("t")}).collect()
    held = {(r["k"], r["t"]): r for r in got}
    assert len(got) == len(rows)
    for k, own in by_key(rows).items():
        total, top, before, when = 0.0, None, None, None
        for i, (_, t, v) in enumerate(own):
            total += v or 0.0
            top = v if top is None or v is not None and v > top else top
            r = held[k, t]
            assert r["total"] == pytest.approx(total) and (r["place"], r["top"], r["before"], r["when"]) == (i + 1, top, before, when)
            before, when = v, t


def test_quantiles_equal_numpy(spark, busy):
    rows, df = busy
    points = {"v": [("v50", 0.5), ("v95", 0.95), ("v0", 0.0), ("v100", 1.0)], "t": [("t25", 0.25)], "none": [("n50", 0.5)]}
    got = {r["k"]: r for r in scans.quantiles(df, ["k"], {"v": F.col("v"), "t": F.col("t"), "none": F.lit(None)}, points).collect()}
    for k, own in by_key(rows).items():
        v = [r[2] for r in own if r[2] is not None]
        want = [float(np.quantile(v, q)) if v else None for q in (0.5, 0.95, 0.0, 1.0)]
        assert [got[k][c] for c in ("v50", "v95", "v0", "v100")] == (pytest.approx(want) if v else want)
        assert got[k]["t25"] == pytest.approx(float(np.quantile([r[1] for r in own], 0.25))) and got[k]["n50"] is None
    odd = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0), ("b", None)], "k string, v double")
    one = scans.with_quantiles(odd.groupBy("k").agg(F.count("v").alias("n")), odd, ["k"], {"v": F.col("v")}, {"v": [("m", 0.5), ("top", 1.0)]}).orderBy("k").collect()
    assert (one[0]["m"], one[1]["m"], one[1]["n"]) == (3.0, None, 0) and math.isnan(one[0]["top"])
    whole = scans.with_quantiles(df.agg(F.count("v").alias("n")), df, [], {"v": F.col("v")}, {"v": [("m", 0.5)]}).first()
    assert whole["m"] == pytest.approx(float(np.median([r[2] for r in rows if r[2] is not None])))
    assert scans.quantiles(df.filter(F.lit(False)), ["k"], {"v": F.col("v")}, {"v": [("m", 0.5)]}).count() == 0


def test_operators_on_a_busy_key(spark, busy):
    rows, df = busy
    own = by_key(rows)["busy"]
    d = [r[2] for r in own if r[2] is not None]
    r = {x["k"]: x for x in metrics.delta_statistics(df, ["k"], "v").collect()}["busy"]
    assert r["median_samples"] == pytest.approx(np.median(d)) and r["p95_ms"] == pytest.approx(10 * np.quantile(np.abs(d), 0.95)) and r["std_samples"] == pytest.approx(np.std(d))
    r = {x["k"]: x for x in trials.collapse_repeats(df, ["k", "absent"], ["v", "t"]).collect()}["busy"]
    assert (r["v_median"], r["v_count"]) == (pytest.approx(np.median(d)), len(d))
    r = {x["k"]: x for x in trials.device_energy(df.withColumn("p", F.abs("t")), ["k"], "t", "p", {"p": ""}).collect()}["busy"]
    t = np.array([x[1] for x in own])
    assert r["energy"] == pytest.approx(np.trapezoid(t, t))
    r = {x["k"]: x for x in trials.resource_rollup(df.withColumn("c", F.pmod(F.col("t") * 7, F.lit(100.0))), ["k"], "t", "t", "c", 100.0).collect()}["busy"]
    c = np.mod(t * 7, 100.0)
    assert r["gain"] == pytest.approx(float(np.where(np.diff(c) < 0, np.diff(c) + 100, np.diff(c)).sum()))


def test_paced_stream_of_one_key(spark):
    rng = np.random.default_rng(1)
    work = rng.exponential(50, 1500)
    df = spark.createDataFrame([("s", i, float(w)) for i, w in enumerate(work)] + [("z", 0, 1.0)], "stream string, feed_index int, work_s double")
    got = {r["feed_index"]: r for r in K.paced(df, 60.0).filter("stream = 's'").collect()}
    end = 0.0
    for i, w in enumerate(work):
        start = max(60.0 * i, end)
        assert got[i]["start_s"] == pytest.approx(start) and got[i]["wait_s"] == pytest.approx(max(60.0 * i - end, 0.0), abs=1e-6) and got[i]["late_s"] == pytest.approx(start - 60.0 * i, abs=1e-6)
        end = start + w
    assert len(got) == 1500


def test_logs_of_one_busy_station(spark):
    rows = [("A", "P" if i % 3 else "S", 1_700_000_000_000_000 + (i * 7919 % 3001) * 1_000_000) for i in range(3001)]
    df = spark.createDataFrame(rows, "station string, phase string, us long").withColumn("t", F.timestamp_micros("us"))
    order = [u for *_, u in sorted(rows, key=lambda r: r[2])]
    log = sorted(sinks.pick_log(df).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in log] == list(range(1, 3002)) and [r["line"] for r in log] == sorted(r["line"] for r in log)
    tree = sinks.export_tree(df, spark.createDataFrame([("A",), ("B",)], "station string")).withColumns({"p": F.unix_micros("p_time"), "s": F.unix_micros("s_time")}).collect()
    p = [r[2] for r in sorted(rows, key=lambda r: r[2]) if r[1] == "P"]
    s = [r[2] for r in sorted(rows, key=lambda r: r[2]) if r[1] == "S"]
    assert len(order) == 3001 and sorted((r["rn"], r["p"], r["s"]) for r in tree if r["station"] == "A") == [(i + 1, p[i], s[i] if i < len(s) else None) for i in range(len(p))]
    assert [tuple(r)[1:4] for r in tree if r["station"] == "B"] == [(None, None, None)]


def test_rules_with_open_keys(spark):
    from itertools import product

    from quakeframe.operators import reports

    plan = [(a, b, c) for a, b, c in product(("x", "y", None), (1, 2, None), (True, False))] + [("x", 1, True)]
    rules = [("x", None, None, "m"), (None, 2, True, "c"), ("y", 1, False, "a"), (None, None, False, "z"), ("x", 1, True, "b"), ("x", None, None, "n")]
    df = spark.createDataFrame(plan, "k string, n int, f boolean")
    got = reports.mark_unsupported(df, spark.createDataFrame(rules, "k string, n long, f boolean, reason string"), ["k", "n", "f"]).collect()
    want = []
    for row in plan:
        fits = [r[3] for r in rules if all(v is None or v == row[i] for i, v in enumerate(r[:3]))]
        want.append((*row, min(fits, default=None), "skipped" if fits else "planned"))
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    everything = spark.createDataFrame([(None, None, None, "all")], "k string, n int, f boolean, reason string")
    assert {r["skip_reason"] for r in reports.mark_unsupported(df, everything, ["k", "n", "f"]).collect()} == {"all"}
    assert {r["benchmark_status"] for r in reports.mark_unsupported(df, everything.filter("false"), ["k", "n", "f"]).collect()} == {"planned"}
