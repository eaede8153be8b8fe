"""Chunks conditioned in stretches against plain passes over whole traces; filters and resamplers against their definitions."""

import datetime as dt
import os
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeframe.operators import conditioning as C
from quakeframe.operators import picks, prep

T0 = dt.datetime(2024, 1, 1, 0, 9, tzinfo=dt.UTC)
SEGMENT = "net string, sta string, loc string, cha string, start timestamp, sr double, samples array<double>"


def recursion(x, kind, sr, low, high, corners):
    """The difference equation, sample by sample, section by section."""
    top, sections = C.butterworth(kind, sr, low, high, corners)
    y = np.array([sum(c * x[i - k] for k, c in enumerate(top) if i >= k) for i in range(len(x))])
    for a1, a2 in sections:
        for i in range(len(y)):
            y[i] -= (a1 * y[i - 1] if i > 0 else 0) + (a2 * y[i - 2] if i > 1 else 0)
    return y


@pytest.mark.parametrize("kind,low,high", [("bandpass", 1.0, 20.0), ("bandstop", 5.0, 12.0), ("lowpass", 0.0, 8.0), ("highpass", 3.0, 99.0)])
@pytest.mark.parametrize("corners", [1, 2, 3, 4])
def test_butterworth_gain(kind, low, high, corners):
    h = C.response(kind, 100.0, low, high, corners, 1 << 13)
    gain = lambda f: abs(np.sum(h * np.exp(-2j * np.pi * f / 100 * np.arange(len(h)))))
    for corner in {"lowpass": [high], "highpass": [low]}.get(kind, [low, high]):
        assert gain(corner) == pytest.approx(np.sqrt(0.5), abs=1e-6)
    inside = {"bandpass": 5.0, "bandstop": 0.0, "lowpass": 0.0, "highpass": 50.0}[kind]
    outside = {"bandpass": 0.0, "bandstop": 7.8, "lowpass": 49.9, "highpass": 0.0}[kind]
    assert gain(inside) > 0.9 and gain(outside) < 0.12
    x = np.random.default_rng(1).normal(size=150)
    y = recursion(x, kind, 100.0, low, high, corners)
    assert np.allclose(C.filtered(x, C.response(kind, 100.0, low, high, corners, 150), False), y, atol=1e-10)
    both = recursion(y[::-1], kind, 100.0, low, high, corners)[::-1]
    assert np.allclose(C.filtered(x, C.response(kind, 100.0, low, high, corners, 150), True), both, atol=1e-10)


def test_upper_corner_beyond_half_the_rate_and_unknown_kinds():
    assert np.allclose(C.response("bandpass", 20.0, 1.0, 45.0, 2, 99), C.response("highpass", 20.0, 1.0, 0.0, 2, 99))
    assert C.response("lowpass", 20.0, 0.0, 45.0, 2, 3).tolist() == [1, 0, 0]
    with pytest.raises(ValueError):
        C.butterworth("comb", 20.0, 1.0, 2.0, 2)


def test_sinc_removes_tones_that_the_target_cannot_hold(spark):
    t = np.arange(4000) / 100.0
    rows = [(np.sin(2 * np.pi * f * t).tolist(), 100.0) for f in (3.0, 17.0, 31.0)] + [([], 100.0), ([1.0], 100.0), ([2.0] * 500, 100.0)]
    df = spark.createDataFrame(rows, "samples array<double>, sr double")
    low, high, higher, none, single, flat = [np.array(r["samples"]) for r in C.resample_waveforms(df, 20.0).collect()]
    inner = slice(100, -100)
    assert np.abs(low[inner] - np.sin(2 * np.pi * 3 * np.arange(len(low)) / 20)[inner]).max() < 1e-3
    assert np.abs(high[inner]).max() < 1e-2 and np.abs(higher[inner]).max() < 1e-2
    assert len(low) == 800 and len(none) == 0 and len(single) == 1 and np.allclose(flat[40:-40], 2.0)
    linear = np.array(C.resample_waveforms(df, 20.0, "linear").collect()[1]["samples"])
    assert np.abs(linear[inner]).max() > 0.5


def network(rng, sr):
    """Two stations of three channels; Z of the first in overlapping pieces with a gap, N beginning late."""
    rows, whole = [], {}
    for sta in ("A", "B"):
        for cha, late in (("HHZ", 0), ("HHN", 37), ("HH1", 5)):
            n = round(150 * sr) - late
            x = np.cumsum(rng.normal(size=n)) + 5
            pieces = [(0, n)]
            if (sta, cha) == ("A", "HHZ"):
                pieces = [(0, 700), (600, 1500), (1700, n)]
                x[1500:1700] = 0
            for a, b in pieces:
                part = x[a:b].copy()
                if a == 0 and len(pieces) > 1:
                    part[600:] = -99  # the later piece wins
                rows.append(("XX", sta, "", cha, T0 + dt.timedelta(seconds=(late + a) / sr), sr, part.tolist()))
            whole[sta, cha] = (late, x)
    return rows, whole


def plain_chunks(late, x, sr, target, chunk_s, fmin, fmax, method, light):
    """(first output sample, values) by chunk, of the whole trace; samples are numbered from the epoch."""
    begin, out = round(T0.timestamp() * sr) + late, {}
    per = round(chunk_s * sr)
    for chunk in range(begin // per, (begin + len(x) - 1) // per + 1):
        a, b = max(begin, chunk * per), min(begin + len(x), (chunk + 1) * per)
        y = x[a - begin : b - begin] - x[a - begin : b - begin].mean()
        n = len(y)
        if not light:
            w = min(int(5 * sr), n // 2)
            edge = np.minimum(np.arange(n), np.arange(n)[::-1])
            y = y * np.where(edge >= w, 1.0, 0.5 * (1 - np.cos(np.pi * edge / w)))
            y = recursion(recursion(y, "bandpass", sr, fmin, fmax, 2)[::-1], "bandpass", sr, fmin, fmax, 2)[::-1]
        p, q = C.steps(sr, target)
        j = np.arange(-(-a * p // q), (b - 1) * p // q + 1)
        if method == "linear":
            z = np.interp((j * q - a * p) / p, np.arange(n), y)
        else:
            z = np.zeros(len(j))
            g = C.taps(p, q, 16, 0.9)
            r = g.shape[1] // 2
            for m, v in enumerate(j):
                base = v * q // p - a
                z[m] = sum(g[v * q % p][k + r] * y[base + k] for k in range(-r, r + 1) if 0 <= base + k < n)
        out[chunk] = (int(j[0]), z)
    return out


@pytest.mark.parametrize("sr,target,method,light", [(20.0, 20.0, "linear", False), (20.0, 50.0, "linear", False), (20.0, 8.0, "sinc", False), (20.0, 50.0, "sinc", True)])
def test_chunks_in_stretches_equal_whole_traces(spark, sr, target, method, light):
    rows, whole = network(np.random.default_rng(7), sr)
    overrides = spark.createDataFrame([("B", 2.0, 6.0)], "sta string, hp double, lp double")
    df = spark.createDataFrame(rows, SEGMENT).repartition(3)
    got = C.prepare_chunks(df, overrides, target, 60.0, 10.0, light, 1.0, 9.0, method=method).collect()
    held = {}
    for r in sorted(got, key=lambda r: r["at"]):
        begin, xs = held.setdefault((r["sta"], r["chunk"]), (r["at"], [[], [], []]))
        assert begin + len(xs[0]) == r["at"]  # stretches join without a gap
        assert all(len(x) == len(r["xs"][0]) for x in r["xs"])
        for k in range(3):
            xs[k].extend(r["xs"][k])
    for sta in ("A", "B"):
        fmin, fmax = (1.0, 9.0) if sta == "A" else (2.0, 6.0)
        want = [plain_chunks(*whole[sta, c], sr, target, 60.0, fmin, fmax, method, light) for c in ("HHZ", "HHN", "HH1")]
        chunks = [c for c in want[0] if all(c in w for w in want)]
        assert len(chunks) >= 3 and sorted(c for s, c in held if s == sta) == sorted(chunks)
        for c in chunks:
            a = max(w[c][0] for w in want)
            b = min(w[c][0] + len(w[c][1]) for w in want)
            begin, xs = held[sta, c]
            assert begin == a
            for k in range(3):
                at, z = want[k][c]
                assert np.abs(np.array(xs[k]) - z[a - at : b - at]).max() < 1e-9


def test_windows_cross_stretches(spark):
    rows, _ = network(np.random.default_rng(3), 20.0)
    prepared = C.prepare_chunks(spark.createDataFrame(rows, SEGMENT), None, 20.0, 60.0, 10.0, True)
    traces = {}
    for r in sorted(prepared.collect(), key=lambda r: r["at"]):
        traces.setdefault((r["sta"], r["chunk"]), []).append(np.array(r["xs"]))
    for n, overlap in ((300, 100), (64, 0), (5000, 7), (250, 249)):
        got = C.windows_over_stretches(prepared, ["sta", "chunk"], n, overlap).collect()
        by = {}
        for r in got:
            by.setdefault((r["sta"], r["chunk"]), []).append(r)
        assert set(by) == set(traces)
        for key, parts in traces.items():
            x = np.concatenate(parts, axis=1)
            t, step = x.shape[1], n - overlap
            starts = list(range(0, t - n + 1, step)) or [0]
            if t > n and starts[-1] + n < t:
                starts.append(t - n)
            own = sorted(by[key], key=lambda r: r["win_idx"])
            assert [r["w_start"] for r in own] == starts and [r["win_idx"] for r in own] == list(range(len(starts)))
            for r in own[:: max(1, len(own) // 7)]:
                want = np.zeros((3, n))
                part = x[:, r["w_start"] : r["w_start"] + n]
                want[:, : part.shape[1]] = part
                assert np.allclose(np.array(r["window"]), want, atol=1e-9)  # means are summed in any order


def test_merged_stretches_equal_a_plain_overlay(spark):
    """Segments within, over and beside each other, gaps of whole stretches, a channel without a location."""
    rng, rows, want = np.random.default_rng(5), [], {}
    for cha, loc, spans in (("HHZ", "", [(3, 40), (10, 15), (12, 31), (95, 99)]), ("HHN", None, [(20, 21), (0, 64)]), ("HHE", "00", [(7, 8)])):
        base, whole = min(a for a, _ in spans), np.zeros(max(b for _, b in spans))
        parts = [(a, rng.normal(size=b - a)) for a, b in spans]
        for a, x in sorted(parts, key=lambda v: v[0]):
            whole[a : a + len(x)] = x
        rows += [("XX", "A", loc, cha, T0 + dt.timedelta(seconds=a), 1.0, x.tolist()) for a, x in parts]
        want[cha, loc] = (base, whole[base:])
    got = {}
    for r in sorted(prep.merge_segments(spark.createDataFrame(rows, SEGMENT).repartition(3), 10.0).collect(), key=lambda r: r["start"]):
        begin, held = got.setdefault((r["cha"], r["loc"]), (r["start"], []))
        assert r["start"] == begin + dt.timedelta(seconds=len(held)) and 0 < len(r["samples"]) <= 10
        held.extend(r["samples"])
    assert {k: ((begin.replace(tzinfo=dt.UTC) - T0).total_seconds(), held) for k, (begin, held) in got.items()} == {k: (base, x.tolist()) for k, (base, x) in want.items()}


@pytest.mark.parametrize("method,light", [("linear", False), ("sinc", False), ("sinc", True)])
@pytest.mark.parametrize("stretches", [1, 2, 4])
def test_blocks_of_a_chunk_equal_one_pass(spark, monkeypatch, stretches, method, light):
    rows, _ = network(np.random.default_rng(11), 20.0)
    df = spark.createDataFrame(rows, SEGMENT).repartition(3)

    def prepared():
        out = C.prepare_chunks(df, None, 50.0, 60.0, 10.0, light, 1.0, 9.0, method=method).collect()
        return {(r["sta"], r["chunk"], r["stretch"]): (r["at"], r["first_out"], r["stop_out"], np.array(r["xs"])) for r in out}

    whole = prepared()
    monkeypatch.setattr(C, "BLOCK", stretches * 500)
    dealt = prepared()
    assert whole.keys() == dealt.keys() and len(whole) > 20
    for key, (*numbers, xs) in dealt.items():
        assert numbers == list(whole[key][:3]) and np.abs(xs - whole[key][3]).max() < 1e-9
    each = C.condition_chunks(prep.merge_segments(df, 10.0).withColumns({"fmin": F.lit(1.0), "fmax": F.lit(9.0)}), 50.0, 60.0, 10.0, kind=None if light else "bandpass", method=method)
    letters = {"Z": 0, "N": 1, "1": 2}
    for r in each.collect():
        at, _, _, xs = whole.get((r["sta"], r["chunk"], r["stretch"]), (0, 0, 0, np.zeros((3, 0))))
        own = xs[letters[r["cha"][-1]]]
        assert np.abs(np.array(r["samples"])[at - r["at"] :][: len(own)] - own).max(initial=0) < 1e-9


def workers():
    """Processes of Python below this process's JVM."""
    parents = {}
    for stat in Path("/proc").glob("[0-9]*/stat"):
        try:
            parents[int(stat.parent.name)] = int(stat.read_text().rpartition(")")[2].split()[1])
        except OSError:
            pass
    below = {os.getpid()}
    while more := {p for p, parent in parents.items() if parent in below} - below:
        below |= more
    return [Path(f"/proc/{p}") for p in below - {os.getpid()} if Path(f"/proc/{p}/cmdline").exists() and b"pyspark" in Path(f"/proc/{p}/cmdline").read_bytes() and b"java" not in Path(f"/proc/{p}/cmdline").read_bytes().split(b"\0")[0]]


def test_memory_and_shuffle_of_conditioning(spark):
    """Whatever a task's share, a Python worker holds one block, and conditioned samples go through no shuffle."""
    x = F.transform(F.sequence(F.lit(0), F.lit(1199)), lambda i: F.sin(i * 0.7 + F.col("id")))
    cha = F.explode(F.array(*[F.lit(c) for c in ("HHZ", "HHN", "HHE")])).alias("cha")
    start = F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 60000000).alias("start")
    rows = spark.range(0, 2400, 1, 4).select(F.lit("XX").alias("net"), F.lit("A").alias("sta"), F.lit("").alias("loc"), cha, start, F.lit(20.0).alias("sr"), x.alias("samples"))
    prepared = C.prepare_chunks(rows, None, 100.0, 600.0, low=1.0, high=9.0)
    plan = prepared._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Exchange" not in re.split(r"\w+In(?:Arrow|Pandas)", plan)[0]
    for p in workers():
        (p / "clear_refs").write_text("5")  # the peak counts anew
    got = prepared.agg(F.count("*"), F.sum(F.size(F.get("xs", F.lit(2))))).first()
    assert got[0] == 2400 and got[1] > 2400 * 5990
    peaks = [int(re.search(r"VmHWM:\s+(\d+)", (p / "status").read_text())[1]) / 1024 for p in workers()]
    assert peaks and max(peaks) < 300


def test_chunk_of_whole_stretches_only(spark):
    df = spark.createDataFrame([], SEGMENT)
    assert C.prepare_chunks(df, None, 20.0, 60.0, 10.0).count() == 0
    with pytest.raises(ValueError):
        C.prepare_chunks(df, None, 20.0, 60.0, 7.0)


def test_tensor_windows_give_one_pass_for_all_channels(spark):
    calls = spark.sparkContext.accumulator(0)

    def make():
        def predict(x):
            assert x.ndim == 3 and x.shape[1:] == (3, 4)
            calls.add(1)
            return np.stack([x.sum(axis=1), x[:, 0] - x[:, 2]], axis=1)

        return predict

    rows = [(i, [[float(i + k + j) for j in range(4)] for k in range(3)]) for i in range(10)]
    df = spark.createDataFrame(rows, "i int, window array<array<double>>").coalesce(1)
    got = picks.annotate(df, "window", (3, 4), make, 4, channels=("P", "S"), warm_up=2).collect()
    for r in got:
        x = np.array(rows[r["i"]][1])
        assert r["prob"]["P"] == x.sum(axis=0).tolist() and r["prob"]["S"] == (x[0] - x[2]).tolist()
    assert calls.value >= 2 + 3
    both = picks.annotate_branches(df, "window", (3, 4), {"P": lambda: lambda x: x[:, 0], "S": lambda: lambda x: x[:, 1]}).collect()
    assert {(r["i"], r["phase"], tuple(r["prob"])) for r in both} == {(i, p, tuple(x[k])) for i, x in rows for k, p in enumerate("PS")}


def test_peak_values_of_triggers(spark):
    p = [0.0, 0.6, 0.9, 0.9, 0.2, 0.7, 0.1, 0.8, float("nan"), 0.1, 0.6, 0.95]
    df = spark.createDataFrame([("a", 100, p)], "station string, at long, p array<double>")
    row = df.select(picks.triggers(F.col("p"), 0.5, 4).alias("t")).first()["t"]
    assert [(r["onset"], r["peak"], r["value"]) for r in row[:2]] == [(1, 2, 0.9), (5, 5, 0.7)]
    got = picks.trace_picks(df, ["station"], "p", 0.5, 4, F.col("at"), "prob").collect()
    assert [(r["sample"], r["prob"]) for r in got[:2]] == [(101, 0.9), (105, 0.7)]
