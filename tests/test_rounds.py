"""Chains of claims, spaced picks, draining streams and picking across arrivals, each against a plain loop or its batch twin."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quakeframe.operators import dense, picks, trials
from quakeframe.operators.spacing import spaced
from quakeframe.streaming import stations as K

T0 = dt.datetime(2024, 1, 1)
EPOCH = (T0 - dt.datetime(1970, 1, 1)).total_seconds()


@pytest.mark.parametrize(("n", "fullest", "most"), [(800, 1 << 16, 12), (120, 40, 12)])
def test_a_chain_through_200_stretches_takes_few_rounds(spark, n, fullest, most):
    """Each a would rather have the b before it, which the a before it has taken: claims travel from the first to the last."""
    turns: list[int] = []
    rows = [("k", True, float(i), float(i), None) for i in range(n)] + [("k", False, None, i + 0.6, None) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, is_a boolean, o double, v double, w double")
    got = dense.pair_up(df, ["k"], 1.0, fullest=fullest, on_round=turns.append).collect()
    assert sorted((r["a_v"], r["b_v"]) for r in got if r["side"] == "pair") == [(float(i), i + 0.6) for i in range(n)]
    assert len(got) == n and len(turns) <= most


def plain_spacing(values, least):
    kept = []
    for v in sorted(set(values)):
        if not kept or v - kept[-1] >= least:
            kept.append(v)
    return kept


@pytest.mark.parametrize("least", [0, 1, 7, 400])
def test_spaced_picks_of_a_busy_key_equal_a_plain_loop(spark, least):
    rng = np.random.default_rng(least)
    busy = [int(v) for v in rng.integers(0, 6000, 2500)]
    few = {"a": [5], "b": [-3, -3, 4, 9], None: [100, 101, 107, 110, 500], "wide": [int(v) for v in rng.integers(-(10**9), 10**9, 300)]}
    rows = [("k", v) for v in busy] + [(k, v) for k, vs in few.items() for v in vs] + [("k", None), ("none", None)]
    got: dict = {}
    for r in spaced(spark.createDataFrame(rows, "k string, sample long").repartition(5), ["k"], "sample", least).collect():
        got.setdefault(r["k"], []).append(r["sample"])
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_spacing(v, max(least, 1)) for k, v in {"k": busy, **few}.items()}
    assert spaced(spark.createDataFrame([], "k string, sample long"), ["k"], "sample", least).collect() == []


def streamed(source, name, tmp_path, spark):
    q = source.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


EVENT = "pool string, station string, ready timestamp, ready_s double"


def arrivals(spark, tmp_path, files):
    for rows in files:
        part = [(p, s, T0 + dt.timedelta(seconds=t), t + EPOCH) for p, s, t in rows]
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), spark.read.parquet(str(tmp_path / "in"))


def group_set(rows):
    return sorted((r["pool"] or "", round(r["fire_s"] - EPOCH, 3), tuple(r["stations"])) for r in rows)


def test_the_last_station_fires_what_waits(spark, tmp_path):
    """Three stations a group or five seconds: 0 and 1 fire at 5 s, and 9 fires at 9 s since nobody else is expected."""
    source, flat = arrivals(spark, tmp_path, [[("p", "a", 0.0), ("p", "b", 1.0)], [("p", "c", 9.0)]])
    got = streamed(K.stream_groups(source, 3, 5.0, roster=K.last_chunks(flat)), "drained_few", tmp_path, spark)
    assert group_set(got) == [("p", 5.0, ("a", "b")), ("p", 9.0, ("c",))]


def test_a_draining_stream_equals_its_batch_twin(spark, tmp_path):
    """A station that comes twice, and a null pool, count like any other; a pool without a roster does not drain."""
    rng = np.random.default_rng(1)
    rows = [(("p0", "p1", None)[i % 3], f"s{i % 50:02d}", float(t)) for i, t in enumerate(np.sort(rng.uniform(0, 170, 75)).round(2))]
    source, flat = arrivals(spark, tmp_path, [*[rows[i : i + 20] for i in range(0, 75, 20)], [("z", "end", 9000.0)]])
    flat = flat.filter("pool IS NULL OR pool <> 'z'")
    got = streamed(K.stream_groups(source, 4, 8.0, roster=K.last_chunks(flat)), "drained", tmp_path, spark)
    want = group_set(K.batch_groups(flat, "pool", 4, 8.0, drain=True).collect())
    assert group_set(got) == want != group_set(K.batch_groups(flat, "pool", 4, 8.0).collect())


def plain_continuous(pieces, n, overlap, threshold, least):
    """One station: runs, windows one at a time, the stitched trace, then a plain loop."""
    runs: list[tuple[int, list[float]]] = []
    for at, x in sorted(pieces, key=lambda p: p[0]):
        if not runs or at > runs[-1][0] + len(runs[-1][1]):
            runs.append((at, []))
        runs[-1][1].extend(x[runs[-1][0] + len(runs[-1][1]) - at :])
    predict, step, out = picks.energy_ratio(), n - overlap, []
    for at, x in runs:
        trace: list[float] = []
        for w in range(0, len(x) - n + 1, step):
            p = predict(np.array([x[w : w + n]]))[0]
            trace.extend(p if not w else p[overlap:])
        for i in range(1, len(trace)):
            if trace[i] >= threshold > trace[i - 1] and (not out or at + i - out[-1] >= least):
                out.append(at + i)
    return out


@pytest.mark.parametrize(("n", "overlap"), [(60, 20), (50, 0), (40, 39)])
def test_picks_carry_over_arrivals(spark, tmp_path, n, overlap):
    rng = np.random.default_rng(n)
    want, rows = {}, []
    for sta in ("A", "B", "C"):
        at, pieces = 0, []
        for k in range(14):
            size = int(rng.integers(5, 90))
            x = (rng.standard_normal(size) * np.where(rng.random(size) < 0.04, 12, 0.3)).round(3).tolist()
            pieces.append((at, x))
            at += size + (33 if k in (5, 9) else -4 if k in (2, 7) and size > 8 else 0)
        want[sta] = plain_continuous(pieces, n, overlap, 0.65, 15)
        rows += [(sta, p, T0 + dt.timedelta(seconds=p / 10), x) for p, x in pieces]
    schema = "station string, at long, start timestamp, samples array<double>"
    order = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 120))  # a piece may come after the next one
    order += [(sta, 10**6, T0 + dt.timedelta(hours=9), [0.0]) for sta in ("A", "B", "C", "D")] + [("D", 0, T0 + dt.timedelta(hours=9), [])]
    for i in range(0, len(order), 12):
        spark.createDataFrame(order[i : i + 12], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    got = streamed(K.stream_continuous_picks(source, n, overlap, "stand-in/energy", 0.65, 15), f"carried_{n}", tmp_path, spark)
    batch = K.continuous_picks(spark.read.parquet(str(tmp_path / "in")), n, overlap, "stand-in/energy", 0.65, 15).collect()
    plain = sorted((sta, s) for sta, found in want.items() for s in found)
    assert len(plain) > 20
    assert sorted(map(tuple, batch)) == plain
    assert sorted(map(tuple, got)) == plain


def test_blocks_of_a_tree_share_each_draw_whole():
    """Whatever the blocks hold, their shares add up to the side, with the mean and spread of a multinomial."""
    sizes = np.array([700, 0, 1200, 50, 900, 1100, 1024], dtype=np.int64)  # not a power of two, one block empty
    levels, total, draws = 3, int(sizes.sum()), 20000
    shares = []
    for block, n in enumerate(sizes):
        if n:
            held = [int(sum(m for b, m in enumerate(sizes) if b >> level == block >> level)) for level in range(levels + 1)]
            shares.append(trials._share_of_block(77, block, held, draws))
    got, p = np.array(shares), sizes[sizes > 0] / total
    assert (got.sum(axis=0) == total).all() and (got >= 0).all()
    assert np.allclose(got.mean(axis=1), total * p, rtol=0.01)
    assert np.allclose(np.cov(got), total * (np.diag(p) - np.outer(p, p)), atol=0.05 * total * p.max())


def test_pooled_bootstrap_is_seeded_and_as_wide_as_the_closed_form(spark):
    df = spark.range(20000).select(F.lit("k").alias("k"), (F.col("id") % 4 != 0).alias("top"), (F.col("id") % 251).cast("double").alias("v"))
    run = lambda seed: trials.bootstrap_pooled(df, ["k"], "v", F.col("top"), ~F.col("top"), draws=800, seed=seed, block_rows=500).first()
    a, again, b = run(3), run(3), run(4)
    assert (a["ci_low"], a["ci_high"]) == pytest.approx((again["ci_low"], again["ci_high"]))
    assert a["ci_low"] != b["ci_low"]
    x = np.arange(20000)
    v, top = (x % 251).astype(float), x % 4 != 0
    deviation = np.sqrt(v[top].var() / top.sum() / v[top].mean() ** 2 + v[~top].var() / (~top).sum() / v[~top].mean() ** 2)
    assert (a["ci_high"] - a["ci_low"]) / (2 * 1.96 * deviation * a["ratio"]) == pytest.approx(1, abs=0.12)
