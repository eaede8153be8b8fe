"""Preparation of waveforms: chunks, merging, detrending, tapering, filtering, resampling, components, windows.

A segment is a row ``net, sta, loc, cha, start, sr, samples``.  Arrays are transformed inside the row; only merging
and interpolation look across segments, keyed by channel and by short stretches of time, so that a long channel is
never gathered into one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.functions.scalars import let

CHANNEL = ["net", "sta", "loc", "cha"]


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))


def mean(x: Column) -> Column:
    return F.when(F.size(x) > 0, total(x) / F.size(x))


def seconds(t: Column) -> Column:
    """Epoch microseconds of a timestamp."""
    return F.unix_micros(t)


# --- chunks ----------------------------------------------------------------------------------------------------------------


def chunk_grid(spans: DataFrame, minutes: float, overlap: float = 0.0) -> DataFrame:
    """``chunk_no, t_start, t_end`` for each row's ``start, end``: the first start moves back by the overlap, the last end stops at ``end``.

    Later chunks also begin ``overlap`` minutes before the end of their predecessor.
    """
    us = lambda m: F.lit(int(m * 60e6))
    s, e = F.unix_micros("start"), F.unix_micros("end")
    grid = spans.withColumn("b", F.explode(F.sequence(s, F.greatest(e - 1, s), us(minutes))))
    rows = grid.withColumn("chunk_no", ((F.col("b") - s) / int(minutes * 60e6)).cast("int"))
    return rows.select(*spans.columns, "chunk_no", F.timestamp_micros(F.col("b") - us(overlap)).alias("t_start"), F.timestamp_micros(F.least(F.col("b") + us(minutes), e)).alias("t_end"))


def cut_into_chunks(segments: DataFrame, chunks: DataFrame, chunk_minutes: float) -> DataFrame:
    """Pieces of segments by chunk: ``chunk_id`` and the samples inside; each piece loses its mean.

    Both sides are dealt by whole ``chunk_minutes`` buckets of time, so the range condition only filters within one.
    A pair that meets in several buckets counts in the first of them.
    """
    width = int(chunk_minutes * 60e6)
    end = seconds(F.col("start")) + (F.size("samples") * 1e6 / F.col("sr")).cast("long")
    seg = segments.withColumns({"s_us": seconds(F.col("start")), "e_us": end})
    seg = seg.withColumn("s_first", F.floor(F.col("s_us") / width)).withColumn("bucket", F.explode(F.sequence(F.col("s_first"), F.floor((F.col("e_us") - 1) / width))))
    ch = chunks.select("chunk_id", seconds(F.col("t_start")).alias("c0"), seconds(F.col("t_end")).alias("c1"))
    ch = ch.withColumn("c_first", F.floor(F.col("c0") / width)).withColumn("bucket", F.explode(F.sequence(F.col("c_first"), F.floor((F.col("c1") - 1) / width))))
    pieces = seg.join(ch, "bucket").filter("s_us < c1 AND e_us > c0 AND bucket = greatest(s_first, c_first)")
    first = F.greatest(F.lit(0), F.ceil((F.col("c0") - F.col("s_us")) / 1e6 * F.col("sr"))).cast("int")
    last = F.least(F.size("samples"), F.ceil((F.col("c1") - F.col("s_us")) / 1e6 * F.col("sr"))).cast("int")
    cut = F.slice("samples", first + 1, F.greatest(last - first, F.lit(0)))
    out = pieces.withColumns({"piece": cut, "at": F.timestamp_micros(F.col("s_us") + (first * 1e6 / F.col("sr")).cast("long"))})
    return out.filter(F.size("piece") > 0).select(*CHANNEL, F.col("at").alias("start"), "sr", demean(F.col("piece")).alias("samples"), "chunk_id")


def in_window(segments: DataFrame, t0: Column, t1: Column) -> DataFrame:
    """Only samples from ``t0`` to ``t1``; segments outside are pruned by their start where it is a plain column."""
    s, sr = seconds(F.col("start")), F.col("sr")
    first = F.greatest(F.lit(0), F.ceil((seconds(t0) - s) / 1e6 * sr)).cast("int")
    last = F.least(F.size("samples"), F.floor((seconds(t1) - s) / 1e6 * sr) + 1).cast("int")
    rows = segments.filter(F.col("start") <= t1).withColumns({"i": first, "n": F.greatest(last - first, F.lit(0))})
    return rows.filter("n > 0").withColumns({"samples": F.slice("samples", F.col("i") + 1, F.col("n")), "start": F.timestamp_micros(s + (F.col("i") * 1e6 / sr).cast("long"))}).drop("i", "n")


def archive_span(segments: DataFrame) -> DataFrame:
    """Minutes from the first start to the last end; sample values are not read where a count column is given."""
    n = F.col("npts") if "npts" in segments.columns else F.size("samples")
    end = seconds(F.col("start")) + (n * 1e6 / F.col("sr")).cast("long")
    return segments.agg(((F.max(end) - F.min(seconds(F.col("start")))) / 60e6).alias("minutes"))


# --- samples of one segment -------------------------------------------------------------------------------------------------


def demean(x: Column) -> Column:
    return let(mean(x), lambda m: F.transform(x, lambda v: v - m))


def taper(x: Column, sr: Column, at_ends: float = 5.0) -> Column:
    """A raised cosine over the given seconds at each end, at most half of the trace."""
    n = F.size(x)

    def weight(i: Column, w: Column) -> Column:
        edge = F.least(i, n - 1 - i)
        return F.when(edge >= w, F.lit(1.0)).otherwise(0.5 * (1 - F.cos(F.lit(np.pi) * edge / w)))

    width = F.least(F.floor(sr * at_ends), F.floor(n / 2)).cast("int")
    return let(width, lambda w: F.transform(x, lambda v, i: v * weight(i, w)))


def normalise(x: Column, mode: str = "std") -> Column:
    """Subtract the mean, divide by the largest value or by the population deviation; a zero divisor counts as 1."""

    def divisor(centred: Column) -> Column:
        if mode == "max":
            return F.array_max(centred)
        return F.sqrt(F.aggregate(centred, F.lit(0.0), lambda a, v: a + v * v) / F.size(centred))

    return let(demean(x), lambda c: let(divisor(c), lambda d: F.transform(c, lambda v: v / F.when(d == 0, F.lit(1.0)).otherwise(d))))


def filter_parameters(segments: DataFrame, overrides: DataFrame, low: float = 1.0, high: float = 45.0) -> DataFrame:
    """Add ``fmin, fmax``: of the station's override (``sta, hp, lp``), else the defaults."""
    rows = segments.join(overrides.select("sta", "hp", "lp"), "sta", "left")
    return rows.withColumns({"fmin": F.coalesce("hp", F.lit(low)), "fmax": F.coalesce("lp", F.lit(high))}).drop("hp", "lp")


def resample(x: Column, sr: Column, target: float = 100.0) -> Column:
    """Linear interpolation onto a grid of the target rate over the same span."""
    n = F.size(x)
    m = F.when(n > 0, F.floor((n - 1) * target / sr + 1e-9) + 1).otherwise(0).cast("int")

    def at(j: Column) -> Column:
        place = j * sr / target
        i = F.least(F.floor(place + 1e-9), n - 1).cast("int")
        frac = F.greatest(place - i, F.lit(0.0))
        nxt = F.get(x, F.least(i + 1, n - 1))
        return F.get(x, i) * (1 - frac) + nxt * frac

    return F.when(m > 0, F.transform(F.sequence(F.lit(0), m - 1), at)).otherwise(F.array().cast("array<double>"))


# --- segments of one channel --------------------------------------------------------------------------------------------------


def merge_segments(segments: DataFrame, stretch_s: float = 60.0, chunk_s: float | None = None) -> DataFrame:
    """One row per channel and stretch of time, on the grid of the rate: later segments win, gaps are zero.

    Stretches from the first to the last sample of a channel are filled; each is a group of its own, so a day of one
    channel spreads over many tasks.  With ``chunk_s`` rows also have ``chunk``, of so many seconds, and all stretches of
    a station's chunk are merged in one task, so that what needs them together finds them there.
    """
    seg = segments.withColumn("samples", F.col("samples").cast("array<double>")).withColumns({"i0": F.bround(seconds(F.col("start")) / 1e6 * F.col("sr")).cast("long"), "per": F.bround(F.lit(stretch_s) * F.col("sr")).cast("long")})
    seg = seg.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("i0") / F.col("per")), F.floor((F.col("i0") + F.size("samples") - 1) / F.col("per")))))
    lo = F.greatest(F.col("i0"), F.col("stretch") * F.col("per"))
    hi = F.least(F.col("i0") + F.size("samples"), (F.col("stretch") + 1) * F.col("per"))
    seg = seg.withColumns({"off": (lo - F.col("stretch") * F.col("per")).cast("int"), "x": F.slice("samples", (lo - F.col("i0") + 1).cast("int"), (hi - lo).cast("int"))})
    # the grid of stretches joins the pieces as rows of its own, so that one shuffle serves both
    span = seg.groupBy(*CHANNEL, "sr", "per").agg(F.min("i0").alias("first"), F.max(F.col("i0") + F.size("samples")).alias("stop"))
    every = span.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("first") / F.col("per")), F.floor((F.col("stop") - 1) / F.col("per")))))
    part = seg.select(*CHANNEL, "sr", "per", "stretch", F.struct("i0", "off", "x").alias("part"))
    rows, chunk = part.unionByName(every, allowMissingColumns=True), []
    if chunk_s is not None:
        rows, chunk = rows.withColumn("chunk", F.floor(F.col("stretch") / round(chunk_s / stretch_s))).repartition("net", "sta", "chunk"), ["chunk"]
    rows = rows.groupBy(*CHANNEL, "sr", "per", *chunk, "stretch").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.max("first").alias("first"), F.max("stop").alias("stop"))
    begin = F.greatest(F.col("first"), F.col("stretch") * F.col("per"))
    end = F.least(F.col("stop"), (F.col("stretch") + 1) * F.col("per"))
    rows = rows.withColumns({"begin": begin, "n": (end - begin).cast("int"), "shift": (begin - F.col("stretch") * F.col("per")).cast("int")})
    zeros = lambda n: F.array_repeat(F.lit(0.0), F.greatest(n, F.lit(0)))

    def overlay(acc: Column, p: Column) -> Column:
        x, over = p["x"], p["off"] + F.size(p["x"])
        return F.concat(F.slice(acc, F.lit(1), p["off"]), zeros(p["off"] - F.size(acc)), x, F.slice(acc, over + 1, F.greatest(F.size(acc) - over, F.lit(0))))

    # parts are sorted by start, so where two cover a sample the later wins; what is built so far ends with its last part
    whole = F.aggregate("parts", F.array().cast("array<double>"), overlay)
    samples = let(F.slice(whole, F.col("shift") + 1, F.col("n")), lambda x: F.concat(x, zeros(F.col("n") - F.size(x))))
    return rows.select(*CHANNEL, F.timestamp_micros((F.col("begin") * 1e6 / F.col("sr")).cast("long")).alias("start"), "sr", *chunk, samples.alias("samples"))


# --- components of one station --------------------------------------------------------------------------------------------------


def component_rank(cha: Column) -> Column:
    """Component letter and preference of a channel by its last letter: N before 2, E before 1."""
    last = F.right(F.upper(cha), F.lit(1))
    letter = F.when(last.isin("Z"), "Z").when(last.isin("N", "2"), "N").when(last.isin("E", "1"), "E")
    return F.struct(letter.alias("letter"), F.when(last.isin("1", "2"), 1).otherwise(0).alias("rank"))


def strict_components(segments: DataFrame, keys: list[str], order: str = "ZNE") -> DataFrame:
    """``keys, start, sr, components`` of stations with all three components; the others are left out."""
    r = segments.withColumn("c", component_rank(F.col("cha"))).filter("c.letter IS NOT NULL")
    pick = lambda c: F.min(F.when(F.col("c.letter") == c, F.struct("c.rank", "cha", "start", "sr", "samples")))
    wide = r.groupBy(*keys).agg(*[pick(c).alias(c) for c in "ZNE"]).filter("Z IS NOT NULL AND N IS NOT NULL AND E IS NOT NULL")
    return wide.select(*keys, F.array(*[F.struct(F.col(f"{c}.start").alias("start"), F.col(f"{c}.sr").alias("sr"), F.col(f"{c}.samples").alias("samples")) for c in order]).alias("components"))


def common_interval(stations: DataFrame) -> DataFrame:
    """Trim all components to their common interval and their shortest length; stations without one are left out."""
    us = lambda c: seconds(c["start"])
    begin = F.array_max(F.transform("components", us))
    stop = F.array_min(F.transform("components", lambda c: us(c) + ((F.size(c["samples"]) - 1) * 1e6 / c["sr"]).cast("long")))
    rows = stations.withColumns({"begin": begin, "stop": stop}).filter("stop > begin")

    def cut(c: Column) -> Column:
        i = F.bround((F.col("begin") - us(c)) / 1e6 * c["sr"]).cast("int")
        n = F.floor((F.col("stop") - F.col("begin")) / 1e6 * c["sr"] + 1e-6).cast("int") + 1
        return F.slice(c["samples"], i + 1, n)

    rows = rows.withColumn("xs", F.transform("components", cut))
    rows = rows.withColumn("n", F.array_min(F.transform("xs", F.size)))
    keep = [c for c in stations.columns if c != "components"]
    return rows.select(*keep, F.timestamp_micros("begin").alias("start"), F.transform("xs", lambda x: F.slice(x, F.lit(1), F.col("n"))).alias("xs"))


def union_interval(stations: DataFrame) -> DataFrame:
    """Pad all components with zeros to the span of any."""
    us = lambda c: seconds(c["start"])
    begin = F.array_min(F.transform("components", us))
    stop = F.array_max(F.transform("components", lambda c: us(c) + (F.size(c["samples"]) * 1e6 / c["sr"]).cast("long")))
    rows = stations.withColumns({"begin": begin, "stop": stop})

    def pad(c: Column) -> Column:
        before = F.bround((us(c) - F.col("begin")) / 1e6 * c["sr"]).cast("int")
        n = F.bround((F.col("stop") - F.col("begin")) / 1e6 * c["sr"]).cast("int")
        zeros = lambda k: F.array_repeat(F.lit(0.0), F.greatest(k, F.lit(0)))
        return F.concat(zeros(before), F.transform(c["samples"], lambda v: v.cast("double")), zeros(n - before - F.size(c["samples"])))

    keep = [c for c in stations.columns if c != "components"]
    return rows.select(*keep, F.timestamp_micros("begin").alias("start"), F.transform("components", pad).alias("xs"))


def lenient_components(segments: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """``keys, e, n, z, filled``: the channel chosen for each component, and those that stay empty (zero-filled).

    Rungs: last letter (E before 1, N before 2, Z); else, when two are known, a single spare trace as Z; when none is
    known, the first three channels by name as E, N, Z (or as many as there are).  ``strict`` raises instead of
    filling.  The fallback codes end in the same letters, so the first rung already covers them.
    """
    c = component_rank(F.col("cha"))
    pick = lambda x: F.min(F.when(c["letter"] == x, F.struct(c["rank"], F.col("cha"))))["cha"]
    g = segments.groupBy(*keys).agg(pick("E").alias("e0"), pick("N").alias("n0"), pick("Z").alias("z0"), F.array_sort(F.collect_list(F.upper("cha"))).alias("all"))
    known = F.array_compact(F.array("e0", "n0", "z0"))
    spare = F.array_except("all", F.transform(known, F.upper))
    single = F.when(F.col("z0").isNull() & F.col("e0").isNotNull() & F.col("n0").isNotNull() & (F.size(spare) == 1), F.get(spare, F.lit(0)))
    none = F.size(known) == 0
    by_name = lambda i: F.when(none, F.get("all", F.lit(i)))
    out = g.select(*keys, F.coalesce("e0", by_name(0)).alias("e"), F.coalesce("n0", by_name(1)).alias("n"), F.coalesce("z0", single, by_name(2)).alias("z"))
    missing = F.concat_ws(",", *[F.when(F.col(x).isNull(), F.lit(x.upper())) for x in "enz"])
    if strict:
        missing = F.when(missing != "", F.raise_error(F.concat(F.lit("missing components: "), missing)).cast("string")).otherwise(missing)
    return out.withColumn("filled", missing)


def to_traces(stations: DataFrame, array: str, order: str = "ZNE") -> DataFrame:
    """One row per component, with channel ``HH`` and its letter."""
    keep = [c for c in stations.columns if c != array]
    return stations.select(*keep, F.posexplode(array).alias("i", "samples")).withColumn("cha", F.concat(F.lit("HH"), F.substring(F.lit(order), F.col("i") + 1, F.lit(1)))).drop("i")


# --- windows ------------------------------------------------------------------------------------------------------------------


def window_starts(size: Column, n: int, overlap: int = 0) -> Column:
    """Starts of windows of n samples; a tail window reaches the end; a short trace has one window."""
    step = max(1, n - overlap)
    grid = F.sequence(F.lit(0), size - n, F.lit(step))
    with_tail = F.when(F.get(grid, F.size(grid) - 1) + n < size, F.array_append(grid, size - n)).otherwise(grid)
    return F.when(size <= n, F.array(F.lit(0))).otherwise(with_tail)


def padded(x: Column, start: Column, n: int) -> Column:
    """n samples from ``start``, zeros beyond the end."""
    part = F.slice(x, start + 1, F.lit(n))
    return F.concat(part, F.array_repeat(F.lit(0).cast("double"), F.lit(n) - F.size(part)))


def sliding_windows(traces: DataFrame, array: str, n: int, overlap: int = 0) -> DataFrame:
    """One row per window: ``win_idx, w_start, window``."""
    keep = [c for c in traces.columns if c != array]
    rows = traces.select(*keep, F.posexplode(window_starts(F.size(array), n, overlap)).alias("win_idx", "w_start"), array)
    return rows.select(*keep, "win_idx", "w_start", padded(F.col(array), F.col("w_start"), n).alias("window"))


def single_window(x: Column, n: int) -> Column:
    return padded(x, F.lit(0), n)


def stepped_windows(traces: DataFrame, array: str, n: int = 6000, sr: float = 100.0, overlap_min: float = 0.0) -> DataFrame:
    """Fixed windows at a step of whole seconds, the last ones padded; no tail window."""
    step = int(int(n / sr - overlap_min * 60) * sr)
    keep = [c for c in traces.columns if c != array]
    starts = F.sequence(F.lit(0), F.greatest(F.size(array) - 1, F.lit(0)), F.lit(max(step, 1)))
    rows = traces.select(*keep, F.posexplode(starts).alias("win_idx", "w_start"), array)
    return rows.select(*keep, "win_idx", "w_start", padded(F.col(array), F.col("w_start"), n).alias("window"))


def centred_start(pick: Column, size: Column, n: int) -> Column:
    """Start of a window of n samples around a pick, inside the trace."""
    return F.greatest(F.lit(0), F.least(pick - n // 2, size - n)).cast("int")


def centred_window(traces: DataFrame, array: str, pick: str, n: int) -> DataFrame:
    """``w_start, pick_in_window, window`` of traces whose pick lies inside."""
    rows = traces.filter((F.col(pick) >= 0) & (F.col(pick) < F.size(array))).withColumn("w_start", centred_start(F.col(pick), F.size(array), n))
    return rows.withColumns({"pick_in_window": (F.col(pick) - F.col("w_start")).cast("int"), "window": padded(F.col(array), F.col("w_start"), n)})


def aligned_prediction(trace: Column, offset: Column, n: int) -> Column:
    """A window of n values of an annotation trace; places beyond its ends repeat the end value."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.get(trace, F.greatest(F.lit(0), F.least(j + offset, F.size(trace) - 1))))


def signal_to_noise(x: Column, pick: Column, window: int = 200) -> Column:
    """Decibels of the 95th percentile after a pick over that before it, rounded to one decimal.

    Near an edge both sides shorten to it.  Null without a pick, for pick 0, where the window ends exactly at the
    end of the trace, and where either percentile is not positive.
    """
    n = F.size(x)
    side = F.when((pick >= window) & (pick + window < n), F.lit(window)).when((pick < window) & (pick + window < n), pick).when(pick + window > n, n - pick)

    def at(s: Column, place: Column) -> Column:
        i = F.floor(place).cast("int")
        return F.get(s, i) + (F.get(s, F.least(i + 1, F.size(s) - 1)) - F.get(s, i)) * (place - i)

    def p95(part: Column) -> Column:
        return let(F.array_sort(part), lambda s: at(s, (F.size(s) - 1) * 0.95))

    fits = (side > 0) & (pick > 0) & (pick >= side) & (pick < n)
    noise = F.when(fits, p95(F.slice(x, pick - side + 1, side)))
    signal = F.when(fits, p95(F.slice(x, pick + 1, side)))
    return F.when((noise != 0) & (signal != 0), F.bround(20 * F.log10(F.abs(signal / noise)), 1))
