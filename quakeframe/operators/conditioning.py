"""Conditioning of whole chunks that are spread over many tasks.

A chunk of one channel is held as stretches, one row each.  What needs the chunk as a whole is either a small sum (the
mean and the ends of the trace) or reaches only so far (a filter's response, a resampler's taps, a window), so each
stretch is sent to its neighbours as far as they reach, and every row is then worked on alone.  The result equals one
pass over the unsplit chunk, to rounding.
"""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.operators.prep import CHANNEL, component_rank, filter_parameters, merge_segments, total

# --- Butterworth filters


@lru_cache(maxsize=1024)
def butterworth(kind: str, sr: float, low: float, high: float, corners: int) -> tuple[np.ndarray, tuple[tuple[float, float], ...]]:
    """Numerator, and (a1, a2) of each all-pole section, of a digital Butterworth filter by the bilinear transform.

    ``low`` bounds a highpass, ``high`` a lowpass, both a bandpass or bandstop.  An upper corner at or above half the
    rate bounds nothing: a bandpass becomes a highpass, a lowpass passes all.
    """
    if kind not in ("bandpass", "bandstop", "lowpass", "highpass"):
        raise ValueError(f"unknown filter {kind!r}")
    if high >= sr / 2 * (1 - 1e-6) and kind in ("bandpass", "lowpass"):
        if kind == "lowpass":
            return np.ones(1), ()
        kind = "highpass"
    warp = lambda f: 2 * sr * np.tan(np.pi * min(f, sr / 2 * (1 - 1e-6)) / sr)
    poles = np.exp(1j * np.pi * (2 * np.arange(corners) + corners + 1) / (2 * corners))
    if kind == "lowpass":
        poles, zeros, at = warp(high) * poles, [-1.0] * corners, 0.0
    elif kind == "highpass":
        poles, zeros, at = warp(low) / poles, [1.0] * corners, np.pi
    else:
        a, b = warp(low), warp(high)
        half, centre = (b - a) / 2 * (poles if kind == "bandpass" else 1 / poles), a * b
        poles = np.concatenate([half + np.sqrt(half * half - centre), half - np.sqrt(half * half - centre)])
        on = (2 * sr + 1j * np.sqrt(centre)) / (2 * sr - 1j * np.sqrt(centre))
        zeros, at = ([1.0, -1.0] * corners, np.angle(on)) if kind == "bandpass" else ([on, on.conjugate()] * corners, 0.0)
    poles = (2 * sr + poles) / (2 * sr - poles)
    top = np.poly(zeros).real
    e = np.exp(1j * at)
    gain = np.prod(np.abs(e - poles)) / np.abs(np.polyval(top, e))
    pairs = [(-2 * p.real, abs(p) ** 2) for p in poles if p.imag > 1e-12]
    alone = [(-p.real, 0.0) for p in poles if abs(p.imag) <= 1e-12]
    return top * gain, tuple(pairs + alone)


@lru_cache(maxsize=1024)
def response(kind: str, sr: float, low: float, high: float, corners: int, n: int) -> np.ndarray:
    """The first ``n`` values of a filter's response to a unit pulse."""
    top, sections = butterworth(kind, sr, low, high, corners)
    h = np.zeros(max(n, len(top)))
    h[: len(top)] = top
    for a1, a2 in sections:
        one, two, out = 0.0, 0.0, h.tolist()
        for i, v in enumerate(out):
            out[i] = v = v - a1 * one - a2 * two
            one, two = v, one
        h = np.array(out)
    return h[:n]


def convolved(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The first len(x) values of x * h."""
    size = 1 << (len(x) + len(h) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[: len(x)]


def filtered(x: np.ndarray, h: np.ndarray, zero_phase: bool) -> np.ndarray:
    """One pass forward, and for zero phase one backward over its result, both from rest."""
    if not len(x) or not len(h):
        return x
    y = convolved(x, h)
    return convolved(y[::-1], h)[::-1] if zero_phase else y


def filter_waveforms(segments: DataFrame, kind: str = "bandpass", corners: int = 2, zero_phase: bool = True, low: str = "fmin", high: str = "fmax") -> DataFrame:
    """Butterworth filter of each row's whole ``samples``, in Arrow batches; corner frequencies are columns of the row."""
    widened = segments.withColumn("samples", F.col("samples").cast("array<double>"))

    def run(batches):
        for pdf in batches:
            out = []
            for x, rate, a, b in zip(pdf["samples"], pdf["sr"], pdf[low], pdf[high], strict=True):
                x = np.asarray(x, dtype=float)
                out.append(filtered(x, response(kind, rate, a, b, corners, len(x)), zero_phase))
            yield pdf.assign(samples=pd.Series(out, index=pdf.index, dtype=object))

    return widened.mapInPandas(run, widened.schema)


# --- resampling


@lru_cache(maxsize=256)
def taps(p: int, q: int, zeros: int, rolloff: float) -> np.ndarray:
    """Row r: the weights, of samples from ``reach`` before to ``reach`` after, for a place r / p after a sample.

    A sinc with its cutoff at ``rolloff`` of the lower of both Nyquist rates, under a raised cosine that ends at the
    ``zeros``-th zero of the sinc; each row sums to one.
    """
    cutoff = 0.5 * min(1.0, p / q) * rolloff
    width = zeros / (2 * cutoff)
    reach = int(np.ceil(width))
    u = np.arange(-reach, reach + 1) - np.arange(p)[:, None] / p
    g = np.where(np.abs(u) < width, np.sinc(2 * cutoff * u) * 0.5 * (1 + np.cos(np.pi * u / width)), 0.0)
    return g / g.sum(axis=1, keepdims=True)


def steps(sr: float, target: float) -> tuple[int, int]:
    """p, q: sample j of the target rate lies at j q / p samples of the given one."""
    ratio = Fraction(target / sr).limit_denominator(10_000)
    return ratio.numerator, ratio.denominator


def resampled_at(x: np.ndarray, at: int, stop: int, first: int, end: int, p: int, q: int, method: str, zeros: int, rolloff: float) -> np.ndarray:
    """Values of output samples ``first`` to ``end`` of a trace of which ``x`` holds samples from number ``at`` on.

    Numbers count from one origin at both rates.  Beyond sample ``stop - 1``, the trace's last, and before its first,
    which ``at`` then is, samples are zero to the sinc; linear interpolation never looks there.
    """
    if end <= first:
        return np.zeros(0)
    j = np.arange(first, end, dtype=np.int64) * q
    base, phase = j // p - at, j % p
    if method == "linear":
        after = np.minimum(base + 1, stop - 1 - at)
        return x[base] * (1 - phase / p) + x[after] * (phase / p)
    g = taps(p, q, zeros, rolloff)
    reach = g.shape[1] // 2
    held = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(reach), x, np.zeros(reach)]), g.shape[1])
    return np.einsum("ij,ij->i", held[base], g[phase])


def resample_waveforms(segments: DataFrame, target: float, method: str = "sinc", zeros: int = 16, rolloff: float = 0.9) -> DataFrame:
    """Each row's ``samples`` at the ``target`` rate over the same span; ``sr`` becomes the target.

    ``sinc`` removes what the target rate cannot hold, as polyphase weights of a windowed sinc; ``linear`` does not.
    """
    widened = segments.withColumns({"samples": F.col("samples").cast("array<double>"), "sr": F.col("sr").cast("double")})

    def run(batches):
        for pdf in batches:
            out = []
            for x, rate in zip(pdf["samples"], pdf["sr"], strict=True):
                x = np.asarray(x, dtype=float)
                p, q = steps(rate, target)
                end = (len(x) - 1) * p // q + 1 if len(x) else 0
                out.append(resampled_at(x, 0, len(x), 0, end, p, q, method, zeros, rolloff))
            yield pdf.assign(samples=pd.Series(out, index=pdf.index, dtype=object), sr=float(target))

    return widened.mapInPandas(run, widened.schema)


# --- chunks


#: Samples of a channel, at the target rate, that a block of stretches holds at most (a single stretch may hold more).
BLOCK = 1 << 16


def in_block(target: float, chunk_s: float, stretch_s: float) -> tuple[int, int]:
    """Stretches of a chunk, and of a block."""
    n = round(chunk_s / stretch_s)
    return n, min(n, max(1, int(BLOCK / (stretch_s * target))))


def in_chunks(stretches: DataFrame, chunk_s: float, stretch_s: float) -> DataFrame:
    """Number the samples of merged stretches, and add what each needs to know of its chunk.

    Adds ``at`` (number of the row's first sample, from the epoch), ``per`` (samples of a stretch), ``stretch``,
    ``chunk`` (of ``chunk_s`` seconds), ``rate`` (the sampling rate as a key), and of the chunk's whole trace ``first``,
    ``stop`` and ``mean``.  Sums are made per stretch.  A ``chunk`` that the rows have is kept, with the place of its rows.
    """
    per = F.bround(F.lit(stretch_s) * F.col("sr")).cast("long")
    rows = stretches.filter(F.size("samples") > 0).withColumns({"at": F.bround(F.unix_micros("start") / 1e6 * F.col("sr")).cast("long"), "per": per})
    rows = rows.withColumn("stretch", F.floor(F.col("at") / F.col("per")))
    if "chunk" not in rows.columns:
        rows = rows.withColumn("chunk", F.floor(F.col("stretch") / round(chunk_s / stretch_s)))
    rows = rows.withColumns({"rate": F.col("sr").cast("string"), "sum": total(F.col("samples"))})
    whole, size = Window.partitionBy(*CHANNEL, "rate", "chunk"), F.size("samples")
    return rows.withColumns({"first": F.min("at").over(whole), "stop": F.max(F.col("at") + size).over(whole), "mean": F.sum("sum").over(whole) / F.sum(size).over(whole)}).drop("sum")


def _in_blocks(stretches, keep, target, chunk_s, stretch_s, at_ends=5.0, kind="bandpass", corners=2, zero_phase=True, method="linear", zeros=16, rolloff=0.9):
    """Pieces of stretches by the ``block`` of stretches that they reach, and what conditions the pieces of one block.

    A block is a part of a chunk and holds no more than ``BLOCK`` samples of a channel; each stretch sends a block only
    the samples that it reaches.  The function takes a block's pieces as an Arrow table and yields, for each channel, a
    dict of its ``keep`` and key columns, and tuples ``stretch, at, samples, first_out, n_trace``.
    """
    if round(chunk_s / stretch_s) * stretch_s != chunk_s:
        raise ValueError("a chunk must be a whole number of stretches")
    of_chunk, of_block = in_block(target, chunk_s, stretch_s)
    rows = in_chunks(stretches.withColumn("samples", F.col("samples").cast("array<double>")), chunk_s, stretch_s)
    taps_reach = F.ceil(F.lit(zeros / rolloff) * F.greatest(F.lit(1.0), F.col("sr") / target)).cast("long") + 1 if method == "sinc" else F.lit(1)
    if kind is None:
        rows = rows.withColumns({"fmin": F.lit(0.0), "fmax": F.lit(0.0), "length": F.lit(0).cast("long")})
    else:
        # the response has died out after 36 times the time in which its slowest part falls by a factor of e; a corner
        # near half the rate is as slow as its distance from there
        below = F.when(F.col("fmax") < F.col("sr") / 2, F.col("sr") / 2 - F.col("fmax"))
        slowest = {"lowpass": F.least("fmax", below), "highpass": F.least("fmin", F.col("sr") / 2 - F.col("fmin"))}.get(kind, F.least("fmin", (F.col("fmax") - F.col("fmin")) / 2, below))
        rows = rows.withColumn("length", F.ceil(36 * F.col("sr") / (2 * np.pi * float(np.sin(np.pi / (2 * corners))) * F.greatest(slowest, F.lit(1e-4)))).cast("long") + 8)
    rows = rows.withColumn("reach", F.col("length") + taps_reach)
    per, size = F.col("per"), F.size("samples").cast("long")
    lo, hi = F.greatest(F.col("at") - F.col("reach"), F.col("first")), F.least(F.col("at") + size + F.col("reach"), F.col("stop")) - 1
    block = lambda at: F.floor((F.floor(at / per) - F.col("chunk") * of_chunk) / of_block)
    sent = rows.withColumn("block", F.explode(F.sequence(block(lo), block(hi))))
    opens = (F.col("chunk") * of_chunk + F.col("block") * of_block) * per
    begin = F.greatest(F.col("at"), opens - F.col("reach"))
    end = F.least(F.col("at") + size, opens + of_block * per + F.col("reach"))
    piece = F.slice("samples", (begin - F.col("at") + 1).cast("int"), (end - begin).cast("int"))
    trace = [*CHANNEL, "rate", "fmin", "fmax"]
    sent = sent.filter(end > begin).select(*keep, *trace, "sr", "chunk", "block", "first", "stop", "mean", "length", begin.alias("held"), piece.alias("samples"))

    def one(x, r):
        held, first, stop, sr = r["held"], r["first"], r["stop"], r["sr"]
        n, width = stop - first, round(stretch_s * sr)
        x = x - (np.nan if r["mean"] is None else r["mean"])
        if kind is not None:
            place = np.arange(held - first, held - first + len(x))
            w = min(int(sr * at_ends), n // 2)
            edge = np.minimum(place, n - 1 - place)
            x = x * np.where(edge >= w, 1.0, 0.5 * (1 - np.cos(np.pi * edge / max(w, 1))))
            x = filtered(x, response(kind, sr, r["fmin"], r["fmax"], corners, r["length"]), zero_phase)
        p, q = steps(sr, target)
        reach = taps(p, q, zeros, rolloff).shape[1] // 2 + 1 if method == "sinc" else 1
        begin, end = -(-first * p // q), (stop - 1) * p // q + 1
        at = r["chunk"] * of_chunk + r["block"] * of_block
        for stretch in range(at, min(at + of_block, (r["chunk"] + 1) * of_chunk)):
            lo, hi = max(first, stretch * width), min(stop, (stretch + 1) * width)
            a, b = -(-lo * p // q), end if hi == stop else -(-hi * p // q)
            if hi > lo and b > a:
                cut = max(held, lo - reach)
                yield stretch, a, resampled_at(x[cut - held : hi + reach - held], cut, stop, a, b, p, q, method, zeros, rolloff), begin, end - begin

    def conditioned(block):
        lists = pa.concat_arrays(block["samples"].chunks)
        values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        rows, pieces = block.drop_columns(["samples"]).to_pylist(), {}
        for i in sorted(range(len(rows)), key=lambda i: rows[i]["held"]):
            pieces.setdefault(tuple(rows[i][c] for c in trace), []).append(i)
        for own in pieces.values():
            yield rows[own[0]], one(np.concatenate([values[ends[i] : ends[i + 1]] for i in own]), rows[own[0]])

    return sent, conditioned


def condition_chunks(
    stretches: DataFrame, target: float, chunk_s: float = 3600.0, stretch_s: float = 60.0, at_ends: float = 5.0, kind: str | None = "bandpass", corners: int = 2,
    zero_phase: bool = True, method: str = "linear", zeros: int = 16, rolloff: float = 0.9,
) -> DataFrame:
    """Demean, taper, filter (columns ``fmin, fmax``) and resample each channel's chunk as one trace.

    ``stretches`` come from ``merge_segments`` with the same ``stretch_s``, which must divide ``chunk_s``.  Returns a
    row per stretch at the target rate: ``CHANNEL, chunk, stretch, sr, at, samples, first_out, n_trace, start``.
    Samples are numbered from the epoch by ``at``, so that all channels share one grid; ``first_out`` and ``n_trace``
    tell where the chunk's trace begins and how long it is.  ``kind=None`` leaves out taper and filter.
    """
    sent, conditioned = _in_blocks(stretches, [], target, chunk_s, stretch_s, at_ends, kind, corners, zero_phase, method, zeros, rolloff)
    kinds = dict(sent.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*CHANNEL, "chunk"]) + ", stretch long, sr double, at long, samples array<double>, first_out long, n_trace long"
    names = [*CHANNEL, "chunk", "stretch", "sr", "at", "samples", "first_out", "n_trace"]

    def run(block: pa.Table) -> pa.Table:
        rows = [(*(r[c] for c in [*CHANNEL, "chunk"]), s, float(target), at, x, a, n) for r, out in conditioned(block) for s, at, x, a, n in out]
        types = [block.schema.field(c).type for c in [*CHANNEL, "chunk"]] + [pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.int64()]
        return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(zip(names, types, strict=True))})

    out = sent.groupBy(*CHANNEL, "rate", "chunk", "block").applyInArrow(run, schema)
    return out.withColumn("start", F.timestamp_micros(F.bround(F.col("at") / F.col("sr") * 1e6).cast("long")))


def prepare_chunks(segments: DataFrame, overrides: DataFrame | None = None, target: float = 100.0, chunk_s: float = 3600.0, stretch_s: float = 60.0, light: bool = False, low: float = 1.0, high: float = 45.0, **options) -> DataFrame:
    """The whole station chain over chunks: merge, demean, taper, filter, resample, choose components Z, N, E, trim.

    Returns ``net, sta, chunk, stretch, at, xs, first_out, stop_out``: ``xs`` holds the three components of a stretch,
    cut to the interval of the chunk that all three cover, from sample ``first_out`` to before ``stop_out``.  ``light``
    leaves out taper and filter.  ``overrides`` holds ``sta, hp, lp``.

    A station's channels are conditioned together, a block at a time, so that conditioned samples are never shuffled
    and a task holds those of one block.
    """
    n, of_block = in_block(target, chunk_s, stretch_s)
    rows = merge_segments(segments, stretch_s, chunk_s if n == of_block else None)  # a chunk of one block is not dealt again
    if light:
        options["kind"] = None
    else:
        rows = filter_parameters(rows, overrides, low, high) if overrides is not None else rows.withColumns({"fmin": F.lit(low), "fmax": F.lit(high)})
    c = component_rank(F.col("cha"))
    rows = rows.withColumns({"letter": c["letter"], "rank": c["rank"]}).filter("letter IS NOT NULL")
    sent, conditioned = _in_blocks(rows, ["letter", "rank"], target, chunk_s, stretch_s, **options)
    kinds = dict(sent.dtypes)
    schema = f"net {kinds['net']}, sta {kinds['sta']}, chunk long, stretch long, at long, xs array<array<double>>, first_out long, stop_out long"

    def run(block: pa.Table) -> pa.Table:
        found: dict[int, dict[str, list]] = {}
        for r, out in conditioned(block):
            rank = (r["rank"], r["cha"], r["loc"] is not None, r["loc"] or "")
            for stretch, at, x, first, n in out:
                found.setdefault(stretch, {}).setdefault(r["letter"], []).append((rank, at, x, first, first + n))
        rows = []
        for stretch, by in found.items():
            if len(by) == 3:
                best = [by[c][0] if len(by[c]) == 1 else min(by[c], key=lambda v: (*v[:2], v[2].tolist(), *v[3:])) for c in "ZNE"]
                first, stop = max(v[3] for v in best), min(v[4] for v in best)
                at, end = max(first, *[v[1] for v in best]), min(stop, *[v[1] + len(v[2]) for v in best])
                if end > at:
                    rows.append((stretch, at, [v[2][at - v[1] : end - v[1]] for v in best], first, stop))
        parts = [x for r in rows for x in r[2]]
        inner = pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)], dtype=np.int32), np.concatenate([*parts, np.zeros(0)]))
        xs = pa.ListArray.from_arrays(np.arange(0, 3 * len(rows) + 1, 3, dtype=np.int32), inner)
        same = {c: pa.array([block[c][0].as_py()] * len(rows), block.schema.field(c).type) for c in ("net", "sta", "chunk")}
        number = {c: pa.array([r[i] for r in rows], pa.int64()) for i, c in ((0, "stretch"), (1, "at"), (3, "first_out"), (4, "stop_out"))}
        return pa.table(same | {"stretch": number["stretch"], "at": number["at"], "xs": xs, "first_out": number["first_out"], "stop_out": number["stop_out"]})

    return sent.groupBy("net", "sta", "chunk", "block").applyInArrow(run, schema)


def windows_over_stretches(prepared: DataFrame, keys: list[str], n: int, overlap: int = 0, array: str = "xs") -> DataFrame:
    """Windows of ``n`` samples of every component over a chunk's whole trace, whatever stretches they touch.

    ``prepared`` has ``at``, ``first_out``, ``stop_out`` and an array of component arrays.  Windows start each
    ``n - overlap`` samples, one more ends with the trace, and a trace shorter than a window is padded with zeros.
    Each stretch sends every window the samples that it holds of it.  Returns ``keys, win_idx, w_start`` (sample within
    the trace), ``at`` (number of the window's first sample) and ``window`` (component arrays).
    """
    step = max(1, n - overlap)
    t = F.col("stop_out") - F.col("first_out")
    a = F.col("at") - F.col("first_out")
    size = F.size(F.get(array, F.lit(0)))
    whole = F.greatest(F.floor((t - n) / step), F.lit(0))  # the last window of the grid
    grid = F.sequence(F.least(whole, F.greatest(F.floor((a - n) / step) + 1, F.lit(0))), F.least(whole, F.floor((a + size - 1) / step)))
    grid = F.transform(grid, lambda k: F.struct(k.cast("int").alias("win_idx"), (k * step).alias("w_start")))
    tail = F.array(F.struct((whole + 1).cast("int").alias("win_idx"), (t - n).alias("w_start")))
    every = F.when((t > n) & (whole * step + n < t), F.concat(grid, tail)).otherwise(grid)
    rows = prepared.select(*keys, "first_out", a.alias("a"), size.alias("size"), array, F.inline(every))
    begin, end = F.greatest("a", "w_start"), F.least(F.col("a") + F.col("size"), F.col("w_start") + n)
    cut = F.transform(array, lambda x: F.slice(x, (begin - F.col("a") + 1).cast("int"), (end - begin).cast("int")))
    pieces = rows.filter(end > begin).groupBy(*keys, "first_out", "win_idx", "w_start").agg(F.array_sort(F.collect_list(F.struct(begin.alias("at"), cut.alias("x")))).alias("pieces"))
    joined = lambda i: F.flatten(F.transform("pieces", lambda s: F.get(s["x"], F.lit(i))))
    filled = [F.concat(joined(i), F.array_repeat(F.lit(0.0), n - F.size(joined(i)))) for i in range(3)]
    return pieces.select(*keys, "win_idx", F.col("w_start").cast("int").alias("w_start"), (F.col("first_out") + F.col("w_start")).alias("at"), F.array(*filled).alias("window"))
