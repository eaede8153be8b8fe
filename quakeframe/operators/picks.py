"""From probability traces to picks, and from picks to rows of output."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quakeframe.functions.scalars import let
from quakeframe.operators.dense import pair_up
from quakeframe.operators.runs import short_and_long, with_runs

MakePredict = Callable[[], Callable[[np.ndarray], np.ndarray]]
#: Models by name; a user adds a function that loads a model and returns its batch function.
MODELS: dict[str, MakePredict] = {}


def register_model(name: str, make: MakePredict) -> None:
    MODELS[name] = make


def energy_ratio() -> Callable[[np.ndarray], np.ndarray]:
    """A deterministic stand-in picker: short over long running energy, squashed to 0..1."""

    def predict(x: np.ndarray) -> np.ndarray:
        e = np.cumsum(np.asarray(x, dtype=np.float64) ** 2, axis=1)
        e = np.concatenate([np.zeros((len(e), 1)), e], axis=1)
        i = np.arange(1, e.shape[1])
        short = e[:, i] - e[:, np.maximum(i - 3, 0)]
        long = e[:, i] - e[:, np.maximum(i - 30, 0)]
        r = (short / np.minimum(i, 3)) / (long / np.minimum(i, 30) + 1e-9)
        return r / (1 + r)

    return predict


register_model("stand-in/energy", energy_ratio)


def three_components() -> Callable[[np.ndarray], np.ndarray]:
    """The stand-in over (batch, components, samples): P from the first component, S from the energy of the others."""
    one = energy_ratio()

    def predict(x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=np.float64)
        return np.stack([one(x[:, 0]), one(np.sqrt((x[:, 1:] ** 2).sum(axis=1)))], axis=1)

    return predict


register_model("stand-in/three", three_components)


def annotate(
    windows: DataFrame, array: str, n: int | tuple[int, int], model: str | MakePredict, batch_size: int = 512, out: str = "prob", channels: tuple[str, ...] | None = None, warm_up: int = 0
) -> DataFrame:
    """Add probability traces to each window; the model loads once per Python worker and sees batches across stations.

    ``n`` is the number of samples of a plain window, or (components, samples) of a window of component arrays, which
    the model then gets as one tensor (batch, components, samples).  With ``channels`` it returns (batch, channels,
    samples), and ``out`` is a struct of one trace for each name.  ``warm_up`` batches of zeros run before the first.
    """
    make = MODELS[model] if isinstance(model, str) else model
    shape = [n] if isinstance(n, int) else list(n)

    def ready():
        predict = make()
        for _ in range(warm_up):
            predict(np.zeros((batch_size, *shape), dtype=np.float32))
        if channels is None:
            return predict

        def named(x: np.ndarray) -> dict[str, np.ndarray]:
            y = predict(x)
            return {c: y[:, k] for k, c in enumerate(channels)}

        return named

    kind = ArrayType(DoubleType()) if channels is None else StructType([StructField(c, ArrayType(DoubleType())) for c in channels])
    run = predict_batch_udf(ready, return_type=kind, batch_size=batch_size, input_tensor_shapes=[shape])
    return windows.withColumn(out, run(F.col(array) if len(shape) == 1 else F.flatten(array)))


def by_phase(annotated: DataFrame, channels: tuple[str, ...], traces: str = "prob") -> DataFrame:
    """One row per window and channel: ``phase`` and its trace under the name that the struct had."""
    rest = [c for c in annotated.columns if c != traces]
    return annotated.select(*rest, F.inline(F.array(*[F.struct(F.lit(c).alias("phase"), F.col(traces)[c].alias(traces)) for c in channels])))


def annotate_branches(windows: DataFrame, array: str, n: int | tuple[int, int], branches: dict[str, str | MakePredict], out: str = "prob", **options) -> DataFrame:
    """One row per window and branch (phase), each with its own model; all branches see a batch in one pass."""
    makes = [MODELS[m] if isinstance(m, str) else m for m in branches.values()]

    def together():
        models = [make() for make in makes]
        return lambda x: np.stack([m(x) for m in models], axis=1)

    return by_phase(annotate(windows, array, n, together, out=out, channels=tuple(branches), **options), tuple(branches), out)


def onsets(p: Column, threshold: float, separation: int) -> Column:
    """Indices where the trace rises to the threshold, each at least ``separation`` after the last one kept."""
    rises = F.filter(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda i: F.coalesce((F.get(p, i) >= threshold) & (F.get(p, i - 1) < threshold), F.lit(False)))

    def step(acc: Column, i: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        return F.when(last.isNull() | (i - last >= separation), F.array_append(acc, i)).otherwise(acc)

    return F.aggregate(rises, F.array().cast("array<int>"), step)


def peaks(p: Column, height: float | None = None, distance: int = 1, threshold: float = 0.0, edge: str | None = "rising", keep_same: bool = False, valley: bool = False) -> Column:
    """Indices of local maxima (minima for ``valley``).

    Of a flat top the rising, the falling or both edges count, or none.  A value that is NaN or null is no peak, nor
    are its neighbours, nor the first and last value.  Kept: values of ``height`` or more that exceed both
    neighbours by ``threshold``; then, from the highest (of equal ones the later) down, those not within
    ``distance`` of one kept (``keep_same``: unless of equal height).
    """
    clean = F.transform(p, lambda v: F.when(v.isNotNull() & ~F.isnan(v), -v if valley else v))
    return let(clean, lambda x: _peaks(x, height, distance, threshold, edge, keep_same))


def _peaks(x: Column, height: float | None, distance: int, threshold: float, edge: str | None, keep_same: bool) -> Column:
    n = F.size(x)

    def is_peak(i: Column) -> Column:
        v, a, b = F.get(x, i), F.get(x, i - 1), F.get(x, i + 1)
        up, down = v - a, b - v
        shape = F.lit(False)
        if edge is None:
            shape = (down < 0) & (up > 0)
        if edge in ("rising", "both"):
            shape = shape | ((down <= 0) & (up > 0))
        if edge in ("falling", "both"):
            shape = shape | ((down < 0) & (up >= 0))
        if height is not None:
            shape = shape & (v >= height)
        if threshold > 0:
            shape = shape & (F.least(v - a, v - b) >= threshold)
        return F.coalesce(shape, F.lit(False))

    found = F.when(n < 3, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), is_peak))
    if distance <= 1:
        return found
    ranked = F.reverse(F.array_sort(F.transform(found, lambda i: F.struct(F.get(x, i).alias("v"), i.alias("i")))))

    def step(acc: Column, q: Column) -> Column:
        near = F.exists(acc, lambda k: (F.abs(k["i"] - q["i"]) <= distance) & ((k["v"] > q["v"]) if keep_same else F.lit(True)))
        return F.when(near, acc).otherwise(F.array_append(acc, q))

    kept = F.aggregate(ranked, F.array().cast("array<struct<v:double,i:int>>"), step)
    return F.array_sort(F.transform(kept, lambda k: k["i"]))


def best_pick(p: Column, threshold: float) -> Column:
    """Struct ``sample, prob`` of the highest peak by probability rounded to three digits, the first of equal ones; null for none."""
    ranked = F.transform(peaks(p, height=threshold), lambda i: F.struct((-F.bround(F.get(p, i), 3)).alias("v"), i.alias("i")))
    return let(F.array_min(ranked), lambda best: F.when(best.isNotNull(), F.struct(best["i"].alias("sample"), (-best["v"]).alias("prob"))))


def argmax_pick(p: Column) -> Column:
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def window_pick_times(windows: DataFrame, prob: str, start: str, threshold: float, rate_hz: float = 100.0) -> DataFrame:
    """One row per window with its best pick's time and probability, nulls where there is none."""
    rows = windows.withColumn("best", best_pick(F.col(prob), threshold))
    t = F.timestamp_micros(F.unix_micros(start) + (F.col("best.sample") * (1e6 / rate_hz)).cast("long"))
    return rows.withColumns({"pick_time": t, "pick_prob": F.col("best.prob")}).drop("best")


def triggers(p: Column, threshold: float | Column, separation: int) -> Column:
    """Structs ``onset, peak, value``: each onset, and the first highest value until the trace falls below the threshold."""

    def highest(i: Column) -> Column:
        after = F.transform(F.slice(p, i + 1, F.size(p)), lambda v, k: F.struct(v.alias("v"), (i + k).alias("k")))
        start = F.struct(F.lit(True).alias("on"), F.lit(None).cast("double").alias("v"), F.lit(None).cast("int").alias("k"))

        def step(acc: Column, q: Column) -> Column:
            on = acc["on"] & F.coalesce(q["v"] >= threshold, F.lit(False))
            better = on & (acc["v"].isNull() | (q["v"] > acc["v"]))
            return F.struct(on.alias("on"), F.when(better, q["v"]).otherwise(acc["v"]).alias("v"), F.when(better, q["k"]).otherwise(acc["k"]).alias("k"))

        return F.aggregate(after, start, step)

    return F.transform(onsets(p, threshold, separation), lambda i: let(highest(i), lambda h: F.struct(i.alias("onset"), h["k"].alias("peak"), h["v"].alias("value"))))


def trace_picks(windows: DataFrame, keys: list[str], prob: str, threshold: float, separation: int, offset: Column | None = None, value: str | None = None) -> DataFrame:
    """One row per onset: ``sample`` counted from the trace's start, and the peak's probability under the name ``value``."""
    base = F.coalesce(offset if offset is not None else F.col("w_start"), F.lit(0))
    if value is None:
        rows = windows.select(*keys, base.alias("__o"), F.explode(onsets(F.col(prob), threshold, separation)).alias("__i"))
        return rows.select(*keys, (F.col("__o") + F.col("__i")).cast("int").alias("sample"))
    rows = windows.select(*keys, base.alias("__o"), F.inline(triggers(F.col(prob), threshold, separation)))
    return rows.select(*keys, (F.col("__o") + F.col("onset")).cast("int").alias("sample"), F.col("value").alias(value))


def classify(
    windows: DataFrame, array: str, n: int | tuple[int, int], model: str | MakePredict, thresholds: dict[str, float], separation: int = 50, rate_hz: float = 100.0, merged: bool = False, **options
) -> DataFrame:
    """Annotate, then picks: ``station, phase, peak_time, peak_value``, one row per pick of any window.

    ``windows`` have ``station``, ``at`` (number of the first sample, from the epoch, at ``rate_hz``) and the window.
    ``thresholds`` names the model's channels in order.  A pick that several windows find counts once, with the
    highest value.  ``merged`` pools the network: its rows belong to the station ``NETWORK``.
    """
    channels = tuple(thresholds)
    rows = by_phase(annotate(windows, array, n, model, out="__p", channels=channels, **options), channels, "__p")
    threshold = F.element_at(F.create_map(*[F.lit(v) for pair in thresholds.items() for v in pair]), F.col("phase"))
    found = rows.select("station", "phase", "at", F.inline(triggers(F.col("__p"), threshold, separation)))
    found = found.select("station", "phase", (F.col("at") + F.col("peak")).alias("sample"), "value").groupBy("station", "phase", "sample").agg(F.max("value").alias("peak_value"))
    time = F.timestamp_micros(F.bround(F.col("sample") / rate_hz * 1e6).cast("long"))
    return found.select(F.lit("NETWORK").alias("station") if merged else "station", "phase", time.alias("peak_time"), "peak_value")


def channel_phase(cha: Column) -> Column:
    """P or S by the suffix of an annotation channel."""
    return F.when(F.right(cha, F.lit(2)) == "_P", "P").when(F.right(cha, F.lit(2)) == "_S", "S")


def normalise_picks(rows: DataFrame) -> DataFrame:
    """``station, phase, t, prob`` of pick objects: phase upper-cased (default P), first known time, station of the trace id.

    Rows without a time, a station, or with another phase are dropped.
    """
    out = rows.select(
        F.coalesce(F.get(F.split("trace_id", r"\."), F.lit(1)), F.col("station")).alias("station"), F.upper(F.coalesce("phase", F.lit("P"))).alias("phase"),
        F.coalesce("peak_time", "start_time", "time").alias("t"), F.coalesce("peak_value", F.lit(0.0)).alias("prob"),
    )
    return out.filter(F.col("t").isNotNull() & F.col("station").isNotNull() & (F.col("station") != "") & F.col("phase").isin("P", "S"))


def pair_phases(picks: DataFrame, keys: list[str], t: str = "t", prob: str = "prob", most: float = 30.0) -> DataFrame:
    """Pair each P in turn with the first unused S that follows within ``most`` seconds; the other S stand alone.

    Returns ``keys, p_time, p_prob, s_time, s_prob``.  ``t`` is seconds (double).  Picks are cut into runs wherever
    nothing happens for ``most`` seconds: no pair crosses such a gap, so a busy station still folds in small groups.
    """
    runs = with_runs(picks.select(*keys, "phase", F.col(t).alias("t"), F.col(prob).alias("prob")), keys, "t", most, inclusive=True)
    of = lambda x: F.array_sort(F.collect_list(F.when(F.col("phase") == x, F.struct("t", "prob"))))
    short, long = short_and_long(runs, keys)
    g = short.groupBy(*keys, "run").agg(of("P").alias("p"), of("S").alias("s"))
    row = "array<struct<p_time:double,p_prob:double,s_time:double,s_prob:double>>"
    indexed = F.transform("s", lambda x, i: F.struct(i.alias("i"), x["t"].alias("t"), x["prob"].alias("prob")))
    nothing = F.lit(None).cast("double")

    def step(acc: Column, p: Column) -> Column:
        hit = F.get(F.filter(indexed, lambda s: (s["t"] > p["t"]) & (s["t"] - p["t"] < most) & ~F.array_contains(acc["used"], s["i"])), F.lit(0))
        out = F.struct(p["t"].alias("p_time"), p["prob"].alias("p_prob"), hit["t"].alias("s_time"), hit["prob"].alias("s_prob"))
        return F.struct(F.when(hit.isNull(), acc["used"]).otherwise(F.array_append(acc["used"], hit["i"])).alias("used"), F.array_append(acc["rows"], out).alias("rows"))

    done = F.aggregate("p", F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(row).alias("rows")), step)

    def alone(used: Column) -> Column:
        return F.transform(F.filter(indexed, lambda s: ~F.array_contains(used, s["i"])), lambda s: F.struct(nothing.alias("p_time"), nothing.alias("p_prob"), s["t"].alias("s_time"), s["prob"].alias("s_prob")))

    folded = g.select(*keys, F.inline(let(done, lambda d: F.concat(d["rows"], alone(d["used"])))))
    if long is None:
        return folded
    v = F.col("t").cast("double")
    rows = long.filter(F.col("phase").isin("P", "S") & F.col("t").isNotNull())
    rows = rows.select(*keys, "run", (F.col("phase") == "P").alias("is_a"), v.alias("o"), v.alias("v"), F.col("prob").cast("double").alias("w"))
    far = F.isnan("v") | (F.abs("v") == float("inf"))  # within reach of nothing
    sides = [F.when(c, F.col(x)).alias(n) for n, c, x in (("p_time", F.col("is_a"), "v"), ("p_prob", F.col("is_a"), "w"), ("s_time", ~F.col("is_a"), "v"), ("s_prob", ~F.col("is_a"), "w"))]
    paired = pair_up(rows.filter(~far), [*keys, "run"], most, following=True)
    paired = paired.select(*keys, F.col("a_v").alias("p_time"), F.col("a_w").alias("p_prob"), F.col("b_v").alias("s_time"), F.col("b_w").alias("s_prob"))
    return folded.unionByName(rows.filter(far).select(*keys, *sides)).unionByName(paired)


def with_empty_stations(paired: DataFrame, stations: DataFrame, keys: list[str]) -> DataFrame:
    """One blank row for each station without picks."""
    return stations.select(*keys).distinct().join(paired, keys, "left")


def pick_quality(rows: DataFrame, prob: str, catalog: str, threshold: float, separation: int = 50) -> DataFrame:
    """Argmax and first onset of each trace with their differences to the catalog sample."""
    first = F.get(onsets(F.col(prob), threshold, separation), F.lit(0))
    out = rows.withColumns({"argmax": argmax_pick(F.col(prob)), "onset": first})
    return out.withColumns({"delta_argmax": F.col("argmax") - F.col(catalog), "delta_onset": F.col("onset") - F.col(catalog)})
