"""Late stations as streams: chunks by event time, launch groups by count or wait, latencies, continuous picking.

Every streaming operator has a batch twin with the same result, which tests hold against it; ``from_first`` is batch only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quakeframe.functions import scalars as S
from quakeframe.operators import conditioning, picks, prep
from quakeframe.operators.runs import numbered
from quakeframe.operators.scans import carried, dealt, null_safe
from quakeframe.operators.spacing import spaced

#: Delays that a late station may have, in seconds.  Fixed values.
DELAYS = (0, 5, 10, 15, 20, 25, 30, 60, 65, 90)
#: A late station is always processed, in a later chunk, so the watermark waits longer than the largest delay.
WATERMARK = "120 seconds"


# --- arrival schedules -------------------------------------------------------------------------------------------------------


def ready_times(stations: DataFrame, share: float | None, seed: int, delays: tuple[int, ...] = DELAYS) -> DataFrame:
    """Add ``ready_s``: 0, or for a seeded share of the stations one of the delays; no ``share`` draws it from the seed.

    Draws are digests of seed and name, so they are the same for every partitioning.
    """
    drawn = lambda salt: S.drawn(F.lit(f"{seed}/{salt}"), F.col("station"))
    limit = F.lit(share) if share is not None else S.drawn(F.lit(f"{seed}/share"))
    pick = F.floor(drawn("delay") * len(delays)).cast("int")
    return stations.withColumn("ready_s", F.when(drawn("late") < limit, F.get(F.array(*[F.lit(float(d)) for d in delays]), pick)).otherwise(0.0))


def split_on_time(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    return events.filter("ready_s <= 0"), events.filter("ready_s > 0")


def pool_of(ready: Column) -> Column:
    return F.when(ready <= 0, "ontime").otherwise("delayed")


def round_robin(stations: DataFrame, workers: int) -> DataFrame:
    """Add ``worker``: stations in name order dealt to workers in turn; places are sums of range counts."""
    return numbered(stations, ["station"], "worker", 0).withColumn("worker", (F.col("worker") % workers).cast("int"))


# --- chunks by event time ---------------------------------------------------------------------------------------------------------


def stations_per_chunk(events: DataFrame, at: str = "ready", length: str = "60 seconds") -> DataFrame:
    """``chunk_start, n_stations`` by tumbling windows of the ready time; batch or stream."""
    rows = events.withWatermark(at, WATERMARK) if events.isStreaming else events
    return rows.groupBy(F.window(at, length)).agg(F.count(F.lit(1)).alias("n_stations")).select(F.col("window.start").alias("chunk_start"), "n_stations")


# --- launch groups ---------------------------------------------------------------------------------------------------------------------


def launch_groups(events: list[tuple[str, float]], size: int, wait: float, chunk: float = 60.0, from_first: bool = False, drain: bool = False) -> list[tuple[float, list[str]]]:
    """(time, stations) of the groups of one pool: fired at ``size`` stations, at ``wait`` seconds after the oldest, or at the chunk's end.

    Waiting counts from the oldest station in the queue; with ``from_first`` from the first ready one of the chunk.
    A size of 1 fires at once.  With ``drain`` nobody else is expected, so the last group waits no longer than its last station.
    """
    fired: list[tuple[float, list[str]]] = []
    queue: list[tuple[float, str]] = []
    first: dict[int, float] = {}

    def deadline() -> float:
        oldest = queue[0][0]
        start = first[int(oldest // chunk)] if from_first else oldest
        return min(max(start + wait, oldest), (int(oldest // chunk) + 1) * chunk)

    for t, station in sorted((t, s) for s, t in events):
        while queue and deadline() <= t:
            fired.append((deadline(), [s for _, s in queue]))
            queue.clear()
        first.setdefault(int(t // chunk), t)
        queue.append((t, station))
        if len(queue) >= size:
            fired.append((t, [s for _, s in queue]))
            queue.clear()
    if queue:
        fired.append((min(deadline(), queue[-1][0]) if drain else deadline(), [s for _, s in queue]))
    return fired


def batch_groups(events: DataFrame, key: str, size: int, wait: float, chunk: float = 60.0, from_first: bool = False, drain: bool = False) -> DataFrame:
    """``key, fire_s, n, stations`` of every launch group, by a fold over the sorted stations of each key and chunk.

    No group outlives its chunk, so a chunk's stations are all that meets in one row.  With ``drain`` the last group
    of a key fires as soon as its last station has come: nobody else is expected.
    """
    rows = events.select(key, F.floor(F.col("ready_s") / chunk).alias("chunk"), F.struct(F.col("ready_s").cast("double").alias("t"), F.col("station").cast("string").alias("s")).alias("e"))
    per = rows.groupBy(key, "chunk").agg(F.array_sort(F.collect_list("e")).alias("r"))
    if drain:
        ends = rows.groupBy(key).agg(F.max("e.t").alias("last"))
        a, b = per.alias("a"), ends.alias("b")
        per = a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))).select("a.*", "b.last")
    else:
        per = per.withColumn("last", F.lit(float("inf")))
    end = (F.col("chunk") + 1) * chunk
    first = F.get("r", F.lit(0))["t"]

    def due(queue: Column) -> Column:
        oldest = F.get(queue, F.lit(0))["t"]
        return F.least(F.greatest(first + wait, oldest) if from_first else oldest + wait, end)

    def group(at: Column, queue: Column) -> Column:
        return F.struct(at.alias("fire_s"), F.transform(queue, lambda x: x["s"]).alias("stations"))

    def step(acc: Column, e: Column) -> Column:
        over = (F.size(acc["queue"]) > 0) & (due(acc["queue"]) <= e["t"])
        queue = F.when(over, F.array(e)).otherwise(F.array_append(acc["queue"], e))
        fired = F.when(over, F.array_append(acc["fired"], group(due(acc["queue"]), acc["queue"]))).otherwise(acc["fired"])
        return S.let(queue, lambda q: F.struct(
            F.when(F.size(q) >= size, F.array().cast(queue_type)).otherwise(q).alias("queue"),
            F.when(F.size(q) >= size, F.array_append(fired, group(e["t"], q))).otherwise(fired).alias("fired"),
        ))

    queue_type, fired_type = "array<struct<t:double,s:string>>", "array<struct<fire_s:double,stations:array<string>>>"
    start = F.struct(F.array().cast(queue_type).alias("queue"), F.array().cast(fired_type).alias("fired"))
    done = per.withColumn("done", F.aggregate("r", start, step))
    rest = F.when(F.size("done.queue") > 0, F.array(group(F.least(due(F.col("done.queue")), F.col("last")), F.col("done.queue")))).otherwise(F.array().cast(fired_type))
    groups = done.select(key, F.inline(F.concat("done.fired", rest)))
    return groups.select(key, "fire_s", F.size("stations").alias("n"), "stations")


class LaunchQueue(StatefulProcessor):
    """Keeps the stations of one pool and chunk until they fill a group, have waited long enough, or their chunk ends.

    Where the roster says how many stations the chunk awaits, arrivals are counted, and the last of them fires the rest.
    """

    def __init__(self, size: int, wait: float, chunk: float):
        self.size, self.wait, self.chunk = size, wait, chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getListState("queue", "station string, ready_s double")
        self.come = handle.getValueState("come", "n long, expected long")

    def _settle(self, key, upto: float) -> Iterator[pd.DataFrame]:
        """Fire what is certain at event time ``upto`` (all, once all have come); keep the rest with a timer at its deadline."""
        n, expected = self.come.get() if self.come.exists() else (0, None)
        full = expected is not None and n >= expected
        held = sorted(((r[0], r[1]) for r in self.queue.get()), key=lambda x: (x[1], x[0]))
        groups = launch_groups(held, self.size, self.wait, self.chunk, drain=full)
        done = [(t, s) for t, s in groups if full or t <= upto]
        rest = held[sum(len(s) for _, s in done) :]  # groups take the stations in turn
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        end = (key[1] + 1) * self.chunk
        if rest:
            self.queue.put(rest)
            self.handle.registerTimer(int(groups[len(done)][0] * 1000))
        else:
            self.queue.clear()
            if full or upto >= end:
                self.come.clear()
            elif expected is not None:
                self.handle.registerTimer(int(end * 1000))
        if done:
            yield pd.DataFrame({"pool": [key[0]] * len(done), "fire_s": [t for t, _ in done], "n": [len(s) for _, s in done], "stations": [s for _, s in done]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, expected = self.come.get() if self.come.exists() else (0, None)
        for pdf in rows:
            for station, ready in zip(pdf["station"], pdf["ready_s"], strict=True):
                self.queue.appendValue((station, float(ready)))
            awaited = pdf["expected"].dropna()
            n, expected = n + len(pdf), int(awaited.iloc[0]) if len(awaited) else expected
        self.come.update((n, expected))
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs() / 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs() / 1000)

    def close(self) -> None:
        pass


GROUPS = "pool string, fire_s double, n int, stations array<string>"


def last_chunks(plan: DataFrame, key: str = "pool", chunk: float = 60.0) -> DataFrame:
    """``key, chunk, expected`` of each key's last chunk in a plan of arrivals (``key, ready_s``): how many stations it awaits."""
    per = plan.groupBy(key, F.floor(F.col("ready_s") / chunk).alias("chunk")).agg(F.count(F.lit(1)).alias("expected"))
    return per.groupBy(key).agg(F.max(F.struct("chunk", "expected")).alias("m")).select(key, "m.*")


def stream_groups(events: DataFrame, size: int, wait: float, chunk: float = 60.0, roster: DataFrame | None = None) -> DataFrame:
    """Launch groups of a stream ``pool, station, ready (timestamp), ready_s``; needs the RocksDB state store.

    A group is given out once the watermark has passed its time, so that no earlier station can still change it.
    State is kept by pool and chunk, so a busy pool spreads over tasks and its state ends with the chunk.  With a
    ``roster`` (``last_chunks``) the stream drains: once a pool's last chunk has all the stations that it awaits, what
    waits fires at the last one's time, without waiting for the watermark.
    """
    rows = events.withWatermark("ready", WATERMARK).select("pool", F.floor(F.col("ready_s") / chunk).alias("chunk"), "station", "ready", "ready_s")
    if roster is None:
        rows = rows.withColumn("expected", F.lit(None).cast("long"))
    else:
        awaited = roster.select(F.col("pool").alias("__pool"), F.col("chunk").alias("__chunk"), F.col("expected").cast("long").alias("expected"))
        rows = rows.join(awaited, F.col("pool").eqNullSafe(F.col("__pool")) & (F.col("chunk") == F.col("__chunk")), "left").drop("__pool", "__chunk")
    return rows.groupBy("pool", "chunk").transformWithStateInPandas(LaunchQueue(size, wait, chunk), GROUPS, "Append", "EventTime")


# --- latency and cadence -----------------------------------------------------------------------------------------------------------------


def station_latency(tasks: DataFrame, ready: DataFrame) -> DataFrame:
    """One row per station of each task: waiting, total and service time, and its even share of the inference time."""
    rows = tasks.select("task_id", "queued_s", "returned_s", "inference_s", F.size("stations").alias("n_in_group"), F.explode("stations").alias("station"))
    j = rows.join(ready, "station")
    return j.select(
        "station", "task_id", "n_in_group", "ready_s", (F.col("returned_s") - F.col("ready_s")).alias("e2e_s"), (F.col("queued_s") - F.col("ready_s")).alias("queue_s"),
        (F.col("returned_s") - F.col("queued_s")).alias("service_s"), (F.col("inference_s") / F.col("n_in_group")).alias("inference_share_s"),
    )


def paced(feeds: DataFrame, cadence: float = 60.0) -> DataFrame:
    """Wait before and lateness after each feed's due time; a feed starts when due or when the one before has ended."""
    keys, order = ["stream"], ["feed_index"]
    # end of feed i = max over j <= i of (due of j + work from j to i), by running sums and then a running maximum
    rows = dealt(feeds.withColumn("due_s", F.col("feed_index") * cadence), keys, order)
    rows = carried(rows, keys, order, totals={"__w": F.col("work_s")})
    rows = carried(rows, keys, order, highest={"__slack": F.col("due_s") - (F.col("__w") - F.col("work_s"))}).withColumn("end_s", F.col("__slack") + F.col("__w"))
    rows = carried(rows, keys, order, previous={"__before": F.col("end_s")}).withColumn("start_s", F.col("end_s") - F.col("work_s"))
    before = F.coalesce("__before", F.lit(0.0))
    return rows.select("stream", "feed_index", "due_s", "start_s", "end_s", F.greatest(F.col("due_s") - before, F.lit(0.0)).alias("wait_s"), F.greatest(F.col("start_s") - F.col("due_s"), F.lit(0.0)).alias("late_s"))


def stream_picks(spark: SparkSession, folder: str, schema: str, n: int, overlap: int, model: str, threshold: float, separation: int) -> DataFrame:
    """Arriving traces (``station, samples``) to picks: windows, batched model, onsets; the model stays in its worker."""
    arriving = spark.readStream.schema(schema).parquet(folder)
    windows = prep.sliding_windows(arriving, "samples", n, overlap)
    return picks.trace_picks(picks.annotate(windows, "window", n, model), ["station"], "prob", threshold, separation)


# --- picking over arriving pieces of a trace -----------------------------------------------------------------------------------------


class ContinuousPicker(StatefulProcessor):
    """Picks of one station's trace whose pieces arrive apart and out of order.

    Kept between arrivals: the samples from the next window's start on, pieces that wait for an earlier one, and the
    last kept onset.  Never more than a window and the pieces of the watermark's delay.
    """

    def __init__(self, n: int, overlap: int, model: str | picks.MakePredict, threshold: float, separation: int):
        self.n, self.step, self.threshold, self.separation = n, max(1, n - overlap), threshold, separation
        self.make = picks.MODELS[model] if isinstance(model, str) else model

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.predict = handle, self.make()
        self.pieces = handle.getListState("pieces", "at long, upto long, samples array<double>")
        # the next window's first sample, whether a window came before it in this run, its last value, the last kept onset
        self.trace = handle.getValueState("trace", "begin long, later boolean, value double, kept long, samples array<double>")

    def _settle(self, key, upto: float) -> Iterator[pd.DataFrame]:
        begin, later, value, kept, held = self.trace.get() if self.trace.exists() else (None, False, None, None, None)
        x = np.asarray(held if held is not None else [], dtype=np.float64)
        waiting = sorted(((r[0], r[1], list(r[2])) for r in self.pieces.get()), key=lambda p: (p[0], -len(p[2]), p[2]))
        found: list[int] = []
        while waiting:
            at, ms, samples = waiting[0]
            if begin is None or at > begin + len(x):  # a run begins here, unless something earlier is still to come
                if ms > upto:
                    break
                begin, later, value, x = at, False, None, np.zeros(0)
            waiting.pop(0)
            x = np.concatenate([x, np.asarray(samples[begin + len(x) - at :], dtype=np.float64)])
            n_windows = (len(x) - self.n) // self.step + 1
            if n_windows < 1:
                continue
            p = np.asarray(self.predict(np.lib.stride_tricks.sliding_window_view(x, self.n)[:: self.step]), dtype=np.float64)
            for row in p:
                new = row if not later else row[self.n - self.step :]
                first = begin + (self.n - len(new))
                before = np.concatenate([[np.nan if value is None else value], new[:-1]])
                for i in (first + np.flatnonzero((new >= self.threshold) & (before < self.threshold))).tolist():
                    if kept is None or i - kept >= self.separation:
                        kept = i
                        found.append(i)
                begin, later, value = begin + self.step, True, float(new[-1])
            x = x[n_windows * self.step :]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if waiting:
            self.pieces.put(waiting)
            self.handle.registerTimer(waiting[0][1])
        else:
            self.pieces.clear()
        if begin is not None:
            self.trace.update((begin, later, value, kept, x.tolist()))
        if found:
            yield pd.DataFrame({"station": [key[0]] * len(found), "sample": found})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for at, start, samples in zip(pdf["at"], pdf["start_ms"], pdf["samples"], strict=True):
                self.pieces.appendValue((int(at), int(start), [float(v) for v in samples]))
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_continuous_picks(pieces: DataFrame, n: int, overlap: int, model: str | picks.MakePredict, threshold: float, separation: int, delay: str = WATERMARK) -> DataFrame:
    """``station, sample`` of the onsets in a stream of pieces ``station, at, start (timestamp), samples``.

    ``at`` numbers a piece's first sample on the station's grid, ``start`` is its time.  Pieces follow on from each
    other; a gap ends a run once the watermark has passed the piece behind it, and what two pieces both hold counts
    once.  Windows start each ``n - overlap`` samples of a run.  A run's first window decides on all its samples, each
    other on those that no window before it held, so that every onset has ``overlap`` samples of context, and edges and
    the ``separation`` to the last kept onset carry over from window to window and piece to piece.
    """
    rows = pieces.withWatermark("start", delay).select("station", "at", "start", F.unix_millis("start").alias("start_ms"), "samples").filter("at IS NOT NULL AND size(samples) > 0")
    return rows.groupBy("station").transformWithStateInPandas(ContinuousPicker(n, overlap, model, threshold, separation), "station string, sample long", "Append", "EventTime")


def continuous_picks(pieces: DataFrame, n: int, overlap: int, model: str | picks.MakePredict, threshold: float, separation: int) -> DataFrame:
    """Batch twin of ``stream_continuous_picks``: ``station, sample``.

    Runs, the value before each window's part and the kept onsets come from ordered scans, so a busy station spreads
    over tasks; a piece sends each window the samples that it holds of it.  Of pieces of one place and length any one counts.
    """
    keys, step = ["station"], max(1, n - overlap)
    rows = pieces.filter("at IS NOT NULL AND size(samples) > 0").select("station", "at", "samples", (F.col("at") + F.size("samples")).alias("stop"))
    # of what two pieces hold, the earlier piece's samples count; one deal serves all three scans
    order = ["at", "stop"]
    rows = carried(dealt(rows, keys, order), keys, order, highest={"__high": F.col("stop")})
    rows = carried(rows, keys, order, previous={"__end": F.col("__high")})
    opens = F.when(F.col("__end").isNull() | (F.col("at") > F.col("__end")), F.col("at"))
    rows = carried(rows, keys, order, highest={"first_out": opens}).drop("__range")
    cut = F.greatest(F.coalesce("__end", F.col("at")) - F.col("at"), F.lit(0)).cast("int")
    rows = rows.filter("__end IS NULL OR stop > __end").select("station", "first_out", (F.col("at") + cut).alias("at"), F.array(F.slice("samples", cut + 1, F.size("samples"))).alias("xs"), "stop")
    stops = rows.groupBy("station", "first_out").agg(F.max("stop").alias("stop_out"))
    rows = null_safe(rows.drop("stop"), stops, ["station", "first_out"], "inner")

    windows = conditioning.windows_over_stretches(rows.withColumn("run", F.col("first_out")), ["station", "run", "stop_out"], n, overlap)
    windows = windows.filter((F.col("at") + n <= F.col("stop_out")) & (F.col("w_start") % step == 0)).withColumn("window", F.get("window", F.lit(0)))
    found = picks.annotate(windows, "window", n, model, out="p").select("station", "run", "at", F.when(F.col("w_start") == 0, F.col("p")).otherwise(F.slice("p", n - step + 1, step)).alias("p"))
    found = carried(dealt(found, ["station", "run"], ["at"]), ["station", "run"], ["at"], previous={"before": F.element_at("p", -1)})
    begin = F.col("at") + n - F.size("p")
    with_before = F.concat(F.array("before"), F.col("p"))
    rises = found.select("station", (begin - 1).alias("b"), F.explode(picks.onsets(with_before, threshold, 1)).alias("i")).select("station", (F.col("b") + F.col("i")).alias("sample"))
    return spaced(rises, keys, "sample", separation)


def chunk_of(ready: Column) -> Column:
    return S.chunk_index(ready)
