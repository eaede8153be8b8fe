"""Column expressions for labels, times, samples and lenient casts.  All run inside code generation; none needs Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_FORMAT = "yyyyMMdd'T'HHmmss'Z'"
CHUNK_PATTERN = r"^\d{8}T\d{6}Z_\d{8}T\d{6}Z$"
PICK_FORMATS = ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss")
#: Texts that mean a missing value in pick files.  Fixed values.
MISSING = ("", "none", "nan", "na")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it inside a lambda for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- numbers -----------------------------------------------------------------------------------------------------


def is_finite(x: Column) -> Column:
    """False for null, NaN and infinities."""
    d = x.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))


def number(x: Column) -> Column:
    """The double a text or number stands for, null for NaN, infinities and anything else."""
    d = x.try_cast("double")
    return F.when(is_finite(d), d)


def finite_int(x: Column) -> Column:
    """The nearest integer (ties to even) of a finite value, else null."""
    return F.bround(number(x), 0).cast("int")


def in_range(x: Column, low: float, high: float) -> Column:
    """``low <= x < high``; false where x is null."""
    return F.coalesce((x >= low) & (x < high), F.lit(False))


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``; null where the bottom is zero or either is null."""
    return F.when(bottom != 0, top / bottom)


def rate(n: Column, seconds: Column) -> Column:
    """Items per second; NaN where the time is missing or not positive."""
    return F.when((seconds > 0) & n.isNotNull(), n / seconds).otherwise(F.lit(float("nan")))


# --- times and samples ---------------------------------------------------------------------------------------------


def to_sample(t: Column, t0: Column, rate_hz: Column | float) -> Column:
    """Samples between ``t0`` and ``t``."""
    return (F.unix_micros(t) - F.unix_micros(t0)) / 1e6 * rate_hz


def to_time(sample: Column, t0: Column, rate_hz: Column | float) -> Column:
    """The time of a sample, to the microsecond."""
    return F.timestamp_micros(F.unix_micros(t0) + F.bround(sample / rate_hz * 1e6, 0).cast("long"))


def is_chunk_id(text: Column) -> Column:
    return F.coalesce(text.rlike(CHUNK_PATTERN), F.lit(False))


def chunk_bounds(text: Column) -> Column:
    """Struct ``start, end, minutes`` of a chunk id; nulls for any other text."""
    parts = F.split(F.when(is_chunk_id(text), text), "_")
    start, end = (F.try_to_timestamp(F.get(parts, F.lit(i)), F.lit(CHUNK_FORMAT)) for i in (0, 1))
    minutes = (F.unix_micros(end) - F.unix_micros(start)) / 60e6
    return F.struct(start.alias("start"), end.alias("end"), minutes.alias("minutes"))


def chunk_id(start: Column, end: Column) -> Column:
    return F.concat_ws("_", F.date_format(start, CHUNK_FORMAT), F.date_format(end, CHUNK_FORMAT))


def chunk_index(seconds: Column, length: float = 60.0) -> Column:
    return F.floor(F.greatest(seconds, F.lit(0.0)) / length).cast("int")


def chunk_end(seconds: Column, length: float = 60.0) -> Column:
    return (chunk_index(seconds, length) + 1) * F.lit(length)


def file_safe(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9A-Za-z._-]", "_")


def parse_pick_time(text: Column) -> Column:
    """The first of four formats that fits; null for none, and for texts that mean a missing value."""
    clean = F.trim(text)
    known = F.when(~F.lower(clean).isin(*MISSING), F.regexp_replace(clean, "Z$", ""))
    return F.coalesce(*[F.try_to_timestamp(known, F.lit(f)) for f in PICK_FORMATS])


def format_pick_time(t: Column) -> Column:
    return F.date_format(t, PICK_FORMATS[0])


def duration_text(seconds: Column) -> Column:
    """``d Days h Hrs m Min s Sec`` of the rounded, non-negative seconds."""
    s = F.greatest(F.bround(seconds, 0), F.lit(0)).cast("long")
    parts = [F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60]
    return F.format_string("%d Days %d Hrs %d Min %d Sec", *parts)


def analysis_window(start: Column, end: Column, chunk: Column, minutes: Column) -> Column:
    """Bounds given by the user, else those of the chunk id, else the length in minutes."""
    bounds = chunk_bounds(chunk)
    pair = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.concat(F.date_format(a, "yyyy-MM-dd HH:mm:ss"), F.lit(" to "), F.date_format(b, "yyyy-MM-dd HH:mm:ss")))
    return F.coalesce(pair(start, end), pair(bounds["start"], bounds["end"]), F.concat(F.format_string("%.0f", minutes.cast("double")), F.lit(" min")))


# --- labels ----------------------------------------------------------------------------------------------------------


def group_size(n: Column, workers: Column | int, grouped: Column) -> Column:
    """Stations in a task: an even share of ``n``, or 1."""
    return F.when(grouped, F.ceil(n / workers)).otherwise(F.lit(1)).cast("int")


def threshold_label(p: Column, s: Column) -> Column:
    text = lambda x: F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x.cast("double")), "0+$", ""), r"\.$", "")
    return F.when(p == s, text(p)).otherwise(F.concat(F.lit("P "), text(p), F.lit(" / S "), text(s)))


def model_label(parent: Column, child: Column) -> Column:
    return F.when(child.isNull() | (child == ""), parent).otherwise(F.concat_ws("/", parent, child))


def resolve_model(name: Column, aliases: dict[str, tuple[str, str]]) -> Column:
    """Struct ``parent, child`` of an alias or of ``parent/child``; the child is null where none is named."""
    pairs = [F.lit(x) for alias, pair in aliases.items() for x in (alias, "/".join(pair))]
    full = F.coalesce(F.try_element_at(F.create_map(*pairs), name), name) if pairs else name
    parts = F.split(full, "/", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("parent"), F.get(parts, F.lit(1)).alias("child"))


def json_value(text: Column) -> Column:
    """JSON text of a table cell: null, number, boolean, or a quoted string."""
    clean = F.trim(text)
    low = F.lower(clean)
    return (
        F.when(clean.isNull() | low.isin(*MISSING, "null"), F.lit("null"))
        .when(low.isin("true", "false"), low)
        .when(clean.try_cast("long").isNotNull(), clean.try_cast("long").cast("string"))
        .when(number(clean).isNotNull(), number(clean).cast("string"))
        .otherwise(F.concat(F.lit('"'), F.replace(F.replace(clean, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    )


def int_list(text: Column) -> Column:
    """Integers of a list text such as ``[0, 1]`` or ``(0,1)`` or ``0``; an empty list for none."""
    inner = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"-?\d+"), F.lit(0))
    return F.transform(inner, lambda x: x.cast("int"))


def first_number(json: Column, paths: tuple[str, ...]) -> Column:
    """The first path of a JSON text that holds a number."""
    return F.coalesce(*[number(F.get_json_object(json, p)) for p in paths])


def variant_label(kind: Column, backend: Column, dtype: Column, workers: Column, threads: Column, compiled: Column) -> Column:
    """Backend and type, then what sets the row apart: compiled, workers, threads."""
    return F.concat_ws(
        "/",
        F.when(kind == "baseline", F.lit("baseline")).otherwise(backend),
        dtype,
        F.when(compiled, F.lit("compiled")),
        F.when(workers > 0, F.concat(F.lit("w"), workers.cast("string"))),
        F.when(threads > 0, F.concat(F.lit("t"), threads.cast("string"))),
    )


def mapped(x: Column, names: dict[str, str], other: Column | None = None) -> Column:
    """A label for each known value, else ``other`` (the value itself by default)."""
    pairs = reduce(lambda acc, kv: acc.when(x == kv[0], F.lit(kv[1])) if acc is not None else F.when(x == kv[0], F.lit(kv[1])), names.items(), None)
    fallback = x if other is None else other
    return fallback if pairs is None else pairs.otherwise(fallback)


def trial_key(*axes: Column) -> Column:
    """Axes joined in order; a missing one is an empty field."""
    return F.concat_ws("|", *[F.coalesce(a.cast("string"), F.lit("")) for a in axes])


def trial_uid(*axes: Column) -> Column:
    """Twelve hexadecimal digits of the key's SHA-1."""
    return F.substring(F.sha1(trial_key(*axes)), 1, 12)


def quality_safe(dtype: Column, f1: Column, least: float = 0.99) -> Column:
    return F.coalesce((dtype == "fp32") | (f1 >= least), F.lit(False))


def usable_trial(timed_out: Column, success_rate: Column, value: Column) -> Column:
    return ~F.coalesce(timed_out, F.lit(False)) & F.coalesce(success_rate == 1.0, F.lit(False)) & is_finite(value)


def completion(repeats: Column, wanted: Column, skipped: Column) -> Column:
    """``skipped``, ``complete``, ``partial`` or ``empty`` of an array of structs with a ``success`` field."""
    done = F.size(F.filter(repeats, lambda r: F.coalesce(r["success"], F.lit(False))))
    return F.when(F.coalesce(skipped, F.lit(False)), "skipped").when(done >= wanted, "complete").when(done > 0, "partial").otherwise("empty")


def stage_split(total: Column, picker: Column, actors: Column, warmup: Column, inference: Column, preprocess: Column) -> Column:
    """Spread the picker's wall time over inference and preprocessing by their busy time; the rest is framework start.

    Without busy time, all of it counts as inference.
    """
    zero = F.lit(0.0)
    busy = F.coalesce(inference, zero) + F.coalesce(preprocess, zero)
    part = lambda x: picker * F.coalesce(x, zero) / busy
    return F.struct(
        F.greatest(zero, total - picker - F.coalesce(actors, zero) - F.coalesce(warmup, zero)).alias("framework"),
        F.coalesce(actors, zero).alias("model_load"),
        F.coalesce(warmup, zero).alias("warmup"),
        F.when(busy > 0, part(inference)).otherwise(picker).alias("inference"),
        F.when(busy > 0, part(preprocess)).otherwise(zero).alias("preprocess"),
    )


def trial_outcome(error: Column, returned: Column, stations: Column, seconds: Column) -> Column:
    """Struct ``ok, reason``."""
    reason = (
        F.when(error.isNotNull() & (error != ""), error)
        .when(F.coalesce(returned, F.lit(0)) == 0, "no stations returned")
        .when(returned < stations, F.concat(returned.cast("string"), F.lit(" of "), stations.cast("string"), F.lit(" stations returned")))
        .when(~is_finite(seconds), "no inference time")
    )
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def mean_utilisation(devices: Column) -> Column:
    """Mean of forward over wall time of an array of structs, in percent; 0 where unknown."""
    shares = F.transform(F.filter(devices, lambda g: g["wall"] > 0), lambda g: g["forward"] / g["wall"])
    total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(shares) > 0, 100.0 * total / F.size(shares)).otherwise(F.lit(0.0))


def window_regime(input_samples: Column, network_samples: int = 6000) -> Column:
    return F.when(input_samples >= network_samples, "single").when(input_samples > 0, "sliding").otherwise("unknown")


def drawn(*of: Column) -> Column:
    """A number from 0 to 1 by a digest of the given values: the same in every run and partitioning."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[x.cast("string") for x in of])), 1, 12), 16, 10).cast("double") / float(1 << 48)
