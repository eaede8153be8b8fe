"""Readers of waveform folders, trial records, manifests and pick files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakeframe.functions import scalars as S
from quakeframe.sources import schemas

EXTENSIONS = ("mseed", "miniseed", "msd", "sac", "parquet")


# --- files of a waveform archive ------------------------------------------------------------------------------------------


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` of all files below a folder; contents are never read, and empty files are left out."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")


def waveform_files(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Files with a waveform extension in any case, once each."""
    return files.filter(F.lower("path").rlike(r"\.(" + "|".join(extensions) + r")$")).dropDuplicates(["path"])


def stations_of(files: DataFrame) -> DataFrame:
    """Distinct ``station`` folders, sorted; a folder named like a chunk is none; the abstracted layout wins where present."""
    parts = F.split("path", "/")
    parent = F.get(parts, F.size(parts) - 2)
    rows = files.select(parent.alias("station"), F.col("path").contains("/abstracted_waveforms/").alias("abstracted")).filter(~S.is_chunk_id(F.col("station")))
    marked = rows.groupBy("station").agg(F.max("abstracted").alias("abstracted"))
    some = marked.agg(F.max("abstracted").alias("__any"))
    return marked.join(F.broadcast(some)).filter((F.col("abstracted") == F.col("__any"))).select("station").orderBy("station")


def select_stations(stations: DataFrame, n: int) -> DataFrame:
    """The first n stations by name; raises, when run, if there are fewer."""
    first = stations.select("station").distinct().orderBy("station").limit(n)
    found = first.agg(F.count(F.lit(1)).alias("__n"))
    check = F.when(F.col("__n") < n, F.raise_error(F.concat(F.lit(f"asked for {n} stations, found "), F.col("__n").cast("string"))).cast("string")).otherwise(F.col("station"))
    return found.join(first, F.lit(True), "left").select(check.alias("station"))


def resolve_files(files: DataFrame, decoded: DataFrame, keys: list[str]) -> DataFrame:
    """Files of each chunk and station: the chunk's own, or the parent folder's where those decode to nothing.

    ``files`` has ``keys, path, local``; ``decoded`` has ``path, samples``.
    """
    rows = files.join(decoded, "path", "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
    w = Window.partitionBy(*keys)
    own = F.sum(F.when(F.col("local"), F.col("samples")).otherwise(0)).over(w)
    return rows.withColumn("__own", own).filter(F.col("local") == (F.col("__own") > 0)).drop("__own")


def network_segments(segments: DataFrame, stations: DataFrame | None = None) -> DataFrame:
    """All segments, or those of the given stations."""
    return segments if stations is None else segments.join(stations.select(F.col("station").alias("sta")), "sta", "left_semi")


# --- trial records -----------------------------------------------------------------------------------------------------------


def read_trials(spark: SparkSession, path: str, include_errors: bool = False, drop_env: bool = True) -> DataFrame:
    """Rows of a trial file: blank and malformed lines dropped, wall time completed, ``is_error`` and ``variant`` added."""
    raw = spark.read.schema(schemas.TRIAL_JSONL + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return shape_trials(raw.filter("_bad IS NULL").drop("_bad"), include_errors, drop_env)


def shape_trials(raw: DataFrame, include_errors: bool = False, drop_env: bool = True) -> DataFrame:
    rows = raw.filter(F.col("kind").isNotNull())
    if drop_env:
        rows = rows.filter("kind <> 'env'")
    if not include_errors:
        rows = rows.filter("kind <> 'error'")
    wall = F.coalesce("wall_time_s", "total_s", F.try_element_at("stage_times_s", F.lit("total")))
    variant = S.variant_label(F.col("kind"), F.col("backend"), F.col("dtype"), F.col("n_cpu_workers"), F.col("infer_num_threads"), F.coalesce(F.col("backend_extra.compile"), F.lit(False)))
    return rows.withColumns({"wall_time_s": wall, "is_error": F.col("kind") == "error", "variant": variant})


def env_rows(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, line, value``: environment snapshots, in the order of files and of lines in a file.

    A line's number only tells which of a block's lines comes first; a file that is read in several blocks keeps its order.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")]
    return spark.read.text(path).select(*place, "value").filter(F.get_json_object("value", "$.kind") == "env").orderBy("file", "block", "line")


def read_results(spark: SparkSession, folder: str, axes: dict[str, str], names: str = "result.json") -> DataFrame:
    """All files of the given names below a folder, one record each, with axes taken from the path by regular expression."""
    raw = spark.read.schema(schemas.RESULT_JSON).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", names).json(folder)
    path = F.col("_metadata.file_path")
    named = {k: F.nullif(F.regexp_extract(path, v, 1), F.lit("")) for k, v in axes.items()}
    return raw.select("*", path.alias("path"), *[c.alias(k) for k, c in named.items()])


def result_repeats(results: DataFrame, keys: list[str]) -> DataFrame:
    """One row per cell and successful repeat; a cell without one has a single row with ``ok`` false."""
    good = F.filter("timing.repeats", lambda r: F.coalesce(r["success"], F.lit(False)))
    rows = results.select(*keys, F.explode_outer(good).alias("r"))
    return rows.withColumn("ok", F.col("r").isNotNull()).select(*keys, "ok", "r.*")


def read_trial_csv(spark: SparkSession, path: str, columns: dict[str, str], gpu_list: str = "gpus") -> DataFrame:
    """Trial table with human names; ``columns`` maps name to (new name, type) as ``new type``; bad cells are null."""
    raw = spark.read.option("header", "true").csv(path)
    out = []
    for name, spec in columns.items():
        new, kind = spec.split(" ")
        c = F.trim(F.col(f"`{name}`"))
        out.append(S.int_list(c).alias(new) if new == gpu_list else c.try_cast(kind).alias(new))
    return raw.select(*out)


# --- picks and catalogs ----------------------------------------------------------------------------------------------------------


def read_picks(spark: SparkSession, path: str) -> DataFrame:
    """``station, phase, t, prob`` of pick files; texts that mean a missing value are null."""
    raw = spark.read.schema(schemas.PICK_CSV).option("header", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(path)
    one = lambda p, s: F.struct(F.lit(p).alias("phase"), S.parse_pick_time(F.col(f"{s}_arrival_time")).alias("t"), S.number(F.col(f"{s}_probability")).alias("prob"))
    return raw.select("station", F.inline(F.array(one("P", "p"), one("S", "s")))).filter("t IS NOT NULL")


def manifest_catalog(manifest: DataFrame) -> DataFrame:
    """``station, phase, sample`` of a manifest: scalars ``p_sample, s_sample``, else the lists ``p, s``; a sample of 0 counts."""
    rows = manifest.select(F.explode("stations").alias("station", "m"))
    of = lambda s: F.coalesce(F.when(F.col(f"m.{s}_sample").isNotNull(), F.array(f"m.{s}_sample")), F.col(f"m.{s}"), F.array().cast("array<double>"))
    one = lambda p, s: F.transform(of(s), lambda x: F.struct(F.lit(p).alias("phase"), x.alias("sample")))
    return rows.select("station", F.inline(F.concat(one("P", "p"), one("S", "s"))))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).option("multiLine", "true").json(path)


def picks_from_json(text: Column) -> Column:
    """Array of ``station, phase, sample`` of a picks text."""
    entries = F.map_entries(F.from_json(text, schemas.PICKS_JSON))

    def side(e: Column, s: str) -> Column:
        return F.transform(F.coalesce(e["value"][s], F.array().cast("array<double>")), lambda x: F.struct(e["key"].alias("station"), F.lit(s.upper()).alias("phase"), x.alias("sample")))

    return F.flatten(F.transform(entries, lambda e: F.concat(side(e, "p"), side(e, "s"))))


def catalog_columns(metadata: DataFrame) -> DataFrame:
    """Rename either spelling of the arrival columns to ``p`` and ``s``; raises if the P column is absent."""
    names = {}
    for phase in "ps":
        for spelling in (f"trace_{phase}_arrival_sample", f"trace_{phase.upper()}_arrival_sample"):
            if spelling in metadata.columns:
                names[phase] = spelling
    if "p" not in names:
        raise ValueError("no P arrival column among " + ", ".join(metadata.columns))
    return metadata.withColumnsRenamed({v: k for k, v in names.items()})


# --- generated and chosen networks ------------------------------------------------------------------------------------------------


def seeded_subset(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a seeded digest of their key, one per key."""
    return rows.dropDuplicates([key]).orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)).limit(n)


def build_network(metadata: DataFrame, n: int, seed: int, low: float, high: float, trim: int | None = None, array: str = "samples") -> DataFrame:
    """n distinct traces with both picks inside the range; raises, when run, if there are fewer.

    ``trim`` cuts each chosen trace to its first samples; the choice is the same with and without it.
    """
    good = metadata.filter(S.is_finite(F.col("p")) & S.is_finite(F.col("s")) & S.in_range(F.col("p"), low, high) & S.in_range(F.col("s"), low, high))
    chosen = seeded_subset(good, "trace", n, seed)
    count = chosen.agg(F.count(F.lit(1)).alias("__n"))
    check = F.when(F.col("__n") < n, F.raise_error(F.concat(F.lit(f"asked for {n} traces, found "), F.col("__n").cast("string"))).cast("long")).otherwise(F.col("trace"))
    out = chosen.join(F.broadcast(count)).withColumn("trace", check).drop("__n")
    return out if trim is None else out.withColumn(array, F.slice(array, 1, trim))


def synthetic_network(spark: SparkSession, stations: int | DataFrame, n: int, seed: int) -> DataFrame:
    """Segments of noise with a Gaussian pulse at P and at S on each component, and the pulses' samples.

    ``stations`` is a number of made-up names, or a table with a column ``sta``.  Every value is a digest of seed, station
    and place, so it is the same for every partitioning.
    """
    named = spark.range(stations).select(F.format_string("S%04d", "id").alias("sta")) if isinstance(stations, int) else stations.select("sta")
    drawn = lambda salt, *of: S.drawn(F.lit(f"{seed}/{salt}"), *of)
    p = (F.floor(drawn("p", F.col("sta")) * (n // 3)) + n // 6).cast("int")
    rows = named.withColumn("p_sample", p).withColumn("s_sample", (F.col("p_sample") + n // 4).cast("int")).withColumn("comp", F.explode(F.array(*[F.lit(c) for c in "ZNE"])))
    noise = lambda i: drawn("noise", F.col("sta"), F.col("comp"), i.cast("string")) / 10 - 0.05
    pulse = lambda i, at, width: F.exp(-((i - F.col(at)) ** 2) / (2.0 * width * width))
    samples = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (noise(i) + pulse(i, "p_sample", 5) + pulse(i, "s_sample", 8)).cast("float"))
    return rows.select(F.lit("SB").alias("net"), "sta", F.lit("").alias("loc"), F.concat(F.lit("HH"), "comp").alias("cha"), F.lit("2024-01-01").cast("timestamp").alias("start"), F.lit(100.0).alias("sr"), samples.alias("samples"), "p_sample", "s_sample")


def duplicate_stations(segments: DataFrame, copies: int) -> DataFrame:
    """Each segment under ``copies`` new station codes, cut to five characters."""
    return segments.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("sta", F.substring(F.format_string("S%04d", F.col("copy")), 1, 5))
