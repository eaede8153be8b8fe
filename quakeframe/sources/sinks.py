"""Writers of picks, logs, summaries and trial records.  Each has a frame form (what is written) and a write call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.functions import scalars as S
from quakeframe.operators.runs import numbered
from quakeframe.operators.scans import carried, dealt
from quakeframe.sources.schemas import PICK_COLUMNS


def pick_rows(paired: DataFrame, network: str = "") -> DataFrame:
    """The eleven columns of a pick file from ``station, p_time, p_prob, s_time, s_prob`` (timestamps)."""
    text = lambda c: F.coalesce(S.format_pick_time(F.col(c)), F.lit(""))
    prob = lambda c: F.coalesce(F.format_string("%.6f", F.col(c)), F.lit(""))
    zero = F.lit(0.0)
    values = [F.col("station"), F.lit(network), F.col("station"), F.lit("0"), zero, zero, zero, text("p_time"), F.when(F.col("p_time").isNotNull(), prob("p_prob")).otherwise(""), text("s_time"), F.when(F.col("s_time").isNotNull(), prob("s_prob")).otherwise("")]
    extra = [c for c in ("chunk_id",) if c in paired.columns]
    return paired.select(*[v.alias(n) for n, v in zip(PICK_COLUMNS, values, strict=True)], *extra)


def write_picks(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """One folder per chunk and station, as CSV or XML: a file each, more for a station that would fill a task."""
    rows = rows.withColumn("sta", F.col("station"))
    keys = [c for c in ("chunk_id", "sta") if c in rows.columns]
    writer = rows.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys)
    writer.option("header", "true").csv(path) if kind == "csv" else writer.option("rowTag", "pick").xml(path)


def export_tree(picks: DataFrame, stations: DataFrame) -> DataFrame:
    """``station, p_time, s_time`` with P and S paired by their place in the lists; a blank row for a station without picks."""
    keys = ["station", "phase"]
    rows = carried(dealt(picks.select(*keys, "t"), keys, ["t"]), keys, ["t"], totals={"rn": F.lit(1)}).withColumn("rn", F.col("rn").cast("int"))
    side = lambda p: rows.filter(F.col("phase") == p).select("station", "rn", F.col("t").alias(f"{p.lower()}_time"))
    both = side("P").join(side("S"), ["station", "rn"], "full_outer")
    return stations.select("station").distinct().join(both, "station", "left").select("station", "rn", "p_time", "s_time")


def picks_json(picks: DataFrame) -> DataFrame:
    """One row per station: ``station, p, s`` lists of samples in order."""
    of = lambda p: F.array_sort(F.collect_list(F.when(F.col("phase") == p, F.col("sample"))))
    return picks.groupBy("station").agg(of("P").alias("p"), of("S").alias("s"))


def write_picks_json(picks: DataFrame, path: str) -> None:
    picks_json(picks).write.mode("overwrite").json(path)


def classify_rows(picks: DataFrame) -> DataFrame:
    return picks.select("station", "phase", S.format_pick_time(F.col("t")).alias("peak_time"), F.col("prob").alias("peak_value"))


def pick_log(picks: DataFrame) -> DataFrame:
    """``station, place, line``: times in order, P before S at ties; rows without a time dropped."""
    rank = F.when(F.col("phase") == "P", 0).otherwise(1)
    good = picks.filter(F.col("t").isNotNull() & F.col("phase").isin("P", "S")).select("station", "t", "phase", rank.alias("rank"))
    rows = carried(dealt(good, ["station"], ["t", "rank"]), ["station"], ["t", "rank"], totals={"place": F.lit(1)})
    return rows.select("station", F.col("place").cast("int").alias("place"), F.concat(S.format_pick_time(F.col("t")), F.col("phase")).alias("line"))


def write_pick_log(picks: DataFrame, path: str) -> None:
    """One folder of text per station, lines in order."""
    pick_log(picks).repartition("station").sortWithinPartitions("station", "place").select("station", F.col("line").alias("value")).write.mode("overwrite").partitionBy("station").text(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; the others stay; ordered by key without regard to case."""
    both = new.withColumn("__p", F.lit(0)).unionByName(old.withColumn("__p", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__p")
    return both.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__p", "__rn").orderBy(*[F.upper(F.col(k).cast("string")) for k in keys])


def number_records(records: DataFrame, order: list[str]) -> DataFrame:
    """Trial numbers from 1 in the order of their keys."""
    return numbered(records, order, "trial_number", 1)


def append_records(records: DataFrame, path: str, names: dict[str, str]) -> None:
    """Append records under their file names, with the time of writing."""
    records.withColumnsRenamed(names).withColumn("recorded_at", F.current_timestamp()).write.mode("append").json(path)


def patched(records: DataFrame, patches: DataFrame, key: str, seq: str) -> DataFrame:
    """Records with later patches applied: for each column, the last value that is not null."""
    both = records.unionByName(patches, allowMissingColumns=True)
    cols = [c for c in records.columns if c not in (key, seq)]
    return both.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in cols])


def result_struct(meta: Column, timing: Column, quality: Column) -> Column:
    return F.struct(F.lit(3).alias("schema_version"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("recorded_at"), meta.alias("meta"), timing.alias("timing"), quality.alias("pick_quality_vs_catalog"))


def write_results(rows: DataFrame, path: str, axes: tuple[str, ...] = ()) -> None:
    """Append result records as JSON; with ``axes`` each record is a file of its own, in folders named by their values."""
    writer = rows.write.mode("append")
    writer.option("maxRecordsPerFile", 1).partitionBy(*axes).json(path) if axes else writer.json(path)
