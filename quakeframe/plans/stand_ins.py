"""Picks, trials and waveforms read from the general tables at hand.

Events play picks and station events, line items play trial repeats, embeddings play traces and windows.
Each view comes with the SQL that says the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START = "2024-01-01"


def micros(t: str) -> Column:
    """Microseconds since the start of a time without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '{START}', {t})")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run, station, phase, sample, prob, t, event_id``; samples are minutes since the start."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type") != "error")
    return e.select(
        F.when(F.col("event_id") % 2 == 0, "catalog").otherwise("detected").alias("run"),
        F.format_string("S%04d", F.col("user_id")).alias("station"),
        F.when(F.col("event_type").isin("click", "view"), "P").otherwise("S").alias("phase"),
        (micros("ts") / 60e6).alias("sample"),
        (F.col("value") / 500.0).alias("prob"), F.col("ts").cast("timestamp").alias("t"), "event_id",
    )


PICKS = """picks AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'catalog' ELSE 'detected' END AS run, printf('S%04d', user_id) AS station,
  CASE WHEN event_type IN ('click', 'view') THEN 'P' ELSE 'S' END AS phase,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 60000000.0::DOUBLE AS sample, value / 500.0::DOUBLE AS prob, ts AS t, event_id
  FROM events WHERE event_type <> 'error')"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model, device, n_stations, variant, kind, repeat, wall_s, success, dtype, cpus, f1``, one row per line item."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("device"), (F.col("l_linenumber") * 50).cast("int").alias("n_stations"),
        (F.col("l_suppkey") % 5).cast("int").alias("variant"), F.when(F.col("l_suppkey") % 5 == 0, "baseline").otherwise("single").alias("kind"),
        F.col("l_orderkey").alias("repeat"), (F.col("l_extendedprice") / 1000.0).alias("wall_s"), (F.col("l_discount") < 0.09).alias("success"),
        F.when(F.col("l_partkey") % 3 == 0, "fp32").when(F.col("l_partkey") % 3 == 1, "bf16").otherwise("fp16").alias("dtype"),
        (F.col("l_quantity")).cast("int").alias("cpus"), (1.0 - F.col("l_tax")).alias("f1"),
    )


TRIALS = """trials AS (SELECT l_returnflag AS model, l_linestatus AS device, (l_linenumber * 50)::INTEGER AS n_stations, (l_suppkey % 5)::INTEGER AS variant,
  CASE WHEN l_suppkey % 5 = 0 THEN 'baseline' ELSE 'single' END AS kind, l_orderkey AS repeat, l_extendedprice / 1000.0::DOUBLE AS wall_s, (l_discount < 0.09) AS success,
  CASE WHEN l_partkey % 3 = 0 THEN 'fp32' WHEN l_partkey % 3 = 1 THEN 'bf16' ELSE 'fp16' END AS dtype, l_quantity::INTEGER AS cpus, 1.0::DOUBLE - l_tax AS f1 FROM lineitem)"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``trace, station, p``: one array of values per trace, and its station."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("trace"), F.format_string("S%04d", F.col("label")).alias("station"), F.transform("embedding", lambda x: x.cast("double")).alias("p"))


TRACES = "traces AS (SELECT vec_id AS trace, printf('S%04d', label) AS station, embedding::DOUBLE[] AS p FROM embeddings)"


def station_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``station, chunk, ready_s, queued_s, returned_s, seen``: seconds within an hour's chunk."""
    e = table(spark, sf_dir, "events")
    second = (micros("ts") % 3600000000) / 1e6
    return e.select(
        F.format_string("S%04d", F.col("user_id")).alias("station"), F.floor(micros("ts") / 3600000000).cast("int").alias("chunk"),
        second.alias("ready_s"), (second + F.col("value") / 100).alias("queued_s"), (second + F.col("value") / 50).alias("returned_s"), F.col("ts").cast("timestamp").alias("seen"), "event_id",
    )


STATION_EVENTS = """station_events AS (SELECT printf('S%04d', user_id) AS station, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000)::INTEGER AS chunk,
  (epoch_us(ts) % 3600000000) / 1000000.0::DOUBLE AS ready_s, (epoch_us(ts) % 3600000000) / 1000000.0::DOUBLE + value / 100 AS queued_s,
  (epoch_us(ts) % 3600000000) / 1000000.0::DOUBLE + value / 50 AS returned_s, ts AS seen, event_id FROM events)"""


def rounded(df: DataFrame, digits: int = 6, finer: tuple[str, ...] = ()) -> DataFrame:
    """All doubles rounded, for comparison with another engine's sums.

    Columns in ``finer`` keep nine digits: means of a few decimal amounts, whose seventh digit is often an exact 5.
    """
    return df.select(*[F.round(c, 9 if c in finer else digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
