"""Runs of values without a wide gap, found without ever gathering a key in one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Runs of up to so many picks fold inside a row; longer ones are settled by stretches.
SHORT = 64


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder named by ``spark.checkpoint.dir``; in a temporary one in local mode where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quakeframe-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and reread."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def short_and_long(runs: DataFrame, keys: list[str], most: int = SHORT) -> tuple[DataFrame, DataFrame | None]:
    """Rows of runs of up to ``most`` rows, and rows of longer ones (None without any)."""
    runs = materialised(runs)
    long = runs.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most).select(*[F.col(k).alias(f"__{k}") for k in [*keys, "run"]])
    if long.isEmpty():
        return runs, None
    on = F.lit(True)
    for k in [*keys, "run"]:
        on = on & runs[k].eqNullSafe(F.col(f"__{k}"))
    return runs.join(long, on, "left_anti"), runs.join(long, on, "left_semi")


def with_runs(df: DataFrame, keys: list[str], value: str, gap: float, inclusive: bool = False, width: float | None = None) -> DataFrame:
    """Add ``run``: the first value of the row's run.  A run ends where the next value is more than ``gap`` away
    (``inclusive``: at least ``gap``).

    Rows are sorted within buckets of ``width`` (1,000 gaps by default); how runs continue across buckets follows
    from one row per key and bucket, so a key with a third of all rows spreads over its buckets.
    """
    width = width or 1000.0 * gap
    rows = df.withColumn("__b", F.floor(F.col(value) / width))
    inside = Window.partitionBy(*keys, "__b").orderBy(value)

    def wide(a, b):
        return a - b >= gap if inclusive else a - b > gap

    v = F.col(value)
    rows = rows.withColumn("__open", F.when(wide(v, F.lag(value).over(inside)), v))
    buckets = rows.groupBy(*keys, "__b").agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"), F.max("__open").alias("__last"))
    along = Window.partitionBy(*keys).orderBy("__b")
    before = F.lag("__hi").over(along)
    buckets = buckets.withColumn("__first", F.when(before.isNull() | wide(F.col("__lo"), before), F.col("__lo")))
    buckets = buckets.withColumn("__start", F.coalesce("__last", "__first"))
    carried = F.last("__start", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    buckets = buckets.select(*keys, "__b", F.coalesce("__first", carried).alias("__enter"))
    opened = F.last("__open", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.withColumn("__opened", opened).join(buckets, [*keys, "__b"])
    return joined.select(*df.columns, F.coalesce("__opened", "__enter").alias("run"))


def numbered(rows: DataFrame, order: list[str], name: str, start: int) -> DataFrame:
    """Add the row's place in the whole order: rows are dealt by ranges, and a place is the sum of earlier ranges' counts and its own."""
    dealt = materialised(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    counts = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = counts.select("__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return dealt.withColumn("__inside", inside).join(offsets, "__range").select(*rows.columns, (F.col("__offset") + F.col("__inside") + start).alias(name))
