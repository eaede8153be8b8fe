"""Helpers shared by the operators: materialised intermediates, Arrow batches and skew-proof running totals."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The six white-space characters of the class [\x20\x09-\x0D].
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="quakeframe-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialise(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and reread it: cuts lineage, survives lost executors, has true size statistics."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def extended(df: DataFrame, **columns: str) -> StructType:
    """The schema of ``df`` with further columns, given as name and type."""
    return StructType([*df.schema.fields, *[StructField(n, DataType.fromDDL(t)) for n, t in columns.items()]])


def strings(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of every value of a string column; null counts as empty."""
    kind = pa.large_binary()
    if not pa.types.is_binary(column.type):
        column = column.cast(pa.large_string())
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(batches, column: str, limit: int = 1 << 21):
    """(part of a batch, its texts as bytes): parts hold at most ``limit`` bytes of text, or one row.

    A batch from the engine may hold 10,000 rows; what is made of a part is bounded by the part.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and held + size > limit:
                yield (part := batch.slice(start, i - start)), strings(part.column(part.schema.get_field_index(column)))
                start, held = i, 0
            held += size
        part = batch.slice(start)
        yield part, strings(part.column(part.schema.get_field_index(column)))


def chunks(texts: list[bytes], limit: int = 1 << 22):
    """Consecutive (start, end) ranges of ``texts`` of at most ``limit`` bytes, or of a single text."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        if i > start and total + len(text) > limit:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def pack(texts: list[bytes], gap: bytes = b"\n") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One byte buffer of all texts, each followed by ``gap``, with the start and the end of each."""
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lengths + len(gap)) - len(gap)
    return np.frombuffer(gap.join(texts) + gap, dtype=np.uint8), ends - lengths, ends


def running_totals(df: DataFrame, keys: list[str], order: str, ties: list[str], weight: Column, rows_per_bucket: int = 1024) -> DataFrame:
    """Add ``before``: the sum of ``weight`` over the rows of the same key that come earlier by (``order``, ``ties``).

    ``order`` is a lower-case hexadecimal digest.  Its leading digits cut each key into buckets of about
    ``rows_per_bucket`` rows, so that no task ever holds a whole key: bucket sums are combined map-side, their
    prefix sums run over a small table, and only the rows of one bucket are sorted together.
    ``df`` is read twice; pass a materialised table.
    """
    spread = F.conv(F.substring(order, 1, 13), 16, 10).cast("double") / float(1 << 52)
    per_key = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows_per_bucket).alias("__buckets"))


    a, b = df.alias("a"), per_key.alias("b")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    dealt = a.join(b, on, "inner").select("a.*", F.floor(spread * F.col("__buckets")).alias("__bucket"), weight.alias("__weight"))
    sums = dealt.groupBy(*keys, "__bucket").agg(F.sum("__weight").alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("__offset", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("__inside", F.coalesce(F.sum("__weight").over(inside), F.lit(0)))
    c, d = rows.alias("c"), offsets.alias("d")
    on = F.lit(True)
    for k in [*keys, "__bucket"]:
        on = on & F.col(f"c.{k}").eqNullSafe(F.col(f"d.{k}"))
    kept = [F.col(f"c.{n}") for n in df.columns]
    return c.join(d, on, "inner").select(*kept, (F.col("__offset") + F.col("__inside")).alias("before"))
