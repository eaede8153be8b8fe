"""Picks kept at a least distance from the last kept one, however many a key has.

What a range of a key's picks keeps depends on one number, the last pick kept before it, and only through the first pick
that is far enough from it.  So a range is summarised by the last pick that it keeps for each pick it could start with,
at most those within the distance of its first one; the summaries of a key are folded, and each range then keeps its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from quakeframe.operators.scans import dealt, null_safe


def spaced(rows: DataFrame, keys: list[str], value: str, separation: int) -> DataFrame:
    """``keys, value`` of those rows whose whole-numbered ``value`` is the key's first or ``separation`` or more after the last kept one.

    Of equal values one stays; null values go.  Null keys are a key.  A separation of less than 1 counts as 1.
    """
    least = max(1, int(separation))
    own = [*keys, "__range"]
    cut = dealt(rows.select(*keys, F.col(value).cast("long").alias(value)).filter(F.col(value).isNotNull()).distinct(), keys, [value])
    fields = cut.select(*own).schema.fields

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf[value].to_numpy())
        after = np.searchsorted(x, x + least)
        last = x.copy()
        for i in range(len(x) - 1, -1, -1):
            if after[i] < len(x):
                last[i] = last[after[i]]
        n = int(after[0]) + 1  # beyond the distance of the first pick, only the nearest can be the start
        return pdf.iloc[:1][own].assign(starts=[x[:n]], lasts=[last[:n]])

    longs = ArrayType(LongType())
    ranges = cut.groupBy(*own).applyInPandas(summary, StructType([*fields, StructField("starts", longs), StructField("lasts", longs)]))

    def step(acc: Column, r: Column) -> Column:
        far = F.filter(F.arrays_zip(r["starts"].alias("s"), r["lasts"].alias("l")), lambda z: acc["kept"].isNull() | (z["s"] - acc["kept"] >= least))
        entry = F.struct(r["__range"].alias("__range"), acc["kept"].alias("kept"))
        return F.struct(F.coalesce(F.get(far, F.lit(0))["l"], acc["kept"]).alias("kept"), F.array_append(acc["into"], entry).alias("into"))

    none = F.struct(F.lit(None).cast("long").alias("kept"), F.array().cast("array<struct<__range:int,kept:bigint>>").alias("into"))
    per = ranges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__range", "starts", "lasts"))).alias("r"))  # a row per range
    entries = per.select(*keys, F.inline(F.aggregate("r", none, step)["into"]))

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(pdf[value].to_numpy())
        before = pdf["kept"].iloc[0]
        i = 0 if pd.isna(before) else int(np.searchsorted(x, int(before) + least))
        chosen = []
        while i < len(x):
            chosen.append(x[i])
            i = int(np.searchsorted(x, x[i] + least))
        return pdf.iloc[[0] * len(chosen)][keys].assign(**{value: np.array(chosen, dtype=np.int64)})

    joined = null_safe(cut, entries, own, "inner")
    return joined.groupBy(*own).applyInPandas(keep, StructType([f for f in cut.schema.fields if f.name in (*keys, value)]))
