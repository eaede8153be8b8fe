"""Ordered scans and exact quantiles that never gather a key in one task.

Rows are dealt by ranges of (keys, order), so a busy key spreads over ranges.  A range is summarised in a row, the
summaries of a key's ranges are carried along in order, and each range then works on its own rows with what was
carried into it.  The same ranges, over counted values, hold the value at any rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.operators.runs import materialised


def null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join that matches null keys, as grouping does; keeps a's key columns."""
    right = b.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(F.col(f"__r_{k}"))
    return a.join(right, on, how).drop(*[f"__r_{k}" for k in keys])


def dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``__range``, the number of a row's range of (keys, order); rows that tie in both share a range.

    Written once, so that a repeated task finds each row in the range that it was dealt to.
    """
    return materialised(df.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()))


def carried(rows: DataFrame, keys: list[str], order: list[str], totals: dict[str, Column] | None = None, highest: dict[str, Column] | None = None, previous: dict[str, Column] | None = None) -> DataFrame:
    """Add running columns to rows of ``dealt``, in order within each key.

    ``totals`` are sums up to and with the row (null counts as 0), ``highest`` the greatest value up to and with the
    row, ``previous`` a value of the row before (null for a key's first row).  ``order`` must tell all rows of a key
    apart where it matters.
    """
    totals, highest, previous = totals or {}, highest or {}, previous or {}
    work = rows.withColumns({**{f"__t_{n}": F.coalesce(c, F.lit(0)) for n, c in totals.items()}, **{f"__h_{n}": c for n, c in highest.items()}})
    sums = [F.sum(f"__t_{n}").alias(f"__s_{n}") for n in totals] + [F.max(f"__h_{n}").alias(f"__m_{n}") for n in highest]
    if previous:
        work = work.withColumn("__last", F.struct(*[c.alias(n) for n, c in previous.items()]))
        sums.append(F.max_by("__last", F.struct(*order)).alias("__l"))
    ranges = work.groupBy(*keys, "__range").agg(*sums)
    before = Window.partitionBy(*keys).orderBy("__range")
    up_to = before.rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.coalesce(F.sum(f"__s_{n}").over(up_to), F.lit(0)).alias(f"__ct_{n}") for n in totals] + [F.max(f"__m_{n}").over(up_to).alias(f"__ch_{n}") for n in highest]
    carry += [F.lag("__l").over(before).alias("__cl")] if previous else []
    joined = null_safe(work, ranges.select(*keys, "__range", *carry), [*keys, "__range"], "inner")
    local = Window.partitionBy(*keys, "__range").orderBy(*order)
    so_far = local.rowsBetween(Window.unboundedPreceding, 0)
    out = {n: F.col(f"__ct_{n}") + F.sum(f"__t_{n}").over(so_far) for n in totals}
    out |= {n: F.greatest(F.col(f"__ch_{n}"), F.max(f"__h_{n}").over(so_far)) for n in highest}
    if previous:
        prior = F.coalesce(F.lag("__last").over(local), F.col("__cl"))
        out |= {n: prior[n] for n in previous}
    return joined.select(*[c for c in rows.columns if c not in out], *[c.alias(n) for n, c in out.items()])


def without_ranges(rows: DataFrame) -> DataFrame:
    return rows.drop("__range")


def quantiles(df: DataFrame, keys: list[str], measures: dict[str, Column], points: dict[str, list[tuple[str, float]]]) -> DataFrame:
    """Exact interpolated quantiles of several measures, one row per key.

    ``points`` gives for each measure the names and shares (0 to 1) of its quantiles; each is a column of the result,
    null where a measure has no value.  NaN counts as the largest value.  Measures are melted and counted by value
    before anything is shuffled; the two values beside a quantile's place are found by their ranks.
    """
    by = [*keys, "__measure"]
    melted = df.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("__measure"), x.cast("double").alias("__v")) for m, x in measures.items()]))).filter("__v IS NOT NULL")
    counts = melted.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__n"))
    rows = carried(dealt(counts, by, ["__v"]), by, ["__v"], totals={"__upto": F.col("__n")})
    whole = rows.groupBy(*by).agg(F.max("__upto").alias("__whole"))
    rows = null_safe(rows, whole, by, "inner")

    aggs, out = [], []
    for m, named in points.items():
        for name, q in named:
            place = (F.col("__whole") - 1) * F.lit(float(q))
            own = F.col("__measure") == m
            aggs += [F.max(F.when(own, place - F.floor(place))).alias(f"__f_{name}")]
            aggs += [F.max(F.when(own & (F.col("__upto") - F.col("__n") <= r) & (r < F.col("__upto")), F.col("__v"))).alias(f"__{side}_{name}") for side, r in (("a", F.floor(place)), ("b", F.ceil(place)))]
            a, b, f = F.col(f"__a_{name}"), F.col(f"__b_{name}"), F.col(f"__f_{name}")
            out.append(F.when(f == 0, a).otherwise((1 - f) * a + f * b).alias(name))
    return rows.groupBy(*keys).agg(*aggs).select(*keys, *out)


def with_quantiles(plain: DataFrame, df: DataFrame, keys: list[str], measures: dict[str, Column], points: dict[str, list[tuple[str, float]]]) -> DataFrame:
    """``plain``, one row per key of ``df``, with the columns of ``quantiles``; without keys both have one row."""
    if not keys:
        one = quantiles(df.withColumn("__all", F.lit(0)), ["__all"], measures, points)
        return plain.withColumn("__all", F.lit(0)).join(one, "__all", "left").drop("__all")
    return null_safe(plain, quantiles(df, keys, measures, points), keys, "left")
