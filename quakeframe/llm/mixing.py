"""Mixing sources to target weights along a time-varying curriculum.

Each source has a share of the word budget and a density over training time whose integral is that share.  The
running word total of a source, inverted through the integrated density, gives each copy of a document its
position in training; documents are then range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.llm.common import WORD, materialise, running_totals

WEIGHTS = (5, 2, 1)
#: Slope of a source's density over training time, by rank: early, even, late.
TILTS = (0.5, 0.0, -0.5)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float, tilts: tuple[float, ...]) -> DataFrame:
    """Add ``target`` and ``tilt`` to one row per source (``source, source_size``).

    Sources by code point, null last, take the weights in turn.  The budget is ``share`` times all words; a target
    stops at ``most`` times its source, and the excess goes to the others by weight until none is above.  In the
    order of cap per unit of weight the capped sources come first, so the level of the rest follows from sums.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), turn)
    tilt = F.get(F.array(*[F.lit(x) for x in tilts]), turn % len(tilts))
    s = sizes.select("source", "source_size", w.alias("w"), tilt.alias("tilt"), (F.col("source_size") * most).alias("cap"))
    filled = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    earlier = filled.rowsBetween(Window.unboundedPreceding, -1)
    onward = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("w").over(onward)
    s = s.withColumn("level", level).withColumn("open", F.col("cap") > F.col("level") * F.col("w"))
    whole = filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    final = F.coalesce(F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(whole), F.lit(float("inf")))
    return s.select("source", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("cap"), final * F.col("w"))).alias("target"), "tilt")


def invert_density(y: Column, tilt: Column) -> Column:
    """The time t at which the share y of a source is used up, for the density 1 + tilt * (1 - 2t)."""
    b = F.lit(1.0) + tilt
    root = (b - F.sqrt(F.greatest(b * b - 4 * tilt * y, F.lit(0.0)))) / F.when(tilt == 0, F.lit(1.0)).otherwise(2 * tilt)
    return F.when(tilt == 0, y).otherwise(root)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, tilts: tuple[float, ...] = TILTS) -> DataFrame:
    """``doc_id, content, size, source, source_size, target, taken, parts`` of every row; ``parts`` lists the copies.

    Documents of a source are taken in the order of a digest of their id, once around, then again, until the target
    is met; the copy at the target is cut there, so that the words taken equal the target's whole part.  ``parts``
    is an array of (copy, words, position in training from 0 to 1).  A document without words is taken with none.
    Null sources form one source.  Repeated rows are taken one after the other.
    """
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    base = materialise(docs.select("doc_id", F.xxhash64(*docs.columns).alias("content"), "source", word_count(F.col("text")).alias("size"), order.alias("order")))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialise(source_targets(sizes, weights, share, most, tilts)).withColumnRenamed("source", "__source")
    placed = running_totals(base, ["source"], "order", ["doc_id", "size", "content"], F.col("size"))
    joined = placed.join(targets, F.col("source").eqNullSafe(F.col("__source")))
    copies = F.sequence(F.lit(0), F.lit(max(0, int(-(-most // 1)) - 1)))

    def part(copy: Column) -> Column:
        start = copy.cast("long") * F.col("source_size") + F.col("before")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.floor("target") - start))
        y = F.least((start + words / 2) / F.greatest(F.col("target"), F.lit(1e-9)), F.lit(1.0))
        return F.struct(copy.alias("copy"), words.alias("words"), invert_density(y, F.col("tilt")).alias("position"))

    parts = F.filter(F.transform(copies, part), lambda p: p["words"] > 0)
    taken = F.aggregate(F.col("parts"), F.lit(0).cast("long"), lambda a, p: a + p["words"])
    rows = joined.withColumn("parts", parts)
    return rows.select("doc_id", "content", "size", "source", "source_size", "target", taken.alias("taken"), "parts")


def in_training_order(mixed: DataFrame, position: Column) -> DataFrame:
    """Range-partitioned and sorted by position; what takes no part comes last."""
    rows = materialise(mixed.withColumn("position", position))
    return rows.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row per copy in training order, cut copies cut to their words.

    The words of a cut copy are joined by single spaces.  Columns that start with two underscores are reserved.
    """
    names = docs.columns
    # rows of one key are alike in every column: one of them serves the copies of all, by a join on the key alone;
    # both sides are dealt by the same flat columns, so that the texts are shuffled once before they are range-sorted
    key = {"__id": F.coalesce("doc_id", F.lit(0)), "__none": F.col("doc_id").isNull(), "__content": F.xxhash64(*names)}
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1)))
    texts = docs.withColumns(key).withColumn("__turn", turn).filter("__turn = 1").drop("__turn")
    mixed = mix(docs, **options).withColumns(key | {"__content": F.col("content")})
    parts = mixed.select(*key, F.col("size").alias("__size"), F.explode("parts").alias("__part"))
    joined = texts.join(parts, list(key))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("__part.words").cast("int")), " ")
    text = F.when(F.col("__part.words") >= F.col("__size"), F.col("text")).otherwise(cut)
    rows = joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in names], F.col("__part.position").alias("__position"), F.col("doc_id").alias("__tie"))
    # the sampling pass of the range partitioner reads the join's shuffle files again, so no copy of the texts is written
    return rows.repartitionByRange("__position", "__tie").sortWithinPartitions("__position", "__tie").select(*names)
