"""Sharding along a Hilbert curve: built-in functions only.

Metadata dimensions are quantised to cells, cells are ordered along the curve, and the order is cut into runs of
equal row counts.  Neighbouring runs share narrow ranges in every dimension, so that file statistics prune by any.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.llm.common import materialise, running_totals


def _rotate(value: int, by: int, width: int) -> int:
    by %= width
    return ((value << by) | (value >> (width - by))) & ((1 << width) - 1)


def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """Digit and next state for each (state, corner); a state is an entry corner and a direction of the curve.

    Built from the reflected Gray code: the sub-cell of rank w has the corner gray(w), rotated by the direction and
    mirrored at the entry; it is entered at the Gray code of the even number below w.
    """
    side = 1 << dims
    gray = [w ^ (w >> 1) for w in range(side)]
    rank = {g: w for w, g in enumerate(gray)}

    def trailing_ones(w: int) -> int:
        return (~w & (w + 1)).bit_length() - 1

    def entry(w: int) -> int:
        return 0 if w == 0 else gray[2 * ((w - 1) // 2)]

    def direction(w: int) -> int:
        return 0 if w == 0 else trailing_ones(w - 1) % dims if w % 2 == 0 else trailing_ones(w) % dims

    digits, states = [], []
    for state in range(side * dims):
        start, axis = divmod(state, dims)
        for corner in range(side):
            w = rank[_rotate(corner ^ start, -(axis + 1), dims)]
            digits.append(w)
            states.append((start ^ _rotate(entry(w), axis + 1, dims)) * dims + (axis + direction(w) + 1) % dims)
    return digits, states


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Position along the curve of a cell given by integers from 0 to 2**bits - 1; dims * bits must be 62 or less."""
    n = len(dims)
    digits, states = (F.array(*[F.lit(x) for x in t]) for t in curve_tables(n))

    def corner(level: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.getbit(d.cast("long"), level).cast("int") * (1 << k) for k, d in enumerate(dims)])

    def step(acc: Column, level: Column) -> Column:
        at = acc["state"] * (1 << n) + corner(level)
        return F.struct((acc["index"] * (1 << n) + F.get(digits, at)).alias("index"), F.get(states, at).alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), start, step, lambda acc: acc["index"])


def with_value_cells(rows: DataFrame, name: str, bits: int, out: str) -> DataFrame:
    """Add ``out``: the cell of a categorical value by its place among the sorted distinct values, null first.

    The order of values is kept, so that the smallest and largest value of a run of cells bound what is in it.  Up to
    2**bits values have a cell of their own.  Values are ranked in one window: a row per distinct value.
    """
    place = F.row_number().over(Window.orderBy(F.col(name).asc_nulls_first())) - 1
    values = rows.select(name).distinct()
    cells = values.select(F.col(name).alias("__value"), F.floor(place * (1 << bits) / F.count(F.lit(1)).over(Window.partitionBy())).cast("int").alias(out))
    return rows.join(cells, F.col(name).eqNullSafe(F.col("__value"))).drop("__value")


def size_cell(value: Column, bits: int) -> Column:
    """A cell of a size by its binary logarithm, the last cell open above."""
    return F.least(F.floor(F.log2(F.greatest(value, F.lit(1)))).cast("int"), F.lit((1 << bits) - 1))


def hilbert_shards(rows: DataFrame, cell: str, order: str, ties: list[str], shards: int) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0): runs of the order (cell, order, ties).

    Counts differ by one at most: of N rows, the first N mod shards shards have one more.  No task holds a whole
    cell: ranks are prefix sums over cells, over buckets of a cell, then over the rows of a bucket.
    ``rows`` is read several times; pass a materialised table.
    """
    counts = rows.groupBy(cell).agg(F.count(F.lit(1)).alias("__n"))
    # cells number 2**(dims*bits) at most, whatever the input
    along = Window.orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    cells = counts.select(F.col(cell).alias("__cell"), F.coalesce(F.sum("__n").over(along), F.lit(0)).alias("__start"), F.sum("__n").over(whole).alias("__total"))
    ranked = running_totals(rows, [cell], order, ties, F.lit(1).cast("long"))
    placed = ranked.join(cells, F.col(cell) == F.col("__cell")).withColumn("__rank", F.col("__start") + F.col("before"))
    each, more = F.floor(F.col("__total") / shards), F.col("__total") % shards
    long_part = more * (each + 1)
    shard = F.when(F.col("__rank") < long_part, F.floor(F.col("__rank") / (each + 1))).otherwise(more + F.floor((F.col("__rank") - long_part) / F.greatest(each, F.lit(1))))
    first = shard * each + F.least(shard, more)
    return placed.select(*[F.col(c) for c in rows.columns], shard.cast("int").alias("shard"), (F.col("__rank") - first).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 16, bits: int = 4) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, cell`` of every row of ``docs``.

    The law is ``rows``: shard counts differ by one at most.  Dimensions are language, source and size.  A null text
    has size 1 and checksum 0; a null id orders as an empty text; null languages and sources come before all others.
    Rows of equal cells are ordered by a digest of id and checksum, then by both; repeated rows take neighbouring
    places.  Further columns of ``docs``, whatever their names, are left out.
    """
    text = F.coalesce("text", F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    base = docs.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), "lang", "source")
    base = with_value_cells(with_value_cells(base, "lang", bits, "__lang"), "source", bits, "__source")
    cell = hilbert_index([F.col("__lang"), F.col("__source"), size_cell(F.col("size"), bits)], bits)
    order = F.md5(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("text_crc32").cast("string")))
    rows = materialise(base.select("doc_id", "size", "text_crc32", cell.alias("cell"), order.alias("order")))
    placed = hilbert_shards(rows, "cell", "order", ["doc_id", "text_crc32"], shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")


def write_shards(rows: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """Write each shard to a folder of its own, in slot order; a large shard is cut into files that are runs of slots."""
    rows.repartitionByRange(F.col(shard), F.col(slot)).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
