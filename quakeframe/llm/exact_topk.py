"""Exact top-k search by vector-approximation files.

Vectors are written twice: whole, and as blocks of cells, one byte a component, with the grid of each block.  The scan
reads cells only and bounds every inner product from both sides.  What may still be among the k best of a query is read
whole, in the order of its upper bound (for inner products the counterpart of lower bounds of distances), until no
unread vector can enter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeframe.llm.common import materialise

#: Cells of each dimension of a block.
CELLS = 64
#: The ends of a long, as doubles; scores and bounds beyond them are held there.
LEAST, MOST = -(2.0**63), 2.0**63


def integer_components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as doubles (which hold these integers exactly)."""

    def whole(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole

    return F.transform(vector, whole)


def usable(vector: Column, scale: int) -> Column:
    """True for a vector without null, NaN or infinite components, before and after scaling."""

    def bad(x: Column) -> Column:
        y = x.cast("double") * scale
        return x.isNull() | F.isnan(y) | (F.abs(y) == float("inf"))

    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True))


@dataclass
class Approximation:
    """Cells of one block, with the lowest value and the cell width of each dimension."""

    cells: np.ndarray
    low: np.ndarray
    width: np.ndarray

    @classmethod
    def of(cls, block: np.ndarray) -> Approximation:
        low = block.min(axis=0)
        width = np.floor(block.max(axis=0) / CELLS - low / CELLS) + 1
        return cls(np.clip(np.floor((block - low) / width), 0, CELLS - 1).astype(np.uint8), low, width)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the inner products, a row per query, whatever the size of the components.

        Cells hold integers, so that their edges are inclusive.  Cells are multiplied in single precision; the bounds
        are wider by more than single and double precision can lose.  Where even doubles overflow, nothing is bounded.
        """
        dims = len(self.low)
        half = (self.width - 1) / 2
        with np.errstate(over="ignore", invalid="ignore"):
            steps = (queries * self.width).astype(np.float32)
            centre = (queries @ (self.low + half))[:, None] + steps @ self.cells.T.astype(np.float32)
            lost = (dims + 8) * (2.0**-22 * CELLS * self.width + 2.0**-50 * np.abs(self.low))
            slack = (np.abs(queries) @ (half + lost))[:, None]
            lower, upper = centre - slack, centre + slack
        lower, upper = np.where(np.isnan(lower), LEAST, lower), np.where(np.isnan(upper), MOST, upper)
        return np.clip(lower, LEAST, MOST), np.clip(upper, LEAST, MOST)


def open_pairs(query_ids: np.ndarray, ids: np.ndarray, lower: np.ndarray, upper: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and vector of each pair of a block whose upper bound reaches the query's kth lower bound in the block."""
    others = query_ids[:, None] != ids[None, :]
    kth = np.full((len(query_ids), 1), -np.inf)
    if len(ids) > k:
        kth[:, 0] = np.partition(np.where(others, lower, -np.inf), len(ids) - k, axis=1)[:, len(ids) - k]
    return np.nonzero(others & (upper >= kth))


def whole_vectors(vectors: DataFrame, is_query: Column, scale: int) -> DataFrame:
    """``row, vec_id, v, q``: the usable vectors as integers, each with a number of its own; written, so numbers stay."""
    clean = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"), scale))
    rows = clean.select(F.col("vec_id").cast("long").alias("vec_id"), integer_components(F.col("embedding"), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    return materialise(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", "q"))


def without_beaten_copies(whole: DataFrame, k: int) -> DataFrame:
    """The vectors that can be among the k best of some query.

    Equal vectors have equal scores, and ties go to the smaller id, so a vector is beaten wherever it may appear by its
    copies under k + 1 smaller ids (one of them may be the query's own), and a repeated row by k earlier ones.  Both
    limits are applied before the shuffles too, so that the copies of one vector never meet in one task.
    """
    repeated = Window.partitionBy("v", "vec_id").orderBy("row")
    copies = Window.partitionBy("v").orderBy("vec_id")
    fewer = whole.select("row", "vec_id", "v").withColumn("n", F.row_number().over(repeated)).filter(F.col("n") <= k)
    return fewer.withColumn("n", F.dense_rank().over(copies)).filter(F.col("n") <= k + 1).drop("n")


def blocks_of(size: int):
    """A reader of Arrow batches of ``row, vec_id, v``: (dim, rows, ids, matrix) of up to ``size`` vectors of one length."""

    def read(batches):
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            rows, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lists = batch.column(2)
            flat, edges = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            edges = edges - edges[0]
            dims = np.diff(edges)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                block = flat[edges[own][:, None] + np.arange(dim)[None, :]]
                kept = held.setdefault(dim, [])
                kept.append((rows[own], ids[own], block))
                if sum(len(r) for r, _, _ in kept) >= size:
                    yield from cut(dim, held.pop(dim))
        for dim, kept in held.items():
            yield from cut(dim, kept)

    def cut(dim, kept):
        rows, ids, block = (np.concatenate(x) for x in zip(*kept, strict=True))
        for at in range(0, len(ids), size):
            yield dim, rows[at : at + size], ids[at : at + size], block[at : at + size]

    return read


def cell_blocks(vectors: DataFrame, size: int) -> DataFrame:
    """The approximation file: ``dim, rows, ids, cells, low, width``, a block a row."""
    read = blocks_of(size)

    def run(batches):
        for dim, rows, ids, block in read(batches):
            near = Approximation.of(block)
            parts = [rows.astype("<i8"), ids.astype("<i8"), near.cells, near.low.astype("<f8"), near.width.astype("<f8")]
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], names=["dim", "rows", "ids", "cells", "low", "width"])

    return vectors.select("row", "vec_id", "v").mapInArrow(run, "dim int, rows binary, ids binary, cells binary, low binary, width binary")


def query_blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Whole vectors of the queries in blocks: ``dim, q_rows, q_ids, q_data``."""
    read = blocks_of(size)

    def run(batches):
        for dim, rows, ids, block in read(batches):
            parts = [rows.astype("<i8"), ids.astype("<i8"), block.astype("<f8")]
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], names=["dim", "q_rows", "q_ids", "q_data"])

    return vectors.filter("q").select("row", "vec_id", "v").mapInArrow(run, "dim int, q_rows binary, q_ids binary, q_data binary")


def scan(cells: DataFrame, asked: DataFrame, k: int, lane_blocks: int) -> DataFrame:
    """``q_row, query_id, row, vec_id, lower, upper`` of the pairs that the cells of a block leave open.

    A stated query set against all rows, in blocks: every block of cells has one lane, every block of queries is in all
    lanes, so that each pair of blocks meets once.  Lanes grow with the blocks.
    """
    lanes = max(1, -(-cells.count() // lane_blocks))
    left = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    right = cells.withColumn("lane", F.pmod(F.xxhash64("rows"), F.lit(lanes)).cast("int"))
    # a merge join streams and spills: the copies of the query blocks are larger than their files suggest
    pairs = left.hint("merge").join(right, ["dim", "lane"])

    def run(batches):
        for batch in batches:
            for pair in batch.to_pylist():
                dim = pair["dim"]
                rows, ids, q_rows, q_ids = (np.frombuffer(pair[c], "<i8") for c in ("rows", "ids", "q_rows", "q_ids"))
                near = Approximation(np.frombuffer(pair["cells"], np.uint8).reshape(len(ids), dim), np.frombuffer(pair["low"], "<f8"), np.frombuffer(pair["width"], "<f8"))
                lower, upper = near.bounds(np.frombuffer(pair["q_data"], "<f8").reshape(len(q_ids), dim))
                x, y = open_pairs(q_ids, ids, lower, upper, k)
                columns = [q_rows[x], q_ids[x], rows[y], ids[y], lower[x, y], upper[x, y]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["q_row", "query_id", "row", "vec_id", "lower", "upper"])

    columns = ["dim", "rows", "ids", "cells", "low", "width", "q_rows", "q_ids", "q_data"]
    return pairs.select(*columns).mapInArrow(run, "q_row long, query_id long, row long, vec_id long, lower double, upper double")


def inner_products(queries: list[np.ndarray], vectors: list[np.ndarray]) -> list[int]:
    """Exact inner products of integers held as doubles: in doubles where these cannot round, else in Python integers."""
    out = []
    for a, b in zip(queries, vectors, strict=True):
        with np.errstate(over="ignore"):
            whole = float(np.abs(a) @ np.abs(b)) < float(1 << 52)
        score = int(a @ b) if whole else sum(int(x) * int(y) for x, y in zip(a, b, strict=True))
        out.append(max(-(1 << 63), min((1 << 63) - 1, score)))
    return out


def read_exactly(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """``q_row, query_id, vec_id, score`` of pairs (``q_row, query_id, row, vec_id``), from the whole vectors."""
    vectors = whole.select("row", "v")
    queries = whole.filter("q").select(F.col("row").alias("q_row"), F.col("v").alias("w"))
    met = pairs.join(vectors, "row").join(queries, "q_row").select("q_row", "query_id", "vec_id", "v", "w")

    def run(batches):
        for batch in batches:
            a, b = ([np.asarray(x, dtype=np.float64) for x in batch.column(i).to_pylist()] for i in (4, 3))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(inner_products(a, b), pa.int64())], names=["q_row", "query_id", "vec_id", "score"])

    return met.mapInArrow(run, "q_row long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, block_rows: int = 2048, query_rows: int = 512, lane_blocks: int = 4) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k largest integer inner products of each query row with all other rows.

    ``vectors`` has ``vec_id`` and ``embedding``; further columns are left out.  Vectors that are null or hold null or
    non-finite components (or components whose scaled value is beyond a double), and null ids, take no part.  Vectors
    of different length are never compared; two empty vectors score 0.  Rows of one id are each other's own row; each
    of them has results of its own.
    Components of any size are multiplied exactly; a score beyond a long is held at its end, and such ties go to the
    smaller id like all others.

    The best 2 k of a query by upper bound are read first; then only what their kth score leaves open.
    """
    whole = whole_vectors(vectors, is_query, scale)
    cells = materialise(cell_blocks(without_beaten_copies(whole, k), block_rows))
    asked = materialise(query_blocks(whole, query_rows))
    found = materialise(scan(cells, asked, k, lane_blocks))
    by_query = Window.partitionBy("q_row")
    lowest = found.select("q_row", "lower").withColumn("place", F.row_number().over(by_query.orderBy(F.col("lower").desc())))
    kth = lowest.filter(F.col("place") <= k).groupBy("q_row").agg(F.when(F.count(F.lit(1)) == k, F.min("lower")).alias("kth"))
    left = found.join(kth, "q_row").filter(F.col("upper") >= F.coalesce("kth", F.lit(LEAST)))
    turn = F.row_number().over(by_query.orderBy(F.col("upper").desc(), "vec_id", "row"))
    left = materialise(left.select("q_row", "query_id", "row", "vec_id", "upper", turn.alias("turn")))
    first = materialise(read_exactly(left.filter(F.col("turn") <= 2 * k), whole))
    ranked = by_query.orderBy(F.col("score").desc(), "vec_id")
    sure = first.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") == k).select("q_row", F.col("score").cast("double").alias("sure"))
    rest = left.filter(F.col("turn") > 2 * k).join(sure, "q_row", "left").filter(F.col("upper") >= F.coalesce("sure", F.lit(LEAST)))
    scored = first.unionByName(read_exactly(rest.select("q_row", "query_id", "row", "vec_id"), whole))
    return scored.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
