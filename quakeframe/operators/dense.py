"""Greedy pairing of picks of busy stations: bounded blocks of time, settled in rounds.

A block pairs its own picks of ``a`` in their order.  Its neighbours' claims on picks of ``b`` that both can reach
come from the round before; a claim counts against later picks only.  When a round changes no claim, every pick of ``a``
has its first choice among those that no earlier one holds, which is the greedy result and the only such state.

A chain of claims moves one block a round, so blocks double from round to round while none holds more than ``FULLEST``
picks: a chain through n blocks of the first width takes about log2(n) rounds, and beyond that one for each ``FULLEST`` picks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quakeframe.operators.runs import materialised

#: Picks that a block may hold for blocks to double once more; a first block holds what lies within four reaches.
FULLEST = 1 << 16


def pair_up(rows: DataFrame, keys: list[str], reach: float, following: bool = False, fullest: int = FULLEST, on_round: Callable[[int], None] | None = None) -> DataFrame:
    """``keys, side, a_v, a_w, b_v, b_w`` of ``keys, is_a, o, v, w``; ``v`` is finite.

    ``a`` is taken by (o, v, w).  Each takes the nearest free ``b`` within ``reach``, inclusive, ties to the earlier;
    ``following``: the first free ``b``, by (v, w), that comes after it by less than ``reach``.  ``on_round`` is told
    the number of each round before it runs.
    """
    slack = 1.001 * reach  # a pick of b is within reach of two blocks at most
    seen = lambda c, width: F.sequence(F.floor((F.col(c) - slack) / width), F.floor((F.col(c) + slack) / width))
    at = lambda c, width: F.floor(F.col(c) / width)
    rest = ["o", "v", "w", F.lit(None).cast("double").alias("b"), F.lit(None).cast("int").alias("rank")]
    own = [*keys, "stretch"]
    rows = materialised(rows.select(*keys, "is_a", "o", "v", "w"))

    def blocks(width: float) -> DataFrame:
        a = rows.filter("is_a").select(*keys, at("v", width).alias("stretch"), F.lit(0).alias("kind"), *rest)
        return a.unionByName(rows.filter("NOT is_a").select(*keys, F.explode(seen("v", width)).alias("stretch"), F.lit(1).alias("kind"), *rest))

    def claims(out: DataFrame, width: float) -> DataFrame:
        """Pairs whose ``b`` another block of this width sees as well, for that block."""
        far = out.filter("side = 'pair'").withColumn("to", F.explode(seen("b_v", width))).filter(F.col("to") != at("a_v", width))
        return far.select(*keys, F.col("to").alias("stretch"), F.lit(2).alias("kind"), "o", F.col("a_v").alias("v"), F.col("a_w").alias("w"), F.col("b_v").alias("b"), "rank")

    def most(counts: DataFrame, times: int) -> int:
        return counts.groupBy(*keys, F.floor(F.col("stretch") / times)).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0

    base = blocks(4.0 * reach)
    fields = StructType([*base.select(*own).schema.fields, *StructType.fromDDL("side string, o double, a_v double, a_w double, b_v double, b_w double, rank int").fields])

    def settling(width: float) -> Callable[[pa.Table], pa.Table]:
        def run(t: pa.Table) -> pa.Table:
            return settle(t, width)

        return run

    def settle(t: pa.Table, width: float) -> pa.Table:
        col = {c: t.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("o", "v", "w", "b", "rank")}
        null = {c: np.asarray(t.column(c).is_null()) for c in ("o", "w")}
        kind, here = t.column("kind").to_numpy(), t.column("stretch")[0].as_py()
        bs = np.flatnonzero(kind == 1)
        bs = bs[np.lexsort((col["w"][bs], ~null["w"][bs], col["v"][bs]))]
        takers = np.flatnonzero(kind != 1)
        takers = takers[np.lexsort((col["w"][takers], ~null["w"][takers], col["v"][takers], col["o"][takers], ~null["o"][takers]))]
        taken, held = _greedy(col["v"][bs], col["v"][takers], kind[takers] == 2, col["b"][takers], col["rank"][takers], reach, following)
        mine = kind[takers] == 0
        free = ~held & (np.floor(col["v"][bs] / width) == here)
        left, right = np.concatenate([takers[mine], np.full(free.sum(), -1)]), np.concatenate([np.where(taken[mine] >= 0, bs[taken[mine]] if len(bs) else -1, -1), bs[free]])
        first = np.searchsorted(col["v"][bs], col["v"][bs], "left")
        ranks = np.concatenate([taken[mine] - (first[taken[mine]] if len(bs) else 0), np.zeros(free.sum(), dtype=np.int64)])
        pick = lambda c, i: pa.array(col[c][i] if len(i) else np.zeros(0), pa.float64(), mask=(i < 0) | (null[c][i] if c in null else False))
        sides = np.where(left < 0, "b", np.where(right < 0, "a", "pair"))
        named = t.select(own).take(pa.array(np.zeros(len(left), dtype=np.int64)))
        return pa.Table.from_arrays(
            [*named.columns, pa.array(sides.tolist(), pa.string()), pick("o", left), pick("v", left), pick("w", left), pick("v", right), pick("w", right), pa.array(ranks, pa.int32(), mask=right < 0)],
            names=fields.names,
        )

    counts = materialised(base.groupBy(*own).agg(F.count(F.lit(1)).alias("n")))
    times, used, turn, doubling = 1, None, 0, True
    while True:
        if on_round:
            on_round(turn)
        width = 4.0 * reach * times
        given = blocks(width) if used is None else blocks(width).unionByName(used)
        out = materialised(given.groupBy(*own).applyInArrow(settling(width), fields))
        now = claims(out, width)
        if used is not None:  # what came in fewer or more times than it went out
            now, seen_as = now.withColumn("n", F.lit(1)), used.withColumn("n", F.lit(-1))
            now = now.unionByName(seen_as).groupBy(*used.columns).agg(F.sum("n").alias("n")).filter("n <> 0")
        if now.isEmpty():
            return out.select(*keys, "side", "a_v", "a_w", "b_v", "b_w")
        turn, doubling = turn + 1, doubling and most(counts, 2 * times) <= fullest
        times *= 2 if doubling else 1
        used = claims(out, 4.0 * reach * times)


def _greedy(b: np.ndarray, a: np.ndarray, foreign: np.ndarray, claimed: np.ndarray, rank: np.ndarray, reach: float, following: bool) -> tuple[np.ndarray, np.ndarray]:
    """The place in ``b`` (sorted) that each of ``a`` takes in turn, or -1, and which of ``b`` are held at the end.

    Foreign ones take nothing here but hold the ``rank``-th of the values equal to ``claimed``.
    """
    n = len(b)
    values, up, down = b.tolist(), list(range(n + 1)), list(range(n + 1))  # links to the next free place, down shifted by one
    first = np.searchsorted(b, b, "left").tolist()
    starts = np.searchsorted(b, a, "right" if following else "left").tolist()
    places = np.searchsorted(b, claimed, "left")
    held, taken = np.zeros(n, dtype=bool), np.full(len(a), -1)

    def end(links: list[int], i: int) -> int:
        root = i
        while links[root] != root:
            root = links[root]
        while links[i] != root:
            links[i], i = root, links[i]
        return root

    for k, x in enumerate(a.tolist()):
        if foreign[k]:
            i = int(places[k] + rank[k])
        else:
            i, r = -1, end(up, starts[k])
            if following:
                if r < n and values[r] - x < reach:
                    i = r
            else:
                left = end(down, starts[k]) - 1
                if r < n and abs(values[r] - x) <= reach:
                    i = r
                if left >= 0 and abs(values[left] - x) <= (abs(values[r] - x) if i >= 0 else reach):
                    i = left
                    # values so close that their distances round alike: the earliest
                    while (left := end(down, first[i]) - 1) >= 0 and abs(values[left] - x) == abs(values[i] - x):
                        i = left
            taken[k] = i
        if i >= 0 and not held[i]:
            held[i] = True
            up[i], down[i + 1] = i + 1, i
    return taken, held
