"""MinHash near-dedup by a chosen-path set similarity join.

Equal shingle sets are one class first.  Classes then branch down independent trees: a node hashes itself to two
coordinates of the MinHash signature, and its members go to the child of their value in each.  Two sets of
similarity s stay together in a child with probability s for each coordinate, so the expected number of shared
nodes does not die out at 0.75, while unlike sets part quickly.  Nodes without company end; small ones are compared
exhaustively by signature; large ones branch on.  Several trees raise recall.

A large node full of near copies would branch for long, since near copies go the same ways.  So a few consensus
signatures of the node absorb what differs from them in few coordinates: absorbed members leave the node, and every other member that could be alike to one of them joins the same star.  Differing coordinates are a
distance, so that no pair of the node which the signatures leave open is lost by this, whatever the consensus is.

What a leaf finds alike it reports as stars, never as all pairs.  The stars' components are clusters that may link.
A cluster's full shingle sets meet in blocks, where every pair that the signatures leave open is confirmed exactly,
unless a chain of confirmed links already joins it.  Of a cluster of several blocks first the blocks are confirmed,
each with the same few leading members; then only members outside the largest confirmed component meet the other blocks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeframe.llm.common import materialise, running_totals, strings
from quakeframe.llm.components import connected_components
from quakeframe.llm.shingles import scramble, shingle_sets


@dataclass(frozen=True)
class Plan:
    """Parameters of the join.

    A pair whose signatures agree in three quarters of the coordinates shares a leaf of one tree with probability
    0.89 at least (the branching of two coordinates at 0.75 survives any depth), hence of one of five trees with
    0.99998.  ``slack`` is how far a signature's estimate may lie below the threshold: ``deviations`` standard
    deviations of its coordinates, or all the way where ``deviations`` is infinite, so that every pair of a leaf is
    confirmed on full sets.  ``small`` bounds a leaf.  A node above it takes up to ``centres`` consensus signatures
    from about ``sample`` members.  Each absorbs up to a distance of ``reach`` coordinates, or up to ``far`` where
    that leaves few members around it.  ``block_docs`` and ``block_shingles`` bound a block of the confirmation,
    beside one text that may be longer.
    """

    width: int = 5
    percent: int = 75
    coordinates: int = 64
    trees: int = 5
    small: int = 1024
    depth: int = 8
    deviations: float = 4.0
    reach: int = 10
    far: int = 28
    sample: int = 64
    centres: int = 8
    block_docs: int = 512
    block_shingles: int = 1 << 20

    @property
    def slack(self) -> float:
        p = self.percent / 100
        return min(self.deviations * (p * (1 - p) / self.coordinates) ** 0.5, p)

    @property
    def floor(self) -> int:
        """Equal coordinates from which on a pair is looked at."""
        return int((self.percent / 100 - self.slack) * self.coordinates)

    @property
    def unit(self) -> int:
        """The least a text weighs in a block, so that a block holds ``block_docs`` texts at most."""
        return max(1, self.block_shingles // self.block_docs)


def factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = scramble(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n:] >> np.uint64(32)).astype(np.uint32)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """MinHash values (a row per non-empty set) by multiply-shift hashes of the upper half of each shingle."""
    a, b = factors(n)
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), n), dtype=np.uint32)
    for i in range(n):
        out[:, i] = np.minimum.reduceat(flat * a[i] + b[i], starts)
    return out


def describe(docs: DataFrame, plan: Plan) -> DataFrame:
    """``doc_id, n_shingles, print, sig``: size, 128-bit fingerprint and signature of each set; null for empty sets."""

    def run(batches):
        for batch in batches:
            sizes, prints, sigs = [], [], []
            held: list[np.ndarray] = []

            def flush():
                if held:
                    sigs.extend(row.tobytes() for row in signatures(held, plan.coordinates))
                    held.clear()

            for own in shingle_sets(strings(batch.column(1)), plan.width):
                sizes.append(len(own))
                prints.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                if len(own):
                    held.append(own)
                    if sum(map(len, held)) > 1 << 16 or len(held) > 256:
                        flush()
                else:
                    flush()
                    sigs.append(None)
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "print", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, print binary, sig binary")


def matrix(column, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, n)


def children(node: np.ndarray, sig: np.ndarray) -> list[np.ndarray]:
    """The two children of each row's node: coordinates chosen by the node alone, values by the row."""
    n = np.uint64(sig.shape[1])
    pick = scramble(node)
    one = pick % n
    two = (one + np.uint64(1) + (pick >> np.uint64(32)) % (n - np.uint64(1))) % n
    rows = np.arange(len(node))
    return [scramble(scramble(node + c + np.uint64(1)) ^ sig[rows, c.astype(np.int64)]) for c in (one, two)]


def roots(reps: DataFrame, plan: Plan) -> DataFrame:
    """``node, rep`` of the first level of all trees."""

    def run(batches):
        for batch in batches:
            sig = matrix(batch.column(1), plan.coordinates)
            nodes = []
            for tree in range(plan.trees):
                start = scramble(np.full(1, 1 + tree, dtype=np.uint64))
                nodes += children(np.repeat(start, len(sig)), sig) if len(sig) else [np.zeros(0, np.uint64)] * 2
            ids = np.tile(batch.column(0).to_numpy(), len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes).view(np.int64)), pa.array(ids)], names=["node", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "node long, rep long")


def branch(rows: DataFrame, plan: Plan) -> DataFrame:
    """``node, rep, sig`` of the children of large nodes."""

    def run(batches):
        for batch in batches:
            sig = matrix(batch.column(2), plan.coordinates)
            for nodes in children(batch.column(0).to_numpy().view(np.uint64), sig):
                yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), batch.column(1), batch.column(2)], names=["node", "rep", "sig"])

    return rows.select("node", "rep", "sig").mapInArrow(run, "node long, rep long, sig binary")


def in_blocks(rows: DataFrame, plan: Plan) -> DataFrame:
    """Large nodes at the last level: every pair of a node's blocks becomes a small node of its own, so all is compared."""
    half = plan.small // 2
    blocks = F.greatest(F.ceil(F.col("n") / half).cast("int"), F.lit(1))
    own = F.pmod(F.xxhash64(F.col("rep")), blocks)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rows.withColumns({"blocks": blocks, "own": own}).select("node", "rep", "sig", "own", other.alias("other"))
    return dealt.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "rep", "sig")


def consensus(sig: np.ndarray, plan: Plan) -> np.ndarray:
    """Signatures that many of a node's sampled members are near to, each with the distance up to which it absorbs.

    A signature has the most frequent values of a group by coordinate.  Its distance is the one that absorbs most
    members while those merely around it stay fewer than a quarter of the absorbed; ``reach`` where none does.
    """
    n = plan.coordinates
    found: list[np.ndarray] = []
    while len(sig) and len(found) < plan.centres:
        near = alike(sig, plan, slice(0, len(sig))) >= plan.floor
        group = sig[near[near.sum(axis=1).argmax()]]
        middle = np.empty(n, dtype=np.uint32)
        for c in range(n):
            values, counts = np.unique(group[:, c], return_counts=True)
            middle[c] = values[counts.argmax()]
        away = n - (sig == middle).sum(axis=1)
        taken = {r: int((away <= r).sum()) for r in range(plan.reach, max(plan.reach, min(plan.far, plan.floor)) + 1)}
        fair = {r: t for r, t in taken.items() if 4 * ((away <= n - plan.floor + r).sum() - t) <= t}
        reach = max(fair, key=lambda r: (fair[r], -r), default=plan.reach)
        if taken[reach] < max(2, plan.sample // 8):
            break
        found.append(np.append(middle, np.uint32(reach)))
        sig = sig[away > reach]
    return np.array(found, dtype=np.uint32).reshape(-1, n + 1)


def absorb(large: DataFrame, plan: Plan) -> DataFrame:
    """``node, rep, sig, near, around``: the centre that absorbs a member (or -1), and all those it may have to do with.

    A member goes to the nearest centre that reaches it.  A pair that is looked at differs in ``coordinates - floor``
    places at most, so what may pair with an absorbed member lies within that plus the reach of the centre.  The
    sample of a node decides how much is absorbed, never which pairs are looked at.
    """
    n = plan.coordinates
    drawn = F.pmod(F.xxhash64("node", "rep"), F.lit(1 << 30)) * F.col("n") < F.lit(plan.sample << 30)
    lists = large.filter(drawn).groupBy("node").agg(F.collect_list("sig").alias("m"))

    def choose(batches):
        for batch in batches:
            middles = [consensus(np.frombuffer(b"".join(sorted(m)), np.uint32).reshape(-1, n), plan).tobytes() for m in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(middles, pa.binary())], names=["node", "middles"])

    middles = lists.mapInArrow(choose, "node long, middles binary").filter(F.length("middles") > 0)

    def run(batches):
        for batch in batches:
            sig = matrix(batch.column(2), n)
            near = np.full(len(sig), -1, dtype=np.int32)
            around: list[list[int]] = [[]] * len(sig)
            rows_of: dict[bytes, list[int]] = {}
            for i, m in enumerate(batch.column(3).to_pylist()):
                if m:
                    rows_of.setdefault(m, []).append(i)
            for m, rows in rows_of.items():
                table = np.frombuffer(m, np.uint32).reshape(-1, n + 1)
                reach = table[:, n].astype(np.int64)
                away = np.stack([n - (sig[rows] == middle).sum(axis=1) for middle in table[:, :n]], axis=1)
                best = np.where(away <= reach, away, n + 1).argmin(axis=1)
                taken = (away <= reach).any(axis=1)
                near[rows] = np.where(taken, best, -1)
                for i, row in zip(rows, away <= n - plan.floor + reach, strict=True):
                    if row.any():
                        around[i] = np.flatnonzero(row).tolist()
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(near), pa.array(around, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "rep", "sig", "near", "around"])

    joined = large.join(middles, "node", "left").select("node", "rep", "sig", "middles")
    return joined.mapInArrow(run, "node long, rep long, sig binary, near int, around array<int>")


def absorbed_stars(absorbed: DataFrame) -> DataFrame:
    """``a, b``: each centre's members, and those around it, with the least id that it has absorbed."""
    hubs = absorbed.filter("near >= 0").groupBy("node", "near").agg(F.min("rep").alias("hub"))
    touched = absorbed.select("node", "rep", F.explode("around").alias("near"))
    return touched.join(hubs, ["node", "near"]).filter("rep != hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))


def leaves(reps: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame | None]:
    """``node, rep, sig`` of all nodes that are compared exhaustively, and the stars (``a, b``) of what was absorbed."""
    rows = roots(reps, plan)
    done = found = None
    for level in range(plan.depth + 1):
        counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = rows.join(counts, "node")
        if level == 0:
            shared = shared.join(reps.select("rep", "sig"), "rep")
        shared = materialise(shared.select("node", "n", "rep", "sig"))
        now = shared.filter(F.col("n") <= plan.small).select("node", "rep", "sig")
        done = now if done is None else done.unionByName(now)
        large = shared.filter(F.col("n") > plan.small)
        if large.isEmpty():
            break
        absorbed = materialise(absorb(large, plan))
        stars_ = absorbed_stars(absorbed)
        found = stars_ if found is None else found.unionByName(stars_)
        left = absorbed.filter("near < 0").select("node", "rep", "sig")
        left = left.join(left.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "node")
        done = done.unionByName(left.filter(F.col("n") <= plan.small).select("node", "rep", "sig"))
        large = left.filter(F.col("n") > plan.small)
        if level == plan.depth:
            done = done.unionByName(in_blocks(large, plan))
        else:
            rows = branch(large, plan)
    return done, found


def alike(sig: np.ndarray, plan: Plan, rows: slice) -> np.ndarray:
    """Equal coordinates of some rows of a node with all of its rows."""
    same = np.zeros((rows.stop - rows.start, len(sig)), dtype=np.uint8)
    for c in np.ascontiguousarray(sig.T):
        same += c[rows, None] == c[None, :]
    return same


def stars(ids: np.ndarray, sig: np.ndarray, plan: Plan) -> np.ndarray:
    """(member, centre) of each group of a node that is connected by pairs whose estimate allows the threshold."""
    n = len(ids)
    step = max(1, (1 << 20) // n)
    near = np.concatenate([alike(sig, plan, slice(i, min(n, i + step))) >= plan.floor for i in range(0, n, step)])
    busy = np.flatnonzero(near.sum(axis=1) > 1)
    if not len(busy):
        return np.zeros((0, 2), dtype=np.int64)
    near, ids = near[np.ix_(busy, busy)], ids[busy]
    label = ids.copy()
    while True:
        new = np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (new == label).all():
            break
        label = new
    member = label != ids
    return np.stack([ids[member], label[member]], axis=1)


def candidates(members: DataFrame, plan: Plan) -> DataFrame:
    """``a, b``: stars of all leaves; a leaf's rows meet in one list, which ``small`` bounds."""
    lists = members.groupBy("node").agg(F.collect_list(F.struct("rep", "sig")).alias("m"))

    def run(batches):
        for batch in batches:
            column = batch.column(0)
            values, edges = column.values, column.offsets.to_numpy()
            ids = values.field("rep").to_numpy()
            out = [stars(ids[i:j], matrix(values.field("sig").slice(i, j - i), plan.coordinates), plan) for i, j in zip(edges[:-1], edges[1:], strict=True)]
            pairs = np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return lists.select("m").mapInArrow(run, "a long, b long")


def confirmed(ids: np.ndarray, labels: np.ndarray, asks: np.ndarray, sets: list[np.ndarray], plan: Plan) -> list[tuple[int, int]]:
    """Links that join the confirmed components of one bundle; texts of one label are joined already.

    Only pairs in which one text asks are looked at.
    """
    sig = signatures(sets, plan.coordinates)
    sizes = np.array([len(s) for s in sets])
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found, step = [], max(1, (1 << 20) // len(ids))
    asking = np.flatnonzero(asks)
    _, first, group = np.unique(labels, return_index=True, return_inverse=True)
    for i, g in enumerate(group.tolist()):
        parent[i] = int(first[g])
    for start in range(0, len(asking), step):
        rows = asking[start : start + step]
        same = np.zeros((len(rows), len(ids)), dtype=np.uint8)
        for c in np.ascontiguousarray(sig.T):
            same += c[rows, None] == c[None, :]
        x, y = np.nonzero(same >= plan.floor)
        keep = (labels[rows[x]] != labels[y]) & ((rows[x] < y) | ~asks[y])
        keep &= 100 * np.minimum(sizes[rows[x]], sizes[y]) >= plan.percent * np.maximum(sizes[rows[x]], sizes[y])
        x, y = x[keep], y[keep]
        order = np.argsort(-same[x, y].astype(np.int16), kind="stable")
        for i, j in zip(rows[x[order]].tolist(), y[order].tolist(), strict=True):
            a, b = root(i), root(j)
            if a != b:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both and 100 * both >= plan.percent * (int(sizes[i]) + int(sizes[j]) - both):
                    parent[max(a, b)] = min(a, b)
                    found.append((int(ids[i]), int(ids[j])))
    return found


def bundled(rows: DataFrame, by: list[str], plan: Plan) -> DataFrame:
    """``a, b``: confirmed links within each bundle of ``rep, label, asks, shingles`` that has the same ``by``."""
    lists = rows.groupBy(*by).agg(F.collect_list(F.struct("rep", "label", "asks", "shingles")).alias("m"))

    def run(batches):
        for batch in batches:
            column = batch.column(0)
            values, edges = column.values, column.offsets.to_numpy()
            ids, labels, data = values.field("rep").to_numpy(), values.field("label").to_numpy(), values.field("shingles")
            asks = values.field("asks").to_numpy(zero_copy_only=False)
            out = []
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                sets = [np.frombuffer(x, np.uint64) for x in data.slice(start, end - start).to_pylist()]
                out += confirmed(ids[start:end], labels[start:end], asks[start:end], sets, plan)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return lists.select("m").mapInArrow(run, "a long, b long")


def in_turn(rows: DataFrame, plan: Plan) -> DataFrame:
    """Add ``before``: the weight of a cluster's earlier texts, by fingerprint; it deals them to blocks of bounded weight."""
    rows = rows.withColumns({"order": F.lower(F.hex("print")), "weight": F.greatest(F.col("n_shingles"), F.lit(plan.unit))})
    return running_totals(rows, ["component"], "order", ["id"], F.col("weight")).drop("order")


def placed_in_blocks(clusters: DataFrame, classes: DataFrame, plan: Plan) -> tuple[DataFrame, bool]:
    """``id, component, print, n_shingles, block, blocks, leads`` of all clustered classes, and whether any cluster has several blocks.

    A block's texts weigh ``block_shingles`` and the last of them at most.  The first texts of a cluster lead it.
    """
    sized = clusters.join(classes.select(F.col("rep").alias("id"), "n_shingles", "print"), "id")
    heavy = sized.groupBy("component").agg(F.sum(F.greatest(F.col("n_shingles"), F.lit(plan.unit))).alias("total"))
    sized = materialise(sized.join(heavy, "component"))
    one = sized.filter(F.col("total") <= plan.block_shingles)
    small = one.select("id", "component", "print", "n_shingles", F.lit(0).cast("long").alias("block"), F.lit(1).cast("long").alias("blocks"), F.lit(False).alias("leads"))
    several = sized.filter(F.col("total") > plan.block_shingles)
    if several.isEmpty():
        return small, False
    block = F.floor(F.col("before") / plan.block_shingles)
    last = F.floor(F.col("total") / plan.block_shingles) + 1
    large = in_turn(several, plan).select("id", "component", "print", "n_shingles", block.alias("block"), last.alias("blocks"), (F.col("before") < 4 * plan.unit).alias("leads"))
    return small.unionByName(large), True


def shingles_of(docs: DataFrame, wanted: DataFrame, plan: Plan) -> DataFrame:
    """The full sets of ``wanted`` (``id, print`` and more), with ``rep`` for ``id`` and ``shingles``; once for repeated rows."""
    rest = [c for c in wanted.columns if c not in ("id", "print")]
    # a merge join at every size: the rows wanted grow with the input
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted.hint("merge"), "id").select("id", "text", "print", *rest)
    fields = {f.name: f.dataType.simpleString() for f in wanted.schema.fields}
    schema = ", ".join(["rep long", "print binary", *[f"{c} {fields[c]}" for c in rest], "shingles binary"])

    def run(batches):
        for batch in batches:
            keep, sets = [], []
            for own, print_ in zip(shingle_sets(strings(batch.column(1)), plan.width), batch.column(2).to_pylist(), strict=True):
                keep.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() == print_)  # not another text of the same id
                if keep[-1]:
                    sets.append(own.tobytes())
            fits = pa.array(keep, pa.bool_())
            columns = [batch.column(i).filter(fits) for i in (0, *range(2, 3 + len(rest)))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sets, pa.binary())], names=["rep", "print", *rest, "shingles"])

    return texts.mapInArrow(run, schema).dropDuplicates(["rep", "print"])


def confirm(clusters: DataFrame, classes: DataFrame, docs: DataFrame, plan: Plan) -> DataFrame:
    """``id, component``: the classes that confirmed links join, from clusters (``id, component``) of those that may be."""
    wanted, several = placed_in_blocks(clusters, classes, plan)
    sets = materialise(shingles_of(docs, wanted, plan))
    # a text is known by a number of its own: two texts of one id are compared with each other and with all others
    named = sets.withColumns({"label": F.xxhash64("rep", "print"), "asks": F.lit(True)})
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: b != F.col("block"))
    leading = named.filter(F.col("leads") & (F.col("blocks") > 1)).withColumn("block", F.explode(others))
    joined = connected_components(bundled(named.unionByName(leading), ["component", "block"], plan))
    if not several:
        return joined
    large = sets.filter(F.col("blocks") > 1).select(F.col("rep").alias("id"), "component", "print", "n_shingles", "block", "blocks")
    labelled = large.join(joined.withColumnRenamed("component", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    most = labelled.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    labelled = materialise(labelled.join(most, "component"))
    open_ = labelled.filter("label != main")
    if open_.isEmpty():
        return joined
    # what is outside a cluster's largest component meets all other blocks; the rest is joined among itself
    group = F.floor(F.col("before") / plan.block_shingles)
    asking = materialise(in_turn(open_, plan).select("component", F.col("id").alias("rep"), "print", "label", group.alias("group")))
    groups = asking.groupBy("component").agg(F.max("group").alias("last"))
    near = sets.drop("leads").join(labelled.select(F.col("id").alias("rep"), "print", "label"), ["rep", "print"]).join(groups, "component")
    answers = near.select("component", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("group"), "rep", "label", F.lit(False).alias("asks"), "shingles")
    questions = sets.join(asking.drop("component"), ["rep", "print"]).withColumn("block", F.explode(others))
    rows = answers.unionByName(questions.select("component", "block", "group", "rep", "label", F.lit(True).alias("asks"), "shingles"))
    links = materialise(bundled(rows, ["component", "block", "group"], plan))
    if links.isEmpty():
        return joined
    # the later links join components: they are followed between the components' names only
    named_a = links.join(joined.select(F.col("id").alias("a"), F.col("component").alias("x")), "a", "left")
    named_b = named_a.join(joined.select(F.col("id").alias("b"), F.col("component").alias("y")), "b", "left")
    merged = connected_components(named_b.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    merged = merged.select(F.col("id").alias("was"), F.col("component").alias("now"))
    kept = joined.join(merged, joined["component"] == merged["was"], "left").select("id", F.coalesce("now", "component").alias("component"))
    alone = merged.join(joined, merged["was"] == joined["id"], "left_anti").select(F.col("was").alias("id"), F.col("now").alias("component"))
    return kept.unionByName(alone)


def near_duplicates(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    A text's set is its distinct shingles of ``width`` words; a shorter text is one shingle; a null text, or one
    without words, has an empty set and is linked with nothing.  Rows of equal sets are one class, named by its
    smallest id; different texts of one id count as linked.  A row with a null id is not compared: its component is null
    and it is kept.  Repeated rows have the same result.
    """
    base = materialise(describe(docs, plan))
    some = base.filter(F.col("print").isNotNull() & F.col("doc_id").isNotNull())
    classes = materialise(some.groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")))
    members, absorbed = leaves(classes, plan)
    stars_ = candidates(members, plan)
    clusters = materialise(connected_components(stars_ if absorbed is None else stars_.unionByName(absorbed)))
    found = confirm(clusters, classes, docs, plan)
    placed = classes.join(found, classes["rep"] == found["id"], "left").select("print", F.coalesce("component", "rep").alias("component"))
    out = base.join(placed, "print", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
