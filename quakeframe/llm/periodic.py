"""Periodic runs of words, by an online sparse dynamic program over the diagonals of a text against itself.

A run of period q is a diagonal of lag q: the words from its q-th on equal the words q before them.  At each word the
program looks up its earlier occurrences; each adds one to the match length of its lag if that lag was active at the
word before, lags that no occurrence carries on end there, and one that ends long enough is a run at once.

Looking at all earlier occurrences of a word is quadratic where words are frequent.  A run of four periods has more
than 2 q matches on its diagonal, so a lag between l / 2 and l (l a power of two) is looked up by the last l words
together, not by one.  Inside a run the nearest earlier occurrence of those l words is exactly q back: a nearer one
would give the stretch a second period, and by the periodicity lemma a divisor of q would be a period of the whole
run, which is then not its smallest.  So one nearest occurrence a power of two stands for all, the work is
n log n in a text of n words, and nothing is lost.  Groups of l words have names made by doubling, and only those that
occur twice in their text are kept from one power to the next.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeframe.llm.common import WORD, extended, slices

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Names(dict):
    """Numbers for words in order of first sight, from ``first`` on."""

    def __init__(self, first: int):
        super().__init__()
        self.first = first

    def __missing__(self, word):
        self[word] = name = self.first + len(self)
        return name


def earlier_occurrences(words: list[list[bytes]], base: int, power: int):
    """(places, lags, l) for every place of the joined texts whose last l words occur a lag before it, l / 2 < lag <= l.

    ``base`` is the least l; it takes all lags from 1 to itself.  Places of a text never meet those of another: names
    of words are drawn anew for each text.
    """
    total = sum(map(len, words))
    name, first = np.empty(total, dtype=np.int64), 0
    for own in words:
        seen = Names(first)
        name[first : first + len(own)] = np.fromiter(map(seen.__getitem__, own), dtype=np.int64, count=len(own))
        first += len(own)
    start = np.repeat(np.cumsum([0, *map(len, words)])[:-1], [len(w) for w in words]) if total else np.zeros(0, dtype=np.int64)
    longest, size, places = max(map(len, words), default=0), 1, np.arange(total)
    while True:
        order = np.argsort(name[places], kind="stable")
        ranked, named = places[order], name[places[order]]
        same = np.zeros(len(ranked) + 1, dtype=bool)
        same[1:-1] = named[1:] == named[:-1]
        if size >= base:
            lags = np.diff(ranked, prepend=-1)
            on = same[:-1] & (lags <= size) & ((lags > size // 2) | (size == base))
            yield ranked[on], lags[on], size
        if size >= base and power * size >= longest:
            return
        # only what occurs twice can be half of something longer that does
        twice = same[:-1] | same[1:]
        group = np.cumsum(~same[:-1])
        name = np.full(total, -1)
        name[ranked[twice]] = group[twice]
        places = np.sort(ranked[twice])
        places = places[places - size >= start[places]]
        places = places[name[places - size] >= 0]
        if not len(places):
            return
        joined = name[places - size] * (total + 1) + name[places]
        name = np.full(total, -1)
        name[places] = joined
        size *= 2


def diagonals(places: list[int], lags: list[int], sizes: list[int]):
    """(last place, lag, matches) of every diagonal at the moment it ends; the lists are in order of places."""
    active: dict[int, int] = {}  # lag -> matches on its diagonal up to ``at``
    at, i, count = -2, 0, len(places)
    while i < count or active:
        place, first = (places[i] if i < count else -1), i
        while i < count and places[i] == place:
            i += 1
        carried = active if place == at + 1 else {}
        # a lag that begins has just seen a whole group of words match
        grown = {lags[k]: carried.get(lags[k], sizes[k] - 1) + 1 for k in range(first, i)}
        for lag, matches in active.items():
            if lag not in grown or lag not in carried:
                yield at, lag, matches
        active, at = grown, place


def runs_of(words: list[list[bytes]], least: int = 6, power: int = 4) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, by start and period."""
    if power < 3:
        raise ValueError("power must be 3 or more")
    base = 1
    while all(max(least - q, (power - 1) * q) >= 2 * base for q in range(1, 2 * base + 1)):
        base *= 2
    found = [(places, lags, np.full(len(places), size)) for places, lags, size in earlier_occurrences(words, base, power)]
    places, lags, sizes = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 3
    order = np.argsort(places, kind="stable")
    edges = np.cumsum([0, *map(len, words)]).tolist()
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for last, lag, matches in diagonals(places[order].tolist(), lags[order].tolist(), sizes[order].tolist()):
        if matches + lag >= max(least, power * lag):
            own = bisect_right(edges, last) - 1
            out[own].append((last - matches - lag + 1 - edges[own], matches + lag, lag))
    return [sorted(own, key=lambda r: (r[0], r[2])) for own in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 6, power: int = 4) -> DataFrame:
    """Add ``runs`` (array of start, length, period in words, by start and period) and ``collapsed`` to ``docs``.

    A run is a stretch of words with smallest period q, of ``least`` words and ``power`` periods or more, that no
    neighbouring word extends.  ``collapsed`` keeps the first period of every run and all words outside of runs,
    joined by one space.  Words are what ASCII white space parts.  Null texts and texts without words have no runs and
    an empty ``collapsed``.  Columns with those names are replaced; no row is dropped, so repeated rows have repeated
    results.  A task holds two megabytes of text at a time, or one text.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("runs", "collapsed")])

    def run(batches):
        for batch, texts in slices(batches, text):
            words = [t.split() for t in texts]
            found = runs_of(words, least, power)
            flat = [r for own in found for r in own]
            offsets = pa.array(np.cumsum([0, *map(len, found)]), type=pa.int32())
            struct = pa.StructArray.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)], names=["start", "length", "period"])
            short = pa.array([collapsed(w, r).decode() for w, r in zip(words, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, struct), short], names=[*batch.schema.names, "runs", "collapsed"])

    return docs.mapInArrow(run, extended(docs, runs=RUN, collapsed="string"))


def digest(found: DataFrame) -> DataFrame:
    """Per row of ``periodic_runs``: the number of runs, the longest one (ties: first start, then period) and digests."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    n = F.size("runs")
    return found.withColumn("__best", best).select(
        "doc_id",
        n.cast("long").alias("n_runs"),
        (-F.col("__best.start")).alias("start"),
        F.col("__best.length").alias("length"),
        (-F.col("__best.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("__best.length") / -F.col("__best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(n > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(doc_id: Column, text: Column) -> Column:
    """The text whose words repeat where the digest of the id says so; other texts as they are.

    Of h = crc32 of the decimal id, if h % 10 is 0, each word i >= a becomes word a + (i - a) % p, where
    g = h div 10, a = g % n and p = 1 + (n - a) div (3 + g % 8).  A null id leaves the text alone.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, g = F.size(words), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    period = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    bent = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(bent, " ")).otherwise(text)
