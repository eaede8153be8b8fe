"""Token ids in files of directly addressable codes.

Every id is split into chunks of eight bits.  Level 0 holds the lowest chunk of all ids, level 1 the next chunk of
those ids that have one, and so on.  A bitmap beside each level marks the ids that go on in the next level; its rank
directory holds the ones before every 512 bits.  The place of an id in the next level is its rank in the bitmap, so
any id is read by as many lookups as it has chunks and nothing else is decoded.

A store is a Parquet table of segments: ``part`` and ``first`` say where a segment stands, ``doc_ids`` and ``sizes``
name its documents in order, ``codes`` holds their ids as one block of codes.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quakeframe.llm.common import extended, shared_folder, slices

MAGIC = b"DAC1"
#: Bits and bytes of the bitmap between two entries of the rank directory.
BLOCK_BITS, BLOCK_BYTES = 512, 64
STORE = "part int, first long, doc_ids array<bigint>, sizes array<bigint>, codes binary"

# --- the codes


def pack_codes(values: np.ndarray) -> bytes:
    """The block of codes of an array of unsigned 32-bit ids."""
    rest, levels = np.asarray(values, dtype=np.uint32), []
    while len(rest):
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % BLOCK_BYTES, dtype=np.uint8)])
        ones = np.bitwise_count(bits.reshape(-1, BLOCK_BYTES)).sum(axis=1, dtype=np.uint64)
        levels.append((rest.astype(np.uint8), bits, np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint64)))
        rest = rest[more] >> np.uint32(8)
    head = MAGIC + struct.pack("<I", len(levels)) + b"".join(struct.pack("<Q", len(chunks)) for chunks, _, _ in levels)
    return head + b"".join(x.tobytes() for chunks, bits, ranks in levels for x in (ranks, bits, chunks))


class Codes:
    """Reads ids at any place of a block of codes."""

    def __init__(self, block: bytes):
        if block[:4] != MAGIC:
            raise ValueError("not a block of codes")
        (count,) = struct.unpack_from("<I", block, 4)
        lengths = struct.unpack_from(f"<{count}Q", block, 8)
        at, self.levels = 8 + 8 * count, []
        for n in lengths:
            blocks = -(-n // BLOCK_BITS)
            ranks = np.frombuffer(block, dtype="<u8", count=blocks, offset=at)
            bits = np.frombuffer(block, dtype=np.uint8, count=blocks * BLOCK_BYTES, offset=at + 8 * blocks)
            at += 8 * blocks + len(bits)
            self.levels.append((np.frombuffer(block, dtype=np.uint8, count=n, offset=at), bits, ranks))
            at += n

    def __len__(self) -> int:
        return len(self.levels[0][0]) if self.levels else 0

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Ones before each place: the directory's entry, whole bytes of the place's own 512 bits, and part of a byte."""
        block, byte = places >> 9, (places >> 3) & 63
        own = np.bitwise_count(bits.reshape(-1, BLOCK_BYTES)[block])
        whole = np.where(np.arange(BLOCK_BYTES) < byte[:, None], own, 0).sum(axis=1, dtype=np.int64)
        part = np.bitwise_count(bits[places >> 3] & ((1 << (places & 7)) - 1).astype(np.uint8))
        return ranks[block].astype(np.int64) + whole + part

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at ``places``, in that order."""
        places = np.asarray(places, dtype=np.int64)
        if len(places) and not 0 <= places.min() <= places.max() < len(self):
            raise IndexError("place outside the block")
        out, open_ids = np.zeros(len(places), dtype=np.uint32), np.arange(len(places))
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            out[open_ids] |= chunks[places].astype(np.uint32) << np.uint32(8 * level)
            on = (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 > 0
            open_ids, places = open_ids[on], self._rank(bits, ranks, places[on])
            if not len(places):
                break
        return out

    def span(self, start: int, end: int) -> np.ndarray:
        """The ids of places ``start`` to ``end``: one rank lookup a level, then consecutive chunks."""
        out = np.zeros(max(0, end - start), dtype=np.uint32)
        open_ids = np.arange(len(out))
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            if not len(open_ids):
                break
            out[open_ids] |= chunks[start:end].astype(np.uint32) << np.uint32(8 * level)
            on = np.unpackbits(bits[start >> 3 : (end + 7) >> 3], bitorder="little")[start & 7 :][: end - start] > 0
            open_ids = open_ids[on]
            start = int(self._rank(bits, ranks, np.array([start]))[0])
            end = start + len(open_ids)
        return out


# --- encoding texts

#: Pieces end where the tokenizer's pattern always begins a new word: at white space that follows something else, and
#: where a plain letter meets ASCII that is none.
PIECE = re.compile(r" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]++(?=[\x00-@\[-`{-\x7f]|\Z)|\s*\S+|\s+")
#: Characters that Python and the tokenizer may class differently; a text with one is encoded whole.
DOUBTFUL = "\x1c\x1d\x1e\x1f\x85\u180e\u200b\ufeff"
#: Pieces that a worker remembers at most before it starts anew, and the longest that it remembers.
REMEMBERED, SHORT = 1 << 20, 64


class Encoder:
    """Encodes texts piece by piece, asking the library once for a piece."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.whole = [*DOUBTFUL, *[t.content for t in self.library.get_added_tokens_decoder().values()]]
        self.known: dict[str, bytes] = {}
        gap = self.library.encode("\n", add_special_tokens=False).ids
        self.gap = gap if len(gap) == 1 else None

    def alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def ask(self, pieces: list[str]) -> list[bytes]:
        """The library's ids of every piece.  Pieces without line ends go in one text, parted by line ends.

        A line end between two pieces is a word of its own to the pattern, unless white space other than one space
        follows it; such pieces go alone.
        """
        lined = [p for p in pieces if "\n" not in p and not (p[1:2] if p[0] == " " else p[0]).isspace() and p != " "] if self.gap else []
        ids = np.array(self.library.encode_batch_fast(["\n".join(lined)], add_special_tokens=False)[0].ids if lined else [], dtype="<u4")
        edges = np.flatnonzero(ids == self.gap[0]).tolist() if lined else []
        if len(edges) + 1 != len(lined):
            return self.alone(pieces)
        raw = ids.tobytes()
        found = {p: raw[4 * a + 4 : 4 * b] for p, a, b in zip(lined, [-1, *edges], [*edges, len(ids)], strict=True)}
        rest = [p for p in pieces if p not in found]
        found |= dict(zip(rest, self.alone(rest), strict=True))
        return [found[p] for p in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text as little-endian unsigned 32-bit integers."""
        whole = {i: t for i, t in enumerate(texts) if any(w in t for w in self.whole)}
        pieces = [[] if i in whole else PIECE.findall(t) for i, t in enumerate(texts)]
        parts = [list(map(self.known.get, p)) for p in pieces]
        new: dict[str, list[tuple[list, int]]] = {}
        for own, found in zip(pieces, parts, strict=True):
            at = -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                new.setdefault(own[at], []).append((found, at))
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
        for (piece, places), ids in zip(new.items(), self.ask(list(new)), strict=True):
            for found, at in places:
                found[at] = ids
            if len(piece) <= SHORT:
                self.known[piece] = ids
        out = [b"".join(found) for found in parts]
        for i, ids in zip(whole, self.alone(list(whole.values())), strict=True):
            out[i] = ids
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and tokenizer file."""
    return Encoder(path)


def encoded(batches, tokenizer: str, text: str, end_id: int | None):
    """(part of a batch, the ids of its texts as bytes)."""
    own, last = encoder(tokenizer), b"" if end_id is None else struct.pack("<I", end_id)
    for batch, texts in slices(batches, text):
        yield batch, [ids + last for ids in own.encode([t.decode() for t in texts])]


def encode_ids(docs: DataFrame, tokenizer: str, text: str = "text", end_id: int | None = 2) -> DataFrame:
    """Add ``ids binary``: the ids of the whole text as little-endian unsigned 32-bit integers, then ``end_id``.

    ``tokenizer`` is a file of the ``tokenizers`` library, whose pattern splits words as byte-level BPE does; special
    tokens are not added, but one written out in a text has its own id, as the library has it.  A null text counts as
    empty.  A column ``ids`` is replaced; no row is dropped, so repeated rows have repeated results.
    """
    docs = docs.select(*[c for c in docs.columns if c != "ids"])

    def run(batches):
        for batch, ids in encoded(batches, tokenizer, text, end_id):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, type=pa.binary())], names=[*batch.schema.names, "ids"])

    return docs.mapInArrow(run, extended(docs, ids="binary"))


# --- files


def write_store(docs: DataFrame, tokenizer: str, path: str | None = None, text: str = "text", end_id: int | None = 2, tokens_per_segment: int = 1 << 20) -> str:
    """Encode the texts of ``docs``, write them in ascending ``doc_id`` order, and return the store's path.

    Texts, which are smaller than their ids, are dealt by ranges of (doc_id, digest of the text, row number), so an id
    that a third of all rows carry, or a third of all rows that are equal, spread over ranges; null ids come first.  Row
    numbers follow the order in which ``docs`` is read: pass a table, or the result of ``materialise``.  A segment ends
    with the document that fills it, so a document is never split and a task holds one segment at a time.  Null texts
    count as empty; an empty input makes a store without segments; further columns of ``docs`` are left out.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    order = ["doc_id", "tie", "row"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches):
        part, first, held, docs = TaskContext.get().partitionId(), 0, 0, []

        def segment():
            sizes = [len(ids) // 4 for _, ids in docs]
            block = pack_codes(np.frombuffer(b"".join(ids for _, ids in docs), dtype="<u4"))
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "first": pa.array([first], pa.int64()), "doc_ids": pa.array([[i for i, _ in docs]], pa.list_(pa.int64())),
                 "sizes": pa.array([sizes], pa.list_(pa.int64())), "codes": pa.array([block], pa.binary())}
            )

        for batch, ids in encoded(batches, tokenizer, "text", end_id):
            for row in zip(batch.column(0).to_pylist(), ids, strict=True):
                docs.append(row)
                held += len(row[1]) // 4
                if held >= tokens_per_segment:
                    yield segment()
                    first, held, docs = first + held, 0, []
        if docs:
            yield segment()

    dealt.mapInArrow(run, STORE).write.parquet(path)
    return path


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The segments of a store, with ``start``: the ids of all segments before.

    Parts are as many as tasks wrote the store, so their running total is a small table and is broadcast.
    """
    segments = spark.read.schema(STORE).parquet(path)
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n)
    parts = segments.groupBy("part").agg(F.sum(size).alias("held"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("held").over(earlier), F.lit(0).cast("long")).alias("offset"))
    return segments.join(F.broadcast(offsets), "part").withColumn("start", F.col("offset") + F.col("first")).drop("offset")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids`` (binary) of every stored document."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                codes = Codes(row["codes"])
                edges = np.concatenate([[0], np.cumsum(np.array(row["sizes"], dtype=np.int64))])
                ids = codes.span(0, len(codes)).astype("<u4").tobytes()
                spans = list(pairwise(edges.tolist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(edges[:-1] + row["start"]), pa.array(np.diff(edges)), pa.array([ids[4 * a : 4 * b] for a, b in spans], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return read_store(spark, path).select("start", "doc_ids", "sizes", "codes").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def tokens_at(store: DataFrame, places: DataFrame, place: str | Column = "place", grain: int = 1 << 16) -> DataFrame:
    """``place`` and ``id`` for every distinct place (number of a token in the whole store) of ``places``.

    ``store`` is what ``read_store`` gives.  Places meet segments by the grains of ``grain`` tokens that a segment
    touches, so the work per task is bounded by a grain whatever places are asked for.  Places that are null or
    outside the store have no row.
    """
    end = F.aggregate("sizes", F.col("start"), lambda a, n: a + n)
    grains = store.filter(end > F.col("start")).select("start", end.alias("end"), "codes", F.explode(F.sequence(F.floor(F.col("start") / grain), F.floor((end - 1) / grain))).alias("grain"))
    asked = places.select((F.col(place) if isinstance(place, str) else place).cast("long").alias("place")).filter("place >= 0").distinct()
    lists = asked.groupBy(F.floor(F.col("place") / grain).alias("grain")).agg(F.collect_list("place").alias("asked"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                wanted = np.array([p for p in row["asked"] if row["start"] <= p < row["end"]], dtype=np.int64)
                ids = Codes(row["codes"]).at(wanted - row["start"])
                yield pa.RecordBatch.from_arrays([pa.array(wanted), pa.array(ids.astype(np.int64))], names=["place", "id"])

    return grains.join(lists, "grain").select("start", "end", "codes", "asked").mapInArrow(run, "place long, id long")
