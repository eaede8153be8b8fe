"""SentencePiece encoding and decoding with original byte spans.

The normaliser is ours: longest-prefix replacement through the model's compiled character map, recording for
every normalised byte the source byte it came from.  The library merges the normalised text into pieces; piece
lengths then project through that alignment to spans of the original text.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeframe.llm.common import extended, slices

SPACE = "▁".encode()
#: The map's replacement of a byte that is not valid UTF-8.
BROKEN = "�".encode()


def _fields(data: bytes):
    """(number, wire type, value, start, end) of each field of a protocol-buffer message."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        start = at
        key = number()
        kind = key & 7
        if kind == 0:
            value = number()
        else:
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            value = data[at : at + size]
            at += size
        yield key >> 3, kind, value, start, at


class CharacterMap:
    """The compiled map: a double-array trie of source prefixes and a block of zero-ended replacements."""

    def __init__(self, compiled: bytes):
        self.units = np.zeros(0, dtype=np.uint32)
        self.block = b""
        if compiled:
            (size,) = struct.unpack_from("<I", compiled)
            self.units = np.frombuffer(compiled, dtype="<u4", count=size // 4, offset=4)
            self.block = compiled[4 + size :]
        self.list = self.units.tolist()

    @classmethod
    def build(cls, rules: dict[bytes, bytes]) -> CharacterMap:
        """A map of given rules, in the compiled layout, for tests and for tokenizers without a compiled map."""
        block = bytearray()
        values = {}
        for source in sorted(rules):
            values[source] = len(block)
            block += rules[source] + b"\0"
        units = {0: 0}
        used = {0}
        bases: set[int] = set()  # two nodes of one base would share their children

        def place(node: int, prefix: bytes, members: list[bytes]) -> None:
            labels = sorted({m[len(prefix)] if len(m) > len(prefix) else 0 for m in members})
            base = 1
            while base in bases or any((base ^ c) in used for c in labels) or (node ^ base) >> 21:
                base += 1
            bases.add(base)
            units[node] |= (node ^ base) << 10
            if 0 in labels:
                units[node] |= 1 << 8
            for c in labels:
                used.add(base ^ c)
                units[base ^ c] = c if c else (1 << 31) | values[prefix]
            for c in labels:
                if c:
                    place(base ^ c, prefix + bytes([c]), [m for m in members if m[len(prefix) : len(prefix) + 1] == bytes([c])])

        if rules:
            place(0, b"", list(rules))
        array = np.zeros(max(units) + 1, dtype="<u4")
        for i, v in units.items():
            array[i] = v
        data = array.tobytes()
        return cls(struct.pack("<I", len(data)) + data + bytes(block))

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest source prefix at ``at``; None where no rule begins."""
        units = self.list
        if not units:
            return None
        found = None
        node = (units[0] >> 10) << ((units[0] & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or (units[node] & 0x800000FF) != data[i]:
                break
            unit = units[node]
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        end = self.block.index(b"\0", found[1])
        return found[0], self.block[found[1] : end]


class Normaliser:
    """Rewrites a text as the model's normaliser does; ``__call__`` returns the bytes and the source of each of them."""

    def __init__(self, map_: CharacterMap, dummy_prefix: bool, squeeze: bool, escape: bool):
        self.map, self.dummy, self.squeeze, self.escape = map_, dummy_prefix, squeeze, escape

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        if not len(self.map.units) and not self.squeeze and self.escape:
            return self._plain(data)
        return self._mapped(data)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """No rules: only spaces are rewritten, so the alignment is found for all bytes at once."""
        if not data:
            return b"", np.zeros(0, dtype=np.int64)
        source = np.frombuffer(data, dtype=np.uint8)
        width = np.where(source == 32, 3, 1)
        align = np.repeat(np.arange(len(source)), width)
        out = data.replace(b" ", SPACE)
        if self.dummy:
            return SPACE + out, np.concatenate([np.zeros(3, dtype=np.int64), align])
        return out, align

    def _mapped(self, data: bytes) -> tuple[bytes, np.ndarray]:
        parts: list[bytes] = []
        origins: list[tuple[int, int]] = []
        at, blank = 0, self.squeeze
        space = SPACE if self.escape else b" "

        def add(text: bytes, origin: int) -> None:
            parts.append(text)
            origins.append((origin, len(text)))

        def step(i: int) -> tuple[int, bytes]:
            hit = self.map.longest(data, i)
            if hit:
                return hit
            lead = data[i]
            size = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
            try:
                data[i : i + size].decode()
            except UnicodeDecodeError:
                size = 0
            return (size, data[i : i + size]) if size else (1, BROKEN)

        if self.squeeze:
            while at < len(data):
                size, text = step(at)
                if text != b" ":
                    break
                at += size
        if at >= len(data):
            return b"", np.zeros(0, dtype=np.int64)
        if self.dummy:
            add(space, at)
        blank = self.squeeze
        while at < len(data):
            size, text = step(at)
            if blank and self.squeeze:
                text = text.lstrip(b" ")
            if text:
                add(text.replace(b" ", space), at)
                blank = text.endswith(b" ")
            at += size
        out = b"".join(parts)
        align = np.repeat([o for o, _ in origins], [n for _, n in origins])
        if self.squeeze:
            while out.endswith(space):
                out, align = out[: -len(space)], align[: -len(space)]
        return out, align


class Codec:
    """Encodes and decodes with one model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec, rest, pieces = b"", b"", []
        for field, _, value, start, end in _fields(model):
            if field == 3:
                spec = value
            else:
                rest += model[start:end]
            if field == 1:
                pieces.append(value)
        given = {field: value for field, _, value, _, _ in _fields(spec)}
        self.normalise = Normaliser(CharacterMap(given.get(2, b"")), bool(given.get(3, 1)), bool(given.get(4, 1)), bool(given.get(5, 1)))
        bare = bytes([10, 8]) + b"identity" + bytes([24, 0, 32, 0, 40, 0])
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=rest + bytes([26, len(bare)]) + bare)
        self.width = np.ones(len(pieces), dtype=np.int64)
        for i, piece in enumerate(pieces):
            inner = {field: value for field, _, value, _, _ in _fields(piece)}
            if inner.get(3, 1) in (1, 4):
                self.width[i] = len(inner[1])
        self.unknown = self.library.unk_id()
        self.end = self.library.eos_id()

    def encode(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids without control ids, and the (begin, end) bytes of the original text that each covers."""
        normal, align = self.normalise(data)
        ids = self.merger.encode_as_numpy(normal.decode())
        if not len(ids):
            return ids, np.zeros((0, 2), dtype=np.int64)
        ends = np.cumsum(self.width[ids])
        if ends[-1] != len(normal):  # unknown pieces have no width of their own
            ends = np.array([p.end for p in self.merger.encode(normal.decode(), return_type="proto").pieces])
        edges = np.append(align, len(data))[np.concatenate([[0], ends])]
        return ids, np.stack([edges[:-1], edges[1:]], axis=1)

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec per Python worker and model file."""
    return Codec(path)


def encode_documents(docs: DataFrame, model: str, text: str = "text", add_end: bool = True, spans: bool = True) -> DataFrame:
    """Add ``ids array<int>``, ``span_begin`` and ``span_end array<int>`` (bytes of the original) to ``docs``.

    The end id covers the empty span at the text's end.  Null and empty texts have the end id alone.  Columns of
    ``docs`` with those names are replaced; no row is dropped, so repeated rows have repeated results.
    ``spans=False`` leaves the two span columns null, for callers that need ids only.
    """
    kept = [c for c in docs.columns if c not in ("ids", "span_begin", "span_end")]
    docs = docs.select(*kept)
    schema = extended(docs, ids="array<int>", span_begin="array<int>", span_end="array<int>")

    def run(batches):
        own = codec(model)
        for batch, texts in slices(batches, text):
            ids, edges, sizes = [], [], []
            for data in texts:
                found, span = own.encode(data)
                ids.append(found)
                edges.append(span)
                if add_end:
                    ids.append([own.end])
                    edges.append([[len(data), len(data)]])
                sizes.append(len(found) + add_end)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), type=pa.int32())
            flat = np.concatenate([np.zeros((0, 2), dtype=np.int64), *edges]).astype(np.int32)
            values = [np.concatenate([np.zeros(0, dtype=np.int32), *ids]).astype(np.int32), flat[:, 0], flat[:, 1]]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) if n == 0 or spans else pa.nulls(batch.num_rows, pa.list_(pa.int32())) for n, v in enumerate(values)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, "ids", "span_begin", "span_end"])

    return docs.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text that the library's ``decode`` gives for the array column ``ids``; null ids give an empty text."""
    encoded = encoded.select(*[c for c in encoded.columns if c != out])
    schema = extended(encoded, **{out: "string"})

    def run(batches):
        own = codec(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                yield one(own, whole.slice(at, 500))

    def one(own: Codec, batch):
        lists = batch.column(batch.schema.get_field_index(ids))
        flat, edges = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        texts = pa.array([own.decode(flat[a:b].tolist()) if b > a else "" for a, b in zip(edges[:-1], edges[1:], strict=True)], type=pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, out])

    return encoded.mapInArrow(run, schema)


def digest(encoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of encoded and decoded documents, by built-in functions."""
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def reference_digest(texts: list[str | None], model: str) -> list[tuple[int, str, str]]:
    """The same digests straight from the library, for tests."""
    own = sentencepiece.SentencePieceProcessor(model_file=model)
    out = []
    for text in texts:
        ids = own.encode(text or "", add_eos=True)
        out.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()))
    return out
