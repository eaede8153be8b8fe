"""Media columns for telephony audio: mu-law, A-law and ADPCM, stored as WAV bytes in a binary column.

Companded samples expand by lookup tables built from the decoding rule.  ADPCM blocks are decoded step by step with
numpy across all blocks of a batch.  Decoded audio is resampled by a rational factor and stored as 16-bit PCM, as it is
or lifted: a reversible form of all its samples that compresses better.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeframe.llm.common import extended, materialise, slices

RATE = 8000
UNIT = 192
#: WAVE format numbers: 16-bit PCM, A-law, mu-law, IMA ADPCM.
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17
FORMATS = {"pcm": PCM, "alaw": ALAW, "mulaw": MULAW, "adpcm": ADPCM}


def mulaw_table() -> np.ndarray:
    """16-bit values of all mu-law bytes: bits inverted; sign, three exponent bits, four mantissa bits, bias 132."""
    byte = ~np.arange(256) & 255
    size = (((byte & 15) << 3) + 132 << (byte >> 4 & 7)) - 132
    return np.where(byte & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit values of all A-law bytes: even bits inverted; the first segment is linear."""
    byte = np.arange(256) ^ 0x55
    exponent, mantissa = byte >> 4 & 7, (byte & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, mantissa + 264 << np.maximum(exponent - 1, 0))
    return np.where(byte & 128, size, -size).astype(np.int16)


def step_table() -> np.ndarray:
    """The 89 IMA ADPCM step sizes.  Fixed values."""
    text = """7 8 9 10 11 12 13 14 16 17 19 21 23 25 28 31 34 37 41 45 50 55 60 66 73 80 88 97 107 118 130 143 157 173 190
    209 230 253 279 307 337 371 408 449 494 544 598 658 724 796 876 963 1060 1166 1282 1411 1552 1707 1878 2066 2272 2499
    2749 3024 3327 3660 4026 4428 4871 5358 5894 6484 7132 7845 8630 9493 10442 11487 12635 13899 15289 16818 18500 20350
    22385 24623 27086 29794 32767"""
    return np.array(text.split(), dtype=np.int32)


MULAW_PCM, ALAW_PCM, STEPS = mulaw_table(), alaw_table(), step_table()
#: Index change by the three magnitude bits of a code.  Fixed values.
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def decode_adpcm(data: np.ndarray, block: int = UNIT) -> np.ndarray:
    """IMA ADPCM blocks to 16-bit samples, a row per block: a 4-byte header (sample, index), then two codes a byte.

    All blocks move together, one code at a time; a header index beyond the table counts as its last entry.
    """
    blocks = data.reshape(-1, block)
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((1 + 2 * (block - 4), len(blocks)), dtype=np.int16)
    out[0] = value
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(2 * (block - 4)):
        code = columns[i // 2] & 15 if i % 2 == 0 else columns[i // 2] >> 4
        size = (code & 7).astype(np.int32)
        step = STEPS[index]
        move = (step >> 3) + np.where(size & 4, step, 0) + np.where(size & 2, step >> 1, 0) + np.where(size & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + INDEX_MOVES[size], 0, 88)
        out[i + 1] = value
    return out.T


def resample(samples: np.ndarray, up: int = 2, down: int = 1) -> np.ndarray:
    """``up / down`` times the rate by linear interpolation, in integers (rounded down); beyond the end the last sample holds."""
    n = -(-len(samples) * up // down)
    at = np.arange(n, dtype=np.int64) * down
    first, part = at // up, at % up
    wide = samples.astype(np.int64)
    held = wide[np.minimum(first + 1, len(wide) - 1)] if n else wide
    return ((wide[first] * (up - part) + held * part) // up).astype(np.int16)


def write_wav(payload: bytes, kind: int, rate: int = RATE, block: int = 1, name: bytes = b"data") -> bytes:
    """A RIFF file: format chunk, then the data as given, in a chunk of that name; one channel."""
    bits = 16 if kind == PCM else 4 if kind == ADPCM else 8
    extra = b"" if kind == PCM else struct.pack("<HH", 2, 2 * (block - 4) + 1) if kind == ADPCM else struct.pack("<H", 0)
    head = struct.pack("<HHIIHH", kind, 1, rate, rate * bits // 8, block, bits) + extra
    chunks = b"fmt " + struct.pack("<I", len(head)) + head + name + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wav(data: bytes, name: bytes = b"data") -> tuple[int, int, int, bytes]:
    """Format number, rate, block size and data (the chunk ``name``) of a RIFF file; chunks may come in any order."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, kind, rate, block, payload = 12, 0, 0, 0, b""
    while at + 8 <= len(data):
        (size,) = struct.unpack_from("<I", data, at + 4)
        if data[at : at + 4] == b"fmt ":
            kind, _, rate, _, block = struct.unpack_from("<HHIIH", data, at + 8)
        elif data[at : at + 4] == name:
            payload = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return kind, rate, block, payload


def neighbours(even: np.ndarray, n: int) -> np.ndarray:
    """The means, rounded down, of the even samples beside each of ``n`` odd ones; beyond the end the last holds."""
    wide = even.astype(np.int32)
    return (wide[:n] + np.append(wide[1:], wide[-1:])[:n]) >> 1


def lift(samples: np.ndarray) -> np.ndarray:
    """All even 16-bit samples, then the difference of each odd one from the mean beside it, modulo 2^16.

    The prediction step of the 5/3 wavelet.  ``unlift`` gives back any samples; smooth ones leave small differences.
    """
    even, odd = samples[::2], samples[1::2]
    return np.concatenate([even, (odd - neighbours(even, len(odd))).astype(np.int16)])


def unlift(lifted: np.ndarray) -> np.ndarray:
    out = np.empty(len(lifted), dtype=np.int16)
    half = -(-len(lifted) // 2)
    out[::2] = lifted[:half]
    out[1::2] = (lifted[half:] + neighbours(lifted[:half], len(lifted) - half)).astype(np.int16)
    return out


def restore_pcm(data: bytes) -> bytes:
    """The PCM file of one that was stored lifted; any other file as it is."""
    kind, rate, block, lifted = read_wav(data, b"lift")
    return write_wav(unlift(np.frombuffer(lifted, dtype="<i2")).astype("<i2").tobytes(), kind, rate, block) if lifted else data


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """``data`` with spaces up to a positive multiple of ``unit``."""
    return data + b" " * (max(unit, -(-len(data) // unit) * unit) - len(data))


def decode_wav(media: bytes) -> tuple[np.ndarray, int]:
    """16-bit samples and the rate of a WAV of any of the four formats."""
    kind, rate, block, payload = read_wav(media)
    raw = np.frombuffer(payload, dtype=np.uint8)
    if kind == MULAW:
        return MULAW_PCM[raw], rate
    if kind == ALAW:
        return ALAW_PCM[raw], rate
    if kind == ADPCM:
        return decode_adpcm(raw[: len(raw) // block * block], block).reshape(-1), rate
    return raw[: len(raw) // 2 * 2].view("<i2"), rate


def encode_media(docs: DataFrame, format: str = "mulaw", text: str = "text", out: str = "media") -> DataFrame:
    """Add ``n_bytes`` and a binary column with the padded text as the samples of a WAV; null counts as empty."""
    kept = docs.select(*[c for c in docs.columns if c not in (out, "n_bytes")])
    schema = extended(kept, **{"n_bytes": "long", out: "binary"})
    kind = FORMATS[format]

    def run(batches):
        for batch, texts in slices(batches, text):
            files = pa.array([write_wav(pad(t), kind, RATE, UNIT if kind == ADPCM else 2 if kind == PCM else 1) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(t) for t in texts], pa.int64()), files], names=[*batch.schema.names, "n_bytes", out])

    return kept.mapInArrow(run, schema)


def pcm_file(samples: np.ndarray, rate: int, up: int, down: int, lifted: bool = False) -> bytes:
    wide = resample(samples, up, down)
    lifted = lifted and len(wide) > 0
    return write_wav((lift(wide) if lifted else wide).astype("<i2").tobytes(), PCM, rate * up // down, 2, b"lift" if lifted else b"data")


def store_pcm(media: DataFrame, column: str = "media", out: str = "pcm", up: int = 2, down: int = 1, lifted: bool = False) -> DataFrame:
    """Add a binary column with each file decoded, resampled to ``up / down`` times its rate and stored as 16-bit PCM; null stays null.

    With ``lifted`` the samples stand in reversible form in a chunk ``lift`` instead of ``data``; ``restore_pcm`` gives back the file.
    """
    kept = media.select(*[c for c in media.columns if c != out])
    schema = extended(kept, **{out: "binary"})

    def one(data: bytes | None) -> bytes | None:
        if data is None:
            return None
        return pcm_file(*decode_wav(data), up, down, lifted)

    def run(batches):
        for batch, _ in slices(batches, column, 1 << 20):
            files = batch.column(batch.schema.get_field_index(column)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([one(f) for f in files], pa.binary())], names=[*batch.schema.names, out])

    return kept.mapInArrow(run, schema)


def level(samples: np.ndarray) -> tuple[int, int]:
    """Energy (sum of squares) and sign changes, in integers."""
    wide = samples.astype(np.int64)
    return int((wide * wide).sum()), int(((wide[1:] < 0) != (wide[:-1] < 0)).sum())


def describe_media(media: DataFrame, column: str = "media", pcm: str = "pcm") -> DataFrame:
    """Read the stored bytes back: ``doc_id, n_bytes``, digests and features of each file and of its stored PCM.

    ``feature`` lists energy and sign changes of the payload expanded as mu-law, as A-law and as ADPCM blocks, and of
    the resampled audio as it was stored in ``pcm`` (a lifted file is restored first), with that file's rate and the
    checksum of its samples.  All depend on the payload alone.  A null file has nulls but for ``doc_id`` and ``n_bytes``.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes", "pcm_sha256"]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"

    def rows(files: list[bytes | None], sounds: list[bytes | None]):
        payloads = [read_wav(f)[3] if f is not None else b"" for f in files]
        counts = np.array([len(p) // UNIT for p in payloads])
        whole = np.frombuffer(b"".join(p[: len(p) // UNIT * UNIT] for p in payloads), dtype=np.uint8)
        decoded = decode_adpcm(whole)
        ends = np.cumsum(counts)
        for file, sound, payload, start, end in zip(files, sounds, payloads, ends - counts, ends, strict=True):
            if file is None:
                yield (None,) * len(names)
                continue
            raw, sound = np.frombuffer(payload, dtype=np.uint8), restore_pcm(sound)
            _, rate, _, samples = read_wav(sound)
            marks = [*level(MULAW_PCM[raw]), *level(ALAW_PCM[raw]), *level(decoded[start:end].reshape(-1)), *level(np.frombuffer(samples, dtype="<i2")), rate, zlib.crc32(samples)]
            yield (
                len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), " ".join(map(str, marks)),
                len(sound), hashlib.sha256(sound).hexdigest(),
            )

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def run(batches):
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            start = held = 0
            for i, size in enumerate(sizes.tolist()):  # what is made of a part is bounded by about 2 MB of input
                held += size
                if held > 1 << 21 or i == len(sizes) - 1:
                    part = batch.slice(start, i + 1 - start)
                    columns = list(zip(*rows(part.column(2).to_pylist(), part.column(3).to_pylist()), strict=True))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", *names])
                    start, held = i + 1, 0

    return media.select(F.col("doc_id").cast("long"), "n_bytes", column, pcm).mapInArrow(run, schema)
