"""Quality, sharding and SentencePiece against versions that share no code with them."""

import hashlib
import math
import struct
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quakeframe.llm import queries, sentencepiece_codec, sharding

SF = "/root/testdata/sf0.001"


# --- quality


def plain_statistics(text):
    """The twelve statistics by loops over the bytes."""
    data = text.encode()
    n = Counter(data)
    of = lambda chars: sum(n[ord(c)] for c in chars)
    share = lambda part, whole: math.log((part + 0.5) / (whole + 20))
    upper = sum(n[b] for b in range(65, 91))
    wide = sum(n[b] for b in range(128, 256))
    letters = upper + sum(n[b] for b in range(97, 123)) + wide
    words = data.split()
    n.pop(32, None)
    return [
        math.log(1 + len(data)), share(upper, letters), share(of("0123456789"), len(data)), share(of("#$%&*|<>{}[]=~^\\/_@+"), len(data)), share(of("!?"), len(data)),
        share(of("."), len(words)), share(of(",;:"), len(words)), share(wide, len(data)), math.log((1 + letters) / (1 + len(words))),
        math.log((len(set(words)) + 1) / (len(words) + 1)) / math.log(len(words) + 3), math.log(1 + len(words) / (data.count(b"\n") + 1)), share(max(n.values(), default=0), len(data)),
    ]


def test_quality_scores_are_density_ratios(spark):
    """Means, covariances and determinants by numpy over the rows; no Cholesky factor, no moments."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["quality"] in (0, 1) and r["doc_id"] in texts]
    x = {i: np.array(plain_statistics(t)) for i, t in texts.items()}
    fit = [(x[i], q) for i, q in labels if zlib.crc32(str(i).encode()) % 5]
    classes = {c: np.array([v for v, q in fit if q == c]) for c in (0, 1)}
    within = sum(len(v) * np.cov(v.T, bias=True) for v in classes.values()) / len(fit)
    k, ridge, pool = within.shape[0], 0.02, 0.1
    scale = np.diag(1 / np.sqrt(np.diag(within)))

    def log_density(v, own):
        weight = pool + (1 - pool) * k / (k + len(own))
        cov = (1 - ridge) * scale @ ((1 - weight) * np.cov(own.T, bias=True) + weight * within) @ scale + ridge * np.eye(k)
        away = scale @ (v - own.mean(axis=0))
        return -0.5 * (away @ np.linalg.solve(cov, away) + np.linalg.slogdet(cov)[1])

    prior = math.log((len(classes[1]) + 1) / (len(classes[0]) + 1))
    got = {r["doc_id"]: r["score"] for r in queries.op2_quality_classifier(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, v in x.items():
        odds = prior + log_density(v, classes[1]) - log_density(v, classes[0])
        assert abs(got[i] - 1 / (1 + math.exp(-min(max(odds, -500), 500)))) < 1e-6


# --- sharding


def test_shards_are_the_plain_ranking_cut(spark):
    got = [r.asDict() for r in queries.op8_hilbert_sharding(spark, "/root/testdata/sf0.01").collect()]
    digest = lambda r: hashlib.md5(f"{r['doc_id']}/{r['text_crc32']}".encode()).hexdigest()
    ranked = sorted(got, key=lambda r: (r["cell"], digest(r), r["doc_id"], r["text_crc32"]))
    each, more = divmod(len(ranked), 16)
    place = [(s, slot) for s in range(16) for slot in range(each + (s < more))]
    assert [(r["shard"], r["slot"]) for r in ranked] == place


def test_shards_prune_by_every_dimension(spark, tmp_path):
    """Statistics of the written files leave out most shards for one language, one source or a range of sizes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["doc_id"])
    placed = sharding.shard_documents(docs).select("doc_id", "size", "shard", "slot").join(docs.select("doc_id", "lang", "source"), "doc_id")
    sharding.write_shards(placed, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == docs.count()
    rows, stats = defaultdict(list), defaultdict(lambda: defaultdict(list))
    for file in (tmp_path / "shards").rglob("*.parquet"):
        shard = int(Path(file).parent.name.split("=")[1])
        table = pq.ParquetFile(file)
        slots = table.read(["slot"]).column(0).to_pylist()
        assert slots == sorted(slots)
        rows[shard] += slots
        for g in range(table.num_row_groups):
            for c in range(table.metadata.num_columns):
                column = table.metadata.row_group(g).column(c)
                if column.statistics is not None and column.statistics.has_min_max:
                    stats[shard][column.path_in_schema].append((column.statistics.min, column.statistics.max))
    assert sorted(rows) == list(range(16)) and all(sorted(v) == list(range(len(v))) for v in rows.values())
    touched = lambda c, v: sum(any(lo <= v <= hi for lo, hi in stats[s][c]) for s in range(16))
    for column, most in (("lang", 0.7), ("source", 0.7)):
        values = [r[0] for r in docs.select(column).where(F.col(column).isNotNull()).distinct().collect()]
        assert np.mean([touched(column, v) for v in values]) <= 16 * most, column
    assert touched("size", docs.select(F.max(F.octet_length("text")) + 1).first()[0]) <= 8


# --- SentencePiece

RULES = {b"ab": b"X", b"abc": b"YY", "é".encode(): b"e", b"\t": b" ", "ﬁ".encode(): b"fi", "Ａ".encode(): b"A", "½".encode(): "1⁄2".encode(), b"zz": b"", "　".encode(): b" "}
ALPHABET = ["𓀀", "a", "b", "c", "ab", "abc", "é", "\t", "ﬁ", "Ａ", "½", "z", "zz", "　", " ", "  ", "the", "ing", "日本", "🙂", ".", "▁", "\n"]


def varint(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)


def message(number, data):
    return varint(number << 3 | 2) + varint(len(data)) + data


def fields_of(model):
    return [(field, value, model[start:end]) for field, _, value, start, end in sentencepiece_codec._fields(model)]


def model_with_map(dummy, squeeze, fallback, path):
    """The public model with its normaliser replaced: a compiled map of ``RULES`` and the given switches.

    Without ``fallback`` pieces of single bytes are unused, so that unknown characters have the unknown id.
    """
    table = sentencepiece_codec.CharacterMap.build(RULES)
    units = np.zeros(-(-len(table.units) // 256) * 256, dtype="<u4")  # the library reads whole blocks of 256 units
    units[: len(table.units)] = table.units
    compiled = struct.pack("<I", units.nbytes) + units.tobytes() + table.block
    out = b""
    for field, value, whole in fields_of(Path(queries.piece_model()).read_bytes()):
        if field == 1 and not fallback and (3, 6) in [(f, v) for f, v, _ in fields_of(value)]:
            out += message(1, b"".join(w for f, _, w in fields_of(value) if f != 3) + bytes([24, 5]))
        elif field == 2 and not fallback:
            out += message(2, value + varint(35 << 3) + bytes([0]))
        elif field != 3:
            out += whole
    spec = message(1, b"own") + message(2, compiled) + bytes([24, dummy, 32, squeeze, 40, 1])
    path.write_bytes(out + message(3, spec))
    return str(path)


@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize("dummy", [0, 1])
@pytest.mark.parametrize("squeeze", [0, 1])
def test_longest_prefix_walk_equals_the_library(dummy, squeeze, fallback, tmp_path):
    path = model_with_map(dummy, squeeze, fallback, tmp_path / "own.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(path)
    assert len(own.normalise.map.units)
    rng = np.random.default_rng(dummy * 2 + squeeze)
    texts = ["", " ", "\t　 ", "abcab", "abd zz", "zz", " zz a", "𓀀"] + ["".join(rng.choice(ALPHABET, rng.integers(1, 60))) for _ in range(400)]
    unknown = 0
    for text in texts:
        data = text.encode()
        ids, spans = own.encode(data)
        assert list(ids) == library.encode(text), text
        unknown += int((np.asarray(ids) == own.unknown).sum())
        assert all(0 <= a <= b <= len(data) for a, b in spans) and (np.diff(spans[:, 0]) >= 0).all()
        for piece, (begin, _) in zip(library.encode(text, return_type="proto").pieces, spans, strict=True):
            if not piece.piece.startswith("<0x"):
                assert piece.begin == begin, text
    assert fallback or unknown > 0
