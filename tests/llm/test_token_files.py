"""Files of directly addressable codes: round trips, random access, the library's own ids, hard rows."""

import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quakeframe.llm import queries, token_files
from tests.llm.test_operators import HARD, SCHEMA, SF

FILE = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")


@pytest.mark.parametrize("top", [1, 200, 256, 60000, 1 << 24, (1 << 32) - 1])
def test_codes_are_read_at_any_place(top):
    draw = np.random.default_rng(top)
    for n in (0, 1, 511, 512, 513, 5000):
        values = (draw.random(n) ** 3 * top).astype(np.uint32)
        codes = token_files.Codes(token_files.pack_codes(values))
        assert len(codes) == n
        places = draw.integers(0, max(n, 1), 300) if n else np.zeros(0, dtype=int)
        assert codes.at(places).tolist() == values[places].tolist()
        for start, end in [(0, n), (n // 3, n // 2), (n, n), *np.sort(draw.integers(0, n + 1, (20, 2)), axis=1).tolist()]:
            assert codes.span(start, end).tolist() == values[start:end].tolist()
    with pytest.raises(ValueError):
        token_files.Codes(b"else....")
    with pytest.raises(IndexError):
        token_files.Codes(token_files.pack_codes(np.arange(3))).at([3])


def test_pieces_have_the_ids_of_whole_texts(library):
    own = token_files.Encoder(FILE)
    odd = ["", " ", "a  b", "a \n\n b\t\tc  ", "don't  we'll 'S", "x!\x1c y", "x᠎ y", "　全 角　", "é  b", "1 23a 4", "<|endoftext|> a<|endoftext|>", "\r\n\r\n x", " \x85 y", "🙂 🙂​ z", "﻿ a", "a\x0b\x0cb"]
    draw = np.random.default_rng(5)
    odd += ["".join(draw.choice(list(" \n\ta1é!'s 　\x1f "), 40)) for _ in range(400)]
    odd += ["l'eau  -don't_x9 d'Été,ñandú.Łódź ñł! a.b,c", "w" * 100 + " x", "ab'sc 'sab' re're"]
    for text, ids in zip(odd, own.encode(odd), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert not any(len(p) > 64 for p in own.known)


def test_ids_column(spark, library):
    hard = spark.createDataFrame(HARD, SCHEMA).withColumn("ids", F.lit("clash"))
    got = token_files.encode_ids(hard, FILE)
    assert got.columns == hard.columns
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in got.collect()) == sorted((str(r[0]), ids_of(library, r[1]).tobytes()) for r in HARD)


def test_query_equals_the_library(spark, library):
    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    want, start = [], 0
    for r in rows:
        ids = ids_of(library, r["text"])
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = queries.op11_token_ids(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == want


def test_hard_rows_small_segments_and_places(spark, library):
    hard = spark.createDataFrame(HARD, SCHEMA).withColumn("ids", F.lit("clash")).withColumn("start", F.lit(7))
    path = token_files.write_store(hard, FILE, tokens_per_segment=50)
    got = sorted(token_files.read_documents(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted([r[0] for r in HARD], key=lambda i: (i is not None, i))
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in got) == sorted((str(r[0]), ids_of(library, r[1]).tobytes()) for r in HARD)
    stream = np.concatenate([np.frombuffer(r["ids"], dtype="<u4") for r in got])
    places = [0, 1, 1, len(stream) - 1, len(stream), -1, None, *range(5, len(stream), 997)]
    read = token_files.tokens_at(token_files.read_store(spark, path), spark.createDataFrame([(p,) for p in places], "place long"), grain=1000)
    assert sorted(map(tuple, read.collect())) == sorted((p, int(stream[p])) for p in {p for p in places if p is not None and 0 <= p < len(stream)})


def test_empty_table_and_one_id_for_all(spark):
    docs = spark.createDataFrame([(1, "a b")] * 40 + [(1, f"text {i}") for i in range(40)], "doc_id long, text string")
    path = token_files.write_store(docs, FILE, end_id=None)
    got = token_files.read_documents(spark, path)
    assert got.count() == 80 and got.agg(F.sum("n_tokens")).head()[0] == got.agg(F.max(F.col("start") + F.col("n_tokens"))).head()[0]
    path = token_files.write_store(docs.filter(F.lit(False)), FILE)
    assert token_files.read_documents(spark, path).count() == 0
