"""Periodic runs against all lags of brute force, and hard rows."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quakeframe.llm import periodic, queries
from tests.llm.test_operators import HARD, SCHEMA, SF, WORDS


def plain_runs(words, least=6, power=4):
    """Every maximal stretch of every lag whose smallest period is that lag."""
    n, out = len(words), []
    for q in range(1, n // power + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j > i and j - i + q >= max(least, power * q):
                stretch = words[i - q : j]
                if not any(stretch[p:] == stretch[: len(stretch) - p] for p in range(1, q)):
                    out.append((i - q, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = WORDS.findall(text or "")
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    tail = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *tail, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("least,power", [(6, 4), (1, 3), (9, 5), (40, 4)])
def test_runs_equal_brute_force(least, power):
    draw = random.Random(least)
    for _ in range(600):
        docs = []
        for _ in range(draw.randint(0, 4)):
            n, k = draw.randint(0, 90), draw.choice([1, 2, 2, 3, 9])
            words = [b"%d" % draw.randrange(k) for _ in range(n)]
            if draw.random() < 0.6 and n > 8:
                p, a = draw.randint(1, 12), draw.randrange(n - 1)
                words = words[:a] + [words[a + (i - a) % min(p, n - a)] for i in range(a, n)]
                for _ in range(draw.randint(0, 2)):
                    words[draw.randrange(n)] = b"z"
            docs.append(words)
        assert periodic.runs_of(docs, least, power) == [plain_runs(w, least, power) for w in docs]


def test_long_texts_of_few_words_stay_cheap():
    assert periodic.runs_of([[b"a"] * 100_000]) == [[(0, 100_000, 1)]]
    runs = periodic.runs_of([([b"a"] * 101 + [b"b"]) * 500])[0]
    assert len(runs) == 501 and runs[1] == (0, 51_000, 102)
    with pytest.raises(ValueError):
        periodic.runs_of([[b"a"]], 6, 2)


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r["text"] or "") < 20_000]
    got = {r["doc_id"]: tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert sum(r[1] > 0 for r in got.values()) > 5
    for doc_id, text in rows:
        assert got[doc_id] == plain_row(doc_id, text)


def test_hard_rows(spark):
    rows = [r for r in HARD if r[1] is None or len(r[1]) < 300_001 and len(WORDS.findall(r[1])) < 3000] + [(20, "so so so so so so it is", "en", None), (21, "a b c \x85 " * 9, "en", None)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("clash").alias("runs"), F.lit("clash").alias("collapsed"), F.lit("clash").alias("__best"))
    kept = periodic.periodic_runs(df)
    assert kept.columns[:4] == ["doc_id", "text", "lang", "source"] and kept.count() == len(rows)
    bent = df.withColumn("text", periodic.planted(F.col("doc_id"), F.col("text")))
    got = sorted(map(tuple, periodic.digest(periodic.periodic_runs(bent)).collect()), key=str)
    assert got == sorted([plain_row(i, t) for i, t, *_ in rows], key=str)
    assert periodic.digest(periodic.periodic_runs(df.filter(F.lit(False)))).count() == 0
    assert [re.sub(r"\s+", " ", r["collapsed"]) for r in kept.filter("doc_id = 20").collect()] == ["so it is"]
