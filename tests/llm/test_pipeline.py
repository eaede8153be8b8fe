"""The pipeline's stages against plain versions, each over all that its predecessor kept."""

import hashlib
from collections import Counter

import sentencepiece

import pytest

import corpus_pipeline
from quakeframe.llm import mixing, queries
from tests.llm.test_operators import plain_components, plain_lines

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    named = dict(corpus_pipeline.STAGES)

    kept = named["language_id"](spark, docs, SF).cache()
    assert kept.columns == columns and kept.count() == docs.filter("text rlike '[A-Za-z]'").count()

    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    deduped = named["line_dedup"](spark, kept, SF).cache()
    assert deduped.columns == columns
    want = {i: (n, sha) for i, _, n, sha in plain_lines(rows, 10, True)}
    for r in deduped.collect():
        assert hashlib.sha256(r["text"].encode()).hexdigest() == want[r["doc_id"]][1]
    assert len(rows) - deduped.count() == sum(1 for r in rows if not any(line.strip() for line in plain_text(r, want)))

    near = named["near_dedup"](spark, deduped, SF).cache()
    component, _ = plain_components([(r["doc_id"], r["text"]) for r in deduped.collect()])
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(i for i, c in component.items() if i == c)

    mixed = named["mixing"](spark, near, SF).cache()
    assert mixed.columns == columns
    copies = {r["doc_id"]: len(r["parts"]) for r in mixing.mix(near).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})

    own = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    last = named["sentencepiece"](spark, mixed, SF).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in last) == Counter((r["doc_id"], len(own.encode(r["text"])) + 1) for r in mixed.collect())


def plain_text(row, want):
    """The lines of a row if some are kept: a document goes only when nothing is left of it."""
    empty = hashlib.sha256(b"").hexdigest()
    return [] if want[row[0]][1] == empty else (row[1] or "").split("\n")


def test_run_counts(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


EDGES = [  # the last three columns have the names of columns that operators add
    (1, "plain words about one harbour town and its boats", "en", "a", 48, 0.5, 7, "x"),
    (1, "plain words about one harbour town and its boats", "en", "a", 48, 0.5, 7, "x"),
    (2, None, "en", "a", None, 0.1, 1, None),
    (3, "", None, None, 0, None, None, "y"),
    (4, "12 34", "de", "b", 5, 0.2, 2, "z"),
    (5, "der lange Text " * 20000, "de", "b", 300000, 0.3, 3, "z"),
    (6, "words of a row without a language or source", None, None, 43, 0.4, 4, None),
    (None, "words of a row without an id stay as they are", "en", "a", 45, None, None, None),
]
EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_lines long, lang_pred string"


def test_stages_on_edge_rows(spark):
    docs = spark.createDataFrame(EDGES, EDGE_SCHEMA)
    named = dict(corpus_pipeline.STAGES)

    def rows(frame):
        assert frame.columns == docs.columns
        return sorted((tuple(r) for r in frame.collect()), key=repr)

    lettered = [r for r in EDGES if r[1] and r[0] != 4]
    kept = named["language_id"](spark, docs, SF).cache()
    assert rows(kept) == sorted(lettered, key=repr)

    deduped = named["line_dedup"](spark, kept, SF).cache()  # no line is in ten documents
    want = sorted(((*r[:4], len(r[1]), *r[5:]) for r in lettered), key=repr)
    assert rows(deduped) == want

    near = named["near_dedup"](spark, deduped, SF).cache()
    assert rows(near) == sorted(set(want), key=repr)

    mixed = named["mixing"](spark, near, SF).cache()
    copies = {r["doc_id"]: [p["words"] for p in r["parts"]] for r in mixing.mix(near).collect()}
    texts = {r[0]: r for r in want}
    assert sum(map(len, copies.values())) == mixed.count()
    for r in mixed.collect():
        assert len(r["text"].split()) in copies[r["doc_id"]] and r["n_chars"] == len(r["text"])
        assert (r["lang"], r["source"], r["score"], r["n_lines"], r["lang_pred"]) == (*texts[r["doc_id"]][2:4], *texts[r["doc_id"]][5:])

    own = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    last = named["sentencepiece"](spark, mixed, SF).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in last) == Counter((r["doc_id"], len(own.encode(r["text"])) + 1) for r in mixed.collect())


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_on_an_empty_table(spark, name):
    docs = spark.createDataFrame([], EDGE_SCHEMA)
    done = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert done.count() == 0 and (name == "sentencepiece" or done.columns == docs.columns)
