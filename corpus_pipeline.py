"""A corpus pipeline of five operators: each stage takes all documents that the one before has kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last
return the columns of ``documents``.  ``run`` writes each stage's result to the shared folder and rereads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.llm import language_id, line_dedup, mixing, sentencepiece_codec
from quakeframe.llm.common import materialise
from quakeframe.llm.near_dedup import near_duplicates
from quakeframe.llm.queries import piece_model


def beside(docs: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` over ``docs``, with the columns that it does not know under names that none of its own can clash with."""
    known = ("doc_id", "text", "lang")
    names = {c: c if c in known else f"column_{i}" for i, c in enumerate(docs.columns)}
    done = step(docs.select(*[F.col(c).alias(n) for c, n in names.items()]))
    return done.select(*[F.col(n).alias(c) for c, n in names.items()])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is identified; a null text or one without letters goes."""
    filters = language_id.learn(docs.filter(~language_id.held_out(F.col("doc_id"), 3, 1)))
    return beside(docs, lambda d: language_id.identify(d, filters).filter(F.col("lang_pred") != language_id.UNKNOWN))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines in ten documents or more keep the first occurrence; documents left without a word go.

    The first occurrence stays so that one of many copies of a clean document does.
    """
    deduped = beside(docs, lambda d: line_dedup.dedup_lines(d, keep_first=True)).withColumn("n_chars", F.length("text").cast("long"))
    return deduped.filter(F.btrim("text", F.lit(line_dedup.BLANKS)) != "").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates; repeated rows stay once."""
    kept = near_duplicates(docs.select("doc_id", "text")).filter("kept").select("doc_id").distinct()
    with_id = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return with_id.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, cut or leave out documents so that sources meet their targets, in training order."""
    mixed = mixing.mix_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else mixed


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode every document; counts and digests of ids and decoded text."""
    encoded = sentencepiece_codec.encode_documents(docs.select("doc_id", "text"), piece_model())
    return sentencepiece_codec.digest(sentencepiece_codec.decode_documents(encoded.select("doc_id", "ids"), piece_model()))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Hash draws, signatures and the tokenizer are beyond SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
