"""Line dedup by hashes: built-in functions only, no text is shuffled until the keep bitmaps exist.

Lines become 128-bit hashes with their document and position.  The hashes are range-partitioned with document and
position as trailing keys, so that even one line of a third of all documents spreads over many ranges; each range
streams its sorted runs into a first occurrence and a document count, and only these summaries meet again.
Decisions return to the documents as sparse bitmaps of dropped positions: words of 64 lines, only those with a set bit.

The first occurrence and the document count of a key within a range are a minimum and a count, which the optimiser
takes from the sorted run; a line is kept unless its bit is set, so the bitmaps hold the complement of a keep bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeframe.llm.common import BLANKS, LOWER, UPPER, materialise


#: Parts of each key's lines in the join with the repeated keys.
SALT = 16


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    """All lines of a text; null and empty have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """Rows ``doc, content, h1, h2, pos, fresh`` of all lines whose key has ``min_chars`` code points or more.

    ``fresh`` marks the first line with its key in its document.  ``content`` hashes the text: with the id it
    names a row, so that rows of one id with different texts stay apart and null ids do no harm.
    """
    keyed = F.transform(lines_of(F.col(text)), lambda line, i: F.struct(line_key(line).alias("k"), i.alias("pos")))
    long_enough = F.filter(keyed, lambda x: F.char_length(x["k"]) >= min_chars)
    hashed = F.array_sort(F.transform(long_enough, lambda x: F.struct(F.xxhash64(x["k"]).alias("h1"), F.xxhash64(F.lit("second"), x["k"]).alias("h2"), x["pos"].alias("pos"))))
    runs = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(F.col(text)).alias("content"), hashed.alias("s"))

    def marked(x: Column, i: Column) -> Column:
        before = F.get(F.col("s"), i - 1)
        again = (before["h1"] == x["h1"]) & (before["h2"] == x["h2"])
        return F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["pos"].alias("pos"), (~F.coalesce(again, F.lit(False))).alias("fresh"))

    return runs.select("doc", "content", F.inline(F.transform("s", marked)))


def repeated_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """``h1, h2, first`` of the keys found in ``min_docs`` documents or more; ``first`` is the earliest occurrence."""
    place = F.struct("doc", "content", "pos")
    ranged = lines.filter("fresh").repartitionByRange(F.col("h1"), F.col("h2"), F.col("doc"), F.col("content"), F.col("pos"))
    streamed = ranged.sortWithinPartitions("h1", "h2", "doc", "content", "pos")
    return streamed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.min(place).alias("first")).filter(F.col("docs") >= min_docs).select("h1", "h2", "first")


def drop_bitmaps(lines: DataFrame, repeated: DataFrame, keep_first: bool) -> DataFrame:
    """``doc, content, words``: for each document with a dropped line, a map of words whose set bits are dropped positions.

    Lines of one key are salted over ``SALT`` parts, so that the rows of a line of a third of all documents spread.
    """
    salted = lines.withColumn("__salt", F.pmod(F.xxhash64("doc", "pos"), F.lit(SALT)).cast("int"))
    keys = repeated.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(SALT)])))
    hit = salted.join(keys, ["h1", "h2", "__salt"])
    if keep_first:
        hit = hit.filter(~F.struct("doc", "content", "pos").eqNullSafe(F.col("first")))
    word = F.floor(F.col("pos") / 64).cast("int")
    bits = hit.groupBy("doc", "content", word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64)).alias("bits"))
    return bits.groupBy("doc", "content").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "bits")))).alias("words"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Drop lines whose key occurs in ``min_docs`` documents or more; each row of ``docs`` is a document.

    Returns the columns of ``docs`` with ``text`` replaced by the kept lines, then ``n_lines``, ``n_dropped`` and
    ``drop_words`` (a map, null where no line is dropped).  ``keep_first`` keeps the first occurrence of each such key, by
    id and position.  A null or empty text has one empty line; a null text stays null unless a line is dropped.
    Columns of ``docs`` with the added names are replaced; names that start with two underscores are reserved.
    """
    added = ("n_lines", "n_dropped", "drop_words")
    docs = docs.select(*[c for c in docs.columns if c not in added])
    lines = materialise(hashed_lines(docs, doc_id, text, min_chars))
    repeated = materialise(repeated_keys(lines, min_docs))
    bitmaps = drop_bitmaps(lines, repeated, keep_first).select(F.col("doc").alias("__doc"), F.col("content").alias("__content"), F.col("words").alias("drop_words"))
    joined = docs.withColumn("__hash", F.xxhash64(F.col(text))).join(bitmaps, F.col(doc_id).eqNullSafe(F.col("__doc")) & (F.col("__hash") == F.col("__content")), "left")
    every = lines_of(F.col(text))

    def stays(_: Column, i: Column) -> Column:
        word = F.try_element_at(F.col("drop_words"), F.floor(i / 64).cast("int"))
        return F.getbit(F.coalesce(word, F.lit(0).cast("long")), F.pmod(i, F.lit(64))) == 0

    kept = F.when(F.col("drop_words").isNull(), every).otherwise(F.filter(every, stays))
    out = joined.withColumns({"__kept": kept, "n_lines": F.size(every).cast("long")})
    rest = [F.col(c) for c in docs.columns if c != text]
    whole = F.when(F.col("drop_words").isNull(), F.col(text)).otherwise(F.array_join("__kept", "\n"))
    out = out.select(*rest, whole.alias(text), "n_lines", (F.col("n_lines") - F.size("__kept")).alias("n_dropped"), "drop_words")
    return out.select(*docs.columns, *added)


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
