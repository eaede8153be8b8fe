"""Read-quality reports and run summaries of stations and chunks; known-bad data; skipped combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeframe.operators.scans import null_safe


def read_quality(expected: Column, decoded: Column, recovered: Column) -> Column:
    """``FAILED`` without samples, ``RECOVERED`` when fewer than expected or by recovery, else ``CLEAN``."""
    return F.when(F.coalesce(decoded, F.lit(0)) == 0, "FAILED").when(recovered | (decoded < expected), "RECOVERED").otherwise("CLEAN")


def station_quality(reports: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of expected and decoded samples, whether expectations are partial, all tags, and a text."""
    rows = reports.groupBy(*keys).agg(
        F.sum("expected").alias("expected"), F.sum("decoded").alias("decoded"), (F.count("expected") < F.count(F.lit(1))).alias("partial"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"), F.count_if(F.col("quality") == "FAILED").alias("failed"), F.count(F.lit(1)).alias("files"),
    )
    text = F.when(F.col("failed") == F.col("files"), "FAILED").when(F.size("tags") > 0, F.array_join("tags", "; ")).otherwise("OK")
    return rows.withColumn("text", text)


def run_quality(reports: DataFrame, keys: list[str]) -> DataFrame:
    n = lambda q: F.count_if(F.col("quality") == q).alias(q.lower())
    return reports.groupBy(*keys).agg(n("CLEAN"), n("RECOVERED"), n("FAILED"), F.count(F.lit(1)).alias("files"), F.sum("decoded").alias("decoded"))


def station_summary(picks: DataFrame, quality: DataFrame, keys: list[str]) -> DataFrame:
    """P and S counts of each station and chunk, with its read quality."""
    n = picks.groupBy(*keys).agg(F.count_if(F.col("phase") == "P").alias("n_p"), F.count_if(F.col("phase") == "S").alias("n_s"))
    rows = quality.join(n, keys, "left")
    return rows.withColumns({"n_p": F.coalesce("n_p", F.lit(0)), "n_s": F.coalesce("n_s", F.lit(0))})


def run_rows(summary: DataFrame, runs: DataFrame, on: list[str]) -> DataFrame:
    """Each station's row with the ``window``, ``model`` and ``thresholds`` of its run; empty text where the run is unknown.

    ``expected`` and ``decoded`` become text, empty where they were not counted.
    """
    rows = summary.join(runs.select(*on, "window", "model", "thresholds"), on, "left")
    texts = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("window", "model", "thresholds", "expected", "decoded")}
    return rows.withColumns({**texts, "text": F.coalesce("text", F.lit("not available"))})


def is_problem(text: Column) -> Column:
    """A summary cell that names a problem."""
    t = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    return ~t.isin("", "OK", "CLEAN", "-")


def executive_summary(rows: DataFrame, station: str, chunk: str, label: str, text: str, most: int = 3) -> DataFrame:
    """Totals of a station over chunks, its first non-empty label, and its problem chunks, the first ``most`` by name.

    All problem chunks are counted; only the list of names shown is short, as the report asks.
    """
    bad = F.when(is_problem(F.col(text)), F.col(chunk))
    g = rows.groupBy(station).agg(
        F.sum(F.col("n_p").try_cast("long")).alias("n_p"), F.sum(F.col("n_s").try_cast("long")).alias("n_s"),
        F.min(F.when(F.trim(F.col(label)) != "", F.struct(F.col(chunk), F.col(label))))[label].alias(label), F.array_sort(F.collect_set(bad)).alias("bad"),
    )
    shown = F.array_join(F.slice("bad", 1, most), ", ")
    more = F.when(F.size("bad") > most, F.concat(F.lit(" +"), (F.size("bad") - most).cast("string"), F.lit(" more"))).otherwise("")
    return g.select(station, "n_p", "n_s", label, F.concat(shown, more).alias("bad_chunks"))


def known_issues(run: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    """Registered issues of the stations and chunks of a run."""
    return run.select(*keys).distinct().join(registry, keys)


def mark_unsupported(plan: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``benchmark_status`` and ``skip_reason`` (the first by name); a rule's null key fits any value.

    Each rule is filed under a mask of its given keys and their values; each distinct plan row looks itself up under the
    masks that occur, in one equi-join however many keys there are.  A plan row with a null key fits only rules that
    leave that key open; repeated plan rows stay.
    """
    kinds = dict(plan.dtypes)
    bits = {k: 1 << i for i, k in enumerate(keys)}
    given = lambda k: F.when(F.col(k).isNotNull(), bits[k]).otherwise(0)
    filed = rules.select(*[F.col(k).cast(kinds[k]).alias(k) for k in keys], "reason").withColumn("__mask", sum((given(k) for k in keys), F.lit(0)))
    # null fields are left out of the text, so it names the given keys and their values
    filed = filed.groupBy("__mask", F.to_json(F.struct(*keys)).alias("__values")).agg(F.min("reason").alias("__reason"))
    masks = [r["__mask"] for r in filed.select("__mask").distinct().collect()]  # at most one for each subset of the keys
    cells = plan.select(*keys).distinct()
    asked = cells.withColumn("__mask", F.explode(F.array(*[F.lit(m) for m in masks]).cast("array<int>")))
    of_mask = F.to_json(F.struct(*[F.when(F.col("__mask").bitwiseAND(bits[k]) != 0, F.col(k)).alias(k) for k in keys]))
    found = asked.withColumn("__values", of_mask).join(filed, ["__mask", "__values"]).groupBy(*keys).agg(F.min("__reason").alias("skip_reason"))
    rows = null_safe(plan.drop("skip_reason", "benchmark_status"), found, keys, "left")
    return rows.withColumn("benchmark_status", F.when(F.col("skip_reason").isNull(), "planned").otherwise("skipped"))
