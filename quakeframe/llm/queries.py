"""One query per operator, with production parameters, over the operator's whole table; and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.llm import exact_topk, language_id, line_dedup, media, mixing, periodic, quality, sentencepiece_codec, sharding, token_files, whitening
from quakeframe.llm.near_dedup import near_duplicates
from quakeframe.llm.url_filters import Rule, filter_urls

RULES = [
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """The tokenizer file: of the installed vocabulary package, the same path on every executor."""
    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda doc_id: language_id.held_out(doc_id, 5, 0))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    ordered = mixing.in_training_order(mixed, F.get(F.col("parts"), F.lit(0))["position"])
    return ordered.select("doc_id", "size", "source_size", "target", "taken", "position")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = language_id.learn(docs.filter(~language_id.held_out(F.col("doc_id"), 3, 1)))
    found = language_id.identify(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", language_id.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.encode_media(table(spark, sf_dir, "documents").select("doc_id", "text"), "mulaw").select("doc_id", "n_bytes", "media")
    files = media.store_pcm(stored, up=2, down=1, lifted=True)
    return media.describe_media(media.materialise(files, **{"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_topk.top_k(vectors, F.col("vec_id") % 50 == 0)


def op8_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = sentencepiece_codec.encode_documents(docs, piece_model())
    return sentencepiece_codec.digest(sentencepiece_codec.decode_documents(encoded.select("doc_id", "ids"), piece_model()))


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = token_files.write_store(docs, str(public_tokenizers.path("byte_bpe_50k.json")))
    return token_files.read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic.planted(F.col("doc_id"), F.col("text")).alias("text"))
    return periodic.digest(periodic.periodic_runs(docs))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_url_filters, op2_quality_classifier, op3_minhash_near_dedup, op4_mixing_sources, op5_language_id, op6_media_columns, op7_exact_topk, op8_hilbert_sharding, op9_line_dedup, op10_sentencepiece, op11_token_ids, op12_periodic_runs, op13_embedding_whitening, pipeline)
}

#: The characters of [\x20\x09-\x0D], as a DuckDB expression.
BLANKS_SQL = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

ORACLE_SQL = {
    "op1_url_filters": """
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
raw AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM rest),
parts AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM raw),
rules(rule_host, rule_path, rule_verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
                 ('example.net', '/de/8', 'allow'), ('org', '/es/', 'block')),
fits AS (SELECT page_id, host, path, rule_host || rule_path AS rule, rule_verdict,
                row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS place
         FROM parts LEFT JOIN rules ON ('.' || host) LIKE ('%.' || rule_host) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM fits WHERE place = 1""",
    "op4_mixing_sources": """
WITH base AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS turn FROM sizes),
caps AS (SELECT *, CASE turn WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
                CASE turn WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE -0.5::DOUBLE END AS tilt, source_size * 2.0::DOUBLE AS cap FROM ranked),
levels AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
final AS (SELECT *, coalesce((SELECT level FROM levels WHERE cap > level * w ORDER BY cap / w, source NULLS LAST LIMIT 1), 'inf'::DOUBLE) AS stop FROM levels),
targets AS (SELECT source, source_size, tilt, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(cap, stop * w) END AS target FROM final),
placed AS (SELECT b.doc_id, b.size, t.source_size, t.target, t.tilt,
                  coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.o, b.doc_id, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
           FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source),
words AS (SELECT *, greatest(0, least(size, floor(target)::BIGINT - start)) AS one, greatest(0, least(size, floor(target)::BIGINT - start - source_size)) AS two FROM placed),
shares AS (SELECT *, least((start + one / 2.0::DOUBLE) / greatest(target, 1e-9), 1.0::DOUBLE) AS y FROM words)
SELECT doc_id, size, source_size, target, (one + two)::BIGINT AS taken,
       CASE WHEN one <= 0 THEN NULL WHEN tilt = 0 THEN y
            ELSE ((1.0::DOUBLE + tilt) - sqrt(greatest((1.0::DOUBLE + tilt) * (1.0::DOUBLE + tilt) - 4 * tilt * y, 0.0::DOUBLE))) / (2 * tilt) END AS position
FROM shares""",
    "op7_exact_topk": """
WITH clean AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
           FROM clean q JOIN clean c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5""",
    "op9_line_dedup": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
keyed AS (SELECT r, pos, line, translate(trim(line, {BLANKS_SQL}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10),
kept AS (SELECT r, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n FROM keyed WHERE k NOT IN (SELECT k FROM common) GROUP BY r)
SELECT d.doc_id, len(d.lines)::BIGINT AS n_lines, (len(d.lines) - coalesce(kept.n, 0))::BIGINT AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept ON d.r = kept.r""",
}
