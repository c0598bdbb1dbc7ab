"""The query of each operator, on whole tables with production parameters, and SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import media, mixing, packing, quality_classifier, quality_rules, records, sharding, simhash, token_counts, toxicity
from .common import new_folder, prepare

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file; any path can be passed to the operators instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    held_out = toxicity.is_match(F.col("doc_id"), 5, 0).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", "predicted")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, read(spark, sf_dir, "labels"))
    held_out = toxicity.is_match(F.col("doc_id"), 4, 2).alias("held_out")
    return quality_classifier.score(docs, model).select("doc_id", held_out, "score", "predicted")


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "records")
    manifest = records.write_records(read(spark, sf_dir, "documents"), folder, tokenizer("byte_bpe_50k.json"))
    return records.read_records(manifest, folder, with_ids=False)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "media")
    index = media.read_headers(media.store_payloads(read(spark, sf_dir, "documents"), folder), folder)
    return media.read_payloads(index, folder).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "width", "height", "bits",
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    own = (
        op1_pack, op2_toxicity, op3_simhash, op4_quality_rules, op5_quality,
        op6_shards, op7_records, op8_token_counts, op9_mix, op10_media, pipeline,
    )
    return {f.__name__: f for f in own}


#: Mixing in SQL: the same order, the same running sums, the same offsets.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3
              WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 3 AS most
  FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS k
  FROM w
), t AS (
  SELECT source, source_size,
         coalesce(least(most::DOUBLE, weight * arg_min(level, CASE WHEN level <= most / weight THEN k END) OVER ()), most) AS target,
         CAST(('0x' || substr(md5('7:' || coalesce(source, '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS each,
         row_number() OVER (PARTITION BY d.source ORDER BY
           length(bin(d.size)) * 128 + (d.size >> greatest(length(bin(d.size)) - 7, 0)),
           substr(md5(d.doc_id::VARCHAR), 1, 2), md5(d.doc_id::VARCHAR)) - 1 AS rank
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(u + (rank + 1) * each) - floor(u + rank * each)) AS BIGINT) AS taken
FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_mix": MIX_SQL}
