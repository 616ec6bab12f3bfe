"""The queries of the operators, with their production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geosieve.llm.common import fresh_path, table


def op1_pack_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geosieve.llm.packing import pack

    return pack(table(spark, sf_dir, "documents")).drop("ids", "source_no")


def op2_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geosieve.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from geosieve.llm.simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_language_hd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geosieve.llm.language import language

    return language(table(spark, sf_dir, "documents"))


def op5_repeats_pfp(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geosieve.llm.repeats import digests, without_repeats

    return digests(without_repeats(table(spark, sf_dir, "documents")))


def op6_stable_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geosieve.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), 20, 20)


def op7_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geosieve.llm.token_files import token_digest, write_token_files

    path = fresh_path(spark, "token-orc")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return token_digest(spark, path)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from geosieve.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from geosieve.llm.sharding import shard

    out = shard(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from geosieve.llm.winnowing import digest, edited_fingerprints

    out = edited_fingerprints(table(spark, sf_dir, "documents"))
    marks = {"fingerprint": digest(F.col("hashes"), F.col("positions")), "edited_fingerprint": digest(F.col("edited_hashes"), F.col("edited_positions"))}
    return out.select("doc_id", "n_chars", "edited_sha256", *(v.alias(k) for k, v in marks.items()), "near_edited", "near_next", "positions")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict:
    return {"op8_mix_sources": OP8}


OP8 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1 AS rnk FROM s0),
s2 AS (SELECT *, [5, 2, 1][rnk % 3 + 1] AS weight FROM s1),
s3 AS (SELECT *, sum(source_size) OVER () AS all_words,
         coalesce(sum(source_size) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining FROM s2),
s4 AS (SELECT *, (all_words * 1.5::DOUBLE - capped * 2.0::DOUBLE) / remaining AS lvl FROM s3),
s5 AS (SELECT *, (SELECT arg_min(lvl, capped) FROM s4 WHERE lvl * weight <= source_size * 2.0::DOUBLE) AS final FROM s4),
s AS (SELECT source, source_size, least(source_size * 2.0::DOUBLE, final * weight) AS target FROM s5),
p AS (SELECT d.doc_id, d.size, s.source_size, s.target, CAST(floor(s.target + 0.5) AS BIGINT) AS budget,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_words
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(greatest(budget - epochs * source_size - before_words, 0), size) AS BIGINT) AS taken FROM q
"""
