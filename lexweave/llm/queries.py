"""The queries of the corpus operators, one an operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm.common import documents


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.llm.mixing import mix_plan

    return mix_plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.llm.minhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir), size=3, percent=85)


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.llm.sharding import shard

    return shard(documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.llm.quality import score_quality

    return score_quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.llm.toxicity import score_toxicity

    return score_toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.llm.suffix import repeated_passages

    return repeated_passages(documents(spark, sf_dir))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lexweave.llm.packing import pack

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.llm.ann import nearest

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lexweave.llm.fingerprints import linked_fingerprints

    return linked_fingerprints(documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lexweave.llm.tokenfile import round_trip

    return round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_quality": op2_quality,
    "op3_repeated_passages": op3_repeated_passages,
    "op4_pack": op4_pack,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_shard": op6_shard,
    "op7_toxicity": op7_toxicity,
    "op8_nearest": op8_nearest,
    "op9_fingerprints": op9_fingerprints,
    "op10_token_files": op10_token_files,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1]::DOUBLE AS w,
         2.0 * source_size AS cap, 1.5 * sum(source_size) OVER () AS whole FROM t),
n AS (SELECT *, cap / w AS need FROM w),
v AS (
  SELECT *, (whole - coalesce(sum(cap) OVER (ORDER BY need, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(w) OVER (ORDER BY need, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM n),
f AS (SELECT *, max(CASE WHEN lv <= need THEN lv END) OVER () AS found FROM v),
g AS (SELECT source, source_size, CASE WHEN found IS NULL OR need < found THEN cap ELSE w * found END::DOUBLE AS target FROM f),
p AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, round(g.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS k FROM p)
SELECT doc_id, size, source_size, target,
       (k * size + greatest(0, least(size, budget - k * source_size - before)))::BIGINT AS taken
FROM q
""",
}
