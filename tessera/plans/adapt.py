"""The driver's tables in the shapes of the operators, as DataFrames and as the same rules in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table

ACTIVITIES = ["musculacao", "pilates", "muay_thai", "yoga", "boxe", "danca"]

CHUNKS_SQL = """
chunks AS (
  SELECT 'c' || vec_id AS chunk_id, vec_id, label AS group_id, text, embedding::DOUBLE[] AS embedding,
         CASE WHEN vec_id % 3 <> 0 THEN (vec_id % 4)::VARCHAR END AS tenant_id,
         'NATION_' || (vec_id % 25) AS cidade, ['NATION_' || ((vec_id + 1) % 25), 'NATION_' || ((vec_id + 2) % 25)] AS related,
         CASE WHEN vec_id % 7 <> 0 THEN vec_id % 10 + 1 END AS plano_minimo_rank,
         (['musculacao', 'pilates', 'muay_thai', 'yoga', 'boxe', 'danca'])[(vec_id % 6 + 1)::INT] AS modalidade_key
  FROM embeddings JOIN documents ON vec_id = doc_id),
q AS (SELECT embedding AS v FROM chunks WHERE vec_id = 0),
s AS (SELECT *, list_cosine_similarity(embedding, v) AS similarity FROM chunks, q)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings with their documents' texts as chunks; metadata by arithmetic on the id."""
    v = F.col("vec_id")
    nation = lambda k: F.concat(F.lit("NATION_"), ((v + k) % 25).cast("string"))
    key = F.element_at(F.array(*[F.lit(a) for a in ACTIVITIES]), (v % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "documents").select("doc_id", "text"), v == F.col("doc_id"))
    return rows.select(
        F.concat(F.lit("c"), v.cast("string")).alias("chunk_id"), "vec_id", F.col("label").alias("group_id"), "text", "embedding",
        F.when(v % 3 != 0, (v % 4).cast("string")).alias("tenant_id"), nation(0).alias("cidade"), F.array(nation(1), nation(2)).alias("municipios_relacionados"),
        F.when(v % 7 != 0, v % 10 + 1).alias("plano_minimo_rank"), key.alias("modalidade_key"), F.replace(key, F.lit("_"), F.lit(" ")).alias("modalidade"),
        F.array().cast("array<string>").alias("modalidades_secundarias"), F.lit(None).cast("string").alias("bairro_normalizado"),
    )


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The first vector, as a question would be embedded; one row."""
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    kind = F.when(F.col("c_acctbal") > 6000, "hot").when(F.col("c_acctbal") > 2000, "morno").otherwise("frio")
    return c.select(F.col("c_custkey").alias("lead_id"), F.col("c_name").alias("name"), kind.alias("classification"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("updated"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))


LEADS_SQL = """
leads AS (
  SELECT c_custkey AS lead_id, c_name AS name, CASE WHEN c_acctbal > 6000 THEN 'hot' WHEN c_acctbal > 2000 THEN 'morno' ELSE 'frio' END AS classification,
         CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS updated, c_mktsegment AS segment, c_nationkey AS nation
  FROM customer)"""


def gyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as gyms: activity, plan, rank, price and an explicit order."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        (k % 500).alias("gym_id"), F.element_at(F.array(*[F.lit(a) for a in ACTIVITIES]), (k % 6 + 1).cast("int")).alias("modality"), F.col("p_brand").alias("plano"),
        F.when(k % 9 != 0, F.col("p_size")).alias("rank"), F.when(k % 4 == 0, "N/A").when(k % 4 != 1, F.col("p_type")).alias("valor"), F.round(F.col("p_retailprice") % 100, 2).alias("score"), k.alias("ord"), F.col("p_name").alias("nome"),
    )


GYMS_SQL = """
gyms AS (
  SELECT p_partkey % 500 AS gym_id, (['musculacao', 'pilates', 'muay_thai', 'yoga', 'boxe', 'danca'])[(p_partkey % 6 + 1)::INT] AS modality, p_brand AS plano,
         CASE WHEN p_partkey % 9 <> 0 THEN p_size END AS rank, CASE WHEN p_partkey % 4 = 0 THEN 'N/A' WHEN p_partkey % 4 <> 1 THEN p_type END AS valor,
         round(p_retailprice % 100, 2) AS score, p_partkey AS ord, p_name AS nome
  FROM part)"""
