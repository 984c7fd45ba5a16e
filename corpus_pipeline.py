"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, jaccard_join, mixing, secrets, toxicity
from tessera.llm.common import bounded_memory, cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for toxicity go; the model learns from the labels of all documents, and without both classes of them all stay."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(toxicity.predicted() == 0).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of 5-word shingles at 80 of 100, the document with the smallest id stays; so do rows without an id, and rows that repeat an id with other texts."""
    found = jaccard_join.near_duplicates(docs, size=5, percent=80)
    # Ids only, and read twice: a plan that holds the join twice takes much of the driver's memory.
    with bounded_memory(spark):
        kept = cut(found.where("component_id = doc_id").groupBy(F.col("doc_id").alias("kept_id")).agg(F.count(F.lit(1)).alias("kept_rows")))
    held = docs.select(*COLUMNS)
    # Only ids with several rows are looked at for rows that say the same, and without such ids not planned.
    named = held.join(kept, F.col("doc_id") == F.col("kept_id"))
    nameless = held.where("doc_id is null").dropDuplicates(["text"])
    once = named.where("kept_rows = 1").select(*COLUMNS).unionByName(nameless)
    if kept.where("kept_rows > 1").isEmpty():
        return once
    return once.unionByName(named.where("kept_rows > 1").dropDuplicates(["doc_id", "text"]).select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least 80 of 100 of a benchmark item's 5-word shingles go."""
    found = decontamination.leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leaked_id")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("leaked_id")), "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark, and n_chars follows where a text has changed."""
    scanned = secrets.redact(secrets.scan(docs, secrets.train(docs)))
    return scanned.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document that is left."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("mixing sources", mix_sources),
]

#: SQL can't express compression distances; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet in the folder of spark.checkpoint.dir and read again; what a stage has read is deleted once its result is written."""
    cut(spark.range(1))  # a session without a checkpoint folder gets one
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
        done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(done, True)
    return STAGES[-1][1](spark, docs, sf_dir)
