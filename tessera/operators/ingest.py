"""Loads in which one bad row never costs a good one.

Each row is cast by ``try_`` expressions and held against rules; what fails is kept as it came,
with all its reasons. Good rows and quarantine are parted in one pass over the source and written
in one job, whose counts are observed on the way, so they always add up.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def judged(raw: DataFrame, casts: dict[str, str], required: list[str] = (), rules: dict[str, Column] | None = None) -> DataFrame:
    """(loaded struct, reasons array, raw columns): each row with its columns cast.

    Reasons: 'column:type' where a value that is there can't be cast, 'column:missing' where a
    required one is null or blank, and the names of rules that don't hold of the cast row. Rules
    are conditions on ``loaded``; one that is null, or fails as such, counts as not held.
    """
    plain = {c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))) if dict(raw.dtypes)[c] == "string" else F.col(c) for c in casts}
    held = raw.withColumn("loaded", F.struct(*[(F.col(c) if kind == "string" else plain[c].try_cast(kind)).alias(c) for c, kind in casts.items()]))
    bad = [F.when(plain[c].isNotNull() & F.col(f"loaded.{c}").isNull(), F.lit(f"{c}:{kind}")) for c, kind in casts.items() if kind != "string"]
    bad += [F.when(plain[c].isNull(), F.lit(f"{c}:missing")) for c in required]
    bad += [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in (rules or {}).items()]
    return held.withColumn("reasons", F.array_compact(F.array(*bad)).cast("array<string>"))


class Load:
    """What a load has written: good rows, quarantine, and counts (rows, loaded, failed, and failed by reason)."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, counts: dict[str, int]):
        self.spark, self.path, self.schema, self.counts = spark, path, schema, counts

    def _read(self, ok: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).where(F.col("ok") == ok)

    def good(self) -> DataFrame:
        return self._read(1).select("loaded.*")

    def quarantine(self) -> DataFrame:
        """The failed rows as they came, with their reasons."""
        return self._read(0).drop("ok", "loaded")


def load(raw: DataFrame, path: str, casts: dict[str, str], required: list[str] = (), rules: dict[str, Column] | None = None) -> Load:
    """Write a load below a path that all executors share, parted by ``ok``: one job, in which every row is read once."""
    rows = judged(raw, casts, required, rules).withColumn("ok", (F.size("reasons") == 0).cast("int"))
    names = [f"{c}:{kind}" for c, kind in casts.items() if kind != "string"] + [f"{c}:missing" for c in required] + list(rules or {})
    seen = Observation("load")
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col("ok") == 1).alias("loaded"), F.count_if(F.col("ok") == 0).alias("failed")]
    watched = rows.observe(seen, *counts, *[F.count_if(F.array_contains("reasons", n)).alias(n) for n in names])
    watched.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("ok").parquet(path)
    return Load(raw.sparkSession, path, rows.schema, dict(seen.get))


def audit(spark: SparkSession, path: str, action: str, counts: dict[str, int], at: str) -> bool:
    """Append one entry (at, action, counts as JSON) to a log; a log that can't be written is told by False and harms nothing else."""
    try:
        spark.createDataFrame([(at, action, json.dumps(counts, sort_keys=True))], "at string, action string, counts string").coalesce(1).write.mode("append").json(path)
        return True
    except Exception:  # noqa: BLE001  whatever keeps the log from being written
        return False
