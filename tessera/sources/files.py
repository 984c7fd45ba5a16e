"""File sources: JSON documents and folders, whole texts, alternative shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Elements of JSON files that are an array or hold one under ``data``; schema is an element's DDL, without a field of that name.

    The elements of an array are parsed one after the other, however large the file is. Files that don't parse have none.
    """
    fields = [f.name for f in T.StructType.fromDDL(schema).fields]
    found = spark.read.schema(f"data array<struct<{schema}>>, {schema}, _corrupt string").json(path, multiLine=True, columnNameOfCorruptRecord="_corrupt").where("_corrupt is null")
    return found.select(F.explode(F.coalesce("data", F.array(F.struct(*fields)))).alias("row")).select("row.*")


def seeds(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The records of those files that exist; none at all is an error."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    held = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return merged([json_records(spark, p, schema) for p, at in zip(paths, held) if at.getFileSystem(hadoop).exists(at)])


def json_folder(spark: SparkSession, path: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of a folder of one JSON object a file, without manifest.json: bad ones don't parse or lack a required field."""
    ddl = f"{schema}, _corrupt string"
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("file"), F.from_json("value", ddl, {"columnNameOfCorruptRecord": "_corrupt"}).alias("row")).where("file <> 'manifest.json'")
    good = F.col("row._corrupt").isNull()
    for c in required:
        good &= F.coalesce(F.trim(F.col(f"row.{c}")) != "", F.lit(False))
    fields = [f.name for f in T.StructType.fromDDL(schema).fields]
    return files.where(good).select("file", *[f"row.{f}" for f in fields]), files.where(~good).select("file")


def text_folder(spark: SparkSession, path: str, least: int = 50) -> DataFrame:
    """(file, text) of *.txt files with at least so many characters."""
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text")).where(F.length(F.trim("text")) >= least)


def merged(frames: list[DataFrame]) -> DataFrame:
    """All sources that could be read, by column name; at least one is needed."""
    if not frames:
        raise ValueError("no source could be read")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def exactly_one(rows: DataFrame) -> DataFrame:
    """The row of a look-up that has to find one; none, or more than one, is an error."""
    n = rows.limit(2).count()
    if n != 1:
        raise LookupError("no row" if not n else "more than one row")
    return rows


def at_most_one(rows: DataFrame) -> DataFrame:
    """The rows of a point lookup; more than one is an error."""
    if rows.limit(2).count() > 1:
        raise ValueError("more than one row")
    return rows
