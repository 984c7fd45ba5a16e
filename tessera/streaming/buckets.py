"""Tables under a shared path that batches rewrite by buckets, with a manifest that names what counts.

A bucket is a hash of a key. A batch writes new files for the buckets it touches and then a
manifest of one row a bucket, which says in which batch's folder each table's bucket lies; what
no manifest names was never written. A batch that runs again reads the manifest before it and
overwrites its own folders, so it counts once. Folders that neither the last manifest nor the
one before it names are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Manifest = dict[int, int]


class Buckets:
    """One such table."""

    def __init__(self, path: str, schema: str, key: list[str], buckets: int = 256):
        self.path, self.schema, self.key, self.buckets = path.rstrip("/"), schema, key, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _fs(self, spark: SparkSession, name: str):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, spark: SparkSession, name: str) -> set[str]:
        """What lies in a folder; nothing where there is none."""
        fs, folder = self._fs(spark, name)
        return {x.getPath().getName() for x in fs.listStatus(folder)} if fs.exists(folder) else set()

    def manifest(self, spark: SparkSession, number: int) -> Manifest:
        """By bucket the batch whose folder holds it, after a batch; empty before the first."""
        fs, done = self._fs(spark, f"manifest/{number}/_SUCCESS")
        if number < 0 or not fs.exists(done):
            return {}
        return {r["bucket"]: r["batch"] for r in spark.read.schema("bucket int, batch long").json(f"{self.path}/manifest/{number}").collect()}

    def touched(self, rows: DataFrame) -> set[int]:
        """The buckets of rows that have the key: at most ``buckets`` numbers reach the driver."""
        return {r["bucket"] for r in rows.select(self.bucket().alias("bucket")).distinct().collect()}

    def read(self, spark: SparkSession, manifest: Manifest, of: set[int] | None = None) -> DataFrame:
        """The rows of some buckets, or of all; the other buckets' files aren't opened."""
        wanted = [(n, b) for b, n in sorted(manifest.items()) if of is None or b in of]
        there = {n: self._names(spark, f"rows/{n}") for n, _ in wanted}  # a bucket without rows has no folder
        paths = [f"{self.path}/rows/{n}/bucket={b}" for n, b in wanted if f"bucket={b}" in there[n]]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, number: int, before: Manifest, touched: set[int]) -> Manifest:
        """Put rows in place of what the touched buckets held; a bucket without rows is empty from now on."""
        spark = rows.sparkSession
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.path}/rows/{number}")
        after = before | dict.fromkeys(touched, number)
        # One row a bucket.
        spark.createDataFrame(sorted(after.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/{number}")
        self._clear(spark, number, {*before.values(), *after.values(), number})
        return after

    def _clear(self, spark: SparkSession, number: int, used: set[int]) -> None:
        for kind, kept in (("rows", used), ("manifest", {number - 1, number})):
            for name in self._names(spark, kind):
                if name.isdigit() and int(name) < number and int(name) not in kept:
                    fs, folder = self._fs(spark, f"{kind}/{name}")
                    fs.delete(folder, True)
