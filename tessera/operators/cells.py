"""Exact distance-only top-k that an index serves: vectors in cells around centroids.

Centroids are fitted on a bounded sample of unit vectors; every vector is filed in the cell of its
nearest centroid, with its distance from it, and cells are written as folders. A search first
looks into a query's nearest cells. Its k-th distance so far then bounds the rest: by the triangle
inequality no vector of a cell is nearer to the query than the distance to the centroid less the
cell's radius, nor than the difference of the two distances to the centroid. Cells that can't
hold anything nearer aren't met, rows that can't aren't multiplied, and the result is that of a
search over all rows, whatever the sample was.

Cells and the queries that meet in them are split into blocks, so a cell with a third of all
rows is many tasks. Null, empty and zero vectors, those with a null or non-finite component and
those of another length than the index's have no cosine and aren't filed. Ids are unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import cut

#: Rows that centroids are fitted on at most, rounds of fitting, and nearest cells of the first look.
SAMPLE, ROUNDS, FIRST = 20_000, 8, 2
#: Rows and queries of a block; cells up to which the table of cells is shipped with the tasks (some 16 MB at 64 components).
BLOCK, MOST_CELLS = 4096, 32_768
#: Slack on distances, for rounding.
EPS = 1e-9


def unit_rows(vectors: Iterator, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows fit, their unit vectors): whole vectors of a width that aren't zero."""
    rows = [None if v is None or len(v) != width else np.asarray(v, np.float64) for v in vectors]
    fits = np.array([v is not None and bool(np.isfinite(v).all()) and bool(v.any()) for v in rows], bool)
    m = np.array([v for v, ok in zip(rows, fits) if ok], np.float64).reshape(-1, width)
    m = m / np.abs(m).max(axis=1, initial=1e-300)[:, None]
    return fits, m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)))


class Cells:
    """Centroids, and what is known of their cells."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    @classmethod
    def fit(cls, chunks: DataFrame, cells: int | None = None, seed: int = 5) -> Cells:
        """Centroids of a sample of at most SAMPLE rows; some n / BLOCK of them, at least 16, unless told. The most common length wins."""
        held = chunks.where("embedding is not null and size(embedding) > 0")
        sizes = held.groupBy(F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").limit(1).collect()
        if not sizes:
            return cls(np.zeros((1, 1)))
        width, n = sizes[0]["width"], sizes[0]["n"]
        # The sample is drawn by a hash of the id: bounded, and the same each time.
        parts = max(1, -(-n // (SAMPLE // 2)))
        sample = held.where((F.size("embedding") == width) & (F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(parts)) == 0)).select("embedding").limit(SAMPLE).toPandas()
        _, m = unit_rows(sample["embedding"], width)
        if not len(m):
            return cls(np.zeros((1, width)))
        count = min(len(m), MOST_CELLS, max(16, n // BLOCK) if cells is None else cells)
        centroids = m[np.random.default_rng(seed).permutation(len(m))[:count]]
        for _ in range(ROUNDS):
            near = (m @ centroids.T - (centroids * centroids).sum(axis=1) / 2).argmax(axis=1)
            sums = np.zeros_like(centroids)
            np.add.at(sums, near, m)
            held_by = np.bincount(near, minlength=count)
            centroids = np.where(held_by[:, None] > 0, sums / np.maximum(held_by, 1)[:, None], centroids)
        return cls(centroids)

    def file(self, chunks: DataFrame) -> DataFrame:
        """(chunk_id, group_id, embedding, cell, away): each whole vector's cell and its distance from the centroid."""
        shipped = chunks.sparkSession.sparkContext.broadcast(self.centroids)
        width = self.width

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                fits, m = unit_rows(rows["embedding"], width)
                out = rows[fits].copy()
                away = distances(m, shipped.value)
                out["cell"] = away.argmin(axis=1).astype(np.int32)
                out["away"] = away.min(axis=1) if len(m) else np.zeros(0)
                yield out

        held = chunks.select("chunk_id", "group_id", "embedding")
        shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema)
        return held.mapInPandas(run, f"{shape}, cell int, away double")

    def write(self, chunks: DataFrame, path: str) -> None:
        """The index as Parquet: rows by cell, sorted by distance from the centroid, and a small table of the cells."""
        spark = chunks.sparkSession
        self.file(chunks).repartition("cell").sortWithinPartitions("cell", "away").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        spark.createDataFrame(pd.DataFrame({"cell": np.arange(len(self.centroids)), "centroid": list(self.centroids)}), "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> tuple[Cells, DataFrame]:
        rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
        return cls(np.array([r["centroid"] for r in rows])), spark.read.parquet(f"{path}/rows")


def _probes(cells: Cells, reach: tuple[np.ndarray, np.ndarray], queries: DataFrame, worst: float) -> DataFrame:
    """(query_id, vector, group_id, cell, apart, bound) of queries (query_id, vector, group_id, kth).

    Without a kth column the FIRST nearest cells of each, else all others that may hold a row at
    most kth away (null: worst). reach has the least and largest distance of each cell's rows from
    its centroid, the least above the largest where it has none.
    """
    shipped = queries.sparkSession.sparkContext.broadcast((cells.centroids, *reach))
    width, second = cells.width, "kth" in queries.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, near, far = shipped.value
        for rows in batches:
            for start in range(0, len(rows), 256):
                some = rows.iloc[start : start + 256]
                fits, m = unit_rows(some["vector"], width)
                some = some[fits]
                apart = distances(m, centroids)
                apart[:, near > far] = np.inf
                first = np.argsort(apart, axis=1, kind="stable")[:, :FIRST]
                looked = np.zeros(apart.shape, bool)
                np.put_along_axis(looked, first, True, axis=1)
                bound = np.full(len(some), worst)
                if second:
                    bound = np.minimum(worst, some["kth"].fillna(worst).to_numpy()) + EPS
                    least = np.maximum(apart - far, near - apart)
                    looked = ~looked & (least <= bound[:, None])
                i, cell = np.nonzero(looked & np.isfinite(apart))
                out = some.iloc[i][["query_id", "vector", "group_id"]].copy()
                out["cell"], out["apart"], out["bound"] = cell.astype(np.int32), apart[i, cell], bound[i]
                yield out

    shape = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in ("query_id", "vector", "group_id"))
    return queries.mapInPandas(run, f"{shape}, cell int, apart double, bound double")


def _best(queries: pd.DataFrame, rows: pd.DataFrame, width: int, k: int) -> pd.DataFrame:
    """Each query's k nearest of a block, rows whose distance from the centroid rules them out left aside; and how many were multiplied."""
    _, q = unit_rows(queries["vector"], width)
    _, m = unit_rows(rows["embedding"], width)
    away, ids = rows["away"].to_numpy(), rows["chunk_id"].to_numpy()
    out = []
    for i, (query_id, apart, bound) in enumerate(zip(queries["query_id"], queries["apart"], queries["bound"])):
        some = np.flatnonzero(np.abs(away - apart) <= bound + EPS)
        near = np.round(np.einsum("ij,j->i", m[some], q[i]), 12)
        order = np.lexsort((ids[some], -near))[:k]
        out += [(query_id, ids[some[j]], float(near[j])) for j in order]
    return pd.DataFrame(out, columns=["query_id", "chunk_id", "similarity"])


def _blocks(n: Column) -> Column:
    return F.ceil(n / F.lit(BLOCK)).cast("int")


def _meet(probes: DataFrame, filed: DataFrame, width: int, k: int) -> DataFrame:
    """(query_id, chunk_id, similarity) of probes (query_id, vector, group_id, cell, apart, bound, held) in their cells, block by block."""
    keys = ["group_id", "cell", "r", "q"]
    asked = cut(probes.groupBy("group_id", "cell").agg(_blocks(F.max("held")).alias("rs"), _blocks(F.count(F.lit(1))).alias("qs")))
    left = probes.join(asked, ["group_id", "cell"]).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rs") - 1))).withColumn("q", F.pmod(F.xxhash64("query_id"), F.col("qs")).cast("int"))
    right = filed.join(asked, ["group_id", "cell"]).withColumn("r", F.pmod(F.xxhash64("chunk_id"), F.col("rs")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
    left, right = left.select(*keys, "query_id", "vector", "apart", "bound"), right.select(*keys, "chunk_id", "embedding", "away")
    shape = f"query_id {left.schema['query_id'].dataType.simpleString()}, chunk_id {right.schema['chunk_id'].dataType.simpleString()}, similarity double"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: _best(a, b, width, k), shape)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(cells: Cells, filed: DataFrame, queries: DataFrame, k: int, min_similarity: float = -1.0) -> tuple[DataFrame, DataFrame]:
    """((query_id, chunk_id, similarity, rank), (query_id, cells, cells_read)) of queries (query_id, vector, group_id).

    The first has each query's k nearest rows of its group, ties by chunk_id; the second how many
    cells the group has rows in and how many of them the query met.
    """
    sizes = cut(filed.groupBy("group_id", "cell").agg(F.count(F.lit(1)).alias("held"), F.min("away").alias("near"), F.max("away").alias("far")))
    near, far = np.full(len(cells.centroids), 1.0), np.full(len(cells.centroids), 0.0)
    for r in sizes.groupBy("cell").agg(F.min("near").alias("near"), F.max("far").alias("far")).collect():  # at most MOST_CELLS rows
        near[r["cell"]], far[r["cell"]] = r["near"], r["far"]
    worst = float(np.sqrt(2.0 - 2.0 * min_similarity))
    asked, there = queries.where("group_id is not null").select("query_id", "vector", "group_id"), sizes.select("group_id", "cell", "held")
    first = cut(_probes(cells, (near, far), asked, worst).join(there, ["group_id", "cell"]))
    found = cut(_meet(first, filed, cells.width, k))
    last = _ranked(found, k).where(F.col("rank") == k).select("query_id", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("similarity"))).alias("kth"))
    more = cut(_probes(cells, (near, far), asked.join(last, "query_id", "left"), worst).join(there, ["group_id", "cell"]))
    hits = _ranked(found.unionByName(_meet(more, filed, cells.width, k)).where(F.col("similarity") >= min_similarity), k)
    read = first.select("query_id").unionByName(more.select("query_id")).groupBy("query_id").agg(F.count(F.lit(1)).alias("cells_read"))
    per_group = there.groupBy("group_id").agg(F.count(F.lit(1)).alias("cells"))
    report = asked.join(per_group, "group_id").join(read, "query_id", "left").select("query_id", "cells", F.coalesce("cells_read", F.lit(0)).cast("long").alias("cells_read"))
    return hits, report
