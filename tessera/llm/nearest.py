"""Approximate nearest neighbours by cross-polytope hashing.

A table turns a unit vector by a fast Hadamard pseudo-rotation (three rounds of random signs
and a Walsh-Hadamard transform, padded with zeros to a power of two) and files it under the
nearest signed axis: the largest coordinate and its sign. Every vector is filed in all tables.

A query probes in two rounds. The first looks into the buckets of its nearest few axes in one
table and gives a fifth cosine ``c``; the true fifth neighbour is at least as near. The second
round turns that into probes: of a number of random unit vectors at cosine ``c`` from the
query it finds the bucket each lies in, and it probes all (table, axis) buckets whose axis is at
least as near to the query as is needed to meet the stated share of those vectors, the
nearest axes of all tables first. So a query in a dense cluster looks into one or two buckets,
and one among scattered vectors into many; where that comes to more buckets than one table
has, or the first round found too few, it looks into all buckets of one table, which is an
exact search. Candidates are ranked by their exact cosines; no bucket and no list of candidates
has a bound.

Buckets are split into blocks of a bounded number of vectors and of queries, so a bucket with
a third of all rows is many tasks; a block is one matrix product and gives k rows a query.
The work of a query on scattered vectors is a fixed share of all rows (about half at 64
components), of one in a cluster its bucket's share.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without an
id, take no part. Only vectors of one length meet. Rows with one id are one candidate, with the
best of their scores, and as a query the id stands with its smallest vector; they are never
each other's neighbours. Equal scores go by the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, table
from tessera.llm.vectors import dense, packed, scaled, unpacked

TABLES, ROUNDS, SEED = 3, 3, 12
#: Axes that the first round probes, random neighbours that the second one draws for a query, and the share of them it must meet.
FIRST_AXES, DRAWS, RECALL = 4, 256, 0.95
#: Vectors and queries of a block.
BLOCK = 4096
#: Rows of bucket sizes up to which they are broadcast: some 1 MB.
MOST_SIZES = 50_000
KEYS = ["width", "table_no", "code"]


def rotated(m: np.ndarray, table_no: int) -> np.ndarray:
    """Rows of a matrix under a table's pseudo-rotation, padded to the next power of two."""
    width = m.shape[1]
    size = 1 << max(0, int(width - 1).bit_length())
    signs = np.random.default_rng((SEED, width, table_no)).choice([-1.0, 1.0], (ROUNDS, size))
    out = np.zeros((len(m), size))
    out[:, :width] = m
    for flips in signs:
        out *= flips
        h = 1
        while h < size:
            pairs = out.reshape(len(m), -1, 2, h)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(m), size)
            h *= 2
        out /= np.sqrt(size)
    return out


def nearest_axis(turned: np.ndarray) -> np.ndarray:
    """The code of each row's bucket: the axis of its largest coordinate, plus the number of axes if that is negative."""
    axis = np.abs(turned).argmax(axis=1)
    return axis + turned.shape[1] * (turned[np.arange(len(turned)), axis] < 0)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _both(turned: np.ndarray) -> np.ndarray:
    """Coordinates along all signed axes."""
    return np.concatenate([turned, -turned], axis=-1)


def first_probes(unit: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, table, code) of the nearest few axes of the first table."""
    along = _both(rotated(unit, 0))
    most = min(FIRST_AXES, along.shape[1])
    near = np.argpartition(-along, most - 1, axis=1)[:, :most]
    for i, codes in enumerate(near):
        yield from ((i, 0, int(c)) for c in codes)


def second_probes(unit: np.ndarray, cosines: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, table, code) of the buckets that hold RECALL of the random vectors at each row's cosine; all of one table for a null cosine or where they'd be more."""
    width = unit.shape[1]
    drawn = np.random.default_rng((SEED, width)).standard_normal((DRAWS, width))
    turned = np.stack([rotated(drawn, t) for t in range(TABLES)])
    along = np.stack([_both(rotated(unit, t)) for t in range(TABLES)], axis=1)
    codes = along.shape[2]
    at = np.arange(DRAWS)
    for i, c in enumerate(cosines):
        probes = None
        if np.isfinite(c):
            c = min(1.0, max(-1.0, c))
            straight = drawn @ unit[i]
            aside = np.sqrt(np.maximum((drawn * drawn).sum(axis=1) - straight**2, 1e-300))
            best = np.full(DRAWS, -np.inf)
            for t in range(TABLES):
                own = along[i, t, : codes // 2]
                near = c * own + np.sqrt(1 - c * c) * (turned[t] - straight[:, None] * own) / aside[:, None]
                best = np.maximum(best, along[i, t, nearest_axis(near)][at])
            least = np.sort(best)[int((1 - RECALL) * DRAWS)]
            found = np.argwhere(along[i] >= least)
            probes = found if len(found) < codes else None
        if probes is None:
            yield from ((i, 0, k) for k in range(codes))
        else:
            yield from ((i, int(t), int(k)) for t, k in probes)


def vector_rows(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id long, width, vector binary): whole vectors that aren't zero, as they are stored."""
    kind = np.float32 if rows.schema[vector].dataType.elementType.simpleString() == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, at, m in dense(batch.column("vector")):
                some = m.any(axis=1)
                at = at[some]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(np.full(len(at), width, np.int32)), packed(m[some].astype(kind))], names=["id", "width", "vector"])

    held = rows.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("vector"))
    return held.mapInArrow(run, "id long, width int, vector binary")


def _filed(rows: DataFrame, kind: type, tables: int) -> DataFrame:
    """Each vector once a table, under its code there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths):
                some = batch.take(pa.array(np.flatnonzero(widths == width)))
                unit = _unit(scaled(unpacked(some.column("vector"), int(width), kind)))
                for t in range(tables):
                    codes = nearest_axis(rotated(unit, t)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([some.column("width"), pa.array(np.full(len(codes), t, np.int32)), pa.array(codes), some.column("id"), some.column("vector")], names=[*KEYS, "id", "vector"])

    return rows.mapInArrow(run, "width int, table_no int, code int, id long, vector binary")


def _probing(queries: DataFrame, kind: type, second: bool) -> DataFrame:
    """Each query once a bucket it looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths):
                some = batch.take(pa.array(np.flatnonzero(widths == width)))
                unit = _unit(scaled(unpacked(some.column("vector"), int(width), kind)))
                probes = second_probes(unit, some.column("cosine").to_numpy(zero_copy_only=False)) if second else first_probes(unit)
                for part in _some(probes, 8192):
                    at = pa.array(part[:, 0])
                    yield pa.RecordBatch.from_arrays([some.column("width").take(at), pa.array(part[:, 1].astype(np.int32)), pa.array(part[:, 2].astype(np.int32)), some.column("id").take(at), some.column("vector").take(at)], names=[*KEYS, "id", "vector"])

    return queries.mapInArrow(run, "width int, table_no int, code int, id long, vector binary")


def _some(probes: Iterator[tuple[int, int, int]], most: int) -> Iterator[np.ndarray]:
    held = []
    for p in probes:
        held.append(p)
        if len(held) == most:
            yield np.array(held)
            held = []
    if held:
        yield np.array(held)


def best_in_block(queries: pa.Table, vectors: pa.Table, kind: type, k: int) -> pa.Table:
    """(query_id, vec_id, score) of each query's k nearest in a block, ids in order on ties; an id counts once."""
    out: list[tuple[int, int, float]] = []
    if len(queries) and len(vectors):
        width = queries.column("width")[0].as_py()
        q, x = (scaled(unpacked(side.column("vector"), width, kind)) for side in (queries, vectors))
        ids, own = vectors.column("id").to_numpy(), queries.column("id").to_numpy()
        norms, lengths = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        for start in range(0, len(q), 512):  # a bounded matrix at a time
            near = _unit(q[start : start + 512]) @ _unit(x).T
            near[own[start : start + 512, None] == ids[None, :]] = -np.inf
            for i, row in enumerate(near, start):
                some = np.flatnonzero(row > -np.inf)
                if len(some) > k:
                    some = some[row[some] >= np.partition(row[some], len(some) - k)[len(some) - k] - 1e-9]
                # The same sum for a pair of vectors in whatever block they meet.
                scores = np.clip((x[some] * q[i]).sum(axis=1) / (norms[some] * lengths[i]), -1, 1)
                place = np.lexsort((ids[some], -scores))
                _, once = np.unique(ids[some][place], return_index=True)
                out += [(own[i], ids[some][j], scores[j]) for j in place[np.sort(once)[:k]]]
    columns = list(zip(*out)) or [(), (), ()]
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])


def _met(probes: DataFrame, filed: DataFrame, codes: DataFrame, kind: type, k: int) -> DataFrame:
    """Best rows of all pairs of blocks. codes has (width, table_no, code, vectors): how many vectors a bucket holds."""
    asked = probes.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("queries"))
    blocks = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("int")
    sizes = cut(codes.join(asked, KEYS).select(*KEYS, blocks("vectors").alias("xs"), blocks("queries").alias("qs")))
    # The bound on what is broadcast is checked; beyond it the join is left to the engine.
    sizes = F.broadcast(sizes) if sizes.count() <= MOST_SIZES else sizes

    def dealt(rows: DataFrame, own: str, other: str, copies: str, salt: Column) -> DataFrame:
        held = rows.join(sizes, KEYS).withColumn(own, F.pmod(salt, F.col(f"{own[0]}s")).cast("int"))
        return held.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(copies) - 1))).select(*KEYS, "x_block", "q_block", "id", "vector")

    left = dealt(probes, "q_block", "x_block", "xs", F.xxhash64("id"))
    right = dealt(filed, "x_block", "q_block", "qs", F.xxhash64("id", "vector"))
    keys = [*KEYS, "x_block", "q_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: best_in_block(a, b, kind, k), "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def neighbours(rows: DataFrame, asked: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``asked`` holds its k nearest other rows found, by cosine."""
    kind = np.float32 if rows.schema[vector].dataType.elementType.simpleString() == "float" else np.float64
    held = vector_rows(rows, id_column, vector)
    queries = vector_rows(rows.where(asked), id_column, vector).groupBy("id", "width").agg(F.min("vector").alias("vector"))
    queries = cut(queries.groupBy("id").agg(F.min(F.struct("width", "vector")).alias("q")).select("id", "q.width", "q.vector"))

    codes = cut(_filed(held, kind, TABLES).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("vectors")))
    first = cut(_met(_probing(queries, kind, False), _filed(held, kind, 1), codes, kind, k))
    last = _ranked(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("cosine"))
    # The cosine is taken off by a hair so that a query's own copies count as nearest.
    probes = cut(_probing(queries.join(last, "id", "left"), kind, True))
    found = cut(_met(probes, _filed(held, kind, TABLES), codes, kind, k))
    return _ranked(found.unionByName(first), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of every embedding whose vec_id is divisible by 50."""
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
