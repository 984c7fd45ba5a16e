"""Hard-negative mining by blocked dense matrix products.

Components become the integers floor(256 * x), so float64 products are exact below 2^53; a block
whose products might not be is multiplied in Python's integers, and a score beyond a long is
clipped to one. Anchors are dealt into blocks of bounded bytes. A block is broadcast and meets
all rows tile by tile where they are stored, so rows aren't shuffled: a first pass leaves each
task's best 5 rows of an anchor's own label, which merge into the anchor's positives; these are
broadcast with the block, and a second pass leaves each task's best 3 rows of other labels
inside each positive's window. Only these few rows a task and anchor are shuffled.

Rows without an id or a label and those whose vector is null, empty or holds a null or
non-finite component take no part; vectors of different lengths don't meet. An anchor's other
rows are those with other ids; rows that repeat an id each count, as anchors and as what is
found. Scores that tie go by the smaller id. An empty table or no anchor gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, table
from tessera.llm.vectors import dense

#: Bytes of vectors in a block of anchors: what is broadcast at once, whatever the table holds.
BLOCK_BYTES = 32 << 20
#: Rows and anchors of a tile; the rows' places in it must fit into PLACE_BITS.
TILE, ANCHORS, PLACE_BITS = 8192, 512, 13
NONE = np.iinfo(np.int64).min


def whole_numbers(m: np.ndarray) -> np.ndarray:
    """floor(256 * x) of every component."""
    return np.floor(256.0 * m)


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of two matrices of whole numbers, as int64."""
    bound = np.abs(a).max(initial=0) * np.abs(x).max(initial=0) * a.shape[1]
    if bound < 2.0**53:
        return (a @ x.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    found = exact(a) @ exact(x).T
    return np.clip(found, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, open_: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of each row's k best places among the open ones, ids being ascending; NONE where there are fewer."""
    k = min(k, len(ids))
    if np.abs(scores).max(initial=0) < 1 << (62 - PLACE_BITS):
        # One number for score and place: no two are equal, so the partition is exact.
        keys = np.where(open_, (scores << PLACE_BITS) + (TILE - 1 - np.arange(len(ids))), NONE)
        if k < len(ids):
            at = np.argpartition(keys, len(ids) - k, axis=1)[:, len(ids) - k :]
        else:
            at = np.broadcast_to(np.arange(len(ids)), keys.shape)
        held = np.take_along_axis(keys, at, 1) > NONE
    else:
        at = np.argsort(np.where(open_, -scores.astype(object), 1 << 70), axis=1, kind="stable")[:, :k]
        held = np.take_along_axis(open_, at, 1)
    return np.where(held, np.take_along_axis(scores, at, 1), NONE), np.where(held, ids[at], NONE)


def merged(old: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The best of two lists of each row, as many as the first has."""
    k = old[0].shape[-1]
    scores, ids = (np.concatenate(pair, axis=-1) for pair in zip(old, new))
    order = np.lexsort((ids, ~scores), axis=-1)[..., :k]  # ~ reverses without overflow
    return np.take_along_axis(scores, order, -1), np.take_along_axis(ids, order, -1)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids ascending, labels, whole numbers) of the rows that take part, one length at a time."""
    for batch in batches:
        for _, rows, m in dense(batch.column("vector")):
            ids, labels = (batch.column(c).take(pa.array(rows)).to_numpy(zero_copy_only=False) for c in ("id", "label"))
            order = np.argsort(ids, kind="stable")
            for start in range(0, len(order), TILE):
                at = order[start : start + TILE]
                yield ids[at], labels[at], whole_numbers(m[at])


class Block:
    """A block of anchors of one length, as it is broadcast."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, numbers: np.ndarray):
        self.ids, self.labels, self.numbers = ids, labels, numbers

    def positives(self, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
        """(anchor, 0, vec_id, score) of a task's k best rows of each anchor's label."""
        held = np.full((2, len(self.ids), k), NONE)
        for ids, labels, numbers in _tiles(batches):
            if numbers.shape[1] != self.numbers.shape[1]:
                continue
            for label in np.intersect1d(labels, self.labels):
                mine, theirs = np.flatnonzero(self.labels == label), np.flatnonzero(labels == label)
                for start in range(0, len(mine), ANCHORS):
                    at = mine[start : start + ANCHORS]
                    found = best(products(self.numbers[at], numbers[theirs]), self.ids[at, None] != ids[theirs], ids[theirs], k)
                    held[:, at] = merged((held[0, at], held[1, at]), found)
        yield from _shown(held[:, :, None])

    def negatives(self, batches: Iterator[pa.RecordBatch], low: np.ndarray, high: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
        """(anchor, positive's place, vec_id, score) of a task's k best rows of other labels with scores from low to high."""
        held = np.full((2, *low.shape, k), NONE)
        for ids, labels, numbers in _tiles(batches):
            if numbers.shape[1] != self.numbers.shape[1]:
                continue
            for start in range(0, len(self.ids), ANCHORS):
                at = slice(start, start + ANCHORS)
                scores = products(self.numbers[at], numbers)
                other = (self.labels[at, None] != labels) & (self.ids[at, None] != ids)
                for p in range(low.shape[1]):
                    inside = other & (scores >= low[at, p, None]) & (scores <= high[at, p, None])
                    held[:, at, p] = merged((held[0, at, p], held[1, at, p]), best(scores, inside, ids, k))
        yield from _shown(held)


def _shown(held: np.ndarray) -> Iterator[pa.RecordBatch]:
    anchor, place, _ = found = np.nonzero(held[0] > NONE)
    for start in range(0, len(anchor), 65_536):
        some = slice(start, start + 65_536)
        at = tuple(x[some] for x in found)
        yield pa.RecordBatch.from_arrays([pa.array(anchor[some].astype(np.int32)), pa.array(place[some].astype(np.int32)), pa.array(held[1][at]), pa.array(held[0][at])], names=["anchor", "place", "vec_id", "score"])


FOUND = "anchor int, place int, vec_id long, score long"


def _first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _mined(rows: DataFrame, block: Block, positives: int, negatives: int) -> DataFrame:
    """What one block of anchors gives."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(block)
    near = _first(rows.mapInArrow(lambda b: shared.value.positives(b, positives), FOUND), positives).select("anchor", "rank", "vec_id", "score").toArrow()
    low, high = np.full((len(block.ids), positives), 1), np.full((len(block.ids), positives), 0)
    anchor, rank, vec_id, score = (near.column(c).to_numpy() for c in near.column_names)
    # 50 * p <= 100 * n <= 95 * p in whole numbers; positives that aren't there keep an empty window.
    low[anchor, rank - 1] = [-(-int(p) // 2) for p in score]
    high[anchor, rank - 1] = [95 * int(p) // 100 for p in score]
    windows = spark.sparkContext.broadcast((low, high))
    found = cut(_first(rows.mapInArrow(lambda b: shared.value.negatives(b, *windows.value, negatives), FOUND), negatives))
    # Names and scores of the block's positives: as bounded as the block.
    known = spark.createDataFrame(pa.table([pa.array(anchor, pa.int32()), pa.array((rank - 1).astype(np.int32)), pa.array(block.ids[anchor]), pa.array(vec_id), pa.array(score)], names=["anchor", "place", "anchor_id", "positive_id", "positive_score"]))
    out = found.join(known, ["anchor", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    shared.unpersist()
    windows.unpersist()
    return out


def mine(rows: DataFrame, asked: Column, label: Column, positives: int = 5, negatives: int = 3, id_column: str = "vec_id", vector: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows for which ``asked`` holds.

    The driver holds one block of anchors at a time; there is one pair of passes over the rows a block.
    """
    held = rows.select(F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("vector"), F.coalesce(asked, F.lit(False)).alias("asked")).where("id is not null and label is not null and vector is not null")
    anchors = cut(held.where("asked").select("id", "label", "vector", F.size("vector").alias("width")))
    sizes = anchors.groupBy("width").agg(F.count(F.lit(1)).alias("n")).orderBy("width")
    out = rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for width, n in ((r["width"], r["n"]) for r in sizes.toLocalIterator()):
        blocks = -(-n * width * 8 // block_bytes)
        own = anchors.where(F.col("width") == width).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
        for b in range(blocks):
            ids, labels, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for batch in own.where(F.col("block") == b).select("id", "label", "vector").toArrow().to_batches():
                for i, x, m in _tiles([batch]):
                    ids.append(i)
                    labels.append(x)
                    numbers.append(m)
            if numbers:
                found = _mined(held.select("id", "label", "vector"), Block(np.concatenate(ids), np.concatenate(labels), np.concatenate(numbers)), positives, negatives)
                out = out.unionByName(found)
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every embedding whose vec_id is divisible by 50, with the contract's labels."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


ORACLE_SQL = r"""
WITH w AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor_id, a.label AS own, r.id, r.label, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM w a JOIN w r ON a.id <> r.id AND len(a.v) = len(r.v) WHERE a.id % 50 = 0),
p AS (SELECT anchor_id, own, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE label = own QUALIFY place <= 5),
n AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, place ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE s.label <> p.own AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score)
SELECT * FROM n WHERE rank <= 3
"""
