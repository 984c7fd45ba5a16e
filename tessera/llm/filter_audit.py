"""Filter interaction audit: what each of several filters removes alone, together and in every order.

A first pass over the texts finds each document's failures. They then lie as a packed bitmap
index: per batch of a partition one NumPy bitset a filter, a label and a part, where rows are
put in order of their parts so that a part is a range of bytes however many there are. For each
subset of the filters the bitset of the documents that pass it is the bitset of a smaller
subset AND NOT one filter; its popcounts by part, alone and under the labels, are what a
partition gives. Partitions' counts add up, and every order's every step is a difference of two
of them, since what is left after some filters doesn't depend on their order.

Null texts are empty, a null part is the empty string; rows that repeat an id are rows of their
own, and equal ids never make one a copy of the other; a null id is neither a copy nor an
original; labels of an id count as 1 if any of its label rows says so. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, table
from tessera.llm.shingles import groups

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Parts whose sums a task holds before it passes them on.
MOST_PARTS = 4096
_MARKS = np.isin(np.arange(256), np.frombuffer(b"#$%&*|", np.uint8))
_UPPER = (np.arange(256) >= ord("A")) & (np.arange(256) <= ord("Z"))


def _per_row(hits: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many hits lie in each row, rows ending at ends."""
    return np.diff(np.concatenate([[0], np.cumsum(hits)])[np.concatenate([[0], ends])])


def failures(texts: pa.Array) -> np.ndarray:
    """Bits 0 to 3 of each text: fails A, B, C and D. Nothing here is null."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    raw = np.frombuffer(b"".join(texts.cast(pa.large_binary()).to_pylist()), np.uint8)
    lists = pc.ascii_split_whitespace(texts)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    held = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    owner, codes = owner[held], pc.dictionary_encode(flat).indices.to_numpy(zero_copy_only=False)[held]
    words = np.bincount(owner, minlength=len(texts))
    pairs = np.unique(owner.astype(np.int64) << 32 | codes)
    distinct = np.bincount(pairs >> 32, minlength=len(texts))
    points = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    return (words < 100) | (100 * distinct < 80 * words) << 1 | (100 * _per_row(_UPPER[raw], ends) > 10 * points) << 2 | (_per_row(_MARKS[raw], ends) > 0) << 3


def flagged(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text, lang): doc_id, part, fails (bits A to D), digest (sha256 of the text). Texts are read once and go no further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            for a, b in groups(texts):
                some = texts.take(pa.array(np.arange(a, b)))
                digests = pa.array([hashlib.sha256(x).digest() for x in some.cast(pa.large_binary()).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("part").slice(a, b - a), pa.array(failures(some), pa.int32()), digests], names=["doc_id", "part", "fails", "digest"])

    rows = docs.select("doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, fails int, digest binary")


def with_copies(flags: DataFrame) -> DataFrame:
    """flags with bit 4 set where the text is that of a smaller id.

    Only digests that several rows share are joined; the first ids are cut off from their
    aggregation, so a digest with a third of all rows is split by the join.
    """
    firsts = flags.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("held")).where("held > 1 and first_id is not null").select(F.col("digest").alias("copied"), "first_id")
    joined = flags.join(cut(firsts), F.col("digest") == F.col("copied"), "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return joined.select("doc_id", "part", (F.col("fails") + F.when(copy, 16).otherwise(0)).alias("fails"))


def subset_counts(rows: DataFrame) -> DataFrame:
    """(part, fails bits, good, toxic) to (part, subset, kept, good_kept, toxic_kept): documents that pass all filters of a subset, for all subsets."""

    def count(batch: pa.RecordBatch, held: dict[str, np.ndarray]) -> None:
        coded = pc.dictionary_encode(batch.column("part"))
        names, part = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(part, kind="stable")
        size = np.bincount(part, minlength=len(names))
        # Each part starts at a byte of its own.
        room = (size + 7) // 8
        start = np.concatenate([[0], np.cumsum(room)])
        place = np.arange(len(part)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[:-1] * 8, size)

        def bitset(flags: np.ndarray) -> np.ndarray:
            out = np.zeros(start[-1] * 8, bool)
            out[place] = flags[order]
            return np.packbits(out)

        fails = batch.column("fails").to_numpy(zero_copy_only=False)
        failing = [bitset(fails >> f & 1 == 1) for f in range(len(FILTERS))]
        labels = [bitset(batch.column(x).to_numpy(zero_copy_only=False).astype(bool)) for x in ("good", "toxic")]
        kept = [bitset(np.ones(len(part), bool))]
        for s in range(1, SUBSETS):
            low = (s & -s).bit_length() - 1
            kept.append(kept[s & (s - 1)] & ~failing[low])
        found = np.empty((len(names), SUBSETS, 3), np.int64)
        for s, bits in enumerate(kept):
            for k, seen in enumerate((bits, bits & labels[0], bits & labels[1])):
                found[:, s, k] = np.add.reduceat(np.bitwise_count(seen).astype(np.int64), start[:-1])
        for name, x in zip(names, found):
            held[name] = held[name] + x if name in held else x

    def shown(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        sums = np.concatenate([*held.values(), np.zeros((0, 3), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(held), object), SUBSETS), pa.string()), pa.array(np.tile(np.arange(SUBSETS, dtype=np.int32), len(held)), pa.int32()), *[pa.array(sums[:, k], pa.int64()) for k in range(3)]], names=["part", "subset", "kept", "good_kept", "toxic_kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if len(batch):
                count(batch, held)
            if len(held) > MOST_PARTS:
                yield shown(held)
                held = {}
        if held:
            yield shown(held)

    counts = rows.select("part", "fails", "good", "toxic").mapInArrow(run, "part string, subset int, kept long, good_kept long, toxic_kept long")
    return counts.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("kept", "good_kept", "toxic_kept")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step; see the module for the columns' meaning."""
    spark = docs.sparkSession
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = with_copies(cut(flagged(docs)))
    rows = rows.join(said, F.col("doc_id") == F.col("labelled"), "left").select("part", "fails", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("good", "toxic")])
    counts = cut(subset_counts(rows))

    # Each filter after each subset without it: differences of two subsets' counts.
    pairs = [(s, s | 1 << f, f, math.factorial(bin(s).count("1")) * math.factorial(len(FILTERS) - 1 - bin(s).count("1"))) for f in range(len(FILTERS)) for s in range(SUBSETS) if not s >> f & 1]
    pairs = F.broadcast(spark.createDataFrame(pairs, "subset int, after int, filter int, orders int"))
    after = counts.select("part", F.col("subset").alias("after"), F.col("kept").alias("kept_after"), F.col("good_kept").alias("good_after"), F.col("toxic_kept").alias("toxic_after"))
    steps = counts.join(pairs, "subset").join(after, ["part", "after"])
    steps = steps.select("part", "filter", "orders", F.col("subset").alias("before"), F.col("kept_after").alias("kept"), (F.col("kept") - F.col("kept_after")).alias("removed"), (F.col("good_kept") - F.col("good_after")).alias("good_lost"), (F.col("toxic_kept") - F.col("toxic_after")).alias("toxic_lost"))
    first, last = F.col("before") == 0, F.expr(f"before = {SUBSETS - 1} - shiftleft(1, filter)")
    alone = steps.groupBy("part", "filter").agg(F.max(F.when(first, F.col("removed"))).alias("fails"), F.max(F.when(last, F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    steps = steps.join(alone, ["part", "filter"])
    walks = [("".join(FILTERS[f] for f in order), k + 1, sum(1 << f for f in order[:k]), order[k]) for order in itertools.permutations(range(len(FILTERS))) for k in range(len(FILTERS))]
    walks = F.broadcast(spark.createDataFrame(walks, "filter_order string, step int, before int, filter int"))
    return steps.join(walks, ["before", "filter"]).select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in all 120 orders, by language."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
m AS (SELECT t AS same, min(doc_id) AS first_id FROM w GROUP BY t),
l AS (SELECT doc_id AS labelled, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > first_id, false)::INT AS fails
  FROM w JOIN m ON t = same LEFT JOIN l ON doc_id = labelled),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
x(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
p AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM p, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (fails & (before | own) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (fails & before = 0 AND fails & own > 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (fails & before > 0 AND fails & own > 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (fails & before = 0 AND fails & own > 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (fails & before = 0 AND fails & own > 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own, before)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
