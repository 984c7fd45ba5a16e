"""Benchmark decontamination by size-partitioned MinHash containment search.

An item counts as leaked into a document when at least ``percent`` of its distinct word
shingles occur there, however long the document is. Items are partitioned by size, in powers
of two. An item of n shingles is indexed under its bottom-m MinHash sketch with
``m = n - ceil(percent n / 100) + 1``: so many shingles can't all be missing from a document
that holds the item, so no leak is lost. For each size class, documents are probed with a
bitmap of fixed size that holds the class's sketches, up to the class's largest sketch hash;
documents that are too small for a class skip it. A document with a hit also gives its
shingles that any item has, from which the containment of each candidate is counted exactly.

An item of fewer words than a shingle is one shingle as a whole, and leaks into every document
that holds its words in a row: documents are searched for all their runs of the lengths that
such items have, at most four, against a bitmap of those items.

Words are runs without ASCII white space, A-Z lower-cased. Null and empty texts match nothing. Null ids stay null in
the result; rows of one id with different texts are searched apart, and equal results appear
once. Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_memory, cut, table
from tessera.llm.shingles import shingle_and_gram_sets, word_hashes

#: Bits of a bitmap; 1 MB, whatever the number of items.
BITS = 1 << 23


def _item_shingles(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ns, hs, sketch, words = [], [], [], [], []
            lengths = np.diff(word_hashes(batch.column(1))[1]).tolist()
            for item_id, length, (s, _) in zip(batch.column(0).to_pylist(), lengths, shingle_and_gram_sets(batch.column(1), size, ())):
                m = len(s) + -percent * len(s) // 100 + 1 if len(s) else 0
                ids += [item_id] * len(s)
                ns += [len(s)] * len(s)
                hs.append(s.view(np.int64))
                sketch += [True] * m + [False] * (len(s) - m)
                words += [length] * len(s)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int32()), pa.array(np.concatenate([*hs, np.zeros(0, np.int64)])), pa.array(sketch, pa.bool_()), pa.array(words, pa.int32())], ["item_id", "n", "h", "sketch", "words"])

    return run


def _bitmap(rows: DataFrame) -> bytes:
    """Bits of the column h, eight to a byte; at most BITS / 32 rows reach the driver."""
    words = rows.groupBy(F.expr(f"cast(shiftright(h & {BITS - 1}L, 5) as int)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 31L as int)))").alias("bits")).collect()
    held = np.zeros(BITS // 32, "<u4")
    for r in words:
        held[r["w"]] = r["bits"]
    return held.tobytes()


def _set_in(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit in a bitmap, which stays packed: a byte for each bit would be 8 MB for each class and worker."""
    at = hashes & np.uint64(BITS - 1)
    return (held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _probe(classes: list[tuple[int, int, bytes]], every: bytes, size: int, shorter: tuple[int, ...], short: bytes):
    """classes: (least number of a document's shingles, largest sketch hash, packed bitmap); shorter: the lengths of items below size, and short: their bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = lambda x: np.frombuffer(x, np.uint8)
        held, brief, sketches = packed(every), packed(short), [(least, np.uint64(top), packed(x)) for least, top, x in classes]
        for batch in batches:
            ids, marks, hs = [], [], []
            for doc_id, (s, runs) in zip(batch.column(0).to_pylist(), shingle_and_gram_sets(batch.column(1), size, shorter)):
                met = runs[_set_in(brief, runs)]
                found = any(len(s) >= least and _set_in(bits, s[: np.searchsorted(s, top, side="right")]).any() for least, top, bits in sketches)
                if found or len(met):
                    own = np.unique(np.concatenate([s[_set_in(held, s)] if found else s[:0], met])).view(np.int64)
                    ids += [doc_id] * len(own)
                    marks += [int(np.bitwise_xor.reduce(s).view(np.int64))] * len(own)
                    hs.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(np.concatenate([*hs, np.zeros(0, np.int64)]))], ["doc_id", "mark", "h"])

    return run


def leaks(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_shingles, shared, containment) for items (item_id, text) in docs (doc_id, text)."""
    with bounded_memory(docs.sparkSession):
        own = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
        shingles = cut(own.mapInArrow(_item_shingles(size, percent), "item_id long, n int, h long, sketch boolean, words int"))
        sketches = shingles.where("sketch").withColumn("kind", F.when(F.col("words") < size, -1).otherwise(F.floor(F.log2("n")).cast("int")))
        # Hashes are unsigned; with the top bit turned over, their order is that of signed numbers.
        top = F.max(F.col("h").bitwiseXOR(F.lit(-(1 << 63))))
        kinds = sorted((r["kind"], r["least"], r["top"] + (1 << 63)) for r in sketches.where("kind >= 0").groupBy("kind").agg(F.min("n").alias("least"), top.alias("top")).collect())
        classes = [(-(-percent * least // 100), high, _bitmap(sketches.where(F.col("kind") == kind))) for kind, least, high in kinds]

        brief = sketches.where("kind < 0")
        shorter = tuple(sorted(r["words"] for r in brief.select("words").distinct().collect()))

        texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        hits = cut(texts.mapInArrow(_probe(classes, _bitmap(shingles.where(F.col("words") >= size)), size, shorter, _bitmap(brief)), "doc_id long, mark long, h long"))
    candidates = hits.join(sketches.select("h", "item_id"), "h").select("doc_id", "mark", "item_id").distinct()
    # Only a candidate's own shingles are looked up, so frequent shingles of other items cost nothing.
    wanted = candidates.alias("c").join(shingles.alias("s"), F.expr("c.item_id <=> s.item_id")).select("c.*", "s.h", "s.n")
    met = wanted.alias("w").join(hits.distinct().alias("d"), F.expr("w.doc_id <=> d.doc_id and w.mark = d.mark and w.h = d.h"), "left_semi")
    counted = met.groupBy("doc_id", "mark", "item_id").agg(F.max("n").alias("n_shingles"), F.countDistinct("h").cast("int").alias("shared"))
    found = counted.where(100 * F.col("shared") >= percent * F.col("n_shingles"))
    return found.select("doc_id", "item_id", "n_shingles", "shared", (F.col("shared") / F.col("n_shingles")).alias("containment")).distinct()


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, by 5-word shingles at 80 of 100."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id AS id, 0 AS kind, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT item_id, 1, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
s AS (
  SELECT DISTINCT id, kind, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                   ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM w WHERE kind = 1 OR len(w) >= 5
  UNION
  SELECT id, 0, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')))
  FROM w, (SELECT DISTINCT len(w) AS n FROM w WHERE kind = 1 AND len(w) BETWEEN 1 AND 4) WHERE kind = 0 AND len(w) >= n),
n AS (SELECT id, count(*)::INT AS n FROM s WHERE kind = 1 GROUP BY id),
p AS (SELECT d.id AS doc_id, b.id AS item_id, count(*)::INT AS shared FROM s d JOIN s b ON d.s = b.s AND d.kind = 0 AND b.kind = 1 GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_shingles, shared, shared::DOUBLE / n AS containment FROM p JOIN n ON n.id = item_id WHERE 100 * shared >= 80 * n
"""
