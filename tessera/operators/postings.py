"""A positional inverted index: which chunks hold a stem, and at which places.

Texts are read once, when the index is built; ranks of a whole table of questions then come from
the postings of their stems in one plan. Written postings lie in buckets by a hash of the stem,
so the scan of a search opens the buckets of its stems only.

Two analyzers: 'stem' takes Portuguese stems without stop words, as ``question_rank`` does; 'word'
takes lower-case words as they are, as ``ts_rank`` does. Null and empty texts have no postings.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ranking import MOST_PLACES, rank_of_places, split_words
from tessera.functions.stems import STOP, stem
from tessera.session import cut

#: Characters of text that are taken apart at once, and rows of asked stems up to which they are broadcast (some 10 MB).
GROUP, MOST_ASKED = 1 << 20, 100_000
_PLAIN = re.compile(r"[^\W_]+")

#: By analyzer, the words of a text in order and what is kept of a word (None: nothing, but it has a place).
ANALYZERS: dict[str, tuple[Callable[[str], list[str]], Callable[[str], str | None]]] = {
    "stem": (split_words, lambda w: None if w in STOP else stem(w)),
    "word": (lambda text: _PLAIN.findall(text.lower()), lambda w: w),
}


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= GROUP:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _posted(texts: list[str | None], analyzer: str) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """(stems, rows, places) of some texts, one entry a text and stem; a stem is made once for each different word."""
    split, kept = ANALYZERS[analyzer]
    words = [split(t) if t else [] for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    coded = pc.dictionary_encode(pa.array([w for ws in words for w in ws], pa.string()))
    stems = pc.dictionary_encode(pa.array([kept(w) for w in coded.dictionary.to_pylist()], pa.string()))
    of_word = pc.fill_null(stems.indices, -1).to_numpy(zero_copy_only=False)
    codes = of_word[coded.indices.to_numpy(zero_copy_only=False)] if len(of_word) else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(texts)), counts)
    places = np.arange(len(codes)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
    some = codes >= 0
    codes, rows, places = codes[some], rows[some], places[some]
    order = np.lexsort((places, codes, rows))
    codes, rows, places = codes[order], rows[order], places[order]
    starts = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1])])) if len(codes) else np.zeros(0, np.int64)
    held = pa.ListArray.from_arrays(pa.array(np.append(starts, len(codes)).astype(np.int32)), pa.array(places.astype(np.int32)))
    return stems.dictionary.take(pa.array(codes[starts], pa.int64())), rows[starts], held


def postings(chunks: DataFrame, analyzer: str = "stem") -> DataFrame:
    """(stem, chunk_id, places) of chunks (chunk_id, text): places count all words from 1, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _groups(texts):
                stems, rows, places = _posted(texts[a:b], analyzer)
                yield pa.RecordBatch.from_arrays([stems, batch.column("chunk_id").take(pa.array(rows + a)), places], names=["stem", "chunk_id", "places"])

    return chunks.select("chunk_id", "text").mapInArrow(run, f"stem string, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, places array<int>")


def write(index: DataFrame, path: str, buckets: int = 64) -> None:
    """Postings as Parquet folders by bucket, sorted by stem, so that row groups of other stems are skipped as well."""
    dealt = index.withColumn("bucket", F.pmod(F.xxhash64("stem"), F.lit(buckets)).cast("int"))
    dealt.repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).sortWithinPartitions("bucket", "stem", "chunk_id").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str, asked: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """Written postings; of some stems only their buckets are listed in the scan's filter."""
    held = spark.read.parquet(path)
    if asked is not None:
        numbers = [r["b"] for r in spark.createDataFrame([(s,) for s in asked], "stem string").select(F.pmod(F.xxhash64("stem"), F.lit(buckets)).alias("b")).distinct().collect()]
        held = held.where(F.col("bucket").isin(numbers) & F.col("stem").isin(asked))
    return held.drop("bucket")


def asked_stems(questions: DataFrame, analyzer: str = "stem") -> DataFrame:
    """(query_id, stem, stems): each question's different stems and how many they are."""
    split, kept = ANALYZERS[analyzer]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([list(dict.fromkeys(s for w in split(t or "") if (s := kept(w)) is not None)) for t in texts])

    held = questions.select("query_id", F.pandas_udf(run, "array<string>")("question").alias("found"))
    return held.select("query_id", F.explode("found").alias("stem"), F.size("found").alias("stems"))


def ranks(index: DataFrame, questions: DataFrame, analyzer: str = "stem") -> DataFrame:
    """(query_id, chunk_id, rank): the rank of every chunk for every question (query_id, question) where it isn't 0.

    Asked stems meet the postings, a chunk's postings for a question come together, and the rank
    is worked out from their places: of a stem the first MOST_PLACES, of a word all. A question of several stems ranks chunks with at least two of them.
    """
    asked = cut(asked_stems(questions, analyzer))
    # The size of what is broadcast is checked; beyond it postings and stems are joined by shuffles.
    asked = F.broadcast(asked) if asked.limit(MOST_ASKED + 1).count() <= MOST_ASKED else asked
    met = index.join(asked, "stem").groupBy("query_id", "chunk_id").agg(F.max("stems").alias("stems"), F.collect_list("places").alias("held"))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([rank_of_places([p[:most] for p in x]) for x in rows], dtype="float64")

    most = MOST_PLACES if analyzer == "stem" else None
    some = met.where((F.size("held") > 1) | (F.col("stems") == 1))
    return some.select("query_id", "chunk_id", F.pandas_udf(run, "double")("held").alias("rank")).where("rank > 0")


def term_counts(index: DataFrame, questions: DataFrame, analyzer: str = "word") -> DataFrame:
    """(query_id, chunk_id, hits): how many of a question's words a chunk holds, without those where it holds none."""
    asked = asked_stems(questions, analyzer)
    return index.join(asked, "stem").groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("hits"))
