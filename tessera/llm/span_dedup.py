"""Substring dedup by sliding sentence spans.

A text's words are cut into sentences after each word that ends in ``.``, ``!`` or ``?`` and,
where ``WINDOW`` words in a row have no such end, after the one of them with the least hash:
sentences have at most ``WINDOW`` words, and where they end hangs on the words around alone.
A second cut does the same line by line, so that short lines align in whatever text they stand.
From every sentence of either cut on, the shortest run of at least ``LEAST_SENTENCES`` sentences
and ``LEAST_WORDS`` words is hashed; so is the shortest such run that ends the text. A text too
short for one has none and stays as it is, whether others say the same or not. Runs are joined over all documents; every word in a run that is
repeated elsewhere goes, except in the run's first place by (doc_id, word). Case and white space
don't matter.

Two passages with the same words share all ends but those in their first and last ``WINDOW``
words, and a run has at most ``LEAST_WORDS`` + ``WINDOW`` - 1 words. So any 50 shared words hold
a whole run, wherever they stand; of a longer passage, words at its edges may stay.

Null and empty texts stay as they are. Rows with a null id are neither searched nor changed;
rows that share an id count as one document. Repeats inside a document count as well. An
empty table gives an empty result. Columns ``n_sentences`` and ``n_removed`` of docs are replaced,
all others are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, free_name, table

LEAST_SENTENCES = 2
LEAST_WORDS = 15
WINDOW = 12
TOKEN = re.compile(r"\S+")
BASE = 0x9E3779B97F4A7C15


@lru_cache(4)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of BASE and of its inverse modulo 2^64."""
    both = []
    for x in (BASE, pow(BASE, -1, 1 << 64)):
        held = np.full(size, x, np.uint64)
        held[0] = 1
        both.append(np.cumprod(held, dtype=np.uint64))
    return both[0], both[1]


def ends(keys: np.ndarray) -> np.ndarray:
    """0 and the places after those words whose key is 0 or the least of some WINDOW words in a row, and after the last word."""
    picked = keys == 0
    if len(keys) >= WINDOW:
        low, width = keys, 1
        while width < WINDOW:
            step = min(width, WINDOW - width)
            low, width = np.minimum(low[:-step], low[step:]), width + step
        high, width = np.concatenate([np.zeros(WINDOW - 1, np.uint64), low, np.zeros(WINDOW - 1, np.uint64)]), 1
        while width < WINDOW:
            step = min(width, WINDOW - width)
            high, width = np.maximum(high[:-step], high[step:]), width + step
        picked |= keys == high
    picked[-1] = True
    return np.concatenate([[0], np.flatnonzero(picked) + 1])


def sentences(text: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The hashes of a text's lower-case words, and the ends of its sentences: 0 first, by words alone and, if it differs, by lines too."""
    words, lines = [], []
    for line in text.lower().split("\n"):
        words += line.split()
        lines.append(len(words))
    size = len(words)
    if not size:
        return np.zeros(0, np.uint64), [np.zeros(1, np.int64)]
    encoded = [w.encode("utf-8", "replace") for w in words]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, encoded), np.uint64, size)
    keys = hashes | np.uint64(1)
    keys[np.fromiter([w[-1] in b".!?" for w in encoded], bool, size)] = 0
    cuts = [ends(keys)]
    lines = np.array([x - 1 for x in lines if 0 < x < size], np.int64)
    if keys[lines].any():
        keys[lines] = 0
        cuts.append(ends(keys))
    return hashes, cuts


def runs(hashes: np.ndarray, cuts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(first word << 20 | number of words, signed hash) of all runs."""
    size = len(hashes)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = []
    for at in cuts:
        last = np.maximum(np.searchsorted(at, at + LEAST_WORDS), np.arange(len(at)) + LEAST_SENTENCES)
        starts = at[last < len(at)]
        found.append(starts << 20 | at[last[last < len(at)]] - starts)
        tail = min(np.searchsorted(at, size - LEAST_WORDS, "right") - 1, len(at) - 1 - LEAST_SENTENCES)
        if tail >= 0:
            found.append(np.array([at[tail] << 20 | size - at[tail]]))
    places = np.unique(np.concatenate(found))
    a, n = places >> 20, places & 0xFFFFF
    up, down = powers(1 << max(10, (size - 1).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:size], dtype=np.uint64)])
    h = (sums[a + n] - sums[a]) * down[a] + n.astype(np.uint64)
    h = (h ^ h >> np.uint64(29)) * np.uint64(BASE)
    return places, (h ^ h >> np.uint64(32)).view(np.int64)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [runs(*sentences(text.as_py() or "")) for text in batch.column(1)]
        ids = np.repeat(np.array(batch.column(0).to_pylist(), np.int64), [len(x) for x, _ in found])
        places, hashes = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found) if found else ((), ())))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(places), pa.array(hashes)], ["doc_id", "place", "h"])


def without(text: str | None, marks) -> tuple[str | None, int, int]:
    """(text without the words of the marked runs, sentences of both cuts, sentences removed).

    A mark (place, h) whose hash isn't that of the text's run is another row's and is passed over.
    """
    if text is None:
        return None, 0, 0
    hashes, cuts = sentences(text)
    bounds = np.unique(np.concatenate(cuts))
    gone = np.zeros(len(hashes), bool)
    if marks is not None and len(marks):
        own = dict(zip(*(x.tolist() for x in runs(hashes, cuts))))
        for mark in marks:
            if own.get(mark["place"]) == mark["h"]:
                at = mark["place"] >> 20
                gone[at : at + (mark["place"] & 0xFFFFF)] = True
    if not gone.any():
        return text, len(bounds) - 1, 0
    starts = [m.start() for m in TOKEN.finditer(text)]
    kept = "".join(text[a:b] for a, b, x in zip(starts, [*starts[1:], len(text)], gone) if not x)
    return kept.strip(), len(bounds) - 1, int(gone[bounds[:-1]].sum())


def dedup_spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, …) with ``text`` cleaned, and ``n_sentences`` and ``n_removed`` (long)."""
    found = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_runs, "doc_id long, place long, h long")
    first = F.min(F.struct("doc_id", "place")).alias("first")
    # Cut, so that both sides of the join are shuffled for it and a hot run's rows can be split.
    repeated = cut(found.groupBy("h").agg(first, F.count(F.lit(1)).alias("c")).where("c > 1").select("h", "first"))
    again = found.join(repeated, "h").where("doc_id <> first.doc_id or place <> first.place")
    marked, marks, cleaned_as = (free_name(docs, x) for x in ("marked_id", "marks", "cleaned"))
    marked_rows = again.groupBy("doc_id").agg(F.collect_list(F.struct("place", "h")).alias(marks)).withColumnRenamed("doc_id", marked)

    def clean(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, held in batches:
            yield pd.DataFrame([without(t, m) for t, m in zip(texts, held)], columns=["text", "n_sentences", "n_removed"])

    cleaned = F.pandas_udf(clean, "text string, n_sentences long, n_removed long")
    joined = docs.join(marked_rows, F.col("doc_id") == F.col(marked), "left").withColumn(cleaned_as, cleaned("text", marks))
    held = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    return joined.select(*[F.col(f"{cleaned_as}.text").alias("text") if c == "text" else F.col(c) for c in held], f"{cleaned_as}.n_sentences", f"{cleaned_as}.n_removed")


def op1_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without repeated passages: doc_id, text, n_sentences, n_removed."""
    return dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
