"""Vector similarity and full-text ranks."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.stems import STOP, stem

#: Words between which a pair of terms counts, and places of a term that do.
NEAR, MOST_PLACES = 100, 255
#: Words with dots inside are one, those with hyphens one and their parts as well.
WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)+|[^\W_]+(?:-[^\W_]+)+|[^\W_]+")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a norm is 0, a side is null or lengths differ."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)


def _unit(rows: list) -> np.ndarray:
    """Rows of one length as float64 vectors of norm 1; a norm of 0 gives nan."""
    m = np.array(rows, np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def nearness(embedding: Column, vector: list[float]) -> Column:
    """``cosine`` of a column of vectors to one, a batch at a time; rounded to 12 digits, so equal vectors tie."""
    (unit,) = _unit([vector])

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            fits = np.array([x is not None and len(x) == len(vector) for x in rows], bool)
            out = np.full(len(rows), np.nan)
            if fits.any():
                out[fits] = np.round(np.einsum("ij,j->i", _unit(list(rows[fits])), unit), 12)
            yield pd.Series(out).astype("Float64").where(~np.isnan(out))

    return F.pandas_udf(run, "double")(embedding)


def best_of_block(queries: pd.DataFrame, chunks: pd.DataFrame, k: int, least: float) -> pd.DataFrame:
    """(query_id, chunk_id, similarity) of each query's k nearest chunks in a block, by one matrix product; ties go by chunk_id."""
    found = np.round(_unit(list(queries["vector"])) @ _unit(list(chunks["embedding"])).T, 12) if len(queries) and len(chunks) else np.zeros((0, 0))
    ids, out = chunks["chunk_id"].to_numpy(), []
    for query, row in zip(queries["query_id"], found):
        near = np.flatnonzero(row >= least)
        if len(near) > k:
            near = near[row[near] >= np.partition(row[near], len(near) - k)[len(near) - k]]
        out += sorted(((query, ids[i], row[i]) for i in near), key=lambda x: (-x[2], x[1]))[:k]
    return pd.DataFrame(out, columns=["query_id", "chunk_id", "similarity"])


def blend(similarity: Column, rank: Column) -> Column:
    """The hybrid score of a similarity and a full-text rank."""
    return 0.7 * similarity + 0.3 * rank / (rank + 1)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def rank_of_places(places: list[np.ndarray]) -> float:
    """Rank of a text from the ascending places of each of the terms it holds, with weight 0.1.

    One term sums 1/j² over its occurrences; of several, every pair of places of different terms
    adds by noisy-or of their distance. Pairs more than NEAR words apart would add some 1e-16 each
    and are left out, so the work grows with the text.
    """
    if len(places) == 1:
        return float((0.1 / np.arange(1.0, len(places[0]) + 1) ** 2).sum() / (math.pi**2 / 6))
    miss, held = 0.0, [np.asarray(p, np.int64) for p in places]
    for i, a in enumerate(held):
        for b in held[i + 1 :]:
            low, high = np.searchsorted(b, a - NEAR), np.searchsorted(b, a + NEAR, "right")
            n = high - low
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            d = np.abs(b[at] - np.repeat(a, n))
            miss += np.log1p(-np.sqrt(0.01 / (1.005 + 0.05 * np.exp(d[d > 0] / 1.5 - 2)))).sum()
    return float(-np.expm1(miss))


def ts_rank(text: Column, terms: list[str]) -> Column:
    """Rank of a text for terms by the distances of their positions, in words from 1; 0 for a null text.

    All places of a term count. Terms must be lower case; ``question_rank`` stems.
    """
    wanted = list(dict.fromkeys(terms))
    if not wanted:
        return F.lit(0.0)
    word = re.compile(r"[^\W_]+")

    def rank(said: str) -> float:
        places: dict[str, list[int]] = {t: [] for t in wanted}
        for i, w in enumerate(word.findall(said), 1):
            if w in places:
                places[w].append(i)
        held = [np.array(p) for p in places.values() if p]
        return rank_of_places(held) if held and (len(held) > 1 or len(wanted) == 1) else 0.0

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else rank(t) for t in texts], dtype="float64")

    # A text without any term needn't leave the JVM.
    said = F.lower(text)
    found = F.lit(False)
    for t in wanted:
        found |= F.contains(said, F.lit(t))
    return F.when(found, F.pandas_udf(run, "double")(F.when(found, said))).otherwise(0.0)


def split_words(text: str) -> list[str]:
    """The lower-case words of a text; those with hyphens are followed by their parts."""
    return [x for w in WORD.findall(text.lower()) for x in ([w, *w.split("-")] if "-" in w else [w])]


def stemmed(text: str | None) -> list[tuple[int, str]]:
    """(place, stem) of the words that aren't stop words; places count all words, from 1."""
    return [(i, stem(w)) for i, w in enumerate(split_words(text or ""), 1) if w not in STOP]


def rank_of(text: str | None, stems: list[str]) -> float:
    """``rank_of_places`` of one text for stems, of which the first MOST_PLACES places each count, as in PostgreSQL."""
    places: dict[str, list[int]] = {s: [] for s in stems}
    for i, s in stemmed(text):
        if s in places:
            places[s].append(i)
    held = [np.array(p[:MOST_PLACES], np.int64) for p in places.values() if p]
    return rank_of_places(held) if held and (len(held) > 1 or len(places) == 1) else 0.0


def question_rank(text: Column, question: str) -> Column:
    """Rank of Portuguese texts for a question's words, without stop words and by stems; 0 where the question has none."""
    stems = list(dict.fromkeys(s for _, s in stemmed(question)))
    if not stems:
        return F.lit(0.0)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([rank_of(t, stems) for t in texts], dtype="float64")

    return F.pandas_udf(run, "double")(F.coalesce(text, F.lit("")))
