"""An embedding column that is made once for each different text.

What is embedded is a text cut to a number of characters; its key is a digest of the model, its
version and that text. Keys that a cache of earlier embeddings holds aren't embedded again, and
of the others each goes to the embedder once, in batches of a bounded number, where vectors of
another length than stated fail the batch. Chunks meet their vectors by the key; the vectors
are checkpointed before that join, so a text with a third of all rows is split by it.

Null texts count as empty and are embedded like others. The embedder is a function of a list of
texts that gives a matrix; ``hashed`` needs no model: signed feature hashing of words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

Embedder = Callable[[list[str]], np.ndarray]
#: Texts of a batch and characters of a text.
BATCH, MOST_CHARS = 32, 8000
_WORD = re.compile(r"[^\W_]+")


@lru_cache(1 << 16)
def _slot(word: str, dimension: int) -> tuple[int, int]:
    """The place of a word and its sign: the first eight hexadecimal digits of its md5 modulo the dimension, and whether the ninth is even."""
    digest = hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()
    return int(digest[:8], 16) % dimension, 1 if int(digest[8], 16) % 2 == 0 else -1


def hash_sums(dimension: int) -> Embedder:
    """Signed counts of the lower-case words of texts in a number of places."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension))
        for i, text in enumerate(texts):
            for w in _WORD.findall(text.lower()):
                at, sign = _slot(w, dimension)
                out[i, at] += sign
        return out

    return embed


def hashed(dimension: int) -> Embedder:
    """``hash_sums`` as vectors of norm 1; a text without words, or whose words cancel out, is along the first axis, as no vector is zero."""
    sums = hash_sums(dimension)

    def embed(texts: list[str]) -> np.ndarray:
        out = sums(texts)
        norms = np.sqrt((out * out).sum(axis=1))
        out[norms == 0, 0] = 1
        return out / np.where(norms == 0, 1, norms)[:, None]

    return embed


def embedding_key(text: Column, model: str, version: str, most_chars: int = MOST_CHARS) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(model), F.lit(version), F.substring(F.coalesce(text, F.lit("")), 1, most_chars)), 256)


def embed_texts(texts: DataFrame, embedder: Embedder, dimension: int, batch: int = BATCH) -> DataFrame:
    """(key, embedding array<float>) of (key, text), in batches; a wrong number or length of vectors, or one that isn't finite, is an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for start in range(0, len(rows), batch):
                some = rows.iloc[start : start + batch]
                found = np.asarray(embedder(some["text"].tolist()), np.float64)
                if found.ndim != 2 or found.shape != (len(some), dimension):
                    raise ValueError(f"embedding_length_mismatch:expected_{dimension}_got_{found.shape[1] if found.ndim == 2 else found.shape}")
                if not np.isfinite(found).all():
                    raise ValueError("embedding_not_finite")
                yield pd.DataFrame({"key": some["key"].to_numpy(), "embedding": list(found.astype(np.float32))})

    return texts.select("key", "text").mapInPandas(run, "key string, embedding array<float>")


def with_embeddings(chunks: DataFrame, embedder: Embedder, dimension: int, model: str, version: str = "1", cache: DataFrame | None = None, most_chars: int = MOST_CHARS, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(chunks with ``embedding_key`` and ``embedding``, new rows (key, embedding) for the cache).

    cache (key, embedding) has what was embedded before; its keys are unique.
    """
    rows = chunks.withColumn("embedding_key", embedding_key(F.col(text), model, version, most_chars))
    # The longest prefix that is embedded stands for its key: one row a text, combined before the shuffle.
    texts = rows.groupBy(F.col("embedding_key").alias("key")).agg(F.first(F.substring(F.coalesce(F.col(text), F.lit("")), 1, most_chars)).alias("text"))
    if cache is not None:
        texts = texts.join(cache.select("key"), "key", "left_anti")
    new = cut(embed_texts(texts, embedder, dimension))
    known = new if cache is None else new.unionByName(cache.select("key", "embedding"))
    known = known.select(F.col("key").alias("embedding_key"), "embedding")
    return rows.join(known, "embedding_key"), new
