"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

A text is split at the vocabulary's added tokens, which count one each, and then into
pre-tokens. Pre-tokens not met before in a task are held together as one ragged array of
symbols; in each round every pre-token's lowest-ranked pair is found and all its occurrences
are merged at once, until no pair has a rank. What survives is counted and remembered.
Pre-tokens of ``LONG`` bytes or more are linked arrays: all their occurrences of the lowest
rank merge at once, and only the pairs beside them get a new rank, so their cost grows with
the number of merges.

Null and empty texts have 0 bytes and 0 tokens; lone surrogates can't occur in Spark strings.
Ids may be null or repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

#: Pre-tokens remembered by a task, and bytes of text that are split at a time.
REMEMBERED = 1_000_000
GROUP_CHARS = 4 << 20
NO_RANK = np.int64(1) << 40
LONG = 256
#: Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next free one from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class PairMerger:
    """Counts of tokens of pre-tokens under one vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only byte-level BPE without a normalizer or prefix space")
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.first = np.array([vocab[s] for s in byte_symbols()], np.int64)
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.split = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def merge(self, tokens: list[bytes]) -> np.ndarray:
        """How many symbols of each token survive."""
        lengths = np.array([len(t) for t in tokens], np.int64)
        out = lengths.copy()
        for which, way in ((lengths < LONG, self._rounds), (lengths >= LONG, self._links)):
            at = np.flatnonzero(which)
            if len(at):
                symbols = self.first[np.frombuffer(b"".join(tokens[i] for i in at), np.uint8)]
                way(symbols, np.repeat(at, lengths[at]), out)
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def _rounds(self, symbols: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
        """Each round merges every owner's lowest pair and takes what has merged off out."""
        while len(symbols) > 1:
            rank = np.append(np.where(owner[:-1] == owner[1:], self._ranks(symbols[:-1], symbols[1:]), NO_RANK), NO_RANK)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(owner))))
            hit = (rank == best) & (rank < NO_RANK)
            if not hit.any():
                return
            # Of hits that overlap, as in "aaa", every second one counts from the left.
            begins = hit & ~np.append(False, hit[:-1])
            where = np.arange(len(hit))
            hit &= (where - np.maximum.accumulate(np.where(begins, where, 0))) % 2 == 0
            symbols[hit] = self.merged[rank[hit]]
            np.subtract.at(out, owner[hit], 1)
            stays = ~np.append(False, hit[:-1]) & (best < NO_RANK)
            symbols, owner = symbols[stays], owner[stays]

    def _links(self, symbols: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
        """The same for long tokens: owners don't meet, so ranks are taken in ascending order over all of them."""
        size = len(symbols)
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        ends = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
        after[ends] = -1
        before[np.append(0, ends[:-1] + 1)] = -1
        rank = np.full(size, NO_RANK)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def ranked(at: np.ndarray) -> None:
            paired = at[after[at] >= 0]
            rank[at] = NO_RANK
            rank[paired] = found = self._ranks(symbols[paired], symbols[after[paired]])
            known = found < NO_RANK
            paired, found = paired[known], found[known]
            order = np.argsort(found, kind="stable")
            paired, found = paired[order], found[order]
            starts = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else []
            for a, b in zip(starts, [*starts[1:], len(found)]):
                r = int(found[a])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(paired[a:b])

        ranked(np.arange(size))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            follows = np.append(False, after[at[:-1]] == at[1:])
            where = np.arange(len(at))
            at = at[(where - np.maximum.accumulate(np.where(follows, 0, where))) % 2 == 0]
            gone = after[at]
            symbols[at], rank[gone] = self.merged[r], NO_RANK
            after[at] = after[gone]
            linked = at[after[at] >= 0]
            before[after[linked]] = linked
            np.subtract.at(out, owner[at], 1)
            left = before[at]
            ranked(np.unique(np.concatenate([at, left[left >= 0]])))

    def pieces(self, text: str) -> tuple[int, list[str]]:
        """(added tokens, pre-tokens) of a text."""
        if self.added is None or not self.added.search(text):
            return 0, self.split.findall(text)
        parts = self.added.split(text)
        return len(parts) - 1, [t for part in parts for t in self.split.findall(part)]

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end]) <= GROUP_CHARS):
                chars += len(texts[end])
                end += 1
            split = [self.pieces(t) for t in texts[start:end]]
            if len(self.known) > REMEMBERED:
                self.known.clear()
            new = list({t for _, tokens in split for t in tokens}.difference(self.known))
            if new:
                self.known.update(zip(new, self.merge([t.encode("utf-8") for t in new]).tolist()))
            out += [n + sum(map(self.known.__getitem__, tokens)) for n, tokens in split]
            start = end
        return out


@lru_cache(maxsize=2)
def _merger(path: str) -> PairMerger:
    return PairMerger(path)


def token_counts(path: str):
    """A pandas UDF: text to its number of tokens under the vocabulary file at path, which every executor has."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(_merger(path).count(texts.tolist()), dtype="int64")

    return F.pandas_udf(run, "long")


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens, over_limit."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_counts(path)(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 50k byte-level vocabulary."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
