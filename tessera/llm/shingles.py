"""Word shingles of whole texts as 64-bit hashes, a batch at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Texts are cut into groups of about so many bytes, which bounds a task's memory.
GROUP_BYTES = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over the hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about GROUP_BYTES of text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + GROUP_BYTES, side="right")))
        yield start, end
        start = end


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text where its words start (one more entry than texts).

    Words are runs without ASCII white space, A-Z lower-cased; a null text has none.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    keep = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    coded = pc.dictionary_encode(flat)
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    codes = coded.indices.to_numpy(zero_copy_only=False)[keep]
    starts = np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(texts)))]).astype(np.int64)
    return known[codes] if len(known) else np.zeros(0, np.uint64), starts


def shingle_rows(words: np.ndarray, starts: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each text the hashes of its shingles in order: one for the whole sequence where there are fewer words than size."""
    rolled = words.copy()
    for j in range(1, size):
        rolled[: len(rolled) - j] = rolled[: len(rolled) - j] * _STEP + words[j:] if len(words) > j else rolled[: len(rolled) - j]
    rolled = _mix(rolled)
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a >= size:
            yield rolled[a : b - size + 1]
        elif b > a:
            h = words[a : a + 1].copy()
            for w in words[a + 1 : b]:
                h = h * _STEP + w
            yield _mix(h + np.uint64(b - a))
        else:
            yield rolled[:0]


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes, ascending."""
    for a, b in groups(texts):
        words, starts = word_hashes(texts.take(pa.array(np.arange(a, b))))  # not a slice: ascii_lower misreads those
        for row in shingle_rows(words, starts, size):
            yield np.unique(row)


def gram_rows(words: np.ndarray, starts: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each text the hashes of all its runs of size words, each as ``shingle_rows`` gives it for a text of just those words."""
    rolled = words.copy()
    for j in range(1, size):
        rolled[: len(rolled) - j] = rolled[: len(rolled) - j] * _STEP + words[j:] if len(words) > j else rolled[: len(rolled) - j]
    rolled = _mix(rolled + np.uint64(size))
    for a, b in zip(starts[:-1], starts[1:]):
        yield rolled[a : max(a, b - size + 1)]


def shingle_and_gram_sets(texts: pa.Array, size: int, shorter: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles, ascending, and the distinct runs of each of some shorter lengths."""
    for a, b in groups(texts):
        words, starts = word_hashes(texts.take(pa.array(np.arange(a, b))))
        runs = [gram_rows(words, starts, n) for n in shorter]
        for row in shingle_rows(words, starts, size):
            yield np.unique(row), np.unique(np.concatenate([next(r) for r in runs])) if runs else row[:0]
