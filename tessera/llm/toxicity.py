"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart on labelled rows, one on windows of ordinary texts
and one on what toxic texts hold beyond ordinary words: of each toxic text the words that are far
more common among toxic texts than among ordinary ones. A text is cut into windows of a few
words; each is compressed with either dictionary, and the bytes that the toxic one saves in the
two best windows are the text's margin. Margins become scores by an isotonic fit, and the
margins it learns from are those of rows that the dictionaries haven't seen: the sample is dealt
into ``PARTS``, and each part is measured with dictionaries that were trained on the others.

Only the dictionaries' content serves, not their entropy tables, and a window is compressed twice
in a row: so its length hangs on what the dictionary has of it, rather than on how common its
letters are or on the fixed cost of a first match.

Training is bounded by parameters: ``max_toxic`` and ``max_ordinary`` labelled ids, in the order
of a hash of the id, one text each (of rows that share an id the least text, of differing labels
the toxic one), at most ``candidates`` words that are weighed, and ``max_windows`` ordinary
windows. A word of toxic texts counts as often as there are texts that have it or, if they are
fewer, different words that it follows: near copies don't make a rare word look typical.

Nulls and empty texts score as a text without any toxic window; a null id is never held out
and its labels aren't learned from. Equal texts get equal scores, repeated rows stay repeated,
an empty table gives an empty result. Without labels of both classes outside the held-out fold,
or without a word that sets toxic texts apart, every text scores the share of toxic labels, but
at most ``MOST_UNTRAINED``, so none counts as toxic. Columns ``margin`` and ``score`` of docs are replaced, all others stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import held_out, isotonic, table

#: Words of a window, words from one to the next, and windows that are compressed at a time.
WINDOW, STEP, GROUP = 3, 2, 1 << 16
#: Bytes of the dictionaries, and the lengths of what the trainer counts and takes.
ORDINARY_BYTES, TOXIC_BYTES, COUNTED, TAKEN = 16_384, 8_192, 6, 32
#: A word is evidence in this share of the toxic texts, and in 4 of them at least, if its share there is so many times that in ordinary ones.
LEAST_SHARE, CONTRAST = 0.015, 10
PARTS = 3
#: The most that a text scores where nothing sets toxic texts apart.
MOST_UNTRAINED = 0.49
#: What a doubled window takes beyond its own bytes with a dictionary that has nothing of it, and the bytes by which it must be shorter to count.
FIXED_COST, LEAST_SAVED = 15, 3
NOT_LETTERS = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")


def words(text: str | None) -> list[bytes]:
    """Lower-case UTF-8 words without ASCII digits and punctuation."""
    return NOT_LETTERS.sub(b" ", (text or "").lower().encode("utf-8", "replace")).split()


def trained_dictionary(samples: list[bytes], size: int) -> bytes:
    """The dictionary that zstandard trains on samples; samples too few to train on are one themselves."""
    whole = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(size, max(1024, whole // 4)), samples, level=3, k=TAKEN, d=COUNTED).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size].ljust(16)


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """The same parameters for either dictionary, whatever its size."""
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    parameters = zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=15, hash_log=15, search_log=5, min_match=3, target_length=16,
        strategy=zstandard.STRATEGY_BTULTRA, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    held.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=parameters)


@dataclass
class ToxicityModel:
    """Both dictionaries and the calibrated score of each margin."""

    ordinary: bytes = b" " * 16
    toxic: bytes = b" " * 16
    margins: list[float] = field(default_factory=lambda: [0.0])
    scores: list[float] = field(default_factory=lambda: [0.0])

    def meters(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        return compressor(self.ordinary), compressor(self.toxic)

    def score(self, margins: np.ndarray) -> np.ndarray:
        return np.interp(margins, self.margins, self.scores)


def margin(text: str | None, meters) -> int:
    """The bytes that the toxic dictionary saves in the two best windows of the text; a single window counts twice.

    Most windows get no shorter by the toxic dictionary; they save nothing and aren't compressed with the other.
    """
    w = words(text)
    windows = list({b" " + b" ".join(w[i : i + WINDOW]) + b" " for i in range(0, max(1, len(w) - WINDOW + STEP), STEP)})
    best = [0, 0]
    for k in range(0, len(windows), GROUP):
        doubled = [x + x for x in windows[k : k + GROUP]]
        toxic = list(map(len, meters[1].multi_compress_to_buffer(doubled, threads=0)))
        short = [i for i, n in enumerate(toxic) if n <= len(doubled[i]) // 2 + FIXED_COST - LEAST_SAVED]
        if short:
            plain = meters[0].multi_compress_to_buffer([doubled[i] for i in short], threads=0)
            best = sorted([*best, *(len(x) - toxic[i] for x, i in zip(plain, short))])[-2:]
    return best[1] * 2 if len(windows) == 1 else sum(best)


def _margins(models: list[ToxicityModel]):
    """A pandas UDF of (text, number of the model)."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        meters = [m.meters() for m in models]
        for texts, parts in batches:
            yield pd.Series([margin(t, meters[k]) for t, k in zip(texts, parts)], dtype="int32")

    return F.pandas_udf(run, "int")


def training_rows(docs: DataFrame, labels: DataFrame, max_toxic: int, max_ordinary: int) -> tuple[DataFrame, dict[int, float], float]:
    """The bounded sample (toxic, part, text), for each class the labelled ids that one of it stands for, and the share of toxic ones, one ordinary id added."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    there = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bounds = {1: max_toxic, 0: max_ordinary}
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = usable.where("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(usable.where("toxic = 0").orderBy(*order).limit(max_ordinary))
    # At most max_toxic + max_ordinary ids: a proven bound for a broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(PARTS)).cast("int").alias("part")
    rate = there.get(1, 0) / (there.get(1, 0) + there.get(0, 0) + 1)
    return rows.select("toxic", part, F.coalesce("text", F.lit("")).alias("text")), {y: max(1.0, there.get(y, 0) / bounds[y]) for y in bounds}, rate


def _texts_of_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        n = Counter(w for text in pdf["text"] for w in set(words(text)))
        yield pd.DataFrame({"word": list(n), "n": list(n.values())})


def _counts_of(candidates: frozenset[bytes]):
    """By class and part, the texts that have a candidate (n, before null) and, in toxic texts, each different word before it (n 0)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, before = Counter(), set()
            for y, part, text in zip(pdf["toxic"], pdf["part"], pdf["text"]):
                w = words(text)
                n.update((y, part, x) for x in candidates.intersection(w))
                if y:
                    before.update((part, x, p) for x, p in zip(w, [b"", *w]) if x in candidates)
            rows = [(*k, None, v) for k, v in n.items()] + [(1, part, x, p, 0) for part, x, p in before]
            yield pd.DataFrame(rows, columns=["toxic", "part", "word", "before", "n"])

    return run


def _residues(evidence: frozenset[bytes]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"part": pdf["part"], "words": [[w for w in dict.fromkeys(words(t)) if w in evidence] for t in pdf["text"]]})

    return run


def _some_windows(each: int):
    """Windows of each text, evenly spaced."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for part, text in zip(pdf["part"], pdf["text"]):
                w = words(text)
                rows += [(part, b" " + b" ".join(w[i : i + WINDOW]) + b" ") for i in range(0, len(w), max(WINDOW, len(w) // each))]
            yield pd.DataFrame(rows, columns=["part", "window"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 4000, max_ordinary: int = 12_000, candidates: int = 20_000, max_windows: int = 100_000) -> ToxicityModel:
    """Learn dictionaries and calibration from labels outside the held-out fold."""
    rows, weight, rate = training_rows(docs, labels, max_toxic, max_ordinary)
    rows = rows.persist()
    try:
        size = Counter({(r["toxic"], r["part"]): r["n"] for r in rows.groupBy("toxic", "part").agg(F.count(F.lit(1)).alias("n")).collect()})
        all_of = lambda y, without=None: sum(size[y, p] for p in range(PARTS) if p != without)
        if not all_of(1) or not all_of(0):
            return ToxicityModel(scores=[min(rate, MOST_UNTRAINED)])
        toxic = rows.where("toxic = 1")
        least = max(4, LEAST_SHARE * all_of(1) * (PARTS - 1) / PARTS)
        common = toxic.mapInPandas(_texts_of_words, "word binary, n int").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        weighed = frozenset(bytes(r["word"]) for r in common.orderBy(F.desc("n"), "word").limit(candidates).collect())
        counts = rows.mapInPandas(_counts_of(weighed), "toxic int, part int, word binary, before binary, n int").groupBy("toxic", "part", "word", "before").agg(F.sum("n").alias("n"))
        found = counts.groupBy("toxic", "part", "word").agg(F.sum("n").alias("texts"), F.count("before").alias("contexts")).collect()
        held = Counter({(r["toxic"], r["part"], bytes(r["word"])): min(r["texts"], r["contexts"]) if r["toxic"] else r["texts"] for r in found})

        def evidence(without: int | None) -> frozenset[bytes]:
            nx, ny = max(1, all_of(1, without)), max(1, all_of(0, without))
            at = [p for p in range(PARTS) if p != without]
            x, y = ({w: sum(held[k, p, w] for p in at) for w in weighed} for k in (1, 0))
            return frozenset(w for w in weighed if x[w] >= max(4, LEAST_SHARE * nx) and x[w] / nx > CONTRAST * (y[w] + 0.5) / ny)

        evident = {k: evidence(k) for k in (None, *range(PARTS))}
        if not evident[None]:
            return ToxicityModel(scores=[min(rate, MOST_UNTRAINED)])
        residues = [(r["part"], [bytes(w) for w in r["words"]]) for r in toxic.mapInPandas(_residues(frozenset().union(*evident.values())), "part int, words array<binary>").collect()]
        each = max(1, max_windows // all_of(0))
        windows = [(r["part"], bytes(r["window"])) for r in rows.where("toxic = 0").mapInPandas(_some_windows(each), "part int, window binary").collect()]

        def fitted(without: int | None) -> ToxicityModel:
            left = [[w for w in ws if w in evident[without]] for part, ws in residues if part != without]
            # The trainer takes the best piece of each stretch of its samples: hash order deals them evenly and always alike.
            samples = sorted((b" " + b" ".join(ws) + b" " for ws in left if ws), key=xxhash.xxh3_128_digest)
            plain = sorted((w for part, w in windows if part != without), key=xxhash.xxh3_128_digest)
            return ToxicityModel(trained_dictionary(plain, ORDINARY_BYTES), trained_dictionary(samples, TOXIC_BYTES))

        model, others = fitted(None), [fitted(k) for k in range(PARTS)]
        fit = rows.select("toxic", _margins(others)("text", "part").alias("margin")).groupBy("margin", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    finally:
        rows.unpersist()
    met = sorted({r["margin"] for r in fit})
    mass = {(r["margin"], r["toxic"]): r["n"] * weight[r["toxic"]] for r in fit}
    model.margins, model.scores = isotonic(met, [mass.get((m, 1), 0) for m in met], [mass.get((m, 1), 0) + mass.get((m, 0), 0) for m in met])
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs with ``margin`` (int) and ``score`` (double, 0 to 1) of their column ``text``; other columns stay."""
    margins = docs.withColumn("margin", _margins([model])(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(0)))
    top = int(max(model.margins)) + 1
    low = int(min(model.margins)) - 1
    line = F.array(*[F.lit(float(model.score(np.array([m]))[0])) for m in range(low, top + 1)])
    at = F.least(F.greatest(F.col("margin"), F.lit(low)), F.lit(top)) - low + 1
    return margins.withColumn("score", F.element_at(line, at))


def predicted() -> Column:
    """1 where a scored text counts as toxic, 0 elsewhere."""
    return (F.col("score") >= 0.5).cast("int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document: doc_id, held_out, score, predicted, margin."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted().alias("predicted"), "margin")
