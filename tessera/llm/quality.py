"""Quality classifier: ridge regression on random Fourier features, calibrated.

Statistics of each whole text, standardised, pass through random Fourier features of a
Gaussian kernel. Partitions of the labelled sample sum their normal equations; the small
system that is left is solved once. An isotonic fit turns raw scores into probabilities.

Training takes at most ``max_rows`` labelled rows in the order of a hash of their ids, none of
the held-out fold. Null and empty texts have statistics of 0. Equal texts get equal scores;
ids may be null or repeat; an empty table gives an empty result; without labels of both
classes every text scores 0.5. A column ``score`` of docs is replaced, all others stay. Rows
that share an id count as one labelled row.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, held_out, isotonic, table

FEATURES = 192
RIDGE = 1e-2
STATISTICS = ("words", "lines", "word_length", "distinct", "top_share", "stutter", "upper", "digits", "shouts", "symbols", "bars", "same_lines", "short", "sentence", "compressed", "distinct_pairs")
NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
SYMBOLS = b"#$%&*+<=>@[\\]^_`{|}~"
NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)


def statistics(text: str | None) -> list[float]:
    """STATISTICS of one whole text."""
    if not text or not (words := text.split()):
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "replace")
    n, size = len(words), len(raw)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    ends = raw.count(b".") + raw.count(b"!") + raw.count(b"?") + 1
    return [
        math.log1p(n), math.log1p(len(lines)), min(size / n, 40.0), len(counts) / n, max(counts.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n, len(raw.translate(None, NOT_UPPER)) / size, len(raw.translate(None, NOT_DIGIT)) / size,
        raw.count(b"!") / n, len(raw.translate(None, NOT_SYMBOL)) / n, raw.count(b"|") / n, 1 - len(set(lines)) / max(1, len(lines)),
        sum(v for w, v in counts.items() if len(w) <= 3) / n, math.log1p(n / ends), len(zlib.compress(raw, 1)) / size, len(set(zip(words, words[1:]))) / n,
    ]


@dataclass
class QualityModel:
    mean: np.ndarray = field(default_factory=lambda: np.zeros(len(STATISTICS)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(STATISTICS)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    raw: list[float] = field(default_factory=lambda: [0.0])
    scores: list[float] = field(default_factory=lambda: [0.5])
    seed: int = 11

    def features(self, x: np.ndarray) -> np.ndarray:
        """cos(x W + b) for a Gaussian kernel of width sqrt(number of statistics), and a constant."""
        rng = np.random.default_rng(self.seed)
        w = rng.standard_normal((len(STATISTICS), FEATURES)) / math.sqrt(len(STATISTICS))
        b = rng.uniform(0, 2 * math.pi, FEATURES)
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(x @ w + b) * math.sqrt(2 / FEATURES), np.ones((len(x), 1))])

    def predict(self, x: np.ndarray) -> np.ndarray:
        # Row by row sums don't depend on which rows share a batch, so equal texts score equal.
        return np.round(np.einsum("ij,j->i", self.features(x), self.weights), 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.predict(x), self.raw, self.scores)


def _statistics_table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "x": [statistics(t) for t in pdf["text"]]})


def _normal_equations(model: QualityModel):
    """Each partition's upper triangle of Z'Z with the label as last column, as (i, j, v)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FEATURES + 2, FEATURES + 2))
        for pdf in batches:
            if len(pdf):
                z = np.hstack([model.features(np.array(pdf["x"].tolist())), pdf[["label"]].to_numpy(float)])
                total += z.T @ z
        i, j = np.triu_indices(FEATURES + 2)
        yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "v": total[i, j]})

    return run


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 40_000) -> QualityModel:
    """Fit on at most max_rows labelled rows outside the held-out fold."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("label"))
    # At most max_rows ids: a proven bound for a broadcast.
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    measured = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInPandas(_statistics_table, "doc_id long, label int, x array<double>")
    rows = cut(measured.groupBy("doc_id", "label").agg(F.min("x").alias("x")))
    at = [F.col("x")[k] for k in range(len(STATISTICS))]
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positive"), *[F.avg(c).alias(f"m{k}") for k, c in enumerate(at)], *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(at)]).first()
    model = QualityModel()
    if not sums["n"] or sums["positive"] in (0, sums["n"]):
        return model
    model.mean = np.array([sums[f"m{k}"] for k in range(len(STATISTICS))])
    model.scale = np.array([sums[f"s{k}"] or 1.0 for k in range(len(STATISTICS))])
    cells = rows.mapInPandas(_normal_equations(model), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    whole = np.zeros((FEATURES + 2, FEATURES + 2))
    for r in cells:
        whole[r["i"], r["j"]] = whole[r["j"], r["i"]] = r["v"]
    ztz, zty = whole[:-1, :-1], whole[:-1, -1]
    model.weights = np.linalg.solve(ztz + RIDGE * np.eye(len(ztz)), zty)

    def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(np.round(np.clip(model.predict(np.array(x.tolist())), -1, 2), 2))

    fit = rows.select("label", F.pandas_udf(raw, "double")("x").alias("raw")).groupBy("raw").agg(F.sum("label").alias("p"), F.count(F.lit(1)).alias("n")).collect()
    model.raw, model.scores = isotonic([r["raw"] for r in fit], [r["p"] for r in fit], [r["n"] for r in fit])
    return model


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs with ``score`` (double, 0 to 1) of their column ``text``; all other columns stay."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(np.array([statistics(t) for t in texts]).reshape(len(texts), len(STATISTICS))))

    return docs.withColumn("score", F.pandas_udf(run, "double")("text"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
