"""What several of the operators share: reading, cutting lineage, folds, isotonic fits, words."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of the contracts: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is what the cluster names in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a folder of its own; a cluster without it is an error, since
    executors don't share local folders.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        sc.setCheckpointDir(folder)
    # What was shuffled on the way to the checkpoint isn't read again, so its files needn't wait for the driver's memory to fill up.
    # A DataFrame keeps the setting that it was made under: the checkpoint is one of a new DataFrame.
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BROADCAST = "spark.sql.autoBroadcastJoinThreshold"
#: Rows at a time between Spark and Python where each is a whole text or its set of shingles, and bytes of a table that is broadcast without a hint.
FEW_ROWS, FEW_BYTES = 1000, 256 << 10


@contextmanager
def bounded_memory(spark: SparkSession) -> Iterator[None]:
    """For what is computed inside: at most FEW_ROWS in a batch for Python, of which either side holds several copies, and no broadcasts of more than FEW_BYTES, which the driver gathers and hashes. Lower limits that are set stay."""
    before = {key: spark.conf.get(key) for key in (BATCH_ROWS, BROADCAST)}
    if not 0 < int(before[BATCH_ROWS]) < FEW_ROWS:  # 0 and less mean no limit
        spark.conf.set(BATCH_ROWS, FEW_ROWS)
    if not before[BROADCAST].startswith("-") and spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before[BROADCAST]) > FEW_BYTES:
        spark.conf.set(BROADCAST, FEW_BYTES)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


WHOLE_STAGE = "spark.sql.codegen.wholeStage"


@contextmanager
def many_small_plans(spark: SparkSession) -> Iterator[None]:
    """For rounds that each plan a dozen stages over far fewer rows than the input has: no code of its own for each stage, which the driver would write and compile again and again, and hold with what that takes of its memory."""
    before = spark.conf.get(WHOLE_STAGE)
    spark.conf.set(WHOLE_STAGE, "false")
    try:
        yield
    finally:
        spark.conf.set(WHOLE_STAGE, before)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as keep it apart from the columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learned from: crc32 of the id's text, modulo 5, is 0 (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


#: Bits of a membership bitmap; 8 MB, whatever it is made of.
BITMAP_BITS = 1 << 26


def bitmap(values: DataFrame, column: str) -> bytes:
    """The low bits of a column of hashes as a bitmap of fixed size, for a first look before a join.

    Words of 64 bits are joined up on the executors and arrive as 128 chunks. With more values
    than bits it lets everything pass: a join that follows stays right and only loses its head start.
    """
    at = f"({column} & {BITMAP_BITS - 1}L)"
    words = values.selectExpr(f"cast(shiftright({at}, 6) as int) as w", f"shiftleft(1L, cast({at} & 63L as int)) as bits").groupBy("w").agg(F.bit_or("bits").alias("bits"))
    size = BITMAP_BITS // 64 // 128

    def chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(size, np.int64)
        held[pdf["w"].to_numpy() % size] = pdf["bits"]
        return pd.DataFrame({"k": [int(pdf["w"].iloc[0]) // size], "held": [held.tobytes()]})

    whole = bytearray(BITMAP_BITS // 8)
    for r in words.groupBy(F.floor(F.col("w") / size)).applyInPandas(chunk, "k int, held binary").collect():
        whole[r["k"] * size * 8 : (r["k"] + 1) * size * 8] = r["held"]
    return bytes(whole)


def in_bitmap(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (uint64) have their bit in a bitmap, read as bytes."""
    at = hashes & np.uint64(BITMAP_BITS - 1)
    return (held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def isotonic(x: Iterable[float], positive: Iterable[float], total: Iterable[float]) -> tuple[list[float], list[float]]:
    """Pool adjacent violators over at most a few thousand distinct x: (x, non-decreasing rate).

    Rates are shrunk towards the overall rate by one pseudo-observation, so none is 0 or 1.
    """
    order = sorted(zip(x, positive, total))
    if not order:
        return [0.0], [0.5]
    prior = (sum(p for _, p, _ in order) + 0.5) / (sum(t for *_, t in order) + 1)
    blocks: list[list] = []
    for v, p, t in order:
        blocks.append([[float(v)], float(p), float(t)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            xs, p1, t1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + xs, blocks[-1][1] + p1, blocks[-1][2] + t1]
    xs = [v for b in blocks for v in b[0]]
    ys = [(b[1] + prior) / (b[2] + 1) for b in blocks for _ in b[0]]
    return xs, list(np.maximum.accumulate(ys))
