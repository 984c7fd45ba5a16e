"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target number of words. A source whose target passes its size is read in
whole epochs first; the rest of its target is filled by a weighted sample without
replacement: each document draws the exponential key ``-ln(u) / w`` from a hash of its id and
its quality weight ``w``, and documents are taken in key order while the prefix sum of their
words stays within the rest. Keys depend on nothing but id, seed and text, so reruns agree, and
rows that share an id or have none draw apart.

Prefix sums are distributed: documents fall into key bins, of about ``BIN_ROWS`` rows each
however large their source; sums of bins are added up first, and only the one bin of a source
that holds the end of its budget is ordered by document.

Null texts have size 0 and are never taken; a null source is a source of its own, after all
others; a null id draws the key of an empty id; rows with equal ids and texts tie, and which
of them is taken first can't be told from the result. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

WEIGHTS = (5, 2, 1)
BIN_ROWS = 4096


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    squeezed = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w")
    return F.coalesce(F.length(F.regexp_replace(squeezed, r"[\x20\x09-\x0D]", "")), F.lit(0)).cast("long")


def quality_weight(size: Column, chars: Column) -> Column:
    """1 to 3: one more for a length of 50 to 10,000 words, one more for words of 3 to 9 characters on average."""
    return F.lit(1.0) + size.between(50, 10_000).cast("double") + (chars.between(size * 4, size * 10) & (size > 0)).cast("double")


def targets(sizes: DataFrame, percent: int = 150, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources by code point, null last, weigh ``weights`` in turn and share ``percent`` of all
    sizes; none gets more than ``most`` times its size, and what it can't take the others share
    by weight. That is ``least(cap, level * weight)`` with one level for all: sources are
    capped in the order of cap / weight until the next one's cap is above its share. There is
    one row a source, so this window isn't over data: it sorts the sources, not their documents, in
    one task, which bounds them to some millions.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(most))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole) * (percent / 100)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    levelled = ranked.withColumn("level", level)
    # The level of the first source whose cap is not reached holds for all from there on.
    final = F.first(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level")), ignorenulls=True).over(by_cap)
    return levelled.withColumn("final", final).select("source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, percent: int = 150, most: int = 2, weights: tuple[int, ...] = WEIGHTS, seed: int = 17) -> DataFrame:
    """Per row of docs (doc_id, text, source): doc_id, size, source_size, target, taken."""
    size = word_count(F.col("text"))
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed)), F.md5(F.coalesce(F.col("text"), F.lit(""))))), 1, 13), 16, 10).cast("double")
    u = (draw + 0.5) / float(1 << 52)
    rows = docs.select("doc_id", "source", size.alias("size"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"), u.alias("u"))
    rows = rows.withColumn("key", -F.log("u") / quality_weight(F.col("size"), F.col("chars"))).drop("u", "chars")
    rows = cut(rows)
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    goal = targets(sources.select("source", "source_size"), percent, most, weights)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = goal.alias("g").join(sources.select(F.col("source").alias("s"), "n"), F.col("g.source").eqNullSafe(F.col("s"))).drop("s")
    plan = cut(plan.withColumn("epochs", epochs.cast("long")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))

    dealt = rows.alias("r").join(plan.withColumnRenamed("source", "s"), F.col("r.source").eqNullSafe(F.col("s"))).drop("s")
    # exp(-key) is spread over 0 to 1 with a density of at most 3, so bins stay near BIN_ROWS rows.
    bins = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(BIN_ROWS)))
    dealt = dealt.withColumn("bin", F.floor((1 - F.exp(-F.col("key"))) * bins).cast("long"))
    sums = dealt.groupBy("source", "bin").agg(F.sum("size").alias("held"), F.first("rest").alias("rest"))
    ahead = F.coalesce(F.sum("held").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("ahead", ahead)
    # The bin in which the rest runs out; bins before it are taken whole, bins after it not at all.
    edge = sums.where((F.col("ahead") < F.col("rest")) & (F.col("ahead") + F.col("held") >= F.col("rest"))).groupBy("source").agg(F.min(F.struct("bin", "ahead")).alias("edge"))
    edge = edge.select(F.col("source").alias("s"), F.col("edge.bin").alias("edge_bin"), F.col("edge.ahead").alias("edge_ahead"))
    marked = dealt.alias("d").join(edge, F.col("d.source").eqNullSafe(F.col("s")), "left").drop("s")
    inside = F.col("bin") == F.col("edge_bin")
    # Only rows of an edge bin share a window's partition; all others are dealt out by their ids.
    part = F.when(inside, F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id", "key"), F.lit(1 << 20)))
    order = Window.partitionBy("source", part).orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("edge_ahead") + F.coalesce(F.sum("size").over(order), F.lit(0))
    drawn = F.when(F.col("edge_bin").isNull(), F.lit(False)).when(inside, before + F.col("size") / 2 <= F.col("rest")).otherwise(F.col("bin") < F.col("edge_bin"))
    out = marked.withColumn("drawn", drawn)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("drawn").cast("long"))).alias("taken"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 percent of their words: doc_id, size, source_size, target, taken."""
    return mix(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH r AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(length(text), 0) AS chars,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|17|' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
k AS (
  SELECT *, -ln(u) / (1.0 + (size BETWEEN 50 AND 10000)::INT + (chars BETWEEN size * 4 AND size * 10 AND size > 0)::INT) AS key FROM r),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
         ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight
  FROM s),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (c ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER c AS i
  FROM w WINDOW c AS (ORDER BY cap / weight, source IS NULL, source)),
f AS (SELECT *, (SELECT arg_min(level, i) FROM l WHERE level * weight < cap) AS final,
             (SELECT min(i) FROM l WHERE level * weight < cap) AS since FROM l),
t AS (
  SELECT source, source_size, CASE WHEN since IS NULL OR i < since THEN cap ELSE least(cap, final * weight) END AS target FROM f),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
d AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (size * (epochs + (rest > 0 AND ahead + size / 2.0 <= rest)::INT))::BIGINT AS taken FROM d
"""
