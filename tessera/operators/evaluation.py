"""Retrieval metrics over ranked hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fold


def per_query(hits: DataFrame, relevant: Column, k: int = 5) -> DataFrame:
    """(query_id, retrieved, precision, first_rank, mrr, any_in_k) of hits (query_id, rank): precision is over what was retrieved."""
    top = hits.where(F.col("rank") <= k)
    hit = F.coalesce(relevant, F.lit(False))
    out = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("retrieved"), F.avg(hit.cast("double")).alias("precision"), F.min(F.when(hit, F.col("rank"))).alias("first_rank"), F.max(hit).alias("any_in_k"))
    return out.withColumn("mrr", F.coalesce(1 / F.col("first_rank"), F.lit(0.0)))


def keyword_metrics(hits: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """Per question (query_id, keywords array): recall, precision, mrr and retrieved over hits (query_id, rank, text, meta JSON).

    A chunk has a keyword if its text or metadata holds it, whatever case and accents. Recall is over
    keywords and precision over chunks among the first k; the reciprocal rank is over all hits.
    A question without hits or without keywords has 0 for each.
    """
    blob = fold(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("meta", F.lit(""))))
    met = F.filter(F.sequence(F.lit(0), F.size("keywords") - 1), lambda i: F.contains(F.col("blob"), fold(F.element_at("keywords", i + 1))))
    found = hits.select("query_id", "rank", blob.alias("blob")).join(questions.select("query_id", "keywords"), "query_id")
    found = found.withColumn("met", F.when(F.size("keywords") > 0, met).otherwise(F.array().cast("array<int>")))
    top = F.col("rank") <= k
    # At most k arrays of a question are gathered.
    per = found.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("retrieved"), F.size(F.array_distinct(F.flatten(F.collect_list(F.when(top, F.col("met")))))).alias("kinds"),
        F.avg(F.when(top, (F.size("met") > 0).cast("double"))).alias("precision"), F.min(F.when(F.size("met") > 0, F.col("rank"))).alias("first"),
    )
    out = questions.join(per, "query_id", "left")
    recall = F.when(F.size("keywords") > 0, F.col("kinds") / F.size("keywords"))
    return out.select("query_id", F.coalesce("retrieved", F.lit(0)).alias("retrieved"), *[F.coalesce(x, F.lit(0.0)).alias(n) for x, n in ((recall, "recall"), (F.col("precision"), "precision"), (1 / F.col("first"), "mrr"))])


def document_match(refs: Column, expected: Column) -> Column:
    """Whether one of the references holds the expected document's name, or the name holds it."""
    needle = fold(expected)
    return F.coalesce(F.exists(refs, lambda r: F.contains(fold(r), needle) | F.contains(needle, fold(r))), F.lit(False))


def rates(metrics: DataFrame, averages: list[str], flags: list[str]) -> DataFrame:
    """One row: the averages of metrics, and the share of true flags among the questions that have one, null if none has."""
    return metrics.agg(*[F.round(F.avg(c), 6).alias(f"avg_{c}") for c in averages], *[F.round(F.avg(F.col(c).cast("double")), 6).alias(f"{c}_rate") for c in flags])


def recall_by(metrics: DataFrame, column: str) -> DataFrame:
    """The mean recall by a column."""
    return metrics.groupBy(column).agg(F.round(F.avg("recall"), 6).alias("recall"), F.count(F.lit(1)).alias("queries"))


def recommendation(deltas: DataFrame, least: float = 0.05) -> DataFrame:
    """deltas (primary_delta, mrr_delta) with a recommendation: keep a clear gain, neutral without any change, else review."""
    primary, mrr = F.col("primary_delta"), F.col("mrr_delta")
    return deltas.withColumn("recommendation", F.when((primary >= least) | (mrr >= least), "keep").when((primary == 0) & (mrr == 0), "neutral").otherwise("review"))


def macro(metrics: DataFrame) -> DataFrame:
    """Averages over queries."""
    return metrics.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg(F.col("any_in_k").cast("double")), 6).alias("hit_rate"))


def paired(base: DataFrame, other: DataFrame, missing: int = 99) -> DataFrame:
    """Improved, worsened and unchanged queries between two runs, by first_rank; none counts as ``missing``."""
    b, o = (x.select("query_id", F.coalesce("first_rank", F.lit(missing)).alias(n)) for x, n in ((base, "b"), (other, "o")))
    return b.join(o, "query_id").agg(F.count_if(F.col("o") < F.col("b")).alias("improved"), F.count_if(F.col("o") > F.col("b")).alias("worsened"), F.count_if(F.col("o") == F.col("b")).alias("unchanged"))


def rank_changes(base: DataFrame, other: DataFrame, missing: int = 99) -> DataFrame:
    """(query_id, delta_rank, top_changed) of two runs (query_id, first_rank, top_city).

    delta_rank is how many places the first right hit has come up; where only the other run has one it is ``missing``,
    where only the base has one minus that, and 0 where neither has. top_changed tells whether the cities of the first hits differ.
    """
    b, o = (x.select("query_id", F.col("first_rank").alias(f"{n}_rank"), F.col("top_city").alias(f"{n}_city")) for x, n in ((base, "b"), (other, "o")))
    had, has = F.col("b_rank").isNotNull(), F.col("o_rank").isNotNull()
    delta = F.when(had & has, F.col("b_rank") - F.col("o_rank")).when(has, missing).when(had, -missing).otherwise(0)
    return b.join(o, "query_id").select("query_id", delta.cast("int").alias("delta_rank"), (~F.col("b_city").eqNullSafe(F.col("o_city"))).alias("top_changed"))
