"""Keyed writes as DataFrame operations: the new state of a table from the old one and a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Old rows without those that a key of the batch replaces, and each key's last row of the batch by ``order``.

    Rows with a null in the key never meet and are all kept.
    """
    complete = F.lit(True)
    for k in key:
        complete &= F.col(k).isNotNull()
    keyed = new.where(complete)
    # The last row by partial maxima: a key that a batch repeats often is combined before the shuffle.
    latest = keyed.groupBy(*key).agg(F.max_by(F.struct(*new.columns), F.struct(order)).alias("last")).select("last.*").unionByName(new.where(~complete))
    return old.join(keyed.select(*key), key, "left_anti").unionByName(latest.drop(order) if order not in old.columns else latest)


def replace_where(old: DataFrame, new: DataFrame, condition: Column) -> DataFrame:
    """Wipe the rows of a condition (null counts as false) and load the new ones."""
    return old.where(~F.coalesce(condition, F.lit(False))).unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows, and those of the batch whose key is not there yet."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti").select(*old.columns))


def backfill(rows: DataFrame, source: DataFrame, key: str, column: str) -> DataFrame:
    """Nulls of a column from the source's column of that name."""
    return rows.join(source.select(key, F.col(column).alias("_from")), key, "left").withColumn(column, F.coalesce(column, "_from")).drop("_from")


def delete_children(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Cascade: children of deleted parents go."""
    return children.join(gone.select(key), key, "left_anti")


def unlink_children(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Set null: children of deleted parents lose the key."""
    marks = gone.select(F.col(key).alias("_gone")).distinct()
    return children.join(marks, F.col(key) == F.col("_gone"), "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")


def unique_violations(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key…, rows) of keys without nulls that occur more than once."""
    complete = F.lit(True)
    for k in key:
        complete &= F.col(k).isNotNull()
    return rows.where(complete).groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def missing_parents(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Children whose key is set but has no parent."""
    return children.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def fill_constant(rows: DataFrame, column: str, value: str) -> DataFrame:
    """Nulls of a column become a constant."""
    return rows.withColumn(column, F.coalesce(column, F.lit(value)))


def stamp_changes(old: DataFrame, new: DataFrame, key: list[str], order: str, now: Column) -> DataFrame:
    """An upsert whose rows have now in ``updated_at``; rows that the batch leaves alone keep theirs."""
    return upsert(old, new.withColumn("updated_at", now), key, order)


def upsert_agents(old: DataFrame, groups: DataFrame) -> DataFrame:
    """An agent for each group (group_id): status and chunk_count of those there are stay, new ones are drafts without chunks."""
    rest = groups.select("group_id").distinct().join(old.select("group_id"), "group_id", "left_anti")
    return old.unionByName(rest.select("group_id", F.lit("draft").alias("status"), F.lit(0).cast(old.schema["chunk_count"].dataType).alias("chunk_count")))


def mark_where(rows: DataFrame, column: str, value: str, condition: Column) -> DataFrame:
    """A column set to a value in the rows of a condition; null counts as false."""
    return rows.withColumn(column, F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.col(column)))


def pending(chunks: DataFrame, most: int | None = None) -> DataFrame:
    """Chunks without an embedding or whose model is pending, by id; all, or the first ``most``."""
    rows = chunks.where(F.col("embedding").isNull() | (F.col("embedding_model") == "pending")).orderBy("chunk_id")
    return rows if most is None else rows.limit(most)


def batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Rows with the number of their batch of about ``size``, by a hash of the key: no order over all rows is needed to deal them out."""
    count = max(1, -(-rows.count() // size))
    return rows.withColumn("batch", F.pmod(F.xxhash64(key), F.lit(count)))


def counters(rows: DataFrame, outcome: str) -> DataFrame:
    """One row: how many rows were loaded, skipped and failed."""
    return rows.agg(*[F.count_if(F.col(outcome) == x).alias(x) for x in ("loaded", "skipped", "failed")])


def publish_status(chunks: DataFrame) -> DataFrame:
    """(group_id, chunk_count, status): published if no chunk is pending, else training."""
    pending = F.col("embedding").isNull() | (F.col("embedding_model") == "pending")
    return chunks.groupBy("group_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.when(F.count_if(pending) == 0, "published").otherwise("training").alias("status"))


def agent_status(chunks: DataFrame, errors: DataFrame, shown: int = 3) -> DataFrame:
    """``publish_status`` with last_error: a group's first few errors (group_id, at, message) in order, joined by bars, null where it has none.

    Errors are numbered and cut before they are gathered, so a group with very many of them gathers no more than are shown.
    """
    place = F.row_number().over(Window.partitionBy("group_id").orderBy("at", "message"))
    first = errors.where("message is not null").withColumn("place", place).where(F.col("place") <= shown)
    said = first.groupBy("group_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "message"))), lambda x: x["message"]), " | ").alias("last_error"))
    return publish_status(chunks).join(said, "group_id", "left")


def check_violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that a check doesn't hold of, with ``violated``, the names of all such checks in order. As in SQL a check that is null holds."""
    failed = F.array_compact(F.array(*[F.when(~check, F.lit(name)) for name, check in checks.items()]))
    return rows.withColumn("violated", failed.cast("array<string>")).where(F.size("violated") > 0)


def replace_counted(old: DataFrame, new: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """``replace_where``, and one row with how many rows were deleted and inserted."""
    gone = old.agg(F.count_if(F.coalesce(condition, F.lit(False))).alias("deleted"), F.lit(0).cast("long").alias("inserted"))
    come = new.agg(F.lit(0).cast("long").alias("deleted"), F.count(F.lit(1)).alias("inserted"))
    return replace_where(old, new, condition), gone.unionByName(come).agg(F.sum("deleted").alias("deleted"), F.sum("inserted").alias("inserted"))
