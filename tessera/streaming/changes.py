"""A change feed between two versions of a keyed table, and lists that follow it.

``changes`` compares digests of rows first, so of rows that stay as they were only a key and a
digest are shuffled; whole rows are fetched for the keys that differ. ``ListRefresh`` is a
foreachBatch writer that reads again only the lists that a batch of changes affects, as a
screen does that shows them, and leaves the others alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import cut
from tessera.streaming.buckets import Buckets

#: Affected keys up to which they are put into the scan's filter, where row groups can be skipped by them.
MOST_PUSHED = 1000


def row_digest(rows: DataFrame) -> Column:
    """sha256 of a whole row; columns by name, so their order doesn't count, and a null differs from any value."""
    return F.unhex(F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256))


def complete(key: list[str]) -> Column:
    """No column of the key is null."""
    out = F.lit(True)
    for k in key:
        out &= F.col(k).isNotNull()
    return out


def changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key…, op, before, after): what happened between two versions of a table.

    op is INSERT, UPDATE or DELETE; before and after are the whole rows as structs, null where there
    is none. Rows with a null in the key belong to no version. Where a version repeats a key, its
    row with the largest digest stands for the key. Both versions have the same columns. The keys
    that differ are checkpointed.
    """

    def digests(rows: DataFrame, name: str) -> DataFrame:
        return rows.where(complete(key)).select(*key, row_digest(rows).alias("digest")).groupBy(*key).agg(F.max("digest").alias(name))

    both = digests(old, "was").join(digests(new, "is"), key, "full")
    op = F.when(F.col("was").isNull(), "INSERT").when(F.col("is").isNull(), "DELETE").otherwise("UPDATE")
    changed = cut(both.where(~F.col("was").eqNullSafe(F.col("is"))).withColumn("op", op))

    def whole(rows: DataFrame, name: str, digest: str) -> DataFrame:
        held = rows.where(complete(key)).select(*key, row_digest(rows).alias(digest), F.struct(*rows.columns).alias(name))
        return held.join(changed.select(*key, digest), [*key, digest]).dropDuplicates(key).drop(digest)

    return changed.select(*key, "op").join(whole(old, "before", "was"), key, "left").join(whole(new, "after", "is"), key, "left")


def applied(rows: DataFrame, events: DataFrame, key: list[str]) -> DataFrame:
    """A version with the changes made: what ``changes`` found turns the old version into the new one. One event a key."""
    named = [F.col(f"after.{c}").alias(c) for c in rows.columns]
    return rows.join(events.select(*key), key, "left_anti").unionByName(events.where("op <> 'DELETE'").select(*named))


def affected(events: DataFrame, list_key: list[str]) -> DataFrame:
    """The keys of the lists that changes touch: those a row was in and those it is in. Rows without a list key are in none."""
    sides = [events.where(F.col(side).isNotNull()).select(*[F.col(f"{side}.{k}").alias(k) for k in list_key]) for side in ("before", "after")]
    return sides[0].unionByName(sides[1]).where(complete(list_key)).distinct()


def first_rows(rows: DataFrame, list_key: list[str], order: list[Column], n: int) -> DataFrame:
    """(list key…, place, other columns): the first n rows of each list. Ranks are cut before the shuffle, so a list with a third of all rows sends n rows a task."""
    place = F.row_number().over(Window.partitionBy(*list_key).orderBy(*order))
    return rows.where(complete(list_key)).withColumn("place", place).where(F.col("place") <= n)


class ListRefresh:
    """foreachBatch writer of change events: lists under a shared path, as they'd be if all were built anew.

    current gives the table as it stands when a batch is worked off, build turns rows of some list
    keys into those lists' rows (with the key). Only lists of affected keys are built, from a scan
    that is filtered to them, and only their buckets are written. Running a batch again gives the
    same lists, as each is built from the table and not from the one before it.
    """

    def __init__(self, path: str, schema: str, list_key: list[str], current: Callable[[SparkSession], DataFrame], build: Callable[[DataFrame], DataFrame], buckets: int = 256):
        self.store, self.key, self.current, self.build = Buckets(path, schema, list_key, buckets), list_key, current, build

    def __call__(self, events: DataFrame, number: int) -> None:
        keys = affected(events, self.key).persist()
        try:
            self.refresh(keys, number)
        finally:
            keys.unpersist()

    def refresh(self, keys: DataFrame, number: int) -> None:
        """Build the lists of some keys anew."""
        spark, store = keys.sparkSession, self.store
        before, touched = store.manifest(spark, number - 1), store.touched(keys)
        table = self.current(spark)
        few = keys.limit(MOST_PUSHED + 1).collect() if len(self.key) == 1 else []
        if few and len(few) <= MOST_PUSHED:
            table = table.where(F.col(self.key[0]).isin([r[0] for r in few]))
        else:
            table = table.join(keys, self.key, "left_semi")
        kept = store.read(spark, before, touched).join(keys, self.key, "left_anti")
        store.write(kept.unionByName(self.build(table).select(*kept.columns)), number, before, touched)

    def lists(self, spark: SparkSession, number: int) -> DataFrame:
        """All lists after a batch."""
        return self.store.read(spark, self.store.manifest(spark, number))


def start(events: DataFrame, sink: ListRefresh, checkpoint: str):
    """Run a streaming DataFrame of changes into a sink until it has no more input."""
    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
