"""Queries on feeds of changes and streams of messages, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.registered import query
from tessera.session import shared_folder, table
from tessera.streaming import changes, keyed

MESSAGE = "message_id long, thread long, turn long, role string, text string"

_VERSIONS_SQL = """
m AS (SELECT conv_id * 1000 + turn AS message_id, conv_id AS thread, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
v1 AS (SELECT * FROM m WHERE (thread + turn) % 11 <> 0),
v2 AS (
  SELECT message_id, CASE WHEN turn = 1 AND thread % 7 = 0 THEN thread + 1 ELSE thread END AS thread, turn,
         CASE WHEN message_id % 19 = 0 THEN NULL ELSE role END AS role, CASE WHEN thread % 9 = 0 AND turn % 2 = 0 THEN 'edited ' || text ELSE text END AS text
  FROM m WHERE (3 * thread + turn) % 13 <> 0)"""


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of conversations as messages: some only in one, some moved to another thread, edited or without their role."""
    thread, turn = F.col("thread"), F.col("turn")
    m = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null").select((F.col("conv_id") * 1000 + turn).alias("message_id"), F.col("conv_id").alias("thread"), "turn", "role", "text")
    moved = F.when((turn == 1) & (thread % 7 == 0), thread + 1).otherwise(thread)
    edited = F.when((thread % 9 == 0) & (turn % 2 == 0), F.concat(F.lit("edited "), "text")).otherwise(F.col("text"))
    new = m.where((3 * thread + turn) % 13 != 0).select("message_id", moved.alias("thread"), "turn", F.when(F.col("message_id") % 19 != 0, F.col("role")).alias("role"), edited.alias("text"))
    return m.where((thread + turn) % 11 != 0), new


@query(f"""WITH {_VERSIONS_SQL}
SELECT coalesce(a.message_id, b.message_id) AS message_id, CASE WHEN a.message_id IS NULL THEN 'INSERT' WHEN b.message_id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op,
       a.thread AS thread_before, b.thread AS thread_after, a.role AS role_before, b.role AS role_after, a.text AS text_before, b.text AS text_after
FROM v1 a FULL JOIN v2 b ON a.message_id = b.message_id
WHERE a.message_id IS NULL OR b.message_id IS NULL OR a.thread <> b.thread OR a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text""")
def change_events(spark, sf_dir):
    found = changes.changes(*versions(spark, sf_dir), ["message_id"])
    return found.select("message_id", "op", *[F.col(f"{side}.{c}").alias(f"{c}_{side}") for c in ("thread", "role", "text") for side in ("before", "after")])


@query(f"""WITH {_VERSIONS_SQL}
SELECT thread, row_number() OVER (PARTITION BY thread ORDER BY turn DESC, message_id DESC) AS place, message_id, role, text FROM v2 QUALIFY place <= 12""")
def refreshed_threads(spark, sf_dir):
    """The newest 12 messages of each thread: built once from the first version, then refreshed by the changes to the second, twice as after a failure."""
    old, new = versions(spark, sf_dir)
    now = [old]
    sink = changes.ListRefresh(
        shared_folder(spark, "threads"), "thread long, place int, message_id long, role string, text string", ["thread"], lambda _: now[0],
        lambda rows: changes.first_rows(rows, ["thread"], [F.desc("turn"), F.desc("message_id")], 12), buckets=64,
    )
    sink.refresh(old.select("thread").distinct(), 0)
    now[0] = new
    events = changes.changes(old, new, ["message_id"])
    for _ in range(2):
        sink(events, 1)
    return sink.lists(spark, 1)


@query("""WITH m AS (SELECT conv_id::VARCHAR AS conversation, 60 * (turn * 7 % 5) + turn AS told, conv_id || '-' || turn AS id, substr(role || ': ' || coalesce(text, ''), 1, 200) AS preview FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL)
SELECT conversation, max(told) AS last_at, arg_max(preview, (told, id)) AS preview, count(*) AS unread FROM m GROUP BY conversation""")
def streamed_conversations(spark, sf_dir):
    """conversations as messages that come out of order, in two deliveries and some in both, kept by key; the stream is run anew for the second."""
    folder, turn = shared_folder(spark, "conversations"), F.col("turn")
    messages = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null and role is not null").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string")).alias("provider_id"), F.col("conv_id").cast("string").alias("conversation"),
        F.timestamp_seconds(60 * (turn * 7 % 5) + turn).alias("ts"), F.substring(F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))), 1, 200).alias("preview"),
    )
    for delivered in ("crc32(provider_id) % 3 <= 1", "crc32(provider_id) % 3 >= 1"):
        messages.where(delivered).write.mode("append").parquet(f"{folder}/in")
        keyed.start(spark.readStream.schema(keyed.MESSAGE).parquet(f"{folder}/in"), f"{folder}/state").awaitTermination()
    return keyed.states(spark, f"{folder}/state").select("conversation", F.unix_seconds("last_at").alias("last_at"), "preview", "unread")
