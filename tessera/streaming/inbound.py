"""Inbound messages to conversation state, as a batch and as a stream of micro-batches.

Delivery is at least once: a provider id counts once, rows without one always count. The state
of a conversation is its last message by event time and the number of unread ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import millis, preview
from tessera.streaming import keyed

#: What an envelope, an item and a message without wrappers are read for; nested JSON stays text.
ENVELOPE = "event string, type string, data string, key string, message string, messages string"
ITEM = "key struct<id:string,remoteJid:string,fromMe:string>, id string, remoteJid string, fromMe string, pushName string, message string"
MESSAGE = "conversation string, extendedTextMessage struct<text:string>, imageMessage struct<caption:string,url:string>, videoMessage struct<caption:string,url:string>, audioMessage struct<url:string>"
WRAPPERS = ["ephemeralMessage", "viewOnceMessage", "viewOnceMessageV2", "documentWithCaptionMessage"]
#: How many wrappers may lie around a message.
DEPTH = 6


def _object(x: Column, schema: str) -> Column:
    return F.from_json(F.when(F.ltrim(x).startswith("{"), x), schema)


def _list(x: Column) -> Column:
    return F.from_json(F.when(F.ltrim(x).startswith("["), x), "array<string>")


def _filled(x: Column) -> Column:
    return F.when(~x.isin("", "false", "0"), x)


def _unwrapped(message: Column) -> Column:
    """A message's JSON without the wrappers around it."""
    inner = lambda x: F.coalesce(*[_filled(F.get_json_object(x, f"$.{w}.message")) for w in WRAPPERS], x)
    return F.aggregate(F.array_repeat(F.lit(0), DEPTH), message, lambda x, _: inner(x))


def unpack(payloads: DataFrame, column: str = "payload", *others: str) -> DataFrame:
    """One row a message of JSON payloads: provider_id, jid, from_me, name, text, kind, media_url, and other columns of the payload's row.

    Messages are the payload's data or else the payload itself: a list, an object with a list
    of messages, or one item. Other events without data and key hold none. Items without a jid
    go; kind is text, image (videos too) or audio.
    """
    raw = F.col(column)
    top = _object(raw, ENVELOPE)
    data = F.coalesce(top["data"], raw)
    held = _object(data, ENVELOPE)
    event = F.lower(F.coalesce(_filled(top["event"]), _filled(top["type"]), F.lit("")))
    other = (event != "") & ~event.contains("messages.upsert") & (event != "messages_upsert") & _filled(top["data"]).isNull() & _filled(top["key"]).isNull()
    is_item = lambda x: F.coalesce(_filled(x["key"]), _filled(x["message"])).isNotNull()
    items = F.when(~F.coalesce(other, F.lit(False)), F.coalesce(_list(data), _list(held["messages"]), F.when(is_item(held), F.array(data)), F.when(is_item(top), F.array(raw))))
    found = payloads.select(F.explode(items).alias("raw"), *others).select("raw", *others, _object(F.col("raw"), ITEM).alias("item"))
    found = found.select("raw", *others, "item", _object(_unwrapped(F.col("item.message")), MESSAGE).alias("m"))
    m, item = F.col("m"), F.col("item")
    said = F.coalesce(m["conversation"], m["extendedTextMessage"]["text"])
    image, audio, video = m["imageMessage"], m["audioMessage"], m["videoMessage"]
    pick = lambda i, a, v: F.when(said.isNotNull(), F.lit(None)).when(image.isNotNull(), i).when(audio.isNotNull(), a).when(video.isNotNull(), v)
    return found.select(
        F.coalesce(item["key"]["id"], item["id"]).alias("provider_id"),
        F.trim(F.coalesce(_filled(item["key"]["remoteJid"]), item["remoteJid"])).alias("jid"),
        _filled(F.coalesce(item["key"]["fromMe"], item["fromMe"])).isNotNull().alias("from_me"),
        F.coalesce(item["pushName"], F.get_json_object("raw", "$.pushname")).alias("name"),
        F.coalesce(said, pick(image["caption"], F.lit(None), video["caption"])).alias("text"),
        F.coalesce(pick(F.lit("image"), F.lit("audio"), F.lit("image")), F.lit("text")).alias("kind"),
        _filled(pick(image["url"], audio["url"], video["url"])).alias("media_url"), *others,
    ).where("jid <> ''")


def accepted(messages: DataFrame) -> DataFrame:
    """Without own messages, broadcasts and senders without digits."""
    return messages.where(~F.col("from_me") & ~F.col("jid").endswith("@broadcast") & (F.regexp_replace(F.substring_index("jid", "@", 1), "[^0-9]", "") != ""))


def once(messages: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Each provider id's first message by time, without those already seen; messages without an id all stay."""
    named = messages.where("provider_id is not null")
    if seen is not None:
        named = named.join(seen.select("provider_id"), "provider_id", "left_anti").select(*messages.columns)
    kept = named.groupBy("provider_id").agg(F.min(F.struct("ts", *[c for c in messages.columns if c not in ("ts", "provider_id")])).alias("m")).select("provider_id", "m.*").select(*messages.columns)
    return kept.unionByName(messages.where("provider_id is null"))


def conversation_state(messages: DataFrame) -> DataFrame:
    """(conversation, last_at, preview, unread): the last message by time, then provider id, and how many there are."""
    last = F.max(F.struct("ts", F.coalesce("provider_id", F.lit("")).alias("id"), "preview")).alias("last")
    return messages.groupBy("conversation").agg(last, F.count(F.lit(1)).alias("unread")).select("conversation", F.col("last.ts").alias("last_at"), "last.preview", "unread")


def messages_of(payloads: DataFrame, column: str = "payload", ts: str = "ts") -> DataFrame:
    """Accepted messages (provider_id, conversation, ts, preview) of payloads with their time of arrival."""
    found = accepted(unpack(payloads.select(column, F.col(ts).alias("arrived")), column, "arrived"))
    return found.select("provider_id", F.substring_index("jid", "@", 1).alias("conversation"), F.col("arrived").alias("ts"), preview(F.col("text"), F.col("kind")).alias("preview"))


#: What a payload with messages of direct channels is read for.
DIRECT = "entry array<struct<messaging:array<struct<sender:struct<id:string>,timestamp:bigint,message:struct<text:string,attachments:array<struct<type:string,payload:struct<url:string>>>>>>>>"


def unpack_direct(payloads: DataFrame, arrived: Column, column: str = "payload") -> DataFrame:
    """One row a message of payloads that nest messaging lists in entries: sender, ts, text, media_url, kind, preview.

    Without a time of its own a message has that of its arrival; senders without an id go. There is
    no provider id, so each delivery counts. Kind is text, or audio or image where there is media.
    """
    entries = payloads.select(F.explode(F.from_json(column, DIRECT)["entry"]).alias("e"), arrived.alias("arrived"))
    found = entries.select(F.explode("e.messaging").alias("m"), "arrived").where("coalesce(m.sender.id, '') <> ''")
    first = F.get(F.col("m.message.attachments"), F.lit(0))
    url = _filled(first["payload"]["url"])
    kind = F.when(url.isNull(), "text").when(first["type"] == "audio", "audio").otherwise("image")
    out = found.select(F.col("m.sender.id").alias("sender"), F.coalesce(millis(F.col("m.timestamp")), "arrived").alias("ts"), F.col("m.message.text").alias("text"), url.alias("media_url"), kind.alias("kind"))
    said = F.coalesce(F.nullif("text", F.lit("")), F.when(F.col("media_url").isNotNull(), F.concat(F.lit("["), F.col("kind"), F.lit("]"))), F.lit(""))
    return out.withColumn("preview", F.substring(said, 1, 200))


def thread_state(messages: DataFrame, monotonic: bool = True) -> DataFrame:
    """(sender, last_at, preview, unread) of messages (sender, ts, preview, arrival).

    Either the latest message by event time counts, or, as where late ones overwrite, the last to arrive.
    """
    by = F.struct("ts", "arrival") if monotonic else F.struct("arrival")
    return messages.groupBy("sender").agg(F.max_by("ts", by).alias("last_at"), F.max_by("preview", by).alias("preview"), F.count(F.lit(1)).alias("unread"))


def merge_leads(leads: DataFrame, contacts: DataFrame) -> DataFrame:
    """Leads (channel, external_id, name, classification, score, status, last_contact_at) after contacts (channel, external_id, name, ts).

    A contact's last name that isn't blank takes the place of the lead's; its last time is the last
    contact. New leads are 'morno' with a score of 0 and the status 'new'.
    """
    named = F.when(F.coalesce(F.trim("name"), F.lit("")) != "", F.col("name"))
    seen = contacts.groupBy("channel", "external_id").agg(F.max_by(named, F.when(named.isNotNull(), F.struct("ts", "name"))).alias("said"), F.max("ts").alias("at"))
    both = leads.join(seen, ["channel", "external_id"], "full")
    return both.select(
        "channel", "external_id", F.coalesce("said", "name").alias("name"), F.coalesce("classification", F.lit("morno")).alias("classification"), F.coalesce("score", F.lit(0)).alias("score"),
        F.coalesce("status", F.lit("new")).alias("status"), F.coalesce("at", "last_contact_at").alias("last_contact_at"),
    )


def auto_replies(messages: DataFrame, enabled: bool) -> DataFrame:
    """The messages that call for an automatic reply: those with text, if the flag is set."""
    return messages.where(F.lit(enabled) & (F.coalesce(F.trim("text"), F.lit("")) != ""))


def start_payloads(payloads: DataFrame, checkpoint: str, into: str | None = None):
    """Run a stream of webhook payloads (payload, ts) into the keyed states of their conversations, until it has no more input."""
    return keyed.start(messages_of(payloads), checkpoint, into)
