"""Lists, boards, counts and histories of the CRM tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def classified_counts(leads: DataFrame) -> DataFrame:
    """One row: all leads, and those hot, warm and cold."""
    return leads.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("classification") == c).alias(c) for c in ("hot", "morno", "frio")])


def search(rows: DataFrame, text: str, columns: list[str], classification: str | None = None) -> DataFrame:
    """Rows where any column has the text, whatever its case; blank text finds all."""
    found = F.lit(False)
    for c in columns:
        found |= F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lower(F.lit(text.strip())))
    return rows.where(found if classification is None else found & (F.col("classification") == classification))


def board(stages: DataFrame, items: DataFrame) -> DataFrame:
    """(stage, cards, total value, first cards): every stage, also without items. Cards are counted and summed before they are joined."""
    sums = items.groupBy("stage").agg(F.count(F.lit(1)).alias("cards"), F.round(F.sum("value"), 2).alias("value"))
    return stages.join(sums, "stage", "left").select("stage", F.coalesce("cards", F.lit(0)).alias("cards"), F.coalesce("value", F.lit(0.0)).alias("value"))


def board_cards(stages: DataFrame, items: DataFrame, leads: DataFrame, n: int = 50) -> DataFrame:
    """(stage, cards): each stage's first n items (lead_id, position) as an array of (position, lead_id, name), by position and id; empty where there are none.

    Places are numbered before leads are joined and cards gathered, so no array holds more than n.
    """
    place = Window.partitionBy("stage").orderBy("position", "lead_id")
    first = items.withColumn("place", F.row_number().over(place)).where(F.col("place") <= n)
    named = first.join(leads.select("lead_id", "name"), "lead_id", "left")
    cards = F.transform(F.sort_array(F.collect_list(F.struct("place", "position", "lead_id", "name"))), lambda x: F.struct(x["position"].alias("position"), x["lead_id"].alias("lead_id"), x["name"].alias("name")))
    held = named.groupBy("stage").agg(cards.alias("cards"))
    return stages.join(held, "stage", "left").withColumn("cards", F.coalesce("cards", F.array().cast(held.schema["cards"].dataType)))


def replied(conversations: DataFrame, leads: DataFrame) -> DataFrame:
    """Conversations (lead_id) with the name and classification of their lead; unknown leads stay null."""
    return conversations.join(leads.select("lead_id", "name", "classification"), "lead_id", "left")


def reply_guard(messages: DataFrame, channels: list[str]) -> DataFrame:
    """Messages (channel, kind, text) with the reason why none is answered, or null: an unknown channel, media, or no text."""
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    return messages.withColumn("reason", F.when(~F.coalesce(F.col("channel").isin(channels), F.lit(False)), "channel").when(F.col("kind") != "text", "media").when(blank, "empty"))


def first_named(groups: DataFrame, names: list[str]) -> DataFrame:
    """The group (group_id, name) that the first fitting name of an ordered list finds, whatever its case; none if no name fits. Ties go to the least id."""
    place = F.coalesce(*[F.when(F.contains(F.lower("name"), F.lit(x.lower())), F.lit(k)) for k, x in enumerate(names)])
    best = groups.withColumn("place", place).where("place is not null").agg(F.min(F.struct("place", "group_id", "name")).alias("g"))
    return best.where("g is not null").select("g.group_id", "g.name")


def qualify(leads: DataFrame, pipeline: DataFrame, least: int = 80) -> tuple[DataFrame, DataFrame]:
    """(leads, pipeline) after hot leads, and those with a score of least or more, have moved on to 'qualifying'."""
    hot = (F.col("classification") == "hot") | (F.col("score") >= least)
    return move_stage(leads, pipeline, leads.where(hot).select("lead_id", F.lit("qualifying").alias("stage")))


#: Stages that a lead can be moved to.
STAGES = ["new", "qualifying", "qualified", "call", "proposal", "converted", "discarded"]


def grid(cities: DataFrame, large: Column, step: float) -> DataFrame:
    """Cities (lat, lng) with steps x and y: nine points around a large one, else its own."""
    steps = F.when(large, F.sequence(F.lit(-1), F.lit(1))).otherwise(F.array(F.lit(0)))
    cells = cities.withColumn("x", F.explode(steps)).withColumn("y", F.explode(steps))
    return cells.withColumn("lat", F.col("lat") + F.col("x") * step).withColumn("lng", F.col("lng") + F.col("y") * step)


def openings(rows: DataFrame, group_id: str, municipio: str, year: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Openings, closures and their balance of rows (group_id, municipio, kind, year) in a city, whatever its case; in one row or by columns, of one year or all."""
    held = rows.where((F.col("group_id") == group_id) & (F.lower("municipio") == municipio.lower()))
    held = held if year is None else held.where(F.col("year") == year)
    opened, closed = F.count_if(F.col("kind") == "abertura"), F.count_if(F.col("kind") == "fechamento")
    return held.groupBy(*(by or [])).agg(opened.alias("aberturas"), closed.alias("fechamentos"), (opened - closed).alias("saldo"))


def newest_first(rows: DataFrame, column: str, key: str, n: int | None = None) -> DataFrame:
    """By a column descending with nulls first, as PostgreSQL lists; ties by key; all rows, or the first n."""
    listed = rows.orderBy(F.col(column).desc_nulls_first(), key)
    return listed if n is None else listed.limit(n)


def last_message(messages: DataFrame, role: str) -> DataFrame:
    """(conv_id, text): each conversation's last message of a role."""
    return messages.where(F.col("role") == role).groupBy("conv_id").agg(F.max_by("text", F.struct("turn", "text")).alias("text"))


def history(messages: DataFrame, n: int = 12) -> DataFrame:
    """(conv_id, history): the last n messages, oldest first, one 'role: text' a line."""
    latest = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    kept = messages.withColumn("place", F.row_number().over(latest)).where(F.col("place") <= n)
    line = F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", line.alias("line")))), lambda x: x["line"])
    return kept.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("history"))


def nested(parents: DataFrame, children: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """Parents with an ordered array of their children, empty where there are none; for children that belong to a page of parents."""
    held = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    kind = held.schema[name].dataType
    return parents.join(held, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def remote_then_local(remote: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """All remote rows, and the local ones whose key is not among them."""
    return remote.unionByName(local.join(remote.select(key), key, "left_anti"), allowMissingColumns=True)


def move_stage(leads: DataFrame, pipeline: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leads, pipeline) after moves (lead_id, stage): 'discarded' changes the lead's status only, others the stage, at position 0, as well; a stage that isn't one of STAGES is an error."""
    known = F.when(F.col("stage").isin(STAGES), F.col("stage")).otherwise(F.raise_error(F.concat(F.lit("invalid_stage:"), F.coalesce("stage", F.lit("")))))
    to = moves.select("lead_id", known.alias("to"))
    led = leads.join(to, "lead_id", "left").withColumn("status", F.coalesce("to", "status")).drop("to")
    on = F.col("to").isNotNull() & (F.col("to") != "discarded")
    moved = pipeline.join(to, "lead_id", "left")
    return led, moved.withColumn("position", F.when(on, F.lit(0)).otherwise(F.col("position"))).withColumn("stage", F.when(on, F.col("to")).otherwise(F.col("stage"))).drop("to")


def price_of(plan: Column, prices: dict[str, float], hint: Column | None = None) -> Column:
    """A hint, else the price of the plan without spaces, else of the plan as it is."""
    known = F.create_map(*[F.lit(x) for pair in prices.items() for x in pair])
    found = F.coalesce(F.try_element_at(known, F.replace(plan, F.lit(" "), F.lit(""))), F.try_element_at(known, plan))
    return found if hint is None else F.coalesce(hint, found)
