"""Found gyms as the text of an answer: a count, the plans, and the gyms by activity in the order of their names.

A table of searches is rendered at once. A search has as many hits as its top-k gives, so what is
gathered for one answer is bounded by k; nothing else comes together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.collation import in_order
from tessera.operators.knowledge import filled
from tessera.operators.retrieval import ACTIVITY_ORDER, effective_activity

# What activities are called in answers, and what an answer without hits says.
LABELS = {"musculacao": "Musculação", "funcional": "Funcional", "pilates": "Pilates", "yoga": "Yoga", "crossfit": "CrossFit", "muay_thai": "Muay Thai", "jiu_jitsu": "Jiu-Jitsu", "boxe": "Boxe", "natacao": "Natação", "danca": "Dança", "spinning": "Spinning", "academia_geral": "Academia"}
NOTHING, NO_PLAN = "Não encontrei academias Wellhub no catálogo para essa busca.", "Plano não informado"
UNRANKED = 99


def activity_label(key: Column) -> Column:
    """What an activity is called; an unknown one by its key, spaces for underscores and words capitalized."""
    known = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.regexp_replace(F.lower(key), "[^a-z0-9_]", "_")), F.initcap(F.replace(key, F.lit("_"), F.lit(" "))))


def _joined(rows: DataFrame, by: list[str], order: list[str], text: str, name: str, mark: str) -> DataFrame:
    """Texts of each group in order, joined by a mark."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(*order, text))), lambda x: x[text])
    return rows.groupBy(*by).agg(F.array_join(lines, mark).alias(name))


def answers(searches: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, text) of searches (query_id, municipio) and their hits (query_id, ord, gym_id, nome, bairro, modalidade, plano, plan_rank, valor, horario, score).

    In an activity a gym counts once, with its best score, the first of equal ones; overall once, with its
    lowest plan rank. A plan's price is the last that isn't 'N/A', by the order in which gyms first come up.
    """
    held = hits.select("query_id", "ord", "gym_id", "nome", "bairro", effective_activity(F.col("nome"), F.col("modalidade"))["modality"].alias("modality"), F.coalesce(filled(F.col("plano")), F.lit(NO_PLAN)).alias("plano"), F.coalesce("plan_rank", F.lit(UNRANKED)).alias("plan_rank"), "valor", "horario", F.coalesce("score", F.lit(0.0)).alias("score"))
    gym, gym_there = Window.partitionBy("query_id", "gym_id"), Window.partitionBy("query_id", "modality", "gym_id")

    unique = held.withColumn("seen", F.min("ord").over(gym)).withColumn("n", F.row_number().over(gym.orderBy("plan_rank", "ord"))).where("n = 1")
    stated = F.when(F.coalesce(F.col("valor") != "N/A", F.lit(False)) & (F.col("valor") != ""), F.col("seen"))
    plans = unique.groupBy("query_id", "plano").agg(F.count(F.lit(1)).alias("gyms"), F.min("plan_rank").alias("rank"), F.max_by("valor", stated).alias("valor"), F.min("seen").alias("seen"))
    price = F.coalesce(F.concat(F.lit(" (valor referência: "), "valor", F.lit(")")), F.lit(""))
    plans = plans.withColumn("line", F.concat("plano", F.lit(": "), F.col("gyms").cast("string"), F.lit(" academia(s)"), price))
    summary = _joined(plans, ["query_id"], ["rank", "seen"], "line", "plans", "\n").join(unique.groupBy("query_id").agg(F.count(F.lit(1)).alias("total")), "query_id")

    best = held.withColumn("seen", F.min("ord").over(gym_there)).withColumn("came", F.min("ord").over(Window.partitionBy("query_id", "modality"))).withColumn("n", F.row_number().over(gym_there.orderBy(F.desc("score"), "ord"))).where("n = 1")
    line = F.concat("nome", F.coalesce(F.concat(F.lit(" ("), filled(F.col("bairro")), F.lit(")")), F.lit("")), F.lit(" — "), "plano", F.coalesce(F.concat(F.lit(" | Horário: "), filled(F.col("horario"))), F.lit("")))
    placed = best.withColumn("line", line).withColumn("place", F.row_number().over(Window.partitionBy("query_id", "modality").orderBy(in_order(F.col("nome")), "seen")))
    at = F.array_position(F.array(*[F.lit(x) for x in ACTIVITY_ORDER]), F.col("modality"))
    sections = _joined(placed, ["query_id", "modality", "came"], ["place"], "line", "lines", "\n")
    sections = sections.withColumn("section_at", F.when(at > 0, at).otherwise(UNRANKED)).withColumn("section", F.concat(activity_label(F.col("modality")), F.lit("\n"), "lines"))
    listed = _joined(sections, ["query_id"], ["section_at", "came"], "section", "sections", "\n\n")

    place = F.nullif(F.trim("municipio"), F.lit(""))
    intro = F.coalesce(F.concat(F.lit("Academias em "), place, F.lit(" que aceitam Wellhub (resultados recuperados):")), F.lit("Academias que aceitam Wellhub (resultados recuperados):"))
    total = F.concat(F.lit("Total: "), F.col("total").cast("string"), F.lit(" academia(s) única(s) nos resultados recuperados."))
    text = F.concat(intro, F.lit("\n\n"), total, F.lit("\nPor plano mínimo Wellhub:\n"), "plans", F.lit("\n\n"), "sections")
    out = searches.select("query_id", "municipio").join(summary, "query_id", "left").join(listed, "query_id", "left")
    return out.select("query_id", F.coalesce(F.trim(text), F.lit(NOTHING)).alias("text"))
