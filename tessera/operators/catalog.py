"""Offers by place and plan: filters, catalogues, and the documents that are made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.classify import credits_of
from tessera.functions.text import content_hash, escape_xml, none_if_blank, short_id, slug


def _slug(x: Column) -> Column:
    return slug(F.coalesce(x, F.lit("")))


def in_place(items: DataFrame, cidade: str, uf: str = "", bairro: str = "") -> DataFrame:
    """Items (cidade, uf, bairro) of a city, with bairro_unknown.

    Cities are equal as slugs; states only have to agree where both are known; a district
    fits if either slug holds the other, and items without one stay, marked. No city: nothing.
    """
    city, state, district = _slug(F.lit(cidade)), F.lit(uf.upper()), _slug(F.lit(bairro))
    own_state, own_district = F.upper(F.coalesce("uf", F.lit(""))), _slug(F.col("bairro"))
    nowhere = F.coalesce(F.col("bairro"), F.lit("")) == ""
    out = items.where((city != "") & (_slug(F.col("cidade")) == city) & ((state == "") | (own_state == "") | (own_state == state)))
    out = out.where((district == "") | nowhere | F.contains(own_district, district) | F.contains(district, own_district))
    return out.withColumn("bairro_unknown", (district != "") & nowhere)


def within_credits(items: DataFrame, user_credits: float | None) -> DataFrame:
    """Items whose least credits the user has, with user_plan_ok; unknown ones go. Without user credits all stay, undecided."""
    if user_credits is None:
        return items.withColumn("user_plan_ok", F.lit(None).cast("boolean"))
    least = credits_of(F.col("creditos_minimos"), F.col("plano_minimo"))
    return items.where(least <= user_credits).withColumn("user_plan_ok", F.lit(True))


def plan_catalog(items: DataFrame) -> DataFrame:
    """(plan_key, nome, creditos_por_dia, valor_mensal_brl): each plan as its first item by ``ord`` has it.

    A minimum of structs, so a plan that holds most of the items combines before the shuffle.
    """
    key = F.coalesce(F.nullif("plano_minimo", F.lit("")), F.concat(F.lit("creditos_"), F.coalesce(F.col("creditos_minimos").cast("string"), F.lit("null"))))
    first = F.min_by(F.struct(F.col("plano_minimo").alias("nome"), F.col("creditos_minimos").alias("creditos_por_dia"), "valor_mensal_brl"), "ord")
    return items.groupBy(key.alias("plan_key")).agg(first.alias("plan")).select("plan_key", "plan.*")


def cheapest(items: DataFrame, key: list[str], price: str, order: str) -> DataFrame:
    """Each key's cheapest item; null prices come last, and ties go by ``order``."""
    rest = [c for c in items.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(F.coalesce(F.col(price).cast("double"), F.lit(9e9)).alias("p"), order))
    return items.groupBy(*key).agg(best.alias("_best")).select(*key, "_best.*")


def sources_with_plans(chunks: DataFrame) -> DataFrame:
    """Chunks (source, chunk_type, has_plan) without the sources whose gym chunks all lack plans; sources without gyms stay."""
    gym = F.col("chunk_type") == "gp_gym"
    bare = chunks.where(gym).groupBy("source").agg(F.max(F.coalesce("has_plan", F.lit(False))).alias("any_plan")).where(~F.col("any_plan"))
    return chunks.join(bare.select(F.col("source").alias("_bare")), F.col("source").eqNullSafe(F.col("_bare")), "left_anti")


def merge_places(rows: DataFrame, key: str, place: str, order: str, attributes: list[str]) -> DataFrame:
    """Per key the attributes of its first row, and its distinct places by first appearance.

    Places are made distinct before they are gathered, so an array holds no more than the places there are.
    """
    once = rows.groupBy(key, place).agg(F.min(order).alias("_first"), F.min_by(F.struct(*attributes), order).alias("_attributes"))
    gathered = F.transform(F.sort_array(F.collect_list(F.struct("_first", place))), lambda x: x[place])
    return once.groupBy(key).agg(F.min_by("_attributes", "_first").alias("_attributes"), gathered.alias("places")).select(key, "_attributes.*", "places")


def activity_chunks(places: DataFrame, group_id: str, rank: Column) -> DataFrame:
    """One chunk for each place (nome, endereco, plano_minimo) and activity (nome, plano_minimo), or one listing for a place without.

    rank is a Column over ``plano``, the activity's plan. Secondary activities are the others of the place.
    """
    named = lambda x: slug(x, "_")
    out = places.select("*", F.explode_outer("modalidades").alias("_m"))
    listed = F.col("_m").isNull()
    out = out.withColumn("plano", F.when(listed, F.col("plano_minimo")).otherwise(F.col("_m.plano_minimo")))
    digest = F.when(listed, content_hash(F.lit(group_id), F.col("nome"), F.col("endereco"))).otherwise(content_hash(F.lit(group_id), F.col("nome"), F.col("_m.nome"), F.col("endereco"), F.col("plano")))
    others = F.transform(F.filter("modalidades", lambda x: x["nome"] != F.col("_m.nome")), lambda x: named(x["nome"]))
    return out.withColumn("content_hash", digest).select(
        F.when(listed, short_id("tp-fallback-", F.col("content_hash"))).otherwise(short_id("tp-", F.col("content_hash"))).alias("chunk_id"),
        F.when(listed, "gym_listing").otherwise("gym_modality").alias("chunk_type"), "nome", "endereco",
        F.when(listed, "academia_geral").otherwise(named(F.col("_m.nome"))).alias("modalidade"),
        F.when(listed, F.array().cast("array<string>")).otherwise(others).alias("modalidades_secundarias"),
        "plano", rank.alias("plano_rank"), "content_hash",
    )


def context_block(hits: DataFrame, empty: str = "(nenhum chunk relevante encontrado)") -> DataFrame:
    """(context) of the at most 50 hits of a search (rank, chunk_id, score, modalidade, text), each as an escaped element."""
    field = lambda c: escape_xml(F.coalesce(none_if_blank(F.col(c)), F.lit("")))
    head = F.concat(F.lit('<chunk id="'), escape_xml(F.col("chunk_id")), F.lit('" score="'), F.format_string("%.2f", F.coalesce("score", F.lit(0.0))), F.lit('" modalidade="'), field("modalidade"), F.lit('">'))
    block = F.concat_ws("\n", head, escape_xml(F.coalesce("text", F.lit(""))), F.lit("</chunk>"))
    blocks = F.transform(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"])
    return hits.agg(F.coalesce(F.nullif(F.array_join(blocks, "\n\n"), F.lit("")), F.lit(empty)).alias("context"))
