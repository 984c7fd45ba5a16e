"""Filtered hybrid top-k over chunks, reranking and grouping of what it finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ranking import best_of_block, blend, nearness, question_rank, ts_rank
from tessera.functions.text import fold, none_if_blank

DEFAULT_K, MOST_K = 15, 50
BOOST = 0.08
# The order in which activities are listed; others come last.
ACTIVITY_ORDER = ["musculacao", "funcional", "crossfit", "pilates", "yoga", "muay_thai", "jiu_jitsu", "boxe", "natacao", "danca", "spinning", "academia_geral"]


def clamp_k(k: int | None) -> int:
    """null: 15; below 1: 1; above 50: 50."""
    return max(1, min(DEFAULT_K if k is None else k, MOST_K))


def visible_to(tenant: str | None) -> Column:
    """A null tenant sees all rows; rows without a tenant are seen by all."""
    return F.lit(True) if tenant is None else F.col("tenant_id").isNull() | (F.col("tenant_id") == tenant)


def has_activity(key: str) -> Column:
    """ILIKE on the label, with its wildcards unescaped, or containment in the key, or membership in the secondary list."""
    return F.coalesce(F.col("modalidade").ilike(f"%{key}%"), F.lit(False)) | F.coalesce(F.contains("modalidade_key", F.lit(key)), F.lit(False)) | F.coalesce(F.array_contains("modalidades_secundarias", key), F.lit(False))


def in_city(name: str, mode: str = "strict") -> Column:
    """strict: equal without case to the city or a related one; equal: to the city only; contains: either side inside the other. Accents count."""
    wanted = F.lower(F.lit(name))
    city = F.coalesce(F.lower("cidade"), F.lit(""))
    related = F.coalesce("municipios_relacionados", F.array().cast("array<string>"))
    if mode == "equal":
        return city == wanted
    if mode == "strict":
        return (city == wanted) | F.exists(related, lambda m: F.lower(m) == wanted)
    return F.contains(city, wanted) | ((city != "") & F.contains(wanted, city)) | F.exists(related, lambda m: F.contains(F.lower(m), wanted))


def match_chunks(chunks: DataFrame, query: list[float], group_id=None, tenant_id: str | None = None, modalidade: str | None = None, bairro: str | None = None, plano_rank: int | None = None, municipio: str | None = None, k: int | None = DEFAULT_K, min_similarity: float | None = 0.6, terms: list[str] | None = None, municipio_mode: str = "strict", question: str | None = None) -> DataFrame:
    """The k chunks nearest to a vector among those that pass all filters, with similarity and score.

    Cheap predicates come before the cosine; min_similarity bounds the similarity, not the
    score; blank filters are none; a null min_similarity gives no rows. Without terms the
    score is the similarity, with an empty list 0.7 of it. A question instead of terms is stemmed.
    Ties go by chunk_id.
    """
    blank = lambda x: None if x is None or not x.strip() else x.strip()
    out = chunks.where(F.col("embedding").isNotNull() & visible_to(tenant_id))
    if group_id is not None:
        out = out.where(F.col("group_id") == group_id)
    if blank(modalidade):
        out = out.where(has_activity(blank(modalidade)))
    if blank(bairro):
        out = out.where(F.col("bairro_normalizado") == blank(bairro))
    if plano_rank is not None:
        out = out.where(F.coalesce("plano_minimo_rank", F.lit(99)) <= plano_rank)
    if blank(municipio):
        out = out.where(in_city(blank(municipio), municipio_mode))
    out = out.withColumn("similarity", nearness(F.col("embedding"), [float(x) for x in query])).where(F.col("similarity") >= F.lit(min_similarity).cast("double"))
    if blank(question):
        score = blend(F.col("similarity"), question_rank(F.col("text"), blank(question)))
    else:
        score = F.col("similarity") if terms is None else blend(F.col("similarity"), ts_rank(F.col("text"), terms))
    return out.withColumn("score", score).orderBy(F.desc("score"), F.desc("similarity"), "chunk_id").limit(clamp_k(k))


def batch_match(chunks: DataFrame, queries: DataFrame, k: int = DEFAULT_K, min_similarity: float = 0.0, block: int = 4096) -> DataFrame:
    """Top-k for a stated set of queries (query_id, vector, group_id): queries meet the chunks of their group only.

    A group's chunks and queries are dealt into blocks of about ``block`` rows by a hash; each pair
    of blocks is scored by one matrix product and gives k hits a query, of which the best k are
    then taken. Only hits meet the other columns again. chunk_id and query_id are unique.
    """
    k = clamp_k(k)

    def dealt(side: str, rows: DataFrame, other: DataFrame, vector: str, ids: str, mine: str, theirs: str) -> DataFrame:
        """Rows with the number of their own block, once for each block of the other side."""
        size = lambda df, name: df.groupBy("group_id").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(block))).cast("int").alias(name))
        held = rows.where(F.col(vector).isNotNull() & F.col("group_id").isNotNull()).select("group_id", F.col(ids), F.col(vector), F.size(vector).alias("width"))
        counted = held.join(size(rows, "own"), "group_id").join(size(other, "others"), "group_id")
        blocks = counted.select(F.col("group_id").alias(f"{side}_group"), F.col("width").alias(f"{side}_width"), ids, vector, F.pmod(F.xxhash64(ids), F.col("own")).cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("theirs"))
        return blocks.withColumnsRenamed({"mine": f"{side}_{mine}", "theirs": f"{side}_{theirs}"})

    left = dealt("query", queries, chunks, "vector", "query_id", "q", "c")
    right = dealt("chunk", chunks, queries, "embedding", "chunk_id", "c", "q")
    keys = lambda side: [f"{side}_{x}" for x in ("group", "width", "q", "c")]
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, similarity double"
    best = left.groupBy(*keys("query")).cogroup(right.groupBy(*keys("chunk"))).applyInPandas(lambda a, b: best_of_block(a, b, k, min_similarity), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    hits = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return hits.join(chunks, "chunk_id").join(queries.withColumnRenamed("group_id", "query_group"), "query_id")


def rerank(hits: DataFrame, boosted: Column) -> DataFrame:
    """Hits of a batch ranked anew by similarity with the boost of those for which a condition holds, then by similarity and chunk_id."""
    score = F.col("similarity") + F.when(boosted, BOOST).otherwise(0.0)
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(score.desc(), F.desc("similarity"), "chunk_id")))


def boost_city(hits: DataFrame, municipio: str | None) -> DataFrame:
    """score + 0.08, at most 1, where the city is the wanted one without case and accents; a blank city changes nothing."""
    if municipio is None or not municipio.strip():
        return hits.withColumn("boosted", F.lit(False))
    primary = F.coalesce((F.col("cidade") != "") & (fold(F.col("cidade")) == fold(F.lit(municipio))), F.lit(False))
    score = F.coalesce("score", "similarity", F.lit(0.0))
    return hits.withColumn("boosted", primary).withColumn("score", F.when(primary, F.least(score + BOOST, F.lit(1.0))).otherwise(score))


def cut_to_city(hits: DataFrame, municipio: str | None) -> DataFrame:
    """Hits in the city itself if there are any, else those it is related to; no city: all."""
    if municipio is None or not municipio.strip():
        return hits
    wanted = fold(F.lit(municipio))
    marked = hits.withColumn("is_primary", F.coalesce(fold(F.col("cidade")) == wanted, F.lit(False))).withColumn("is_related", F.exists(F.coalesce("municipios_relacionados", F.array().cast("array<string>")), lambda m: fold(m) == wanted))
    # Hits of one search, 50 rows at most, so the window over all of them is small; the search runs once.
    found = marked.withColumn("any_primary", F.max("is_primary").over(Window.partitionBy(F.lit(1))))
    return found.where(F.when(F.col("any_primary"), F.col("is_primary")).otherwise(F.col("is_related"))).drop("is_primary", "is_related", "any_primary")


def first_of(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in an explicit order. Keys are high-cardinality ids, so no group is large."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_place = 1").drop("_place")


def name_activity(name: Column) -> Column:
    """The activity that a name states, by ordered rules, else null."""
    from tessera.functions.query_filters import ascii_words

    # Rules on names without accents, first match wins.
    rules = [(r"<yogaa?>|\.yoga", "yoga"), (r"<pilates>", "pilates"), (r"<cross\s*fit>", "crossfit"), (r"<muay\s*thai>", "muay_thai"), (r"<jiu[-\s]?jitsu>|<bjj>", "jiu_jitsu"), (r"<boxe>", "boxe"), (r"<nata[cç][aã]o>", "natacao"), (r"<dan[cç][ae]>", "danca"), (r"<funcional>", "funcional"), (r"<spinning>", "spinning")]
    plain = fold(name)
    out = F.lit(None).cast("string")
    for pattern, label in reversed(rules):
        out = F.when(plain.rlike(ascii_words(pattern)), F.lit(label)).otherwise(out)
    return out


def effective_activity(name: Column, stated: Column) -> Column:
    """struct(modality, source): the name's activity where it differs from the stated one."""
    chunk = F.coalesce(none_if_blank(F.lower(stated)), F.lit("academia_geral"))
    named = name_activity(name)
    differs = F.coalesce(named != chunk, F.lit(False))
    return F.struct(F.when(differs, named).otherwise(chunk).alias("modality"), F.when(differs, F.lit("name")).otherwise(F.lit("chunk")).alias("source"))


def best_per_activity(gyms: DataFrame) -> DataFrame:
    """(modality, gym_id, score, ord, …): the best score of each gym in each activity, the first on ties, with the listing place of the activity."""
    best = first_of(gyms, ["modality", "gym_id"], [F.desc("score"), F.col("ord")])
    place = F.array_position(F.array(*[F.lit(x) for x in ACTIVITY_ORDER]), F.col("modality"))
    return best.withColumn("place", F.when(place > 0, place - 1).otherwise(99).cast("int"))


def plan_buckets(gyms: DataFrame) -> DataFrame:
    """(gym_id, plano, rank, valor, ord): unique gyms at their lowest rank, then per plan the count, lowest rank and last stated price."""
    unique = first_of(gyms, ["gym_id"], [F.coalesce("rank", F.lit(99)).asc(), F.col("ord")])
    stated = F.when(F.col("valor").isNotNull() & (F.col("valor") != "N/A"), F.col("ord"))
    return unique.groupBy("plano").agg(F.count(F.lit(1)).alias("gyms"), F.min(F.coalesce("rank", F.lit(99))).alias("rank"), F.max_by("valor", stated).alias("valor"))


def first_marker(rows: DataFrame, marker: Column) -> DataFrame:
    """The marker of the first row by ``ord`` that has one, else 'unknown'."""
    return rows.agg(F.coalesce(F.min_by(marker, F.when(marker.isNotNull(), F.col("ord"))), F.lit("unknown")).alias("marker"))
