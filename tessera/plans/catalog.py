"""Queries on offers, plans, messages and keyed writes, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import classify, text
from tessera.operators import catalog, crm, retrieval, store
from tessera.plans.adapt import CHUNKS_SQL, chunks, query_vector
from tessera.plans.registered import query
from tessera.session import table
from tessera.streaming import inbound

ITEMS_SQL = """
items AS (
  SELECT c_custkey AS ord, CASE c_custkey % 3 WHEN 0 THEN 'Fortaleza' WHEN 1 THEN 'FORTALEZA' ELSE 'Natal' END AS cidade, CASE c_custkey % 4 WHEN 1 THEN 'ce' WHEN 2 THEN 'CE' WHEN 3 THEN 'RN' END AS uf,
         CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS bairro, CASE WHEN c_custkey % 7 <> 0 THEN 'Ilimitado ' || (c_custkey % 10 * 10) END AS plano_minimo,
         CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 100 END AS creditos_minimos, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS valor_mensal_brl
  FROM customer)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as offers: city, state, district, plan, credits and price by arithmetic on the key."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("ord"), F.when(k % 3 == 0, "Fortaleza").when(k % 3 == 1, "FORTALEZA").otherwise("Natal").alias("cidade"), F.when(k % 4 == 1, "ce").when(k % 4 == 2, "CE").when(k % 4 == 3, "RN").alias("uf"),
        F.when(k % 5 != 0, F.col("c_mktsegment")).alias("bairro"), F.when(k % 7 != 0, F.concat(F.lit("Ilimitado "), (k % 10 * 10).cast("string"))).alias("plano_minimo"),
        F.when(k % 2 == 0, k % 100).alias("creditos_minimos"), F.when(k % 11 != 0, F.col("c_acctbal")).alias("valor_mensal_brl"),
    )


@query(rf"""WITH {ITEMS_SQL} SELECT ord, bairro IS NULL AS bairro_unknown, true AS user_plan_ok FROM items
WHERE lower(cidade) = 'fortaleza' AND (uf IS NULL OR upper(uf) = 'CE') AND (bairro IS NULL OR contains(lower(bairro), 'build')) AND coalesce(creditos_minimos, nullif(regexp_extract(plano_minimo, '(\d+)', 1), '')::INT) <= 60""")
def accept_list(spark, sf_dir):
    held = catalog.in_place(items(spark, sf_dir), "fortaléza", "ce", "Build")
    return catalog.within_credits(held, 60).select("ord", "bairro_unknown", "user_plan_ok")


@query(f"""WITH {ITEMS_SQL}, k AS (SELECT *, coalesce(plano_minimo, 'creditos_' || coalesce(creditos_minimos::VARCHAR, 'null')) AS plan_key FROM items)
SELECT plan_key, plano_minimo AS nome, creditos_minimos AS creditos_por_dia, valor_mensal_brl FROM k QUALIFY row_number() OVER (PARTITION BY plan_key ORDER BY ord) = 1""")
def offer_catalog(spark, sf_dir):
    return catalog.plan_catalog(items(spark, sf_dir))


@query(f"WITH {ITEMS_SQL} SELECT cidade, plano_minimo, ord, valor_mensal_brl FROM items QUALIFY row_number() OVER (PARTITION BY cidade, plano_minimo ORDER BY coalesce(valor_mensal_brl, 9e9), ord) = 1")
def cheapest_offer(spark, sf_dir):
    return catalog.cheapest(items(spark, sf_dir), ["cidade", "plano_minimo"], "valor_mensal_brl", "ord").select("cidade", "plano_minimo", "ord", "valor_mensal_brl")


@query("""WITH d AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 'gp_gym' ELSE 'page' END AS chunk_type, doc_id % 2 = 0 AND source NOT IN ('src1', 'src3') AS has_plan FROM documents)
SELECT doc_id, source FROM d WHERE source IS NULL OR source NOT IN (SELECT source FROM d WHERE chunk_type = 'gp_gym' GROUP BY source HAVING NOT bool_or(has_plan))""")
def sources_with_plans(spark, sf_dir):
    has_plan = (F.col("doc_id") % 2 == 0) & ~F.col("source").isin("src1", "src3")
    held = table(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 3 == 0, "gp_gym").otherwise("page").alias("chunk_type"), has_plan.alias("has_plan"))
    return catalog.sources_with_plans(held).select("doc_id", "source")


@query("""WITH o AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS f, arg_min(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY ALL)
SELECT o_custkey, arg_min(s, f) AS o_orderstatus, string_agg(o_orderpriority, ',' ORDER BY f) AS places FROM o GROUP BY o_custkey""")
def places_per_key(spark, sf_dir):
    found = catalog.merge_places(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey", ["o_orderstatus"])
    return found.withColumn("places", F.array_join("places", ","))


@query("""WITH p AS (SELECT p_name || ' ' || p_partkey AS nome, p_type AS endereco, 'TP ' || (p_size % 8) AS plano_minimo, p_partkey % 4 AS n,
  [{'nome': 'Muay Thai', 'plano': 'TP 1'}, {'nome': 'Jiu-Jitsu', 'plano': 'TP ' || (p_size % 7 + 1)}, {'nome': 'Natação', 'plano': 'TP 9'}] AS m FROM part),
c AS (SELECT nome, endereco, 'gym_listing' AS chunk_type, 'academia_geral' AS modalidade, '' AS secundarias, plano_minimo AS plano, sha256(concat_ws('|', 'g', nome, endereco)) AS h, 'tp-fallback-' AS prefix FROM p WHERE n = 0
  UNION ALL
  SELECT nome, endereco, 'gym_modality', (['muay_thai', 'jiu_jitsu', 'natacao'])[i], array_to_string(list_filter((['muay_thai', 'jiu_jitsu', 'natacao'])[1:n], lambda x, j: j <> i), ','), m[i].plano, sha256(concat_ws('|', 'g', nome, m[i].nome, endereco, m[i].plano)), 'tp-'
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM p))
SELECT prefix || substr(h, 1, 16) AS chunk_id, chunk_type, nome, modalidade, secundarias, CASE plano WHEN 'TP 0' THEN 1 WHEN 'TP 1' THEN 2 WHEN 'TP 2' THEN 4 WHEN 'TP 3' THEN 5 WHEN 'TP 4' THEN 6 WHEN 'TP 5' THEN 7 WHEN 'TP 6' THEN 9 ELSE 10 END AS plano_rank, h AS content_hash FROM c""")
def gym_modality_chunks(spark, sf_dir):
    of = lambda name, plan: F.struct(F.lit(name).alias("nome"), plan.alias("plano_minimo"))
    stated = F.concat(F.lit("TP "), (F.col("p_size") % 7 + 1).cast("string"))
    every = F.array(of("Muay Thai", F.lit("TP 1")), of("Jiu-Jitsu", stated), of("Natação", F.lit("TP 9")))
    places = table(spark, sf_dir, "part").select(
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("nome"), F.col("p_type").alias("endereco"), F.concat(F.lit("TP "), (F.col("p_size") % 8).cast("string")).alias("plano_minimo"),
        F.slice(every, F.lit(1), (F.col("p_partkey") % 4).cast("int")).alias("modalidades"),
    )
    found = catalog.activity_chunks(places, "g", classify.plan_rank(F.col("plano")))
    return found.select("chunk_id", "chunk_type", "nome", "modalidade", F.array_join("modalidades_secundarias", ",").alias("secundarias"), "plano_rank", "content_hash")


_TAILS = ["Studio", "Academia", "Espaço Bem-Estar", "MEDITAÇÃO", "Spa", "spaço", "Tênis", "Boxe", "CrossFit", "Dojô", "Pro 9", "Pilates Yoga"]
_RULES_SQL = " ".join("WHEN regexp_matches(hay, '(?i)" + p.replace("<", r"(?:^|[^A-Za-z0-9_])").replace(">", r"(?:$|[^A-Za-z0-9_])") + f"') THEN '{label}:{weight / 100}'" for p, label, weight in classify.ACTIVITY_RULES)


@query(rf"""WITH p AS (SELECT p_partkey, p_name || ' ' || ({_TAILS})[(p_partkey % 12 + 1)::INT] AS name, p_type AS address, p_partkey % 13 * 50 AS price FROM part),
a AS (SELECT p_partkey, CASE {_RULES_SQL} WHEN regexp_matches(name, '(?i)\bstudio\b') THEN 'pilates:0.6' WHEN regexp_matches(name, '(?i)(^| )espa[çc]o( |$)') AND regexp_matches(name, '(?i)bem[\s-]?estar') THEN 'pilates:0.5'
  WHEN price >= 500 THEN 'spa:0.4' WHEN price > 0 AND price <= 80 THEN 'academia_geral:0.4' ELSE 'desconhecida:0.0' END AS x FROM (SELECT *, name || ' ' || address AS hay FROM p))
SELECT p_partkey, split_part(x, ':', 1) AS modality, split_part(x, ':', 2)::DOUBLE AS confidence, CASE WHEN x = 'desconhecida:0.0' THEN 'llm_fallback' ELSE 'rule' END AS method FROM a""")
def classify_modality(spark, sf_dir):
    name = F.concat_ws(" ", "p_name", F.element_at(F.array(*[F.lit(x) for x in _TAILS]), (F.col("p_partkey") % 12 + 1).cast("int")))
    found = classify.classify_activity(name, F.col("p_type"), F.col("p_partkey") % 13 * 50)
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("x")).select("p_partkey", "x.*")


_ENDS = ["tenho TP 3 e", "tp5", "Ilimitado 70", "30 créditos", "tp go", "nada", "TotalPass TP 6", "tp free"]


@query(rf"""WITH q AS (SELECT item_id, lower(text || ' ' || ({_ENDS})[(item_id % 8 + 1)::INT]) AS q FROM benchmark),
a AS (SELECT *, nullif(regexp_extract(q, '(?:^|[^a-z0-9_])tp\s*(\d+)(?:$|[^a-z0-9_])', 1), '') AS n, nullif(regexp_extract(q, '(?:^|[^a-z0-9_])tp\s*(go|free)(?:$|[^a-z0-9_])', 1), '') AS w FROM q)
SELECT item_id, coalesce('TP ' || n, CASE w WHEN 'go' THEN 'TP GO' WHEN 'free' THEN 'TP Free' END) AS plan,
  CASE coalesce(n, w, '') WHEN 'go' THEN 1 WHEN 'free' THEN 0 WHEN '3' THEN 5 WHEN '5' THEN 7 WHEN '6' THEN 9 WHEN '' THEN 99 ELSE 1 + n::INT END AS plan_rank,
  coalesce(nullif(regexp_extract(q, 'ilimitado\s*(\d+)', 1), ''), nullif(regexp_extract(q, '(\d+)\s*cr[eé]ditos?', 1), ''))::INT AS credits FROM a""")
def asked_plans(spark, sf_dir):
    q = F.concat_ws(" ", "text", F.element_at(F.array(*[F.lit(x) for x in _ENDS]), (F.col("item_id") % 8 + 1).cast("int")))
    plan = classify.asked_plan(q)
    return table(spark, sf_dir, "benchmark").select("item_id", plan.alias("plan"), classify.plan_rank(plan).alias("plan_rank"), classify.asked_credits(q).alias("credits"))


@query(rf"""WITH a AS (SELECT c_custkey, 'Rua ' || c_name || ', ' || c_mktsegment || (['- Fortaleza', ', fortaleza, CE', ' - Fortalezas', ' - Natal'])[(c_custkey % 4 + 1)::INT] AS a FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN trim(regexp_extract(a, ',\s*([^,]+?)\s*(?:-|,)\s*[Ff]ortaleza', 1)) END AS district FROM a""")
def district_of_address(spark, sf_dir):
    ends = F.array(*[F.lit(x) for x in ("- Fortaleza", ", fortaleza, CE", " - Fortalezas", " - Natal")])
    address = F.concat(F.lit("Rua "), F.col("c_name"), F.lit(", "), F.col("c_mktsegment"), F.element_at(ends, (F.col("c_custkey") % 4 + 1).cast("int")))
    return table(spark, sf_dir, "customer").select("c_custkey", classify.district_before(address).alias("district"))


@query(f"""WITH {CHUNKS_SQL}, h AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, chunk_id) AS rank FROM s WHERE similarity >= 0.0 ORDER BY similarity DESC, chunk_id LIMIT 15)
SELECT coalesce(string_agg('<chunk id="' || chunk_id || '" score="' || printf('%.2f', similarity) || '" modalidade="' || replace(modalidade_key, '_', ' ') || '">' || chr(10) || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || chr(10) || '</chunk>', chr(10) || chr(10) ORDER BY rank), '(nenhum chunk relevante encontrado)') AS context FROM h""")
def answer_context(spark, sf_dir):
    hits = retrieval.match_chunks(chunks(spark, sf_dir), query_vector(spark, sf_dir), min_similarity=0.0)
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), F.desc("similarity"), "chunk_id")))
    return catalog.context_block(ranked)


_MARKED = "'## ' || lang || chr(10) || '- **' || source || '** [' || lang || '](http://x) *x* \"' || text || '\"'"


@query(rf"""WITH m AS (SELECT doc_id, {_MARKED} AS x FROM documents)
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '(^|[^*])\*([^*\n]+)\*([^*]|$)', '\1\2\3', 'g'), '(^|[^*])\*([^*\n]+)\*([^*]|$)', '\1\2\3', 'g'), '(?m)^#{{1,6}}\s+', '', 'g'), '(?m)^[*-]\s+', '', 'g'), '["''`]', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS plain FROM m""")
def markdown_stripped(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.strip_markdown(F.expr(_MARKED.replace("chr(10)", "char(10)"))), 256).alias("plain"))


_BROKEN = "text || chr(10) || 'frag-' || chr(10) || 'mento ..... 9' || chr(10) || chr(10) || 'A ______ 3 …_.… B ... C' || chr(173) || 'D' || chr(160) || ' ' || 'e-' || chr(173) || chr(10) || 'f g' || chr(173) || '-' || chr(10) || 'h'"
_BLANK = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


@query(rf"""WITH b AS (SELECT doc_id, {_BROKEN} AS x FROM documents), h AS (SELECT doc_id, replace(regexp_replace(x, '(\p{{L}})-{_BLANK}*\n{_BLANK}*(\p{{L}})', '\1\2', 'g'), chr(173), '') AS x FROM b)
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(x, '[.…_][.…_][.…_][.…_]+', ' ', 'g'), '{_BLANK}+', ' ', 'g'))) AS clean FROM h""")
def pdf_text_cleaned(spark, sf_dir):
    broken = F.expr(_BROKEN.replace("chr(10)", "char(10)"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.clean_pdf_text(broken), 256).alias("clean"))


@query("""SELECT c_custkey AS lead_id, CASE c_custkey % 3 WHEN 0 THEN 'qualifying' WHEN 1 THEN 'discarded' ELSE 'new' END AS status, CASE WHEN c_custkey % 3 = 0 THEN 'qualifying' ELSE 'new' END AS stage,
CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 9 END AS position FROM customer""")
def stage_moves(spark, sf_dir):
    k = F.col("c_custkey")
    held = table(spark, sf_dir, "customer")
    led, staged = held.select(k.alias("lead_id"), F.lit("new").alias("status")), held.select(k.alias("lead_id"), F.lit("new").alias("stage"), (k % 9).alias("position"))
    moves = held.where(k % 3 < 2).select(k.alias("lead_id"), F.when(k % 3 == 0, "qualifying").otherwise("discarded").alias("stage"))
    led, staged = crm.move_stage(led, staged, moves)
    return led.join(staged, "lead_id").select("lead_id", "status", "stage", "position")


@query("SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def insert_if_absent(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi").select("doc_id", "quality")
    return store.insert_absent(labels, table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("quality")), ["doc_id"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 4 <> 0")
def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return store.delete_children(table(spark, sf_dir, "orders"), gone, "o_custkey").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 4 <> 0 THEN o_custkey END AS o_custkey FROM orders")
def cascade_set_null(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return store.unlink_children(table(spark, sf_dir, "orders"), gone, "o_custkey").select("o_orderkey", "o_custkey")


@query("""SELECT conv_id || '-' || turn AS provider_id, '55' || conv_id AS phone, text, CASE WHEN conv_id % 3 = 1 THEN 'image' ELSE 'text' END AS kind
FROM conversations WHERE role = 'user'""")
def webhook_messages(spark, sf_dir):
    said = F.when(F.col("conv_id") % 3 == 1, F.struct(F.lit(None).cast("string").alias("conversation"), F.struct(F.col("text").alias("caption")).alias("imageMessage")))
    said = said.otherwise(F.struct(F.col("text").alias("conversation"), F.lit(None).cast("struct<caption:string>").alias("imageMessage")))
    key = F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat(F.lit("55"), F.col("conv_id").cast("string"), F.lit("@s.net")).alias("remoteJid"), (F.col("role") != "user").alias("fromMe"))
    shape = F.col("conv_id") + F.coalesce(F.col("turn"), F.lit(0))
    item = lambda message: F.struct(key.alias("key"), message.alias("message"))
    wrapped = said
    for name in inbound.WRAPPERS:
        wrapped = F.struct(F.struct(wrapped.alias("message")).alias(name))
    flat = F.struct(key["id"].alias("id"), key["remoteJid"].alias("remoteJid"), key["fromMe"].alias("fromMe"), said.alias("message"))
    listed = lambda x: F.struct(F.array(x).alias("messages"))
    data = lambda x: F.struct(x.alias("data"))
    shapes = [data(item(said)), data(F.array(item(wrapped))), data(listed(flat)), item(wrapped), F.array(item(said)), listed(item(said)), flat]
    payload = F.coalesce(*[F.when(shape % len(shapes) == k, F.to_json(x)) for k, x in enumerate(shapes)], F.to_json(shapes[0]))
    found = inbound.accepted(inbound.unpack(table(spark, sf_dir, "conversations").select(payload.alias("payload"))))
    return found.select("provider_id", text.jid(F.col("jid"))["phone"].alias("phone"), "text", "kind")


@query("SELECT count(*) AS total, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS assistants, count(*) FILTER (role NOT IN ('user', 'assistant') OR role IS NULL) AS others FROM conversations")
def role_counts(spark, sf_dir):
    role = F.coalesce("role", F.lit(""))
    return table(spark, sf_dir, "conversations").agg(F.count(F.lit(1)).alias("total"), F.count_if(role == "user").alias("users"), F.count_if(role == "assistant").alias("assistants"), F.count_if(~role.isin("user", "assistant")).alias("others"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, hour(ts)::INT AS hour, count(*) AS entries FROM events GROUP BY ALL")
def calendar_buckets(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("entries"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_partkey % 5 = 0 THEN p_retailprice END, CASE p_size % 4 WHEN 0 THEN 49.9 WHEN 1 THEN 99.9 WHEN 2 THEN 149.9 END::DOUBLE) AS price FROM part")
def plan_prices(spark, sf_dir):
    plan = F.concat(F.lit("TP "), (F.col("p_size") % 4).cast("string"))
    hint = F.when(F.col("p_partkey") % 5 == 0, F.col("p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", crm.price_of(plan, {"TP0": 49.9, "TP 1": 99.9, "TP2": 149.9}, hint).alias("price"))
