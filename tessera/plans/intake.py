"""Queries on loads, settings, embeddings and names, with their DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessera.functions import collation, text
from tessera.operators import answers, embedding, ingest, knowledge, render, retrieval, settings, store
from tessera.plans.adapt import CHUNKS_SQL, chunks
from tessera.plans.registered import query
from tessera.session import shared_folder, table

_SLOTS = 32


@query(rf"""WITH t AS (SELECT doc_id, substr(coalesce(text, ''), 1, 2000) AS x FROM documents),
w AS (SELECT doc_id, md5(unnest(list_filter(regexp_split_to_array(lower(x), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''))) AS h FROM t),
s AS (SELECT doc_id, ('0x' || substr(h, 1, 8))::BIGINT % {_SLOTS} AS slot, sum(CASE WHEN ('0x' || substr(h, 9, 1))::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS n FROM w GROUP BY ALL),
f AS (SELECT t.doc_id, i AS slot, coalesce(n, 0) AS n FROM t CROSS JOIN range({_SLOTS}) r(i) LEFT JOIN s ON s.doc_id = t.doc_id AND s.slot = i)
SELECT doc_id, string_agg(n, ',' ORDER BY slot) AS sums FROM f GROUP BY doc_id""")
def embedded_documents(spark, sf_dir):
    """Signed word sums of all documents, half of their different texts from a cache."""
    docs, made = table(spark, sf_dir, "documents").select("doc_id", "text"), embedding.hash_sums(_SLOTS)
    _, cache = embedding.with_embeddings(docs.where("doc_id % 2 = 0"), made, _SLOTS, "hash", most_chars=2000)
    found, _ = embedding.with_embeddings(docs, made, _SLOTS, "hash", cache=cache, most_chars=2000)
    return found.select("doc_id", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("sums"))


_WORD_SQL = "replace(regexp_extract(text, '[\\p{L}]+'), 'ß', 'ss')"


@query(f"WITH n AS (SELECT doc_id, source, {_WORD_SQL} AS name FROM documents) SELECT source, name, doc_id, row_number() OVER (PARTITION BY source ORDER BY name COLLATE pt, name, doc_id) AS place FROM n WHERE name <> '' QUALIFY place <= 25")
def names_in_order(spark, sf_dir):
    """The first 25 opening words of each source's documents, in the order of Portuguese."""
    held = _names(spark, sf_dir).where("name <> ''")
    return collation.first_by_name(held, ["source"], "name", "doc_id", 25).select("source", "name", "doc_id", "place")


def _names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.replace(F.regexp_extract("text", r"\p{L}+", 0), F.lit("ß"), F.lit("ss")).alias("name"))


@query(f"WITH n AS (SELECT {_WORD_SQL} AS name FROM documents), s AS (SELECT name, count(*) AS n FROM n WHERE name <> '' GROUP BY name) SELECT arg_min(name, k) AS name, count(*) AS spellings, sum(n)::BIGINT AS rows FROM (SELECT *, row_number() OVER (ORDER BY name COLLATE pt, name) AS k FROM s) GROUP BY lower(strip_accents(name))")
def names_folded(spark, sf_dir):
    """How often each opening word comes, whatever its case and accents."""
    return collation.count_names(_names(spark, sf_dir).where("name <> ''"), "name")


_RAW = """CASE doc_id % 7 WHEN 0 THEN 'x' || doc_id WHEN 1 THEN NULL ELSE ' ' || doc_id || ' ' END AS id,
CASE doc_id % 5 WHEN 0 THEN '12,5' WHEN 1 THEN '' WHEN 2 THEN '-3' ELSE doc_id || '.25' END AS score,
CASE doc_id % 3 WHEN 0 THEN '2024-02-30' WHEN 1 THEN '2024-02-29' END AS day"""


@query(f"""WITH r AS (SELECT doc_id, {_RAW} FROM documents),
c AS (SELECT doc_id, TRY_CAST(trim(id) AS BIGINT) AS i, trim(id) AS id, TRY_CAST(nullif(trim(score), '') AS DOUBLE) AS s, nullif(trim(score), '') AS score, TRY_CAST(day AS DATE) AS d, day FROM r)
SELECT doc_id, i AS id, s AS score, d::VARCHAR AS day, array_to_string(list_filter([CASE WHEN id IS NOT NULL AND i IS NULL THEN 'id:bigint' END, CASE WHEN score IS NOT NULL AND s IS NULL THEN 'score:double' END,
  CASE WHEN day IS NOT NULL AND d IS NULL THEN 'day:date' END, CASE WHEN id IS NULL THEN 'id:missing' END, CASE WHEN NOT coalesce(s >= 0, false) THEN 'negative' END], lambda x: x IS NOT NULL), ',') AS reasons FROM c""")
def quarantined_load(spark, sf_dir):
    """documents as raw records, loaded in one pass: good rows as they were cast, failed ones with their reasons."""
    raw = table(spark, sf_dir, "documents").select("doc_id", *[F.expr(x) for x in _RAW.split(",\n")])
    casts = {"doc_id": "bigint", "id": "bigint", "score": "double", "day": "date"}
    done = ingest.load(raw, shared_folder(spark, "load"), casts, ["id"], {"negative": F.col("loaded.score") >= 0})
    if done.counts["rows"] != done.counts["loaded"] + done.counts["failed"]:
        raise ValueError(f"counts don't add up: {done.counts}")
    ingest.audit(spark, shared_folder(spark, "audit"), "quarantined_load", done.counts, "now")
    good = done.good().withColumn("reasons", F.lit(""))
    # What failed stands as it came; the parts of it that can be cast are shown.
    cast = {"id": "bigint", "score": "double", "day": "date"}
    bad = done.quarantine().select("doc_id", *[F.trim(c).try_cast(kind).alias(c) for c, kind in cast.items()], F.array_join("reasons", ",").alias("reasons"))
    return good.unionByName(bad).withColumn("day", F.col("day").cast("string"))


_SETTINGS = """SELECT CASE WHEN doc_id % 10 < 8 THEN 't' || doc_id % 40 END AS tenant_id, CASE doc_id % 3 WHEN 0 THEN 'provider' WHEN 1 THEN 'model' ELSE 'reply' END AS key,
CASE WHEN doc_id % 11 = 0 THEN ' ' WHEN doc_id % 13 <> 0 THEN 'v' || doc_id END AS value, CASE WHEN doc_id % 4 <> 0 THEN lpad(doc_id % 100 || '', 3, '0') END AS updated_at FROM {0} WHERE doc_id % 50 < 9"""
_DEFAULTS = {"provider": "voyage", "reply": None, "version": "1"}


@query(f"""WITH s AS ({_SETTINGS.format('documents')}), k AS (SELECT tenant_id, key, arg_max(value, (coalesce(updated_at, ''), value)) AS value FROM s WHERE trim(value) <> '' GROUP BY ALL),
d AS (SELECT doc_id, CASE WHEN doc_id % 6 <> 0 THEN 't' || doc_id % 60 END AS tenant_id FROM documents)
SELECT doc_id, coalesce((SELECT value FROM k WHERE k.tenant_id = d.tenant_id AND key = 'provider'), (SELECT value FROM k WHERE k.tenant_id IS NULL AND key = 'provider'), 'voyage') AS provider,
  coalesce((SELECT value FROM k WHERE k.tenant_id = d.tenant_id AND key = 'model'), (SELECT value FROM k WHERE k.tenant_id IS NULL AND key = 'model')) AS model,
  coalesce((SELECT value FROM k WHERE k.tenant_id = d.tenant_id AND key = 'reply'), (SELECT value FROM k WHERE k.tenant_id IS NULL AND key = 'reply')) AS reply, '1' AS version FROM d""")
def settings_by_scope(spark, sf_dir):
    """Each document's settings: of its tenant, or global, or by default."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    said = spark.sql(_SETTINGS.format("{docs}"), docs=docs)
    rows = docs.select("doc_id", F.when(F.col("doc_id") % 6 != 0, F.concat(F.lit("t"), (F.col("doc_id") % 60).cast("string"))).alias("tenant_id"))
    return settings.resolved(rows, said, ["provider", "model", "reply", "version"], _DEFAULTS).drop("tenant_id")


_RIGHTS = {"admin": {"see", "see_all", "edit"}, "creator": {"see", "edit"}, "viewer": {"see"}, "bot": set()}


@query("""WITH d AS (SELECT doc_id, (['admin', 'creator', 'viewer', 'bot', 'stranger', NULL])[(doc_id % 6 + 1)::INT] AS role, CASE WHEN doc_id % 5 <> 0 THEN 't' || doc_id % 3 END AS mine, CASE WHEN doc_id % 4 <> 0 THEN 't' || doc_id % 2 END AS theirs FROM documents)
SELECT doc_id, coalesce(role = 'admin' OR (role IN ('creator', 'viewer') AND (theirs IS NULL OR coalesce(theirs = mine, false))), false) AS visible, coalesce(role IN ('admin', 'creator'), false) AS editable FROM d""")
def rights_by_role(spark, sf_dir):
    """Requests of users for rows, decided by their role and tenant."""
    k = F.col("doc_id")
    role = F.element_at(F.array(*[F.lit(x) for x in ("admin", "creator", "viewer", "bot", "stranger", None)]), (k % 6 + 1).cast("int"))
    mine, theirs = F.when(k % 5 != 0, F.concat(F.lit("t"), (k % 3).cast("string"))), F.when(k % 4 != 0, F.concat(F.lit("t"), (k % 2).cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", settings.row_filter(_RIGHTS, role, mine, theirs).alias("visible"), settings.allows(_RIGHTS, role, "edit").alias("editable"))


_GYM = """doc_id AS ord, CASE WHEN doc_id % 500 = 77 THEN 'Crossfit Aldeota ' || doc_id ELSE 'Gym ' || doc_id END AS name,
CASE doc_id % 9 WHEN 0 THEN 'Coco' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE source END AS bairro, CASE WHEN doc_id % 4 <> 0 THEN 'Ilimitado ' || doc_id % 90 END AS plano_minimo,
CASE WHEN doc_id % 7 = 1 THEN doc_id % 50 END AS creditos_minimos, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 90 + 0.5 END AS valor_mensal_brl"""
_GYM_QUESTION = """CASE item_id % 9 WHEN 0 THEN 'Qual o VALOR do plano Ilimitado ' || item_id % 95 || '?' WHEN 1 THEN 'academias no cocó com ' || item_id % 100 || ' créditos' WHEN 2 THEN 'a mais barata com ilimitado ' || item_id % 30
WHEN 3 THEN 'crossfit aldeota com ' || item_id % 100 || ' creditos' WHEN 4 THEN 'Crossfit Aldeota' WHEN 5 THEN 'quais aceitam ilimitado ' || item_id % 60 WHEN 6 THEN 'bom dia' WHEN 7 THEN 'LISTA' ELSE 'mais barata' END"""


@query(f"""WITH g AS (SELECT *, coalesce(creditos_minimos, TRY_CAST(nullif(regexp_extract(plano_minimo, '[0-9]+'), '') AS BIGINT)) AS need, plano_minimo IS NOT NULL OR creditos_minimos IS NOT NULL OR valor_mensal_brl IS NOT NULL AS listed,
  '• ' || name || ' (' || coalesce(nullif(bairro, ''), '?') || ') — ' || coalesce(plano_minimo, '?') || ' / R$' || coalesce(valor_mensal_brl::DOUBLE::VARCHAR, '?') AS line FROM (SELECT {_GYM} FROM documents)),
q AS (SELECT item_id, lower({_GYM_QUESTION}) AS q FROM benchmark),
a AS (SELECT *, TRY_CAST(coalesce(nullif(regexp_extract(q, 'ilimitado\\s*([0-9]+)', 1), ''), nullif(regexp_extract(q, '([0-9]+)\\s*cr[eé]ditos?', 1), '')) AS BIGINT) AS c FROM q),
t AS (SELECT count(*) FILTER (listed) AS listed, arg_min(line, ord) FILTER (contains(lower(name), 'crossfit aldeota')) AS named, coalesce(arg_min(need, ord) FILTER (contains(lower(name), 'crossfit aldeota')), 70) AS named_need,
  arg_min(coalesce(plano_minimo, 'null') || ' (R$' || coalesce(valor_mensal_brl::DOUBLE::VARCHAR, 'null') || ')', ord) FILTER (contains(lower(name), 'crossfit aldeota')) AS named_plan FROM g),
f AS (SELECT item_id, count(ord) AS n, count(ord) FILTER (contains(lower(bairro), 'coco')) AS coco, arg_min(line, (coalesce(valor_mensal_brl, 9e9), ord)) AS cheapest FROM a LEFT JOIN g ON listed AND (c IS NULL OR need <= c) GROUP BY item_id),
p AS (SELECT item_id, arg_min(name, ord) AS name, arg_min(coalesce(valor_mensal_brl, -1), ord) AS price FROM a JOIN g ON listed AND need = c GROUP BY item_id),
i AS (SELECT *, CASE WHEN regexp_matches(q, 'valor|pre[cç]o|custa|quanto') AND c IS NOT NULL AND NOT regexp_matches(q, 'academ|aceit|lista|quais') THEN 'price' WHEN regexp_matches(q, 'coco|cocó') THEN 'district' WHEN regexp_matches(q, 'barat|menor pre') THEN 'cheapest'
  WHEN contains(q, 'crossfit aldeota') THEN 'named' WHEN regexp_matches(q, 'quais|lista|aceit|gurupass|academ') OR c IS NOT NULL THEN 'list' ELSE 'hint' END AS intent FROM a)
SELECT item_id, intent, CASE intent WHEN 'price' THEN 'Ilimitado ' || c || ' = R$' || printf('%.2f', CASE WHEN p.price IS NULL OR p.price < 0 THEN round(c::DOUBLE * 4.95::DOUBLE, 2) ELSE p.price::DOUBLE END) || '/mês' || CASE WHEN p.name IS NULL THEN ' (tabela R$4,95/crédito)' ELSE ' (visto em ' || p.name || ')' END || '.'
  WHEN 'district' THEN CASE WHEN coco > 0 THEN '' ELSE 'Nenhuma academia indexada com bairro Cocó neste agente. Snapshot atual é Fortaleza city-wide.' END
  WHEN 'cheapest' THEN coalesce('Mais barata no filtro' || coalesce(' (≤' || c || ' créditos)', '') || ':' || chr(10) || cheapest, 'Nenhuma academia no filtro do seu plano.')
  WHEN 'named' THEN CASE WHEN named IS NULL THEN 'Crossfit Aldeota não está no índice.' WHEN c < named_need THEN 'Crossfit Aldeota exige ' || named_plan || '. Seu plano (' || c || ' créditos) NÃO cobre.' ELSE named END
  WHEN 'list' THEN CASE WHEN c IS NOT NULL THEN 'Gurupass com ≤' || c || ' créditos: ' || n || '/' || listed || ' academias' ELSE 'Gurupass indexado: ' || n || ' academias' END || CASE WHEN n = 0 THEN chr(10) || '(nenhuma no filtro)' ELSE '' END
  ELSE 'Pergunte: lista Gurupass, bairro, plano (ex. Ilimitado 35), ou academia específica.' END AS text
FROM i JOIN f USING (item_id) LEFT JOIN p USING (item_id), t""")
def gym_answers(spark, sf_dir):
    """What a table of questions gets from documents as gyms."""
    gyms = spark.sql(f"SELECT {_GYM} FROM {{docs}}", docs=table(spark, sf_dir, "documents"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.expr(_GYM_QUESTION).alias("question"))
    found, _ = answers.answer_gyms(asked, gyms)
    return found.select(F.col("question_id").alias("item_id"), "intent", "text")


_PARTNER = """doc_id AS ord, 'P' || doc_id AS name, CASE WHEN doc_id % 9 = 0 THEN 'Coco' END AS bairro, CASE WHEN doc_id % 5 <> 0 THEN 'TP ' || doc_id % 8 END AS plan_minimo, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 90 + 0.5 END AS price_brl_month"""
_PARTNER_QUESTION = "(['quais academias TP 3', 'TP 5+ no coco', 'mais barata TP go', 'Tabela', 'oi', 'lista', 'Cocó', 'qual a mais barata', 'TP free no coco', 'tp1'])[(item_id % 10 + 1)::INT]"


@query(f"""WITH g AS (SELECT *, CASE plan_minimo WHEN 'TP 0' THEN 1 WHEN 'TP 1' THEN 2 WHEN 'TP 2' THEN 4 WHEN 'TP 3' THEN 5 WHEN 'TP 4' THEN 6 WHEN 'TP 5' THEN 7 WHEN 'TP 6' THEN 9 WHEN 'TP 7' THEN 10 END AS need,
  '• ' || name || coalesce(' (' || bairro || ')', '') || ' — ' || plan_minimo || ' / R$' || coalesce(price_brl_month::DOUBLE::VARCHAR, '?') AS line FROM (SELECT {_PARTNER} FROM documents)),
q AS (SELECT item_id, {_PARTNER_QUESTION} AS q FROM benchmark),
a AS (SELECT item_id, lower(q) AS q, CASE q WHEN 'quais academias TP 3' THEN 'TP 3' WHEN 'TP 5+ no coco' THEN 'TP 5' WHEN 'mais barata TP go' THEN 'TP GO' WHEN 'TP free no coco' THEN 'TP Free' WHEN 'tp1' THEN 'TP 1' END AS plan,
  CASE q WHEN 'quais academias TP 3' THEN 5 WHEN 'TP 5+ no coco' THEN 7 WHEN 'mais barata TP go' THEN 1 WHEN 'TP free no coco' THEN 0 WHEN 'tp1' THEN 2 END AS r FROM q),
f AS (SELECT item_id, count(ord) AS n, count(ord) FILTER (bairro = 'Coco') AS coco, arg_min(line, (coalesce(price_brl_month, 9e9), ord)) AS cheapest FROM a LEFT JOIN g ON plan_minimo IS NOT NULL AND (r IS NULL OR need <= r) GROUP BY item_id),
i AS (SELECT *, CASE WHEN regexp_matches(q, 'coco|cocó') THEN CASE WHEN coco = 0 AND contains(q, 'tp') THEN 'network' ELSE 'district' END WHEN contains(q, 'barat') THEN 'cheapest' WHEN contains(q, 'tabela') THEN 'catalog' WHEN plan IS NOT NULL OR contains(q, 'lista') THEN 'list' ELSE 'hint' END AS intent FROM a JOIN f USING (item_id))
SELECT item_id, intent, CASE intent WHEN 'network' THEN 'TotalPass (fixture Cocó / partners): ' || n || ' academias com ≤' || plan WHEN 'district' THEN CASE WHEN coco > 0 THEN '' ELSE 'Nenhum partner TP com bairro Cocó no meta.' END
  WHEN 'cheapest' THEN coalesce('Mais barata no filtro:' || chr(10) || cheapest, 'Nenhuma no filtro.') WHEN 'list' THEN CASE WHEN plan IS NULL THEN 'TotalPass indexado: ' || n || ' academias' ELSE 'TotalPass com ≤' || plan || ': ' || n || '/' || (SELECT count(*) FROM g) END || CASE WHEN n = 0 THEN chr(10) || '(nenhuma)' ELSE '' END
  ELSE 'TotalPass preços: TP1=R$49.9' END AS text FROM i""")
def partner_answers(spark, sf_dir):
    """What a table of questions gets from documents as partners with ranked plans."""
    partners = spark.sql(f"SELECT {_PARTNER} FROM {{docs}}", docs=table(spark, sf_dir, "documents"))
    listed = F.array(*[F.lit(x) for x in ("quais academias TP 3", "TP 5+ no coco", "mais barata TP go", "Tabela", "oi", "lista", "Cocó", "qual a mais barata", "TP free no coco", "tp1")])
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.element_at(listed, (F.col("item_id") % 10 + 1).cast("int")).alias("question"))
    found, _ = answers.answer_partners(asked, partners, "TotalPass preços: TP1=R$49.9")
    return found.select(F.col("question_id").alias("item_id"), "intent", "text")


@query("""WITH c AS (SELECT doc_id, list_filter([CASE WHEN NOT (n_chars <= 3000) THEN 'length' END, CASE WHEN NOT (lang IN ('en', 'de')) THEN 'lang' END, CASE WHEN NOT (doc_id % 7 <> 3) THEN 'id' END], lambda x: x IS NOT NULL) AS v FROM documents)
SELECT doc_id, array_to_string(v, ',') AS violated FROM c WHERE len(v) > 0""")
def check_violations(spark, sf_dir):
    found = store.check_violations(table(spark, sf_dir, "documents"), {"length": F.col("n_chars") <= 3000, "lang": F.col("lang").isin("en", "de"), "id": F.col("doc_id") % 7 != 3})
    return found.select("doc_id", F.array_join("violated", ",").alias("violated"))


@query("""WITH e AS (SELECT source, 'e' || doc_id AS message, row_number() OVER (PARTITION BY source ORDER BY n_chars, 'e' || doc_id) AS place FROM documents WHERE doc_id % 3 = 1 AND source <> 'src1'),
m AS (SELECT source, string_agg(message, ' | ' ORDER BY place) AS last_error FROM e WHERE place <= 3 GROUP BY source)
SELECT d.source AS group_id, count(*) AS chunk_count, CASE WHEN count(*) FILTER (d.source IN ('src0', 'src2') AND doc_id % 5 = 0) = 0 THEN 'published' ELSE 'training' END AS status, any_value(last_error) AS last_error
FROM documents d LEFT JOIN m ON m.source = d.source WHERE d.source IS NOT NULL GROUP BY d.source""")
def agent_status(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("source is not null")
    model = F.when(F.col("source").isin("src0", "src2") & (F.col("doc_id") % 5 == 0), "pending").otherwise("m")
    chunks = docs.select(F.col("source").alias("group_id"), F.array(F.lit(1.0)).alias("embedding"), model.alias("embedding_model"))
    errors = docs.where("doc_id % 3 = 1 and source <> 'src1'").select(F.col("source").alias("group_id"), F.col("n_chars").alias("at"), F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("message"))
    return store.agent_status(chunks, errors)


_META = """CASE doc_id % 6 WHEN 0 THEN '{"plano_minimo":" TP 1 ","valor_mensal_brl":" 12.5 "}' WHEN 1 THEN '{"valor_mensal_brl":3,"plano_minimo":7}' WHEN 2 THEN '{"plano_minimo":"  ","valor_mensal_brl":"x"}' WHEN 3 THEN '{broken' WHEN 4 THEN '{"valor_mensal_brl":true,"plano_minimo":null}' END"""


@query(f"""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'TP 1' END AS plan, CASE doc_id % 6 WHEN 0 THEN 12.5 WHEN 1 THEN 3.0 END::DOUBLE AS price, dayofweek(date_trunc('month', d))::INT AS first_weekday, day(last_day(d))::INT AS days
FROM (SELECT doc_id, DATE '2023-01-15' + (doc_id % 900)::INT AS d FROM documents)""")
def meta_values(spark, sf_dir):
    grid = text.month_grid(F.date_add(F.lit("2023-01-15").cast("date"), (F.col("doc_id") % 900).cast("int")))
    meta = F.expr(_META)
    return table(spark, sf_dir, "documents").select("doc_id", text.meta_text(meta, "plano_minimo").alias("plan"), text.meta_number(meta, "valor_mensal_brl").alias("price"), grid["first_weekday"].alias("first_weekday"), grid["days"].alias("days"))


@query("""SELECT source AS group_id, count(*) FILTER (doc_id % 4 <> 0 AND NOT (source = 'src1' AND doc_id % 9 = 5)) > 0 AND count(*) FILTER (doc_id % 4 <> 0 AND source IN ('src0', 'src2') AND doc_id % 11 = 1) = 0 AND count(*) FILTER (source = 'src1' AND doc_id % 9 = 5) = 0 AS missing
FROM documents WHERE source IS NOT NULL GROUP BY source""")
def missing_plans(spark, sf_dir):
    k, other = F.col("doc_id"), (F.col("source") == "src1") & (F.col("doc_id") % 9 == 5)
    kind = F.when(other, "tp_partner").when(k % 4 != 0, "gp_gym").otherwise("summary")
    meta = F.when(F.col("source").isin("src0", "src2") & (k % 11 == 1), '{"creditos_minimos":5}').otherwise("{}")
    return knowledge.missing_plans(table(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("group_id"), kind.alias("chunk_type"), meta.alias("meta")))


_HIT = """'g' || vec_id % 40 AS gym_id, CASE vec_id % 40 % 4 WHEN 0 THEN 'Ácqua ' WHEN 1 THEN 'acqua ' WHEN 2 THEN 'Zênite ' ELSE 'zen ' END || vec_id % 40 || CASE WHEN vec_id % 5 = 0 THEN ' Yoga' ELSE '' END AS nome,
CASE WHEN vec_id % 3 = 0 THEN 'B' || vec_id % 6 END AS bairro, CASE WHEN vec_id % 7 <> 0 THEN 'Plan ' || vec_id % 4 END AS plano, CASE WHEN vec_id % 7 <> 0 THEN vec_id % 4 + 1 END AS plan_rank,
CASE vec_id % 4 WHEN 0 THEN 'N/A' WHEN 1 THEN 'R$ ' || vec_id END AS valor, CASE WHEN vec_id % 8 = 3 THEN '6h' END AS horario"""


@query(f"""WITH {CHUNKS_SQL},
p AS (SELECT x.vec_id AS query_id, x.cidade AS municipio, c.*, list_cosine_similarity(c.embedding, x.embedding) AS sim FROM chunks x JOIN chunks c ON c.group_id = x.group_id WHERE x.vec_id % 50 = 0 AND sim >= 0.0),
h AS (SELECT query_id, municipio, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS ord, round(sim, 6) AS score, modalidade_key, {_HIT} FROM p QUALIFY ord <= 15),
m AS (SELECT * EXCLUDE (plano, plan_rank), coalesce(plano, 'Plano não informado') AS plano, coalesce(plan_rank, 99) AS plan_rank, CASE WHEN contains(nome, 'Yoga') THEN 'yoga' ELSE modalidade_key END AS modality FROM h),
u AS (SELECT *, min(ord) OVER (PARTITION BY query_id, gym_id) AS seen FROM m QUALIFY row_number() OVER (PARTITION BY query_id, gym_id ORDER BY plan_rank, ord) = 1),
b AS (SELECT query_id, plano, count(*) AS gyms, min(plan_rank) AS rank, min(seen) AS seen, arg_max(valor, seen) FILTER (valor IS NOT NULL AND valor <> 'N/A') AS valor FROM u GROUP BY query_id, plano),
su AS (SELECT query_id, sum(gyms)::BIGINT AS total, string_agg(plano || ': ' || gyms || ' academia(s)' || coalesce(' (valor referência: ' || valor || ')', ''), chr(10) ORDER BY rank, seen) AS plans FROM b GROUP BY query_id),
g AS (SELECT *, min(ord) OVER (PARTITION BY query_id, modality, gym_id) AS seen FROM m QUALIFY row_number() OVER (PARTITION BY query_id, modality, gym_id ORDER BY score DESC, ord) = 1),
f AS (SELECT query_id, modality, min(ord) AS came FROM m GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, modality ORDER BY nome COLLATE pt, seen) AS place FROM g),
t AS (SELECT query_id, modality, came, string_agg(nome || coalesce(' (' || bairro || ')', '') || ' — ' || plano || coalesce(' | Horário: ' || horario, ''), chr(10) ORDER BY place) AS lines FROM n JOIN f USING (query_id, modality) GROUP BY ALL),
c AS (SELECT query_id, string_agg(CASE modality WHEN 'musculacao' THEN 'Musculação' WHEN 'pilates' THEN 'Pilates' WHEN 'muay_thai' THEN 'Muay Thai' WHEN 'yoga' THEN 'Yoga' WHEN 'boxe' THEN 'Boxe' ELSE 'Dança' END || chr(10) || lines, chr(10) || chr(10)
  ORDER BY list_position(['musculacao', 'funcional', 'crossfit', 'pilates', 'yoga', 'muay_thai', 'jiu_jitsu', 'boxe', 'natacao', 'danca'], modality), came) AS sections FROM t GROUP BY query_id),
a AS (SELECT vec_id AS query_id, cidade AS municipio FROM chunks WHERE vec_id % 50 = 0)
SELECT a.query_id, coalesce('Academias em ' || municipio || ' que aceitam Wellhub (resultados recuperados):' || chr(10) || chr(10) || 'Total: ' || total || ' academia(s) única(s) nos resultados recuperados.' || chr(10) || 'Por plano mínimo Wellhub:' || chr(10) || plans || chr(10) || chr(10) || sections,
  'Não encontrei academias Wellhub no catálogo para essa busca.') AS text FROM a LEFT JOIN su USING (query_id) LEFT JOIN c USING (query_id)""")
def rendered_answers(spark, sf_dir):
    """The answers to all searches whose ids are divisible by 50."""
    held = chunks(spark, sf_dir)
    asked = held.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "group_id", F.col("cidade").alias("wanted"))
    found = retrieval.batch_match(held, asked).select("query_id", F.col("rank").alias("ord"), F.round("similarity", 6).alias("score"), F.col("modalidade_key").alias("modalidade"), *[F.expr(x) for x in _split(_HIT)])
    return render.answers(asked.select("query_id", F.col("wanted").alias("municipio")), found)


def _split(columns: str) -> list[str]:
    """A select list at the commas between its columns, each of which ends in a name."""
    out = columns.replace("\n", " ").split(", ")
    joined, held = [], []
    for part in out:
        held.append(part)
        if re.search(r" AS \w+$", part.rstrip(",")):
            joined.append(", ".join(held).rstrip(","))
            held = []
    return joined
