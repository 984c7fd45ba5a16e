"""Queries on payloads, listings, sheets and evaluations, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import classify, text
from tessera.operators import crm, evaluation, knowledge, retrieval, store
from tessera.plans.adapt import CHUNKS_SQL, LEADS_SQL, chunks, leads
from tessera.plans.registered import query
from tessera.session import table
from tessera.streaming import inbound

_NUM = "CASE WHEN {0} = floor({0}) THEN {0}::BIGINT::VARCHAR ELSE {0}::VARCHAR END"
_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
_BAL, _NAME = _NUM.format("c_acctbal"), _SLUG.format("c_name")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as payloads of six kinds by key."""
    k, name, price = F.col("c_custkey"), F.col("c_name"), F.col("c_acctbal")
    plan = F.concat(F.lit("Ilimitado "), (k % 90).cast("string"))
    own = F.when(k % 5 != 0, F.col("c_mktsegment"))
    s = lambda **x: F.struct(*[v.alias(n) for n, v in x.items()])
    prices = F.create_map(F.lit("TP1"), F.lit(49.9), F.lit("TP 2"), F.lit(99.0))
    hint = s(plan_minimo=F.concat(F.lit("TP "), (k % 4).cast("string")), price_brl_month=F.when(k % 9 == 0, price), modalities=F.when(k % 5 == 0, F.array(F.lit("Yoga"))))
    none = F.lit(None).cast("string")
    gym = lambda nome, own_name, bairro, endereco, address, plano, price: s(nome=nome, name=own_name, bairro=bairro, endereco=endereco, address=address, plano_minimo=plano, valor_mensal_brl=price)
    kinds = [
        s(academias=F.array(gym(name, none, own, F.lit("Rua 1, Centro - Fortaleza, CE"), none, plan, price), gym(none, F.lit("Outra"), none, none, F.lit("sem"), none, F.lit(90.0)))),
        s(accept_list=F.array(s(name=name, bairro=own, plano_minimo=plan, creditos_minimos=F.when(k % 7 != 0, (k % 50).cast("double")), valor_mensal_brl=price)), rag_chunks=F.array(s(id=F.lit("r"), text=name), s(id=none, text=F.lit("")), s(id=none, text=F.lit("t")))),
        s(catalog_prices_brl=prices, partners=F.array(s(name=name, plan_hint=hint, comodidades=F.when(k % 7 != 0, F.array(F.lit("a"), F.lit("b"))), totalpass_hit=F.when(k % 4 == 0, F.lit(False)))), geo_sample=s(items=F.array(s(name=F.lit("G"), bairro=own, totalpass_hit=F.lit(True)), s(name=F.lit("H"), bairro=own, totalpass_hit=F.lit(False))))),
        s(laws=F.array(s(title=name, text=F.repeat(name, 200)), s(title=F.lit("leer"), text=F.lit("  ")))),
        s(aggregator=F.lit("Wellhub"), pages=F.array(s(id=name, body=name)), title=name, text=F.lit("own")),
        s(foo=k),
    ]
    return table(spark, sf_dir, "customer").select(k.cast("string").alias("source_ref"), F.coalesce(*[F.when(k % 6 == i, F.to_json(x)) for i, x in enumerate(kinds)]).alias("payload"))


#: Metadata as JSON text: by kind of chunk, what stands between the braces.
_REF = '"source_ref":"\' || c_custkey || \'"'
_OWN = '"domain":"{0}",' + _REF
_STAMPED = _REF + ',"domain":"gurupass"'
_DOUBLE = "c_acctbal::DOUBLE::VARCHAR"
_SEGMENT = """CASE WHEN c_custkey % 5 <> 0 THEN '"bairro":"' || c_mktsegment || '",' ELSE '' END"""
_PAGE_GYM = f""""name":"' || c_name || '","bairro":"' || CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment ELSE 'Centro' END || '","cidade":"Fortaleza","uf":"CE","plano_minimo":"Ilimitado ' || c_custkey % 90 || '","creditos_minimos":' || c_custkey % 90 || '.0,"valor_mensal_brl":' || {_DOUBLE} || ',"modalidades":[]"""
_OTHER_GYM = '"name":"Outra","cidade":"Fortaleza","uf":"CE","valor_mensal_brl":90.0,"modalidades":[]'
_LISTED_GYM = f""""name":"' || c_name || '",' || {_SEGMENT} || '"plano_minimo":"Ilimitado ' || c_custkey % 90 || '"' || {{0}} || ',"valor_mensal_brl":' || {_DOUBLE} || '"""
_STATED = _LISTED_GYM.format("CASE WHEN c_custkey % 7 <> 0 THEN ',\"creditos_minimos\":' || c_custkey % 50 || '.0' ELSE '' END")
_IMPLIED = _LISTED_GYM.format("',\"creditos_minimos\":' || CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 50 ELSE c_custkey % 90 END || '.0'")
_PRICE = f"""CASE WHEN c_custkey % 9 = 0 THEN ',"price_brl_month":' || {_DOUBLE} WHEN c_custkey % 4 = 1 THEN ',"price_brl_month":49.9' WHEN c_custkey % 4 = 2 THEN ',"price_brl_month":99.0' ELSE '' END"""
_PARTNER = f""""partner":{{"name":"' || c_name || '","plan_minimo":"TP ' || c_custkey % 4 || '"' || {_PRICE} || ',"modalidades":[' || CASE WHEN c_custkey % 5 = 0 THEN '"Yoga"' ELSE '' END || '],"comodidades":[' || CASE WHEN c_custkey % 7 <> 0 THEN '"a","b"' ELSE '' END || '],"totalpass_hit":' || CASE WHEN c_custkey % 4 = 0 THEN 'false' ELSE 'true' END || '}}"""

PAYLOADS_SQL = rf"""
built AS (
  SELECT c_custkey AS k, 'gurupass' AS domain, 0 AS ord, 'gp-gym-' || {_NAME} AS chunk_id, 'gp_gym' AS chunk_type, c_name || ' | ' || CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment ELSE 'Centro' END || ' | Ilimitado ' || c_custkey % 90 || ' | R$' || {_BAL} AS text, '{{{_PAGE_GYM},"gym":{{{_PAGE_GYM}}},{_STAMPED}}}' AS meta FROM customer WHERE c_custkey % 6 = 0
  UNION ALL SELECT c_custkey, 'gurupass', 1, 'gp-gym-outra', 'gp_gym', 'Outra | ? | null | R$90', '{{{_OTHER_GYM},"gym":{{{_OTHER_GYM}}},{_STAMPED}}}' FROM customer WHERE c_custkey % 6 = 0
  UNION ALL SELECT c_custkey, 'gurupass', 2, 'gp-summary-fortaleza', 'summary', 'Gurupass Fortaleza: 2 academias indexadas (plano_minimo + preço).', '{{{_STAMPED}}}' FROM customer WHERE c_custkey % 6 = 0
  UNION ALL SELECT c_custkey, 'gurupass', 0, 'gp-gym-' || {_NAME}, 'gp_gym', c_name || ' | ' || CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment ELSE '?' END || ' | Ilimitado ' || c_custkey % 90 || ' | R$' || {_BAL} || ' | créditos≥' || CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 50 ELSE c_custkey % 90 END, '{{{_STATED},"gym":{{{_IMPLIED}}},{_STAMPED}}}' FROM customer WHERE c_custkey % 6 = 1
  UNION ALL SELECT c_custkey, 'gurupass', 1, 'r', 'rag', c_name, '{{{_STAMPED}}}' FROM customer WHERE c_custkey % 6 = 1
  UNION ALL SELECT c_custkey, 'gurupass', 2, 'rag-2', 'rag', 't', '{{{_STAMPED}}}' FROM customer WHERE c_custkey % 6 = 1
  UNION ALL SELECT c_custkey, 'totalpass', 0, 'tp-catalog-prices', 'tp_catalog', 'TotalPass preços: TP1=R$49.9; TP 2=R$99', '{{"domain":"totalpass","catalog_prices_brl":{{"TP1":49.9,"TP 2":99.0}},{_REF}}}' FROM customer WHERE c_custkey % 6 = 2
  UNION ALL SELECT c_custkey, 'totalpass', 1, 'tp-partner-' || {_NAME}, 'tp_partner', c_name || ' TotalPass | plano_minimo=TP ' || c_custkey % 4 || ' | R$' || CASE WHEN c_custkey % 9 = 0 THEN {_BAL} WHEN c_custkey % 4 = 1 THEN '49.9' WHEN c_custkey % 4 = 2 THEN '99' ELSE '?' END || ' | ' || CASE WHEN c_custkey % 7 <> 0 THEN 'a, b' ELSE '' END, '{{"domain":"totalpass",{_PARTNER},{_REF}}}' FROM customer WHERE c_custkey % 6 = 2
  UNION ALL SELECT c_custkey, 'totalpass', 2, 'tp-summary', 'summary', 'TotalPass: 1 partners indexados (plan_minimo + preço).', '{{{_OWN.format('totalpass')}}}' FROM customer WHERE c_custkey % 6 = 2
  UNION ALL SELECT c_custkey, 'totalpass', 3, 'tp-geo-g', 'tp_partner', 'G | ' || CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment ELSE '?' END || ' | ? | R$?', '{{"domain":"totalpass","partner":{{"name":"G"' || CASE WHEN c_custkey % 5 <> 0 THEN ',"bairro":"' || c_mktsegment || '"' ELSE '' END || '}},{_REF}}}' FROM customer WHERE c_custkey % 6 = 2
  UNION ALL SELECT c_custkey, 'regulatory', i, 'regulatory-' || {_NAME} || '-' || i, 'law_chunk', c_name || chr(10) || substr(repeat(c_name, 200), i * 1200 + 1, 1200), '{{"domain":"regulatory","title":"' || c_name || '","part":' || i || ',{_REF}}}' FROM customer, range(5) t(i) WHERE c_custkey % 6 = 3 AND i * 1200 < 200 * length(c_name)
  UNION ALL SELECT c_custkey, 'wellhub', 0, 'wellhub-' || {_NAME} || '-0', 'doc_chunk', c_name || chr(10) || c_name, '{{"domain":"wellhub","title":"' || c_name || '","part":0,{_REF}}}' FROM customer WHERE c_custkey % 6 = 4
  UNION ALL SELECT c_custkey, 'wellhub', 2, 'generic-json-0', 'raw_json', '{{"aggregator":"Wellhub","pages":[{{"id":"' || c_name || '","body":"' || c_name || '"}}],"title":"' || c_name || '","text":"own"}}', '{{{_OWN.format('generic')}}}' FROM customer WHERE c_custkey % 6 = 4
  UNION ALL SELECT c_custkey, 'generic', 0, 'generic-json-0', 'raw_json', '{{"foo":' || c_custkey || '}}', '{{{_OWN.format('generic')}}}' FROM customer WHERE c_custkey % 6 = 5)"""


@query(f"WITH {PAYLOADS_SQL} SELECT k::VARCHAR AS source_ref, domain, ord::INT AS ord, chunk_id, chunk_type, text, meta FROM built")
def payload_chunks(spark, sf_dir):
    return knowledge.chunks_of(payloads(spark, sf_dir)).select("source_ref", "domain", "ord", "chunk_id", "chunk_type", "text", "meta")


@query(f"WITH {PAYLOADS_SQL} SELECT chunk_type, count(*) AS chunks FROM built GROUP BY chunk_type")
def chunk_type_counts(spark, sf_dir):
    return knowledge.chunks_of(payloads(spark, sf_dir)).groupBy("chunk_type").agg(F.count(F.lit(1)).alias("chunks"))


@query(f"WITH {PAYLOADS_SQL} SELECT domain, min(k) AS first FROM built GROUP BY domain")
def domains_by_first_chunk(spark, sf_dir):
    return knowledge.domains_in(knowledge.chunks_of(payloads(spark, sf_dir)).withColumn("ord", F.col("source_ref").cast("long")))


@query("""SELECT c_name AS name, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment WHEN c_custkey % 6 = 0 THEN 'Centro' END AS bairro, 'Ilimitado ' || c_custkey % 90 AS plano_minimo,
CASE WHEN c_custkey % 6 = 1 AND c_custkey % 7 <> 0 THEN c_custkey % 50 ELSE c_custkey % 90 END::DOUBLE AS creditos_minimos, c_acctbal AS valor_mensal_brl FROM customer WHERE c_custkey % 6 < 2
UNION ALL SELECT 'Outra', NULL, NULL, NULL, 90 FROM customer WHERE c_custkey % 6 = 0""")
def gym_records(spark, sf_dir):
    found = knowledge.gyms_from_chunks(knowledge.chunks_of(payloads(spark, sf_dir)))
    return found.select("name", "bairro", "plano_minimo", "creditos_minimos", "valor_mensal_brl")


@query("""SELECT c_name AS name, 'TP ' || c_custkey % 4 AS plan_minimo, CASE WHEN c_custkey % 9 = 0 THEN c_acctbal WHEN c_custkey % 4 = 1 THEN 49.9 WHEN c_custkey % 4 = 2 THEN 99 END AS price_brl_month FROM customer WHERE c_custkey % 6 = 2
UNION ALL SELECT 'G', NULL, NULL FROM customer WHERE c_custkey % 6 = 2""")
def partner_records(spark, sf_dir):
    return knowledge.partners_from_chunks(knowledge.chunks_of(payloads(spark, sf_dir))).select("name", "plan_minimo", "price_brl_month")


_SHEET = ("'{\"cidade\":\"C' || s_suppkey || '\",\"uf\":\"SP\",' || CASE WHEN s_suppkey % 2 = 0 THEN '\"fonte\":\"x\",\"revisao_pendente\":true,' ELSE '' END || '\"taxas\":{\"alvara_funcionamento_brl\":{\"min\":1234.5,\"max\":' || s_suppkey || '},\"outra\":{\"min\":7,\"max\":7,\"r_m2\":{\"min\":0.5,\"typico\":2}}},\"prazo_meses_tipico\":{\"alvara\":' || s_suppkey % 5 || '}}'")


@query(r"""SELECT 's' || s_suppkey AS slug, 'taxas-s' || s_suppkey AS chunk_id, 'C' || s_suppkey AS cidade, 'Taxas municipais para academia — C' || s_suppkey || '/SP' || chr(10) || 'Documento: s' || s_suppkey || '.json' || chr(10) || CASE WHEN s_suppkey % 2 = 0 THEN 'Fonte: x' ELSE 'Fonte: não informada' END || chr(10) || 'Data da coleta: não informada' || chr(10)
 || CASE WHEN s_suppkey % 2 = 0 THEN 'Status: revisão pendente (estimativa piloto)' ELSE 'Status: curado' END || chr(10) || chr(10) || '## Taxas (BRL)' || chr(10) || '### Alvará de funcionamento (R$)' || chr(10) || '- Mínimo: R$' || chr(160) || '1.234,50' || chr(10) || '- Máximo: R$' || chr(160)
 || regexp_replace(s_suppkey::VARCHAR, '^(\d+)(\d{3})$', '\1.\2') || ',00' || chr(10) || '### outra' || chr(10) || '- Valor: R$' || chr(160) || '7,00' || chr(10) || '- R$/m²: mín R$' || chr(160) || '0,50 · típico R$' || chr(160) || '2,00' || chr(10) || '## Prazos típicos (meses)' || chr(10) || '- Alvará: ' || s_suppkey % 5 || ' mês(es)' AS text FROM supplier""")
def fee_sheet_chunks(spark, sf_dir):
    k = F.col("s_suppkey")
    sheets = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("slug"), F.expr(_SHEET).alias("payload"))
    return knowledge.fee_sheets(sheets).select("slug", "chunk_id", "cidade", "text")


@query(r"""WITH p AS (SELECT p_partkey AS k, p_name, CASE p_size % 3 WHEN 0 THEN 'Yoga' WHEN 1 THEN 'Boxe' ELSE 'Academia' END AS m, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN 'TP 2' ELSE 'TP 3, TP 1' END AS planos,
  CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN length(rtrim(repeat(p_type || ' ', 40))) > 280 THEN trim(substr(repeat(p_type || ' ', 40), 1, 277)) || '…' ELSE rtrim(repeat(p_type || ' ', 40)) END END AS w FROM part)
SELECT sha256('g' || k) AS chunk_id, 'g' || k AS gym_id, m AS modalidade, CASE planos WHEN '' THEN 99 WHEN 'TP 2' THEN 4 ELSE 2 END AS plano_minimo_rank, nullif(split_part(planos, ', ', 1), '') AS plano_minimo,
  'Academia: ' || p_name || chr(10) || 'Endereço: Endereço não informado' || chr(10) || 'Municípios Atendidos: ' || CASE WHEN k % 2 = 0 THEN 'A, B' ELSE 'N/D' END || chr(10) || 'Modalidade Principal: ' || m || chr(10) || 'Planos TotalPass Aceitos: ' || coalesce(nullif(planos, ''), 'N/D') || coalesce(chr(10) || 'Observação: ' || w, '') AS text,
  sha256('A ' || p_name || ', localizada em Endereço não informado, atende os municípios de ' || CASE WHEN k % 2 = 0 THEN 'A, B' ELSE 'município não informado' END || '. Sua modalidade principal é ' || m || ' e aceita os planos TotalPass: ' || coalesce(nullif(planos, ''), 'planos não informados') || '.' || coalesce(' Observação: ' || w || '.', '')) AS embedded FROM p""")
def gym_listing_chunks(spark, sf_dir):
    k, none = F.col("p_partkey"), F.array().cast("array<string>")
    lit = lambda *xs: F.array(*[F.lit(x) for x in xs])
    gyms = table(spark, sf_dir, "part").select(
        F.concat(F.lit("g"), k.cast("string")).alias("id"), F.concat(F.lit(" "), "p_name").alias("name"), F.lit(" ").alias("address"), F.when(k % 2 == 0, lit("A", " ", "B")).otherwise(none).alias("cities"), (F.col("p_size") % 3).cast("string").alias("activity_id"),
        F.when(k % 4 < 2, none).otherwise(lit("TP 3", "TP 1", "", "TP 3")).alias("plans"), F.when(k % 4 == 1, "TP 2").alias("least_plan"), F.when(k % 5 == 0, F.repeat(F.concat("p_type", F.lit(" ")), 40)).alias("warning"), F.lit(None).cast("string").alias("slug"),
    )
    found = knowledge.gym_listings(gyms, {"0": "Yoga", "1": "Boxe"}, {"TP 1": 2, "TP 2": 4, "TP 3": 5})
    return found.select("chunk_id", "gym_id", "modalidade", "plano_minimo_rank", "plano_minimo", "text", F.sha2("embedding_content", 256).alias("embedded"))


@query("""SELECT 'gp-accept-fortaleza-centro' AS id, 'gp_accept_plan_geo' AS type, count(*) AS gp_accept_count, 'Gurupass Centro Fortaleza-CE: ' || count(*) || ' academias (user_credits=70) | ' || (SELECT string_agg(c_name || ' ≥Ilimitado ' || c_custkey % 90 || ' R$' || CASE WHEN c_acctbal = floor(c_acctbal) THEN c_acctbal::BIGINT::VARCHAR ELSE c_acctbal::VARCHAR END, '; ' ORDER BY c_custkey) FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 12)) AS text FROM customer""")
def accept_artifact(spark, sf_dir):
    k = F.col("c_custkey")
    items = table(spark, sf_dir, "customer").select(k.alias("ord"), F.col("c_name").alias("name"), F.concat(F.lit("Ilimitado "), (k % 90).cast("string")).alias("plano_minimo"), k.alias("creditos_minimos"), F.col("c_acctbal").alias("valor_mensal_brl"))
    return knowledge.accept_artifact(items, "Fortaleza", "CE", "Centro", 70)


@query("""SELECT c_name AS name, 'Rua, Meireles - Fortaleza' AS address, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'Meireles' END AS bairro, CASE WHEN c_custkey % 2 = 0 THEN 'Natal' ELSE 'Fortaleza' END AS cidade, CASE WHEN c_custkey % 2 = 0 THEN 'RN' ELSE 'CE' END AS uf,
'P ' || c_custkey % 80 AS plano_minimo, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 80 ELSE c_custkey % 7 END::DOUBLE AS creditos_minimos FROM customer""")
def normal_gyms(spark, sf_dir):
    k = F.col("c_custkey")
    plan, district = F.concat(F.lit("P "), (k % 80).cast("string")), F.when(k % 3 == 0, F.col("c_mktsegment"))
    one = F.to_json(F.struct(F.array(F.struct(F.col("c_name").alias("nome"), F.lit("Rua, Meireles - Fortaleza").alias("endereco"), district.alias("bairro"), plan.alias("plan_minimo"))).alias("academias"), F.lit("Natal").alias("cidade"), F.lit("rn").alias("uf")))
    other = F.to_json(F.struct(F.array(F.struct(F.col("c_name").alias("name"), F.lit("").alias("nome"), F.lit("Rua, Meireles - Fortaleza").alias("address"), district.alias("bairro"), plan.alias("plano_minimo"), (k % 7).alias("creditos_por_dia"))).alias("items")))
    return knowledge.normal_gyms(table(spark, sf_dir, "customer").select(F.when(k % 2 == 0, one).otherwise(other).alias("payload"))).select("name", "address", "bairro", "cidade", "uf", "plano_minimo", "creditos_minimos")


_NAMES = ["Muay Kids", "jiu-jitsu", "Boxing", "POLE dance", "Natação infantil", "tenis", " Zumba ", "Spa day"]
_LABELS = ["Muay Thai", "Jiu Jitsu", "Boxe", "Dança", "Natação", "Tênis", "Zumba", "Spa"]


@query(f"SELECT p_partkey, ({_LABELS})[(p_partkey % 8 + 1)::INT] AS activity FROM part")
def canonical_activities(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(x) for x in _NAMES]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", classify.canonical_activity(name).alias("activity"))


@query(r"""SELECT p_partkey, 'R$' || chr(160) || regexp_replace(split_part(printf('%.2f', p_retailprice), '.', 1), '^(\d+)(\d{3})$', '\1.\2') || ',' || split_part(printf('%.2f', p_retailprice), '.', 2) AS brl,
p_partkey % 3 = 0 AS url, make_timestamp(p_partkey * 1000000) AS at, CASE p_size % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 99 END AS least, (p_size % 3 < 2) AS allowed FROM part""")
def small_functions(spark, sf_dir):
    k = F.col("p_partkey")
    plans = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("TP 2"), F.lit("TP 1"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("TP 2"))).otherwise(F.array(F.lit("x")))
    url = F.when(k % 3 == 0, "HTTPS://a.b").when(k % 3 == 1, "ftp://a.b")
    least = F.when(F.col("p_size") % 3 < 2, "tp1").otherwise("TotalPass TP 6")
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.brl(F.col("p_retailprice")).alias("brl"), text.is_url(url).alias("url"), text.millis(k * 1000).cast("timestamp_ntz").alias("at"),
        classify.least_rank(plans, {"TP 1": 2, "TP 2": 4}).alias("least"), classify.plan_allows(least, F.lit("TP 3")).alias("allowed"),
    )


_FOLDED = "translate(lower({0}), 'áàâãäéèêëíìîïóòôõöúùûüçñ', 'aaaaaeeeeiiiiooooouuuucn')"
_HITS_SQL = f"""{CHUNKS_SQL},
n AS (SELECT x.vec_id AS query_id, c.vec_id AS doc_id, (row_number() OVER (PARTITION BY x.vec_id ORDER BY list_cosine_similarity(c.embedding, x.embedding) DESC, c.chunk_id))::INT AS rank
      FROM chunks x JOIN chunks c ON c.group_id = x.group_id WHERE x.vec_id % 50 = 0 AND list_cosine_similarity(c.embedding, x.embedding) >= 0.0 QUALIFY rank <= 15),
b AS (SELECT vec_id AS query_id, text FROM chunks WHERE vec_id % 50 = 0),
h AS (SELECT query_id, n.doc_id, rank, {_FOLDED.format("coalesce(d.text, '')")} || ' {{"lang":"' || d.lang || '"}}' AS blob, d.source, d.lang FROM n JOIN documents d USING (doc_id))"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the searches of the chunks whose ids are divisible by 50 find, with the documents' fields."""
    held = chunks(spark, sf_dir)
    asked = held.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "group_id")
    found = retrieval.batch_match(held, asked).select("query_id", "rank", F.col("vec_id").alias("doc_id"))
    return found.join(table(spark, sf_dir, "documents"), "doc_id").select("query_id", "rank", "text", F.to_json(F.struct("lang")).alias("meta"), "source", "lang")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "text")


@query(f"""WITH {_HITS_SQL}, kws AS (SELECT query_id, ['The', 'LANG":"de', split_part(text, ' ', 3)] AS kw FROM b),
m AS (SELECT h.query_id, rank, i, contains(blob, {_FOLDED.format('kw[i]')}) AS hit FROM h JOIN kws USING (query_id), range(1, 4) t(i)),
r AS (SELECT query_id, rank, bool_or(hit) AS hit FROM m GROUP BY ALL),
a AS (SELECT query_id, count(*) AS retrieved, avg(hit::INT::DOUBLE) FILTER (rank <= 5) AS precision, 1.0 / min(rank) FILTER (hit) AS mrr FROM r GROUP BY query_id),
k AS (SELECT query_id, count(DISTINCT i) / 3.0 AS recall FROM m WHERE hit AND rank <= 5 GROUP BY query_id)
SELECT kws.query_id, coalesce(retrieved, 0) AS retrieved, round(coalesce(recall, 0), 6) AS recall, round(coalesce(precision, 0), 6) AS precision, round(coalesce(mrr, 0), 6) AS mrr FROM kws LEFT JOIN a USING (query_id) LEFT JOIN k USING (query_id)""")
def eval_keywords(spark, sf_dir):
    b = _questions(spark, sf_dir).select("query_id", F.array(F.lit("The"), F.lit('LANG":"de'), F.split_part("text", F.lit(" "), F.lit(3))).alias("keywords"))
    found = evaluation.keyword_metrics(_hits(spark, sf_dir), b)
    return found.select("query_id", "retrieved", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr")])


@query(f"""WITH {_HITS_SQL}, m AS (SELECT b.query_id, coalesce(bool_or(contains('src1', source) OR contains(source, 'src1')), false) AS doc_match, CASE WHEN b.query_id % 4 <> 0 THEN coalesce(bool_or(lang = 'de'), false) END AS city_match, count(h.query_id)::DOUBLE AS recall FROM b LEFT JOIN h ON h.query_id = b.query_id AND rank <= 5 GROUP BY b.query_id)
SELECT round(avg(recall), 6) AS avg_recall, round(avg(doc_match::INT), 6) AS doc_match_rate, round(avg(city_match::INT), 6) AS city_match_rate, round(avg(NULL::DOUBLE), 6) AS none_rate FROM m""")
def eval_rates(spark, sf_dir):
    return evaluation.rates(_judged(spark, sf_dir), ["recall"], ["doc_match", "city_match", "none"])


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _hits(spark, sf_dir).where("rank <= 5").groupBy("query_id").agg(F.collect_set("source").alias("refs"), F.max(F.col("lang") == "de").alias("de"), F.count(F.lit(1)).cast("double").alias("n"))
    b = _questions(spark, sf_dir).select("query_id").join(top, "query_id", "left")
    k = F.col("query_id")
    return b.select("query_id", (k % 3).alias("document"), evaluation.document_match(F.col("refs"), F.lit("SRC1")).alias("doc_match"), F.when(k % 4 != 0, F.coalesce("de", F.lit(False))).alias("city_match"), F.lit(None).cast("boolean").alias("none"), F.coalesce("n", F.lit(0.0)).alias("recall"))


@query(f"WITH {_HITS_SQL}, m AS (SELECT b.query_id, count(h.query_id)::DOUBLE AS recall FROM b LEFT JOIN h ON h.query_id = b.query_id AND rank <= 5 GROUP BY ALL) SELECT query_id % 3 AS document, round(avg(recall), 6) AS recall, count(*) AS queries FROM m GROUP BY 1")
def eval_recall_by_document(spark, sf_dir):
    return evaluation.recall_by(_judged(spark, sf_dir), "document")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 OR n_nationkey % 7 = 1 THEN 'keep' WHEN n_nationkey % 3 = 1 AND n_nationkey % 7 = 0 THEN 'neutral' ELSE 'review' END AS recommendation FROM nation")
def eval_recommendation(spark, sf_dir):
    k = F.col("n_nationkey")
    deltas = table(spark, sf_dir, "nation").select("n_nationkey", F.when(k % 3 == 0, 0.05).when(k % 3 == 1, 0.0).otherwise(-0.1).alias("primary_delta"), F.when(k % 7 == 1, 0.2).when(k % 7 == 0, 0.0).otherwise(0.01).alias("mrr_delta"))
    return evaluation.recommendation(deltas).select("n_nationkey", "recommendation")


@query("""WITH s(stage) AS (VALUES ('O'), ('F'), ('P'), ('none')), i AS (SELECT o_orderstatus AS stage, o_orderkey AS lead_id, o_custkey % 10 AS position, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey % 10, o_orderkey) AS place, c_name AS name FROM orders LEFT JOIN customer ON c_custkey = o_orderkey)
SELECT stage, coalesce(string_agg(position || ':' || lead_id || ':' || coalesce(name, '?'), ',' ORDER BY place), '') AS cards FROM s LEFT JOIN i USING (stage) WHERE place IS NULL OR place <= 20 GROUP BY stage""")
def board_cards(spark, sf_dir):
    stages = spark.createDataFrame([("O",), ("F",), ("P",), ("none",)], "stage string")
    items = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("stage"), F.col("o_orderkey").alias("lead_id"), (F.col("o_custkey") % 10).alias("position"))
    found = crm.board_cards(stages, items, leads(spark, sf_dir), 20)
    line = F.transform("cards", lambda c: F.concat_ws(":", c["position"].cast("string"), c["lead_id"].cast("string"), F.coalesce(c["name"], F.lit("?"))))
    return found.select("stage", F.array_join(line, ",").alias("cards"))


@query(f"WITH {LEADS_SQL} SELECT o_orderkey, name, classification FROM orders LEFT JOIN leads ON lead_id = o_custkey")
def conversation_leads(spark, sf_dir):
    held = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("lead_id"))
    return crm.replied(held, leads(spark, sf_dir)).select("o_orderkey", "name", "classification")


@query("SELECT conv_id, turn, CASE WHEN role <> 'user' THEN 'channel' WHEN conv_id % 4 = 0 THEN 'media' WHEN trim(coalesce(text, '')) = '' THEN 'empty' END AS reason FROM conversations WHERE role IS NOT NULL")
def reply_guards(spark, sf_dir):
    held = table(spark, sf_dir, "conversations").where("role is not null").select("conv_id", "turn", F.col("role").alias("channel"), F.when(F.col("conv_id") % 4 == 0, "image").otherwise("text").alias("kind"), "text")
    return crm.reply_guard(held, ["user"]).select("conv_id", "turn", "reason")


@query("SELECT min(n_nationkey) AS group_id, arg_min(n_name, n_nationkey) AS name FROM nation WHERE contains(lower(n_name), '_1')")
def group_by_name(spark, sf_dir):
    groups = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("group_id"), F.col("n_name").alias("name"))
    return crm.first_named(groups, ["nowhere", "_1", "NATION"])


@query(f"WITH {LEADS_SQL} SELECT lead_id, CASE WHEN classification = 'hot' OR lead_id % 101 >= 80 THEN 'qualifying' ELSE 'new' END AS stage, CASE WHEN classification = 'hot' OR lead_id % 101 >= 80 THEN 0 ELSE 5 END AS position FROM leads")
def hot_leads_qualify(spark, sf_dir):
    held = leads(spark, sf_dir).select("lead_id", "classification", (F.col("lead_id") % 101).alias("score"), F.lit("new").alias("status"))
    led, staged = crm.qualify(held, held.select("lead_id", F.lit("new").alias("stage"), F.lit(5).alias("position")))
    return led.join(staged, "lead_id").select("lead_id", "stage", "position")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE coalesce(source, 'public') END AS access_level, CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-01-02' ELSE TIMESTAMP '2024-01-01' END AS updated_at FROM documents")
def stamped_upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    old = d.select("doc_id", F.col("source").alias("access_level"), at("2024-01-01").alias("updated_at"))
    new = d.where("doc_id % 3 = 0").select("doc_id", F.col("lang").alias("access_level"))
    return store.fill_constant(store.stamp_changes(old, new.withColumn("at", F.lit(1)), ["doc_id"], "at", at("2024-01-02")), "access_level", "public")


@query("SELECT n_nationkey AS group_id, CASE WHEN n_nationkey % 2 = 0 THEN 'published' ELSE 'draft' END AS status, CASE WHEN n_nationkey % 2 = 0 THEN 7 ELSE 0 END::BIGINT AS chunk_count FROM nation")
def agents_of_groups(spark, sf_dir):
    groups = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("group_id"))
    return store.upsert_agents(groups.where("group_id % 2 = 0").select("group_id", F.lit("published").alias("status"), F.lit(7).cast("long").alias("chunk_count")), groups)


@query("SELECT page_id, CASE WHEN page_id % 5 = 2 THEN 'synced' ELSE 'pending' END AS status FROM pages")
def urls_marked_synced(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select("page_id", F.lit("pending").alias("status"))
    return store.mark_where(urls, "status", "synced", F.col("page_id") % 5 == 2)


@query("SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id % 6 < 2")
def pending_chunks(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    held = e.select(F.col("vec_id").alias("chunk_id"), F.when(F.col("vec_id") % 6 != 0, F.col("embedding")).alias("embedding"), F.when(F.col("vec_id") % 6 == 1, "pending").otherwise("m").alias("embedding_model"))
    return store.pending(held).select("chunk_id")


@query("SELECT count(*) FILTER (page_id % 3 = 0) AS loaded, count(*) FILTER (page_id % 3 = 1) AS skipped, count(*) FILTER (page_id % 3 = 2) AS failed FROM pages")
def load_counters(spark, sf_dir):
    k = F.col("page_id") % 3
    return store.counters(table(spark, sf_dir, "pages").select(F.when(k == 0, "loaded").when(k == 1, "skipped").otherwise("failed").alias("outcome")), "outcome")


def _direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as payloads of direct channels, their messages split over two entries, with the time of arrival."""
    k, t = F.col("conv_id"), F.coalesce("turn", F.lit(0))
    attachment = F.when(k % 3 == 1, F.array(F.struct(F.when(k % 2 == 0, "audio").otherwise("video").alias("type"), F.struct(F.lit("http://m").alias("url")).alias("payload"))))
    message = F.struct(F.struct(F.when(k % 5 != 0, k.cast("string")).alias("id")).alias("sender"), F.when(k % 7 != 0, 1_700_000_000_000 - t * 1000).alias("timestamp"), F.struct(F.when(k % 3 != 1, F.col("text")).alias("text"), attachment.alias("attachments")).alias("message"))
    nothing = F.struct(F.array(message.withField("sender", F.struct(F.lit("").alias("id")))).alias("messaging"))
    body = F.to_json(F.struct(F.lit("page").alias("object"), F.array(F.struct(F.array(message).alias("messaging")), nothing).alias("entry")))
    return table(spark, sf_dir, "conversations").select(body.alias("payload"), F.timestamp_seconds(F.lit(1_600_000_000) + t).alias("arrived"))


_DIRECT_SQL = "d AS (SELECT conv_id::VARCHAR AS sender, CASE WHEN conv_id % 7 <> 0 THEN to_timestamp(1700000000 - coalesce(turn, 0)) ELSE to_timestamp(1600000000 + coalesce(turn, 0)) END::TIMESTAMP AS ts, coalesce(turn, 0) AS turn, CASE WHEN conv_id % 3 <> 1 THEN text END AS text, CASE WHEN conv_id % 3 = 1 THEN 'http://m' END AS media_url, CASE WHEN conv_id % 3 <> 1 THEN 'text' WHEN conv_id % 2 = 0 THEN 'audio' ELSE 'image' END AS kind, coalesce(text, '') AS said FROM conversations WHERE conv_id % 5 <> 0), m AS (SELECT *, substr(CASE WHEN kind = 'text' THEN said ELSE '[' || kind || ']' END, 1, 200) AS preview FROM d)"


@query(f"WITH {_DIRECT_SQL} SELECT sender, ts, text, media_url, kind, preview FROM m")
def direct_messages(spark, sf_dir):
    found = inbound.unpack_direct(_direct(spark, sf_dir), F.col("arrived"))
    return found.withColumn("ts", F.col("ts").cast("timestamp_ntz")).select("sender", "ts", "text", "media_url", "kind", "preview")


@query(f"WITH {_DIRECT_SQL}, a AS (SELECT sender, max(ts) AS newest, arg_max(ts, turn) AS last_to_arrive, count(*) AS unread FROM m GROUP BY sender) SELECT * FROM a")
def direct_threads(spark, sf_dir):
    d = inbound.unpack_direct(_direct(spark, sf_dir), F.col("arrived")).withColumn("at", F.col("ts"))
    # The tables hold messages in turn; the earlier by event time arrives later.
    turn = F.when(F.unix_seconds("ts") > 1_650_000_000, 1_700_000_000 - F.unix_seconds("ts")).otherwise(F.unix_seconds("ts") - 1_600_000_000)
    held = d.withColumn("arrival", turn)
    new, last = inbound.thread_state(held), inbound.thread_state(held, monotonic=False)
    plain = lambda c: F.col(c).cast("timestamp_ntz")
    return new.select("sender", plain("last_at").alias("newest"), "unread").join(last.select("sender", plain("last_at").alias("last_to_arrive")), "sender")


@query("""WITH c AS (SELECT conv_id::VARCHAR AS external_id, turn, CASE WHEN turn % 2 = 0 THEN 'N' || turn ELSE ' ' END AS name FROM conversations WHERE conv_id % 2 = 0 AND turn IS NOT NULL),
s AS (SELECT external_id, arg_max(name, turn) FILTER (trim(name) <> '') AS name, max(turn) AS at FROM c GROUP BY external_id), l AS (SELECT DISTINCT conv_id::VARCHAR AS external_id FROM conversations WHERE conv_id % 3 = 0)
SELECT coalesce(s.external_id, l.external_id) AS external_id, coalesce(s.name, CASE WHEN l.external_id IS NOT NULL THEN 'old' END) AS name, CASE WHEN l.external_id IS NOT NULL THEN 'hot' ELSE 'morno' END AS classification, CASE WHEN l.external_id IS NOT NULL THEN 9 ELSE 0 END AS score, 'new' AS status, coalesce(s.at, -1) AS last_contact_at
FROM s FULL JOIN l ON s.external_id = l.external_id""")
def leads_of_contacts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    key = [F.lit("instagram").alias("channel"), F.col("conv_id").cast("string").alias("external_id")]
    old = c.where("conv_id % 3 = 0").select(*key).distinct().select("*", F.lit("old").alias("name"), F.lit("hot").alias("classification"), F.lit(9).alias("score"), F.lit("new").alias("status"), F.lit(-1).cast("long").alias("last_contact_at"))
    new = c.where("conv_id % 2 = 0 and turn is not null").select(*key, F.when(F.col("turn") % 2 == 0, F.concat(F.lit("N"), F.col("turn").cast("string"))).otherwise(" ").alias("name"), F.col("turn").alias("ts"))
    return inbound.merge_leads(old, new).drop("channel")


@query("SELECT conv_id, turn FROM conversations WHERE trim(coalesce(text, '')) <> ''")
def replies_due(spark, sf_dir):
    return inbound.auto_replies(table(spark, sf_dir, "conversations"), True).select("conv_id", "turn")


@query("SELECT doc_id AS chunk_id, doc_id::DOUBLE AS score, source AS nome_academia, 'C' || (CASE WHEN doc_id % 2 = 0 THEN ',D' ELSE '' END) AS municipios, CASE WHEN doc_id % 3 = 0 THEN 'P0' ELSE 'P1' END AS plano_minimo, CASE WHEN doc_id % 5 = 0 THEN 'own' ELSE 'm' END AS source_ref FROM documents")
def hit_sources(spark, sf_dir):
    k = F.col("doc_id")
    meta = F.to_json(F.struct(F.col("source").alias("nome_academia"), F.lit("C").alias("cidade"), F.when(k % 2 == 0, F.array(F.lit("C"), F.lit("D"))).alias("municipios_relacionados"), F.when(k % 3 == 0, "P0").otherwise(" ").alias("plano_minimo"), F.array(F.lit("P1")).alias("planos_aceitos"), F.when(k % 5 != 0, "m").alias("source_ref")))
    found = knowledge.sources(table(spark, sf_dir, "documents").select(k.alias("chunk_id"), k.cast("double").alias("score"), F.lit("own").alias("source_ref"), meta.alias("meta")))
    return found.select("chunk_id", "score", "nome_academia", F.array_join("municipios", ",").alias("municipios"), "plano_minimo", "source_ref")
