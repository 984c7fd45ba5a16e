"""Names of all queries of the library outside the llm subpackage, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import query_filters, text
from tessera.operators import crm, evaluation, retrieval, store
from tessera.plans import catalog, documents, feeds, indexes, intake  # noqa: F401  (their queries register themselves)
from tessera.plans.adapt import CHUNKS_SQL, GYMS_SQL, LEADS_SQL, chunks, gyms, leads, query_vector
from tessera.plans.registered import oracle_sql, queries, query  # noqa: F401
from tessera.session import table
from tessera.streaming import inbound


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("chunk_id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered top-k, boosted by city."""
    hits = retrieval.match_chunks(chunks(spark, sf_dir), query_vector(spark, sf_dir), plano_rank=8, k=15, min_similarity=0.1)
    return _shown(retrieval.boost_city(hits, "NATION_3"))


TOP = "SELECT chunk_id, round(similarity, 6) AS similarity, round(similarity, 6) AS score FROM s WHERE {} ORDER BY s.similarity DESC, chunk_id LIMIT {}"


@query(f"WITH {CHUNKS_SQL} " + TOP.format("similarity >= 0.05", 15))
def vector_topk(spark, sf_dir):
    return _shown(retrieval.match_chunks(chunks(spark, sf_dir), query_vector(spark, sf_dir), min_similarity=0.05))


@query(f"WITH {CHUNKS_SQL} " + TOP.format("similarity >= 0.0 AND coalesce(plano_minimo_rank, 99) <= 8 AND contains(modalidade_key, 'muay_thai')", 50))
def match_chunks_filtered(spark, sf_dir):
    return _shown(retrieval.match_chunks(chunks(spark, sf_dir), query_vector(spark, sf_dir), plano_rank=8, modalidade=" muay_thai ", bairro=" ", k=99, min_similarity=0.0))


@query(f"WITH {CHUNKS_SQL} " + TOP.format("similarity >= 0.0 AND (tenant_id IS NULL OR tenant_id = '1')", 15))
def match_chunks_tenant(spark, sf_dir):
    return _shown(retrieval.match_chunks(chunks(spark, sf_dir), query_vector(spark, sf_dir), tenant_id="1", min_similarity=0.0))


@query(f"WITH {CHUNKS_SQL} " + TOP.format("similarity >= -1 AND (lower(cidade) = 'nation_7' OR list_contains(list_transform(related, lambda x: lower(x)), 'nation_7'))", 15))
def match_chunks_municipio(spark, sf_dir):
    return _shown(retrieval.match_chunks(chunks(spark, sf_dir), query_vector(spark, sf_dir), municipio="nation_7", min_similarity=-1.0))


@query(f"WITH {CHUNKS_SQL} " + TOP.format("similarity >= -1 AND (contains(lower(cidade), 'nation_1') OR contains('nation_1', lower(cidade)) OR len(list_filter(related, lambda x: contains(lower(x), 'nation_1'))) > 0)", 15))
def match_chunks_contains_municipio(spark, sf_dir):
    return _shown(retrieval.match_chunks(chunks(spark, sf_dir), query_vector(spark, sf_dir), municipio="NATION_1", min_similarity=-1.0, municipio_mode="contains"))


@query(f"""WITH {CHUNKS_SQL},
t AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM s WHERE similarity >= 0.0),
p AS (SELECT *, list_filter(list_transform(w, lambda x, i: CASE WHEN x = 'the' THEN i END), lambda x: x IS NOT NULL) AS a, list_filter(list_transform(w, lambda x, i: CASE WHEN x = 'of' THEN i END), lambda x: x IS NOT NULL) AS b FROM t),
d AS (SELECT chunk_id, unnest(a) AS a, b FROM p), e AS (SELECT chunk_id, a, unnest(b) AS b FROM d),
r AS (SELECT chunk_id, 1 - exp(sum(ln(1 - CASE WHEN abs(a - b) > 100 THEN sqrt(0.01 * 1e-30) ELSE sqrt(0.01 / (1.005 + 0.05 * exp(abs(a - b) / 1.5 - 2))) END))) AS r FROM e GROUP BY chunk_id)
SELECT chunk_id, round(similarity, 6) AS similarity, round(0.7 * similarity + 0.3 * coalesce(r, 0) / (coalesce(r, 0) + 1), 6) AS score
FROM s LEFT JOIN r USING (chunk_id) WHERE similarity >= 0.0 ORDER BY 0.7 * similarity + 0.3 * coalesce(r, 0) / (coalesce(r, 0) + 1) DESC, s.similarity DESC, chunk_id LIMIT 15""")
def match_chunks_hybrid(spark, sf_dir):
    return _shown(retrieval.match_chunks(chunks(spark, sf_dir), query_vector(spark, sf_dir), terms=["the", "of"], min_similarity=0.0))


BATCH_SQL = f"""WITH {CHUNKS_SQL},
p AS (SELECT x.vec_id AS query_id, c.chunk_id, c.cidade, x.cidade AS wanted, list_cosine_similarity(c.embedding, x.embedding) AS similarity
      FROM chunks x JOIN chunks c ON c.group_id = x.group_id WHERE x.vec_id % 50 = 0 AND similarity >= 0.0),
base AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM p QUALIFY rank <= 15),
boosted AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY similarity + CASE WHEN cidade = wanted THEN 0.08 ELSE 0 END DESC, similarity DESC, chunk_id) AS rank FROM base)"""


def _batch(spark, sf_dir):
    held = chunks(spark, sf_dir)
    asked = held.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "group_id", F.col("cidade").alias("wanted"))
    return retrieval.batch_match(held, asked)


@query(BATCH_SQL + " SELECT query_id, chunk_id, rank, round(similarity, 6) AS similarity FROM base")
def batch_match(spark, sf_dir):
    return _batch(spark, sf_dir).select("query_id", "chunk_id", "rank", F.round("similarity", 6).alias("similarity"))


@query(BATCH_SQL + """, b AS (SELECT query_id, coalesce(min(rank) FILTER (cidade = wanted), 99) AS f FROM base WHERE rank <= 5 GROUP BY 1),
o AS (SELECT query_id, coalesce(min(rank) FILTER (cidade = wanted), 99) AS f FROM boosted WHERE rank <= 5 GROUP BY 1)
SELECT count(*) FILTER (o.f < b.f) AS improved, count(*) FILTER (o.f > b.f) AS worsened, count(*) FILTER (o.f = b.f) AS unchanged FROM b JOIN o USING (query_id)""")
def boost_ab(spark, sf_dir):
    hits = _batch(spark, sf_dir)
    relevant = F.col("cidade") == F.col("wanted")
    return evaluation.paired(evaluation.per_query(hits, relevant), evaluation.per_query(retrieval.rerank(hits, relevant), relevant))


@query(BATCH_SQL + """, m AS (SELECT query_id, avg((cidade = wanted)::INT::DOUBLE) AS p, min(rank) FILTER (cidade = wanted) AS f FROM base WHERE rank <= 5 GROUP BY 1)
SELECT count(*) AS queries, round(avg(p), 6) AS precision, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr, round(avg((f IS NOT NULL)::INT::DOUBLE), 6) AS hit_rate FROM m""")
def eval_macro_metrics(spark, sf_dir):
    return evaluation.macro(evaluation.per_query(_batch(spark, sf_dir), F.col("cidade") == F.col("wanted")))


@query(f"WITH {CHUNKS_SQL}, h AS (SELECT * FROM s WHERE similarity >= 0.0 ORDER BY similarity DESC, chunk_id LIMIT 50) SELECT chunk_id, round(similarity, 6) AS similarity, round(CASE WHEN cidade = 'NATION_3' THEN least(similarity + 0.08, 1.0) ELSE similarity END, 6) AS score FROM h")
def city_boost(spark, sf_dir):
    return _shown(retrieval.boost_city(retrieval.match_chunks(chunks(spark, sf_dir), query_vector(spark, sf_dir), k=50, min_similarity=0.0), "nation_3"))


@query(f"WITH {CHUNKS_SQL}, h AS (SELECT * FROM s WHERE similarity >= 0.0 ORDER BY similarity DESC, chunk_id LIMIT 50) SELECT chunk_id, cidade FROM h WHERE CASE WHEN (SELECT count(*) FROM h WHERE cidade = 'NATION_3') > 0 THEN cidade = 'NATION_3' ELSE list_contains(related, 'NATION_3') END")
def city_hard_filter(spark, sf_dir):
    hits = retrieval.match_chunks(chunks(spark, sf_dir), query_vector(spark, sf_dir), k=50, min_similarity=0.0)
    return retrieval.cut_to_city(hits, "nation_3").select("chunk_id", "cidade")


@query("SELECT doc_id, hash FROM (SELECT doc_id, sha256(concat_ws('|', source, text)) AS hash, row_number() OVER (PARTITION BY sha256(concat_ws('|', source, text)) ORDER BY doc_id) AS i FROM documents) WHERE i = 1")
def dedupe_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("hash", text.content_hash(F.col("source"), F.col("text")))
    return docs.groupBy("hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "hash")


@query(f"WITH {GYMS_SQL} SELECT modality, gym_id, score, ord, (list_position(['musculacao', 'funcional', 'crossfit', 'pilates', 'yoga', 'muay_thai', 'jiu_jitsu', 'boxe', 'natacao', 'danca'], modality) - 1)::INT AS place FROM gyms QUALIFY row_number() OVER (PARTITION BY modality, gym_id ORDER BY score DESC, ord) = 1")
def modality_grouping(spark, sf_dir):
    return retrieval.best_per_activity(gyms(spark, sf_dir)).select("modality", "gym_id", "score", "ord", "place")


@query(f"WITH {GYMS_SQL}, u AS (SELECT * FROM gyms QUALIFY row_number() OVER (PARTITION BY gym_id ORDER BY coalesce(rank, 99), ord) = 1) SELECT plano, count(*) AS gyms, min(coalesce(rank, 99)) AS rank, arg_max(valor, ord) FILTER (valor IS NOT NULL AND valor <> 'N/A') AS valor FROM u GROUP BY plano")
def plan_buckets(spark, sf_dir):
    return retrieval.plan_buckets(gyms(spark, sf_dir))


@query("SELECT coalesce(arg_min(CASE WHEN label % 5 = 3 THEN 'group_' || label END, vec_id) FILTER (label % 5 = 3), 'unknown') AS marker FROM embeddings")
def detect_marker(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("ord", F.col("vec_id"))
    return retrieval.first_marker(rows, F.when(F.col("label") % 5 == 3, F.concat(F.lit("group_"), F.col("label").cast("string"))))


_CITY_ROWS = ", ".join(f"({i}, '{a}', '{label}', {str(a in query_filters.SHORT).lower()})" for i, (a, label) in enumerate(query_filters.CITIES))
_PLAN_CASES = " ".join("WHEN contains(q, '" + a + "')" + "".join(f" AND NOT contains(q, '{b}')" for b, _ in query_filters.PLANS if b != a and b.startswith(a) and not a.endswith("+")) + f" THEN {r}" for a, r in query_filters.PLANS)
_ACTIVITY_CASES = " ".join("WHEN regexp_matches(query, '(?i)" + p.replace("<", r"(?:^|[^A-Za-z0-9_])").replace(">", r"(?:$|[^A-Za-z0-9_])") + f"') THEN '{label}'" for p, label in query_filters.ACTIVITIES)
_QUESTION = "text || ' ' || (['em São Paulo', 'Pilates em Niterói', 'no rj musculação', 'TP 5+ Santos ou São Vicente', 'yoga tp3 bh', 'capital', 'interior de sp crossfit'])[(item_id % 7 + 1)::INT]"


@query(f"""WITH b AS (SELECT item_id, {_QUESTION} AS query FROM benchmark),
n AS (SELECT *, trim(regexp_replace(trim(lower(strip_accents(query))), '\\s+', ' ', 'g')) AS q FROM b),
c(ord, alias, label, short) AS (VALUES {_CITY_ROWS}),
h AS (SELECT item_id, arg_min(label, (strpos(q, alias), ord)) AS label FROM n, c
      WHERE CASE WHEN short THEN regexp_matches(q, '(^|[^a-z0-9])' || alias || '([^a-z0-9]|$)') ELSE contains(q, alias) END
        AND NOT (alias IN ('sp', 'rj') AND regexp_matches(q, '(^|[^a-z0-9_])interior\\s+de\\s+(sp|rj|mg|pr|rs|ba|pe|ce|go|df)($|[^a-z0-9_])')) GROUP BY item_id),
r AS (SELECT item_id, coalesce(label, CASE WHEN regexp_matches(q, '(^|[^a-z0-9_])capital($|[^a-z0-9_])') AND (regexp_matches(q, '(^|[^a-z0-9_])sp($|[^a-z0-9_])') OR contains(q, 'sao paulo')
        OR NOT regexp_matches(replace(q, 'capital', ''), '(^|[^a-z0-9_])[a-z][a-z]($|[^a-z0-9_])')) THEN 'São Paulo' END) AS municipio,
        CASE {_ACTIVITY_CASES} END AS modalidade,
        CASE WHEN regexp_matches(q, '(^|[^a-z0-9_])tp\\s*5\\+') THEN 8 WHEN regexp_matches(q, '(^|[^a-z0-9_])tp\\s*1\\+') THEN 3 WHEN regexp_matches(q, '(^|[^a-z0-9_])tp\\s*go($|[^a-z0-9_])') THEN 1 {_PLAN_CASES} END::INT AS plano_rank
      FROM n LEFT JOIN h USING (item_id))
SELECT *, ([0.1, 0.6, 0.75, 0.9]::DOUBLE[])[(municipio IS NOT NULL)::INT + (modalidade IS NOT NULL)::INT + (plano_rank IS NOT NULL)::INT + 1] AS confidence FROM r""")
def query_filter_extraction(spark, sf_dir):
    ends = F.array(*[F.lit(x) for x in ("em São Paulo", "Pilates em Niterói", "no rj musculação", "TP 5+ Santos ou São Vicente", "yoga tp3 bh", "capital", "interior de sp crossfit")])
    asked = F.concat("text", F.lit(" "), F.element_at(ends, (F.col("item_id") % 7 + 1).cast("int")))
    return table(spark, sf_dir, "benchmark").select("item_id", query_filters.extract_filters(asked).alias("f")).select("item_id", "f.*")


@query(f"WITH f AS (SELECT p_partkey, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' Yoga' WHEN p_partkey % 3 = 1 THEN ' Box' ELSE '' END AS n, (['musculacao', 'pilates', 'muay_thai', 'yoga', 'boxe', 'danca'])[(p_partkey % 6 + 1)::INT] AS m FROM part) SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'yoga' ELSE m END AS modality, CASE WHEN p_partkey % 3 = 0 AND m <> 'yoga' THEN 'name' ELSE 'chunk' END AS source FROM f")
def name_modality_rules(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.concat("p_name", F.when(k % 3 == 0, " Yoga").when(k % 3 == 1, " Box").otherwise(""))
    stated = F.element_at(F.array(*[F.lit(a) for a in ("musculacao", "pilates", "muay_thai", "yoga", "boxe", "danca")]), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", retrieval.effective_activity(name, stated).alias("e")).select("p_partkey", "e.*")


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(trim(lower(strip_accents(text))), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug,
regexp_replace(text, '[^0-9]', '', 'g') AS digits, TRY_CAST(nullif(regexp_extract(text, '([0-9]+)', 1), '') AS BIGINT) AS first_integer,
CASE WHEN length(text) > 280 THEN trim(substr(text, 1, 277)) || '…' ELSE text END AS short, sha256(concat_ws('|', lang, text)) AS hash FROM documents""")
def text_functions(spark, sf_dir):
    t = F.col("text")
    first = text.first_integer(t)
    return table(spark, sf_dir, "documents").select("doc_id", text.slug(t).alias("slug"), text.digits_only(t).alias("digits"), first.alias("first_integer"), text.ellipsis(t).alias("short"), text.content_hash(F.col("lang"), t).alias("hash"))


@query("SELECT p_partkey, round(p_retailprice, 2) AS price, round(p_size::DOUBLE * 4.95::DOUBLE, 2) AS credits FROM part")
def money_and_credits(spark, sf_dir):
    shown = F.concat(F.lit("R$ "), F.translate(F.format_number("p_retailprice", 2), ",.", ".,"))
    return table(spark, sf_dir, "part").select("p_partkey", text.money(shown).alias("price"), text.credits_price(F.col("p_size")).alias("credits"))


@query("SELECT doc_id, i AS chunk_index, ceil(length(text) / 1200)::INT AS total_chunks, substr(text, (i * 1200 + 1)::INT, 1200) AS chunk FROM (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 1200)::INT))::INT AS i FROM documents)")
def chunk_fixed_slices(spark, sf_dir):
    held = table(spark, sf_dir, "documents").withColumn("slices", text.fixed_slices(F.col("text")))
    return held.select("doc_id", F.size("slices").alias("total_chunks"), F.posexplode("slices").alias("chunk_index", "chunk"))


@query()
def chunk_recursive(spark, sf_dir):
    held = table(spark, sf_dir, "documents").withColumn("chunks", text.recursive_chunks(text.clean_pdf_text(F.col("text"))))
    return held.select("doc_id", F.size("chunks").alias("total_chunks"), F.posexplode("chunks").alias("chunk_index", "chunk"))


@query(f"WITH {LEADS_SQL} SELECT count(*) AS total, count(*) FILTER (classification = 'hot') AS hot, count(*) FILTER (classification = 'morno') AS morno, count(*) FILTER (classification = 'frio') AS frio FROM leads")
def lead_counts(spark, sf_dir):
    return crm.classified_counts(leads(spark, sf_dir))


@query(f"WITH {LEADS_SQL} SELECT lead_id, name FROM leads WHERE classification = 'hot' AND (contains(lower(name), 'r#00000012') OR contains(lower(segment), 'r#00000012') OR contains(lower(name), '12'))")
def lead_search(spark, sf_dir):
    return crm.search(leads(spark, sf_dir), " 12 ", ["name", "segment"], "hot").select("lead_id", "name")


@query(f"WITH {LEADS_SQL} SELECT lead_id, updated FROM leads ORDER BY updated DESC NULLS FIRST, lead_id")
def list_nulls_first(spark, sf_dir):
    return crm.newest_first(leads(spark, sf_dir), "updated", "lead_id").select("lead_id", "updated")


STAGES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NEVER USED"]


@query("WITH st(stage) AS (VALUES " + ", ".join(f"('{x}')" for x in STAGES) + ") SELECT stage, count(o_orderkey) AS cards, coalesce(round(sum(o_totalprice), 2), 0) AS value FROM st LEFT JOIN orders ON o_orderpriority = stage GROUP BY stage")
def board_by_stage(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stage"), F.col("o_totalprice").alias("value"))
    return crm.board(spark.createDataFrame([(x,) for x in STAGES], "stage string"), items)


@query("SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role) AS history FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) <= 12) GROUP BY conv_id")
def history_last12(spark, sf_dir):
    return crm.history(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_message(spark, sf_dir):
    return crm.last_message(table(spark, sf_dir, "conversations"), "user")


@query("SELECT r_regionkey, r_name, (SELECT coalesce(string_agg(n_name, ',' ORDER BY n_nationkey), '') FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey % 5 <> 0) AS nations FROM region")
def groups_with_urls_nested(spark, sf_dir):
    held = crm.nested(table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0"), "n_regionkey", ["n_nationkey", "n_name"], "nations")
    return held.select(F.col("n_regionkey").alias("r_regionkey"), "r_name", F.array_join(F.transform("nations", lambda x: x["n_name"]), ",").alias("nations"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey, 'local' FROM nation WHERE n_nationkey >= 10 AND n_nationkey % 2 = 0")
def remote_local_union(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return crm.remote_then_local(nation.where("n_nationkey < 10"), nation.where("n_nationkey % 2 = 0").withColumn("n_name", F.lit("local")), "n_nationkey")


@query("SELECT doc_id, coalesce(quality, -1) AS quality, CASE WHEN d.doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM documents d LEFT JOIN labels USING (doc_id)")
def upsert_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))
    new = rows.where("doc_id % 3 = 0").select("*", F.explode(F.array(F.struct(F.lit(1).alias("v"), F.lit("stale").alias("state")), F.struct(F.lit(2).alias("v"), F.lit("new").alias("state")))).alias("x")).select("doc_id", "quality", "x.state", "x.v")
    return store.upsert(rows.withColumn("state", F.lit("old")), new, ["doc_id"], "v")


@query("SELECT doc_id, CASE WHEN source = 'src3' THEN 'reloaded' ELSE lang END AS lang FROM documents WHERE source <> 'src3' OR doc_id % 2 = 0")
def wipe_reload(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    new = docs.where("source = 'src3' and doc_id % 2 = 0").withColumn("lang", F.lit("reloaded"))
    return store.replace_where(docs, new, F.col("source") == "src3").select("doc_id", "lang")


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN n_name END, 'kept') AS tenant FROM customer JOIN nation ON c_nationkey = n_nationkey")
def backfill_join(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), F.when(F.col("c_custkey") % 2 != 0, "kept").alias("n_name"))
    return store.backfill(rows, table(spark, sf_dir, "nation"), "n_nationkey", "n_name").select("c_custkey", F.col("n_name").alias("tenant"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3)")
def fk_violations(spark, sf_dir):
    parents = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 3")
    return store.missing_parents(table(spark, sf_dir, "orders"), parents, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_suppkey, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_violations(spark, sf_dir):
    return store.unique_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"])


@query(f"WITH {CHUNKS_SQL} SELECT group_id, count(*) AS chunk_count, CASE WHEN count(*) FILTER (vec_id % 97 = 0) = 0 THEN 'published' ELSE 'training' END AS status FROM chunks GROUP BY group_id")
def publish_status(spark, sf_dir):
    held = chunks(spark, sf_dir).withColumn("embedding_model", F.when(F.col("vec_id") % 97 == 0, "pending").otherwise("m"))
    return store.publish_status(held)


@query("WITH m AS (SELECT user_id AS conversation, ts, event_id, event_type FROM events) SELECT conversation, max(ts) AS last_at, arg_max(event_type, (ts, event_id::VARCHAR)) AS preview, count(*) AS unread FROM m GROUP BY conversation")
def inbound_state(spark, sf_dir):
    sent = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("provider_id"), F.col("user_id").alias("conversation"), "ts", F.col("event_type").alias("preview"))
    twice = sent.unionByName(sent.where("cast(provider_id as long) % 7 = 0"))
    return inbound.conversation_state(inbound.once(twice))


@query("SELECT doc_id, (contains(lower(text), 'the')::INT + contains(lower(text), 'tion')::INT + contains(lower(text), 'musculacao')::INT) AS hits FROM documents WHERE contains(lower(text), 'the') OR contains(lower(text), 'tion') OR contains(lower(text), 'musculacao') ORDER BY hits DESC, doc_id LIMIT 6")
def lexical_top6(spark, sf_dir):
    hits = text.term_hits(["the", "of", "tion", "musculação"], F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", hits.alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "doc_id").limit(6)


@query("SELECT source, count(*) AS docs, round(avg(quality), 6) AS quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source ORDER BY docs DESC, source LIMIT 8")
def doc_counts_top8(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    held = table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left").groupBy("source")
    return held.agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg("quality"), 6).alias("quality")).orderBy(F.desc("docs"), "source").limit(8)


@query("SELECT n_name, x, y, n_nationkey + x * 0.1::DOUBLE AS lat, n_regionkey + y * 0.1::DOUBLE AS lng FROM nation, (SELECT unnest([-1, 0, 1]) AS x), (SELECT unnest([-1, 0, 1]) AS y) WHERE n_nationkey % 4 = 0 OR (x = 0 AND y = 0)")
def grid_expand(spark, sf_dir):
    cities = table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").cast("double").alias("lat"), F.col("n_regionkey").cast("double").alias("lng"), "n_nationkey")
    return crm.grid(cities, F.col("n_nationkey") % 4 == 0, 0.1).select("n_name", "x", "y", "lat", "lng")


_OPENINGS = "count(*) FILTER (o_orderstatus = 'O') AS aberturas, count(*) FILTER (o_orderstatus = 'F') AS fechamentos, count(*) FILTER (o_orderstatus = 'O') - count(*) FILTER (o_orderstatus = 'F') AS saldo"


def _openings(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "O", "abertura").when(F.col("o_orderstatus") == "F", "fechamento")
    return table(spark, sf_dir, "orders").select(F.lit("g").alias("group_id"), F.lit("X").alias("municipio"), F.col("o_orderpriority").alias("bairro"), kind.alias("kind"), F.year("o_orderdate").alias("year"))


@query(f"SELECT year(o_orderdate)::INT AS year, o_orderpriority AS bairro, {_OPENINGS} FROM orders GROUP BY 1, 2")
def agg_by_neighborhood(spark, sf_dir):
    return crm.openings(_openings(spark, sf_dir), "g", "x", by=["year", "bairro"])


@query(f"SELECT {_OPENINGS} FROM orders")
def openings_summary(spark, sf_dir):
    return crm.openings(_openings(spark, sf_dir), "g", "X")
