"""Queries that an index serves, with their DuckDB SQL over the tables as they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import cells, crm, geo, pages, postings
from tessera.plans.registered import query
from tessera.session import cut, table


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit("all").alias("group_id"), "embedding")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, list_cosine_similarity(a.v, b.v) AS similarity FROM e a JOIN e b ON a.vec_id % 50 = 0)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank, round(similarity, 6) AS similarity FROM p QUALIFY rank <= 10""")
def cells_topk(spark, sf_dir):
    """The 10 nearest rows of every vector whose id is divisible by 50, exact, by cells."""
    held = _vectors(spark, sf_dir)
    index = cells.Cells.fit(held)
    filed = cut(index.file(held))
    asked = held.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"), "group_id")
    hits, _ = cells.search(index, filed, asked, 10)
    return hits.select("query_id", "chunk_id", "rank", F.round("similarity", 6).alias("similarity"))


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_ASKED_SQL = f"""
q AS (SELECT item_id, unnest(list_distinct({_WORDS})) AS word FROM benchmark),
asked AS (SELECT item_id, word, row_number() OVER (PARTITION BY item_id ORDER BY length(word) DESC, word) AS n FROM q QUALIFY n <= 2),
w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM w),
p AS (SELECT * FROM u WHERE word IN (SELECT word FROM asked))"""


def _asked(spark, sf_dir):
    """The two longest words of each benchmark item as a question."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    longest = F.slice(F.transform(F.array_sort(F.transform(words, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("word")))), lambda x: x["word"]), 1, 2)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(longest, " ").alias("question"))


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


@query(f"""WITH {_ASKED_SQL},
pairs AS (SELECT a.item_id, x.doc_id, abs(x.place - y.place) AS d FROM asked a JOIN asked b ON a.item_id = b.item_id AND a.n = 1 AND b.n = 2 JOIN p x ON x.word = a.word JOIN p y ON y.word = b.word AND y.doc_id = x.doc_id)
SELECT item_id AS query_id, doc_id AS chunk_id, round(1 - exp(sum(ln(1 - sqrt(0.01 / (1.005 + 0.05 * exp(d / 1.5 - 2)))))), 6) AS rank FROM pairs WHERE d <= 100 GROUP BY ALL""")
def postings_rank(spark, sf_dir):
    """The ranks of all documents for all questions, from one index of their words."""
    found = postings.ranks(postings.postings(_documents(spark, sf_dir), "word"), _asked(spark, sf_dir), "word")
    return found.select("query_id", "chunk_id", F.round("rank", 6).alias("rank"))


@query(f"WITH {_ASKED_SQL} SELECT item_id AS query_id, doc_id AS chunk_id, count(DISTINCT p.word) AS hits FROM asked JOIN p USING (word) GROUP BY ALL")
def postings_hits(spark, sf_dir):
    """How many words of each question each document holds."""
    return postings.term_counts(postings.postings(_documents(spark, sf_dir), "word"), _asked(spark, sf_dir))


_POINTS = """CASE WHEN doc_id % 3 = 0 THEN -22.5 + doc_id % 101 / 50.0 WHEN doc_id % 97 = 1 THEN 90.0 - doc_id % 2 * 180.0 ELSE doc_id * 7919 % 18001 / 100.0 - 90 END AS {0}lat,
CASE WHEN doc_id % 3 = 0 THEN -45.0 + doc_id % 103 / 50.0 WHEN doc_id % 89 = 1 THEN 179.9 - doc_id % 2 * 359.85 ELSE doc_id * 104729 % 36001 / 100.0 - 180 END AS {0}lng"""


@query(f"""WITH p AS (SELECT doc_id AS point_id, {_POINTS.format('')} FROM documents),
c AS (SELECT n_nationkey * 9 + 3 * x + y + 4 AS centre_id, n_name AS name, n_nationkey * 7.5 - 90 + 1.5 * x AS clat, n_nationkey * 15.0 - 180 + 1.5 * y AS clng FROM nation, (SELECT unnest([-1, 0, 1]) AS x), (SELECT unnest([-1, 0, 1]) AS y)),
d AS (SELECT point_id, centre_id, name, 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians((lat - clat)::DOUBLE) / 2), 2) + cos(radians(lat::DOUBLE)) * cos(radians(clat::DOUBLE)) * pow(sin(radians((lng - clng)::DOUBLE) / 2), 2)))) AS km FROM p, c WHERE clat BETWEEN -90 AND 90)
SELECT point_id, arg_min(centre_id, (round(km, 6), centre_id)) AS centre_id, round(min(km), 3) AS km, count(*) AS centres, array_to_string(list_sort(list_distinct(list(name))), ',') AS places FROM d WHERE km <= 300 GROUP BY point_id""")
def geo_merge(spark, sf_dir):
    """documents as points, a third of them around one spot, merged by id from searches of 300 km around nine points a nation."""
    points = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("point_id"), *[F.expr(x) for x in _POINTS.format("").split(",\n")])
    cities = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), "n_nationkey", (F.col("n_nationkey") * 7.5 - 90).alias("lat"), (F.col("n_nationkey") * 15.0 - 180).alias("lng"))
    centres = crm.grid(cities, F.lit(True), 1.5).withColumn("centre_id", F.col("n_nationkey") * 9 + 3 * F.col("x") + F.col("y") + 4)
    found = geo.merged(points, centres, 300.0)
    return found.select("point_id", "centre_id", F.round("km", 3).alias("km"), "centres", F.array_join("places", ",").alias("places"))


_OFFERED = """CASE page_id % 5 WHEN 0 THEN '1' || chr(10) || 'Muay Kids ' || chr(10) || chr(10) || 'Disponível a partir do plano TP 3' || chr(10) || 'Yoga Flow' || chr(10) || '(aula de uma hora) ' || chr(10) || chr(10) || 'DISPONÍVEL A PARTIR DO PLANO tp' || chr(10) || 'go. Muay thai' || chr(10) || 'Disponível a partir do plano TP 1'
WHEN 1 THEN '7' || chr(10) || 'Dança-livre' || chr(10) || '(x) y' || chr(10) || 'Escalada' || chr(10) || '(muro' || chr(10) || '(alto)' || chr(10) || 'Disponível a partir do plano  TP 5 e Escalada' || chr(10) || 'Disponível a partir do plano TP 6'
WHEN 2 THEN ' Temos Natação, SPA e dança. Sobre: ' || repeat('bom lugar ', 40) WHEN 3 THEN '9 Disponível a partir do plano' ELSE '' END"""
_NAME = r"([A-ZÁÉÍÓÚÂÊÎÔÛÃÕÇ][a-záéíóúâêîôûãõç\s-]+?)\s*\n+(?:\(([^)]+)\)\s*\n+)?Disponível a partir do plano\s+(TP\s*\w+)"
_LABELLED = "CASE {0} ELSE nome END".format(" ".join(f"WHEN {' OR '.join(f'contains(lower(nome), {p!r})' for p in parts)} THEN '{label}'" for parts, label in [(["muay"], "Muay Thai"), (["jiu"], "Jiu Jitsu"), (["boxe", "boxing"], "Boxe"), (["capoeira"], "Capoeira"), (["pilates"], "Pilates"), (["yoga"], "Yoga"), (["nata", "swim"], "Natação"), (["funcional"], "Treinamento Funcional"), (["crossfit"], "Crossfit"), (["dança", "danca", "pole"], "Dança"), (["muscul"], "Musculação"), (["fisio"], "Fisioterapia"), (["spa"], "Spa"), (["massag"], "Massoterapia"), (["tênis", "tenis"], "Tênis")]))
_WORDS_LISTED = "['Musculação', 'Funcional', 'Crossfit', 'Jiu Jitsu', 'Muay Thai', 'Boxe', 'Capoeira', 'Pilates', 'Yoga', 'Natação', 'Dança', 'Fisioterapia', 'Spa', 'Massagem', 'Tênis', 'Lutas']"


@query(rf"""WITH t AS (SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', chr(10), 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', chr(10), 'g'), '(?s)<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') || {_OFFERED} AS text FROM pages),
g AS (SELECT page_id, text, regexp_extract_all(text, '(?i){_NAME}', 1) AS n, regexp_extract_all(text, '(?i){_NAME}', 2) AS x, regexp_extract_all(text, '(?i){_NAME}', 3) AS p FROM t),
o AS (SELECT page_id, generate_subscripts(n, 1) AS i, regexp_replace(unnest(n), '^\s+|\s+$', '', 'g') AS nome, regexp_replace(unnest(x), '^\s+|\s+$', '', 'g') AS extra, regexp_replace(unnest(p), '\s+', ' ', 'g') AS plano FROM g),
l AS (SELECT page_id, i, {_LABELLED} AS nome, plano, extra FROM o),
f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY page_id, nome ORDER BY i) = 1),
k AS (SELECT page_id, list_filter({_WORDS_LISTED}, lambda w: contains(lower(text), lower(w))) AS ws FROM t)
SELECT k.page_id, coalesce(string_agg(f.nome || '=' || plano || '=' || coalesce(extra, ''), ';' ORDER BY i), array_to_string(list_transform(any_value(ws), lambda w: w || '=TP 1='), ';')) AS activities,
       any_value(regexp_replace(substr(regexp_extract(text, '(?is)(?:descrição|sobre|apresenta)(.{{0,300}})', 1), 1), '^\s+', '')[:20]) AS said
FROM k JOIN t ON t.page_id = k.page_id LEFT JOIN f ON f.page_id = k.page_id GROUP BY k.page_id""")
def page_activities(spark, sf_dir):
    """The activities that pages offer, in the order in which they state them."""
    held = table(spark, sf_dir, "pages").select("page_id", F.concat(pages.page_text(F.col("html")), F.expr(_OFFERED.replace("chr(10)", "char(10)"))).alias("text"))
    found = pages.with_activities(held)
    line = F.transform("modalidades", lambda m: F.concat_ws("=", m["nome"], m["plano_minimo"], F.coalesce(m["descricao_extra"], F.lit(""))))
    return found.select("page_id", F.array_join(line, ";").alias("activities"), F.substring("descricao_curta", 1, 20).alias("said"))
