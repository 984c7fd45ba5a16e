"""Offers, plans and texts where the driver's tables hold no edge cases."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import classify, text
from tessera.operators import catalog

ITEM = "ord int, cidade string, uf string, bairro string, plano_minimo string, creditos_minimos int, valor_mensal_brl double"


def values(spark, column, rows):
    held = spark.createDataFrame(list(enumerate(rows)), "i int, x string")
    return [r["y"] for r in held.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "São Paulo", "SP", "Vila Nova", "Ilimitado 70", None, 9.0), (2, "sao-paulo", None, None, None, 30, None), (3, "São Paulo", "RJ", "Nova", "Ilimitado 70", 10, 1.0), (4, None, "SP", "", None, None, 5.0), (5, "SAO PAULO", "", "Centro", "", None, None)]
    return spark.createDataFrame(rows, ITEM)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_place(items):
    assert found(catalog.in_place(items, "São Paulo", "sp", "vila").select("ord", "bairro_unknown")) == [(1, False), (2, True)]
    assert [r[0] for r in found(catalog.in_place(items, "sao paulo").select("ord"))] == [1, 2, 3, 5]
    assert found(catalog.in_place(items, "")) == []


def test_credits(items):
    assert found(catalog.within_credits(items, 30).select("ord", "user_plan_ok")) == [(2, True), (3, True)]
    assert found(catalog.within_credits(items, None).select("ord", "user_plan_ok")) == [(i, None) for i in range(1, 6)]


def test_catalog(items):
    assert found(catalog.plan_catalog(items).select("plan_key", F.coalesce("creditos_por_dia", F.lit(-1)), F.coalesce("valor_mensal_brl", F.lit(-1.0)))) == [("Ilimitado 70", -1, 9.0), ("creditos_30", 30, -1.0), ("creditos_null", -1, 5.0)]
    assert found(catalog.plan_catalog(items.limit(0))) == []
    assert catalog.cheapest(items.withColumn("g", F.lit(None).cast("string")), ["g"], "valor_mensal_brl", "ord").first()["ord"] == 3


def test_sources_with_plans(spark):
    rows = [("a", "gp_gym", False), ("a", "page", True), ("b", "gp_gym", True), ("b", "gp_gym", None), ("c", "page", None), (None, "gp_gym", None)]
    held = spark.createDataFrame(rows, "source string, chunk_type string, has_plan boolean")
    assert sorted(r["source"] for r in catalog.sources_with_plans(held).collect()) == ["b", "b", "c"]


def test_plans(spark):
    assert values(spark, classify.plan_rank, ["TotalPass TP 5+", "tp5", "TP 12", "go", None, "x"]) == [8, 7, 13, 1, 99, 99]
    assert values(spark, classify.asked_plan, ["quero tp 5+ aqui", "TP3", "tp go!", "tp free", "stp 3", None]) == ["TP 5", "TP 3", "TP GO", "TP Free", None, None]
    assert values(spark, classify.asked_credits, ["Ilimitado 70 ou 3 créditos", "30 credito", "", None]) == [70, 30, None, None]
    assert values(spark, classify.district_before, ["Rua A, 10, Meireles - Fortaleza/CE", "Rua A, Fortaleza", None]) == ["Meireles", None, None]


def test_activities(spark):
    def kind(x):
        return classify.classify_activity(x, F.lit(None).cast("string"), F.lit(None).cast("double"))

    got = [(r["modality"], r["confidence"], r["method"]) for r in values(spark, kind, ["Academia de Jiu Jitsu", "SPACE", "Meu STUDIO", "ESPAÇO bem estar", None])]
    assert got == [("jiu_jitsu", 0.95, "rule"), ("desconhecida", 0.0, "llm_fallback"), ("pilates", 0.6, "rule"), ("pilates", 0.5, "rule"), ("desconhecida", 0.0, "llm_fallback")]


def test_texts(spark):
    assert values(spark, text.strip_markdown, ["# A\n\n\n\n- **b** [c](http://d) *e* \"f\"\n", None]) == ["A\n\nb c e f", None]
    assert values(spark, text.escape_xml, ["<a b=\"c\">&'"]) == ["&lt;a b=&quot;c&quot;&gt;&amp;'"]


def test_context(spark):
    hits = spark.createDataFrame([(2, "b", None, None, None), (1, "a<", 0.5, " yoga ", "x & y")], "rank int, chunk_id string, score double, modalidade string, text string")
    assert catalog.context_block(hits).first()[0] == '<chunk id="a&lt;" score="0.50" modalidade="yoga">\nx &amp; y\n</chunk>\n\n<chunk id="b" score="0.00" modalidade="">\n\n</chunk>'
    assert catalog.context_block(hits.limit(0)).first()[0] == "(nenhum chunk relevante encontrado)"
