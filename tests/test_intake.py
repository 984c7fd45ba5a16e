"""Embedding columns, names, loads and settings: edge cases that the driver's tables don't hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import collation
from tessera.operators import embedding, ingest, settings

TEXTS = ["um dois", "um dois", None, "", "três " * 3000, "três " * 1600 + "outro", "Um DOIS"]


def chunks(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "chunk_id int, text string").repartition(3)


def test_each_text_is_embedded_once(spark, tmp_path):
    seen = str(tmp_path / "calls")

    def counting(texts):
        with open(seen, "a") as f:
            f.writelines(f"{len(t)}\n" for t in texts)
        return embedding.hashed(16)(texts)

    found, new = embedding.with_embeddings(chunks(spark), counting, 16, "m")
    rows = {r["chunk_id"]: r for r in found.collect()}
    assert len(rows) == 7 and new.count() == 4  # the long texts agree in what is embedded of them, null is empty
    assert sorted(map(int, open(seen).read().split())) == [0, 7, 7, 8000]
    assert rows[0]["embedding"] == rows[1]["embedding"] and rows[2]["embedding"] == rows[3]["embedding"] and rows[4]["embedding"] == rows[5]["embedding"]
    assert all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-6 for r in rows.values())
    # What the cache holds isn't embedded again; another model's or version's texts are.
    again, more = embedding.with_embeddings(chunks(spark).union(spark.createDataFrame([(9, "novo")], "chunk_id int, text string")), counting, 16, "m", cache=new)
    assert again.count() == 8 and more.count() == 1 and open(seen).read().split().count("4") == 1
    assert embedding.with_embeddings(chunks(spark), counting, 16, "m", "2", cache=new)[1].count() == 4


@pytest.mark.parametrize("wrong", [lambda texts: np.zeros((len(texts), 3)), lambda texts: np.zeros((len(texts) + 1, 4)), lambda texts: np.full((len(texts), 4), np.nan)])
def test_wrong_vectors_fail(spark, wrong):
    with pytest.raises(Exception, match="embedding_(length_mismatch|not_finite)"):
        embedding.with_embeddings(chunks(spark), wrong, 4, "m")


def test_batches_are_bounded(spark):
    most = lambda texts: np.full((len(texts), 1), float(len(texts)))
    texts = spark.createDataFrame([(str(i), "x") for i in range(100)], "key string, text string").coalesce(1)
    assert {r["embedding"][0] for r in embedding.embed_texts(texts, most, 1).collect()} == {32.0, 4.0}
    assert embedding.embed_texts(texts.limit(0), most, 1).count() == 0


def test_names_in_order(spark):
    # By hand: letters before accents, accents before case, lower before upper.
    order = ["abacate", "ação", "acqua", "Acqua", "ácqua", "Ácqua", "Águia", "Éden", "orion", "Orion", "órion", "Órion", "zênite", "Zulu"]
    held = spark.createDataFrame([("g", n, i) for i, n in enumerate(reversed(order))] + [(None, "x", 99), ("g", None, 98)], "g string, name string, i int")
    got = collation.first_by_name(held.where("name is not null and g is not null"), ["g"], "name", "i", 50).orderBy("place").collect()
    assert [r["name"] for r in got] == order
    counted = {r["name"]: (r["spellings"], r["rows"]) for r in collation.count_names(held.union(held.limit(3)), "name").collect()}
    assert counted["acqua"][0] == 4 and counted["orion"][0] == 4 and counted["abacate"] == (1, 1) and "ação" in counted
    other = spark.createDataFrame([("AGUIA", 1), ("eden", 2), ("nada", 3)], "other string, k int")
    assert sorted((r["name"], r["k"]) for r in collation.join_by_name(held, other, "name", "other").collect()) == [("Águia", 1), ("Éden", 2)]


RAW = "id string, n string, day string, kept string"


def test_one_bad_row_loses_no_good_one(spark, tmp_path):
    rows = [("1", "5", "2024-01-01", "a"), ("x", "5", "2024-01-01", "b"), (None, "-1", "2024-13-01", "c"), ("3", "99999999999999999999", None, "d"), (" 4 ", "0", "", "e"), ("5", "", "2024-01-01", None)]
    raw = spark.createDataFrame(rows, RAW).repartition(3)
    rules = {"negative": F.col("loaded.n") >= 0, "even": F.col("loaded.id") / 0 < 1}
    done = ingest.load(raw, str(tmp_path / "a"), {"id": "int", "n": "int", "day": "date", "kept": "string"}, ["id"], {"negative": rules["negative"]})
    assert sorted(r["id"] for r in done.good().collect()) == [1, 4]
    bad = {r["kept"]: (r["id"], sorted(r["reasons"])) for r in done.quarantine().collect()}
    assert bad == {"b": ("x", ["id:int"]), "c": (None, ["day:date", "id:missing", "negative"]), "d": ("3", ["n:int", "negative"]), None: ("5", ["negative"])}
    assert done.counts == {"rows": 6, "loaded": 2, "failed": 4, "id:int": 1, "n:int": 1, "day:date": 1, "id:missing": 1, "negative": 3}
    empty = ingest.load(raw.limit(0), str(tmp_path / "b"), {"id": "int"}, ["id"])
    assert empty.good().count() == 0 and empty.quarantine().count() == 0 and empty.counts["rows"] == 0


def test_a_log_that_fails_harms_nothing(spark, tmp_path):
    (tmp_path / "file").write_text("no folder")
    assert ingest.audit(spark, str(tmp_path / "log"), "load", {"rows": 1}, "t1") and ingest.audit(spark, str(tmp_path / "log"), "load", {"rows": 2}, "t2")
    assert not ingest.audit(spark, str(tmp_path / "file" / "x"), "load", {}, "t3")
    assert sorted((r["at"], r["counts"]) for r in spark.read.json(str(tmp_path / "log")).collect()) == [("t1", '{"rows": 1}'), ("t2", '{"rows": 2}')]


def test_settings(spark):
    said = [("a", "model", "own", "2"), ("a", "model", "older", "1"), (None, "model", "shared", None), ("a", "provider", " ", "9"), ("b", "model", None, "1"), (None, "other", "x", "1"), ("b", "reply", "z", None), ("b", "reply", "y", None)]
    table = spark.createDataFrame(said, "tenant_id string, key string, value string, updated_at string")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c"), (4, "c")], "id int, tenant_id string")
    got = settings.resolved(rows, table, ["model", "provider", "reply"], {"provider": "env"})
    assert sorted(tuple(r) for r in got.select("id", "model", "provider", F.coalesce("reply", F.lit("-"))).collect()) == [(1, "own", "env", "-"), (2, "shared", "env", "z"), (3, "shared", "env", "-"), (4, "shared", "env", "-"), (4, "shared", "env", "-")]
    none = settings.resolved(rows, table.limit(0), ["model"], {"model": "d"})
    assert {r["model"] for r in none.collect()} == {"d"} and none.columns == ["id", "tenant_id", "model"]
    one = lambda v, **k: spark.range(1).select(settings.checked_number(F.lit(v), "dimension", **k).alias("x")).first()["x"]
    assert one("1024", expected=1024) == 1024
    for value, error in (("x", "invalid_dimension:x"), ("-1", "invalid_dimension"), ("512", "dimension_mismatch:expected_1024_got_512")):
        with pytest.raises(Exception, match=error):
            one(value, expected=1024)


def test_rights(spark):
    matrix = {"admin": {"see_all"}, "creator": {"see", "edit"}, "bot": set()}
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, tenant_id string")
    see = lambda role, tenant: sorted(r["id"] for r in settings.visible_to_user(rows, matrix, role, tenant).collect())
    assert see("admin", None) == [1, 2, 3] and see("creator", "a") == [1, 3] and see("creator", None) == [3] and see("bot", "a") == see(None, "a") == see("?", "a") == []
    for role in ("admin", "creator", "bot", None, "?"):
        for tenant in ("a", None):
            kept = rows.where(settings.row_filter(matrix, F.lit(role).cast("string"), F.lit(tenant).cast("string"), F.col("tenant_id")))
            assert sorted(r["id"] for r in kept.collect()) == see(role, tenant)
