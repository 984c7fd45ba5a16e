"""Cells, postings, geographic joins and the like against brute force."""

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.ranking import question_rank, rank_of_places, ts_rank
from tessera.operators import cells, geo, pages, postings


def near_by_all(rows, asked, k, least):
    """Every query against every row of its group."""
    unit = {}
    for i, g, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 8:
            unit[i] = (g, np.array(v, float) / np.linalg.norm(v))
    out = {}
    for q in asked:
        if q in unit and unit[q][0] is not None:
            found = [(round(float(unit[q][1] @ x), 12), i) for i, (g, x) in unit.items() if g == unit[q][0]]
            out[q] = sorted(((s, i) for s, i in found if s >= least), key=lambda x: (-x[0], x[1]))[:k]
    return out


@pytest.mark.parametrize("spread,least", [(0.05, -1.0), (0.05, 0.9), (3.0, -1.0)])
def test_cells_are_exact(spark, monkeypatch, spread, least):
    monkeypatch.setattr(cells, "BLOCK", 40)
    r = np.random.default_rng(2)
    spots = r.standard_normal((9, 8))
    m = spots[r.integers(0, 9, 420)] + spread * r.standard_normal((420, 8))
    m[::3] = spots[0] + 0.01 * r.standard_normal((140, 8))
    m[30:40] = m[30]
    rows = [(i, "a" if i % 4 else "b", [float(x) for x in v]) for i, v in enumerate(m)]
    rows += [(500, "a", None), (510, "a", []), (520, "a", [0.0] * 8), (530, "a", [float("nan")] * 8), (540, "a", [1.0] * 3), (550, None, [1.0] * 8), (560, "c", [1.0] * 8), (570, "a", [None] + [1.0] * 7)]
    held = spark.createDataFrame(rows, "chunk_id long, group_id string, embedding array<double>").repartition(5)
    index = cells.Cells.fit(held)
    filed = index.file(held)
    asked = held.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"), "group_id")
    hits, report = cells.search(index, filed, asked, 7, least)
    got = {}
    for x in hits.orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["similarity"], x["chunk_id"]))
    want = {q: x for q, x in near_by_all(rows, range(0, 600, 10), 7, least).items() if x}
    assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}
    share = {x["query_id"]: x["cells_read"] / x["cells"] for x in report.collect()}
    assert all(0 <= v <= 1 for v in share.values())
    if spread < 1:
        assert sum(share.values()) / len(share) < 0.6  # clusters: most cells are left aside


def test_cells_written_and_read(spark, tmp_path):
    r = np.random.default_rng(4)
    held = spark.createDataFrame([(i, "a", [float(x) for x in v]) for i, v in enumerate(r.standard_normal((200, 8)))], "chunk_id long, group_id string, embedding array<float>")
    cells.Cells.fit(held, 6).write(held, str(tmp_path))
    index, filed = cells.Cells.read(spark, str(tmp_path))
    asked = held.where("chunk_id < 5").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"), "group_id")
    hits, report = cells.search(index, filed, asked, 3)
    assert hits.count() == 15 and {x["cells"] for x in report.collect()} == {6}
    # A filter on cells opens only their folders.
    assert {f.split("cell=")[1].split("/")[0] for f in filed.where("cell = 2").inputFiles()} >= {"2"}
    assert "PartitionFilters: [isnotnull(cell" in filed.where("cell = 2")._jdf.queryExecution().toString()


def test_cells_of_nothing(spark):
    none = spark.createDataFrame([(1, "a", None)], "chunk_id long, group_id string, embedding array<float>")
    index = cells.Cells.fit(none)
    hits, report = cells.search(index, index.file(none), none.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"), "group_id"), 3)
    assert hits.count() == 0 and report.count() == 0


QUESTIONS = ["Academia de musculação em Arujá", "yoga", "de a o", "", None, "pré-natal natação boa", "Boxe boxe BOXE jiu-jitsu", "inexistente palavra"]


def texts_for_ranks():
    r = random.Random(6)
    words = ["academia", "academias", "musculação", "Arujá", "yoga", "de", "o", "boa", "boxe", "jiu-jitsu", "pré-natal", "natação", "a.b.c", "_", "x"]
    return [" ".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 40, 300]))) for _ in range(60)] + ["", None, " ", "yoga " * 700, "musculação " + "x " * 99 + "academia", "Academia, academia; ACADEMIA!"]


def test_postings_rank_as_the_scan_does(spark):
    chunks = spark.createDataFrame(list(enumerate(texts_for_ranks())), "chunk_id long, text string").repartition(4)
    questions = spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id long, question string")
    got = {(r["query_id"], r["chunk_id"]): r["rank"] for r in postings.ranks(postings.postings(chunks), questions).collect()}
    want = {}
    for k, question in enumerate(QUESTIONS):
        for r in chunks.select("chunk_id", question_rank(F.col("text"), question or "").alias("rank")).collect():
            if r["rank"] > 0:
                want[k, r["chunk_id"]] = r["rank"]
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) > 60


def test_postings_of_words(spark):
    chunks = spark.createDataFrame(list(enumerate(texts_for_ranks())), "chunk_id long, text string")
    index = postings.postings(chunks, "word")
    terms = ["academia", "boxe"]
    got = {r["chunk_id"]: r["rank"] for r in postings.ranks(index, spark.createDataFrame([(1, "Boxe academia")], "query_id long, question string"), "word").collect()}
    want = {r["chunk_id"]: r["rank"] for r in chunks.select("chunk_id", ts_rank(F.col("text"), terms).alias("rank")).collect() if r["rank"] > 0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and want
    hits = postings.term_counts(index, spark.createDataFrame([(1, "Boxe academia nada")], "query_id long, question string"))
    lower = [(i, (t or "").lower()) for i, t in enumerate(texts_for_ranks())]
    count = {i: len({"boxe", "academia"} & set(re.findall(r"[^\W_]+", t))) for i, t in lower}
    assert {r["chunk_id"]: r["hits"] for r in hits.collect()} == {i: n for i, n in count.items() if n}


def test_postings_written_by_stem(spark, tmp_path, monkeypatch):
    chunks = spark.createDataFrame(list(enumerate(texts_for_ranks())), "chunk_id long, text string")
    monkeypatch.setattr(postings, "GROUP", 50)  # texts taken apart in several groups
    index = postings.postings(chunks)
    postings.write(index, str(tmp_path), 16)
    rows = lambda df: sorted((r["stem"], r["chunk_id"], tuple(r["places"])) for r in df.collect())
    assert rows(postings.read(spark, str(tmp_path))) == rows(index)
    some = postings.read(spark, str(tmp_path), ["academ", "yog"], 16)
    assert rows(some) == [x for x in rows(index) if x[0] in ("academ", "yog")]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(stem" in plan.split("PushedFilters: [")[1]
    assert postings.postings(chunks.limit(0)).count() == 0


def test_rank_of_places():
    places = [[1, 132], [32, 234], [33]]
    miss = 1.0
    for i, a in enumerate(places):
        for b in places[i + 1 :]:
            for x in a:
                for y in b:
                    if 0 < abs(x - y) <= 100:
                        miss *= 1 - math.sqrt(0.01 / (1.005 + 0.05 * math.exp(abs(x - y) / 1.5 - 2)))
    assert rank_of_places([np.array(p) for p in places]) == pytest.approx(1 - miss, abs=1e-12)
    assert rank_of_places([np.array([3, 9])]) == pytest.approx(0.1 * 1.25 / (math.pi**2 / 6))


def apart(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * geo.EARTH_KM * math.asin(math.sqrt(min(1, h)))


@pytest.mark.parametrize("km", [5.0, 400.0, 9000.0, 30_000.0])
def test_within_as_all_pairs(spark, monkeypatch, km):
    monkeypatch.setattr(geo, "HOT", 20)
    r = random.Random(7)
    spots = [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(150)]
    spots += [(s * (90 - r.random() * 3), r.uniform(-180, 180)) for s in (1, -1) for _ in range(40)] + [(r.uniform(-5, 5), s * (180 - r.random())) for s in (1, -1) for _ in range(40)]
    spots += [(10 + r.random() / 50, 20 + r.random() / 50) for _ in range(100)] + [(90.0, 0.0), (-90.0, 77.0), (0.0, 180.0), (0.0, -180.0), (12.0, 540.0), (12.0, 180.0)]
    points = [(i, *x) for i, x in enumerate(spots)] + [(900, None, 1.0), (901, 1.0, None), (902, float("nan"), 1.0), (903, 91.0, 0.0), (904, 1.0, float("nan"))]
    centres = [(i, *x) for i, x in enumerate(spots[::9])] + [(99, None, 0.0)]
    got = [(x["centre_id"], x["point_id"]) for x in geo.within(spark.createDataFrame(points, "point_id long, lat double, lng double"), spark.createDataFrame(centres, "centre_id long, lat double, lng double"), km).collect()]
    want = {(c, p) for c, a, b in centres[:-1] for p, x, y in points[: len(spots)] if apart(a, b, x, y) <= km}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_merged_by_id(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 50.0, 50.0)], "point_id long, lat double, lng double")
    centres = spark.createDataFrame([(7, 0.0, 0.5, "a"), (8, 0.0, 1.0, "b"), (9, 0.0, -0.5, "a")], "centre_id long, lat double, lng double, name string")
    got = sorted(tuple(x) for x in geo.merged(points, centres, 60.0).select("point_id", "centre_id", "centres", "places").collect())
    assert got == [(1, 7, 2, ["a"]), (2, 8, 2, ["a", "b"])]
    assert geo.merged(points.limit(0), centres, 60.0).count() == 0


#: An offer as one pattern, tried from left to right.
OFFER = re.compile(r"([A-ZÁÉÍÓÚÂÊÎÔÛÃÕÇ][a-záéíóúâêîôûãõç\s\-]+?)\s*\n+(?:\(([^)]+)\)\s*\n+)?Disponível a partir do plano\s+(TP\s*[A-Za-z0-9_]+)", re.IGNORECASE)


def test_offers_as_a_regex_loop_finds_them():
    r = random.Random(12)
    parts = ["Disponível a partir do plano TP 3", "DISPONÍVEL a partir do plano  tp\ngo", "Disponível a partir do plano", "Yoga", "a", "Muay Thai", "(aula)", "(", ")", "()", "\n", "\n", "\n", "\n\n", "\n(aula)\n", "\nDisponível a partir do plano TP 5\n", " ", "-", "1", ".", "é", "ü", "TP 1"]
    hits = 0
    for _ in range(12_000):
        said = "".join(r.choice(parts) for _ in range(r.randrange(2, 22)))
        want = [(m[1].strip(), " ".join(m[3].split()), m[2] and m[2].strip()) for m in OFFER.finditer(said)]
        got, _, _ = pages.read_page(said)
        assert got == want, repr(said)
        hits += len(want)
    assert hits > 800


def test_hostile_pages():
    end = "\n\nDisponível a partir do plano TP 3"
    hostile = ["a " * 500_000, "a\n(" * 300_000, "\n" * 1_000_000, "a\n(b)\n" * 150_000, "Disponível a partir do plano " * 40_000, "(" * 1_000_000 + end, ("a" * 50 + "\n(" + "b" * 50) * 9000 + ")" + end, "Disponível a partir do plano TP 3 " * 30_000, "a\n(b)" + "\n" * 500_000 + "x", "a\n(b\n" * 100_000 + ")\n" + end]
    for said in hostile:
        began = time.time()
        pages.read_page(said)
        assert time.time() - began < 8, said[:40]


def test_activities(spark):
    texts = ["Muay Kids\n\nDisponível a partir do plano TP 3\n.Muay thai\n\nDisponível a partir do plano TP 1", "temos YOGA e spa, nada de lutas", None, "", "sobre nós: " + "x" * 400]
    held = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {x["i"]: ([(m["nome"], m["plano_minimo"]) for m in x["modalidades"]], x["descricao_curta"]) for x in pages.with_activities(held).collect()}
    assert got[0] == ([("Muay Thai", "TP 3")], "") and got[1][0] == [("Yoga", "TP 1"), ("Spa", "TP 1"), ("Lutas", "TP 1")] and got[2] == got[3] == ([], "")
    assert got[4][1] == "nós: " + "x" * 195 + "..."
    html = "<script>var a = '<b>';</script><p>A&nbsp;&amp;&lt;b<!-- c --><br>d"
    assert spark.range(1).select(pages.page_text(F.lit(html)).alias("x")).first()["x"].split() == ["A", "&<b", "d"]
