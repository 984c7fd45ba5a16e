"""Filter audit, nearest neighbours and hard negatives against brute force on small fixtures."""

import itertools
import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import filter_audit, hard_negatives, nearest, vectors

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long, part string, fails string, digest string, vector string"


def shown(df, columns=None):
    columns = sorted(columns or df.columns)
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def by_duckdb(sql, **tables):
    c = duckdb.connect()
    for name, t in tables.items():
        c.register(name, t)
    found = c.sql(sql)
    return sorted(tuple(r[found.columns.index(x)] for x in sorted(found.columns)) for r in found.fetchall())


def audited(docs, labels):
    """The audit row by row, by its definition."""
    found = []
    texts = [(i, t or "", p or "") for i, t, p in docs]
    for i, t, part in texts:
        words = [w for w in t.translate({c: " " for c in range(9, 14)}).split(" ") if w]
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and any(j is not None and j < i and u == t for j, u, _ in texts),
        }
        found.append((part, fails, any(d == i and q == 1 for d, q, _ in labels if i is not None), any(d == i and x == 1 for d, _, x in labels if i is not None)))
    out = []
    for part in {p for p, *_ in found}:
        rows = [x for x in found if x[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        own = []
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                shapley[f] += len(gone)
                own.append((part, "".join(order), step, len(left), len(gone), sum(x[1][f] for x in rows) - len(gone), sum(x[1][f] and sum(x[1].values()) == 1 for x in rows), sum(x[2] for x in gone), sum(x[3] for x in gone), f))
        out += [(*r[:-1], shapley[r[-1]]) for r in own]
    return sorted(out)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_filter_audit(spark):
    r = random.Random(11)
    words = ["alpha", "Beta", "GAMMA", "d$", "é", "日本", "x|y", " wide"]
    texts = [" ".join(r.choice(words[: r.randint(1, 8)]) for _ in range(r.choice([0, 1, 50, 99, 100, 130]))) for _ in range(60)]
    texts += ["", None, " \t\n\x0b\x0c\r", "A", "#", "a" * 200_000, " ".join(f"w{i}" for i in range(50_000)), *texts[:20], "\x85".join(["q"] * 120)]
    docs = [(i if i % 13 else None, t, r.choice(["en", "de", "", None])) for i, t in enumerate(texts)] + [(5, texts[5], "en"), (5, "other", "en"), (70, texts[5], "fr")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 90, 2)] + [(4, 1, 1), (None, 1, 1), (10**6, 1, 1)]
    frame = spark.createDataFrame([(i, t, p, "s", 1, *"wxyz") for i, t, p in docs], DOC).repartition(5)
    got = filter_audit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.select(AUDIT).collect())) == audited(docs, labels)
    as_text = pa.table({"doc_id": [d[0] for d in docs], "text": [d[1] for d in docs], "lang": [d[2] for d in docs]})
    as_labels = pa.table({"doc_id": [x[0] for x in labels], "quality": [x[1] for x in labels], "toxic": [x[2] for x in labels]})
    assert shown(got) == by_duckdb(filter_audit.ORACLE_SQL, documents=as_text, labels=as_labels)


def test_filter_audit_of_nothing_and_of_many_parts(spark, monkeypatch):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], DOC), none).count() == 0
    monkeypatch.setattr(filter_audit, "MOST_PARTS", 7)
    many = spark.createDataFrame([(i, "A b", f"p{i % 40}", None, 1, *"wxyz") for i in range(400)], DOC)
    got = filter_audit.audit(many, none).where("filter_order = 'CADBE' and step = 1").select("part", "kept", "removed", "redundant").collect()
    assert sorted(map(tuple, got)) == sorted((f"p{i}", 0, 10, 0) for i in range(40))


def exact(rows, asked, k=5):
    """Brute force over (id, vector): nearest by cosine, ids on ties."""
    held = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            held.setdefault((i, len(v)), []).append(np.array(v, np.float64))
    out = {}
    for (i, w), (q, *_) in held.items():
        if asked(i):
            found = {}
            for (j, width), xs in held.items():
                if j != i and width == w:
                    found[j] = max(float(x @ q / np.sqrt((x @ x) * (q @ q))) for x in xs)
            out[i] = sorted(found.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = total = 0
    for i, near in want.items():
        held = found.get(i, {})
        assert sorted(held) == list(range(1, len(near) + 1))
        ranked = [held[j] for j in sorted(held)]
        assert ranked == sorted(ranked, key=lambda x: (-x[1], x[0]))
        hits += len({v for v, _ in ranked} & {v for v, _ in near})
        total += len(near)
    return hits / total


@pytest.mark.parametrize("spread", [0.02, 0.3, 5.0])
def test_nearest_recall(spark, spread):
    """Scattered vectors, clusters and a third of all rows in one spot."""
    r = np.random.default_rng(3)
    centres = r.standard_normal((40, 48))
    m = centres[r.integers(0, 40, 3000)] + spread * r.standard_normal((3000, 48))
    m[::3] = centres[0] + 0.01 * r.standard_normal((1000, 48))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    held = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest.neighbours(held, F.col("vec_id") % 50 == 0).collect()
    as_stored = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows]
    want = exact(as_stored, lambda i: i % 50 == 0)
    assert recall(got, want) >= 0.9
    by_id = dict(as_stored)
    for x in got[:50]:
        a, b = np.array(by_id[x["query_id"]]), np.array(by_id[x["vec_id"]])
        assert abs(x["score"] - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_nearest_looks_where_it_must():
    """A query with near copies looks into few buckets; one without a known neighbour into a whole table."""
    u = np.eye(64)[:2] * 0.6 + 0.1
    u /= np.linalg.norm(u, axis=1)[:, None]
    close = list(nearest.second_probes(u, np.array([0.999, 0.999])))
    assert 2 <= len(close) <= 12
    lost = [(t, c) for i, t, c in nearest.second_probes(u, np.array([np.nan, 0.9])) if i == 0]
    assert sorted(lost) == [(0, c) for c in range(128)]


def test_nearest_blocks(spark, monkeypatch):
    """Blocks of 16 vectors and queries give what one block gives."""
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([np.ones((90, 6)), r.standard_normal((110, 6))]))]
    held = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    held = held.withColumns({c: F.lit("x") for c in ("width", "id", "code", "vector", "table_no", "score")}).repartition(3)
    whole = shown(nearest.neighbours(held, F.col("vec_id") % 5 == 0))
    monkeypatch.setattr(nearest, "BLOCK", 16)
    monkeypatch.setattr(nearest, "MOST_SIZES", 0)
    assert shown(nearest.neighbours(held, F.col("vec_id") % 5 == 0)) == whole
    # Equal vectors tie and go by id: the first five others.
    assert [x[3] for x in shown(nearest.neighbours(held, F.col("vec_id") == 0))] == [1, 2, 3, 4, 5]


def test_nearest_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [-1.0, 0.0]), (7, [0.0, 1.0]), (None, [1.0, 0.0]), (50, [1.0, 2.0, 3.0]), (100, []), (150, [1e200, 1e200]), (151, [1e-200, 0.0])]
    held = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for x in nearest.neighbours(held, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], round(x["score"], 9)))
    half = round(math.sqrt(0.5), 9)
    assert sorted(got[0]) == [(1, 151, 1.0), (2, 1, round(1 / math.sqrt(1.01), 9)), (3, 150, half), (4, 7, 0.0)]
    assert sorted(got[150])[0][1] == 1 and {(v, x) for _, v, x in got[150][1:]} <= {(0, half), (7, half), (151, half), (1, got[150][0][2])}
    assert sorted(v for _, v, _ in got[150]) == [0, 1, 7, 151]
    assert 50 not in got and 100 not in got
    assert nearest.neighbours(held.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert nearest.neighbours(held.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_rotation_keeps_lengths_and_angles():
    r = np.random.default_rng(1)
    for width in (1, 2, 5, 64, 100):
        m = r.standard_normal((7, width))
        turned = nearest.rotated(m, 1)
        assert turned.shape[1] & (turned.shape[1] - 1) == 0
        assert np.allclose(turned @ turned.T, m @ m.T)


def test_dense():
    column = pa.array([[1.0, 2.0], None, [], [3.0], [None, 1.0], [float("inf"), 1.0], [4.0, 5.0]], pa.list_(pa.float32()))
    found = {w: (rows.tolist(), m.tolist()) for w, rows, m in vectors.dense(column)}
    assert found == {1: ([3], [[3.0]]), 2: ([0, 6], [[1.0, 2.0], [4.0, 5.0]])}
    assert {w: rows.tolist() for w, rows, _ in vectors.dense(column.slice(2))} == {1: [1], 2: [4]}
    assert vectors.scaled(np.array([[0.0, 0.0], [1e300, 1e300], [3.0, 4.0]])).tolist()[2] == [0.375, 0.5]


def vector_table(spark, rows):
    kept = [(i, v, x) for i, v, x in rows]
    extra = {c: F.lit("x") for c in ("id", "vector", "asked", "block", "width", "score")}
    return spark.createDataFrame(kept, "vec_id long, embedding array<float>, label int").withColumns(extra).repartition(4), pa.table({"vec_id": pa.array([i for i, *_ in kept], pa.int64()), "embedding": pa.array([v for _, v, _ in kept], pa.list_(pa.float32())), "label": pa.array([x for *_, x in kept], pa.int32())})


def mined(held, **more):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(held, F.col("vec_id") % 50 == 0, label, **more)


@pytest.mark.parametrize("block_bytes", [32 << 20, 600])
def test_hard_negatives(spark, block_bytes):
    r = np.random.default_rng(8)
    m = r.standard_normal((400, 12)) + (np.arange(400) % 3 == 0)[:, None]
    m[100:160] = m[100]  # ties
    nan = float("nan")
    rows = [(i, [float(x) for x in v], int(i % 4)) for i, v in enumerate(m)]
    rows += [(450, None, 1), (500, [1.0] * 12, None), (550, [1.0] * 11 + [None], 1), (600, [nan] * 12, 1), (650, [1.0, 2.0], 1), (651, [1.0, 2.5], 1), (652, [1.0, 1.0], 2), (700, [], 1), (None, [1.0] * 12, 1), (401, [2.0] * 12, 3), (401, [2.0] * 12, 3), (401, [1.0] * 12, 2)]
    held, arrow = vector_table(spark, rows)
    got = mined(held, block_bytes=block_bytes)
    assert shown(got) == by_duckdb(hard_negatives.ORACLE_SQL, embeddings=arrow)
    assert got.count() > 50


def test_hard_negatives_of_nothing(spark):
    held, _ = vector_table(spark, [(1, [1.0, 2.0], 1), (3, [1.0, 2.0], 2)])
    assert mined(held).count() == 0
    assert mined(held.limit(0)).count() == 0
    alone, _ = vector_table(spark, [(50, [1.0, 2.0], 1), (3, [1.0, 2.0], 2)])
    assert mined(alone).count() == 0  # no positives, so no windows


def test_products_stay_exact():
    a, x = np.array([[2.0**30, 1.0]]), np.array([[2.0**25, 3.0], [2.0**40, 0.0]])
    assert hard_negatives.products(a, x).tolist() == [[2**55 + 3, 2**63 - 1]]
    scores = np.array([[2**60, 2**60, 5, 2**61]])
    got = hard_negatives.best(scores, np.array([[True, True, True, False]]), np.array([3, 4, 5, 6]), 2)
    assert [x.tolist() for x in got] == [[[2**60, 2**60]], [[3, 4]]]


def test_on_the_given_tables(spark):
    """Recall at the size of the SQL check, over all of its queries."""
    import pyarrow.parquet as pq

    held = pq.read_table(Path(SF) / "embeddings.parquet")
    want = exact(list(zip(held["vec_id"].to_pylist(), held["embedding"].to_pylist())), lambda i: i % 50 == 0)
    assert recall(nearest.op12_nearest(spark, SF).collect(), want) >= 0.9
