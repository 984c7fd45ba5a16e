"""The pipeline's stages against plain versions, models without held-out labels, long texts, empty tables and repeated ids."""

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, components, decontamination, jaccard_join, mixing, quality, secrets, span_dedup, toxicity

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def toxic_model(spark):
    return toxicity.train(*tables(spark))


def test_held_out_labels_are_not_learned_from(spark, toxic_model):
    docs, labels = tables(spark)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    turned = labels.withColumns({c: F.when(held, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    assert toxicity.train(docs, turned) == toxic_model
    scores = lambda x: [r["score"] for r in quality.score(docs, quality.train(docs, x)).orderBy("doc_id").collect()]
    assert np.allclose(scores(labels), scores(turned), atol=1e-12)


def test_toxicity_stage_keeps_what_scores_low(spark, toxic_model):
    docs, _ = tables(spark)
    meters = toxic_model.meters()
    want = {r["doc_id"] for r in docs.collect() if toxic_model.score(np.array([toxicity.margin(r["text"], meters)]))[0] < 0.5}
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == docs.columns
    assert docs.count() - len(want) < 0.1 * docs.count()


def test_secret_and_mixing_stages_keep_every_document(spark):
    docs, _ = tables(spark)
    found = {r["doc_id"]: r for r in secrets.scan(docs, secrets.train(docs)).collect()}
    before = {r["doc_id"]: r for r in docs.collect()}
    after = {r["doc_id"]: r for r in corpus_pipeline.redact_secrets(spark, docs, SF).collect()}
    assert after.keys() == before.keys()
    for i, r in after.items():
        same = not found[i]["spans"]
        assert (r["text"] == before[i]["text"]) == same and (r["lang"], r["source"]) == (before[i]["lang"], before[i]["source"])
        assert r["n_chars"] == (before[i]["n_chars"] if same else len(r["text"]))
    taken = corpus_pipeline.mix_sources(spark, docs, SF)
    assert {r["doc_id"] for r in taken.collect()} == before.keys()


def test_long_texts(spark, toxic_model):
    r = random.Random(2)
    long = " ".join(r.choice(["the", "and", "ing", "tion", "word", "x" * 40]) for _ in range(400_000))
    texts = [long, "a" * 1_500_000, ". " * 500_000, "\n" * 1_000_000, "é" * 700_000]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOC)
    _, labels = tables(spark)
    model = quality.train(*tables(spark))
    for work in (lambda: toxicity.score(docs, toxic_model), lambda: quality.score(docs, model), lambda: mixing.mix(docs), lambda: span_dedup.dedup_spans(docs)):
        began = time.time()
        assert work().count() == 5 and time.time() - began < 90


def test_pipeline_of_nothing_and_of_repeated_ids(spark, tmp_path):
    text = lambda seed: " ".join(random.Random(seed).choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) + str(random.Random(seed + i).randrange(90)) for i in range(80))
    rows = [(1, text(1)), (1, text(1)), (1, text(500)), (2, text(1)), (3, text(900)), (None, text(1300)), (None, text(1300)), (4, None), (5, "")]
    for name, held in (("some", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame([(i, t, "en", "s", 1) for i, t in held], DOC).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        got = sorted(str(r["doc_id"]) for r in corpus_pipeline.run(spark, str(folder)).collect())
        # An id's repeated rows count once, its other text stays; 2 is a copy of 1.
        assert got == ([] if name == "none" else ["1", "1", "3", "4", "5", "None"])


def test_stages_give_python_few_rows_and_broadcast_little(spark, monkeypatch):
    """A batch of whole texts is held several times by either side, and a broadcast is hashed by the driver."""
    docs, _ = tables(spark)
    seen, real = [], common.cut

    def spy(df):
        seen.append((int(spark.conf.get(common.BATCH_ROWS)), int(spark.conf.get(common.BROADCAST).rstrip("b"))))
        return real(df)

    for module in (jaccard_join, decontamination):
        monkeypatch.setattr(module, "cut", spy)
    before = [spark.conf.get(key) for key in (common.BATCH_ROWS, common.BROADCAST)]
    few = docs.limit(50)
    jaccard_join.near_duplicates(few).count()
    decontamination.leaks(few, docs.limit(3).selectExpr("doc_id as item_id", "text")).count()
    assert len(seen) > 5 and all(rows <= 1000 and size <= 1 << 18 for rows, size in seen)
    assert [spark.conf.get(key) for key in (common.BATCH_ROWS, common.BROADCAST)] == before


def test_rounds_of_the_join_plan_little(spark, monkeypatch):
    """The driver's memory follows the stages that it plans and the code that it compiles for them."""
    prose = lambda seed: [f"w{random.Random(seed * 1000 + j).randrange(400)}" for j in range(60)]
    texts = [" ".join([*prose(k), f"end{i}"]) for k in range(6) for i in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, real = [], common.cut

    def spy(df):
        seen.append(spark.conf.get("spark.sql.codegen.wholeStage"))
        return real(df)

    monkeypatch.setattr(components, "cut", spy)
    before = spark.conf.get("spark.sql.codegen.wholeStage")
    spark.sparkContext.setJobGroup("rounds", "rounds")
    try:
        got = jaccard_join.near_duplicates(docs).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r["component_id"] for r in sorted(got)] == [k * 5 for k in range(6) for _ in range(5)]
    assert len(seen) > 1 and set(seen) == {"false"} and spark.conf.get("spark.sql.codegen.wholeStage") == before
    # 87 when each round joined what it now unites.
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")) < 80


def test_bitmaps_of_the_benchmark_stay_packed():
    """Eight size classes take a worker their packed bitmaps, 1 MB each, and not a byte for each bit."""
    packed = b"\xff" * (decontamination.BITS // 8)
    probe = decontamination._probe([(1, (1 << 64) - 1, packed)] * 8, packed, 5, (1,), packed)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["one two three four five six seven", None])], ["doc_id", "text"])
    tracemalloc.start()
    try:
        got = list(probe(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # Three runs of five words and seven words.
    assert got[0].num_rows == 10 and peak < 8 << 20
