import zlib

import numpy as np
from pyspark.sql import functions as F

from tableslice.llm import quality
from tableslice.llm.queries import all_queries, table

SF = "/root/testdata/sf0.01"


def test_held_out_rows_are_classified(spark):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    rows = all_queries()["op1_pu_quality"][0](spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    good = [r.predicted for r in held if labels[r.doc_id] == 1]
    bad = [r.predicted for r in held if labels[r.doc_id] == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.3


def test_held_out_labels_change_nothing(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    turned = labels.withColumn("quality", F.when(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.score(docs.drop("lang", "source"), turned).collect()}
    assert a == b


def test_prior_from_histograms():
    rng = np.random.default_rng(0)
    positive = np.histogram(rng.beta(8, 3, 4000), 400, (0, 1))[0]
    other = np.histogram(rng.beta(2, 8, 3000), 400, (0, 1))[0]
    mixed = np.histogram(rng.beta(8, 3, 7000), 400, (0, 1))[0] + other
    assert abs(quality.class_prior(positive, mixed) - 0.7) < 0.05


def test_risk_is_never_negative_and_classes_part():
    rng = np.random.default_rng(1)
    p = rng.normal(1, 1, (600, 6))
    u = np.concatenate((rng.normal(1, 1, (420, 6)), rng.normal(-1, 1, (180, 6))))
    model = quality.fit_nnpu(p, u, 0.7)
    assert (model.scores(rng.normal(1, 1, (500, 6))) >= 0.3).mean() > 0.95
    assert (model.scores(rng.normal(-1, 1, (500, 6))) >= 0.3).mean() < 0.25


def test_odd_rows(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").limit(300)
    odd = spark.createDataFrame([(5000, None), (5001, ""), (5002, "é" * 3_000_000), (None, "x y"), (5003, "a"), (5003, "a")],
                                "doc_id long, text string")
    every = docs.unionAll(odd).withColumn("score", F.lit("clash")).withColumn("row", F.lit(1))
    labels = table(spark, SF, "labels").unionByName(
        spark.createDataFrame([(None, 1, 0), (5001, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int"))
    rows = quality.score(every, labels).collect()
    assert len(rows) == 306 and all(0 <= r.score <= 1 for r in rows)
    scores = {r.doc_id: r.score for r in rows}
    assert scores[5000] == scores[5001] and [r.held_out for r in rows if r.doc_id is None] == [False]
    kept = quality.keep_good(every, labels)
    assert kept.columns == every.columns
    assert kept.count() == sum(r.predicted for r in rows)
    assert {r.score for r in quality.score(every, labels.limit(0)).collect()} == {0.5}
    assert quality.score(every.limit(0), labels).collect() == []
