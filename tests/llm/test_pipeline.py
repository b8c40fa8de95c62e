from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_chain_and_keep_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, sizes = {r.doc_id: r for r in docs.collect()}, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        sizes[name] = docs.count()
        if name != "packing":
            assert docs.columns == COLUMNS
            assert all(first[r.doc_id].source == r.source for r in docs.collect())
        if name == "personal_data":
            assert sizes[name] == before.count()
            assert docs.filter("n_chars <> length(text)").count() == 0
        if name == "mixture":
            assert max(Counter(r.doc_id for r in docs.collect()).values()) <= 3
    assert 0 < sizes["near_duplicates"] <= sizes["quality"] <= len(first)
    whole = defaultdict(int)
    for r in docs.collect():
        whole[r.doc_id] += r.length
    times = Counter(r.doc_id for r in before.collect())
    tokens = {r.doc_id: r.doc_tokens for r in docs.collect()}
    assert {d: tokens[d] * n for d, n in times.items()} == dict(whole)


def test_run_is_registered_and_empty_input_passes(spark, tmp_path):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_odd_rows_pass_every_stage(spark, tmp_path):
    odd = spark.createDataFrame(
        [(9001, None, None, None, None), (9002, "", "en", "src0", 0), (None, "some words here", "en", None, 15),
         (9003, "word " * 50_000, "en", "big", 250_000), (9004, "same text", "en", "s", 9), (9004, "same text", "en", "s", 9)],
        "doc_id long, text string, lang string, source string, n_chars long").withColumn("__row", F.lit("clash"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("__row", F.lit("c")).unionByName(odd)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() > 0
