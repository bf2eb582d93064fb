"""The corpus pipeline: columns, decisions and odd inputs of every stage."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_edges import ROWS, SCHEMA

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="driver tables are not here")


def test_stages_on_driver_tables(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, steps = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, steps[-1], DIR)
        out = spark.createDataFrame(out.toPandas(), out.schema)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        steps.append(out)
    good, lined, near, mixed, coded = steps[1:]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean) and len(kept) < docs.count()
    assert {r.doc_id for r in lined.collect()} <= kept
    texts = {r.doc_id: r.text for r in lined.collect()}
    components = brute.near_components(texts)
    assert {r.doc_id for r in near.collect()} == {i for i, (_, c) in components.items() if c == i}
    assert mixed.select("doc_id").distinct().subtract(near.select("doc_id")).count() == 0
    assert coded.count() == mixed.count()


def test_stages_on_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    d = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        wider = stage(spark, docs.withColumn("Score", F.lit(1)).withColumn("kept", F.lit("x")), d)
        assert name == "encode" or wider.columns == [*docs.columns, "Score", "kept"]
        wider.collect()
        assert stage(spark, docs.limit(0), d).count() == 0
    docs.write.parquet(f"{d}/documents.parquet")
    assert corpus_pipeline.run(spark, d).count() > 0
