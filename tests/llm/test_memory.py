"""What a worker holds stays small, however many rows it has seen."""

import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import public_tokenizers
from regdata.llm import arrow, bpe, mixing, near, quality, words
from regdata.llm.queries import VOCABULARY
from tests.llm import brute


def test_codec_forgets():
    """Both tables together stay under 100 MB after 650,000 different words (up to 350,000 answers twice in each took more)."""
    codec = bpe.load_codec(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    for start in range(0, 650_000, 4000):
        codec.encode("a " + " ".join(f"w{i}q" for i in range(start, start + 4000)))
    tables = [t for m in (codec.pieces, codec.spaced) for t in (m.fresh, m.old)]
    held = sum(sys.getsizeof(t) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in t.items()) for t in tables)
    assert held < 100e6


def test_parts_are_all_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["x" * 1000] * 1000)], ["i", "t"])
    cut = list(arrow.parts(batch, 64 << 10))
    assert [i for b in cut for i in b.column(0).to_pylist()] == list(range(1000))
    assert max(b.num_rows for b in cut) <= 66 and len(list(arrow.parts(batch, 1))) == 1000
    assert list(arrow.parts(batch.slice(0, 0), 64)) == []


def test_operators_compute_in_parts(spark):
    """24 MB that Spark sends as one batch reach the computation as parts of 4 MB, all rows in order."""
    rows = spark.range(0, 3000, 1, 1).withColumn("text", F.repeat(F.lit("x"), 8000))
    told = arrow.add_columns(rows, lambda b: [pa.array([b.num_rows] * b.num_rows, pa.int64())], [("held", T.LongType())])
    out = told.select("id", "held").collect()
    assert [r.id for r in out] == list(range(3000)) and max(r.held for r in out) * 8000 < 5e6


@pytest.mark.parametrize("step", [quality.features, near.shingles])
def test_chunks_take_little(step):
    """Arrays over a text are many times its size, so 4 MB of text are handled in small chunks (those of 1 MB took 94 and 57 MB)."""
    texts = pa.array([" ".join(f"word{(i * k) % 977}" for i in range(250)) for k in range(2000)])
    step(np.frombuffer(b"a b", dtype=np.uint8), np.array([0, 3]))
    tracemalloc.start()
    for _, _, data, offsets in words.chunks(texts):
        step(data, offsets)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20e6


def test_mix_runs_few_jobs(spark):
    """Each plan takes memory of the driver: Newton's rounds are no jobs of their own (with them these were 59 jobs)."""
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, "abcdef")), (F.col("id") % 6 + 1).cast("int")).alias("source"),
        F.repeat(F.lit("w "), (F.col("id") * F.col("id") % 997).cast("int")).alias("text"),
    )
    context = spark.sparkContext
    context.setJobGroup("mix", "")
    try:
        rows = mixing.mix(docs).select("source", "taken", "target").collect()
        jobs = context.statusTracker().getJobIdsForGroup("mix")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    taken = {s: [sum(r.taken for r in rows if r.source == s), next(r.target for r in rows if r.source == s)] for s in "abcdef"}
    assert all(abs(got - due) < 1000 for got, due in taken.values())
    assert len(jobs) <= 40


def near_copies(groups, of):
    """Texts of 60 words, in each group one text with few words exchanged."""
    rng = np.random.default_rng(5)
    docs = {}
    for g in range(groups):
        base = [f"g{g}w{x}" for x in rng.integers(0, 5000, 60)]
        for _ in range(of):
            own = list(base)
            for at in rng.choice(60, rng.integers(0, 4), replace=False):
                own[at] = f"e{rng.integers(1 << 40)}"
            docs[len(docs)] = " ".join(own)
    return docs


def test_near_dedup_runs_few_stages(spark):
    """Every shuffle leaves three files per task: in 211 partitions they were more than the rows (this took 102 stages)."""
    docs = near_copies(12, 25)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    context = spark.sparkContext
    context.setJobGroup("near", "")
    try:
        rows = near.near_duplicates(df).collect()
        status = context.statusTracker()
        stages = {s for j in status.getJobIdsForGroup("near") for s in status.getJobInfo(j).stageIds}
        ran = [s for s in stages if (told := status.getStageInfo(s)) and told.numCompletedTasks]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.near_components(docs)
    assert len(ran) <= 80


@pytest.mark.parametrize("small", [near.SMALL, 0])
def test_near_dedup_of_repeated_ids(spark, monkeypatch, small):
    """Ids with several texts join what these are near to, with marks that are broadcast and with shuffled ones."""
    monkeypatch.setattr(near, "SMALL", small)
    docs = near_copies(4, 8)
    rows = [*docs.items(), (0, docs[12]), (0, docs[12]), (16, None), (16, "one"), (40, "one"), (None, docs[0]), (None, docs[0]), (41, docs[30])]
    single = dict(enumerate(t for _, t in rows))
    label = {k: c for k, (_, c) in brute.near_components(single).items()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, (i, _) in enumerate(rows):
        if i is not None:
            a, b = sorted([find(("id", i)), find(("set", label[k]))])
            parent[b] = a
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    for r in found:
        near_ids = [i for i in {i for i, _ in rows if i is not None} if r.doc_id is not None and find(("id", i)) == find(("id", r.doc_id))]
        assert r.component_id == min(near_ids, default=None) and r.kept == (r.component_id == r.doc_id)
