"""Whitening, toxicity and spelling groups against plain versions, and on odd input."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regdata.llm import few, spelling, toxicity, whitening
from regdata.llm.queries import QUERIES, table
from tests.llm import brute

DIR = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DIR), reason="driver tables are not here")


def plain_whitening(vectors):
    """Whole numbers, exact deviations, eigenvalues and eigenvectors from the full covariance."""
    x = np.floor(1024 * np.asarray(vectors, dtype=np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return ((n * x - sums) ** 2).sum(axis=1), values[::-1], axes[:, ::-1].T, centred


@here
def test_op11_matches_eigenvectors(spark):
    rows = [r for r in table(spark, DIR, "embeddings").collect()]
    deviation, values, axes, centred = plain_whitening([r.embedding for r in rows])
    found = {}
    for r in QUERIES["op11_bidiagonal_whitening"](spark, DIR).collect():
        found[r.vec_id, r.component] = r
    assert len(found) == 8 * len(rows)
    for k in range(8):
        white = centred @ axes[k] / np.sqrt(values[k])
        own = np.array([found[r.vec_id, k + 1].whitened for r in rows])
        assert np.abs(own * np.sign(own @ white) - white).max() < 1e-9
        assert found[rows[0].vec_id, k + 1].explained == pytest.approx(values[k] / values.sum(), rel=1e-10)
    assert [found[r.vec_id, 1].deviation for r in rows] == deviation.tolist()
    assert all(r.n == len(rows) and r.identity_error < 1e-10 for r in found.values())


def test_whitening_of_equal_eigenvalues(spark):
    """Equal eigenvalues are all found: +-e_i have a covariance that is a multiple of one."""
    points = [[(3.0 if k == i else 0.0) * s for k in range(5)] for i in range(5) for s in (1, -1)]
    df = spark.createDataFrame(list(enumerate(points)), "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    assert np.allclose(model.values, model.values[0]) and np.allclose(model.components @ model.components.T, np.eye(5), atol=1e-12)
    assert model.identity_error < 1e-10


def test_whitening_in_fewer_steps(spark):
    """Leading components settle long before all rounds are made."""
    rng = np.random.default_rng(2)
    points = rng.normal(size=(400, 40)) * np.array([30, 20, 10, *np.ones(37)])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    model = whitening.fit(df, components=3, steps=12)
    _, values, axes, _ = plain_whitening(points)
    assert np.allclose(model.values, values[:3], rtol=1e-9) and np.allclose(np.abs(np.sum(model.components * axes[:3], axis=1)), 1)


def test_whitening_of_odd_rows(spark):
    rows = [
        (1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (None, [3.0, 5.0], 1), (4, None, 0), (5, [float("nan"), 1.0], 0), (6, [float("inf"), 1.0], 0),
        (7, [None, 1.0], 0), (8, [], 0), (9, [1.0], 0), (10, [-2.0, 1e300], 0),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("mine") for c in ("N", "component", "_e", "_k")})
    done = whitening.whiten(df, whitening.fit(df)).collect()
    assert sorted(((r.vec_id, r.component) for r in done), key=repr) == sorted([(i, c) for i in (1, 2, 2, None, 10) for c in (1, 2)], key=repr)
    assert all(r["_e"] == "mine" and r.n == 5 for r in done)
    exact = [[min(int(np.floor(1024 * c)) + 100_000, 2**53) for c in v] for v in ([1.0, 2.0],) * 3 + ([3.0, 5.0], [-2.0, 1e300])]
    sums = [sum(v[k] for v in exact) for k in range(2)]
    expected = [sum((5 * v[k] - sums[k]) ** 2 for k in range(2)) for v in exact]
    assert {r.deviation for r in done} == {v if v < 2**63 else None for v in expected}
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3)], "vec_id long, embedding array<double>")
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whiten(same, whitening.fit(same)).collect()] == [(0, None, None, None)] * 6
    none = whitening.whiten(df.limit(0), whitening.fit(df.limit(0)))
    assert none.count() == 0 and none.columns == ["vec_id", "embedding", "label", "_e", "_k", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_terms_of_a_text():
    def buckets(text):
        data = np.frombuffer(text.encode(), np.uint8)
        doc, bucket = toxicity.terms(data, np.array([0, len(data)]))
        assert set(doc.tolist()) <= {0}
        return set(bucket.tolist())

    assert buckets("Words, words!") == buckets("wORDS") and len(buckets("words")) == 4  # the word, wor, word, words
    assert buckets("été") and len(buckets("été")) == 2 and buckets("") == set() and buckets("12 - 7") == set()
    two = "ab\ncd".encode()
    doc, _ = toxicity.terms(np.frombuffer(two, np.uint8), np.array([0, 2, 5]))
    assert doc.tolist() == [0, 1]


def test_pairs_tell_what_single_weights_cannot():
    """Label 1 where exactly one of two words occurs: no sum of weights says that."""
    rng = np.random.default_rng(1)
    docs, y = [], []
    for _ in range(2400):
        one, two = rng.random(2) < 0.5
        words = ["alpha" if one else "gamma", "omega" if two else "delta", *rng.choice(["und", "the", "les", "con"], 3)]
        docs.append(toxicity.terms(np.frombuffer(" ".join(words).encode(), np.uint8), np.array([0, len(" ".join(words))]))[1])
        y.append(float(one != two))
    y, offsets = np.array(y), np.cumsum([0, *map(len, docs[:2000])])
    right = {}
    for dim in (0, 4):
        model = toxicity.packed(*toxicity.descend(y[:2000], np.concatenate(docs[:2000]), offsets, dim=dim))
        z = [toxicity.logits(np.zeros(len(t), int), t, 1, *toxicity.unpacked(model, dim))[0] for t in docs[2000:]]
        right[dim] = np.mean((np.array(z) > 0) == (y[2000:] == 1))
    assert right[0] < 0.65 and right[4] > 0.95


def test_op12_on_held_out_rows(spark):
    """In sf0.1 a third of the toxic labels stand on texts without any sign of it."""
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in table(spark, d, "labels").collect()}
    found = {r.doc_id: r for r in QUERIES["op12_factor_toxicity"](spark, d).collect()}
    held = [i for i in labels if found[i].held_out]
    caught = [found[i].predicted for i in held if labels[i] == 1]
    wrong = [found[i].predicted for i in held if labels[i] == 0]
    assert sum(caught) >= 0.7 * len(caught) and sum(wrong) <= 0.015 * len(wrong)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())


def test_toxicity_of_odd_rows(spark):
    rows = [(1, "a fine day"), (1, "a fine day"), (2, None), (3, ""), (None, "scum"), (4, "v" * 100_000), (5, "1 2 3")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("_terms", "_label", "Score")})
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (None, 1), (5, None), (4, 7), (99, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    done = toxicity.score(df, model).collect()
    assert len(done) == len(rows) and all(0 <= r.score <= 1 for r in done)
    empty = {r.score for r in done if not r.text or r.text == "1 2 3"}
    assert len(empty) == 1
    assert {r.score for r in toxicity.score(df, toxicity.train(df, labels.limit(0))).collect()} == {0.5}
    assert toxicity.score(df.limit(0), model).count() == 0


def test_smallest_by_a_threshold(spark):
    df = spark.range(20_000).select("id", F.xxhash64("id").alias("h"))
    assert [r.id for r in few.smallest(df, "h", ["id"], 100).collect()] == [r.id for r in df.orderBy("h").limit(100).collect()]
    same = spark.range(5000).select("id", F.lit(2**62).alias("h"))
    assert sorted(r.id for r in few.smallest(same, "h", ["id"], 100).collect()) == list(range(100))


def test_neighbourhoods_are_whole_and_without_repeats():
    k = 3
    for word in ("abcabc", "aaaaaa", "èçßaab", "zzzabczz"):
        s = "".join(map(str, spelling.symbols([word], k)[0]))
        letters = "".join(map(str, range(k)))
        edits = {s} | {s[:i] + s[i + 1 :] for i in range(len(s))}
        edits |= {s[:i] + c + s[i + 1 :] for i in range(len(s)) for c in letters} | {s[:i] + c + s[i:] for i in range(len(s) + 1) for c in letters}
        value, base = spelling._values(k), spelling._BASE
        expected = {sum(int(value[int(c)]) * pow(base, i, 1 << 64) for i, c in enumerate(e)) % 2**64 for e in edits}
        found = np.concatenate([h for _, h in spelling.neighbourhoods([word], k)])
        assert len(found) == len(set(found.tolist())) and set(found.tolist()) == expected


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_match_brute_force(spark, seed):
    """Dense random words over few letters, with many near pairs and ties."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("ababé") for _ in range(rng.randint(6, 7))) for _ in range(300)]
    docs = [(i, " ".join(rng.choices(words, weights=[1.03**i for i in range(300)], k=60))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.word: (r.n, r.n_near, r.form, r.root, r.form_n) for r in spelling.variants(df, edit=spelling.with_slips).collect()}
    assert found == brute.spelling(docs) and any(r[2] for r in found.values())


def test_forms_are_followed_to_the_last(spark):
    chain = ["letter", "lettar", "lattar", "luttar", "luttur", "luttuss"]  # each far commoner than the one before
    df = spark.createDataFrame([(w, 5 * 6**i) for i, w in enumerate(chain)] + [("lettex", 5), ("lettes", 25)], "word string, n long")
    found = {r.word: (r.form, r.form_n, r.root, r.n_near) for r in spelling.grouped(df).collect()}
    assert found["letter"] == ("lettar", 30, "luttur", 3) and found["luttur"] == (None, None, "luttur", 1)
    assert found["luttuss"] == (None, None, "luttuss", 0) and found["lettex"] == ("lettes", 25, "lettes", 2)


def test_spelling_of_odd_rows(spark):
    rows = [(1, "Holiday holiday, HOLIDAY"), (2, None), (3, ""), (None, "holiday holidays"), (4, "holidey " * 30), (4, "holidey " * 30), (5, "x" * 300_000 + " ÷×÷×÷× " * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("word", "N", "_form")})
    found = {r.word: (r.n, r.n_near, r.form, r.root) for r in spelling.variants(df).collect()}
    assert found == {"holidey": (60, 0, None, "holidey"), "÷×÷×÷×": (6, 0, None, "÷×÷×÷×")}
    more = spelling.variants(df.unionByName(df), edit=lambda i, w: w[::-1]).collect()
    assert {r.word for r in more} == {"yadiloh", "yediloh", "×÷×÷×÷"} and {r.form for r in more if r.word == "yadiloh"} == {"yediloh"}
    assert spelling.variants(df.limit(0)).count() == 0
