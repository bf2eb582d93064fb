"""Plain versions of fingerprints and of the mix's optimum, and spans of personal data that are known."""

import math
import os
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from regdata.llm import mixing, pii
from regdata.llm.queries import QUERIES, table
from tests.llm import brute

DIR = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DIR), reason="driver tables are not here")


def chained(*parts):
    """Spark's xxhash64 of several columns: each is hashed with the hash before it as the seed."""
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.to_bytes(4, "little") if isinstance(p, int) else p.encode(), seed=h)
    return h


def plain_lanes(text):
    n, equal, bits = 0, [0] * 8, [0] * 64
    for paragraph in text.split("\n"):
        words = re.sub("[\x20\x09-\x0d]+", " ", paragraph).strip(" ").split(" ")
        for k in range(4):
            p = chained(k, paragraph)
            equal[2 * k] += p & 0xFFFFFFFF
            equal[2 * k + 1] += p >> 32
        for i in range(max(len(words) - 3, 0) + 1):
            h = chained(*words[i : i + 3])
            n += 1
            for j in range(64):
                bits[j] += h >> j & 1
    return [x & 0xFFFFFFFF for x in (n, *equal, *bits)]


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = ([2 * c - v[0] for c in v[9:]] for v in (a, b))
    dot = lambda p, q: sum(i * j for i, j in zip(p, q))
    below = math.sqrt(dot(x, x) * dot(y, y))
    return min(1.0, max(0.0, dot(x, y) / below)) if below else 0.0


@here
def test_op4_matches_plain_lanes(spark):
    docs = {r.doc_id: r.text or "" for r in table(spark, DIR, "documents").collect()}
    found = {r.doc_id: r for r in QUERIES["op4_multiset_fingerprint"](spark, DIR).collect()}
    order = sorted(docs)
    lanes = {i: plain_lanes(docs[i]) for i in order}
    for at, i in enumerate(order):
        after = order[(at + 1) % len(order)]
        text, cut = docs[i], len(docs[i]) // 4
        new = plain_lanes(text[: len(text) - cut] + docs[after][:cut])
        r = found[i]
        assert r.fingerprint == "".join(f"{x:08x}" for x in lanes[i]) and r.edited_fingerprint == "".join(f"{x:08x}" for x in new)
        assert r.near_edited == pytest.approx(plain_likeness(lanes[i], new), abs=1e-12)
        assert r.near_next == pytest.approx(plain_likeness(lanes[i], lanes[after]), abs=1e-12)


@here
def test_op3_rates_solve_the_dual(spark):
    """Newton's multipliers against a bisection of each source's equation."""
    docs = table(spark, DIR, "documents").select(F.col("source").alias("_source"), mixing.word_count(F.col("text")).alias("_size"))
    sizes = docs.groupBy("_source", "_size").agg(F.count(F.lit(1)).alias("_n")).cache()
    goals = mixing.targets(sizes)
    held = {}
    for r in sizes.collect():
        held.setdefault(r["_source"], []).append((r["_size"], r["_n"]))
    some = 0
    for r in mixing.rates(sizes, goals).collect():
        own = held[r["_source"]]

        def words(m):
            return sum(n * s * min(mixing.CAP, math.exp(min(m * s / r["_mean"], 50.0))) for s, n in own)

        if r["_m"] is None:
            assert r["_target"] >= mixing.CAP * r["_words"] * (1 - 1e-9)
            continue
        low, high = -60.0, 60.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if words(middle) < r["_target"] else (low, middle)
        assert words(r["_m"]) == pytest.approx(r["_target"], rel=1e-8) and r["_m"] == pytest.approx(low, rel=1e-5, abs=1e-7)
        some += 1
    assert some > 3


def test_op7_spans_that_are_known(spark):
    """Precision and recall on texts with known spans: the field finds what patterns miss, and little else."""
    rng = random.Random(12)

    def card():
        digits = [rng.randrange(10) for _ in range(15)]
        last = next(d for d in range(10) if brute.luhn([*digits, d]))
        return "".join(map(str, [*digits, last]))

    def phone(sign):
        return f"{sign}1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"

    train = [(i, f"please write to a{i}@mail.example.org or call {phone('+')} about card {card()} from 10.0.{i % 250}.7 today") for i in range(400)]
    # texts without any of it: versions, orders and amounts
    train += [(400 + i, f"order {rng.randrange(10**6, 10**8)} of version {i % 9}.{i % 4}.{i % 7} costs {i}.50") for i in range(400)]
    texts, truth = [], []
    for i in range(200):
        kind, value = rng.choice([("phone", phone("")), ("phone", phone("+")), ("card", card()), ("email", f"b{i}@site.example.com"), ("ip", f"192.168.{i}.9")])
        before = rng.choice(["please call ", "write or call ", "about card ", "today from "])
        texts.append((1000 + i, f"{before}{value} and order 48151623 of version 2.0.1"))
        truth.append((1000 + i, kind, len(before), len(before) + len(value)))
    schema = "doc_id long, text string"
    model = pii.train(spark.createDataFrame(train, schema))
    rows = pii.find(spark.createDataFrame(texts, schema), model).collect()
    found = {(r.doc_id, *s) for r in rows for s in r.spans}
    base = {(r.doc_id, *s) for r in rows for s in r.base}
    recall = lambda x: len(x & set(truth)) / len(truth)
    assert base <= found and recall(found) >= 0.95 and recall(found) > recall(base) + 0.1
    assert len(found & set(truth)) >= 0.95 * len(found)
