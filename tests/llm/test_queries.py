"""The registered queries on driver tables against SQL or plain versions."""

import os

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from contract.compare import duck, rows_of
from regdata.llm import ann, bpe, near
from regdata.llm.queries import QUERIES, SQL, VOCABULARY, table
from tests.llm import brute

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="driver tables are not here")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in table(spark, DIR, "documents").select("doc_id", "text").collect()}


def result(spark, name, key="doc_id"):
    rows = QUERIES[name](spark, DIR).collect()
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, name):
    df = QUERIES[name](spark, DIR)
    answer = duck(DIR).execute(SQL[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in answer.description], answer.fetchall())


def test_op1_matches_the_library(spark, docs):
    codec = bpe.load_codec(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    found = result(spark, "op1_byte_bpe")
    assert found.keys() == docs.keys()
    for i, text in docs.items():
        ids = library.encode_ordinary(text or "")
        assert tuple(found[i]) == (i, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(text or ""))


def test_op2_finds_every_link(spark, docs):
    found = result(spark, "op2_minhash_near_dedup")
    expected = brute.near_components(docs)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in found.items()} == {i: (n, c, c == i) for i, (n, c) in expected.items()}


def test_op3_meets_its_targets(spark, docs):
    found = result(spark, "op3_entropy_mix")
    source = {r.doc_id: r.source for r in table(spark, DIR, "documents").select("doc_id", "source").collect()}
    size = {i: len(brute.words(t)) for i, t in docs.items()}
    names = sorted(set(source.values()))
    words = {s: sum(size[i] for i in docs if source[i] == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    goal, full = {}, set()
    while True:
        left = sum(words.values()) - sum(3 * words[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        goal = {s: 3 * words[s] if s in full else share[s] for s in names}
        more = {s for s in share if share[s] > 3 * words[s]}
        if not more:
            break
        full |= more
    for i, r in found.items():
        assert (r.size, r.source_size) == (size[i], words[source[i]]) and r.target == pytest.approx(goal[source[i]])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    for s in names:
        own = [r for i, r in found.items() if source[i] == s]
        assert abs(sum(r.taken for r in own) - goal[s]) <= max(30, 0.02 * goal[s])
    assert {i: r.taken for i, r in result(spark, "op3_entropy_mix").items()} == {i: r.taken for i, r in found.items()}


def test_op4_edits_and_likeness(spark, docs):
    found = result(spark, "op4_multiset_fingerprint")
    order = sorted(docs)
    by_text = {}
    for k, i in enumerate(order):
        text, after = docs[i] or "", docs[order[(k + 1) % len(order)]] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), brute.sha(edited))
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        assert len(text) < 400 or after == text or r.near_edited > r.near_next
    assert len(set(by_text.values())) == len(by_text)


def test_op5_deletes_only_what_earlier_documents_hold(spark, docs):
    found = result(spark, "op5_line_dedup")
    seen = set()
    some = 0
    for i in sorted(docs):
        lines = docs[i].split("\n")
        assert found[i].n_lines == len(lines)
        shared = [x for x in lines if x in seen]
        assert found[i].n_removed <= len(shared)
        some += found[i].n_removed
        if not any(len(x) >= 20 for x in shared):
            assert found[i].n_removed == 0 and found[i].kept_sha256 == brute.sha(docs[i])
        seen.update(lines)
    assert some > 0
    copies = [i for i in sorted(docs) if any(docs[j] == docs[i] for j in docs if j < i) and len(docs[i]) > 200]
    assert copies and all(found[i].n_removed == found[i].n_lines for i in copies)


def test_op5_matches_brute_force(spark, docs):
    found = result(spark, "op5_line_dedup")
    expected = brute.line_blocks(docs)
    assert {i: tuple(r)[1:] for i, r in found.items()} == {i: (n, gone, brute.sha(kept)) for i, (n, gone, kept) in expected.items()}


def test_op7_keeps_base_spans_and_adds_few(spark, docs):
    found = result(spark, "op7_semi_markov_pii")
    extra = 0
    for i, text in docs.items():
        base, r = brute.pii(text), found[i]
        assert r.base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")]
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert set(base) <= set(spans)
        extra += len(spans) - len(base)
    assert extra <= 0.02 * len(docs)


def test_op8_is_accurate_on_held_out_rows(spark):
    found = result(spark, "op8_quality")
    labels = {r.doc_id: r.quality for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    found = {r.doc_id: r for r in QUERIES["op8_quality"](spark, "/root/testdata/sf0.01").collect()}
    held = [i for i in labels if found[i].held_out]
    right = sum(found[i].predicted == labels[i] for i in held)
    assert len(held) > 40 and right >= 0.93 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())


def test_op9_matches_brute_force(spark, docs):
    found = result(spark, "op9_substring_dedup")
    expected = brute.substrings(docs)
    assert {i: tuple(r)[1:] for i, r in found.items()} == {i: (n, gone, brute.sha(kept)) for i, (n, gone, kept) in expected.items()}


def test_op10_recall_and_exact_scores(spark):
    rows = table(spark, DIR, "embeddings").collect()
    ids = np.array([r.vec_id for r in rows])
    points = np.array([r.embedding for r in rows], dtype=np.float64)
    found = {}
    for r in QUERIES["op10_posting_list_ann"](spark, DIR).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
        best = [k for k in np.lexsort((ids, d)) if k != q][:10]
        own = found[ids[q]]
        assert sorted(own) == list(range(1, 11))
        assert all(abs(d[ids == v][0] - s) < 1e-12 for v, s in own.values())
        assert [own[k] for k in sorted(own)] == sorted(own.values(), key=lambda x: (x[1], x[0]))
        hits, total = hits + len({v for v, _ in own.values()} & set(ids[best])), total + 10
    assert hits >= 0.9 * total


def test_op10_many_lists(spark):
    """Recall where the lists are many and pruned, on clustered points."""
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(60, 16)) * 4
    points = middle[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 16))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F

    found = {}
    for r in ann.search(df, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 6000, 100):
        d = ((points - points[q]) ** 2).sum(axis=1)
        hits += len(found[q] & set(np.argsort(d)[1:11].tolist()))
    assert hits >= 0.9 * 600


def test_near_duplicates_in_a_large_group(spark):
    """Copies with edits of their own: links straddle the threshold, and no centre links to all."""
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    docs = {0: " ".join(base)}
    for i in range(1, 260):
        w = list(base)
        for at in rng.choice(120, rng.integers(1, 6), replace=False):
            w[at] = f"e{i}x{at}"
        docs[i] = " ".join(w)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_duplicates(df).collect()}
    assert found == brute.near_components(docs)
