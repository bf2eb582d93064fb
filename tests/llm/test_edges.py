"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from regdata.llm import ann, bpe, fingerprints, few, lines, mixing, near, pii, quality, substrings, warc, words
from regdata.llm.queries import VOCABULARY
from tests.llm import brute

PROSE = "The first line of a plain text that is long enough.\nAnd a second line, also long enough to count.\n" + " ".join(f"w{i}" for i in range(80))
LONG = " ".join(f"v{i % 997}x{i % 13}" for i in range(60_000))
ROWS = [
    (1, PROSE, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (4, "word", "en", "b", 4), (5, LONG, "en", "b", None),
    (6, PROSE, "en", "c", 1), (6, PROSE, "en", "c", 1), (7, " \n\t ", "en", "a", 4), (8, "é🙂 日本 <|endoftext|>\r\n  x", "fr", "é", 9),
    (None, PROSE, "en", "a", 1), (None, None, None, None, None), (9, "mail a@b.co or +1 (017) 555-7713", "en", None, 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("ids", "Decoded", "score", "n_removed", "n_lines", "kept", "component_id", "taken", "size", "spans", "base", "fingerprint", "lanes", "_id", "_n", "_text")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select("*", *[F.lit("mine").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def codec():
    return bpe.load_codec(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 0, 0), (5, None, None), (None, 1, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_encoding(docs, clashing, codec):
    done = bpe.digest_ids(bpe.decode(bpe.encode(clashing, codec), codec))
    rows = done.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert bytes(r.decoded) == (r.text or "").encode() and (r.ids == []) == (not r.text)
    once = bpe.encode_and_back(clashing, codec).select("ids", "decoded", "ids_sha256").collect()
    assert sorted(once, key=repr) == sorted(done.select("ids", "decoded", "ids_sha256").collect(), key=repr)
    assert bpe.decode(bpe.encode(docs.limit(0), codec), codec).count() == 0


def test_perfect_hash_is_minimal():
    keys = [f"k{i}".encode() for i in range(3001)]
    table = bpe.PerfectHash(keys)
    assert sorted(table.find(keys)) == list(range(3001)) and table.find([b"none", b""]) == [-1, -1]


def test_near_duplicates(docs, clashing):
    rows = near.near_duplicates(clashing).collect()
    assert len(rows) == len(ROWS)
    found = {(r.doc_id, r.text): (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert found[6, PROSE][1:] == (1, False) and found[1, PROSE][1:] == (1, True)
    assert found[2, None] == (0, 2, True) and found[7, " \n\t "] == (0, 7, True) and found[4, "word"] == (1, 4, True)
    assert found[None, PROSE][1:] == (None, True)
    assert near.near_duplicates(docs.limit(0)).count() == 0


def test_mixing(docs, clashing):
    rows = mixing.mix(clashing).collect()
    assert len(rows) == len(ROWS)
    assert all(r["size"] == len(brute.words(r.text)) and 0 <= r.taken <= 3 * r["size"] for r in rows)
    assert mixing.repeated(docs).count() == sum(r.copies for r in rows)
    assert mixing.repeated(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0
    assert all(r.taken == 0 and r.target == 0 for r in mixing.mix(docs.where("doc_id in (2, 3)")).collect())


def test_mixing_splits_ties(spark):
    """A third of the rows share source and size: copies still add up to the target."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("source"))
    done = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 3 for r in done)


def test_fingerprints(docs, clashing):
    rows = fingerprints.edited_fingerprints(clashing).collect()
    assert len(rows) == len(ROWS)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.n_chars, r.fingerprint))
    assert len({f for _, f in by[1] | by[6]}) == 1 and by[2] == by[3]
    assert fingerprints.edited_fingerprints(docs.limit(0)).count() == 0
    alone = fingerprints.edited_fingerprints(docs.where("doc_id = 4")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == brute.sha("worw")


def test_fingerprints_add_up(spark):
    """Order does not matter, and paragraphs are inserted and deleted without the rest."""
    df = spark.createDataFrame([("ab", "one\ntwo words here\nlast"), ("ba", "last\none\ntwo words here"), ("a", "one\ntwo words here"), ("b", "last")], "name string, text string")
    lanes = {r.name: r.lanes for r in fingerprints.fingerprint(df).collect()}
    assert lanes["ab"] == lanes["ba"]
    pair = spark.createDataFrame([(lanes["a"], lanes["b"], lanes["ab"])], "a array<long>, b array<long>, ab array<long>")
    put, cut = pair.select(fingerprints.combine(F.col("a"), F.col("b")), fingerprints.combine(F.col("ab"), F.col("b"), -1)).first()
    assert put == lanes["ab"] and cut == lanes["a"]


def test_line_dedup(docs, clashing):
    rows = lines.line_dedup(clashing).collect()
    assert len(rows) == len(ROWS)
    found = {(r.doc_id, r.n_chars): (r.text, r.n_lines, r.n_removed) for r in rows}
    assert found[1, 5] == (PROSE, 3, 0) and found[6, 1] == ("", 3, 3) and found[2, None] == (None, 0, 0) and found[None, 1] == (PROSE, 3, 0)
    assert lines.line_dedup(docs.limit(0)).count() == 0


def deduped(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.line_dedup(df).collect()}


def test_line_dedup_of_repeated_and_short_lines(spark):
    """A block goes however often it stands in a document, and however short its lines are."""
    header, short = "A page header of more than forty characters.", "\n".join(f"item {k}" for k in range(9))
    texts = {
        1: f"{header}\nfirst page\n{header}\nsecond page", 2: f"own words\n{header}\nmore of them\n{header}\nthe end",
        3: short, 4: short, 5: f"before\n{short}\nafter", 6: "twice\n" * 12, 7: "twice\n" * 12, 8: "ab\ncd", 9: "ab\ncd",
    }
    found = deduped(spark, texts)
    assert found == brute.line_blocks(texts)
    assert [found[i][1] for i in range(1, 10)] == [0, 2, 0, 9, 9, 0, 13, 0, 0]


def test_line_dedup_of_blocks_from_several_documents(spark):
    """A block goes when one earlier document holds it, though its lines come first in different ones."""
    a, b = "a" * 30, "b" * 30
    texts = {1: f"{a}\none", 2: f"{b}\ntwo", 3: f"three\n{a}\n{b}\nends", 4: f"{a}\n{b}\nfour", 5: f"{b}\n{a}\nfive"}
    found = deduped(spark, texts)
    assert found == brute.line_blocks(texts)
    assert [found[i][1] for i in sorted(texts)] == [0, 0, 0, 2, 0]


def test_line_dedup_agrees_with_brute_force(spark):
    """Lines of many lengths from a small stock: repeated, in other orders, short, blank and long."""
    rng = random.Random(7)
    stock = ["", "", "x"] + [f"{k}" * rng.choice((1, 3, 7, 19, 21, 39, 40, 60)) for k in range(40)]
    texts = {i: "\n".join(rng.choice(stock) for _ in range(rng.randrange(1, 25))) for i in range(120)}
    for i in range(120, 150):  # pieces of earlier documents
        texts[i] = "\n".join(texts[rng.randrange(i)][rng.randrange(9) :] for _ in range(3))
    assert deduped(spark, texts) == brute.line_blocks(texts)


def test_rising_chains():
    """The first chain is the longest, all rise in both, and nothing is left."""
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(14))] for _ in range(2))
        pairs = sorted({(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x == y}, key=lambda p: (p[0], -p[1]))
        chains = lines.rising_chains(pairs)
        assert sorted(p for c in chains for p in c) == sorted(pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for c in chains for p, q in zip(c, c[1:]))
        once = {p for p in pairs if a.count(a[p[0]]) == 1 and b.count(b[p[1]]) == 1}
        assert not pairs or len(chains[0]) >= len(brute.patience(a, b)) and (once < set(pairs) or len(chains[0]) == len(brute.patience(a, b)))


def test_alignments_say_where_blocks_come_from(spark):
    a, b, c = ("\n".join(f"{x} line {k} of a block" for k in range(4)) for x in "abc")
    texts = {1: f"{a}\nmiddle\n{b}", 2: f"own\n{b}\nbetween\n{a}\n{c}", 3: f"{c}\n{a}\n{a}"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: [tuple(x) for x in r.aligned] for r in lines.line_dedup(df).collect()}
    assert found[1] == [] and found[2] == [(1, 5, 1, 5), (6, 10, 1, 0)]
    assert found[3] == [(0, 4, 2, 10), (3, 5, 2, 13), (4, 8, 1, 0), (8, 12, 1, 0)] or found[3][-2:] == [(4, 8, 1, 0), (8, 12, 1, 0)]
    for i, blocks in found.items():
        for start, end, other, at in blocks:
            assert texts[i].split("\n")[start:end] == texts[other].split("\n")[at : at + end - start]


def test_line_dedup_agrees_with_patience_over_all_earlier_documents(spark):
    rng = random.Random(11)
    stock = ["", "x", "short line"] + [f"line {k} " * rng.choice((1, 3, 5)) for k in range(25)]
    texts = {i: "\n".join(rng.choice(stock) for _ in range(rng.randrange(1, 18))) for i in range(60)}
    for i in range(60, 80):
        texts[i] = "\n".join(texts[rng.randrange(i)][rng.randrange(9) :] for _ in range(2))
    expected = brute.aligned_lines(texts)
    assert {i: n for i, (_, n, _) in deduped(spark, texts).items()} == {i: len(gone) for i, gone in expected.items()}


def test_hot_keys_are_dealt_to_several_tasks(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    owners = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    found = few.join_spread(rows, owners, "k", "n", ["id"])
    assert found.count() == 9000 and found.where("first <> 0 and k = 7").count() == 0 and found.columns == ["k", "id", "first"]
    assert few.join_spread(rows, owners.limit(0), "k", "n", ["id"]).count() == 0


def test_pii(docs, clashing):
    rows = pii.find(clashing, pii.train(clashing)).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert [tuple(s) for s in r.base] == brute.pii(r.text) and set(map(tuple, r.base)) <= set(map(tuple, r.spans))
    assert pii.train(docs.limit(0)) is None and pii.find(docs.limit(0), None).count() == 0


def test_pii_base_on_random_texts():
    rng = random.Random(6)
    for _ in range(4000):
        text = "".join(rng.choice("0123456789+-. ()@a.b%5") for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == brute.pii(text), text


def test_pii_is_linear():
    """Runs that a backtracking pattern would read again and again."""
    assert pii.base_spans("a" * 300_000 + "@") == [] and pii.base_spans("1" * 300_000) == []


def test_field_finds_numbers_without_their_sign():
    rng = random.Random(7)
    made = []
    for _ in range(300):
        number = f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
        made += list(pii.examples(f"word other {number} more 12 words 3.4")) + list(pii.examples("version 2.0.1 of 48151623 items"))
    weights = pii.learn(made)
    text = "please call 1 (212) 555-0199 today, build 48151623 is out"
    assert [(k, text[a:b]) for k, a, b in pii.extra_spans(text, [], weights)] == [("phone", "1 (212) 555-0199")]


def test_semi_markov_sums_agree_with_enumeration():
    """Marginals and best cut against all cuts of a small region."""
    rng = np.random.default_rng(8)
    pairs = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)]
    scores = rng.normal(size=(5, 4))

    def cuts(i):
        if i >= 4:
            yield []
            return
        for rest in cuts(i + 1):
            yield rest
        for k, (a, b) in enumerate(pairs):
            if a == i:
                for rest in cuts(b):
                    for kind in range(4):
                        yield [(k, kind), *rest]

    every = list(cuts(0))
    value = np.array([sum(scores[k, c] for k, c in cut) for cut in every])
    share = np.exp(value - value.max()) / np.exp(value - value.max()).sum()
    expected = np.zeros((5, 4))
    for cut, p in zip(every, share):
        for k, c in cut:
            expected[k, c] += p
    assert np.allclose(pii.expected(4, pairs, scores), expected)
    top = every[int(value.argmax())]
    assert pii.best(4, pairs, scores) == [(*pairs[k], c) for k, c in top]


def test_quality(docs, clashing, labels):
    model = quality.train(clashing, labels)
    rows = quality.score(clashing, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
    assert quality.score(docs.limit(0), model).count() == 0
    nothing = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, nothing).collect()} == {0.5}
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_substrings(docs, clashing):
    rows = substrings.substring_dedup(clashing).collect()
    assert len(rows) == len(ROWS)
    found = {(r.doc_id, r.n_chars): (r.n_words, r.n_removed) for r in rows}
    n = len(PROSE.split())
    assert found[1, 5] == (n, 0) and found[6, 1] == (n, n) and found[2, None] == (0, 0) and found[None, 1] == (n, 0) and found[5, None][0] == 60_000
    assert substrings.substring_dedup(docs.limit(0)).count() == 0


def test_substrings_on_random_words(spark):
    rng = random.Random(9)
    docs = {i: " ".join(rng.choice("ab") for _ in range(rng.randrange(60))) for i in range(40)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for window in (2, 7, 12):
        found = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substrings.substring_dedup(df, window=window).collect()}
        assert found == brute.substrings(docs, window)


def test_warc(spark):
    body = "x" * 1500
    pages = spark.createDataFrame(
        [(1, "http://a/\nb", body), (2, None, body), (2, None, body), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", body), (7, "u", "é" * 70_000)],
        "page_id long, url string, html string",
    ).withColumn("record_id", F.lit(1)).withColumn("file", F.lit(2))
    index = warc.write_archive(pages)
    rows = warc.read_frames(warc.frame_table(index)).collect()
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in rows)
    assert len(rows) == 9 and [k for k in kinds if k[0] in (0, 1, 2)] == [(0, "revisit", 2, 1500), (1, "revisit", 2, 1500), (2, "response", None, 1500), (2, "response", None, 1500)]
    assert {r.page_id for r in rows if r.record_type == "response"} == {2, 3, 4, 5, 6, 7}
    one = index.where("record_id like 'urn:page:7:%'")
    assert bytes(warc.find_records(index, one).first().payload).decode() == "é" * 70_000
    some = index.where("record_id like 'urn:page:3:%' or record_id like 'urn:page:5:%'").select("record_id")
    odd = some.union(some).union(spark.createDataFrame([("urn:page:99:0",), (None,)], "record_id string"))
    assert sorted(r.page_id for r in warc.find_records(index, odd).collect()) == [3, 5]
    assert sorted(map(repr, warc.find_records(index, index).collect())) == sorted(map(repr, rows))
    assert warc.find_records(index, odd.where("record_id = 'urn:page:99:0'")).count() == 0
    empty = warc.write_archive(pages.limit(0))
    assert empty.count() == 0 and warc.read_frames(warc.frame_table(empty)).count() == 0


def test_warc_bundles_are_plain_zstandard(spark):
    """Any reader unpacks a whole bundle; the seek table is skipped."""
    import io

    import zstandard
    from pyarrow import fs

    pages = spark.range(50).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("page "), 3000).alias("html")).coalesce(1)
    index = warc.write_archive(pages.withColumn("html", F.concat("html", F.col("page_id").cast("string"))))
    system, path = fs.FileSystem.from_uri(index.first().file)
    data = system.open_input_file(path).read()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert sum(1 for _ in warc.records_in(whole)) == 50 and index.agg(F.max("frame")).first()[0] > 0


def test_nearest_neighbours(spark):
    rows = [(100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (200, [0.0, 2.0]), (300, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("_id", F.lit(1)).withColumn("rank", F.lit(1))
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") % 100 == 0).collect())
    assert found == [
        (100, 1, 1, 0.0), (100, 2, 2, 0.0), (100, 3, 3, 2**0.5), (100, 4, 200, 5**0.5),
        (200, 1, 3, 1.0), (200, 2, 1, 5**0.5), (200, 3, 2, 5**0.5), (200, 4, 100, 5**0.5),
    ]
    assert ann.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_equal_vectors_are_searched_once(spark):
    df = spark.range(1, 4001).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.col("id") * 1.0, F.lit(1.0))).alias("embedding"))
    rows = ann.search(df, F.col("vec_id") % 100 == 0).where("query_id = 300").orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in rows] == [(3 * k, 0.0) for k in range(1, 11)]


def test_words_and_windows():
    import pyarrow as pa

    texts_ = ["a b  c", "", None, "héllo\twörld x", " lead", "trail ", "A b c"]
    w = words.Words(*words.utf8(pa.array(texts_)))
    got = [[bytes(w.data[w.start[j] : w.end[j]]).decode() for j in range(w.first[i], w.first[i + 1])] for i in range(len(texts_))]
    assert got == [brute.words(t) for t in texts_]
    low = words.Words(*words.utf8(pa.array(texts_)), lower=True)
    assert low.windows(3)[0][0] == low.windows(3)[0][-1] and w.windows(3)[0][0] != w.windows(3)[0][-1]
    values = np.array([5, 3, 3, 9, 1, 4], dtype=np.uint64)
    assert words.sliding_argmin(values, 3).tolist() == [2, 2, 4, 4] and words.sliding_argmin(values, 9).tolist() == []


def test_marks_beyond_the_broadcast_bound(spark, monkeypatch):
    wide = spark.range(10).withColumn("x", F.col("id") * 2)
    marks = spark.range(3, 6).withColumn("m", F.lit("yes"))
    small = [few.with_marks(wide, marks, ["id"]).collect(), few.only_marked(wide, marks, ["id"]).collect()]
    monkeypatch.setattr(few, "is_small", lambda *a: False)
    large = [few.with_marks(wide, marks, ["id"]).collect(), few.only_marked(wide, marks, ["id"]).collect()]
    assert [sorted(s) for s in small] == [sorted(x) for x in large]


def test_components_in_one_task_and_in_rounds(spark, monkeypatch):
    """Chains, stars, rings, repeated edges and loops, with both ways of finding them."""
    from regdata.llm import components

    rng = random.Random(4)
    order = rng.sample(range(10_000), 400)
    edges = list(zip(order[:200], order[1:200])) + [(order[200], x) for x in order[201:260]] + [(order[300], order[300])]
    edges += [(order[310 + i], order[310 + (i + 1) % 20]) for i in range(20)] * 2 + [(rng.choice(order[340:]), rng.choice(order[340:])) for _ in range(30)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    for few_ in (components.FEW, 3):
        monkeypatch.setattr(components, "FEW", few_)
        assert {r.id: r.c for r in components.components(df).collect()} == {x: find(x) for x in parent}
        assert components.components(df.limit(0)).count() == 0
