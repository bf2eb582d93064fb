"""Queries that apply each operator to a whole table, and the SQL for those that SQL can say."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regdata.llm import ann, bpe, fingerprints, lines, mixing, near, pii, quality, spelling, substrings, toxicity, warc, whitening

VOCABULARY = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every text and the bytes they decode to, as digests."""
    codec = bpe.load_codec(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return bpe.encode_and_back(table(spark, d, "documents").select("doc_id", "text"), codec).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op2_minhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Set size and component of every document."""
    found = near.near_duplicates(table(spark, d, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_entropy_mix(spark: SparkSession, d: str) -> DataFrame:
    """Words that the mix takes of every document."""
    done = mixing.mix(table(spark, d, "documents").select("doc_id", "text", "source"))
    return done.select("doc_id", "size", "source_size", "target", "taken")


def op4_multiset_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness."""
    return fingerprints.edited_fingerprints(table(spark, d, "documents").select("doc_id", "text"))


def op5_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Lines of every document, lines deleted as parts of blocks that an earlier one holds, and the rest as a digest."""
    done = lines.line_dedup(table(spark, d, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, d: str) -> DataFrame:
    """What the archives say of every page after it was written to them."""
    index = warc.write_archive(table(spark, d, "pages").select("page_id", "url", "html"))
    found = warc.read_frames(warc.frame_table(index))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_semi_markov_pii(spark: SparkSession, d: str) -> DataFrame:
    """Spans of personal data in every text."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs)).drop("text")
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op8_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality of every document; rows held out are never learned from."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, d, "labels"))
    return quality.score(docs, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op9_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Words of every document, words removed and the rest as a digest."""
    done = substrings.substring_dedup(table(spark, d, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_posting_list_ann(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest others of every hundredth vector."""
    return ann.search(table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_bidiagonal_whitening(spark: SparkSession, d: str) -> DataFrame:
    """Leading components of every vector, whitened, with what was measured over all of them."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    done = whitening.whiten(rows, whitening.fit(rows))
    return done.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op12_factor_toxicity(spark: SparkSession, d: str) -> DataFrame:
    """Toxicity of every document; rows held out are never learned from."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, d, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op13_spelling_variants(spark: SparkSession, d: str) -> DataFrame:
    """Every word of the corpus, slips planted by rule, with its near words and its form."""
    found = spelling.variants(table(spark, d, "documents").select("doc_id", "text"), edit=spelling.with_slips)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_entropy_mix": op3_entropy_mix,
    "op4_multiset_fingerprint": op4_multiset_fingerprint,
    "op5_line_dedup": op5_line_dedup,
    "op6_warc": op6_warc,
    "op7_semi_markov_pii": op7_semi_markov_pii,
    "op8_quality": op8_quality,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_posting_list_ann": op10_posting_list_ann,
    "op11_bidiagonal_whitening": op11_bidiagonal_whitening,
    "op12_factor_toxicity": op12_factor_toxicity,
    "op13_spelling_variants": op13_spelling_variants,
}
SQL: dict[str, str] = {
    # all pairs that share a shingle, then everything reachable
    "op2_minhash_near_dedup": r"""
        with recursive d as (
            select doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
            from documents
        ),
        placed as (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0),
        s as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as g from placed),
        n as (select doc_id, count(*) as n from s group by 1),
        common as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
        links as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)),
        ways as (select a, b from links union all select b, a from links),
        reach(id, there) as (
            select doc_id, doc_id from documents union select reach.id, ways.b from reach join ways on ways.a = reach.there
        ),
        found as (select id as doc_id, min(there) as component_id from reach group by 1)
        select f.doc_id, coalesce(n, 0) as n_shingles, component_id, f.doc_id = component_id as kept from found f left join n using (doc_id)
    """,
    # the shortest runs of 40 characters from and to each line; a run goes where an earlier document holds it
    "op5_line_dedup": """
        with d as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
        l as (select doc_id, unnest(range(1, len(lines) + 1)) as spot, unnest(lines) as line from d where text is not null),
        c as (
            select doc_id, spot, sum(length(line)) over (partition by doc_id order by spot) as upto, length(line) as own from l
        ),
        runs as (
            select a.doc_id, a.spot as s, b.spot as e from c a join c b
            on a.doc_id = b.doc_id and b.spot >= a.spot and b.upto - (a.upto - a.own) >= 40 and b.upto - b.own - (a.upto - a.own) < 40
            union
            select b.doc_id, a.spot, b.spot from c a join c b
            on a.doc_id = b.doc_id and b.spot >= a.spot and b.upto - (a.upto - a.own) >= 40 and b.upto - a.upto < 40
        ),
        named as (select r.doc_id, s, e, array_to_string(lines[s : e], chr(10)) as run from runs r join d using (doc_id)),
        first as (select run, min(doc_id) as holder from named group by 1),
        gone as (select distinct doc_id, unnest(range(s, e + 1)) as spot from named join first using (run) where holder < doc_id),
        lost as (select doc_id, list(spot) as ats from gone group by 1)
        select doc_id, coalesce(len(lines), 0) as n_lines, coalesce(len(ats), 0) as n_removed,
               sha256(case when ats is null then coalesce(text, '')
                      else array_to_string([lines[k] for k in range(1, len(lines) + 1) if not list_contains(ats, k)], chr(10)) end) as kept_sha256
        from d left join lost using (doc_id)
    """,
    "op6_warc": """
        with p as (select page_id, coalesce(html, '') as body from pages),
        q as (select page_id, octet_length(encode(body)) as payload_bytes, sha1(body) as payload_digest from p),
        f as (select payload_digest, max(page_id) as first from q where payload_bytes >= 1000 group by 1)
        select page_id, payload_bytes, payload_digest,
               case when page_id < first then 'revisit' else 'response' end as record_type,
               case when page_id < first then first end as refers_to
        from q left join f using (payload_digest)
    """,
    # windows are compared word for word
    "op9_substring_dedup": r"""
        with d as (
            select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
        ),
        s as (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50),
        h as (select doc_id, i, array_to_string(w[i : i + 49], ' ') as win from s),
        f as (select win, min(doc_id) as first from h group by 1),
        gone as (select distinct doc_id, unnest(range(i, i + 50)) as place from h join f using (win) where first < doc_id),
        lost as (select doc_id, list(place) as ats from gone group by 1)
        select doc_id, len(w) as n_words, coalesce(len(ats), 0) as n_removed,
               sha256(array_to_string([w[k] for k in range(1, len(w) + 1) if not list_contains(coalesce(ats, []), k)], ' ')) as kept_sha256
        from d left join lost using (doc_id)
    """,
    # the table of crc32 comes from its rule; a replaced letter leaves equal words when it is deleted from both
    "op13_spelling_variants": """
        with recursive crc as (
            select list(c order by i) as t from (
                select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(3988292384, c // 2) else c // 2 end) as c
                from range(256) r(i))
        ),
        runs as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) as run from documents),
        per as (
            select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w, count(*) as m
            from runs where length(run) >= 6 group by all
        ),
        coded as (select w, m, hex(encode(doc_id || ':' || w)) as x from per),
        hashed as (
            select w, m, xor(4294967295, list_reduce(
                list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::bigint)),
                lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256))) as h
            from coded, crc
        ),
        edited as (
            select case when h % 199 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, m from hashed
        ),
        vocabulary as (
            select word, cast(sum(m) as bigint) as n from edited where length(word) >= 6 group by word having sum(m) >= 5
        ),
        cut as (
            select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as d from (select word, unnest(range(1, length(word) + 1)) as i from vocabulary)
        ),
        pairs as (
            select a.word, b.word as near from cut a join cut b on a.i = b.i and a.d = b.d where a.word <> b.word
            union select cut.word, v.word from cut join vocabulary v on v.word = cut.d
            union select v.word, cut.word from cut join vocabulary v on v.word = cut.d
        ),
        ranked as (
            select p.word, v.n, p.near, w.n as near_n, row_number() over (partition by p.word order by w.n desc, p.near) as place,
                   count(*) over (partition by p.word) as n_near
            from pairs p join vocabulary v on v.word = p.word join vocabulary w on w.word = p.near
        ),
        best as (
            select word, n_near, case when near_n >= 5 * n then near end as form, case when near_n >= 5 * n then near_n end as form_n
            from ranked where place = 1
        ),
        roots(word, root) as (
            select word, word from vocabulary where word not in (select word from best where form is not null)
            union all select best.word, roots.root from best join roots on best.form = roots.word
        )
        select v.word, form, root, n, coalesce(n_near, 0) as n_near, form_n
        from vocabulary v left join best on best.word = v.word join roots on roots.word = v.word
    """,
}
