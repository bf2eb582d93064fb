"""Near-duplicate documents by one-permutation MinHash.

A document's set is its distinct word 5-shingles. One hash of each shingle serves as the
permutation: its top bits name one of 128 bins, and a bin keeps its smallest hash. Empty
bins borrow from full ones, each along an own fixed random order (optimal densification).
Four neighbouring bins make a band, so documents with similarity 0.75 share none of the
32 bands with a probability of 5e-6.

Documents with equal sets are one node. From the bands' buckets links are found in two steps:

1. star: every member of a bucket is compared with one centre, the member that comes first
   in an order of ids scrambled by a mask (four masks, by band, so that a member meets several centres);
2. rest: where the members of a bucket are not yet one component, those outside its largest
   component are compared with all members of other components. Members travel in blocks of
   bounded size with 256-byte sketches, and nothing is capped. A document of whose shingles more
   than a quarter occurs nowhere else among those left cannot have a link and leaves first.

A pair goes on to the check of full sets if sizes, shingles found nowhere else and sketches
(within 4 standard deviations) allow a similarity of 0.75; only checked pairs are links. After
both steps every pair of a bucket has been compared or lies in one component anyway.

Defined results: without words a set is empty and linked with nothing. A row without an id is
its own component (null) and is kept. Rows that share an id are one document; that takes a few more
shuffles, left out where no id stands in two rows.

Shuffles are few on purpose: each leaves three files per task on disk until the driver collects its garbage, which
on small tables in many partitions is more than the rows are. What at most ``SMALL`` ids decide is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regdata.llm.arrow import add_columns, column, list_array, parcel, without
from regdata.llm.components import components
from regdata.llm.few import is_small
from regdata.llm.words import Words, between, chunks, mix, running, signed
from regdata.session import materialise

SHINGLE = 5
BINS, ROWS = 128, 4
BANDS = BINS // ROWS
FINE = 512  # bins of the sketch that candidates are compared by
ORDERS = 4  # orders that centres are taken from
BLOCK = 256  # members of a bucket that travel together
SMALL = 500_000  # ids that may be broadcast; more are joined by a shuffle
LONGS = T.ArrayType(T.LongType())
_PROBE = np.argsort(np.random.Generator(np.random.Philox(key=2)).random((BINS, BINS)), axis=1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their texts, sorted by text and hash."""
    words = Words(data, offsets, lower=True)
    hashes, at = words.windows(SHINGLE)
    text = np.repeat(np.arange(len(offsets) - 1), words.count)[at]
    short = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    if len(short):
        whole = between(running(words.hash), words.first[short], words.first[short + 1])
        hashes, text = np.concatenate([hashes, whole]), np.concatenate([text, short])
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], text[new]


def bins(hashes: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Smallest hash of each bin, empty bins filled from others."""
    place = (hashes >> np.uint64(57)).astype(np.int64)
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    out, full = np.zeros((texts, BINS), dtype=np.uint64), np.zeros((texts, BINS), dtype=bool)
    out[text[new], place[new]], full[text[new], place[new]] = hashes[new], True
    row, bin_ = np.nonzero(~full & full.any(axis=1)[:, None])
    probe = 0
    while len(row):
        source = _PROBE[bin_, probe]
        hit = full[row, source]
        out[row[hit], bin_[hit]] = out[row[hit], source[hit]]
        row, bin_, probe = row[~hit], bin_[~hit], probe + 1
    return out


def band_keys(hashes: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Keys of the buckets of each text that has shingles, a row of ``BANDS`` each."""
    low = bins(hashes, text, texts)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (texts, BANDS))
    for r in range(ROWS):
        key = mix(key * np.uint64(31) + low[:, r::ROWS])
    return signed(key[np.bincount(text, minlength=texts) > 0])


def sketches(docs: DataFrame, text: str) -> DataFrame:
    """Add set size, two sums that name the set, and the bands."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        size, one, two, bands = [], [], [], []
        for start, end, data, offsets in chunks(column(batch, text)):
            hashes, doc = shingles(data, offsets)
            n = np.bincount(doc, minlength=end - start)
            first = np.cumsum(n) - n
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(c)), dtype=np.uint64)]) for c in (1, 2)]
            one.append(signed(sums[0][first + n] - sums[0][first]))
            two.append(signed(sums[1][first + n] - sums[1][first]))
            size.append(n)
            bands.append(band_keys(hashes, doc, end - start).ravel())
        n = np.concatenate([np.zeros(0, np.int64), *size]).astype(np.int64)
        none = np.zeros(0, np.int64)
        return [
            pa.array(n), pa.array(np.concatenate([none, *one])), pa.array(np.concatenate([none, *two])),
            list_array(np.concatenate([none, *bands]), np.where(n > 0, BANDS, 0)),
        ]

    long = T.LongType()
    return add_columns(docs, make, [("_n", long), ("_one", long), ("_two", long), ("_bands", LONGS)])


def shingle_sets(docs: DataFrame, text: str) -> DataFrame:
    """Add the sorted distinct shingle hashes, a sketch (per bin a byte of its smallest hash, 0 if it is empty) and the bands."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        none = np.zeros(0, np.int64)
        values, counts, bands, fine = [none], [none], [none], []
        for start, end, data, offsets in chunks(column(batch, text)):
            hashes, doc = shingles(data, offsets)
            values.append(signed(hashes))
            counts.append(np.bincount(doc, minlength=end - start))
            place = (hashes >> np.uint64(64 - 9)).astype(np.int64)
            new = np.ones(len(hashes), dtype=bool)
            new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
            low = np.zeros((end - start, FINE), dtype=np.uint8)
            low[doc[new], place[new]] = (hashes[new] % np.uint64(255)).astype(np.uint8) + np.uint8(1)
            fine += [x.tobytes() for x in low]
            bands.append(band_keys(hashes, doc, end - start).ravel())
        n = np.concatenate(counts)
        return [
            list_array(np.concatenate(values), n), pa.array(fine, pa.binary()),
            list_array(np.concatenate(bands), np.where(n > 0, BANDS, 0)),
        ]

    return add_columns(docs, make, [("_set", LONGS), ("_fine", T.BinaryType()), ("_bands", LONGS)])


def possible(a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Whether sketches ``a``, ``b`` of sets of sizes ``m``, ``n`` with at most ``both`` common
    shingles allow the similarity.

    The bins that are not empty on both sides draw so many shingles from the union, without
    putting any back; the share of equal ones may be 4 standard deviations below 0.75.
    """
    drawn = np.maximum((a | b).astype(bool).sum(axis=-1), 1)
    alike = ((a == b) & (a > 0)).sum(axis=-1) / drawn
    union = np.maximum((m + n) / 1.75, 1)
    slack = 4 * np.sqrt(0.75 * 0.25 / drawn * np.clip(1 - (drawn - 1) / union, 0, 1)) + 1 / drawn
    return (100 * both >= 75 * (m + n - both)) & (alike >= 0.75 - slack)


def fines(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=np.uint8).reshape(-1, FINE)


def likely(edges: DataFrame, info: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` whose sketches allow a link."""
    side = lambda c: info.select(F.col("_rep").alias(c), F.col("_n").alias(f"_n{c}"), F.col("_fine").alias(f"_s{c}"))
    wide = edges.join(side("a"), "a").join(side("b"), "b")

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        m, n = (column(batch, c).to_numpy() for c in ("_na", "_nb"))
        a, b = (fines(column(batch, c).to_pylist()) for c in ("_sa", "_sb"))
        return [pa.array(possible(a, b, m, n, np.minimum(m, n)))]

    return add_columns(wide, make, [("_ok", T.BooleanType())]).where("_ok").select("a", "b")


def confirmed(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges whose full sets are similar enough."""
    side = lambda c: sets.select(F.col("_rep").alias(c), F.col("_set").alias(f"_{c}"))
    wide = edges.join(side("a"), "a").join(side("b"), "b")
    both = F.size(F.array_intersect("_a", "_b"))
    sized = wide.select("a", "b", both.alias("_both"), (F.size("_a") + F.size("_b")).alias("_all"))
    return sized.where("100 * _both >= 75 * (_all - _both)").select("a", "b")


def labelled(ids: DataFrame, labels: DataFrame) -> DataFrame:
    """Add the component of ``_rep``; without links it is its own."""
    return ids.join(labels.withColumnRenamed("id", "_rep"), "_rep", "left").withColumn("_c", F.coalesce("c", "_rep")).drop("c")


def unresolved(members: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with the largest of these and their number."""
    parts = members.groupBy("_key", "_c").agg(F.count(F.lit(1)).alias("_size"))
    keys = parts.groupBy("_key").agg(
        F.count(F.lit(1)).alias("_parts"), F.sum("_size").alias("_members"), F.max(F.struct("_size", "_c")).getField("_c").alias("_big")
    ).where("_parts > 1")
    return members.join(keys, "_key")


def packed(members: DataFrame, name: str) -> DataFrame:
    """Blocks of at most about ``BLOCK`` members of a bucket."""
    block = F.pmod(F.xxhash64("_rep"), F.ceil(F.col("_members") / BLOCK))
    one = F.struct("_rep", "_c", "_n", "_only", "_fine", "_bands")
    return members.withColumn("_block", block).groupBy("_key", "_big", "_block").agg(F.collect_list(one).alias(name)).drop("_block")


def block_pairs(members: DataFrame) -> DataFrame:
    """Possible links between the members outside a bucket's largest component and those of other
    components, each given once, by the first bucket that both are in (more often only for ids with several sets)."""
    outside = packed(members.where("_c <> _big"), "_left")
    blocks = outside.join(packed(members, "_right").drop("_big"), "_key").select("_key", "_big", "_left", "_right")

    def run(batches):
        for batch in batches:
            for key, big, left, right in zip(column(batch, "_key").to_pylist(), column(batch, "_big").to_pylist(), column(batch, "_left"), column(batch, "_right")):
                left, right = left.values, right.values
                rep, comp, n, only = ([s.field(f).to_numpy() for s in (left, right)] for f in range(4))
                a, b = (fines(s.field(4).to_pylist()) for s in (left, right))
                ours, theirs = (s.field(5).flatten().to_numpy().reshape(-1, BANDS) for s in (left, right))
                for i in range(len(a)):
                    # two members outside meet twice, once from each side
                    j = np.flatnonzero((comp[1] != comp[0][i]) & ((comp[1] == big) | (rep[1] > rep[0][i])))
                    j = j[ours[i][(theirs[j] == ours[i]).argmax(axis=1)] == key]
                    both = np.minimum(n[0][i] - only[0][i], n[1][j] - only[1][j])
                    j = j[possible(a[i][None, :], b[j], n[0][i], n[1][j], both)]
                    if len(j):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.minimum(rep[0][i], rep[1][j])), pa.array(np.maximum(rep[0][i], rep[1][j]))], ["a", "b"]
                        )

    return blocks.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with ``n_shingles``, ``component_id`` and ``kept``."""
    names = ("n_shingles", "component_id", "kept")
    rows, columns = parcel(without(docs, *names), _key=key, _t=text)
    rows = rows.withColumn("_id", F.col("_key").cast("long"))
    plain = rows.select("_id", "_t")
    sketched = materialise(sketches(plain.withColumn("_x", F.xxhash64("_t")), "_t").drop("_t"))
    repeated = not is_small(sketched.groupBy("_id").count().where("count > 1"), 0)
    once = DataFrame.distinct if repeated else lambda df: df  # else rows of an id are distinct by themselves
    found = sketched.where("_n > 0 and _id is not null")
    same_set = found.groupBy("_n", "_one", "_two")
    nodes = same_set.agg(F.min("_id").alias("_rep"), F.first("_bands").alias("_bands"))  # equal sets have equal bands

    held = nodes.select("_rep", F.explode("_bands").alias("_key"))
    mask = F.xxhash64(F.pmod("_key", F.lit(ORDERS)))
    buckets = held.groupBy("_key").agg(F.min(F.col("_rep").bitwiseXOR(mask)).alias("_s"), F.count(F.lit(1)).alias("_all"))
    buckets = buckets.where("_all > 1").select("_key", F.col("_s").bitwiseXOR(mask).alias("_centre"))
    members = materialise(held.join(buckets, "_key"))

    wanted = materialise(members.select("_rep").distinct())
    marks = F.broadcast if is_small(wanted, SMALL) else lambda ids: ids  # for tables with at most a row per id wanted
    texts = plain.withColumnRenamed("_id", "_rep").join(marks(wanted), "_rep", "left_semi")
    sets = shingle_sets(texts, "_t").drop("_t").withColumn("_n", F.size("_set").cast("long")).where("_n > 0")
    sets = materialise(sets.dropDuplicates(["_rep", "_set"]) if repeated else sets)

    star = members.where("_rep <> _centre").select(F.least("_rep", "_centre").alias("a"), F.greatest("_rep", "_centre").alias("b"))
    links = materialise(confirmed(likely(star.distinct(), sets), sets))
    labels = components(links)

    left = materialise(unresolved(labelled(members.select("_key", "_rep"), labels)))
    ids = marks(left.select("_rep").distinct())
    among = sets.join(ids, "_rep", "left_semi")
    only = among.select("_rep", F.explode("_set").alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("_times"), F.min("_rep").alias("_rep"))
    only = marks(only.where("_times = 1").groupBy("_rep").agg(F.count(F.lit(1)).alias("_only")))
    able = among.drop("_set").join(only, "_rep", "left").withColumn("_only", F.coalesce("_only", F.lit(0))).where("4 * (_n - _only) >= 3 * _n")
    # the next plan names both several times; without this it would hold all of the above each time
    able = materialise(able)
    those = marks(once(able.select("_rep")))
    rest = materialise(unresolved(left.select("_key", "_rep", "_c").join(those, "_rep", "left_semi")))
    pairs = block_pairs(rest.join(able, "_rep"))
    more = materialise(confirmed(once(pairs), sets.join(those, "_rep", "left_semi")))
    merged = labelled(labelled(more.select(F.col("a").alias("_rep"), "b"), labels).select("_c", F.col("b").alias("_rep")).withColumnRenamed("_c", "x"), labels)
    joins = components(materialise(merged.select(F.col("x").alias("a"), F.col("_c").alias("b"))))
    final = labelled(same_set.agg(F.min("_id").alias("_rep")), labels)
    final = final.join(joins.select(F.col("id").alias("_c"), F.col("c").alias("_to")), "_c", "left")

    # written first, as Spark splits a hot set of copies only where both sides of the join are shuffled for it
    known = materialise(final.select("_n", "_one", "_two", F.coalesce("_to", "_c").alias("_component")))
    each = once(sketched.select("_id", "_x", "_n", "_one", "_two")).join(known, ["_n", "_one", "_two"], "left")
    each = each.withColumn("component_id", F.coalesce("_component", "_id"))
    if repeated:  # rows that share an id are one document: the first of their components
        each = each.drop("component_id").join(each.groupBy("_id").agg(F.min("component_id").alias("component_id")), "_id", "left")
    each = each.select(F.col("_id").alias("_same"), F.col("_x").alias("_y"), "_n", "component_id")
    told = rows.join(each, F.col("_id").eqNullSafe(F.col("_same")) & (F.xxhash64("_t") == F.col("_y")), "left")
    kept = F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True))
    return told.select(*columns, F.col("_n").alias("n_shingles"), "component_id", kept.alias("kept"))
