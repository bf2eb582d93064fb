"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

Each paragraph (line) is hashed to a wide vector of ``LANES`` numbers, and a document's
fingerprint is their sum, lane by lane, modulo 2**32. The order of paragraphs does not
matter, and a paragraph is inserted or deleted by adding or subtracting its vector
(:func:`combine`). The lanes are

* one count of units, a unit being a run of three words of the paragraph (all, if fewer);
* ``EQUAL`` lanes from hashes of the whole paragraph, for equality;
* 64 lanes that count, bit by bit, the set bits of the units' hashes. Less half the count, they
  form a random projection of the multiset of units, so the cosine of two fingerprints
  estimates how much of their wording two documents share. Below 0 it counts as 0.

Everything is a DataFrame function: units are rows, hashed once, and sums fall out of one
aggregate that needs no shuffle of its own.

Defined results: a null text is an empty one; it has one empty paragraph. Ids ascend with null
last. Rows that share an id are followed by the same next document: of the rows with the
next id, the one whose text has the smallest hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regdata.llm.arrow import without
from regdata.session import materialise

EQUAL = 8
BITS = 64
LANES = 1 + EQUAL + BITS
MASK = 0xFFFFFFFF
RUN = 3


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def unit_rows(rows: DataFrame, text: str) -> DataFrame:
    """One row per unit: ``_h``, ``_place`` in its paragraph, and hashes ``_p0``... of the paragraph."""
    rows = rows.withColumn("_par", F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n"))).drop(text)
    whole = [F.xxhash64(F.lit(k), F.col("_par")).alias(f"_p{k}") for k in range(EQUAL // 2)]
    words = F.split(F.trim(F.regexp_replace("_par", r"[\x20\x09-\x0D]+", " ")), " ")
    rows = rows.select(*[c for c in rows.columns if c != "_par"], *whole, words.alias("_words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_words") - RUN, F.lit(0)))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(RUN)]))
    return rows.select(*[c for c in rows.columns if c != "_words"], F.posexplode(hashes).alias("_place", "_h"))


def lane_sums() -> list[Column]:
    """Sums over units that hold all lanes; two bit counts share one number."""
    first = F.col("_place") == 0
    out = [F.count(F.lit(1)).alias("_n")]
    for k in range(EQUAL // 2):
        out.append(F.sum(F.when(first, F.col(f"_p{k}").bitwiseAND(_long(MASK))).otherwise(0)).alias(f"_e{2 * k}"))
        out.append(F.sum(F.when(first, F.shiftrightunsigned(f"_p{k}", 32)).otherwise(0)).alias(f"_e{2 * k + 1}"))
    for j in range(BITS // 2):
        out.append(F.sum(F.shiftrightunsigned("_h", j).bitwiseAND(_long((1 << 32) | 1))).alias(f"_b{j}"))
    return out


def lane_array() -> Column:
    """The lanes as one array, modulo 2**32."""
    bits = [F.col(f"_b{j}") for j in range(BITS // 2)]
    raw = [F.col("_n"), *[F.col(f"_e{k}") for k in range(EQUAL)], *bits, *[F.shiftrightunsigned(b, 32) for b in bits]]
    return F.array(*[r.bitwiseAND(_long(MASK)) for r in raw])


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of both documents' paragraphs together, or with ``sign=-1`` of the first less the second's."""
    return F.zip_with(a, b, lambda x, y: (x + y * sign).bitwiseAND(_long(MASK)))


def spelled(lanes: Column) -> Column:
    return F.concat_ws("", F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")))


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """From 0 (nothing in common) to 1 (equal fingerprints)."""

    def centred(lanes: Column) -> Column:
        n = F.element_at(lanes, 1)
        return F.transform(F.slice(lanes, 2 + EQUAL, BITS), lambda c: (2 * c - n).cast("double"))

    x, y = centred(a), centred(b)
    cosine = F.try_divide(_dot(x, y), F.sqrt(_dot(x, x) * _dot(y, y)))
    return F.when(a == b, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(cosine, F.lit(0.0)))))


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """The distinct rows of the given columns with ``lanes`` and ``fingerprint`` of their text."""
    docs = without(docs, "lanes", "fingerprint")
    keys = docs.columns
    rows = docs.distinct().withColumn("_text", F.col(text))
    done = unit_rows(rows, "_text").groupBy(*keys).agg(*lane_sums()).select(*keys, lane_array().alias("lanes"))
    return done.withColumn("fingerprint", spelled(F.col("lanes")))


def narrow(lanes: Column) -> Column:
    """Lanes as 32-bit integers of the same bits, for the way through a shuffle."""
    return F.transform(lanes, lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int"))


def wide(lanes: Column) -> Column:
    return F.transform(lanes, lambda x: x.cast("long").bitwiseAND(_long(MASK)))


def following(ids: DataFrame) -> DataFrame:
    """For each distinct (``_null``, ``_id``) the ``_next_null``, ``_next``, ``_next_first`` of the next
    in ascending order, the first after the last.

    Ids are range-partitioned and ranked inside the partitions; one row per partition links
    each to the next.
    """
    order = [F.col("_null"), F.col("_id")]
    placed = materialise(ids.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    one = F.struct("_null", "_id", "_first")
    starts = placed.groupBy("_part").agg(F.min(one).alias("_start"))
    after = F.lead("_start").over(Window.orderBy("_part"))
    starts = starts.select("_part", F.coalesce(after, F.min("_start").over(Window.partitionBy(F.lit(0)))).alias("_after"))
    inside = placed.withColumn("_lead", F.lead(one).over(Window.partitionBy("_part").orderBy(*order)))
    linked = inside.join(starts, "_part").withColumn("_to", F.coalesce("_lead", "_after"))
    return linked.select(*ids.columns, F.col("_to._null").alias("_next_null"), F.col("_to._id").alias("_next"), F.col("_to._first").alias("_next_first"))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_chars``, ``edited_sha256``, fingerprints of every text and of its edited
    form, and the likeness to that and to the next document.

    The edited text has its last quarter replaced by as much of the beginning of the next
    document's. Texts are shuffled by id once, and both joins read that shuffle. Units are summed
    where the second join leaves them: a row number that holds inside a task tells rows apart.
    """
    plain = docs.select(
        F.col(key).isNull().cast("int").alias("_null"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("_id"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    mark = F.xxhash64("_text")
    chain = materialise(following(plain.groupBy("_null", "_id").agg(F.max(F.length("_text")).alias("_need"), F.min(mark).alias("_first"))))

    after = chain.select(F.col("_null").alias("_to_null"), F.col("_id").alias("_to"), "_need", F.col("_next_null").alias("_null"), F.col("_next").alias("_id"), "_next_first")
    # not an equality of columns, which would become a join key and part this shuffle from the next
    heads = plain.join(after, ["_null", "_id"]).where(mark.bitwiseXOR(F.col("_next_first")) == 0)
    heads = heads.select(F.col("_to_null").alias("_null"), F.col("_to").alias("_id"), F.left("_text", F.floor(F.col("_need") / 4).cast("int")).alias("_head"))
    heads = heads.groupBy("_null", "_id").agg(F.first("_head").alias("_head"))

    size = F.length("_text")
    quarter = F.floor(size / 4).cast("int")
    edited = plain.join(heads, ["_null", "_id"]).select(
        "_null", "_id", mark.alias("_x"), size.alias("_chars"), F.monotonically_increasing_id().alias("_u"),
        "_text", F.concat(F.left("_text", size - quarter), F.left("_head", quarter)).alias("_new"),
    )
    parts = [F.conv(F.substring("_sha", 8 * i + 1, 8), 16, 10).cast("long").alias(f"_s{i}") for i in range(8)]
    side = lambda n, c: F.struct(F.lit(n).alias("_side"), F.col(c).alias("_text"))
    kept = ["_x", "_chars", *[f"_s{i}" for i in range(8)]]
    sides = edited.withColumn("_sha", F.sha2("_new", 256)).select(
        "_null", "_id", "_u", "_x", "_chars", *parts, F.inline(F.array(side(0, "_text"), side(1, "_new"))),
    )
    sums = unit_rows(sides, "_text").groupBy("_null", "_id", "_u", "_side").agg(*[F.first(c).alias(c) for c in kept], *lane_sums())
    lanes = sums.select("_null", "_id", "_u", "_side", *kept, narrow(lane_array()).alias("_lanes"))
    lane_of = lambda side: F.max(F.when(F.col("_side") == side, F.col("_lanes")))
    both = lanes.groupBy("_null", "_id", "_u").agg(*[F.first(c).alias(c) for c in kept], lane_of(0).alias("_own"), lane_of(1).alias("_new")).drop("_u")
    both = materialise(both)

    links = chain.select("_null", "_id", "_next_null", "_next", "_next_first")
    other = links.select(F.col("_null").alias("_to_null"), F.col("_id").alias("_to"), F.col("_next_null").alias("_null"), F.col("_next").alias("_id"), F.col("_next_first").alias("_x"))
    other = both.select("_null", "_id", "_x", "_own").join(other, ["_null", "_id", "_x"])
    other = other.groupBy(F.col("_to_null").alias("_null"), F.col("_to").alias("_id")).agg(F.first("_own").alias("_other"))
    told = both.join(other, ["_null", "_id"]).withColumns({c: wide(F.col(c)) for c in ("_own", "_new", "_other")})
    sha = F.concat(*[F.lpad(F.lower(F.hex(f"_s{i}")), 8, "0") for i in range(8)])
    return told.select(
        F.when(F.col("_null") == 0, F.col("_id")).alias(key), F.col("_chars").cast("long").alias("n_chars"), sha.alias("edited_sha256"),
        spelled(F.col("_own")).alias("fingerprint"), spelled(F.col("_new")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_new")).alias("near_edited"), likeness(F.col("_own"), F.col("_other")).alias("near_next"),
    )
