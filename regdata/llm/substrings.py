"""Removal of passages that an earlier document holds, word for word.

A passage is a window of ``WINDOW`` consecutive words. Windows are looked for level by level,
each twice as long as the one before:

1. at half the length, each window of full length is stood for by its half window with the
   smallest hash. Equal windows have equal stand-ins, and neighbours mostly share one, so 2
   of 27 positions are kept. Stand-ins found in one document only do not go on;
2. windows of full length whose stand-in is repeated are the only ones extended, and their
   hashes are compared. A window is removed from every document but the first one it is in.

Nothing is capped: hot windows collapse in partial aggregation before they are shuffled. A document
whose words are all those of an earlier one is removed as a whole without any windows.

Defined results: a null text has no words. A row without an id neither loses words nor
takes any. Rows with one id are one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regdata.llm.arrow import add_columns, column, list_array, lists, parcel, without
from regdata.llm.few import is_small, only_marked, with_marks
from regdata.llm.words import Words, between, chunks, mix, running, signed, sliding_argmin, utf8
from regdata.session import materialise

WINDOW = 50
SEEDS = 2_000_000  # stand-ins of 8 bytes that may be broadcast
LONGS, INTS = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())


def stand_ins(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of every full window, hash of its stand-in, and place of that."""
    half = window // 2
    hashes, at = words.windows(half)
    _, full = words.windows(window)
    index = np.full(len(words.hash) + 1, -1)
    index[at] = np.arange(len(at))
    chosen = sliding_argmin(hashes, window - half + 1)[index[full]] if len(full) else np.zeros(0, np.int64)
    return full, hashes[chosen], at[chosen]


def outline(docs: DataFrame, window: int) -> DataFrame:
    """Add the number of words, two hashes of all words and the stand-ins of ``_t``."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        none = np.zeros(0, np.int64)
        parts = [[none], [none], [none], [none], [none]]
        for start, end, data, offsets in chunks(column(batch, "_t")):
            words = Words(data, offsets)
            parts[0].append(words.count)
            for i in (1, 2):
                whole = running(words.hash if i == 1 else mix(words.hash ^ np.uint64(7)))
                parts[i].append(signed(between(whole, words.first[:-1], words.first[1:])))
            _, hashes, place = stand_ins(words, window)
            new = np.ones(len(place), dtype=bool)
            new[1:] = place[1:] != place[:-1]
            text = np.searchsorted(words.first, place[new], side="right") - 1
            parts[3].append(signed(hashes[new]))
            parts[4].append(np.bincount(text, minlength=end - start))
        n, one, two, seeds, counts = [np.concatenate(p) for p in parts]
        return [pa.array(n), pa.array(one), pa.array(two), list_array(seeds, counts)]

    long = T.LongType()
    return add_columns(docs, make, [("_n", long), ("_one", long), ("_two", long), ("_seeds", LONGS)])


def extended(docs: DataFrame, window: int) -> DataFrame:
    """Full windows of ``_t`` whose stand-in is among ``_seeds``: ``_starts``, ``_windows``."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        seeds, at = lists(column(batch, "_seeds"))
        starts, hashes, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for start, end, data, offsets in chunks(column(batch, "_t")):
            words = Words(data, offsets)
            full, stand, _ = stand_ins(words, window)
            mine = np.isin(signed(stand), seeds[at[start] : at[end]])
            whole, place = words.windows(window)
            text = np.repeat(np.arange(end - start), words.count)[place[mine]]
            hashes.append(signed(whole[mine]))
            starts.append((full[mine] - words.first[text]).astype(np.int32))
            counts.append(np.bincount(text, minlength=end - start))
        n = np.concatenate(counts)
        return [list_array(np.concatenate(starts), n), list_array(np.concatenate(hashes), n)]

    return add_columns(docs, make, [("_starts", INTS), ("_windows", LONGS)])


def removals(docs: DataFrame, window: int) -> DataFrame:
    """What rows (``_id``, ``_x``) lose: all words (``_all``) or windows (``_starts``)."""
    outlines = materialise(outline(docs, window).drop("_t").where("_id is not null").where(F.col("_n") >= window))
    first = outlines.groupBy("_n", "_one", "_two").agg(F.min("_id").alias("_first"))
    told = outlines.join(first, ["_n", "_one", "_two"])
    copies = told.where("_id > _first").select("_id", "_x").distinct()
    held = told.where("_id = _first").select("_id", "_x", F.explode(F.array_distinct("_seeds")).alias("_seed"))

    seeds = held.groupBy("_seed").agg(F.min("_id").alias("_a"), F.max("_id").alias("_b")).where("_a < _b").select("_seed")
    seeds = materialise(seeds)
    kept = held.join(F.broadcast(seeds) if is_small(seeds, SEEDS) else seeds, "_seed")
    kept = materialise(kept.groupBy("_id", "_x").agg(F.collect_list("_seed").alias("_seeds")))

    found = materialise(extended(only_marked(docs, kept, ["_id", "_x"]), window).drop("_t", "_seeds"))
    owners = found.select("_id", F.explode("_windows").alias("_w")).groupBy("_w").agg(F.min("_id").alias("_a"), F.max("_id").alias("_b"))
    owners = owners.where("_a < _b").select("_w", "_a")
    each = found.select("_id", "_x", F.inline(F.arrays_zip("_starts", "_windows")).alias("_start", "_w"))
    lost = each.join(owners, "_w").where("_a < _id").groupBy("_id", "_x").agg(F.collect_list("_start").alias("_starts"))
    whole = copies.select("_id", "_x", F.lit(None).cast(INTS).alias("_starts"), F.lit(True).alias("_all"))
    return materialise(lost.withColumn("_all", F.lit(False)).unionByName(whole))


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents with repeated passages removed, words joined by one space, and ``n_words``, ``n_removed``."""
    rows, columns = parcel(without(docs, "n_words", "n_removed"), _key=key, _t=text)
    rows = rows.withColumn("_id", F.col("_key").cast("long")).withColumn("_x", F.xxhash64("_t"))
    marked = with_marks(rows, removals(rows.select("_id", "_x", "_t"), window), ["_id", "_x"])

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        data, offsets = utf8(column(batch, "_t"))
        starts, at = lists(column(batch, "_starts"))
        whole = column(batch, "_all").to_pylist()
        kept, n, removed = [], [], []
        for i in range(batch.num_rows):
            words = data[offsets[i] : offsets[i + 1]].tobytes().split()
            n.append(len(words))
            if whole[i]:
                words = []
            elif at[i] < at[i + 1]:
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                edge[starts[at[i] : at[i + 1]]] += 1
                np.subtract.at(edge, starts[at[i] : at[i + 1]] + window, 1)
                words = [w for w, c in zip(words, np.cumsum(edge[:-1])) if not c]
            kept.append(b" ".join(words).decode("utf-8", "replace"))
            removed.append(n[-1] - len(words))
        return [pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())]

    done = add_columns(marked, make, [("_kept", T.StringType()), ("n_words", T.LongType()), ("n_removed", T.LongType())])
    return done.drop("_t").withColumnRenamed("_kept", "_t").select(*columns, "n_words", "n_removed")
