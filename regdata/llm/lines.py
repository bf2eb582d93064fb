"""Line dedup: documents that overlap are aligned in pairs, and common blocks go from the later one.

A block is a run of neighbouring lines of at least ``MIN_BLOCK`` characters.

1. *Pairs.* Lines are hashed in runs: from each line the shortest block that starts there and the
   shortest that ends there, two per line at most. Short lines thus count with their neighbours, and
   every common block of two documents, however long, consists of runs that both hold. A run pairs
   each later holder with its first holder, the smallest id: a star per run, linear whatever the number
   of holders, so frequent lines need no cap. Runs held by one document pair nothing.
2. *Alignment.* The common runs of a pair are aligned by patience diff: the longest chain of runs that
   rises in both documents. Runs are unique in it, since one that the later document repeats is there once a
   round. What the chain leaves, moved or repeated runs, is aligned again in further
   rising chains until nothing common is left.
3. *Deletion.* Neighbouring aligned runs are one block (``aligned``: first line, line after the last,
   the earlier document and its first line); the lines of all blocks go from the later document.

So a line goes exactly when it stands in a block that an earlier document holds in a row.

Runs travel as 64-bit hashes, texts only meet the list of their own blocks. Runs held by very many
documents are dealt to several tasks, in proportion to their holders.

Defined results: a null text has no lines and stays null; a document without an id stays as it
is; of several rows with one id but different texts only the one with the smallest hash is
compared, equal rows are treated alike. A document all of whose lines are deleted keeps an
empty text. A document of fewer than ``MIN_BLOCK`` characters has no blocks.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regdata.llm.arrow import add_columns, column, list_array, lists, parcel, without
from regdata.llm.few import join_spread, with_marks
from regdata.llm.words import between, running, signed
from regdata.session import materialise

MIN_BLOCK = 40  # characters of a deleted block
LONGS = T.ArrayType(T.LongType())


def longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, sorted by the first, that rises in the second too."""
    tops, last, back = [], [], [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        if at:
            back[k] = last[at - 1]
        tops[at : at + 1], last[at : at + 1] = [j], [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def rising_chains(pairs: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """All pairs in chains that rise in both: the longest one, then what is left, each pair
    behind the chain whose end is the nearest before it."""
    first = longest_rising(pairs)
    out, ends, owner, done = [first] if first else [], [], [], set(first)
    for pair in pairs:
        if pair in done:
            continue
        at = bisect_left(ends, pair[1])
        if at:
            at -= 1
            owner[at].append(pair)
            ends[at] = pair[1]
        else:  # before all ends
            owner.insert(0, [pair])
            ends.insert(0, pair[1])
            out.append(owner[0])
    return out


def aligned_blocks(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Blocks (first line, line after the last, first line of the earlier document) from the common
    runs of a pair (first line, line after the last, first line of the earlier document)."""
    length = {(start, at): end - start for start, end, at in sorted(matches)}
    blocks = []
    for chain in rising_chains(sorted(length, key=lambda p: (p[0], -p[1]))):
        for start, at in chain:
            end = start + length[start, at]
            if blocks and blocks[-1][0] <= start <= blocks[-1][1] and start - blocks[-1][0] == at - blocks[-1][2]:
                blocks[-1] = (blocks[-1][0], max(end, blocks[-1][1]), blocks[-1][2])
            else:
                blocks.append((start, end, at))
    return blocks


def shortest_blocks(lengths: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First line and line after the last of the shortest blocks of at least ``least`` characters
    from every line and to every line, in order; document k has the lines ``offsets[k]`` to ``offsets[k + 1]``."""
    n = len(lengths)
    chars = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    at, held = np.arange(n), np.diff(offsets)
    begin, end = np.repeat(offsets[:-1], held), np.repeat(offsets[1:], held)
    to = np.maximum(np.searchsorted(chars, chars[:-1] + least, side="left"), at + 1)
    since = np.minimum(np.searchsorted(chars, chars[1:] - least, side="right") - 1, at)
    down, up = to <= end, since >= begin
    both = np.concatenate([at[down] * (n + 1) + to[down], since[up] * (n + 1) + at[up] + 1])
    return np.divmod(np.unique(both), n + 1)


def repeats(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a document has the key at an earlier place."""
    order = np.lexsort((np.arange(len(keys)), keys, doc))
    again = np.zeros(len(keys), dtype=bool)
    again[order[1:]] = (keys[order[1:]] == keys[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    return again


def alignments(docs: DataFrame, key: str, text: str, min_block: int = MIN_BLOCK) -> DataFrame:
    """``key``, ``_text`` (hash of the text) and ``aligned``, an array of (start, end, other, other_start), of later documents."""
    split = F.split(text, "\n")
    lined = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("_doc"), F.xxhash64(text).alias("_text"),
        F.transform(split, lambda x: F.xxhash64(x)).alias("_lines"), F.transform(split, lambda x: F.length(x)).alias("_lengths"),
    )
    one = lined.groupBy("_doc").agg(F.min_by(F.struct("_text", "_lines", "_lengths"), "_text").alias("_s")).select("_doc", "_s.*")

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        hashes, offsets = lists(column(batch, "_lines"))
        start, end = shortest_blocks(lists(column(batch, "_lengths"))[0], offsets, min_block)
        doc = np.searchsorted(offsets, start, side="right") - 1
        counts = np.bincount(doc, minlength=batch.num_rows)
        runs = signed(between(running(hashes.view(np.uint64)), start, end))
        places = ((start - offsets[doc]) << 32) | (end - offsets[doc])
        return [list_array(x, counts) for x in (runs, places, repeats(runs, doc))]

    kinds = [("_runs", LONGS), ("_places", LONGS), ("_again", T.ArrayType(T.BooleanType()))]
    runs = materialise(add_columns(one, make, kinds).drop("_lines", "_lengths"))
    held = runs.select("_doc", "_text", F.inline(F.arrays_zip("_runs", "_places", "_again")).alias("_run", "_place", "_again"))
    first = held.groupBy("_run").agg(
        F.min("_doc").alias("_other"), F.max("_doc").alias("_last"), F.count(F.lit(1)).alias("_holders"),
        F.min_by("_place", F.when(~F.col("_again"), F.col("_doc"))).alias("_at"),
    )
    first = materialise(first.where("_other < _last").select("_run", "_other", "_at", "_holders"))
    common = join_spread(held.drop("_again"), first, "_run", "_holders", ["_doc"]).where("_other < _doc")
    pairs = common.groupBy("_doc", "_text").agg(F.sort_array(F.collect_list(F.struct("_other", "_place", "_at"))).alias("_common"))
    block = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("other", pa.int64()), ("other_start", pa.int32())])

    def align(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for cell in column(batch, "_common"):
            rows = cell.values
            place, at = rows.field("_place").to_numpy(), rows.field("_at").to_numpy()
            found: dict[int, list[tuple[int, int, int]]] = {}
            for other, a, b, c in zip(rows.field("_other").to_pylist(), (place >> 32).tolist(), (place & 0xFFFFFFFF).tolist(), (at >> 32).tolist()):
                found.setdefault(other, []).append((a, b, c))
            blocks = sorted((a, b, other, c) for other, own in found.items() for a, b, c in aligned_blocks(own))
            out.append([dict(zip(("start", "end", "other", "other_start"), x)) for x in blocks])
        return [pa.array(out, pa.list_(block))]

    kind = T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("other", T.LongType()), T.StructField("other_start", T.IntegerType()),
    ]))
    return add_columns(pairs, align, [("aligned", kind)]).select(F.col("_doc").alias(key), "_text", "aligned")


def covered(blocks: list[dict], n: int) -> np.ndarray:
    """Which of n lines stand in the blocks."""
    edges = np.zeros(n + 1, dtype=np.int64)
    for b in blocks:
        edges[b["start"]] += 1
        edges[b["end"]] -= 1
    return np.cumsum(edges[:-1]) > 0


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_block: int = MIN_BLOCK) -> DataFrame:
    """The documents with common blocks deleted, and ``n_lines``, ``n_removed``, ``aligned``."""
    rows, columns = parcel(without(docs, "n_lines", "n_removed", "aligned"), _key=key, _t=text)
    rows = rows.withColumn("_key", F.col("_key").cast("long")).withColumn("_text", F.xxhash64("_t"))
    marked = with_marks(rows, materialise(alignments(rows, "_key", "_t", min_block)), ["_key", "_text"])

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        kept, lines, removed = [], [], []
        for t, d in zip(column(batch, "_t"), column(batch, "aligned")):
            t, blocks = t.as_py(), d.as_py()
            split = [] if t is None else t.split("\n")
            gone = covered(blocks, len(split)) if blocks else ()
            lines.append(len(split))
            removed.append(int(sum(gone)))
            kept.append("\n".join([x for x, g in zip(split, gone) if not g]) if blocks else t)
        return [pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(removed, pa.int64())]

    done = add_columns(marked, make, [("_kept", T.StringType()), ("n_lines", T.LongType()), ("n_removed", T.LongType())])
    return done.drop("_t").withColumnRenamed("_kept", "_t").select(*columns, "n_lines", "n_removed", F.coalesce("aligned", F.array()).alias("aligned"))
