"""Quality classifier: averaged vectors of words and character n-grams, softmax on top.

Every word and every run of 3 or 4 characters inside a word names, by its hash, one of a
fixed number of vectors; a word that repeats the one before it names one more. A document is the mean of its vectors; a softmax layer turns it
into two probabilities. Vectors and layer are learned by stochastic gradient descent in
numpy from a bounded sample of labelled documents: the ``sample`` smallest by a hash of
their id, so that it does not depend on the order of rows. Features of the sample are
computed by Spark and learned from in one task; the driver sees the learned weights only.

As mean and layer are linear, a learned model boils down to one number per bucket, and
scoring is a look-up and an average over whole texts.

Defined results: a text without words (null, empty) gets the score of the bias alone. Null
labels are no labels; without any labelled row every score is 0.5. Repeated labels count
as often as they occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regdata.llm.arrow import add_columns, column, learned, list_array, lists, unused
from regdata.llm.few import smallest
from regdata.llm.words import Words, between, chunks

GRAMS = (3, 4)
BITS = 17  # words have 2**BITS vectors, n-grams as many again
AGAIN = 2 << BITS  # the vector of a word that repeats the one before
BUCKETS = AGAIN + 1
SAMPLE = 4000  # labelled documents that are learned from, at most
DIM, EPOCHS, STEPS, RATE, SEED = 8, 6, 12_000, 0.5, 8  # a small sample is gone through until STEPS steps are made


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and n-gram of some texts, and the text it is in."""
    words = Words(data, offsets)
    shift = np.uint64(64 - BITS)
    text = np.repeat(np.arange(len(offsets) - 1), words.count)
    buckets, texts = [(words.hash >> shift).astype(np.int32)], [text]
    again = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (text[1:] == text[:-1]))
    buckets.append(np.full(len(again), AGAIN, dtype=np.int32))
    texts.append(text[again])
    chars = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes
    place = np.searchsorted(words.start, chars, side="right") - 1
    inside = place >= 0
    inside[inside] = chars[inside] < words.end[place[inside]]
    place = np.where(inside, place, -1 - np.arange(len(place)))  # a blank is alone
    edge = np.append(chars, len(data))
    for n in GRAMS:
        at = np.flatnonzero(place[n - 1 :] == place[: len(place) - n + 1]) if len(place) >= n else np.zeros(0, np.int64)
        hashes = between(words.sums, edge[at], edge[at + n])
        buckets.append((hashes >> shift).astype(np.int32) + (1 << BITS))
        texts.append(text[place[at]] if len(at) else at)
    return np.concatenate(buckets), np.concatenate(texts)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def counted(df: DataFrame, text: str) -> DataFrame:
    """Add the distinct buckets of a text and how often each occurs."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        which, often, sizes = [], [], []
        for start, end, data, offsets in chunks(column(batch, text)):
            bucket, doc = features(data, offsets)
            key, n = np.unique(doc.astype(np.int64) << (BITS + 2) | bucket, return_counts=True)
            which.append((key & ((4 << BITS) - 1)).astype(np.int32))
            often.append(n.astype(np.int32))
            sizes.append(np.bincount(key >> (BITS + 2), minlength=end - start))
        empty = np.zeros(0, np.int32)
        counts = np.concatenate(sizes) if sizes else empty
        return [list_array(np.concatenate([empty, *x]), counts) for x in (which, often)]

    ints = T.ArrayType(T.IntegerType())
    return add_columns(df, make, [("_which", ints), ("_often", ints)])


def descend(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """Learn from (label, buckets, counts); give one weight per bucket and a bias."""
    rng = np.random.Generator(np.random.Philox(key=SEED))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    epochs = max(EPOCHS, -(-STEPS // len(rows)))
    step, steps = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, which, often = rows[i]
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            share = often.astype(np.float32) / np.float32(max(1, often.sum()))
            own = vectors[which]
            mean = share @ own
            logits = layer @ mean + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[label] -= 1
            back = error @ layer
            layer -= rate * np.outer(error, mean)
            bias -= rate * np.float32(0.1) * error
            vectors[which] = own - rate * DIM * share[:, None] * back
    return (vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Learn ``label`` from labelled documents that are not held out."""
    order = F.xxhash64(key)
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(key)) & F.col(key).isNotNull())
    picked = smallest(known.select(order.alias("_order"), key, F.col(label).cast("int").alias("_label")), "_order", [key, "_label"], sample)
    rows = docs.select(key, F.col(text).alias("_t")).join(F.broadcast(picked), key)  # at most ``sample`` rows are broadcast

    def fit(batch: pa.RecordBatch) -> bytes:
        which, at = lists(column(batch, "_which"))
        often, _ = lists(column(batch, "_often"))
        known = column(batch, "_label").to_pylist()
        weights, bias = descend([(y, which[a:b], often[a:b]) for y, a, b in zip(known, at[:-1], at[1:])])
        return weights.tobytes() + np.float32(bias).tobytes()

    model = learned(counted(rows, "_t").select("_order", "_label", "_which", "_often"), ["_order", "_label"], fit)
    numbers = np.frombuffer(model, dtype=np.float32) if model else np.zeros(BUCKETS + 1, np.float32)
    return numbers[:-1], float(numbers[-1])


def score(df: DataFrame, model: tuple[np.ndarray, float], text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of label 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        weights, bias = shared.value
        out = []
        for start, end, data, offsets in chunks(column(batch, text)):
            bucket, doc = features(data, offsets)
            total = np.bincount(doc, weights[bucket].astype(np.float64), minlength=end - start)
            n = np.bincount(doc, minlength=end - start)
            out.append(1 / (1 + np.exp(-(total / np.maximum(n, 1) + bias))))
        return [pa.array(np.concatenate(out) if out else np.zeros(0))]

    return add_columns(df, make, [(out, T.DoubleType())])


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Documents that score at least the threshold; the columns stay as they were."""
    name = unused(docs, "_score")
    return score(docs, train(docs, labels), out=name).where(F.col(name) >= threshold).drop(name)
