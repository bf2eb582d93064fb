"""Toxicity by a factorization machine over hashed terms.

A term is a lower-cased run of letters or one of its beginnings of 3, 4 and 5 characters; terms are hashed
to a fixed number of buckets, and a text is the set of its buckets. The score is the logistic of

    bias + sum of w_i + (sum over pairs i < j of <v_i, v_j>) / number of learned terms

so that what a term says depends on its company: an insult beside a group's name weighs more than
both apart, which one weight per term can't tell. The sum over pairs is taken as half of the square
of the sum of the vectors less the sum of their squares, in time linear in the terms.

Weights and vectors are learned by adaptive gradient steps in numpy from a bounded sample of
labelled documents, the ``sample`` smallest by a hash of their id, in one task. Steps are followed by
soft thresholds, which keep the weights of terms that tell nothing at zero; otherwise thousands of neutral
terms would drown one insult in a long text. A term of fewer than ``LEAST`` documents of the sample is not
learned; it has neither weight nor vector.

Scoring looks whole texts up in the learned buckets.

Defined results: a text without terms (null, empty) gets the score of the bias alone. Null labels are
no labels; without any labelled row every score is 0.5. Repeated labels count as often as they occur; a
document without an id is scored but never learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regdata.llm.arrow import add_columns, column, learned, list_array, lists
from regdata.llm.few import smallest
from regdata.llm.words import _LOWER, between, chunks, running

BITS = 19
STARTS = (3, 4, 5)
SAMPLE = 8000  # labelled documents that are learned from, at most
LEAST = 3  # documents of the sample that a term must be in to be learned
DIM, EPOCHS, RATE, SEED = 4, 4, 0.1, 12
THRESHOLD, VECTOR_THRESHOLD = 0.02, 1e-4  # soft thresholds of a step, before the step's own rate
SPREAD, SEEN, VECTOR_SEEN = 0.1, 1e-2, 1e-4  # of the vectors at the start; squared slopes at the start

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) of some texts, in order of text."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = _LETTER[data]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] = inside[edges]
    ends = inside[:-1] & ~inside[1:]
    edges = edges[edges > 0] - 1
    ends[edges] = inside[edges]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    text = np.searchsorted(offsets, start, side="right") - 1
    sums = running(_LOWER[data])
    heads = np.concatenate([np.flatnonzero((data & 0xC0) != 0x80), [len(data)]])  # first bytes of characters
    at, after = np.searchsorted(heads, start), np.searchsorted(heads, end)
    shift, found = np.uint64(64 - BITS), []
    for n, to in [(0, end), *[(n, heads[np.minimum(at + n, len(heads) - 1)]) for n in STARTS]]:
        use = slice(None) if n == 0 else at + n <= after
        bucket = (between(sums, start[use], to[use]) * np.uint64(2 * n + 1)) >> shift
        found.append(text[use].astype(np.int64) << BITS | bucket.astype(np.int64))
    return np.divmod(np.unique(np.concatenate(found)), 1 << BITS)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def with_terms(df: DataFrame, text: str) -> DataFrame:
    """Add the distinct buckets of a text."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        buckets, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for start, end, data, offsets in chunks(column(batch, text)):
            doc, bucket = terms(data, offsets)
            buckets.append(bucket.astype(np.int32))
            counts.append(np.bincount(doc, minlength=end - start))
        return [list_array(np.concatenate(buckets), np.concatenate(counts))]

    return add_columns(df, make, [("_terms", T.ArrayType(T.IntegerType()))])


def shrunk(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by, 0)


def descend(labels: np.ndarray, values: np.ndarray, offsets: np.ndarray, dim: int = DIM, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Learn from documents with the buckets ``values[offsets[k]:offsets[k + 1]]``; give the learned buckets, their weights and vectors, and the bias."""
    rng = np.random.Generator(np.random.Philox(key=SEED))
    used, within = np.unique(values, return_inverse=True)
    common = np.bincount(within, minlength=len(used)) >= LEAST
    kept = np.concatenate([[0], np.cumsum(common[within])])
    within, offsets, used = (np.cumsum(common) - 1)[within[common[within]]], kept[offsets], used[common]
    weights, seen = np.zeros(len(used)), np.full(len(used), SEEN)
    vectors, paths = rng.normal(scale=SPREAD, size=(len(used), dim)), np.full((len(used), dim), VECTOR_SEEN)
    share = np.clip(labels.mean(), 0.01, 0.99) if len(labels) else 0.5
    bias, bias_seen = float(np.log(share / (1 - share))), 1.0
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            at = within[offsets[i] : offsets[i + 1]]
            w, v = weights[at], vectors[at]
            total = v.sum(axis=0)
            z = bias + w.sum() + (total @ total - np.square(v).sum()) / (2 * max(1, len(at)))
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]
            bias_seen += error * error
            bias -= RATE * error / np.sqrt(bias_seen)
            seen[at] += error * error
            step = RATE / np.sqrt(seen[at])
            weights[at] = shrunk(w - step * error, step * THRESHOLD)
            slope = error * (total - v) / max(1, len(at))
            paths[at] += slope * slope
            step = RATE / np.sqrt(paths[at])
            vectors[at] = shrunk(v - step * slope, step * VECTOR_THRESHOLD)
    return used, weights, vectors, bias


def packed(used: np.ndarray, weights: np.ndarray, vectors: np.ndarray, bias: float) -> bytes:
    """The bias, then bucket, weight and vector of every learned term."""
    return np.float32(bias).tobytes() + np.column_stack([used, weights, vectors]).astype(np.float32).tobytes()


def unpacked(model: bytes, dim: int = DIM) -> tuple[np.ndarray, float]:
    """For every bucket 1 if it was learned, its weight, its vector; and the bias."""
    numbers = np.frombuffer(model, dtype=np.float32)
    table = numbers[1:].reshape(-1, dim + 2)
    known = np.zeros((1 << BITS, dim + 2), np.float32)
    known[table[:, 0].astype(np.int64)] = np.column_stack([np.ones(len(table), np.float32), table[:, 1:]])
    return known, float(numbers[0])


def logits(doc: np.ndarray, bucket: np.ndarray, n: int, known: np.ndarray, bias: float) -> np.ndarray:
    """Scores of n texts before the logistic."""
    rows = known[bucket].astype(np.float64)
    held, weight, *sums = [np.bincount(doc, rows[:, k], minlength=n) for k in range(rows.shape[1])]
    squares = np.bincount(doc, np.square(rows[:, 2:]).sum(axis=1), minlength=n)
    pairs = sum((np.square(s) for s in sums), -squares)
    return bias + weight + pairs / (2 * np.maximum(held, 1))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> bytes | None:
    """Learn ``label`` from labelled documents that are not held out; None without any."""
    order = F.xxhash64(key)
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
    picked = smallest(known.select(order.alias("_order"), key, F.col(label).cast("int").alias("_label")), "_order", [key, "_label"], sample)
    rows = docs.select(key, F.col(text).alias("_t")).join(F.broadcast(picked), key)  # at most ``sample`` rows are broadcast

    def fit(batch: pa.RecordBatch) -> bytes:
        values, offsets = lists(column(batch, "_terms"))
        return packed(*descend(np.asarray(column(batch, "_label")).astype(np.float64), values, offsets))

    return learned(with_terms(rows, "_t").select("_order", "_label", "_terms"), ["_order", "_label"], fit)


def score(df: DataFrame, model: bytes | None, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of label 1."""
    shared = df.sparkSession.sparkContext.broadcast(model or np.float32(0).tobytes())
    ready: list[tuple[np.ndarray, float]] = []

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        if not ready:
            ready.append(unpacked(shared.value))
        found = [np.zeros(0)]
        for start, end, data, offsets in chunks(column(batch, text)):
            found.append(1 / (1 + np.exp(-np.clip(logits(*terms(data, offsets), end - start, *ready[0]), -30, 30))))
        return [pa.array(np.concatenate(found))]

    return add_columns(df, make, [(out, T.DoubleType())])
