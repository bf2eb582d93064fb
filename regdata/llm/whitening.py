"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Vectors become whole numbers first, x = floor(1024 * c) + 100000, so that their sums, and with
them the centre, are exact. Rows are centred once and written as packed blocks. The
bidiagonalisation then alternates u = Xv and w = Xᵀu over the blocks. A left vector is never stored: it
is a combination of rows' products with few right vectors, u = Xg, so the d numbers of g tell all of
it, and any task works its own part out again. One round is

1. a pass that sums Uᵀ(Xv), what u shares with the left vectors before it, which g then gives up;
2. a pass that sums the square of u, Xᵀu, and Uᵀu again; where that is not yet zero, g gives it
   up as well and the pass is repeated.

Right vectors are kept orthogonal on the driver, which holds a few d x d matrices; tasks
send it a few d numbers each. The singular values of the small bidiagonal matrix give the
deviations, its right singular vectors the components. A round that reaches the end of an invariant
subspace goes on with a fresh vector orthogonal to all before, so that equal eigenvalues are
found as often as they occur. After d rounds the decomposition is complete; ``steps`` ends it sooner
where d is large and the leading components are enough.

Defined results: null vectors and vectors with null or non-finite entries take no part, nor do
vectors of another length than the commonest (of equally common ones the longest).
Entries beyond 2**53 after scaling count as 2**53. Repeated rows count as often as they occur. A
component without variance has null ``whitened``; without any variance ``explained`` is null. A
deviation beyond the range of a long is null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regdata.llm.arrow import add_columns, column, list_array, lists, parcel, share_code, without
from regdata.session import materialise

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = float(2**53)
HALF = 1 << 24  # sums are kept in two halves, so that no task overflows
BLOCK = 4096  # rows worked on at once
TINY = 1e-13


@dataclass
class Whitening:
    """What was learned: rows, exact sums, total variance, eigenvalues, and components as rows."""

    n: int
    sums: list[int]
    total: float
    values: np.ndarray
    components: np.ndarray
    identity_error: float | None = None


def whole(vectors: pa.ListArray, d: int) -> np.ndarray:
    """Vectors of length d as whole numbers."""
    entries, _ = lists(vectors)
    scaled = np.floor(entries.astype(np.float64).reshape(-1, d) * SCALE) + SHIFT
    return np.clip(scaled, -LARGEST, LARGEST).astype(np.int64)


def offsets_from(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly; Python integers where 64 bits are too few."""
    largest = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums)))
    if largest < 2**62:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def deviations(t: np.ndarray) -> list[int | None]:
    """Sum of the squares of each row, exactly; None beyond the range of a long."""
    if t.size and t.dtype != object and int(np.abs(t).max()) ** 2 * t.shape[1] < 2**63:
        return (t * t).sum(axis=1).tolist()
    found = (sum(int(v) * int(v) for v in row) for row in t)
    return [v if v < 2**63 else None for v in found]


def gathered(df: DataFrame, per_batch: Callable[[pa.RecordBatch], np.ndarray], kind: str = "f8") -> np.ndarray | None:
    """Sum over all batches of what ``per_batch`` gives, one partial sum per task, in the order of tasks."""
    share_code(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = per_batch(batch)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total, dtype=kind).tobytes()], pa.binary())], ["_v"])

    parts = [np.frombuffer(r[0], dtype=kind) for r in df.mapInArrow(run, "_v binary").collect()]
    return np.sum([p.astype(object) if kind == "i8" else p for p in parts], axis=0) if parts else None


def usable(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Rows whose vector takes part, and the length of vectors; 0 without any."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    good = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    found = good.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (good.where(F.size(vector) == found.d), found.d) if found else (good, 0)


def blocks(rows: DataFrame, vector: str, d: int, n: int, sums: list[int]) -> DataFrame:
    """Centred rows, packed as d doubles each, many to a row."""
    share_code(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                t = offsets_from(whole(column(batch.slice(at, BLOCK), vector), d), n, sums)
                yield pa.RecordBatch.from_arrays([pa.array([(t / n).astype(np.float64).tobytes()], pa.binary())], ["_x"])

    return rows.select(vector).mapInArrow(run, "_x binary")


def matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(v.as_buffer(), dtype=np.float64).reshape(-1, d) for v in column(batch, "_x")])


def orthogonal(v: np.ndarray, before: np.ndarray) -> np.ndarray:
    """v without its part in the span of the rows of ``before``; twice is enough."""
    for _ in range(2):
        v = v - before.T @ (before @ v)
    return v


def fresh(rng: np.random.Generator, before: np.ndarray, d: int) -> np.ndarray:
    """A random unit vector orthogonal to all rows of ``before``."""
    v = orthogonal(rng.normal(size=d), before)
    return v / np.linalg.norm(v)


def bidiagonalise(packed: DataFrame, d: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Right vectors as rows, and the upper bidiagonal matrix B with XV = UB."""
    rng = np.random.Generator(np.random.Philox(key=11))
    right = [fresh(rng, np.zeros((0, d)), d)]
    left = np.zeros((0, d))  # the g of each left vector
    alphas, betas, largest = [], [], 0.0

    def shared(g: np.ndarray, before: np.ndarray) -> np.ndarray:
        return gathered(packed, lambda b: (lambda x: (x @ before.T).T @ (x @ g))(matrix(b, d)))

    def products(g: np.ndarray, before: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def own(batch: pa.RecordBatch) -> np.ndarray:
            x = matrix(batch, d)
            u = x @ g
            return np.concatenate([[u @ u], x.T @ u, (x @ before.T).T @ u])

        found = gathered(packed, own)
        return float(np.sqrt(max(found[0], 0.0))), found[1 : d + 1], found[d + 1 :]

    while True:
        g = right[-1].copy()
        if len(left):
            g -= left.T @ shared(g, left)
        alpha, w, again = products(g, left)
        for _ in range(2):
            if not len(again) or np.abs(again).max() <= TINY * alpha:
                break
            g -= left.T @ again
            alpha, w, again = products(g, left)
        largest = max(largest, alpha)
        done = alpha <= 1e-12 * largest  # Xv lies in the span of the left vectors so far
        alphas.append(0.0 if done else alpha)
        left = np.vstack([left, np.zeros(d) if done else g / alpha])
        if len(right) == steps:
            break
        known = np.array(right)
        v = orthogonal(np.zeros(d) if done else w / alpha, known)
        beta = float(np.linalg.norm(v))
        closed = beta <= 1e-12 * largest or largest == 0
        betas.append(0.0 if closed else beta)
        right.append(fresh(rng, known, d) if closed else orthogonal(v / beta, known))
        right[-1] /= np.linalg.norm(right[-1])
    return np.array(right), np.diag(alphas) + np.diag(betas, 1)


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, steps: int | None = None) -> Whitening | None:
    """Learn the leading components of all vectors that take part; None without any."""
    rows, d = usable(df.select(vector), vector)
    if not d:
        return None

    def totals(batch: pa.RecordBatch) -> np.ndarray:
        x = whole(column(batch, vector), d)
        return np.concatenate([[len(x)], (x // HALF).sum(axis=0), (x % HALF).sum(axis=0)])

    found = [int(v) for v in gathered(rows, totals, "i8")]
    n, sums = found[0], [hi * HALF + lo for hi, lo in zip(found[1 : d + 1], found[d + 1 :])]
    packed = materialise(blocks(rows, vector, d, n, sums))
    total = float(gathered(packed, lambda b: np.array([np.square(matrix(b, d)).sum()]))[0]) / n
    v, b = bidiagonalise(packed, d, min(d, steps or d))
    _, sigma, turn = np.linalg.svd(b)
    k = min(components, len(sigma))
    found = Whitening(n, sums, total, sigma[:k] ** 2 / n, turn[:k] @ v)
    found.values[found.values <= 1e-20 * found.values.max(initial=0.0)] = 0.0
    live = np.flatnonzero(found.values > 0)
    if len(live):
        white = (found.components[live] / np.sqrt(found.values[live])[:, None]).T
        m = len(live)
        moments = gathered(packed, lambda b: (lambda z: np.concatenate([z.sum(axis=0), (z.T @ z).ravel()]))(matrix(b, d) @ white))
        mean, second = moments[:m] / n, moments[m:].reshape(m, m) / n
        found.identity_error = float(np.abs(second - np.outer(mean, mean) - np.eye(m)).max())
    return found


def whiten(df: DataFrame, model: Whitening | None, vector: str = "embedding") -> DataFrame:
    """Rows that take part, once for each component: ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    added = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows, columns = parcel(without(df, *added), _e=vector)
    rows, d = usable(rows, "_e")
    if model is None or d != len(model.sums):  # nothing to whiten
        rows, d, model = rows.limit(0), 1, Whitening(1, [0], 0.0, np.zeros(1), np.zeros((1, 1)))
    live = model.values > 0
    white = np.where(live[:, None], model.components / np.sqrt(np.where(live, model.values, 1.0))[:, None], np.nan).T

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        t = offsets_from(whole(column(batch, "_e"), d), model.n, model.sums)
        z = (t / model.n).astype(np.float64) @ white
        return [pa.array(deviations(t), pa.int64()), list_array(z.ravel(), np.full(len(t), z.shape[1]))]

    done = add_columns(rows, make, [("_deviation", T.LongType()), ("_z", T.ArrayType(T.DoubleType()))])
    number = lambda v: F.lit(None if v is None else float(v)).cast("double")
    shares = F.array(*[number(v / model.total if model.total > 0 else None) for v in model.values])
    each = done.select("*", F.posexplode("_z").alias("_k", "_w"))
    return each.select(
        *columns, (F.col("_k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("_deviation").alias("deviation"),
        F.when(~F.isnan("_w"), F.col("_w")).alias("whitened"), F.get(shares, F.col("_k")).alias("explained"),
        number(model.identity_error).alias("identity_error"),
    )
