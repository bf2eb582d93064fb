"""Small helpers around ``mapInArrow``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regdata.session import share_code

PART = 4 << 20  # bytes of rows that a worker computes with at once


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns by name in any letter case: a new column of that name takes their place."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def parcel(df: DataFrame, **pulled: str) -> tuple[DataFrame, list[Column]]:
    """The given columns under inner names beside one column with all others, so that no names
    clash; and the columns that restore the table."""
    inner = {c: name for name, c in pulled.items()}
    rest = [F.col(f"`{c}`") for c in df.columns if c not in inner] or [F.lit(0).alias("_none")]
    packed = df.select(*[F.col(f"`{c}`").alias(name) for c, name in inner.items()], F.struct(*rest).alias("_row"))
    return packed, [F.col(inner[c]).alias(c) if c in inner else F.col("_row").getField(c).alias(c) for c in df.columns]


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def add_columns(df: DataFrame, make: Callable[[pa.RecordBatch], list[pa.Array]], fields: list[tuple[str, T.DataType]]) -> DataFrame:
    """Append columns that ``make`` computes, row by row, from batches cut into parts of about ``PART`` bytes."""
    share_code(df.sparkSession)
    df = without(df, *[n for n, _ in fields])
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in fields]])
    names = [n for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in parts(batch, PART):
                yield pa.RecordBatch.from_arrays([*rows.columns, *make(rows)], [*rows.schema.names, *names])
            pa.default_memory_pool().release_unused()  # a waiting worker would keep it

    return df.mapInArrow(run, schema)


def parts(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``size`` bytes on average, at least one row each."""
    rows = max(1, batch.num_rows * size // max(1, batch.nbytes))
    yield from (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def learned(rows: DataFrame, order: list[str], fit: Callable[[pa.RecordBatch], bytes]) -> bytes | None:
    """What ``fit`` makes of a bounded table, sorted, in one task; None of an empty one.

    The driver gets the result alone, not the rows.
    """
    share_code(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]
        if whole:
            batch = pa.Table.from_batches(whole).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([pa.array([fit(batch)], pa.binary())], ["_model"])

    found = rows.repartition(1).sortWithinPartitions(*order).mapInArrow(run, "_model binary").first()
    return bytes(found[0]) if found else None


def list_array(values: np.ndarray, counts) -> pa.Array:
    """A list column from the values of all rows and the number of values of each."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_of(value: pa.Scalar) -> str:
    """The text of a cell; null is empty."""
    return value.as_py() or ""


def lists(values: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without nulls inside lists; a null list is empty."""
    offsets = np.asarray(values.offsets)
    if values.null_count:  # what a null covers is skipped
        return np.asarray(values.flatten()), np.concatenate([[0], np.cumsum(np.asarray(values.value_lengths().fill_null(0)))])
    return np.asarray(values.flatten()), offsets - offsets[0]
