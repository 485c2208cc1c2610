"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most bytes of text that a Python worker takes apart at once.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Return free memory to the system at a task's end: workers are used again, and what they keep adds up in an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], name: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text column of each piece holds about ``most`` bytes; a longer text stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(batch.schema.get_field_index(name))
        sizes = np.array([x or 0 for x in pa.compute.binary_length(column).to_pylist()], dtype=np.int64)
        turn = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    give_back()


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[list[np.ndarray]]:
    """The columns of batches sorted by the first one, cut where it changes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        g = whole.column(0).to_numpy()
        cut = int(np.searchsorted(g, g[-1]))
        if cut:
            yield [c.to_numpy() for c in whole.slice(0, cut).columns]
        held, size = [whole.slice(cut)], whole.num_rows - cut
        rows = max(rows, 2 * size)  # a large group is put together again only when it has doubled
    if held:
        yield [c.to_numpy() for c in pa.Table.from_batches(held).combine_chunks().to_batches()[0].columns]


def offsets(lengths: list[int]) -> np.ndarray:
    """Start of each run, and the end of the last."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(np.asarray(lengths, dtype=np.int64), out=out[1:])
    return out


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't use yet."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def append(batch: pa.RecordBatch, fields: list[pa.Field], arrays: list[pa.Array]) -> pa.RecordBatch:
    """The batch with more columns."""
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays], schema=pa.schema([*batch.schema, *fields]))


def with_fields(schema: T.StructType, *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in more)])


#: Words of 64 bits in a screen: what is broadcast doesn't grow with the data.
SCREEN_WORDS = 1 << 18


def screened(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> tuple[DataFrame, str]:
    """rows with a boolean column, and its name: false where the key (a long, a hash) is surely not among the wanted ones.

    A bitmap of fixed size holds a bit for each wanted key. Only rows that may be wanted need the exact join after it, so most
    rows aren't shuffled while the wanted ones are few next to its 16 million bits; beyond that all are, with the same result."""
    bit = lambda k: F.expr(f"shiftleft(1L, int(shiftrightunsigned(`{k}`, 40) & 63))")
    word = lambda k: F.pmod(F.col(k), F.lit(SCREEN_WORDS))
    table = wanted.select(wanted_key.alias("_k")).groupBy(word("_k").alias("_at")).agg(F.bit_or(bit("_k")).alias("_word"))
    k, name = free_name(rows, "_key"), free_name(rows, "_may")
    met = rows.withColumn(k, key).alias("_r").join(F.broadcast(table), word(k) == F.col("_at"), "left")
    return met.select("_r.*", F.coalesce(F.col("_word").bitwiseAND(bit(k)) != 0, F.lit(False)).alias(name)).drop(k), name
