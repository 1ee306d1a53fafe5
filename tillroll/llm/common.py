"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from tillroll.session import shared_dir

# A-Z to a-z, all other bytes unchanged.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
# A-Z to a-z; ASCII that is neither a letter nor a digit to a space.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in LOWER)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def is_fold(doc_id: Column, n: int, k: int) -> Column:
    """True where ``fold`` is k; false for a null id."""
    return F.coalesce(fold(doc_id, n) == k, F.lit(False))


def give_back(batches):
    """``batches``; Arrow's memory that is free by then goes back to the system.
    Worker processes are used again, and the memory that one task needed would
    else stand beside what a later stage needs."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()


def with_columns(df: DataFrame, inputs: list[str], ddl: str, fn: Callable[..., dict]) -> DataFrame:
    """``df`` with columns computed per Arrow batch: ``fn(*lists of inputs)``
    returns {column: list}.  Other columns pass through unchanged; a column of
    ``df`` named like a new one is replaced."""
    added = StructType.fromDDL(ddl)
    df = df.drop(*added.names)
    out = StructType(df.schema.fields + added.fields)
    kept = df.columns
    schema = to_arrow_schema(out)

    def run(batches):
        for b in batches:
            got = fn(*(b.column(c).to_pylist() for c in inputs))
            cols = [b.column(c) for c in kept]
            cols += [pa.array(got[f.name], type=to_arrow_type(f.dataType)) for f in added]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], names=schema.names)

    return df.mapInArrow(lambda batches: give_back(run(batches)), out)


def map_rows(df: DataFrame, ddl: str, fn: Callable) -> DataFrame:
    """``fn(iterator of batches)`` yields {column: list}; all columns are new."""
    out = StructType.fromDDL(ddl)
    schema = to_arrow_schema(out)

    def run(batches):
        for got in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in schema], schema=schema)

    return df.mapInArrow(lambda batches: give_back(run(batches)), out)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
