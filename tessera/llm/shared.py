"""What the operators of this subpackage share: table access, durable intermediate
tables, Arrow helpers and hash-based sampling."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.written import discard, keep, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, opened by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_of(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Just the named columns, so that extra columns, whatever their names, can't clash."""
    return df.select(*names)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves `remainder`; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8; a null is an empty text."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def small_batches(batches: Iterable[pa.RecordBatch], column: str, most: int = 8_000_000, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of `column` and `rows` rows at the most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([x or 0 for x in _lengths(batch.column(column))], dtype=np.int64)
        group = np.maximum(np.cumsum(sizes) // most, 0) * (1 + len(sizes)) + np.arange(len(sizes)) // rows
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def _lengths(column: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.binary_length(column.cast(pa.large_binary())).to_pylist()


def like(batch: pa.RecordBatch, values: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of `schema` from `values`, or from `batch` where `values` has no such column."""
    return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) if f.name in values else batch.column(f.name).cast(f.type) for f in schema], schema=schema)
