"""Unicode compatibility forms, which Spark lacks, as Arrow functions over whole columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Marks that are written as ASCII, or not at all.
_MARKS = {0x2018: "'", 0x2019: "'", 0x201A: "'", 0x201B: "'", 0x201C: '"', 0x201D: '"', 0x201E: '"', 0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0x2014: "-", 0x2015: "-", 0x00AD: None, 0xFEFF: None, 0x0000: None}


def normalize_text(text: str) -> str:
    """Unix line ends, NFKC, ASCII quotes and dashes, no soft hyphens, marks or NULs."""
    t = text.replace("\r\n", "\n").replace("\r", "\n").translate({0xFEFF: None, 0: None})
    return unicodedata.normalize("NFKC", t).translate(_MARKS)


def match_text(text: str) -> str:
    """Lower-cased base letters and digits of any script's decomposition, single spaces."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower().replace("&", " and ")
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in bare).split())


def normalize_unicode(text: str | Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else normalize_text(t))

    return run(text)


def normalize_for_match_any(text: str | Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else match_text(t))

    return run(text)


def slices(sizes: Sequence[int], most: int) -> Iterator[slice]:
    """Slices of rows of about `most` characters each, and of one row at the least."""
    group = np.cumsum(np.asarray(sizes, np.int64) + 1) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    yield from (slice(a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def mapped(rows: DataFrame, columns: Sequence[str], run: Callable[..., list], name: str, kind: str, most: int = 1_000_000) -> DataFrame:
    """Adds run(*columns) as a column `name` in place of `columns`. An Arrow batch holds as
    many rows as the session says, whatever their length: it is worked on, and given back, in
    slices of about `most` characters, so that Python doesn't hold a batch in several forms."""
    others = [c for c in rows.columns if c not in columns]
    fields = [f for f in rows.schema.fields if f.name in others]
    schema = StructType([*fields, StructField(name, _parse_datatype_string(kind))])
    arrow = to_arrow_schema(schema)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.coalesce(pc.utf8_length(batch.column(columns[0])), pa.scalar(0, pa.int32())).to_pylist()
            for part in slices(sizes, most):
                own = batch.slice(part.start, part.stop - part.start)
                found = pa.array(run(*[own.column(c).to_pylist() for c in columns]), arrow.field(name).type)
                yield pa.RecordBatch.from_arrays([*[own.column(c).cast(arrow.field(c).type) for c in others], found], names=[*others, name])

    return rows.mapInArrow(of, schema)


def normalized_rows(rows: DataFrame, text: str, name: str) -> DataFrame:
    """`rows` with normalize_text() of the column `text` as `name` in its place."""
    return mapped(rows, [text], lambda texts: [None if t is None else normalize_text(t) for t in texts], name, "string")
