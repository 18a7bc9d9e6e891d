"""Text sources: whole files of any name, decoding, manifests, page indexes, CSV tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.numbering import labelled
from tessera.functions.scalar import csv_cells

#: Encodings tried in turn; the last fits any bytes.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")


def decode_lossy(raw: bytes) -> tuple[str, str]:
    """(text, encoding) by the first encoding that fits."""
    for name in ENCODINGS:
        try:
            return raw.decode(name), name
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", errors="replace"), "replace"


def decoded(raw: str | Column) -> Column:
    """struct<text, encoding> of a binary column."""

    @F.pandas_udf("struct<text string, encoding string>")
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_lossy(bytes(b)) for b in x], columns=["text", "encoding"])

    return run(raw)


def list_files(spark: SparkSession, folder: str, suffix: str = "") -> list[str]:
    """Paths of a folder's files by name, also those that start with '_' or '.', which Spark's
    own readers pass over. Any file system that Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(str(f.getPath()) for f in found if f.isFile() and f.getPath().getName().endswith(suffix))


def read_texts(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    """(text_id, path, text, encoding, file_size) of every file, ids by order of name.

    Names that Spark hides are copied in by the driver's listing; the bytes are read by the
    executors through binaryFile, or, for hidden names, through the file system's stream.
    """
    paths = list_files(spark, folder, suffix)
    hidden = [p for p in paths if p.rsplit("/", 1)[-1][:1] in "_."]
    open_ = [p for p in paths if p not in set(hidden)]
    ids = spark.createDataFrame([(f"TXT_{k:05d}", p) for k, p in enumerate(paths, 1)], "text_id string, path string")
    parts = []
    if open_:
        parts.append(spark.read.format("binaryFile").load(open_).select("path", "content"))
    if hidden:
        fs, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
        rows = []
        for p in hidden:
            path = jvm.org.apache.hadoop.fs.Path(p)
            stream = path.getFileSystem(fs).open(path)
            rows.append((p, bytearray(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
            stream.close()
        parts.append(spark.createDataFrame(rows, "path string, content binary"))
    if not parts:
        return spark.createDataFrame([], "text_id string, path string, text string, encoding string, file_size bigint")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = rows.withColumn("_key", F.regexp_replace("path", "^file:/+", "/"))
    ids = ids.withColumn("_key", F.regexp_replace("path", "^file:/+", "/")).drop("path")
    return rows.join(F.broadcast(ids), "_key").withColumn("d", decoded("content")).select("text_id", "path", F.col("d.text").alias("text"), F.col("d.encoding").alias("encoding"), F.length("content").cast("bigint").alias("file_size"))


def manifest(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Ids by order of the key, sizes and checksums of texts."""
    narrow = docs.select(key, F.length(text).cast("bigint").alias("raw_char_count"), F.size(F.split(text, "\n", -1)).cast("bigint").alias("raw_line_count"), F.sha1(text).alias("raw_text_checksum"))
    return labelled(narrow, "text_id", "TXT_%05d", key).select(key, "text_id", "raw_char_count", "raw_line_count", "raw_text_checksum")


# Fixed value: the form of a page marker.
_PAGE = re.compile(r"^## p\. ([0-9ivxlcdm]*) ?\(#(\d+)\)", re.I | re.M)


def page_index(text: str) -> list[tuple[int, str, int]]:
    """(sequence, printed page, offset) of the page markers."""
    return [(int(m[2]), m[1], m.start()) for m in _PAGE.finditer(text)]


def slice_pages(text: str, first: int, last: int) -> str:
    """The text from the marker of page `first` up to that after page `last`, by sequence."""
    index = page_index(text)
    start = next((p for s, _, p in index if s >= first), None)
    stop = next((p for s, _, p in index if s > last), len(text))
    return "" if start is None else text[start:stop]


def page_indexes(text: str | Column) -> Column:
    """page_index() of a column, as array<struct<seq, page, pos>>."""

    @F.pandas_udf("array<struct<seq int, page string, pos int>>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: [{"seq": s, "page": p, "pos": o} for s, p, o in page_index(t or "")])

    return run(text)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV table with header, quotes doubled inside quotes, and NA or N/A as null."""
    rows = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return rows.select(*[F.when(F.upper(F.trim(c)).isin("NA", "N/A"), None).otherwise(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])


def read_optional_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The table, or an empty one of the same schema if there is no such file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return read_csv(spark, path, schema)


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str | None:
    """The first path that exists on its file system."""
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return p
    return None


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(properties, geometry) of the features as JSON; empty if there is no such file."""
    schema = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
    if first_existing(spark, [path]) is None:
        return spark.createDataFrame([], "properties map<string,string>, geometry struct<type:string,coordinates:string>")
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.properties", "f.geometry")


def stopwords(lines: Iterable[str]) -> set[str]:
    """Entries of a stop-word file: each line, with '_' for spaces too, and its words of 2 to 40 letters."""
    out: set[str] = set()
    for line in lines:
        entry = line.strip().lower()
        if entry:
            out |= {entry, entry.replace(" ", "_")} | {t for t in re.findall(r"[a-z][a-z'-]*", entry) if 2 <= len(t) <= 40}
    return out


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A worksheet of a local workbook, all as text; needs pandas' Excel reader."""
    frame = pd.read_excel(path, sheet_name=sheet, dtype=str)
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None))


def read_csv_by_hand(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table of text whose rows may be shorter or longer than its header: csv_cells() of
    each line, which the executors parse; only the header comes to the driver."""
    lines = spark.read.text(path)
    first = lines.limit(1).collect()
    if not first:
        return spark.createDataFrame([], "value string")
    header = first[0].value.removeprefix("\ufeff")
    names = spark.range(1).select(csv_cells(F.lit(header), header.count(",") + 1).alias("c")).first().c
    names = [n for n in names[: next((k for k in range(len(names), 0, -1) if names[k - 1]), 1)]]
    rows = lines.where(~F.col("value").isin(first[0].value, header)).select(csv_cells("value", len(names)).alias("c"))
    return rows.select(*[F.col("c")[k].alias(n) for k, n in enumerate(names)])
