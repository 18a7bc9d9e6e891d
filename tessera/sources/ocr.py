"""Nested OCR results (pages, blocks, paragraphs, words, symbols) as rows, and tests of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VERTICES = "boundingBox struct<vertices: array<struct<x: double, y: double>>>"
_WORD = f"struct<{_VERTICES.replace(' struct', ': struct', 1)}, symbols: array<struct<text: string>>>"
_PARAGRAPH = f"struct<words: array<{_WORD}>>"
_BLOCK = f"struct<{_VERTICES.replace(' struct', ': struct', 1)}, paragraphs: array<{_PARAGRAPH}>>"
SCHEMA = f"struct<fullTextAnnotation: struct<pages: array<struct<blocks: array<{_BLOCK}>>>>>"


def box(vertices: Column) -> Column:
    """struct<x0, y0, x1, y1> around vertices; a missing coordinate is 0."""
    at = lambda c: F.transform(vertices, lambda v: F.coalesce(v[c], F.lit(0.0)))
    return F.struct(F.array_min(at("x")).alias("x0"), F.array_min(at("y")).alias("y0"), F.array_max(at("x")).alias("x1"), F.array_max(at("y")).alias("y1"))


def blocks(rows: DataFrame, json: str = "json", key: str = "page_id") -> DataFrame:
    """(key, block, text, box) of each block, its words joined by spaces."""
    return words(rows, json, key).groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct("word", "text"))).alias("w"), F.first("block_box").alias("box")).select(key, "block", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"), "box")


def words(rows: DataFrame, json: str = "json", key: str = "page_id") -> DataFrame:
    """(key, block, word, text, box, block_box) of each word with text, in order."""
    parsed = rows.select(key, F.explode(F.from_json(json, SCHEMA)["fullTextAnnotation"]["pages"]).alias("p"))
    own = parsed.select(key, F.posexplode("p.blocks").alias("block", "b"))
    each = own.select(key, "block", F.col("b.boundingBox.vertices").alias("_bv"), F.posexplode(F.flatten(F.transform("b.paragraphs", lambda q: q["words"]))).alias("word", "w"))
    text = F.array_join(F.transform("w.symbols", lambda s: F.coalesce(s["text"], F.lit(""))), "")
    out = each.select(key, "block", "word", text.alias("text"), box(F.col("w.boundingBox.vertices")).alias("box"), box(F.col("_bv")).alias("block_box"))
    return out.where("text != ''")


def looks_like_year(cell: Column) -> Column:
    return F.coalesce(cell.rlike(r"^\s*1[89]\d\d(?:\s*[-/]\s*(?:1[89])?\d\d)?\.?\s*$"), F.lit(False))


def looks_like_volume(cell: Column) -> Column:
    return F.coalesce(cell.rlike(r"(?i)^\s*(?:vol\.?\s*)?[ivxlc]+\.?\s*$"), F.lit(False))


def looks_like_page(cell: Column) -> Column:
    return F.coalesce(cell.rlike(r"^\s*(?:pp?\.?\s*)?\d{1,4}(?:\s*-\s*\d{1,4})?\s*$"), F.lit(False))
