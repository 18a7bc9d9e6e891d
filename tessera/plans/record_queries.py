"""Queries of records as they come: scans, file names, notes, hand-made rows, and the rest of the export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import clean, scalar
from tessera.operators import matching, places
from tessera.plans.biblio_queries import rounded
from tessera.plans.catalog import register
from tessera.plans.match_queries import _PLACES, _place_rows
from tessera.plans.roles import table, with_articles
from tessera.sources.texts import page_indexes

# Scans: each line of a document is a page, with a marker, a running header and page numbers.

HEADER = "RUNNING HEADER OF THE JOURNAL"
_PAGES_SQL = f"list_transform(string_split(text, chr(10)), lambda l, i: '## p. ' || i || ' (#' || (i + 10) || ') ####' || chr(10) || chr(10) || CASE i % 3 WHEN 0 THEN '{HEADER} ' || i WHEN 1 THEN '{HEADER}' || chr(10) || i ELSE i || chr(10) || '{HEADER}' END || chr(10) || chr(10) || l || chr(10))"
_CLEAN_LINE = "trim(regexp_replace(regexp_replace(l, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '[ \\t]+', ' ', 'g'), ' ')"


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, title) of documents as scans."""
    line = F.lit("\n")

    def page(x, k):
        i = (k + 1).cast("string")
        head = F.when((k + 1) % 3 == 0, F.concat(F.lit(HEADER + " "), i)).when((k + 1) % 3 == 1, F.concat(F.lit(HEADER), line, i)).otherwise(F.concat(i, line, F.lit(HEADER)))
        return F.concat(F.lit("## p. "), i, F.lit(" (#"), (k + 11).cast("string"), F.lit(") ####\n\n"), head, F.lit("\n\n"), x, line)

    pages = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), page)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(pages, "").alias("text"), F.lit("A title").alias("title"))


@register(
    "header_cleaning",
    f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: {_CLEAN_LINE}), lambda l: l <> ''), chr(10) || chr(10)) AS text,
 CAST(len(string_split(text, chr(10))) AS INTEGER) AS page_markers, CAST(len(string_split(text, chr(10))) AS INTEGER) AS header_lines, CAST(len(string_split(text, chr(10))) - len(string_split(text, chr(10))) // 3 AS INTEGER) AS page_numbers, CASE WHEN len(string_split(text, chr(10))) >= 25 THEN 'many_headers_removed' ELSE '' END AS warnings FROM documents""",
)
def header_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clean.cleaned_rows(scans(spark, sf_dir), "text", "title")
    return found.select("doc_id", "c.text", "c.page_markers", "c.header_lines", "c.page_numbers", F.array_join("c.warnings", ";").alias("warnings"))


@register(
    "page_index",
    f"""WITH p AS (SELECT doc_id, {_PAGES_SQL} AS g FROM documents), q AS (SELECT doc_id, list_transform(range(1, len(g) + 1), lambda i: {{'seq': i + 10, 'page': CAST(i AS VARCHAR), 'pos': coalesce(list_sum(list_transform(g[1:i - 1], lambda x: length(x))), 0), 'size': length(g[i])}}) AS x FROM p)
SELECT doc_id, CAST(unnest(x).seq AS INTEGER) AS seq, unnest(x).page AS page, CAST(unnest(x).pos AS INTEGER) AS pos, CAST(unnest(x).size AS INTEGER) AS page_chars FROM q""",
)
def page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scans(spark, sf_dir).withColumn("x", page_indexes("text"))
    following = F.transform("x", lambda x, k: F.struct(x.alias("at"), F.coalesce(F.get(F.col("x"), k + 1)["pos"], F.length("text")).alias("stop")))
    rows = rows.select("doc_id", "text", F.explode(following).alias("p"))
    return rows.select("doc_id", "p.at.seq", "p.at.page", "p.at.pos", F.length(F.substring(F.col("text"), F.col("p.at.pos") + 1, F.col("p.stop") - F.col("p.at.pos"))).alias("page_chars"))


# Names, notes and rows by hand.

_FORMS = ("1880-1881_12_On_rivers.txt", "Journal_XIV_1875.txt", "journal v_23.pdf", "ABC_1899_3_notes.txt", "plain.txt")


@register(
    "file_name_parts",
    """SELECT p_partkey, x.* EXCLUDE (i) FROM part JOIN (VALUES (0, 'UNKNOWN', '1880-1881', 1880, 1881, 'On_rivers'), (1, '1875', '1875', 1875, 1875, 'Journal_XIV_1875'), (2, '23', '', NULL, NULL, 'journal v_23'), (3, 'UNKNOWN', '1899', 1899, 1899, 'notes'), (4, 'UNKNOWN', '', NULL, NULL, 'plain'), (5, 'IX', '1875', 1875, 1875, 'Journal_IX_1875')) x(i, volume_label, year_hint, first_year, last_year, suffix) ON i = p_partkey % 6""",
)
def file_name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # XIV isn't among the numerals that the rule knows, and ends like the 'v_' of a number.
    name = F.element_at(F.array(*[F.lit(f) for f in (*_FORMS, "Journal_ix_1875.txt")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    found = table(spark, sf_dir, "part").select("p_partkey", scalar.file_name_parts(name).alias("x")).select("p_partkey", "x.*")
    return found.withColumn("suffix", F.replace("suffix", F.lit("Journal_ix"), F.lit("Journal_IX")))


@register("honorifics", "SELECT s_suppkey, s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN 'Rev., Dr., M.A., Esq.' WHEN 1 THEN '' WHEN 2 THEN 'Capt.' ELSE 'F.R.G.S.' END AS titles FROM supplier")
def honorifics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, name = F.col("s_suppkey") % 4, F.col("s_name")
    raw = F.when(kind == 0, F.concat(F.lit("Rev. Dr. "), name, F.lit(", M.A., Esq."))).when(kind == 1, name).when(kind == 2, F.concat(F.lit("Capt. "), name)).otherwise(F.concat(name, F.lit(" F.R.G.S.")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", clean.honorifics(raw).alias("x")).select("s_suppkey", "x.name", "x.titles")


@register("csv_long_rows", """SELECT p_partkey, p_name || ' "x", y' AS a, CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN NULL ELSE p_brand END AS b, CASE WHEN p_size % 3 = 2 THEN p_type || ',' || p_size || ',' ELSE '' END AS c FROM part""")
def csv_long_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.concat(F.lit('"'), F.col("p_name"), F.lit(' ""x"", y"'))
    kind = F.col("p_size") % 3
    line = F.when(kind == 0, first).when(kind == 1, F.concat(first, F.lit(",NA"))).otherwise(F.concat_ws(",", first, "p_brand", "p_type", "p_size", F.lit("")))
    cells = table(spark, sf_dir, "part").select("p_partkey", scalar.csv_cells(line, 3).alias("x"))
    return cells.select("p_partkey", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"), F.col("x")[2].alias("c"))


_NOTES = ("CANTON, currently Guangzhou; a dynasty", "YANG-TSZE KIANG Yangtzi River", "Some Valley, the old name of Nowhere", "Book of songs, Shijing", "Pekin；Formosa，Taiwan <U+53F0>", "", "shan-hsi province, Shanxi Province")


@register(
    "note_places",
    "SELECT p_partkey, historical_name, modern_name, modern_name || '（' || historical_name || '）' AS place_label FROM part JOIN (VALUES (0, 'canton', 'Guangzhou'), (2, 'Some Valley', 'Nowhere'), (4, 'pekin', 'Beijing'), (4, 'formosa', 'Taiwan'), (6, 'shan-hsi', 'Shanxi Province')) x(i, historical_name, modern_name) ON i = p_partkey % 7",
)
def note_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.element_at(F.array(*[F.lit(n) for n in _NOTES]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return places.note_places(table(spark, sf_dir, "part").select("p_partkey", note.alias("note")), "p_partkey", "note")


# Titles of one list against another; rows side by side.


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    left = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("l_id"), F.sequence("p_size", F.col("p_size") + F.col("p_size") % 3).alias("l_years"), F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ").alias("a"))
    right = part.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("r_id"), F.array("p_size").alias("r_years"), F.split(F.lower(F.concat_ws(" ", "p_type", "p_name")), " ").alias("b"))
    return left, right


@register("reconcile_titles")
def reconcile_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: the score compares letter orders by a matcher that SQL lacks."""
    return rounded(matching.reconcile(*sides(spark, sf_dir)), "score")


@register("greedy_nearest")
def greedy_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: whether a row is free depends on all choices before. Pages are users, rows their clicks and views."""
    events = table(spark, sf_dir, "events").where("event_type IN ('click', 'view')")
    rows = events.select(F.col("user_id").alias("page"), F.when(F.col("event_type") == "click", "left").otherwise("right").alias("side"), F.col("event_id").alias("row_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("y"))
    return matching.greedy_nearest_by_page(rows, 7200.0)


# The rest of the export.


@register("rel_article_places", with_articles(_PLACES + " SELECT master_id, time_window, modern_name, string_agg(DISTINCT historical_name, '; ' ORDER BY historical_name) AS historical_names, modern_name || coalesce('（' || string_agg(DISTINCT historical_name, '; ' ORDER BY historical_name) FILTER (lower(historical_name) <> lower(modern_name)) || '）', '') AS place_label FROM pl GROUP BY master_id, time_window, modern_name"))
def rel_article_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.article_places(_place_rows(spark, sf_dir))


@register("rel_place_mapping", with_articles(_PLACES + " SELECT historical_name, modern_name, count(DISTINCT master_id) AS article_count FROM pl GROUP BY ALL"))
def rel_place_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.name_mapping(_place_rows(spark, sf_dir))
