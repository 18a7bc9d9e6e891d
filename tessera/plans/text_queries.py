"""Text queries: documents as articles, their source as decade, their language as subject."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.functions import words as W
from tessera.operators import text
from tessera.operators.biblio import known_subjects
from tessera.plans.biblio_queries import expanded_articles, rounded
from tessera.plans.catalog import register
from tessera.sources.written import keep
from tessera.plans.roles import articles, subjects, table, titles, windowed_items, with_articles, with_expanded


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


TOKENS_SQL = f"""list_filter(list_transform(regexp_extract_all(lower(text), '[a-z][a-z''-]{{2,}}'), lambda x: trim(x, '-''')),
  lambda x: length(x) >= 3 AND length(translate(x, '-''', '')) >= 3 AND NOT list_contains({_list(W.MODEL + W.DOMAIN)}, x))"""
TOK = f"tok AS MATERIALIZED (SELECT doc_id, lang, source, {TOKENS_SQL} AS tokens FROM documents)"
GRAMS = """gram AS MATERIALIZED (SELECT doc_id, lang, source, list_concat(tokens, list_concat(
  list_transform(list_zip(tokens, tokens[2:], true), lambda p: p[1] || '_' || p[2]),
  list_transform(list_zip(tokens, tokens[2:], tokens[3:], true), lambda p: p[1] || '_' || p[2] || '_' || p[3]))) AS tokens FROM tok)"""


def vocab_sql(source: str, cap: int = 12000) -> str:
    return f"""allrow AS MATERIALIZED (SELECT doc_id, lang, source, unnest(tokens) AS term FROM {source}),
vocab AS MATERIALIZED (SELECT *, ok AND row_number() OVER (PARTITION BY ok ORDER BY raw_count DESC, document_count DESC, term) <= {cap} AS kept_by_df_filter FROM (
  SELECT term, count(*) AS raw_count, count(DISTINCT doc_id) AS document_count, count(DISTINCT doc_id) / (SELECT count(*) FROM documents) AS document_frequency,
    count(DISTINCT doc_id) BETWEEN 5 AND greatest(floor(0.6 * (SELECT count(*) FROM documents)), 5) AS ok FROM allrow GROUP BY term)),
dt AS MATERIALIZED (SELECT *, sum(tf) OVER (PARTITION BY doc_id) AS doc_len FROM (SELECT doc_id, lang, source, term, count(*) AS tf FROM allrow WHERE term IN (SELECT term FROM vocab WHERE kept_by_df_filter) GROUP BY ALL))"""


IDF = "ln((1 + n) / (1 + document_count)) + 1"


def tokenized(spark: SparkSession, sf_dir: str, high: int = 1) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", text.model_tokens(F.col("text")).alias("tokens"))
    return docs if high == 1 else docs.withColumn("tokens", text.ngrams(F.col("tokens"), 1, high))


@register("model_tokens", f"WITH {TOK} SELECT doc_id, len(tokens) AS n, array_to_string(tokens, ' ') AS tokens FROM tok")
def model_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(spark, sf_dir).select("doc_id", F.size("tokens").cast("bigint").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@register("ngrams_1_3", f"WITH {TOK}, {GRAMS} SELECT doc_id, len(tokens) AS n, sha1(array_to_string(tokens, ' ')) AS terms FROM gram")
def ngrams_1_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(spark, sf_dir, 3).select("doc_id", F.size("tokens").cast("bigint").alias("n"), F.sha1(F.array_join("tokens", " ")).alias("terms"))


@register("stopword_filter", f"WITH {TOK} SELECT doc_id, array_to_string(list_filter(tokens, lambda x: NOT list_contains(['than', 'with', 'from', 'pour', 'dans', 'nicht'], x)), ' ') AS tokens FROM tok")
def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Extra words of this query.
    extra = ("than", "with", "from", "pour", "dans", "nicht")
    return tokenized(spark, sf_dir).select("doc_id", F.array_join(text.without(F.col("tokens"), extra), " ").alias("tokens"))


@register("df_vocabulary", f"WITH {TOK}, {vocab_sql('tok')} SELECT term, raw_count, document_count, round(document_frequency, 6) AS document_frequency, kept_by_df_filter FROM vocab")
def df_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(text.vocabulary(tokenized(spark, sf_dir)), "document_frequency")


@register(
    "model_documents",
    f"""WITH {TOK}, {vocab_sql('tok')}, k AS (SELECT t.doc_id, list_filter(t.tokens, lambda x: list_contains(v.l, x)) AS m, t.tokens FROM tok t, (SELECT list(term) AS l FROM vocab WHERE kept_by_df_filter) v)
SELECT doc_id, array_to_string(m, ' ') AS model_text, len(tokens) AS token_count_before_df, len(m) AS token_count_after_df, CASE WHEN len(m) < 20 THEN 'short_after_stopwords_lt_20' ELSE '' END AS exclusion_reason FROM k""",
)
def model_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokenized(spark, sf_dir)
    return text.model_documents(docs, text.kept_terms(text.term_rows(docs), docs))


_OVERALL = "SELECT term, s * (" + IDF + ") AS tfidf_score, raw_count, document_count, document_count / n AS document_frequency FROM (SELECT term, sum(tf / doc_len) AS s, CAST(sum(tf) AS BIGINT) AS raw_count, count(*) AS document_count FROM dt {where} GROUP BY term), (SELECT count(DISTINCT doc_id) AS n FROM dt)"
_TOP = "SELECT term, round(tfidf_score, 6) AS tfidf_score, raw_count, document_count, round(document_frequency, 6) AS document_frequency, CAST(row_number() OVER (ORDER BY round(tfidf_score, 9) DESC, term) AS INTEGER) AS rank FROM ({inner}) QUALIFY rank <= 100"


@register("tfidf_overall", f"WITH {TOK}, {vocab_sql('tok')} " + _TOP.format(inner=_OVERALL.format(where="")))
def tfidf_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(text.tfidf_overall(tokenized(spark, sf_dir)), "tfidf_score", "document_frequency")


@register("tfidf_phrases", f"WITH {TOK}, {GRAMS}, {vocab_sql('gram')} " + _TOP.format(inner=_OVERALL.format(where="WHERE contains(term, '_')")))
def tfidf_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(text.tfidf_overall(tokenized(spark, sf_dir, 3), phrases_only=True), "tfidf_score", "document_frequency")


@register(
    "tfidf_by_group",
    f"""WITH {TOK}, {vocab_sql('tok')}, g AS (SELECT lang, term, sum(tf / doc_len) AS s, CAST(sum(tf) AS BIGINT) AS raw_count, count(*) AS document_count FROM dt GROUP BY lang, term),
c AS (SELECT lang, count(DISTINCT doc_id) AS n FROM dt GROUP BY lang)
SELECT lang, term, round(sc, 6) AS tfidf_score, raw_count, document_count, round(document_count / n, 6) AS document_frequency, rank FROM (
SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY round(sc, 9) DESC, term) AS INTEGER) AS rank FROM (SELECT *, s * ({IDF}) AS sc FROM g JOIN c USING (lang))) WHERE rank <= 25""",
)
def tfidf_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(text.tfidf_by_group(tokenized(spark, sf_dir), "lang"), "tfidf_score", "document_frequency")


@register(
    "tfidf_by_decade_macro",
    f"""WITH {TOK}, {vocab_sql('tok')}, c AS (SELECT source, term, count(*) AS cnt FROM allrow GROUP BY ALL), d AS (SELECT term, count(*) AS document_count FROM c GROUP BY term)
SELECT source, term, cnt AS count, round(sc, 8) AS tfidf_score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY round(sc, 9) DESC, term) AS INTEGER) AS rank FROM (
SELECT source, term, cnt, cnt / sum(cnt) OVER (PARTITION BY source) * ({IDF}) AS sc FROM c JOIN d USING (term), (SELECT count(DISTINCT source) AS n FROM c))) WHERE rank <= 40""",
)
def tfidf_by_decade_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(text.tfidf_macro(tokenized(spark, sf_dir), "source"), "tfidf_score", digits=8)


@register(
    "tfidf_doc_vectors",
    f"""WITH {TOK}, r AS (SELECT doc_id, unnest(tokens) AS term FROM tok), t AS (SELECT *, sum(tf) OVER (PARTITION BY doc_id) AS doc_len FROM (SELECT doc_id, term, count(*) AS tf FROM r GROUP BY ALL)), d AS (SELECT term, count(*) AS document_count FROM t GROUP BY term)
SELECT doc_id, term, round(tf / doc_len * ({IDF}), 6) AS tfidf FROM t JOIN d USING (term), (SELECT count(*) AS n FROM documents)""",
)
def tfidf_doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokenized(spark, sf_dir)
    # A document's length is that of its row's tokens: no window over documents.
    rows = text.nested_counts(docs.withColumn("doc_len", F.size("tokens").cast("bigint")), "tokens", "doc_len")
    terms = keep(text.unnested(rows, "_c", "x", "doc_id", "doc_len").select("doc_id", "x.term", "x.tf", "doc_len"), "vectors")
    count = docs.agg(F.count("*").alias("n_docs"))
    df = terms.groupBy("term").agg(F.count("*").alias("document_count"))
    out = terms.join(df, "term").crossJoin(F.broadcast(count))
    return rounded(out.select("doc_id", "term", (F.col("tf") / F.col("doc_len") * text.idf(F.col("n_docs"), F.col("document_count"))).alias("tfidf")), "tfidf")


@register(
    "class_tfidf",
    f"""WITH {TOK}, {vocab_sql('tok')}, c AS (SELECT lang, term, count(*) AS cnt FROM allrow GROUP BY ALL), t AS (SELECT term, CAST(sum(cnt) AS BIGINT) AS total FROM c GROUP BY term),
m AS (SELECT avg(w) AS mean FROM (SELECT sum(cnt) AS w FROM c GROUP BY lang))
SELECT lang, term, cnt AS count, total, round(sc, 6) AS tfidf_score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY round(sc, 9) DESC, term) AS INTEGER) AS rank FROM (
SELECT lang, term, cnt, total, sqrt(cnt / sum(cnt) OVER (PARTITION BY lang)) * ln(1 + (mean - total + 0.5) / (total + 0.5)) AS sc FROM c JOIN t USING (term), m)) WHERE rank <= 10""",
)
def class_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(text.class_tfidf(tokenized(spark, sf_dir), "lang"), "tfidf_score")


# Titles.

TITLE_TOKENS = f"""list_filter(list_transform(list_filter(list_transform(regexp_extract_all(lower(title), '[a-z][a-z''-]{{1,}}'), lambda x: trim(x, '-''')),
  lambda x: length(x) >= 3 AND NOT list_contains({_list(W.TITLE)}, x)), lambda x: regexp_replace(x, '''s$', '')), lambda x: x <> '' AND NOT list_contains({_list(W.TITLE)}, x))"""
TITLES = with_articles(f", tt AS (SELECT master_id, time_window, {TITLE_TOKENS} AS tokens FROM art), term AS (SELECT master_id, time_window, unnest(tokens) AS term FROM tt)")


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expanded_articles(spark, sf_dir).select("master_id", "time_window", text.title_tokens(F.col("title")).alias("tokens"))


@register("title_terms", TITLES + "SELECT master_id, array_to_string(tokens, ' ') AS tokens FROM tt")
def title_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titled(spark, sf_dir).select("master_id", F.array_join("tokens", " ").alias("tokens"))


def _of_titles(spark: SparkSession, sf_dir: str, array: Callable[[Column], Column], name: str, distinct: bool = False) -> DataFrame:
    """(item, name, times): how often the titles of an item, each once if distinct, hold each element."""
    rows = titles(spark, sf_dir)
    return text.unnested(rows.distinct() if distinct else rows, array(F.col("title")), name, "item").groupBy("item", name).agg(F.count("*").alias("times"))


def _window_counts(spark: SparkSession, sf_dir: str, array: Callable[[Column], Column], name: str) -> DataFrame:
    """(time_window, name, n, article_count). Articles are counted by item before titles are taken apart: an item's articles all hold its terms."""
    groups = windowed_items(spark, sf_dir).groupBy("time_window", "item").agg(F.count("*").alias("rows"), F.countDistinct("master_id").alias("articles"))
    return text.grouped_counts(groups, _of_titles(spark, sf_dir, array, name), name, "time_window")


def _term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window_counts(spark, sf_dir, text.title_tokens, "term")


@register("title_term_time", TITLES + "SELECT time_window, term, count(*) AS n, count(DISTINCT master_id) AS article_count FROM term GROUP BY ALL")
def title_term_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term_counts(spark, sf_dir)


@register(
    "title_bigram_time",
    TITLES + ", b AS (SELECT master_id, time_window, unnest(list_transform(range(1, greatest(len(tokens) - 1, 0) + 1), lambda i: CASE WHEN tokens[i] <> tokens[i + 1] THEN tokens[i] || ' ' || tokens[i + 1] END)) AS bigram FROM tt) SELECT time_window, bigram, count(*) AS n, count(DISTINCT master_id) AS article_count FROM b WHERE bigram IS NOT NULL GROUP BY ALL",
)
def title_bigram_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window_counts(spark, sf_dir, lambda t: text.bigrams(text.title_tokens(t)), "bigram")


@register(
    "title_tfidf_time",
    TITLES + ", c AS (SELECT time_window, term, count(*) AS n FROM term GROUP BY ALL), d AS (SELECT term, count(DISTINCT time_window) AS df FROM c GROUP BY term) SELECT time_window, term, n, df, round(ln((1 + w) / (1 + df)) + 1, 6) AS idf, round(n * (ln((1 + w) / (1 + df)) + 1), 6) AS tfidf FROM c JOIN d USING (term), (SELECT count(DISTINCT time_window) AS w FROM c)",
)
def title_tfidf_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(text.count_tfidf(_term_counts(spark, sf_dir).drop("article_count"), "term", "time_window", "n"), "idf", "tfidf")


TERM_SUBJECT = with_expanded(f", tt AS (SELECT DISTINCT master_id, time_window, title FROM known), term AS (SELECT master_id, time_window, unnest({TITLE_TOKENS}) AS term FROM tt)")


def _term_subjects(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    """(by..., term, n, article_count) by window or subject_l1. An article, its window and a
    subject count once; they are counted by item before titles are taken apart."""
    own = known_subjects(subjects(spark, sf_dir)).select("master_id", "subject_l1").distinct()
    rows = windowed_items(spark, sf_dir).join(own, "master_id").groupBy("master_id", "time_window", "subject_l1", "item").agg(F.lit(1).alias("_one"))
    groups = rows.groupBy(*by, "item").agg(F.count("*").alias("rows"), F.count("*").alias("articles"))
    return text.grouped_counts(groups, _of_titles(spark, sf_dir, text.title_tokens, "term", True), "term", *by)


@register("term_subject_join", TERM_SUBJECT + "SELECT t.term, k.subject_l1, count(*) AS n FROM term t JOIN (SELECT DISTINCT master_id, time_window, subject_l1 FROM known) k USING (master_id, time_window) GROUP BY ALL")
def term_subject_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term_subjects(spark, sf_dir, "subject_l1").select("term", "subject_l1", "n")


@register(
    "title_term_subject_time",
    TERM_SUBJECT
    + """, c AS (SELECT time_window, subject_l1, term, count(*) AS n, count(DISTINCT master_id) AS article_count FROM term JOIN (SELECT DISTINCT master_id, time_window, subject_l1 FROM known) k USING (master_id, time_window) GROUP BY ALL),
d AS (SELECT term, count(DISTINCT time_window) AS df FROM c GROUP BY term)
SELECT time_window, subject_l1, term, n, article_count, df, round(ln((1 + w) / (1 + df)) + 1, 6) AS idf, round(n * (ln((1 + w) / (1 + df)) + 1), 6) AS tfidf FROM c JOIN d USING (term), (SELECT count(DISTINCT time_window) AS w FROM c)""",
)
def title_term_subject_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _term_subjects(spark, sf_dir, "time_window", "subject_l1")
    return rounded(text.count_tfidf(counts, "term", "time_window", "n"), "idf", "tfidf")


# Chunks, units, duplicates.

WORDS_SQL = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')"


@register(
    "chunk_documents",
    f"""WITH w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents), s AS (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 400 THEN [0] ELSE list_filter(range(0, len(w), 350), lambda i: len(w) - i >= 100) END) AS a0 FROM w)
SELECT doc_id, CAST(a0 // 350 AS INTEGER) AS chunk_index, array_to_string(w[a0 + 1:a0 + 400], ' ') AS chunk_text, CAST(len(w[a0 + 1:a0 + 400]) AS INTEGER) AS chunk_word_count FROM s""",
)
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.chunk_documents(table(spark, sf_dir, "documents"))


@register("paragraph_records", "WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS paragraph, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) SELECT doc_id, CAST(i AS INTEGER) AS paragraph_index, paragraph, CAST(n AS INTEGER) AS word_count FROM (SELECT *, len(" + WORDS_SQL.replace("text", "paragraph") + ") AS n FROM p) WHERE n >= 60")
def paragraph_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.paragraph_records(table(spark, sf_dir, "documents"))


#: Matches h of a pattern and what lies between them, w, with their places, as SQL.
_PLACED = "list_transform(range(1, len(h) + 1), lambda i: {'t': h[i], 'a': list_sum(list_transform(w[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0)})"
_LINE, _SENTENCE = "[^ \\t\\n\\x0B\\f\\r](?:[^\\n]*[^ \\t\\n\\x0B\\f\\r])?", "[^.!?]+(?:[.!?]+[\"'')\\]]*)?"


@register(
    "text_units",
    f"""WITH d AS (SELECT doc_id, lang, regexp_split_to_array(text, '{_LINE}') AS w, regexp_extract_all(text, '{_LINE}') AS h FROM documents), p AS (SELECT doc_id, lang, {_PLACED} AS x FROM d),
q AS (SELECT doc_id, lang, generate_subscripts(x, 1) AS p, unnest(x).t AS t, unnest(x).a AS a FROM p),
s0 AS (SELECT doc_id, p, a, regexp_split_to_array(t, '{_SENTENCE}') AS w, regexp_extract_all(t, '{_SENTENCE}') AS h FROM q WHERE lang IN ('en', 'fr', 'de')), s AS (SELECT doc_id, p, a, list_filter({_PLACED}, lambda s: trim(s.t, ' ') <> '') AS l FROM s0),
u AS (SELECT doc_id, 'paragraph' AS unit_type, p, NULL AS k, t AS unit_text, a, a + length(t) AS b FROM q UNION ALL SELECT doc_id, 'sentence', p, generate_subscripts(l, 1), trim(unnest(l).t, ' '), a + unnest(l).a, a + unnest(l).a + length(unnest(l).t) FROM s)
SELECT doc_id, printf('%d_P%04d', doc_id, p) || CASE WHEN k IS NULL THEN '' ELSE printf('_S%04d', k) END AS unit_id, unit_type, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p, k NULLS FIRST) AS INTEGER) AS unit_order, CAST(p AS INTEGER) AS paragraph_id, CAST(k AS INTEGER) AS sentence_id, unit_text,
 CAST(a AS INTEGER) AS char_start, CAST(b AS INTEGER) AS char_end, CAST(len(regexp_extract_all(unit_text, '[\\p{{L}}\\p{{N}}_]+')) AS INTEGER) AS token_count FROM u""",
)
def text_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    # In these texts a paragraph is a line.
    return text.text_units(table(spark, sf_dir, "documents"), paragraph=r"\S(?:[^\n]*\S)?")


_CHECKSUM = "sha1(trim(regexp_replace(lower(text), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '))"


@register("exact_duplicates", f"SELECT doc_id, {_CHECKSUM} AS checksum, count(*) OVER (PARTITION BY {_CHECKSUM}) AS copies FROM documents QUALIFY copies > 1")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.exact_duplicates(table(spark, sf_dir, "documents"))


@register(
    "duplicate_groups",
    f"""WITH k AS (SELECT *, {_CHECKSUM} AS c FROM documents), g AS (SELECT c, count(*) AS copies, printf('DUP_%04d', row_number() OVER (ORDER BY min(doc_id))) AS group_id FROM k GROUP BY c HAVING count(*) > 1)
SELECT doc_id, group_id, copies, row_number() OVER (PARTITION BY c ORDER BY n_chars DESC, source, doc_id) = 1 AS keep FROM k JOIN g USING (c)""",
)
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.duplicate_groups(table(spark, sf_dir, "documents"), preference=[-F.col("n_chars"), F.col("source")])


_LANG = f"""WITH t AS (SELECT doc_id, lower(substr(text, 1, 25000)) AS t FROM documents),
s AS (SELECT doc_id, t, length(regexp_replace(t, '[^\\x{{3400}}-\\x{{9fff}}]', '', 'g')) AS cjk, regexp_extract_all(t, '[a-zà-öø-ÿ]+') AS k FROM t),
h AS (SELECT doc_id, t, cjk, CAST(coalesce(list_sum(list_transform(k, lambda w: length(w))), 0) AS BIGINT) AS alpha,
  len(list_filter(k, lambda w: list_contains({_list(W.ENGLISH)}, w))) + 2 * len(list_filter(list_distinct(k), lambda w: list_contains(['the', 'of', 'and', 'china', 'chinese', 'royal', 'asiatic', 'society'], w))) AS en,
  len(list_filter(k, lambda w: list_contains({_list(W.FRENCH)}, w))) + least(80, 2 * length(regexp_replace(t, '[^àâçéèêëîïôûùüÿœ]', '', 'g'))) AS fr,
  len(list_filter(k, lambda w: list_contains({_list(W.GERMAN)}, w))) + least(80, 3 * length(regexp_replace(t, '[^äöüß]', '', 'g'))) AS de FROM s),
r AS (SELECT *, cjk / (cjk + alpha) AS ratio, greatest(en, fr, de) AS best, list_sort([en, fr, de])[2] AS second FROM h),
lang AS (SELECT doc_id, CASE WHEN cjk + alpha = 0 THEN 'unknown' WHEN ratio >= 0.3 THEN CASE WHEN alpha > 250 AND ratio < 0.75 THEN 'mixed' ELSE 'zh-Hant' END WHEN best < 8 THEN 'unknown'
    WHEN second > 0 AND second / greatest(best, 1) >= 0.72 AND best >= 15 THEN 'mixed' WHEN en = best THEN 'en' WHEN fr = best THEN 'fr' ELSE 'de' END AS detected_language,
  round(CASE WHEN cjk + alpha = 0 THEN 0.0 WHEN ratio >= 0.3 THEN least(0.99, 0.6 + ratio) WHEN best < 8 THEN 0.25 ELSE least(0.99, greatest(0.35, (best + 1) / (en + fr + de + 3))) END::DOUBLE, 3) AS language_confidence FROM r)
"""


@register("language_detect", _LANG + "SELECT * FROM lang")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.with_language(table(spark, sf_dir, "documents")).select("doc_id", "detected_language", "language_confidence")


@register("language_distribution", _LANG + "SELECT lang, source, nullif(detected_language, 'unknown') AS detected_language, count(*) AS n FROM documents JOIN lang USING (doc_id) GROUP BY ALL")
def language_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.with_language(table(spark, sf_dir, "documents"))
    return found.groupBy("lang", "source", F.nullif("detected_language", F.lit("unknown")).alias("detected_language")).agg(F.count("*").alias("n"))


_NORM = f"trim(regexp_replace(replace(lower(translate({{0}}, '{scalar.ACCENTED}', '{scalar.PLAIN}')), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), ' ')"


@register(
    "analysis_text",
    f"""SELECT doc_id, CASE lang WHEN 'en' THEN array_to_string(list_filter(string_split({_NORM.format('text')}, ' '), lambda t: length(t) >= 2 AND NOT regexp_matches(t, '^[0-9]+$') AND NOT list_contains({_list(W.ENGLISH)}, t)), ' ')
 WHEN 'fr' THEN array_to_string(list_filter(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+'), lambda t: length(t) >= 2 AND NOT list_contains({_list(W.FRENCH)}, t)), ' ')
 WHEN 'de' THEN array_to_string(list_filter(regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+'), lambda t: length(t) >= 2 AND NOT list_contains({_list(W.GERMAN)}, t)), ' ')
 ELSE trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') END AS analysis_text FROM documents""",
)
def analysis_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.analysis_text(F.col("text"), F.col("lang")).alias("analysis_text"))


# Scalar functions.


@register("normalize_for_match", f"SELECT doc_id, {_NORM.format('text')} AS norm FROM documents")
def normalize_for_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scalar.normalize_for_match("text").alias("norm"))


@register("normalize_unicode")
def normalize_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.unicode import normalized_rows

    return normalized_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "norm")


@register("place_normalize", "SELECT item_id, trim(regexp_replace(replace(lower(text), 'ü', 'u'), '[^a-z0-9]+', ' ', 'g'), ' ') AS norm FROM benchmark")
def place_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", scalar.place_key("text").alias("norm"))


@register("author_normalize", "SELECT s_suppkey, replace(s_name, '#', ', ') || ' - the 1st' AS raw, replace(s_name, '#', ', ') || '-the 1st' AS norm FROM supplier")
def author_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.replace("s_name", F.lit("#"), F.lit(", ")), F.lit(" - the 1st"))
    noisy = F.concat(F.lit("Translated by  "), F.replace(raw, F.lit(", "), F.lit("  ,  ")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", raw.alias("raw"), scalar.normalize_author(noisy).alias("norm"))


_YEARTEXT = "('vol. ' || p_partkey || ' (' || (1800 + p_partkey % 190) || '), repr. ' || (1810 + p_partkey % 150))"


@register("year_extract", f"SELECT p_partkey, CAST(nullif(regexp_extract({_YEARTEXT}, '((?:18|19)[0-9][0-9])', 1), '') AS INTEGER) AS first_year, CAST(list_min(list_transform(regexp_extract_all({_YEARTEXT}, '((?:18|19)[0-9][0-9])', 1), lambda y: CAST(y AS INTEGER))) AS INTEGER) AS min_year, CAST(list_max(list_transform(regexp_extract_all({_YEARTEXT}, '((?:18|19)[0-9][0-9])', 1), lambda y: CAST(y AS INTEGER))) AS INTEGER) AS max_year FROM part")
def year_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("vol. "), "p_partkey", F.lit(" ("), F.col("p_partkey") % 190 + 1800, F.lit("), repr. "), F.col("p_partkey") % 150 + 1810)
    low, high = scalar.year_bounds(t)
    return table(spark, sf_dir, "part").select("p_partkey", scalar.first_year(t).alias("first_year"), low.alias("min_year"), high.alias("max_year"))


@register("expand_years", "SELECT p_partkey, array_to_string(range(1850 + p_partkey % 90, 1850 + p_partkey % 90 + p_size % 12 + 1), ',') AS years FROM part")
def expand_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("p_partkey") % 90 + 1850
    end = start + F.col("p_size") % 12
    label = F.when(F.col("p_size") % 12 == 0, start.cast("string")).when(F.col("p_partkey") % 2 == 0, F.concat_ws("-", start, end)).otherwise(F.concat(start, F.lit("-"), F.lpad((end % 100).cast("string"), 2, "0")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(scalar.expand_years(label), ",").alias("years"))


@register("decade_label", with_articles("SELECT master_id, year // 10 * 10 || 's' AS decade, CASE WHEN master_id % 3 = 0 THEN '1870s' WHEN master_id % 3 = 1 THEN 'nineties' ELSE year // 10 * 10 || 's' END AS given FROM art"))
def decade_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("master_id") % 3 == 0, "in 1870-79").when(F.col("master_id") % 3 == 1, "nineties")
    return articles(spark, sf_dir).select("master_id", scalar.decade_label("year").alias("decade"), scalar.decade_label("year", given).alias("given"))


@register("split_subjects", with_expanded("SELECT master_id, string_agg(subject_l1, '+' ORDER BY subject_l1) AS subjects FROM (SELECT DISTINCT master_id, subject_l1 FROM expanded WHERE subject_l1 <> 'Unknown') GROUP BY master_id UNION ALL SELECT master_id, '' FROM expanded GROUP BY master_id HAVING min(subject_l1 = 'Unknown')"))
def split_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.plans.roles import expanded

    cells = expanded(spark, sf_dir).groupBy("master_id").agg(scalar.joined_distinct("subject_l1", " | ").alias("cell"))
    return cells.select("master_id", F.array_join(scalar.split_subjects("cell"), "+").alias("subjects"))


@register("subject_split", "SELECT p_partkey, lower(p_type) || CASE WHEN split_part(p_name, ' ', 1) = lower(p_type) THEN '' ELSE '+' || split_part(p_name, ' ', 1) END || '+' || split_part(p_name, ' ', 2) AS parts FROM part")
def subject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.concat(F.upper("p_type"), F.lit(" ,  and "), F.replace("p_name", F.lit(" "), F.lit(" & ")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(scalar.subject_parts(cell), "+").alias("parts"))


@register(
    "subject_mapping",
    "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'Economics' WHEN 'SMALL' THEN 'Small things' ELSE 'Unknown' END AS subject_l2, CASE p_type WHEN 'ECONOMY' THEN 'Social sciences' WHEN 'SMALL' THEN 'General' ELSE 'Unknown' END AS subject_l1, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'reviewed' ELSE 'no rule' END AS mapping_note FROM part",
)
def subject_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.matching import map_subjects

    rules = spark.createDataFrame([("ECONOMY", "Economics", "Social sciences", "reviewed"), ("SMALL", "Small things", "General", "reviewed")], "subject string, subject_l2 string, subject_l1 string, mapping_note string")
    return map_subjects(table(spark, sf_dir, "part").withColumnRenamed("p_type", "subject"), rules).select("p_partkey", "subject_l2", "subject_l1", "mapping_note")


@register("excerpt", "SELECT doc_id, substr(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' '), 1, 200) AS excerpt FROM documents")
def excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scalar.excerpt("text").alias("excerpt"))


@register("url_parse", "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, CAST(nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS BIGINT) AS number, nullif(regexp_extract(url, '#(.*)$', 1), '') AS fragment FROM pages")
def url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", part("^([a-z]+)://").alias("scheme"), part("^[a-z]+://([^/?#]+)").alias("host"), F.nullif(part("/([0-9]+)"), F.lit("")).cast("bigint").alias("number"), F.nullif(part("#(.*)$"), F.lit("")).alias("fragment"))


@register("clean_text_regex", "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&[a-z]+;', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS clean FROM pages")
def clean_text_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "&[a-z]+;", " ")
    return table(spark, sf_dir, "pages").select("page_id", scalar.squish(bare).alias("clean"))


@register("json_props", "SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.from_json("props", "k int")["k"].alias("k")).agg(F.count("*").alias("n"))


@register("doc_manifest", "SELECT doc_id, printf('TXT_%05d', row_number() OVER (ORDER BY doc_id)) AS text_id, length(text) AS raw_char_count, len(string_split(text, chr(10))) AS raw_line_count, sha1(text) AS raw_text_checksum FROM documents")
def doc_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.sources.texts import manifest

    return manifest(table(spark, sf_dir, "documents"), "doc_id", "text")


# Filters and flags.


@register(
    "inclusion_flags",
    """WITH r AS (SELECT doc_id, list_filter([CASE WHEN n_chars < 300 THEN 'too short' END, CASE WHEN n_chars > 20000 THEN 'too long' END, CASE WHEN lang <> 'en' THEN 'not English' END, CASE WHEN coalesce(quality, 1) = 0 THEN 'low quality' END, CASE WHEN coalesce(toxic, 0) = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS r FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, len(r) = 0 AS include, array_to_string(r, '; ') AS reasons FROM r""",
)
def inclusion_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    include, reasons = text.inclusion_flags(
        [
            (F.col("n_chars") < 300, "too short"),
            (F.col("n_chars") > 20000, "too long"),
            (F.col("lang") != "en", "not English"),
            (F.coalesce("quality", F.lit(1)) == 0, "low quality"),
            (F.coalesce("toxic", F.lit(0)) == 1, "toxic"),
        ]
    )
    return rows.select("doc_id", include.alias("include"), reasons.alias("reasons"))


_NEEDLES = ", ".join(f"CASE WHEN contains(h, '{p}') THEN '{p.replace(' ', '_')}' END" for p in W.NON_ARTICLE)
_NAMES = "(CASE doc_id % 7 WHEN 0 THEN 'vol_1_Reviews' WHEN 1 THEN 'Literary Notes' WHEN 2 THEN 'list of plates' WHEN 3 THEN 'PROCEEDINGS-1880' WHEN 4 THEN 'index' WHEN 5 THEN 'front-matter misc' ELSE 'on rivers' END)"


def _names():
    # File names by the id, to exercise the rules.
    names = ["vol_1_Reviews", "Literary Notes", "list of plates", "PROCEEDINGS-1880", "index", "front-matter misc", "on rivers"]
    return F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % 7 + 1).cast("int"))


@register("model_exclusion", f"WITH {TOK}, h AS (SELECT doc_id, len(tokens) AS n, lower({_NAMES}) AS h FROM tok) SELECT doc_id, array_to_string(list_filter([CASE WHEN n < 20 THEN 'short_after_stopwords_lt_20' END, {_NEEDLES}], lambda x: x IS NOT NULL), ';') AS reason FROM h")
def model_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(spark, sf_dir).select("doc_id", text.exclusion_reason(F.size("tokens"), _names(), 20).alias("reason"))


_TYPES = " ".join(f"WHEN list_has_any([{', '.join(repr(n) for n in needles)}], list_filter([{', '.join(repr(n) for n in needles)}], lambda n: contains(a, n) OR contains(b, n))) THEN '{kind}'" for needles, kind in W.TEXT_TYPES)


@register("text_type_rules", f"WITH h AS (SELECT doc_id, replace(lower({_NAMES}), '-', '_') AS a, replace(replace(lower({_NAMES}), '-', '_'), '_', ' ') AS b FROM documents) SELECT doc_id, CASE {_TYPES} WHEN len(list_filter({_list(W.UNCERTAIN)}, lambda n: contains(a, n) OR contains(b, n))) > 0 THEN 'uncertain' ELSE 'article_candidate' END AS text_type FROM h")
def text_type_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.text_type(_names()).alias("text_type"))


@register("language_filter", "SELECT doc_id, lang FROM documents WHERE lower(coalesce(lang, '')) IN ('', 'en', 'fr')")
def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.lower(F.coalesce("lang", F.lit(""))).isin("", "en", "fr")).select("doc_id", "lang")


@register("length_gate", f"SELECT doc_id, len({WORDS_SQL}) AS n_words FROM documents WHERE len({WORDS_SQL}) >= 60")
def length_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")).cast("bigint").alias("n_words")).where("n_words >= 60")


# Corpus summaries.


@register("value_counts", "SELECT coalesce(nullif(CASE WHEN doc_id % 11 = 0 THEN '' ELSE source END, ''), 'missing') AS value, count(*) AS n FROM documents GROUP BY ALL")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").groupBy(F.coalesce(F.nullif(source, F.lit("")), F.lit("missing")).alias("value")).agg(F.count("*").alias("n"))


@register("describe_numeric", "SELECT min(n_chars) AS min_chars, CAST(median(n_chars) AS DOUBLE) AS median_chars, round(avg(n_chars), 6) AS mean_chars, max(n_chars) AS max_chars FROM documents")
def describe_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.min("n_chars").alias("min_chars"), F.percentile("n_chars", 0.5).alias("median_chars"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.max("n_chars").alias("max_chars"))


@register("length_histogram", "WITH b AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents) SELECT CAST(greatest(ceil((n_chars - lo) / ((hi - lo) / 12.0)), 1) AS INTEGER) AS bin, count(*) AS n FROM documents, b GROUP BY ALL")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("n_chars")
    bounds = docs.agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / 12.0
    return docs.crossJoin(F.broadcast(bounds)).groupBy(F.greatest(F.ceil((F.col("n_chars") - F.col("lo")) / step), F.lit(1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@register("validation_counts", "SELECT count(*) FILTER (lang IS NULL) AS missing_lang, count(*) FILTER (source IS NULL) AS missing_source, count(*) FILTER (n_chars < 100) AS short, count(*) FILTER (n_chars > 20000) AS long, count(*) FILTER (lang <> 'en') AS non_english FROM documents")
def validation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda p, name: F.count_if(p).alias(name)
    return table(spark, sf_dir, "documents").agg(n(F.col("lang").isNull(), "missing_lang"), n(F.col("source").isNull(), "missing_source"), n(F.col("n_chars") < 100, "short"), n(F.col("n_chars") > 20000, "long"), n(F.col("lang") != "en", "non_english"))


@register("pipeline_summary", "SELECT count(*) AS documents, count(DISTINCT source) AS sources, CAST(sum(n_chars) AS BIGINT) AS characters, count(*) FILTER (lang = 'en') AS english, count(quality) AS labelled, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def pipeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").drop("text").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n = lambda p, name: F.count_if(p).alias(name)
    return rows.agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"), F.sum("n_chars").alias("characters"), n(F.col("lang") == "en", "english"), F.count("quality").alias("labelled"), n(F.col("quality") == 1, "good"), n(F.col("toxic") == 1, "toxic"))
