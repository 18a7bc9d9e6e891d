"""Text operators: tokens, n-grams, vocabularies, TF-IDF variants, chunks, units,
duplicates, language and analysis text. Built-in functions only.

Documents have a key column (doc_id by default) and a text column. Tokens are arrays in
order; a group column, where there is one, may hold nulls, which count as no group.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import words as W
from tessera.functions.numbering import labelled
from tessera.functions.scalar import normalize_for_match, squish
from tessera.sources.written import keep


def idf(n: Column, df: Column) -> Column:
    """The smoothed inverse document frequency that all variants share."""
    return F.log((1 + n) / (1 + df)) + 1


def _literals(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def without(tokens: Column, words: Sequence[str]) -> Column:
    """Tokens that aren't in `words`; In() over literals is a hash lookup."""
    return F.filter(tokens, lambda t: ~t.isin(*words)) if words else tokens


def model_tokens(text: Column, stopwords: Sequence[str] = W.MODEL + W.DOMAIN) -> Column:
    """Lower-cased words of three letters or more, inner apostrophes and hyphens kept."""
    raw = F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z'-]{2,}"), 0), lambda t: F.btrim(t, F.lit("-'")))
    return without(F.filter(raw, lambda t: (F.length(t) >= 3) & (F.length(F.translate(t, "-'", "")) >= 3)), stopwords)


def unnested(rows: DataFrame, array: str | Column, name: str, *carry: str) -> DataFrame:
    """`carry` and one row per element. An outer explode, with its null rows dropped after
    it: a plain one makes the optimizer test the array's size below the projection that
    builds it, and so build it several times."""
    return rows.select(*carry, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def ngrams(tokens: Column, low: int = 1, high: int = 3) -> Column:
    """All n-grams of `low` to `high` tokens, joined by '_', the short ones first."""

    def of(n: int) -> Column:
        if n == 1:
            return tokens
        # Shifted copies side by side: the array is walked once, not sliced at every place.
        shifted = F.arrays_zip(*[F.slice(tokens, k, F.greatest(F.size(tokens) - n + 1, F.lit(0))).alias(f"t{k}") for k in range(1, n + 1)])
        return F.transform(shifted, lambda x: F.concat_ws("_", *[x[f"t{k}"] for k in range(1, n + 1)]))

    return F.concat(*[of(n) for n in range(low, high + 1)])


def title_tokens(title: Column, stopwords: Sequence[str] = W.TITLE) -> Column:
    """Words of a title: five fixed spellings replaced, stop words and possessives gone."""
    t = F.lower(F.coalesce(title, F.lit("")))
    # Spellings that are made one.
    for old, new in (("yang - tsze", "yangtze"), ("yang-tsze", "yangtze"), ("ta - ts'ing", "qing"), ("ta-ts'ing", "qing"), ("meh tsi", "mozi")):
        t = F.replace(t, F.lit(old), F.lit(new))
    raw = F.transform(F.regexp_extract_all(t, F.lit("[a-z][a-z'-]{1,}"), 0), lambda x: F.btrim(x, F.lit("-'")))
    kept = without(F.filter(raw, lambda x: F.length(x) >= 3), stopwords)
    bare = F.transform(kept, lambda x: F.regexp_replace(x, "'s$", ""))
    return without(F.filter(bare, lambda x: x != ""), stopwords)


def bigrams(tokens: Column) -> Column:
    """Neighbouring tokens joined by a space, but not a token with itself."""
    pairs = F.arrays_zip(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))).alias("a"), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))).alias("b"))
    return F.transform(F.filter(pairs, lambda p: p["a"] != p["b"]), lambda p: F.concat_ws(" ", p["a"], p["b"]))


def nested_counts(docs: DataFrame, tokens: str = "tokens", *carry: str) -> DataFrame:
    """(doc_id, carry..., _c): an array of how often each document has each of its terms, (term,
    tf), counted within its sorted tokens. Rows of a null id don't count; ids are unique."""
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", *carry, F.sort_array(tokens).alias("_t"))
    size = F.size("_t")
    # Where the runs of equal terms end, counted from 1; a run's length is its end less that before it.
    ends = F.when(size > 0, F.filter(F.sequence(F.lit(1), size), lambda i: (i == size) | (F.get("_t", i) != F.get("_t", i - 1))))
    rows = rows.select("doc_id", *carry, "_t", ends.alias("_e"))
    counts = F.transform("_e", lambda e, k: F.struct(F.get("_t", e - 1).alias("term"), (e - F.when(k == 0, 0).otherwise(F.get("_e", k - 1))).cast("bigint").alias("tf")))
    return rows.select("doc_id", *carry, counts.alias("_c"))


def term_rows(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(doc_id, term, tf) of nested_counts(), without a shuffle."""
    return unnested(nested_counts(docs, tokens), "_c", "x", "doc_id").select("doc_id", "x.term", "x.tf").where("term IS NOT NULL")


def _counted(terms: DataFrame, docs: DataFrame, min_df: int, max_df: float) -> DataFrame:
    """(term, raw_count, document_count, _n, _ok) of term_rows()."""
    n = docs.agg(F.count("*").alias("_n"))
    out = terms.groupBy("term").agg(F.sum("tf").alias("raw_count"), F.count("*").alias("document_count")).crossJoin(F.broadcast(n))
    most = F.greatest(F.floor(F.lit(max_df) * F.col("_n")), F.lit(min_df))
    return out.withColumn("_ok", (F.col("document_count") >= min_df) & (F.col("document_count") <= most))


def kept_terms(terms: DataFrame, docs: DataFrame, min_df: int = 5, max_df: float = 0.6, cap: int = 12000) -> DataFrame:
    """(term) within the document-frequency bounds, at most `cap` of them by count, then documents, then term."""
    return _counted(terms, docs, min_df, max_df).where("_ok").orderBy(F.desc("raw_count"), F.desc("document_count"), "term").limit(cap).select("term")


def vocabulary(docs: DataFrame, tokens: str = "tokens", min_df: int = 5, max_df: float = 0.6, cap: int = 12000) -> DataFrame:
    """(term, raw_count, document_count, document_frequency, kept_by_df_filter) of all terms;
    kept are kept_terms(). The counts are written once and read twice."""
    out = keep(_counted(term_rows(docs, tokens), docs, min_df, max_df), "vocabulary")
    top = out.where("_ok").orderBy(F.desc("raw_count"), F.desc("document_count"), "term").limit(cap).select("term", F.lit(True).alias("_top"))
    out = out.join(F.broadcast(top), "term", "left")
    return out.select("term", "raw_count", "document_count", (F.col("document_count") / F.col("_n")).alias("document_frequency"), F.coalesce("_top", F.lit(False)).alias("kept_by_df_filter"))


def doc_terms(terms: DataFrame, keep_terms: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, tf, doc_len) of term_rows(): the terms in `keep_terms`, which is bounded
    by the vocabulary's cap and broadcast, and the number of kept tokens of the document."""
    if keep_terms is not None:
        terms = terms.join(F.broadcast(keep_terms.select("term")), "term", "left_semi").select("doc_id", "term", "tf")
    return terms.withColumn("doc_len", F.sum("tf").over(Window.partitionBy("doc_id")))


def among(term: Column, words: Sequence[str]) -> Column:
    """Whether a term is one of many words: buckets by checksum in one literal, as thousands of
    literals take the driver long to plan."""
    buckets: list[list[str]] = [[] for _ in range(2 * len(words) + 1)]
    for w in words:
        buckets[zlib.crc32(w.encode()) % len(buckets)].append(w)
    table = F.from_json(F.lit(json.dumps(buckets)), "array<array<string>>")
    return F.array_contains(F.get(table, F.pmod(F.crc32(term.cast("binary")), F.lit(len(buckets))).cast("int")), term)


#: The most pairs of words that three-word terms are sought by.
MOST_PAIRS = 50_000


def kept_list(docs: DataFrame, high: int = 1, min_df: int = 5, max_df: float = 0.6, cap: int = 12000) -> list[str]:
    """kept_terms() of the n-grams of up to `high` (1 to 3) tokens, which have no '_', as a list.

    A term of three words isn't in more places or documents than its first two words or its
    last two. So once those of one and two are counted, only such of three are made whose
    pairs have what the last kept term has; all others, counted, would be left out.
    """
    order = [F.desc("raw_count"), F.desc("document_count"), F.asc("term")]
    first = lambda rows: rows.where("_ok").orderBy(*order).limit(cap).select("term", "raw_count", "document_count").collect()
    short = docs if high == 1 else docs.withColumn("tokens", ngrams(F.col("tokens"), 1, min(high, 2)))
    counted = _counted(term_rows(short), docs, min_df, max_df)
    if high < 3:
        return [r.term for r in first(counted)]
    counted = keep(counted.where(F.col("document_count") >= min_df), "counted")
    top = first(counted)
    raw, df = (top[-1].raw_count, top[-1].document_count) if len(top) == cap else (0, 0)
    pairs = counted.where(F.col("term").contains("_") & ((F.col("raw_count") > raw) | (F.col("raw_count") == raw) & (F.col("document_count") >= df)))
    pairs = [r.term for r in pairs.select("term").limit(MOST_PAIRS + 1).collect()]
    if len(pairs) > MOST_PAIRS:
        long = docs.withColumn("tokens", ngrams(F.col("tokens"), 3, 3))
    else:
        known = docs.withColumn("_p", F.transform(ngrams(F.col("tokens"), 2, 2), lambda p: among(p, pairs)))
        of = lambda c, k, name: F.slice(c, k, F.greatest(F.size("tokens") - 2, F.lit(0))).alias(name)
        places = F.arrays_zip(of("tokens", 1, "a"), of("tokens", 2, "b"), of("tokens", 3, "c"), of("_p", 1, "p"), of("_p", 2, "q"))
        long = known.withColumn("tokens", F.transform(F.filter(places, lambda x: x["p"] & x["q"]), lambda x: F.concat_ws("_", x["a"], x["b"], x["c"])))
    top += first(_counted(term_rows(long), docs, min_df, max_df))
    return [r.term for r in sorted(top, key=lambda r: (-r.raw_count, -r.document_count, r.term.encode()))[:cap]]


def kept_counts(docs: DataFrame, vocabulary: list[str], *carry: str) -> DataFrame:
    """(doc_id, carry..., doc_len, _c): nested_counts() of the tokens in `vocabulary`, and how many they are."""
    kept = F.filter("tokens", lambda t: among(t, vocabulary))
    own = docs.select("doc_id", *carry, kept.alias("tokens")).withColumn("doc_len", F.size("tokens").cast("bigint"))
    return nested_counts(own, "tokens", *carry, "doc_len").where("doc_len > 0")


def tfidf_table(docs: DataFrame, vocabulary: list[str], by: Sequence[str] = (), only: Column | None = None) -> DataFrame:
    """(by..., term, tfidf_score, raw_count, document_count, document_frequency): the sum over
    documents of tf / length times the idf within the group. `vocabulary` is capped: lengths are
    taken and terms counted within a document's row, and what is shuffled are sums by group and
    term. A null term stands for the document itself and counts them."""
    rows = kept_counts(docs, vocabulary, *by)
    each = F.concat(F.col("_c"), F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("tf"))))
    rows = unnested(rows, each, "x", *by, "doc_len").select(*by, "x.term", "x.tf", "doc_len")
    out = keep(rows.groupBy(*by, "term").agg(F.sum(F.col("tf") / F.col("doc_len")).alias("_s"), F.sum("tf").alias("raw_count"), F.count("*").alias("document_count")), "sums")
    n_docs = F.broadcast(out.where("term IS NULL").select(*by, F.col("document_count").alias("n_docs")))
    out = out.where("term IS NOT NULL" if only is None else F.col("term").isNotNull() & only)
    out = out.join(n_docs, list(by)) if by else out.crossJoin(n_docs)
    return out.select(*by, "term", (F.col("_s") * idf(F.col("n_docs"), F.col("document_count"))).alias("tfidf_score"), "raw_count", "document_count", (F.col("document_count") / F.col("n_docs")).alias("document_frequency"))


def top_terms(scores: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Adds rank and keeps the first n by score, then term; a global rank is taken after the limit."""
    order = [F.desc(F.round("tfidf_score", 9)), F.asc("term")]
    if by:
        return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)
    return scores.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def tfidf_overall(docs: DataFrame, n: int = 100, phrases_only: bool = False, high: int = 1, min_df: int = 5, max_df: float = 0.6, cap: int = 12000) -> DataFrame:
    """The top terms over all documents of (doc_id, tokens), of n-grams of up to `high` tokens."""
    kept = kept_list(docs, high, min_df, max_df, cap)
    rows = docs if high == 1 else docs.withColumn("tokens", ngrams(F.col("tokens"), 1, high))
    return top_terms(tfidf_table(rows, kept, only=F.col("term").contains("_") if phrases_only else None), n)


def tfidf_by_group(docs: DataFrame, group: str, n: int = 25, min_df: int = 5, max_df: float = 0.6, cap: int = 12000) -> DataFrame:
    """The top terms of each group, with the idf within the group."""
    kept = kept_list(docs, 1, min_df, max_df, cap)
    return top_terms(tfidf_table(docs.where(F.col(group).isNotNull()), kept, [group]), n, [group])


def tfidf_macro(docs: DataFrame, group: str, n: int = 40) -> DataFrame:
    """Groups as documents: relative term counts times the idf over groups; top terms of each."""
    counts = unnested(docs.where(F.col(group).isNotNull()), "tokens", "term", group).groupBy(group, "term").agg(F.count("*").alias("count"))
    groups = counts.agg(F.countDistinct(group).alias("n_docs"))
    df = counts.groupBy("term").agg(F.count("*").alias("document_count"))
    total = F.sum("count").over(Window.partitionBy(group))
    out = counts.withColumn("tf", F.col("count") / total).join(df, "term").crossJoin(F.broadcast(groups))
    return top_terms(out.withColumn("tfidf_score", F.col("tf") * idf(F.col("n_docs"), F.col("document_count"))).select(group, "term", "count", "tfidf_score"), n, [group])


def grouped_counts(groups: DataFrame, terms: DataFrame, name: str, *by: str) -> DataFrame:
    """(by..., name, n, article_count) from how many rows and distinct articles of an item a
    group has, (by..., item, rows, articles), and how often its titles hold a term, (item,
    name, times); an article is of one item. Both are small next to the articles."""
    rows = groups.join(terms, "item")
    return rows.groupBy(*by, name).agg(F.sum(F.col("rows") * F.col("times")).alias("n"), F.sum("articles").alias("article_count"))


def count_tfidf(counts: DataFrame, term: str, window: str, count: str, windows: DataFrame | None = None) -> DataFrame:
    """Adds df (distinct windows of the term), idf over all windows, and tfidf = count * idf.
    The counts are written once and read for each of them."""
    counts = keep(counts, "counts")
    n = (windows if windows is not None else counts).agg(F.countDistinct(window).alias("_n"))
    df = counts.groupBy(term).agg(F.countDistinct(window).alias("df"))
    out = counts.join(df, term).crossJoin(F.broadcast(n)).withColumn("idf", idf(F.col("_n"), F.col("df")))
    return out.withColumn("tfidf", F.col(count) * F.col("idf")).drop("_n")


def class_tfidf(docs: DataFrame, group: str, n: int = 10) -> DataFrame:
    """Classes as documents with BM25 weights: sqrt of the class's relative frequency times
    ln(1 + (mean class words - total + 0.5) / (total + 0.5)), where that is positive."""
    counts = unnested(docs.where(F.col(group).isNotNull()), "tokens", "term", group).groupBy(group, "term").agg(F.count("*").alias("count"))
    mean = counts.groupBy(group).agg(F.sum("count").alias("_w")).agg(F.avg("_w").alias("_mean"))
    total = counts.groupBy("term").agg(F.sum("count").alias("total"))
    out = counts.withColumn("_tf", F.sqrt(F.col("count") / F.sum("count").over(Window.partitionBy(group)))).join(total, "term").crossJoin(F.broadcast(mean))
    # Above this a term is in every class as often as all words together; its logarithm has no value.
    inner = 1 + (F.col("_mean") - F.col("total") + 0.5) / (F.col("total") + 0.5)
    return top_terms(out.withColumn("tfidf_score", F.col("_tf") * F.log(inner)).select(group, "term", "count", "total", "tfidf_score"), n, [group])


def model_documents(docs: DataFrame, kept: DataFrame, min_tokens: int = 20) -> DataFrame:
    """Documents as their tokens in the vocabulary, in order, with counts and exclusion."""
    rows = docs.select("doc_id", F.posexplode_outer("tokens").alias("_i", "term")).where("term IS NOT NULL").join(F.broadcast(kept.select("term")), "term", "left_semi")
    own = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "term"))), lambda x: x["term"]), " ").alias("model_text"), F.count("*").alias("token_count_after_df"))
    out = docs.select("doc_id", F.size("tokens").cast("bigint").alias("token_count_before_df")).join(own, "doc_id", "left")
    count = F.coalesce("token_count_after_df", F.lit(0))
    return out.select("doc_id", F.coalesce("model_text", F.lit("")).alias("model_text"), "token_count_before_df", count.cast("bigint").alias("token_count_after_df"), F.when(count < min_tokens, f"short_after_stopwords_lt_{min_tokens}").otherwise("").alias("exclusion_reason"))


def chunk_documents(docs: DataFrame, text: str = "text", size: int = 400, overlap: int = 50, least: int = 100) -> DataFrame:
    """(doc_id, chunk_index, chunk_text, chunk_word_count): windows of words; a tail of under
    `least` words is dropped, a whole document of `size` or fewer is one chunk."""
    step = size - overlap
    parts = docs.select("doc_id", F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "").alias("w"))
    starts = F.when(F.size("w") == 0, F.array().cast("array<int>")).when(F.size("w") <= size, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step)), lambda i: F.size("w") - i >= least))
    rows = parts.select("doc_id", "w", F.posexplode_outer(starts).alias("chunk_index", "at")).where("at IS NOT NULL")
    chunk = F.slice("w", F.col("at") + 1, size)
    return rows.select("doc_id", "chunk_index", F.array_join(chunk, " ").alias("chunk_text"), F.size(chunk).alias("chunk_word_count"))


def paragraph_records(docs: DataFrame, text: str = "text", separator: str = r"\n", least: int = 60) -> DataFrame:
    """Paragraphs of `least` words or more, numbered by their place."""
    rows = docs.select("doc_id", F.posexplode(F.split(text, separator)).alias("paragraph_index", "paragraph")).withColumn("word_count", F.size(F.filter(F.split("paragraph", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")))
    return rows.where(F.col("word_count") >= least)


def spans(text: Column, pattern: str) -> Column:
    """array<struct<text, start, end>> of a pattern's matches, in characters from 0."""
    parts = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("hits"))
    kind = "array<struct<text:string,start:int,end:int>>"

    def step(x: Column, acc: Column, i: Column) -> Column:
        hit = F.get(x["hits"], i)
        start = acc["at"] + F.length(F.get(x["between"], i))
        one = F.struct(hit.alias("text"), start.alias("start"), (start + F.length(hit)).alias("end"))
        return F.struct((start + F.length(hit)).alias("at"), F.concat(acc["out"], F.array(one)).cast(kind).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    walk = lambda x: F.when(F.size(x["hits"]) > 0, F.aggregate(F.sequence(F.lit(0), F.size(x["hits"]) - 1), first, lambda acc, i: step(x, acc, i), lambda acc: acc["out"])).otherwise(F.array().cast(kind))
    # A one-element array is the place where the two lists are made once and looked up many times.
    return F.get(F.transform(F.array(parts), walk), 0)


#: Sentences by a language's own punctuation; other languages have paragraphs only.
LATIN_SENTENCE, CHINESE_SENTENCE = "[^.!?]+(?:[.!?]+[\"')\\]]*)?", "[^。！？；]+[。！？；]?"
PARAGRAPH = r"(?s)\S(?:.*?\S)?(?=\n\s*\n|\s*\z)"


def text_units(docs: DataFrame, text: str = "text", language: str = "lang", paragraph: str = PARAGRAPH) -> DataFrame:
    """(doc_id, unit_id, unit_type, unit_order, paragraph_id, sentence_id, unit_text, char_start,
    char_end, token_count): paragraphs, each followed by its sentences, numbered from 1, with
    their places in the text. A null text has none."""
    cjk, none = F.col(language) == "zh-Hant", F.array().cast("array<struct<text:string,start:int,end:int>>")
    sentences = lambda t: F.filter(F.when(cjk, spans(t, CHINESE_SENTENCE)).when(F.col(language).isin("en", "fr", "de"), spans(t, LATIN_SENTENCE)).otherwise(none), lambda s: F.trim(s["text"]) != "")
    unit = lambda kind, p, k, t, a, b: F.struct(F.lit(kind).alias("unit_type"), (p + 1).cast("int").alias("paragraph_id"), k.cast("int").alias("sentence_id"), t.alias("unit_text"), a.cast("int").alias("char_start"), b.cast("int").alias("char_end"))

    def of_paragraph(x: Column, p: Column) -> Column:
        one = unit("paragraph", p, F.lit(None), x["text"], x["start"], x["end"])
        return F.concat(F.array(one), F.transform(sentences(x["text"]), lambda s, k: unit("sentence", p, k + 1, F.trim(s["text"]), x["start"] + s["start"], x["start"] + s["end"])))

    # A text's units are made in its row: nothing shuffles.
    rows = docs.select("doc_id", language, F.coalesce(spans(F.col(text), paragraph), none).alias("_p"))
    rows = rows.select("doc_id", language, F.flatten(F.transform("_p", of_paragraph)).alias("_u")).select("doc_id", language, F.posexplode("_u").alias("_k", "u"))
    tokens = F.size(F.when(cjk, F.regexp_extract_all("u.unit_text", F.lit("[\\u3400-\\u9fff]|[A-Za-z0-9]+"), 0)).otherwise(F.regexp_extract_all("u.unit_text", F.lit(r"[\p{L}\p{N}_]+"), 0)))
    unit_id = F.concat(F.format_string("%d_P%04d", "doc_id", "u.paragraph_id"), F.when(F.col("u.sentence_id").isNotNull(), F.format_string("_S%04d", "u.sentence_id")).otherwise(""))
    return rows.select("doc_id", unit_id.alias("unit_id"), "u.unit_type", (F.col("_k") + 1).cast("int").alias("unit_order"), "u.paragraph_id", "u.sentence_id", "u.unit_text", "u.char_start", "u.char_end", tokens.alias("token_count"))


def duplicate_key(text: Column) -> Column:
    return F.sha1(squish(F.lower(F.coalesce(text, F.lit("")))))


def exact_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, checksum, copies) of documents whose normalised text occurs twice or more.
    Copies are counted in the tasks before the shuffle; only repeated checksums are joined."""
    keyed = docs.select("doc_id", duplicate_key(F.col(text)).alias("checksum"))
    sizes = keyed.groupBy("checksum").agg(F.count("*").alias("copies")).where("copies > 1")
    return keyed.join(sizes, "checksum").select("doc_id", "checksum", "copies")


def duplicate_groups(docs: DataFrame, text: str = "text", preference: Sequence[Column] = ()) -> DataFrame:
    """Groups DUP_0001... in order of first appearance, and in each the row to keep: the least
    of the columns `preference`, nulls last, then the smallest id. A group's best row is a
    minimum, taken in the tasks first, so no group is sorted in one task."""
    order = F.struct(*[F.struct(p.isNull(), p) for p in preference], "doc_id")
    keyed = docs.select("doc_id", duplicate_key(F.col(text)).alias("checksum"), order.alias("_order"))
    groups = keyed.groupBy("checksum").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.min("_order").alias("_best")).where("copies > 1")
    named = labelled(groups, "group_id", "DUP_%04d", "first_id")
    return keyed.join(named, "checksum").select("doc_id", "group_id", "copies", (F.col("_order") == F.col("_best")).alias("keep"))


def language_signals(t: Column, tokens: Column) -> Column:
    """Counts by script and function words of a lower-cased text and its words, as the rule states."""
    cjk = F.length(F.regexp_replace(t, "[^\\u3400-\\u9fff]", ""))
    alpha = F.aggregate(tokens, F.lit(0), lambda a, w: a + F.length(w))
    hits = lambda words: F.size(F.filter(tokens, lambda w: w.isin(*words)))
    marks = lambda chars: F.length(F.regexp_replace(t, f"[^{chars}]", ""))
    # Terms that add to English once each.
    common = ("the", "of", "and", "china", "chinese", "royal", "asiatic", "society")
    distinct = F.array_distinct(tokens)
    en = hits(W.ENGLISH) + 2 * F.size(F.filter(distinct, lambda w: w.isin(*common)))
    fr = hits(W.FRENCH) + F.least(F.lit(80), 2 * marks("àâçéèêëîïôûùüÿœ"))
    de = hits(W.GERMAN) + F.least(F.lit(80), 3 * marks("äöüß"))
    return F.struct(cjk.alias("cjk"), alpha.alias("alpha"), en.alias("en"), fr.alias("fr"), de.alias("de"))


def with_language(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds detected_language and language_confidence."""
    # Words are a column of their own: they are extracted once and counted five times.
    out = docs.withColumn("_t", F.lower(F.substring(F.coalesce(text, F.lit("")), 1, 25000))).withColumn("_k", F.regexp_extract_all("_t", F.lit("[a-zà-öø-ÿ]+"), 0))
    out = out.withColumn("_s", language_signals(F.col("_t"), F.col("_k")))
    en, fr, de, cjk, alpha = (F.col(f"_s.{c}") for c in ("en", "fr", "de", "cjk", "alpha"))
    ratio, best = cjk / (cjk + alpha), F.greatest(en, fr, de)
    second = F.sort_array(F.array(en, fr, de))[1]
    first = F.when(en == best, "en").when(fr == best, "fr").otherwise("de")
    mixed = (second > 0) & (second / F.greatest(best, F.lit(1)) >= 0.72) & (best >= 15)
    language = F.when(cjk + alpha == 0, "unknown").when(ratio >= 0.3, F.when((alpha > 250) & (ratio < 0.75), "mixed").otherwise("zh-Hant")).when(best < 8, "unknown").when(mixed, "mixed").otherwise(first)
    confidence = F.when(cjk + alpha == 0, 0.0).when(ratio >= 0.3, F.least(F.lit(0.99), 0.6 + ratio)).when(best < 8, 0.25).otherwise(F.least(F.lit(0.99), F.greatest(F.lit(0.35), (best + 1) / (en + fr + de + 3))))
    return out.withColumn("detected_language", language).withColumn("language_confidence", F.round(confidence, 3)).drop("_s", "_t", "_k")


def analysis_text(text: Column, language: Column) -> Column:
    """Space-joined tokens for bag-of-words work, by language."""
    english = without(F.filter(F.split(normalize_for_match(text), " "), lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$")), W.ENGLISH)
    latin = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-zà-öø-ÿ]+"), 0), lambda t: F.length(t) >= 2)
    return (
        F.when(language == "en", F.array_join(english, " "))
        .when(language == "fr", F.array_join(without(latin, W.FRENCH), " "))
        .when(language == "de", F.array_join(without(latin, W.GERMAN), " "))
        .when(language == "zh-Hant", squish(F.regexp_replace(text, "[^\\u3400-\\u9fffA-Za-z0-9\\s]", " ")))
        .otherwise(squish(text))
    )


def text_type(name: Column) -> Column:
    """Type of a text by its file name; the first rule counts."""
    low = F.replace(F.lower(name), F.lit("-"), F.lit("_"))
    spaced = F.replace(low, F.lit("_"), F.lit(" "))
    has = lambda needles: F.exists(_literals(needles), lambda n: F.contains(low, n) | F.contains(spaced, n))
    out = None
    for needles, kind in W.TEXT_TYPES:
        out = F.when(has(needles), kind) if out is None else out.when(has(needles), kind)
    return out.when(has(W.UNCERTAIN), "uncertain").otherwise("article_candidate")


def exclusion_reason(tokens: Column, haystack: Column, least: int) -> Column:
    """';'-joined reasons why a text is left out of models: too short, then each needle it has."""
    low = F.lower(F.coalesce(haystack, F.lit("")))
    reasons = [F.when(tokens < least, f"short_after_stopwords_lt_{least}")] + [F.when(F.contains(low, F.lit(p)), p.replace(" ", "_")) for p in W.NON_ARTICLE]
    return F.array_join(F.array_distinct(F.filter(F.array(*reasons), lambda r: r.isNotNull())), ";")


def inclusion_flags(reasons: Sequence[tuple[Column, str]]) -> tuple[Column, Column]:
    """(include, '; '-joined distinct reasons) of predicates in order."""
    found = F.array_distinct(F.filter(F.array(*[F.when(p, r) for p, r in reasons]), lambda r: r.isNotNull()))
    return F.size(found) == 0, F.array_join(found, "; ")
