"""URL filters by a temporal list join: dated list entries become validity intervals, and an
as-of join evaluates every capture against the entries active when it was fetched.

Captures are reduced to their distinct (host, day) before the join, so a host with a third
of all captures is looked up once a day; the verdicts then go back by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.shared import table


def host_of(url: Column) -> Column:
    """Lower-cased host of an absolute URL; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def domains_of(host: Column) -> Column:
    """The host and its parent domains of two labels or more; the host itself in any case."""
    parts = F.split(host, "\\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, valid_from, valid_to): when each domain is on the list, end exclusive, null if open.

    entries: (domain, day, action) with action 'add' or 'remove'. Of two on one day 'remove'
    counts. An entry holds until the domain's next. Rows with nulls or other actions don't count.
    """
    dated = entries.where(F.col("action").isin("add", "remove") & F.col("day").isNotNull() & F.col("domain").isNotNull()).groupBy(F.lower("domain").alias("domain"), "day").agg(F.max("action").alias("action"))
    then = F.lead("day").over(Window.partitionBy("domain").orderBy("day"))
    return dated.withColumn("valid_to", then).where("action = 'add'").select("domain", F.col("day").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, host, day, blocked, matched_domain, listed_on) for each row of captures (page_id, url, day).

    A capture is blocked if on its day an entry is active for its host or a parent domain;
    the most specific is reported. Null or malformed URLs have an empty host, which nothing
    lists; a null day is never blocked. Repeated rows stay; other columns are ignored.
    """
    own = captures.select("page_id", host_of(F.col("url")).alias("host"), "day")
    keys = own.where("host != '' and day is not null").select("host", "day").distinct()
    tried = keys.withColumn("domain", F.explode(domains_of(F.col("host"))))
    lists = intervals(entries)
    hits = tried.join(lists, "domain").where((F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to"))))
    best = hits.groupBy("host", "day").agg(F.max(F.struct(F.length("domain").alias("n"), "domain", "valid_from")).alias("best"))
    return own.join(best, ["host", "day"], "left").select("page_id", "host", "day", F.col("best").isNotNull().alias("blocked"), F.col("best.domain").alias("matched_domain"), F.col("best.valid_from").alias("listed_on"))


def fetch_day(page_id: Column) -> Column:
    """The tables have no fetch times: a day of 2023 or 2024 by the page's id."""
    return F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(page_id * 37, F.lit(730)).cast("int"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """The tables have no list: every domain of the pages is added, removed and added again on
    days given by its MD5, if that starts with one of six digits."""
    domains = pages.select(host_of(F.col("url")).alias("host")).where("host != ''").distinct().select(F.explode(domains_of(F.col("host"))).alias("domain")).distinct()
    h = F.conv(F.substring(F.md5(F.col("domain")), 1, 4), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2023-01-01").cast("date"), n.cast("int"))
    events = F.array(*[F.struct(day(n).alias("day"), F.lit(a).alias("action")) for n, a in ((h % 300, "add"), (h % 300 + 40 + h % 97, "remove"), (h % 300 + 200 + h % 211, "add"))])
    return domains.where(h < 6 * 4096).select("domain", F.explode(events).alias("e")).select("domain", "e.day", "e.action")


def op5_temporal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against the dated entries."""
    pages = table(spark, sf_dir, "pages")
    return filter_captures(pages.withColumn("day", fetch_day(F.col("page_id"))), dated_entries(pages))


ORACLE = r"""
WITH own AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
         CAST(DATE '2023-01-01' + CAST((page_id * 37) % 730 AS INTEGER) AS DATE) AS day
  FROM pages
), parts AS (SELECT DISTINCT host, string_split(host, '.') AS p FROM own WHERE host <> ''),
suffixes AS (SELECT host, array_to_string(p[i:], '.') AS domain FROM (SELECT host, p, unnest(range(1, greatest(1, len(p) - 1) + 1)) AS i FROM parts)),
hashed AS (SELECT domain, CAST('0x' || substr(md5(domain), 1, 4) AS INTEGER) AS h FROM (SELECT DISTINCT domain FROM suffixes)),
entries AS (
  SELECT domain, DATE '2023-01-01' + h % 300 AS day, 'add' AS action FROM hashed WHERE h < 24576
  UNION ALL SELECT domain, DATE '2023-01-01' + (h % 300 + 40 + h % 97), 'remove' FROM hashed WHERE h < 24576
  UNION ALL SELECT domain, DATE '2023-01-01' + (h % 300 + 200 + h % 211), 'add' FROM hashed WHERE h < 24576
), dated AS (SELECT domain, day, max(action) AS action FROM entries GROUP BY ALL),
lists AS (SELECT domain, day AS valid_from, lead(day) OVER (PARTITION BY domain ORDER BY day) AS valid_to, action FROM dated),
best AS (
  SELECT page_id, max_by(struct_pack(d := s.domain, f := l.valid_from), length(s.domain)) AS b
  FROM own o JOIN suffixes s USING (host) JOIN lists l ON l.domain = s.domain AND l.action = 'add' AND o.day >= l.valid_from AND (l.valid_to IS NULL OR o.day < l.valid_to)
  GROUP BY page_id
)
SELECT page_id, host, day, b IS NOT NULL AS blocked, b.d AS matched_domain, CAST(b.f AS DATE) AS listed_on FROM own LEFT JOIN best USING (page_id)
"""
