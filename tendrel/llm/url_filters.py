"""URL filters with dated lists: temporal join of captures and list entries.

List entries are events: at a time, a key (a host, a parent domain, or a host with leading path segments) is added to or removed from a list. Each add is
valid until the next event of the same list and key. A capture is looked up under all keys that cover its URL, as of the time it was fetched. Intervals are
cut at fixed spans of time and joined by key and span, so that a key with many changes and many captures meets only those of its own span; captures of a
hot host stand on the streamed side of the join, which Spark splits, and the list side is broadcast only if Spark finds it small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import input_rows

HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)"


def url_host(url: Column) -> Column:
    """Lower-case host without a leading www., or an empty string."""
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit(""))), r"^www\.", "")


def url_keys(url: Column, path_depth: int = 2) -> Column:
    """All keys that cover a URL: its host, the parent domains of two labels or more, and the host with one to ``path_depth`` path segments."""
    host = url_host(url)
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(F.coalesce(F.regexp_extract(url, PATH, 1), F.lit("")), "/"), lambda x: x != "")
    depths = F.slice(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), 1, F.least(F.size(parts), F.lit(path_depth)))
    paths = F.transform(depths, lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.concat(F.array(host), parents, paths))))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, key, at date, action add or remove) to (list, key, valid_from, valid_to); valid_to is null while the entry stands.

    Repeated entries count once. Of two events of one key and day the removal is the later one. Entries with a null in list, key or day are left out, and a
    removal of what was never added does nothing.
    """
    events = entries.select("list", "key", "at", "action").dropna(subset=["list", "key", "at"]).distinct()
    order = Window.partitionBy("list", "key").orderBy("at", "action")
    return events.withColumn("valid_to", F.lead("at").over(order)).where((F.col("action") == "add") & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("at")))).select(
        "list", "key", F.col("at").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched", span_days: int = 30) -> DataFrame:
    """A row for each row of ``captures``: id, url, fetched day, n_active, n_block, decided_by, kept.

    Of the entries active on the day of the fetch, the longest key decides; of block and allow with equally long keys block does. A capture without an
    active entry is kept, and so is one with a null URL, host or day, which no entry covers. Repeated rows each get their verdict.
    """
    rows = captures.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(at_col).cast("date").alias("_at"))
    span = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / span_days)
    last = rows.agg(F.max("_at").alias("_at")).first()["_at"]  # one value: open intervals need no spans beyond it
    spans = validity_intervals(entries).withColumn("_end", F.least(F.coalesce(F.date_sub("valid_to", 1), F.lit(last).cast("date")), F.lit(last).cast("date")))
    spans = spans.where(F.col("_end") >= F.col("valid_from")).select("list", "key", "valid_from", "valid_to", F.explode(F.sequence(span(F.col("valid_from")), span(F.col("_end")))).alias("_span"))
    depth = entries.agg(F.max(F.size(F.split("key", "/")) - 1).alias("n")).first()["n"] or 0  # one value: the most path segments of an entry
    seen = rows.where(F.col("_at").isNotNull() & F.col("_url").isNotNull()).distinct().select("*", F.explode(url_keys(F.col("_url"), depth)).alias("key"), span(F.col("_at")).alias("_span"))
    active = seen.join(spans, ["key", "_span"]).where((F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to"))))
    rank = F.struct(F.length("key").alias("n"), (F.col("list") == "block").cast("int").alias("block"), F.col("key").alias("key"))
    verdicts = active.groupBy("_id", "_url", "_at").agg(F.count("*").alias("n_active"), F.sum((F.col("list") == "block").cast("long")).alias("n_block"), F.max(rank).alias("_top"))
    r, v = rows.alias("r"), verdicts.alias("v")
    return r.join(v, F.col("r._id").eqNullSafe(F.col("v._id")) & (F.col("r._url") == F.col("v._url")) & (F.col("r._at") == F.col("v._at")), "left").select(
        F.col("r._id").alias(id_col), F.col("r._url").alias(url_col), F.col("r._at").alias(at_col), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce("n_block", F.lit(0)).cast("long").alias("n_block"), F.col("_top.key").alias("decided_by"), (F.coalesce(F.col("_top.block"), F.lit(0)) == 0).alias("kept"))


def dated_pages(pages: DataFrame) -> DataFrame:
    """The table has no fetch dates: captures are taken as one year's crawl in the order of their ids."""
    return pages.select("page_id", "url", F.expr("date_add(DATE'2024-01-01', CAST(pmod(page_id * 7, 365) AS INT))").alias("fetched"))


def list_entries(pages: DataFrame) -> DataFrame:
    """The table has no lists either: every host, and every host with its first path segment, gets dated entries worked out from its letters."""
    hosts = pages.select(url_host(F.col("url")).alias("key")).where("key <> ''").distinct().selectExpr("key", "7 * length(key) + ascii(key) AS a", "5 * ascii(substr(key, 2, 1)) AS b")
    events = hosts.selectExpr("'block' AS list", "key", "a % 200 AS day", "'add' AS action").union(
        hosts.selectExpr("'block' AS list", "key", "a % 200 + 30 + b % 90 AS day", "'remove' AS action")).union(
        hosts.selectExpr("'block' AS list", "key", "a % 200 + 200 AS day", "'add' AS action"))
    first = pages.select(F.concat(url_host(F.col("url")), F.lit("/"), F.regexp_extract(F.coalesce(F.regexp_extract("url", PATH, 1), F.lit("")), r"^/([^/]+)", 1)).alias("key"))
    paths = first.where("key NOT LIKE '/%' AND key NOT LIKE '%/'").distinct().selectExpr("'allow' AS list", "key", "(11 * length(key) + ascii(key)) % 300 AS day", "'add' AS action")
    return events.union(paths).selectExpr("list", "key", "date_add(DATE'2024-01-01', CAST(day AS INT)) AS at", "action")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = input_rows(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(dated_pages(pages), list_entries(pages))


OP5_SQL = r"""
WITH c AS (SELECT page_id, url, CAST(DATE '2024-01-01' + CAST((page_id * 7) % 365 AS INTEGER) AS DATE) AS fetched,
    regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)', 1)), '^www\.', '') AS host,
    regexp_extract_all(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)', 1), '[^/]+') AS parts FROM pages),
h AS (SELECT DISTINCT host AS key, 7 * length(host) + ascii(host) AS a, 5 * ascii(substr(host, 2, 1)) AS b FROM c WHERE host <> ''),
ev AS (SELECT 'block' AS list, key, a % 200 AS day, 'add' AS action FROM h
  UNION SELECT 'block', key, a % 200 + 30 + b % 90, 'remove' FROM h
  UNION SELECT 'block', key, a % 200 + 200, 'add' FROM h
  UNION SELECT DISTINCT 'allow', k, (11 * length(k) + ascii(k)) % 300, 'add' FROM (SELECT host || '/' || parts[1] AS k FROM c WHERE host <> '' AND len(parts) > 0)),
iv AS (SELECT list, key, action, CAST(DATE '2024-01-01' + CAST(day AS INTEGER) AS DATE) AS valid_from,
    CAST(DATE '2024-01-01' + CAST(lead(day) OVER (PARTITION BY list, key ORDER BY day, action) AS INTEGER) AS DATE) AS valid_to FROM ev),
k AS (SELECT DISTINCT page_id, url, fetched, key FROM (
    SELECT page_id, url, fetched, host AS key FROM c WHERE host <> ''
    UNION ALL SELECT page_id, url, fetched, array_to_string(string_split(host, '.')[i:], '.') FROM (SELECT *, unnest(range(1, greatest(len(string_split(host, '.')), 2))) AS i FROM c WHERE host <> '')
    UNION ALL SELECT page_id, url, fetched, host || '/' || parts[1] FROM c WHERE host <> '' AND len(parts) >= 1
    UNION ALL SELECT page_id, url, fetched, host || '/' || parts[1] || '/' || parts[2] FROM c WHERE host <> '' AND len(parts) >= 2)),
a AS (SELECT k.page_id, k.url, k.fetched, k.key, iv.list, row_number() OVER (PARTITION BY k.page_id, k.url, k.fetched ORDER BY length(k.key) DESC, iv.list DESC, k.key DESC) AS rn
  FROM k JOIN iv ON k.key = iv.key AND iv.action = 'add' AND k.fetched >= iv.valid_from AND (iv.valid_to IS NULL OR k.fetched < iv.valid_to)),
v AS (SELECT page_id, url, fetched, count(*)::BIGINT AS n_active, count(*) FILTER (WHERE list = 'block')::BIGINT AS n_block,
    max(CASE WHEN rn = 1 THEN key END) AS decided_by, max(CASE WHEN rn = 1 AND list = 'block' THEN 1 ELSE 0 END) AS blocked FROM a GROUP BY page_id, url, fetched)
SELECT c.page_id, c.url, c.fetched, coalesce(v.n_active, 0)::BIGINT AS n_active, coalesce(v.n_block, 0)::BIGINT AS n_block, v.decided_by, coalesce(v.blocked, 0) = 0 AS kept
FROM c LEFT JOIN v ON c.page_id IS NOT DISTINCT FROM v.page_id AND c.url = v.url AND c.fetched = v.fetched
"""
