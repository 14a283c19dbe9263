"""Queries of the DataFrame operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendrel.functions import columns as C
from tendrel.operators import relational as R
from tendrel.plans.tables import VALUE_BANDS, band


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keep_one(spark, sf_dir):
    return R.keep_one(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], [F.desc("l_shipdate"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _versions(spark, sf_dir):
    return R.version_columns(_table(spark, sf_dir, "orders"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "version_number", "version_count", "is_latest")


def _grain(spark, sf_dir):
    return R.verify_grain(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])[0]


def _conflicts(spark, sf_dir):
    return R.conflict_fields(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"), ["l_orderkey", "l_linenumber"])


def _dense(spark, sf_dir):
    status, priority = ["F", "O", "P", "X"], ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return R.dense_group(_table(spark, sf_dir, "orders"), {"o_orderstatus": status, "o_orderpriority": priority}, [F.count("*").alias("orders")])


def _orphans(spark, sf_dir):
    return R.orphans(_table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]).select("c_custkey", "c_name")


def _top_share(spark, sf_dir):
    cents = _table(spark, sf_dir, "orders").select(F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return R.top_share(cents, "cents", 5).select("rows", F.round("value", 0).alias("value"))


def _bands(spark, sf_dir):
    c = (F.round(F.col("o_totalprice") * 100).cast("long") * 10)
    return _table(spark, sf_dir, "orders").groupBy(C.band(c, VALUE_BANDS, right=True).alias("value_band")).agg(F.count("*").alias("orders"))


def _orders(spark, sf_dir):
    return _table(spark, sf_dir, "orders")


def _two(c):
    """Two places, through a decimal so that halves go one way."""
    return F.round(c.cast("decimal(30,8)"), 2).cast("double")


def _scores(spark, sf_dir):
    value, days, usable = F.round(F.col("l_extendedprice") * 100).cast("long") * 1000, F.col("l_quantity") * 160, F.col("l_linenumber")
    method = F.when(F.col("l_returnflag") == "R", "Direct award").when(F.col("l_returnflag") == "A", "limited")
    rows = _table(spark, sf_dir, "lineitem").select(*[c.alias(f"s{v}_{n}") for v in (2, 3) for n, c in C.score_points(value, days, method, usable, v).items()])
    score = lambda v: sum((F.col(c) for c in rows.columns if c.startswith(f"s{v}_")), F.lit(0))
    return rows.select(score(2).alias("score_2"), score(3).alias("score_3")).groupBy("score_2", "score_3", C.score_category(F.col("score_3")).alias("category")).agg(F.count("*").alias("rows"))


def _review(spark, sf_dir):
    value, years = F.round(F.col("o_totalprice") * 100).cast("long") * 100, F.col("o_orderkey") % 15
    return _orders(spark, sf_dir).groupBy(C.review_category(value, years, F.when(F.col("o_orderpriority") == "1-URGENT", " Direct ")).alias("category")).agg(F.count("*").alias("orders"))


def _methods(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").groupBy(C.method_group(F.concat_ws(" ", F.lit("Open"), F.when(F.col("l_returnflag") == "R", "limited"))).alias("method_group")).agg(F.count("*").alias("rows"))


def _structures(spark, sf_dir):
    per_order = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.countDistinct(F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey"))).alias("n"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    return per_order.groupBy(C.supplier_structure(F.col("n")).alias("structure")).agg(F.count("*").alias("orders"), F.sum(F.floor(C.equal_share(F.col("cents"), F.col("n")))).cast("double").alias("shares"))


def _days(spark, sf_dir):
    joined = _table(spark, sf_dir, "lineitem").join(_orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
    start, end = F.col("o_orderdate"), F.col("l_shipdate")
    return joined.groupBy(C.whole_days(start, end).alias("days")).agg(F.count("*").alias("rows"), _two(F.max(C.duration_years(start, end))).alias("years"))


def _dates(spark, sf_dir):
    return _orders(spark, sf_dir).withColumns(C.year_month(F.col("o_orderdate"))).groupBy("year", "month", "month_name").agg(F.count("*").alias("orders"))


def _shares(spark, sf_dir):
    return R.share_by(_orders(spark, sf_dir), ["o_orderpriority"]).select("o_orderpriority", "rows", _two(F.col("share")).alias("share"))


def _thresholds(spark, sf_dir):
    cents = _orders(spark, sf_dir).select(F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return R.threshold_counts(cents, "cents", [10_000_000, 20_000_000, 90_000_000_000])


def _kpis(spark, sf_dir):
    return R.kpi_table(_orders(spark, sf_dir), {"orders": F.count("*"), "customers": F.countDistinct("o_custkey"), "open": F.count_if(F.col("o_orderstatus") == "O")})


def _fields(spark, sf_dir):
    out = R.profile_fields(_orders(spark, sf_dir), {"Key": "o_orderkey", "Customer": "o_custkey", "Method": "no_such_column"})
    return out.select("label", "present", "missing", "distinct_values")


def _in_year(spark, sf_dir):
    return R.in_year(_orders(spark, sf_dir), "o_orderdate", 1995).select("o_orderkey")


def _search(spark, sf_dir):
    return R.search(_table(spark, sf_dir, "customer"), "c_name", "customer#00000001").select("c_custkey", "c_name")


def _sequences(spark, sf_dir):
    return R.tag_sequences(_orders(spark, sf_dir), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus")


_PRICE = "CAST(round(l_extendedprice * 100) AS BIGINT) * 1000"
_POINTS = f"CASE WHEN {_PRICE} >= 1000000000 THEN 3 WHEN {_PRICE} >= 100000000 THEN 2 ELSE 0 END + CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END"
_SQL = {
    "p33_score_points": (_scores, f"SELECT score_2, score_3, CASE WHEN score_3 >= 6 THEN 'Priority review' WHEN score_3 >= 4 THEN 'High review' WHEN score_3 >= 2 THEN 'Moderate review' ELSE 'Lower review priority' END AS category, count(*) AS rows FROM (SELECT {_POINTS} + CASE WHEN round(CAST(l_quantity * 160 / 365.25 AS DECIMAL(20,8)), 2) >= 20 THEN 2 WHEN round(CAST(l_quantity * 160 / 365.25 AS DECIMAL(20,8)), 2) >= 10 THEN 1 ELSE 0 END + CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS score_2, {_POINTS} + CASE WHEN l_quantity * 160 >= 7305 THEN 2 WHEN l_quantity * 160 >= 3652.5 THEN 1 ELSE 0 END + CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END AS score_3 FROM lineitem) x GROUP BY ALL"),
    "p35_review_category": (_review, "SELECT CASE WHEN v >= 1000000000 AND y >= 10 AND o_orderpriority = '1-URGENT' THEN 'Priority' WHEN v >= 500000000 AND y >= 10 THEN 'High' WHEN v >= 100000000 AND y >= 10 THEN 'Moderate' ELSE 'Contextual' END AS category, count(*) AS orders FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) * 100 AS v, o_orderkey % 15 AS y FROM orders) x GROUP BY 1"),
    "p29_method_group": (_methods, "SELECT CASE WHEN l_returnflag = 'R' THEN 'Limited' ELSE 'Open' END AS method_group, count(*) AS rows FROM lineitem GROUP BY 1"),
    "p28_supplier_structure": (_structures, "SELECT CASE WHEN n = 1 THEN 'Single supplier' WHEN n > 1 THEN 'Multiple suppliers' ELSE 'No usable supplier' END AS structure, count(*) AS orders, CAST(sum(floor(CAST(cents AS DOUBLE) / nullif(n, 0))) AS DOUBLE) AS shares FROM (SELECT l_orderkey, count(DISTINCT CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey END) AS n, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem GROUP BY l_orderkey) x GROUP BY 1"),
    "p18_whole_days": (_days, "SELECT CAST(floor((epoch(l_shipdate) - epoch(o_orderdate)) / 86400) AS BIGINT) AS days, count(*) AS rows, CAST(round(CAST(max((epoch(l_shipdate) - epoch(o_orderdate)) / 86400.0 / 365.25) AS DECIMAL(30,8)), 2) AS DOUBLE) AS years FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"),
    "p17_year_month": (_dates, "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, monthname(o_orderdate) AS month_name, count(*) AS orders FROM orders GROUP BY 1, 2, 3"),
    "a02_share_by": (_shares, "SELECT o_orderpriority, count(*) AS rows, CAST(round(CAST(count(*) * 100 / CAST(sum(count(*)) OVER () AS DOUBLE) AS DECIMAL(30,8)), 2) AS DOUBLE) AS share FROM orders GROUP BY o_orderpriority"),
    "j07_threshold_counts": (_thresholds, "SELECT t.threshold, count(c.cents) AS rows, CAST(coalesce(sum(c.cents), 0) AS DOUBLE) AS value FROM (SELECT unnest([10000000, 20000000, 90000000000]) AS threshold) t LEFT JOIN (SELECT CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) c ON c.cents >= t.threshold GROUP BY t.threshold"),
    "a18_kpi_table": (_kpis, "SELECT 'orders' AS metric, CAST(count(*) AS DOUBLE) AS value FROM orders UNION ALL SELECT 'customers', count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'open', count(*) FROM orders WHERE o_orderstatus = 'O'"),
    "d02_profile_fields": (_fields, "SELECT 'Key' AS label, count(o_orderkey) AS present, count(*) - count(o_orderkey) AS missing, count(DISTINCT o_orderkey) AS distinct_values FROM orders UNION ALL SELECT 'Customer', count(o_custkey), count(*) - count(o_custkey), count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'Method', NULL, NULL, NULL"),
    "d25_check_pk": (lambda spark, sf_dir: R.check_pk(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]), "SELECT 0 AS null_rows, count(*) FILTER (WHERE n > 1) AS repeated_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) x"),
    "d27_check_versions": (lambda spark, sf_dir: R.check_versions(R.version_columns(_orders(spark, sf_dir), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")]), "o_custkey"), "SELECT 0 AS bad_numbers, 0 AS keys_without_one_latest"),
    "f01_in_year": (_in_year, "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1995"),
    "f07_search": (_search, "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'customer#00000001')"),
    "f12_outside_year": (lambda spark, sf_dir: R.outside_year(_orders(spark, sf_dir), "o_orderdate", 1995, ["o_orderstatus"]), "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus, count(*) AS rows FROM orders WHERE year(o_orderdate) <> 1995 GROUP BY 1, 2"),
    "a11_most_frequent": (lambda spark, sf_dir: R.most_frequent(_orders(spark, sf_dir), ["o_custkey"], "o_orderpriority"), "SELECT o_custkey, o_orderpriority, times FROM (SELECT o_custkey, o_orderpriority, count(*) AS times, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS rn FROM orders GROUP BY 1, 2) x WHERE rn = 1"),
    "a13_crosstab": (lambda spark, sf_dir: R.crosstab(_orders(spark, sf_dir), "o_orderpriority", "o_orderstatus", ["F", "O", "P"]), "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1"),
    "a15_group_size_histogram": (lambda spark, sf_dir: R.group_size_histogram(_table(spark, sf_dir, "lineitem"), ["l_orderkey"]), "SELECT size, count(*) AS groups FROM (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey) x GROUP BY size"),
    "w06_with_distinct_count": (lambda spark, sf_dir: R.with_distinct_count(_orders(spark, sf_dir), ["o_custkey"], "o_orderpriority").select("o_orderkey", "o_orderpriority_count"), "SELECT o_orderkey, n AS o_orderpriority_count FROM orders JOIN (SELECT o_custkey AS k, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1) x ON o_custkey = k"),
    "w10_sequences": (_sequences, "SELECT sequence, count(*) AS keys FROM (SELECT o_custkey, string_agg(o_orderstatus, ' > ' ORDER BY o_orderdate, o_orderkey) AS sequence FROM orders GROUP BY 1) x GROUP BY 1"),
    "u06_exact_duplicates": (lambda spark, sf_dir: R.count_exact_duplicates(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")), "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows, CAST(sum(n) - count(*) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey) x"),
    "w05_keep_one": (_keep_one, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem) x WHERE rn = 1"),
    "w04_version_columns": (_versions, "SELECT *, version_number = version_count AS is_latest FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS version_number, count(*) OVER (PARTITION BY o_custkey) AS version_count FROM orders) x"),
    "d04_verify_grain": (_grain, "SELECT count(*) AS keys, count(*) FILTER (WHERE n > 1) AS repeated, count(*) FILTER (WHERE n > 1 AND c = 1) AS identical, count(*) FILTER (WHERE c > 1) AS conflicting FROM (SELECT l_orderkey, l_linenumber, sum(n) AS n, count(*) AS c FROM (SELECT *, count(*) AS n FROM lineitem GROUP BY ALL) y GROUP BY l_orderkey, l_linenumber) x"),
    "d05_conflicting_columns": (_conflicts, "SELECT l_orderkey, l_linenumber, n AS rows, concat_ws('; ', CASE WHEN a > 1 THEN 'l_returnflag' END, CASE WHEN b > 1 THEN 'l_linestatus' END, CASE WHEN c > 1 THEN 'l_shipdate' END) AS fields FROM (SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT l_returnflag) AS a, count(DISTINCT l_linestatus) AS b, count(DISTINCT l_shipdate) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber) x WHERE n > 1"),
    "a16_dense_group": (_dense, "SELECT s.o_orderstatus, p.o_orderpriority, count(o.o_orderkey) AS orders FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS o_orderstatus) s CROSS JOIN (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW']) AS o_orderpriority) p LEFT JOIN orders o ON o.o_orderstatus = s.o_orderstatus AND o.o_orderpriority = p.o_orderpriority GROUP BY s.o_orderstatus, p.o_orderpriority"),
    "j05_orphans": (_orphans, "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "t04_top_share": (_top_share, "SELECT count(*) AS rows, CAST(sum(cents) AS DOUBLE) AS value FROM (SELECT CAST(round(o_totalprice * 100) AS BIGINT) AS cents, row_number() OVER (ORDER BY o_totalprice DESC) AS rn, count(*) OVER () AS n FROM orders) x WHERE rn <= floor(n * 5 / 100)"),
    "p24_right_closed_bands": (_bands, f"SELECT {band('CAST(round(o_totalprice * 100) AS BIGINT) * 10', VALUE_BANDS, right=True)} AS value_band, count(*) AS orders FROM orders GROUP BY 1"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _SQL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _SQL.items()}
