"""Notice files made of the given orders and lines, in two headers and two encodings, and what the readers make of them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendrel.operators.ranking import shared_folder
from tendrel.sources import notices

R = notices.RELEASE
YEAR = 1995
NARROW, WIDE = 3, 7  # awards of a notice in files of either header


def write_notices(spark: SparkSession, sf_dir: str) -> str:
    """Write a notice an order, those with at most three lines as UTF-8, the others as Latin-1 under a wider header, to a new shared folder. Returns the pattern of the files."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = F.col("o_orderkey").cast("string")
    orders = table("orders").select(
        "o_orderkey", F.concat(F.lit("ocds-"), key).alias(f"{R}ocid"), key.alias(f"{R}id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(f"{R}date"),
        F.col("o_orderstatus").alias(f"{R}tag/0"), F.concat(F.lit('Order "'), key, F.lit('",\nwhole')).alias(f"{R}tender/title"), F.concat(F.lit("Café "), F.col("o_custkey").cast("string")).alias(f"{R}buyer/name"))
    lines = table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).pivot("l_linenumber", list(range(1, WIDE + 1))).agg(
        F.min(F.col("l_extendedprice").cast("decimal(14,2)")).alias("value"), F.min("l_suppkey").alias("supplier"))
    names = ["o_orderkey"]
    for i in range(WIDE):
        there = F.col(f"{i + 1}_value").isNotNull()
        award = {
            f"{R}awards/{i}/id": F.when(there, F.concat(F.col("o_orderkey").cast("string"), F.lit(f"-{i + 1}"))), f"{R}awards/{i}/value/amount": F.col(f"{i + 1}_value").cast("string"),
            f"{R}awards/{i}/suppliers/0/id": F.when(F.col(f"{i + 1}_supplier") % 5 > 0, F.concat(F.lit("GB-COH-"), F.col(f"{i + 1}_supplier").cast("string"))),
            f"{R}awards/{i}/suppliers/0/name": F.concat(F.lit("Supplier, "), F.col(f"{i + 1}_supplier").cast("string")),
        }
        lines, names = lines.withColumns(award), names + list(award)
    later = [c for c in names if int((c.split("/") + ["-1"] * 4)[3] if c.startswith(f"{R}awards/") else -1) >= NARROW]
    whole = orders.join(lines.select(*[f"`{c}`" for c in names]), "o_orderkey")
    more = F.coalesce(*[F.col(f"`{c}`") for c in later])
    folder = f"{shared_folder(spark)}/notices-{uuid.uuid4().hex}"
    for part, rows, encoding in (("narrow", whole.where(more.isNull()).drop(*later), "UTF-8"), ("wide", whole.where(more.isNotNull()).withColumn("notes, free", F.lit("none")), "ISO-8859-1")):
        rows.drop("o_orderkey").write.option("header", True).option("escape", '"').option("encoding", encoding).csv(f"{folder}/{part}")
    return f"{folder}/*/part-*.csv"


def _year(name: str, columns: tuple[str, ...]) -> Callable:
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = notices.normalise(notices.read_notices(spark, write_notices(spark, sf_dir)), YEAR)[name].select(*columns)
        return out.withColumn("award_value", F.col("award_value").cast("double")) if "award_value" in columns else out

    return read


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.schema_complexity(notices.discover_headers(spark, write_notices(spark, sf_dir))).select("awards", "suppliers")


def _encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.discover_headers(spark, write_notices(spark, sf_dir)).select("encoding", F.size(notices.header_fields(F.col("header"))).alias("columns"), F.element_at(notices.header_fields(F.col("header")), -1).alias("last")).distinct()


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = notices.clean_records(notices.read_notices(spark, write_notices(spark, sf_dir)))
    return out.select("ocid", "release_date", "tender_title", "buyer_name", "award_id", F.col("award_value").cast("double").alias("award_value"), "supplier_id", "supplier_name", "month_name", "has_award", "has_supplier", "has_contract_dates")


_LINES = "(SELECT l_orderkey, l_linenumber, min(CAST(l_extendedprice AS DECIMAL(14,2))) AS value, min(l_suppkey) AS suppkey FROM lineitem GROUP BY ALL)"
_SUPPLIER = "CASE WHEN suppkey % 5 > 0 THEN 'GB-COH-' || suppkey END AS supplier_id, 'Supplier, ' || suppkey AS supplier_name"
_OF_YEAR = f"{_LINES} l JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) = {YEAR}"
_MOST = "(SELECT max(l_linenumber) AS most FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey)"
_RELEASE = "'ocds-' || o_orderkey AS ocid, CAST(o_orderdate AS TIMESTAMP) AS release_date, 'Order \"' || o_orderkey || '\",' || chr(10) || 'whole' AS tender_title, 'Café ' || o_custkey AS buyer_name"
_SQL: dict[str, tuple[Callable, str]] = {
    "s03_headers": (_encodings, f"""SELECT DISTINCT CASE WHEN most <= {NARROW} THEN 'UTF-8' ELSE 'ISO-8859-1' END AS encoding, CASE WHEN most <= {NARROW} THEN {6 + 4 * NARROW} ELSE {7 + 4 * WIDE} END AS columns,
      CASE WHEN most <= {NARROW} THEN '{R}awards/{NARROW - 1}/suppliers/0/name' ELSE 'notes, free' END AS "last" FROM {_MOST} m"""),
    "n06_schema_complexity": (_headers, f"SELECT DISTINCT CASE WHEN most <= {NARROW} THEN {NARROW} ELSE {WIDE} END AS awards, 1 AS suppliers FROM {_MOST} m"),
    "n01_releases": (_year("releases", ("ocid", "release_id", "release_date", "release_tag", "tender_title", "buyer_name")),
      f"SELECT {_RELEASE}, CAST(o_orderkey AS VARCHAR) AS release_id, o_orderstatus AS release_tag FROM orders WHERE year(o_orderdate) = {YEAR} AND o_orderkey IN (SELECT l_orderkey FROM lineitem)"),
    "n02_awards": (_year("awards", ("ocid", "release_id", "award_id", "award_index", "award_value")),
      f"SELECT 'ocds-' || o_orderkey AS ocid, CAST(o_orderkey AS VARCHAR) AS release_id, o_orderkey || '-' || l_linenumber AS award_id, CAST(l_linenumber - 1 AS INTEGER) AS award_index, CAST(value AS DOUBLE) AS award_value FROM {_OF_YEAR}"),
    "n03_award_suppliers": (_year("award_suppliers", ("ocid", "release_id", "award_id", "award_index", "supplier_index", "supplier_id", "supplier_name")),
      f"SELECT 'ocds-' || o_orderkey AS ocid, CAST(o_orderkey AS VARCHAR) AS release_id, o_orderkey || '-' || l_linenumber AS award_id, CAST(l_linenumber - 1 AS INTEGER) AS award_index, 0 AS supplier_index, {_SUPPLIER} FROM {_OF_YEAR}"),
    "d35_clean_records": (_clean, f"""SELECT {_RELEASE}, CASE WHEN value IS NOT NULL THEN o_orderkey || '-1' END AS award_id, CAST(value AS DOUBLE) AS award_value, {_SUPPLIER}, monthname(o_orderdate) AS month_name, value IS NOT NULL AS has_award,
      suppkey IS NOT NULL AS has_supplier, false AS has_contract_dates FROM orders LEFT JOIN {_LINES} l ON l_orderkey = o_orderkey AND l_linenumber = 1 WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)"""),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _SQL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _SQL.items()}
