"""Raw observations out of the given tables, with planted copies, and what resolution and the quality gate make of them. The SQL for DuckDB is written apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

from tendrel.operators import gate
from tendrel.operators import resolution as R
from tendrel.operators.ranking import settle
from tendrel.operators.relational import top_missing, validated_join
from tendrel.sources.tables import load_table
from tendrel.streaming import ingest


def _seen(times, first, again):
    """How often a row is observed, and in which file: its first observation, then copies; a copy may lack its file."""
    return F.explode(F.sequence(F.lit(0), times)), F.when(F.col("copy") == 0, first).otherwise(again)


def raw_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, text = F.col("o_orderkey"), lambda c: F.col(c).cast("string")
    copies, source = _seen(F.when(key % 9 == 0, 1).otherwise(0), F.concat(F.lit("first-"), (key % 365).cast("string")), F.when(key % 27 > 0, F.concat(F.lit("again-"), (key % 365).cast("string"))))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").where(F.floor(key / 3) % 97 != 13).withColumn("copy", copies)
    return rows.select(
        text("o_orderkey").alias("release_id"), F.concat(F.lit("ocid-"), F.floor(key / 3).cast("string")).alias("ocid"), F.when(key % 50 > 0, F.col("o_orderdate")).alias("release_date"),
        F.concat(F.lit("Order "), text("o_orderkey")).alias("tender_title"), F.col("o_orderstatus").alias("tender_status"), F.when(F.col("o_custkey") % 50 > 0, text("o_custkey")).alias("buyer_id"),
        F.col("o_orderpriority").alias("procurement_method"), F.when(key % 6 > 0, F.col("o_totalprice").cast("decimal(14,2)")).alias("tender_value"), source.alias("source_file"))


def _lines(spark: SparkSession, sf_dir: str, times) -> tuple[DataFrame, dict]:
    copies, source = _seen(times, F.lit("first"), F.lit("again"))
    award = F.col("l_orderkey").cast("string")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("copy", copies), {"award_id": award, "release_id": F.concat(award, F.lit("-"), F.col("l_linenumber").cast("string")), "source_file": source}


def raw_awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, named = _lines(spark, sf_dir, F.when(F.col("l_partkey") % 7 == 0, 2).otherwise(0))
    price = F.col("l_extendedprice").cast("decimal(14,2)")
    return rows.select(
        named["award_id"].alias("award_id"), named["release_id"].alias("release_id"), F.concat(F.lit("ocid-"), F.floor(F.col("l_orderkey") / 3).cast("string")).alias("ocid"),
        F.when(F.col("l_partkey") % 41 > 0, F.col("l_shipdate")).alias("release_date"), F.when(F.col("l_partkey") % 53 == 0, -price).when(F.col("l_partkey") % 59 > 0, price).cast("decimal(14,2)").alias("award_value"),
        F.col("l_shipdate").alias("contract_start"), (F.col("l_shipdate") + F.make_dt_interval(F.col("l_quantity").cast("int") * 160 - 200)).alias("contract_end"),
        F.col("l_linestatus").alias("award_status"), named["source_file"].alias("source_file"))


def raw_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, named = _lines(spark, sf_dir, F.when(F.col("l_suppkey") % 6 == 0, 1).otherwise(0))
    key = F.col("l_suppkey")
    return rows.select(
        named["award_id"].alias("award_id"), named["release_id"].alias("release_id"), F.col("l_linenumber").alias("supplier_index"),
        F.when(key % 10 == 0, "GB-COH-0").when(key % 10 > 1, F.concat(F.lit("GB-COH-"), key.cast("string"))).alias("supplier_id"),
        F.when(key % 41 != 11, F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("SUPPLIER  "), key.cast("string"), F.lit(" LIMITED "))).otherwise(F.concat(F.lit("Supplier "), key.cast("string"), F.lit(" Ltd.")))).alias("supplier_name"),
        named["source_file"].alias("source_file"))


def resolved_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five tables, unwritten: in one plan over them Spark shuffles the rows of each once and drops the columns that nothing reads."""
    releases, relationships = R.resolve_releases(raw_releases(spark, sf_dir)), R.resolve_relationships(raw_relationships(spark, sf_dir))
    return {
        "procurements": R.build_procurements(releases), "releases": releases, "awards": R.resolve_award_versions(raw_awards(spark, sf_dir)),
        "relationships": relationships, "suppliers": R.supplier_master(relationships),
    }


def _doubles(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


def _log(spark, sf_dir):
    raw = {"releases": raw_releases(spark, sf_dir), "awards": raw_awards(spark, sf_dir), "relationships": raw_relationships(spark, sf_dir)}
    by = {"releases": R.resolve_releases, "awards": lambda df: R.drop_copies(df, ("award_id", "release_id")), "relationships": lambda df: R.drop_copies(df, ("award_id", "release_id", "supplier_index"))}
    return R.resolution_log({k: (df, by[k](df)) for k, df in raw.items()})


def _gate(spark, sf_dir):
    return gate.quality_gate(**resolved_tables(spark, sf_dir))


def _counts(spark, sf_dir):
    releases = R.resolve_releases(raw_releases(spark, sf_dir))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    return gate.expect_counts(
        {"releases": releases, "procurements": R.build_procurements(releases), "awards": R.drop_copies(raw_awards(spark, sf_dir), ("award_id", "release_id")).select("award_id", "release_id").distinct()},
        {"releases": orders, "procurements": orders.select(F.floor(F.col("o_orderkey") / 3)).distinct(), "awards": lines.distinct()})


def _validated(spark, sf_dir):
    awards = R.drop_copies(raw_awards(spark, sf_dir), ("award_id", "release_id")).select("award_id", "release_id", "ocid", "award_status")
    return validated_join(awards, R.build_procurements(R.resolve_releases(raw_releases(spark, sf_dir))).select("ocid", "tender_status", "procurement_method"), ["ocid"], "left")


def _missing(spark, sf_dir):
    awards = R.drop_copies(raw_awards(spark, sf_dir), ("award_id", "release_id"))
    return top_missing(awards.join(R.build_procurements(R.resolve_releases(raw_releases(spark, sf_dir))).drop("tender_title"), "ocid", "left"), 15)


_LINE = StructType([StructField("l_quantity", IntegerType()), StructField("l_orderkey", LongType(), False), StructField("l_shipdate", TimestampType()), StructField("l_returnflag", StringType(), False)])


def _texts(spark, sf_dir):
    """Lines as texts, some of which are no numbers, no dates, or blank."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key, text = F.col("l_orderkey"), lambda c: F.col(c).cast("string")
    return rows.select(
        F.when(key % 11 == 0, "many").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("l_quantity"), F.when(key % 13 > 0, F.concat(F.lit(" "), text("l_orderkey"))).otherwise(" ").alias("l_orderkey"),
        F.when(key % 17 == 0, "soon").otherwise(text("l_shipdate")).alias("l_shipdate"), F.col("l_returnflag"), F.lit("left out").alias("comment"))


def _rejects(spark, sf_dir):
    return load_table(_texts(spark, sf_dir), _LINE)[1].groupBy("column", "reason").agg(F.count("*").alias("rows"))


def _ingested(spark, sf_dir):
    """The award versions of three batches, of which the last has what the first has."""
    rows = raw_awards(spark, sf_dir)
    table = f"{settle(spark.range(1)).inputFiles()[0].rsplit('/', 1)[0]}-table"
    for part in (0, 1, 2, 0):
        ingest.upsert_versions(spark, rows.where(F.crc32(F.concat("release_id", "award_status")) % 3 == part), table)
    out = _doubles(ingest.read_versions(spark, table))
    return out.groupBy("award_id").agg(F.count("*").alias("rows"), F.max("version_count").alias("versions"), F.count_if("is_latest").alias("latest"), F.max("version_number").alias("last"), F.sum(F.round(F.col("award_value") * 100).cast("long")).alias("pence"))


_ORDERS = """(SELECT CAST(o_orderkey AS VARCHAR) AS release_id, 'ocid-' || CAST(o_orderkey // 3 AS VARCHAR) AS ocid, CASE WHEN o_orderkey % 50 > 0 THEN o_orderdate END AS release_date,
  'Order ' || CAST(o_orderkey AS VARCHAR) AS tender_title, o_orderstatus AS tender_status, CASE WHEN o_custkey % 50 > 0 THEN CAST(o_custkey AS VARCHAR) END AS buyer_id, o_orderpriority AS procurement_method,
  CASE WHEN o_orderkey % 6 > 0 THEN CAST(o_totalprice AS DECIMAL(14,2)) END AS tender_value,
  CASE WHEN o_orderkey % 27 > 0 AND o_orderkey % 9 = 0 THEN 'again-' ELSE 'first-' END || CAST(o_orderkey % 365 AS VARCHAR) AS source_file FROM orders WHERE (o_orderkey // 3) % 97 <> 13)"""
_AWARDS = """(SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS award_id, l_orderkey || '-' || l_linenumber AS release_id, 'ocid-' || CAST(l_orderkey // 3 AS VARCHAR) AS ocid,
  CASE WHEN l_partkey % 41 > 0 THEN l_shipdate END AS release_date, CASE WHEN l_partkey % 53 = 0 THEN -CAST(l_extendedprice AS DECIMAL(14,2)) WHEN l_partkey % 59 > 0 THEN CAST(l_extendedprice AS DECIMAL(14,2)) END AS award_value,
  l_shipdate AS contract_start, l_shipdate + to_days(CAST(l_quantity AS INTEGER) * 160 - 200) AS contract_end, l_linestatus AS award_status FROM lineitem)"""
# rows equal in content are one, from the file 'again' if any of them was seen again
_AWARD_FILES = """(SELECT CAST(l_orderkey AS VARCHAR) AS award_id, l_orderkey || '-' || l_linenumber AS release_id, 'ocid-' || CAST(l_orderkey // 3 AS VARCHAR) AS ocid,
  CASE WHEN l_partkey % 41 > 0 THEN l_shipdate END AS release_date, CASE WHEN l_partkey % 53 = 0 THEN -CAST(l_extendedprice AS DECIMAL(14,2)) WHEN l_partkey % 59 > 0 THEN CAST(l_extendedprice AS DECIMAL(14,2)) END AS award_value,
  l_shipdate AS contract_start, l_shipdate + to_days(CAST(l_quantity AS INTEGER) * 160 - 200) AS contract_end, l_linestatus AS award_status,
  min(CASE WHEN l_partkey % 7 = 0 THEN 'again' ELSE 'first' END) AS source_file FROM lineitem GROUP BY ALL)"""
_VERSIONS = f"""(SELECT *, award_version_number = award_version_count AS is_latest_award_version FROM (SELECT *,
  CAST(row_number() OVER (PARTITION BY award_id ORDER BY release_date NULLS FIRST, release_id NULLS FIRST, ocid NULLS FIRST, award_value NULLS FIRST, contract_start NULLS FIRST, contract_end NULLS FIRST, award_status NULLS FIRST) AS INTEGER) AS award_version_number,
  count(*) OVER (PARTITION BY award_id) AS award_version_count FROM {_AWARD_FILES} a) b)"""
_LINKS = """(SELECT *, CASE WHEN supplier_id_quality = 'unreliable' THEN 'unreliable_id_name_based' WHEN supplier_id_name_count > 1 THEN 'id_multiple_names_review' ELSE 'confirmed_id' END AS supplier_identity_flag FROM (
  SELECT k.*, n.supplier_id_name_count FROM (
    SELECT *, CASE WHEN supplier_id_quality = 'usable' THEN 'SUP_ID:' || upper(trim(supplier_id)) WHEN coalesce(supplier_name_normalized, '') <> '' THEN 'NAME:' || supplier_name_normalized
      ELSE 'UNKNOWN:' || award_id || ':' || supplier_index END AS supplier_key FROM (
      SELECT *, award_id || '|' || release_id || '|' || supplier_index AS relationship_observation_key, upper(trim(regexp_replace(supplier_name, '\\s+', ' ', 'g'))) AS supplier_name_normalized,
        CASE WHEN supplier_id IS NULL OR upper(trim(supplier_id)) IN ('GB-COH-0', 'GB-COH-NA', 'NA', 'N/A', 'NONE', 'NULL', '') THEN 'unreliable' ELSE 'usable' END AS supplier_id_quality FROM (
        SELECT CAST(l_orderkey AS VARCHAR) AS award_id, l_orderkey || '-' || l_linenumber AS release_id, l_linenumber AS supplier_index,
          CASE WHEN l_suppkey % 10 = 0 THEN 'GB-COH-0' WHEN l_suppkey % 10 > 1 THEN 'GB-COH-' || l_suppkey END AS supplier_id,
          CASE WHEN l_suppkey % 41 = 11 THEN NULL WHEN l_partkey % 3 = 0 THEN 'SUPPLIER  ' || l_suppkey || ' LIMITED ' ELSE 'Supplier ' || l_suppkey || ' Ltd.' END AS supplier_name,
          min(CASE WHEN l_suppkey % 6 = 0 THEN 'again' ELSE 'first' END) AS source_file FROM lineitem GROUP BY ALL) a) b) k
  LEFT JOIN (SELECT supplier_id AS id, count(DISTINCT upper(trim(regexp_replace(supplier_name, '\\s+', ' ', 'g')))) AS supplier_id_name_count FROM (
    SELECT CASE WHEN l_suppkey % 10 > 1 THEN 'GB-COH-' || l_suppkey END AS supplier_id,
      CASE WHEN l_suppkey % 41 = 11 THEN NULL WHEN l_partkey % 3 = 0 THEN 'SUPPLIER  ' || l_suppkey || ' LIMITED ' ELSE 'Supplier ' || l_suppkey || ' Ltd.' END AS supplier_name FROM lineitem) GROUP BY 1) n
    ON k.supplier_id_quality = 'usable' AND k.supplier_id = n.id) z)"""
_MASTER = f"""(SELECT supplier_key, min(CASE WHEN supplier_id_quality = 'usable' THEN supplier_id END) AS supplier_id, count(DISTINCT supplier_name_normalized) AS reported_name_count, count(*) AS relationship_count,
  CASE WHEN min(CASE WHEN supplier_id_quality = 'usable' THEN supplier_id END) IS NULL THEN 'unreliable_or_missing' ELSE 'usable' END AS supplier_id_quality,
  CASE WHEN count(DISTINCT supplier_name_normalized) > 1 THEN 'review_name_variation' ELSE 'no_name_conflict' END AS identity_review_flag,
  (SELECT x.name FROM (SELECT supplier_key AS k, supplier_name_normalized AS name, row_number() OVER (PARTITION BY supplier_key ORDER BY count(*) DESC, supplier_name_normalized) AS rn FROM {_LINKS} y
    WHERE supplier_name_normalized IS NOT NULL GROUP BY 1, 2) x WHERE x.k = l.supplier_key AND rn = 1) AS canonical_supplier_name FROM {_LINKS} l GROUP BY supplier_key)"""
_PROCUREMENTS = f"""(SELECT ocid, tender_title, tender_status, buyer_id, procurement_method, tender_value FROM (
  SELECT *, row_number() OVER (PARTITION BY ocid ORDER BY release_date DESC NULLS LAST, release_id DESC) AS rn FROM {_ORDERS} o) WHERE rn = 1)"""


def _check(category: str, test: str, value: str, source: str, bad: str = "FAIL", expected: str = "0", notes: str = "''") -> str:
    status = f"'{bad}'" if bad == "INFO" else f"CASE WHEN v = 0 THEN 'PASS' ELSE '{bad}' END"
    return f"SELECT '{category}' AS category, '{test}' AS test, {status} AS status, v::BIGINT AS value, '{expected}' AS expected, {notes} AS notes FROM (SELECT {value} AS v, count(*) AS n FROM {source}) q"


def _gate_sql() -> str:
    sources = {"procurements": _PROCUREMENTS + " t", "releases": _ORDERS + " t", "awards": _VERSIONS + " t", "relationships": _LINKS + " t", "suppliers": _MASTER + " t"}
    null = lambda c: f"count(*) - count({c})"
    unique = lambda *c: f"count(*) - count(DISTINCT ({', '.join(c)}))"
    out = [
        _check("Primary keys", "procurements.ocid.null", null("ocid"), sources["procurements"]), _check("Primary keys", "procurements.ocid.duplicate", unique("ocid"), sources["procurements"]),
        _check("Primary keys", "releases.release_id.null", null("release_id"), sources["releases"]), _check("Primary keys", "releases.release_id.duplicate", unique("release_id"), sources["releases"]),
        _check("Primary keys", "awards.award_id.null", null("award_id"), sources["awards"]), _check("Primary keys", "awards.release_id.null", null("release_id"), sources["awards"]),
        _check("Primary keys", "awards.award_id_release_id.duplicate", unique("award_id", "release_id"), sources["awards"]),
        _check("Primary keys", "suppliers.supplier_key.null", null("supplier_key"), sources["suppliers"]), _check("Primary keys", "suppliers.supplier_key.duplicate", unique("supplier_key"), sources["suppliers"]),
        _check("Relationship grain", "award_release_supplier_index_duplicate", unique("award_id", "release_id", "supplier_index"), sources["relationships"]),
        *[_check("Award lifecycle", f"{c}.null", null(c), sources["awards"]) for c in ("award_version_number", "award_version_count", "is_latest_award_version")],
        _check("Award lifecycle", "award_version_number.invalid", "count(*) FILTER (WHERE award_version_number <= 0)", sources["awards"]),
        _check("Award lifecycle", "exactly_one_latest_version_per_award", "count(*)", f"(SELECT award_id FROM {sources['awards']} GROUP BY award_id HAVING count(*) FILTER (WHERE is_latest_award_version) <> 1) w"),
        _check("Numeric validity", "negative_tender_values", "count(*) FILTER (WHERE tender_value < 0)", sources["procurements"], "REVIEW"),
        _check("Numeric validity", "negative_award_values", "count(*) FILTER (WHERE award_value < 0)", sources["awards"], "REVIEW"),
        _check("Date validity", "contract_end_before_start", "count(*) FILTER (WHERE contract_end < contract_start)", sources["awards"], "REVIEW"),
        _check("Supplier identity", "relationships_flagged_multiple_names", "count(*) FILTER (WHERE supplier_identity_flag = 'id_multiple_names_review')", sources["relationships"], "INFO", "review"),
        _check("Supplier identity", "relationships_unreliable_ids", "count(*) FILTER (WHERE supplier_identity_flag = 'unreliable_id_name_based')", sources["relationships"], "INFO", "review"),
        _check("Referential integrity", "release_to_procurement", "count(*)", f"(SELECT 1 FROM {sources['releases']} WHERE ocid NOT IN (SELECT ocid FROM {_PROCUREMENTS} p)) w"),
        _check("Referential integrity", "award_to_procurement", "count(*)", f"(SELECT 1 FROM {sources['awards']} WHERE ocid NOT IN (SELECT ocid FROM {_PROCUREMENTS} p)) w"),
        _check("Referential integrity", "relationship_to_award", "count(*)", f"(SELECT 1 FROM {sources['relationships']} WHERE release_id NOT IN (SELECT release_id FROM {_AWARDS} p)) w"),
        _check("Referential integrity", "relationship_to_supplier", "count(*)", f"(SELECT 1 FROM {sources['relationships']} WHERE supplier_key IS NULL) w"),
    ]
    missing = {"procurements": ("buyer_id", "procurement_method", "tender_value"), "releases": ("ocid", "release_date"), "awards": ("award_value", "contract_start", "contract_end"),
               "relationships": ("supplier_id", "supplier_name"), "suppliers": ("supplier_id", "canonical_supplier_name")}
    shown = "CAST(CAST(round(CAST(100 * v / n::DOUBLE AS DECIMAL(30,8)), 2) AS DECIMAL(10,2)) AS VARCHAR) || '% missing'"
    out += [_check("Completeness", f"{t}.{c}.missing", null(c), sources[t], "INFO", "source-dependent", shown) for t, cs in missing.items() for c in cs]
    columns = {"procurements": 6, "releases": 9, "awards": 12, "relationships": 12, "suppliers": 7}
    out += [_check("Structure", f"{t}.row_count", "count(*)", sources[t], "INFO", "documented") for t in sources]
    out += [_check("Structure", f"{t}.column_count", f"(SELECT count(*) FROM (DESCRIBE SELECT * FROM {sources[t]}))", sources[t], "INFO", "documented") for t in columns]
    every = " UNION ALL ".join(out)
    return f"""WITH e AS MATERIALIZED ({every}) SELECT * FROM e UNION ALL SELECT 'Overall', 'quality_gate', CASE WHEN count(*) FILTER (WHERE status = 'FAIL') > 0 THEN 'FAIL'
      WHEN count(*) FILTER (WHERE status = 'REVIEW') > 0 THEN 'REVIEW' ELSE 'PASS' END, count(*) FILTER (WHERE status = 'FAIL'), '0', count(*) FILTER (WHERE status = 'REVIEW') || ' to review' FROM e"""


_MISSING = [("award_id", "a"), ("release_id", "a"), ("ocid", "a"), ("release_date", "a"), ("award_value", "a"), ("contract_start", "a"), ("contract_end", "a"), ("award_status", "a"), ("source_file", "a"),
            ("tender_status", "p"), ("buyer_id", "p"), ("procurement_method", "p"), ("tender_value", "p")]
_SQL: dict[str, tuple[Callable, str]] = {
    "d18_resolved_releases": (lambda s, d: _doubles(R.resolve_releases(raw_releases(s, d))), f"SELECT * REPLACE (CAST(tender_value AS DOUBLE) AS tender_value) FROM {_ORDERS} o"),
    "d19_resolved_award_versions": (lambda s, d: _doubles(R.resolve_award_versions(raw_awards(s, d))), f"SELECT * REPLACE (CAST(award_value AS DOUBLE) AS award_value) FROM {_VERSIONS} v"),
    "d20_resolved_relationships": (lambda s, d: R.resolve_relationships(raw_relationships(s, d)), f"SELECT * FROM {_LINKS} k"),
    "d21_resolved_suppliers": (lambda s, d: R.supplier_master(R.resolve_relationships(raw_relationships(s, d))), f"SELECT * FROM {_MASTER} m"),
    "d22_resolved_procurements": (lambda s, d: _doubles(R.build_procurements(R.resolve_releases(raw_releases(s, d)))), f"SELECT * REPLACE (CAST(tender_value AS DOUBLE) AS tender_value) FROM {_PROCUREMENTS} p"),
    "d23_resolution_counts": (_log, f"""SELECT unnest(['release_duplicates', 'award_versions', 'supplier_relationship_duplicates', 'unreliable_supplier_ids', 'supplier_name_variations', 'award_lifecycle_updates']) AS issue_type,
      unnest(['one row a release_id, of the least source file', 'rows equal in all but source_file at award_id and release_id become one', 'rows equal in all but source_file at award_id, release_id and supplier_index become one',
        'placeholder ids are no keys; the normalised name is', 'all names of an id stay, the id is flagged', 'rows of an award that differ are numbered as versions']) AS rule,
      unnest(['deduplicated', 'preserved', 'deduplicated_exact_only', 'name_based_identity', 'preserved_and_flagged', 'preserved']) AS action,
      unnest([(SELECT count(*) FROM orders WHERE o_orderkey % 9 = 0 AND (o_orderkey // 3) % 97 <> 13), (SELECT sum(CASE WHEN l_partkey % 7 = 0 THEN 3 ELSE 1 END) FROM lineitem) - (SELECT count(*) FROM {_AWARDS} a),
        (SELECT sum(CASE WHEN l_suppkey % 6 = 0 THEN 2 ELSE 1 END) FROM lineitem) - (SELECT count(*) FROM {_LINKS} k), 0, 0, 0])::BIGINT AS rows_removed"""),
    "d31_gate_with_verdict": (_gate, _gate_sql()),
    "d32_counts_against_expected": (_counts, """SELECT name, actual, expected, actual - expected AS difference, CASE WHEN actual = expected THEN 'PASS' ELSE 'FAIL' END AS status FROM (
      SELECT 'releases' AS name, (SELECT count(*) FROM orders WHERE (o_orderkey // 3) % 97 <> 13) AS actual, (SELECT count(*) FROM orders) AS expected
      UNION ALL SELECT 'procurements', (SELECT count(DISTINCT o_orderkey // 3) FROM orders WHERE (o_orderkey // 3) % 97 <> 13), (SELECT count(DISTINCT o_orderkey // 3) FROM orders)
      UNION ALL SELECT 'awards', (SELECT count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem), (SELECT count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem)) x"""),
    "d39_top_missing": (_missing, f"""SELECT name AS field, missing, CAST(round(CAST(100 * missing / n::DOUBLE AS DECIMAL(30,8)), 2) AS DOUBLE) AS missing_percent FROM ({' UNION ALL '.join(
      f"SELECT '{c}' AS name, count(*) - count({t}.{c}) AS missing, count(*) AS n FROM {_AWARD_FILES} a LEFT JOIN {_PROCUREMENTS} p ON a.ocid = p.ocid" for c, t in _MISSING)}) x
      WHERE missing > 0 ORDER BY missing DESC, field LIMIT 15"""),
    "s09_loaded_table": (lambda s, d: load_table(_texts(s, d), _LINE)[0], "SELECT CAST(l_quantity AS INTEGER) AS l_quantity, l_orderkey, l_shipdate, l_returnflag FROM lineitem WHERE l_orderkey % 11 > 0 AND l_orderkey % 13 > 0 AND l_orderkey % 17 > 0"),
    "s09_rejected_values": (_rejects, """SELECT 'l_quantity' AS "column", 'not a int' AS reason, count(*) AS rows FROM lineitem WHERE l_orderkey % 11 = 0 UNION ALL SELECT 'l_orderkey', 'missing', count(*) FROM lineitem WHERE l_orderkey % 13 = 0
      UNION ALL SELECT 'l_shipdate', 'not a timestamp', count(*) FROM lineitem WHERE l_orderkey % 17 = 0"""),
    "i01_ingested_versions": (_ingested, f"SELECT award_id, count(*) AS rows, count(*) AS versions, 1::BIGINT AS latest, count(*) AS last, sum(CAST(round(award_value * 100) AS BIGINT))::BIGINT AS pence FROM {_AWARDS} a GROUP BY award_id"),
    "j08_validated_join": (_validated, f"SELECT a.award_id, a.release_id, a.ocid, a.award_status, p.tender_status, p.procurement_method FROM {_AWARDS} a LEFT JOIN {_PROCUREMENTS} p ON a.ocid = p.ocid"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _SQL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _SQL.items()}
