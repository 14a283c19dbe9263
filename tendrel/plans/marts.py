"""The marts: which query fills each, what its metrics mean, how they are written and held against each other."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .marts_full import KPIS
from .run import queries

# Mart: the query that fills it, the columns that tell its rows apart.
MARTS = (
    ("kpis", "mart_kpis", "metric"), ("procurement_method", "mart_procurement_method", "procurement_method_group"), ("value_distribution", "mart_value_distribution", "award_value_band"),
    ("duration_distribution", "mart_duration_distribution", "duration_band"), ("supplier_structure", "mart_supplier_structure", "supplier_structure"),
    ("supplier_concentration", "mart_supplier_concentration", "supplier_percentile"), ("supplier_value_distribution", "mart_supplier_value_distribution", "value_band"),
    ("supplier_summary", "mart_supplier_summary", "supplier_key"), ("buyer_overview", "mart_buyer_overview", "buyer_key"), ("buyer_activity_bands", "mart_buyer_activity_bands", "activity_band"),
    ("buyer_segments", "mart_buyer_segments", "buyer_segment"), ("buyer_activity_value_matrix", "mart_buyer_activity_value_matrix", "activity_band, value_band"), ("buyer_outliers", "c22_buyer_outliers", "buyer_key"),
    ("top_buyers_by_value", "mart_top_buyers_by_value", "buyer_key"), ("top_buyers_by_count", "mart_top_buyers_by_count", "buyer_key"), ("buyer_procurement_method", "c14_method_by_buyer", "buyer_key, method_group"),
    ("buyer_direct_limited", "mart_buyer_direct_limited", "buyer_key"), ("buyer_long_duration", "mart_buyer_long_duration", "buyer_key"), ("buyer_data_quality", "mart_buyer_data_quality", "metric"),
    ("review_population", "mart_review_population", "award_id"),
)
_DATED = "latest versions of awards with a start and an end"
# What each figure of the KPI, structure, concentration, buyer and review marts is made of: mart, column or metric, unit, how it is worked out, over which rows.
METRICS = (
    *[("kpis", metric, "GBP" if "value" in metric and "missing" not in metric else "points" if "score" in metric else "rows", text, _DATED) for metric, (_, text) in KPIS.items()],
    ("supplier_concentration", "value_share_percent", "%", "value of the first ceil(n * percentile / 100) suppliers by value, by that of all", "award_value of 0 or more, parted equally among the usable suppliers of an award version"),
    ("supplier_summary", "allocated_award_value", "GBP", "sum of the supplier's parts", "award_value of 0 or more, parted equally among the usable suppliers of an award version"),
    ("buyer_overview", "value_rank", "place", "1 plus the number of buyers of a larger value, null as 0", "all buyer keys"), ("buyer_long_duration", "maximum_duration_years", "years", "largest length in days by 365.25", "awards of ten years or more"),
)


def metric_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METRICS, "mart string, metric string, unit string, formula string, population string")


def manifest(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MARTS, "mart string, query string, grain string")


def consolidate(spark: SparkSession, sf_dir: str, out: str, expected: Mapping[str, float] | None = None, rtol: float = 1e-9, atol: float = 1.0) -> DataFrame:
    """Write all marts, the manifest and the dictionary as Parquet under ``out`` and check them; returns check, actual, expected, status.

    Totals of buyers, methods, bands and segments must agree with the KPI mart, whose metrics ``expected`` may fix. A mart without rows fails.
    """
    known = queries()
    for mart, query, _ in MARTS:
        known[query](spark, sf_dir).write.mode("overwrite").parquet(f"{out}/{mart}")
    manifest(spark).write.mode("overwrite").parquet(f"{out}/manifest")
    metric_dictionary(spark).write.mode("overwrite").parquet(f"{out}/metric_dictionary")
    read = lambda mart: spark.read.parquet(f"{out}/{mart}")
    kpis = {r["metric"]: r["value"] for r in read("kpis").collect()}  # a dozen metrics
    checks = [(f"{mart} has rows", float(not read(mart).isEmpty()), 1.0) for mart, _, _ in MARTS if mart not in ("review_population", "buyer_outliers", "buyer_long_duration")]
    for mart, value in (("buyer_overview", "allocated_award_value"), ("procurement_method", "allocated_value"), ("value_distribution", "allocated_value"), ("duration_distribution", "allocated_value"),
                        ("buyer_activity_bands", "allocated_value"), ("buyer_segments", "allocated_value"), ("buyer_activity_value_matrix", "allocated_value")):
        count, total = read(mart).agg(F.sum("award_count"), F.sum(value)).first()
        checks += [(f"{mart} awards", float(count or 0), kpis["total_awards"]), (f"{mart} value", float(total or 0), kpis["allocated_award_value"] or 0.0)]
    checks.append(("buyer_overview buyers", float(read("buyer_overview").count()), kpis["unique_buyer_entities"]))
    checks.append(("review_population awards", float(read("review_population").count()), kpis["high_priority_review_records"]))
    checks += [(f"expected {name}", kpis.get(name), float(want)) for name, want in (expected or {}).items()]
    within = lambda a, e: a is not None and abs(a - e) <= atol + rtol * abs(e)
    return spark.createDataFrame([(name, a, e, "PASS" if within(a, e) else "FAIL") for name, a, e in checks], "check string, actual double, expected double, status string")
