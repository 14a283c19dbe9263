"""Statements for DuckDB that are written by hand over the procurement tables, apart from the templates that Spark runs, to hold the scores against."""

from __future__ import annotations

from .dialect import TWIN
from .tables import with_steps

_DAYS = "((epoch(l.contract_end) - epoch(l.contract_start)) / 86400.0)"
_YEARS = f"CAST(round(CAST({_DAYS} / 365.25 AS DECIMAL(30,8)), 2) AS DOUBLE)"
_NAME = "lower(coalesce(canonical_supplier_name, ''))"
_FIVE = " OR ".join(f"{_NAME} LIKE '%{p}%'" for p in ("successful supplier", "supplier list", "see webpage", "contract award details", "attachments"))
_SIX = f"{_FIVE} OR {_NAME} LIKE '%please see%'"
_VALUE = "CASE WHEN award_value >= 1000000000 THEN 3 WHEN award_value >= 100000000 THEN 2 ELSE 0 END"
_CATEGORY = """CASE WHEN {s} >= {a} THEN 'Priority review' WHEN {s} >= {b} THEN 'High review' WHEN {s} >= {c} THEN 'Moderate review' ELSE 'Lower review priority' END"""
_RATIONALE = """CASE WHEN {s} >= {a} THEN '{top} screening signals' WHEN {s} >= {b} THEN 'Several material screening signals' WHEN {s} >= {c} THEN 'At least one material screening signal'
  ELSE 'Limited screening signals' END"""

# What each award version has of suppliers: by identity flag (first score), by five patterns (second), by six (third).
_FIRST = """SELECT award_id, release_id, count(DISTINCT supplier_key) FILTER (WHERE canonical_supplier_name IS NOT NULL AND supplier_identity_flag = 'confirmed_id') AS usable,
    max((identity_review_flag = 'review_name_variation')::INT) AS review, max((supplier_id_quality = 'unreliable')::INT) AS unreliable FROM award_suppliers GROUP BY award_id, release_id"""
_SECOND = f"""SELECT award_id, release_id, count(DISTINCT supplier_key) FILTER (WHERE trim(coalesce(canonical_supplier_name, '')) <> '' AND NOT ({_FIVE})) AS usable,
    max((supplier_identity_flag = 'id_multiple_names_review')::INT) AS review, max((supplier_id_quality = 'unreliable')::INT) AS unreliable,
    max(({_NAME} LIKE '%successful supplier%')::INT) AS reference FROM award_suppliers GROUP BY award_id, release_id"""
_THIRD = f"""SELECT award_id, release_id, count(DISTINCT supplier_key) FILTER (WHERE trim(coalesce(canonical_supplier_name, '')) <> '' AND NOT ({_SIX})) AS usable,
    array_to_string(list_sort(list_distinct(list(canonical_supplier_name) FILTER (WHERE trim(coalesce(canonical_supplier_name, '')) <> '' AND NOT ({_SIX})))), ', ') AS names,
    max((supplier_identity_flag = 'id_multiple_names_review')::INT) AS review, max(({_SIX})::INT) AS reference FROM award_suppliers GROUP BY award_id, release_id"""

_V1 = f"""SELECT *, value_points + duration_points + method_points + single_supplier_points + supplier_data_quality_points AS score FROM (
  SELECT l.award_id, l.release_id, l.ocid, p.buyer_name, p.procurement_category, p.procurement_method, l.award_date, l.award_value, l.award_currency, l.contract_start, l.contract_end,
    {_YEARS} AS duration_years, coalesce(s.usable, 0) AS usable_supplier_count, coalesce(s.review, 0) AS supplier_identity_review_flag, coalesce(s.unreliable, 0) AS unreliable_supplier_id_flag,
    {_VALUE} AS value_points, CASE WHEN {_YEARS} >= 20 THEN 2 WHEN {_YEARS} >= 10 THEN 1 ELSE 0 END AS duration_points,
    CASE lower(p.procurement_method) WHEN 'direct' THEN 2 WHEN 'limited' THEN 1 ELSE 0 END AS method_points, CASE WHEN s.usable = 1 THEN 1 ELSE 0 END AS single_supplier_points,
    CASE WHEN s.review = 1 OR s.unreliable = 1 THEN 1 ELSE 0 END AS supplier_data_quality_points
  FROM latest l LEFT JOIN procurements p ON l.ocid = p.ocid LEFT JOIN ({_FIRST}) s ON l.award_id = s.award_id AND l.release_id = s.release_id
  WHERE l.contract_start IS NOT NULL AND l.contract_end >= l.contract_start)"""
_V2 = f"""SELECT *, value_points + duration_points + method_points + single_supplier_points AS score FROM (
  SELECT l.award_id, l.release_id, l.ocid, p.buyer_name, p.procurement_category, p.procurement_method, l.award_date, l.award_value, l.award_currency, l.contract_start, l.contract_end,
    {_YEARS} AS duration_years, coalesce(s.usable, 0) AS usable_supplier_count, coalesce(s.review, 0) AS supplier_identity_review_flag, coalesce(s.unreliable, 0) AS unreliable_supplier_id_flag,
    coalesce(s.reference, 0) AS supplier_reference_text_flag, {_VALUE} AS value_points, CASE WHEN {_YEARS} >= 20 THEN 2 WHEN {_YEARS} >= 10 THEN 1 ELSE 0 END AS duration_points,
    CASE lower(p.procurement_method) WHEN 'direct' THEN 2 WHEN 'limited' THEN 1 ELSE 0 END AS method_points, CASE WHEN s.usable = 1 THEN 1 ELSE 0 END AS single_supplier_points
  FROM latest l LEFT JOIN procurements p ON l.ocid = p.ocid LEFT JOIN ({_SECOND}) s ON l.award_id = s.award_id AND l.release_id = s.release_id
  WHERE l.contract_start IS NOT NULL AND l.contract_end >= l.contract_start)"""
_V3 = f"""SELECT *, value_points + duration_points + method_points + single_supplier_points AS score FROM (
  SELECT l.*, {_DAYS} AS days, p.tender_title, p.tender_status, p.buyer_name, p.buyer_id, p.procurement_method, p.procurement_category, p.cpv_code, p.tender_value, p.tender_currency,
    coalesce(s.usable, 0) AS usable_supplier_count, nullif(s.names, '') AS supplier_names, coalesce(s.review, 0) AS review, coalesce(s.reference, 0) AS reference,
    {_VALUE} AS value_points, CASE WHEN {_DAYS} >= 20 * 365.25 THEN 2 WHEN {_DAYS} >= 10 * 365.25 THEN 1 ELSE 0 END AS duration_points,
    CASE WHEN lower(p.procurement_method) LIKE '%direct%' THEN 2 WHEN lower(p.procurement_method) LIKE '%limited%' THEN 1 ELSE 0 END AS method_points,
    CASE WHEN s.usable = 1 THEN 1 ELSE 0 END AS single_supplier_points
  FROM latest l LEFT JOIN procurements p ON l.ocid = p.ocid LEFT JOIN ({_THIRD}) s ON l.award_id = s.award_id AND l.release_id = s.release_id
  WHERE l.contract_start IS NOT NULL AND l.contract_end IS NOT NULL)"""


def _verdict(version: int) -> str:
    a, b, c = {1: (7, 5, 3)}.get(version, (6, 4, 2))
    top = "Multiple high-priority" if version == 1 else "Multiple material"
    return f"score AS pri_score, {_CATEGORY.format(s='score', a=a, b=b, c=c)} AS pri_category, {_RATIONALE.format(s='score', a=a, b=b, c=c, top=top)} AS review_rationale"


_AWARD = """award_id, release_id, ocid, buyer_name, procurement_category, procurement_method, award_date, CAST(award_value AS DOUBLE) AS award_value, award_currency, contract_start, contract_end,
  duration_years, usable_supplier_count, supplier_identity_review_flag, unreliable_supplier_id_flag, value_points, duration_points, method_points, single_supplier_points"""
_CUTS = """count(*) AS total_records, count(*) FILTER (WHERE score >= 6) AS priority_review, count(*) FILTER (WHERE score IN (4, 5)) AS high_review,
  count(*) FILTER (WHERE score IN (2, 3)) AS moderate_review, count(*) FILTER (WHERE score < 2) AS lower_review"""

_STATEMENTS = {
    "q04_16_concentration": """SELECT supplier_group, CAST(round(CAST(100 * CAST(v AS DOUBLE) / CAST(total AS DOUBLE) AS DECIMAL(30,8)), 2) AS DOUBLE) AS allocated_award_value_share_pct FROM (
      SELECT unnest(['Top 1%', 'Top 5%', 'Top 10%', 'Remaining 90%']) AS supplier_group, unnest([top1, top5, top10, total - top10]) AS v, total FROM (
        SELECT sum(value) AS total, sum(value) FILTER (WHERE place <= ceil(n * 0.01)) AS top1, sum(value) FILTER (WHERE place <= ceil(n * 0.05)) AS top5, sum(value) FILTER (WHERE place <= ceil(n * 0.1)) AS top10
        FROM (SELECT value, row_number() OVER (ORDER BY value DESC, supplier_key) AS place, count(*) OVER () AS n FROM usable_allocations)))""",
    "q05_13_score_v1": f"SELECT {_AWARD}, supplier_data_quality_points, {_verdict(1)} FROM ({_V1})",
    "q05_14_score_v2": f"SELECT {_AWARD}, supplier_reference_text_flag, {_verdict(2)} FROM ({_V2})",
    "q05_15_score_v2_summary": f"""SELECT {_CUTS}, {', '.join(f"count(*) FILTER (WHERE score = {k}) AS score_{k}" for k in range(9))},
      count(*) FILTER (WHERE usable_supplier_count = 1) AS single_usable_supplier, count(*) FILTER (WHERE usable_supplier_count > 1) AS multiple_usable_suppliers,
      count(*) FILTER (WHERE usable_supplier_count = 0) AS no_usable_supplier, count(*) FILTER (WHERE supplier_identity_review_flag = 1) AS supplier_identity_review_records,
      count(*) FILTER (WHERE unreliable_supplier_id_flag = 1) AS unreliable_supplier_id_records, count(*) FILTER (WHERE supplier_reference_text_flag = 1) AS supplier_reference_text_records,
      count(*) FILTER (WHERE method_points > 0) AS procurement_method_points, count(*) FILTER (WHERE single_supplier_points > 0) AS single_supplier_points_records FROM ({_V2})""",
    "q05_17_score_v3_check": f"""SELECT {_CUTS}, count(*) FILTER (WHERE reference = 1) AS supplier_reference_text_records, count(*) FILTER (WHERE review = 1) AS supplier_identity_review_records,
      count(*) FILTER (WHERE usable_supplier_count = 1) AS single_usable_supplier_records, count(*) FILTER (WHERE usable_supplier_count > 1) AS multiple_usable_supplier_records,
      count(*) FILTER (WHERE usable_supplier_count = 0) AS no_usable_supplier_records, count(*) FILTER (WHERE method_points > 0) AS procurement_method_signal_records,
      count(*) FILTER (WHERE single_supplier_points > 0) AS single_supplier_signal_records, min(score) AS minimum_pri_score, max(score) AS maximum_pri_score FROM ({_V3})""",
    "q05_19_score_v3": f"""SELECT award_id, release_id, ocid, release_date, award_status, award_date, CAST(award_value AS DOUBLE) AS award_value, award_currency, award_title, contract_start, contract_end,
      tender_title, tender_status, buyer_name, buyer_id, procurement_method, procurement_category, cpv_code, CAST(tender_value AS DOUBLE) AS tender_value, tender_currency,
      CAST(round(CAST(days AS DECIMAL(30,8)), 2) AS DOUBLE) AS contract_duration_days, CAST(round(CAST(days / 365.25 AS DECIMAL(30,8)), 2) AS DOUBLE) AS contract_duration_years, usable_supplier_count,
      supplier_names, reference AS supplier_reference_text_flag, review AS supplier_identity_review_flag, value_points, duration_points, method_points, single_supplier_points, {_verdict(3)} FROM ({_V3})""",
}


def statements() -> dict[str, str]:
    return {k: with_steps(v, TWIN) for k, v in _STATEMENTS.items()}
