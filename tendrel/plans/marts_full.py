"""The marts with all of their columns, each a SELECT over the scored awards and the buyers and suppliers made of them."""

from __future__ import annotations

from .dialect import Dialect, money, n, pct, r2
from .tables import ACTIVITY_BANDS, VALUE_BANDS, band

SEGMENTS = ("High activity / High value", "High activity / Lower value", "Lower activity / High value", "Lower activity / Lower value")
PERCENTILES = (1, 5, 10, 25, 50)
# Metric of the KPI mart: how it is worked out in one pass over the awards, and what that is.
KPIS = {
    "unique_buyer_entities": ("count(DISTINCT buyer_key)", "distinct buyer keys"),
    "total_awards": ("count(*)", "latest award versions with a start and an end"),
    "allocated_award_value": ("sum(award_value)", "sum of their values, GBP"),
    "median_award_value": ("max(q50)", "exact median of their values, GBP"),
    "mean_award_value": ("CAST(sum(award_value) AS DOUBLE) / nullif(count(award_value), 0)", "sum of their values by the number that have one, GBP"),
    "maximum_award_value": ("max(award_value)", "largest of their values, GBP"),
    "awards_with_missing_value": ("count(CASE WHEN award_value IS NULL THEN 1 END)", "those with a null value"),
    "priority_review_records": ("count(CASE WHEN score >= 6 THEN 1 END)", "those with a third score of 6 or more"),
    "high_review_records": ("count(CASE WHEN score >= 4 AND score < 6 THEN 1 END)", "those with a third score of 4 or 5"),
    "high_priority_review_records": ("count(CASE WHEN score >= 4 THEN 1 END)", "those with a third score of 4 or more"),
    "maximum_pri_score": ("max(score)", "largest third score"),
    "missing_procurement_method": ("count(CASE WHEN procurement_method IS NULL THEN 1 END)", "those with a null method"),
    "missing_procurement_category": ("count(CASE WHEN procurement_category IS NULL THEN 1 END)", "those with a null category"),
    "missing_supplier_information": ("count(CASE WHEN usable_suppliers = 0 THEN 1 END)", "those without a usable supplier"),
}


def _listed(d: Dialect, rows: list[dict[str, str]], sums: dict[str, str], source: str) -> str:
    """Several rows out of the one row of ``sums`` over ``source``, which Spark reads once."""
    one = f"(SELECT {', '.join(f'{x} AS {name}' for name, x in sums.items())} FROM {source}) z"
    if d.spark:
        structs = ", ".join("named_struct(" + ", ".join(f"'{c}', {x}" for c, x in row.items()) + ")" for row in rows)
        return f"SELECT inline(array({structs})) FROM {one}"
    return " UNION ALL ".join("SELECT " + ", ".join(f"{x} AS {c}" for c, x in row.items()) + f" FROM {one}" for row in rows)


def statements(d: Dialect) -> dict[str, str]:
    labels = lambda values, name: " UNION ALL ".join(f"SELECT '{v}' AS {name}" for v in values)
    shares = f"{pct('x.award_count', 'sum(x.award_count) OVER ()')} AS award_share_percent, {pct('x.value', 'sum(x.value) OVER ()')} AS value_share_percent"
    grouped = lambda key, name, more="": f"""SELECT x.k AS {name}, x.award_count, {money('x.value')} AS allocated_value{more}, {shares} FROM (
        SELECT {key} AS k, count(*) AS award_count, coalesce(sum(award_value), 0) AS value{", max(q50) AS middle" if more else ""} FROM dataset t{f" LEFT JOIN {key}_quantiles q ON t.{key} = q.k" if more else ""} GROUP BY {key}) x"""  # noqa: E731
    award = lambda c: pct(f"b.{c}", "b.award_count")
    buyers = f"""SELECT b.buyer_key, b.award_count, {money('b.value')} AS allocated_award_value, CAST(b.value AS DOUBLE) / nullif(b.valued, 0) AS mean_award_value, {r2('q.q50')} AS median_award_value,
        b.single AS single_supplier_awards, b.multiple AS multiple_supplier_awards, b.unsupplied AS no_usable_supplier_awards, {r2('b.longest / 365.25')} AS max_contract_duration_years, m.buyer_name,
        b.names AS buyer_name_count, b.variants AS buyer_name_variants, b.names > 1 AS multiple_name_flag, {award('single')} AS single_supplier_award_share_percent,
        {award('multiple')} AS multiple_supplier_award_share_percent, {award('unsupplied')} AS no_usable_supplier_share_percent, %s
        FROM buyer_facts b LEFT JOIN buyer_names m ON b.buyer_key = m.buyer_key LEFT JOIN buyer_quantiles q ON b.buyer_key = q.k"""
    if d.spark:  # places from the counts of distinct values, without a window over all buyers
        buyers = buyers % "v.running - v.n + 1 AS value_rank, a.running - a.n + 1 AS activity_rank" + " JOIN ranked_buyer_values v ON b.value = v.v JOIN ranked_buyer_awards a ON b.award_count = a.v"
    else:
        buyers = buyers % "rank() OVER (ORDER BY b.value DESC) AS value_rank, rank() OVER (ORDER BY b.award_count DESC) AS activity_rank"
    of_all = "{0} AS buyer_share, {1} AS award_share, {2} AS value_share".format(
        *[pct(f"coalesce(x.{c}, 0)", f"sum(x.{c}) OVER ()") for c in ("buyer_count", "award_count", "value")])
    sums = "count(*) AS buyer_count, CAST(sum(awards) AS BIGINT) AS award_count, coalesce(sum(value), 0) AS value"
    filled = f"coalesce(x.buyer_count, 0) AS buyer_count, coalesce(x.award_count, 0) AS award_count, coalesce({money('x.value')}, 0) AS allocated_value"
    return {
        "mart_kpis": _listed(d, [{"metric": f"'{m}'", "value": f"v{k}", "definition": f"'{text}'"} for k, (m, (_, text)) in enumerate(KPIS.items())],
            {f"v{k}": r2(x) for k, (x, _) in enumerate(KPIS.values())}, "dataset LEFT JOIN dataset_quantiles ON 1 = 1"),
        "mart_procurement_method": grouped("method_group", "procurement_method_group", f", {r2('x.middle')} AS median_award_value"),
        "mart_value_distribution": grouped("value_band", "award_value_band"),
        "mart_duration_distribution": grouped("duration_band", "duration_band"),
        "mart_supplier_structure": f"""SELECT x.structure AS supplier_structure, x.award_count, {money('x.value')} AS allocated_value, {shares} FROM (
            SELECT structure, count(*) AS award_count, coalesce(sum(award_value), 0) AS value FROM dataset WHERE structure <> 'No usable supplier' GROUP BY structure) x""",
        "mart_supplier_concentration": _listed(d, [{"supplier_percentile": str(p), "supplier_count": f"n{p}", "allocated_value": r2(f"v{p}"), "value_share_percent": pct(f"v{p}", "total")} for p in PERCENTILES],
            {f"n{p}": n(where=f"rn <= greatest(1, ceil(suppliers * {p} / 100.0))") for p in PERCENTILES} | {f"v{p}": f"sum(CASE WHEN rn <= greatest(1, ceil(suppliers * {p} / 100.0)) THEN value END)" for p in PERCENTILES} | {"total": "max(total)"}, "supplier_ranks"),
        "mart_supplier_value_distribution": f"""SELECT x.value_band, x.supplier_count, {r2('x.value')} AS allocated_value, {pct('x.value', 'sum(x.value) OVER ()')} AS value_share_percent FROM (
            SELECT {band('value', VALUE_BANDS, right=True)} AS value_band, count(*) AS supplier_count, sum(value) AS value FROM supplier_totals GROUP BY {band('value', VALUE_BANDS, right=True)}) x""",
        "mart_supplier_summary": f"""SELECT supplier_key, name AS supplier_name, awards AS award_count, {r2('value')} AS allocated_award_value, rn AS value_rank, {pct('value', 'total')} AS value_share_percent,
            {pct('running', 'total')} AS cumulative_value_share_percent, {pct('rn', 'suppliers')} AS cumulative_supplier_share_percent, {band('value', VALUE_BANDS, right=True)} AS value_band,
            {', '.join(f"rn <= greatest(1, ceil(suppliers * {p} / 100.0)) AS top_{p}_percent" for p in (1, 5, 10))} FROM supplier_ranks""",
        "mart_buyer_overview": buyers,
        "mart_top_buyers_by_value": f"SELECT * FROM ({buyers}) t ORDER BY allocated_award_value DESC, buyer_key LIMIT 25",
        "mart_top_buyers_by_count": f"SELECT * FROM ({buyers}) t ORDER BY award_count DESC, buyer_key LIMIT 25",
        "mart_buyer_long_duration": f"""SELECT b.buyer_key, x.awards AS long_duration_awards, {money('x.value')} AS long_duration_value, {r2('x.days / 365.25')} AS maximum_duration_years, m.buyer_name, b.award_count,
            {money('b.value')} AS allocated_award_value, {pct('x.value', 'b.value')} AS long_duration_value_share_percent FROM buyer_facts b
            JOIN (SELECT buyer_key AS k, count(*) AS awards, coalesce(sum(award_value), 0) AS value, max(duration_days) AS days FROM dataset WHERE duration_days >= 10 * 365.25 GROUP BY buyer_key) x ON b.buyer_key = x.k
            LEFT JOIN buyer_names m ON b.buyer_key = m.buyer_key""",
        "mart_buyer_direct_limited": f"""SELECT b.buyer_key, x.awards AS direct_limited_awards, {money('x.value')} AS direct_limited_value, m.buyer_name, b.award_count, {money('b.value')} AS allocated_award_value,
            {pct('x.awards', 'b.award_count')} AS direct_limited_award_share_percent, {pct('x.value', 'b.value')} AS direct_limited_value_share_percent FROM buyer_facts b
            JOIN (SELECT buyer_key AS k, count(*) AS awards, coalesce(sum(award_value), 0) AS value FROM dataset WHERE method_group IN ('Direct', 'Limited') GROUP BY buyer_key) x ON b.buyer_key = x.k
            LEFT JOIN buyer_names m ON b.buyer_key = m.buyer_key""",
        "mart_buyer_activity_bands": f"""SELECT l.activity_band, {filled}, {r2('v.q50')} AS median_buyer_value, CAST(x.value AS DOUBLE) / nullif(x.buyer_count, 0) AS mean_buyer_value, {r2('a.q50')} AS median_awards_per_buyer,
            CAST(x.award_count AS DOUBLE) / nullif(x.buyer_count, 0) AS mean_awards_per_buyer, {of_all} FROM ({labels([b[1] for b in ACTIVITY_BANDS], 'activity_band')}) l
            LEFT JOIN (SELECT activity_band, {sums} FROM overview GROUP BY activity_band) x ON l.activity_band = x.activity_band
            LEFT JOIN activity_band_quantiles a ON l.activity_band = a.k LEFT JOIN activity_value_quantiles v ON l.activity_band = v.k""",
        "mart_buyer_activity_value_matrix": f"""SELECT l.activity_band, w.value_band, {filled}, {of_all} FROM ({labels([b[1] for b in ACTIVITY_BANDS], 'activity_band')}) l
            JOIN ({labels([b[1] for b in VALUE_BANDS], 'value_band')}) w ON 1 = 1 LEFT JOIN (SELECT activity_band, {band('coalesce(value, 0)', VALUE_BANDS)} AS value_band, {sums} FROM overview
            GROUP BY activity_band, {band('coalesce(value, 0)', VALUE_BANDS)}) x ON l.activity_band = x.activity_band AND w.value_band = x.value_band""",
        "mart_buyer_segments": f"""SELECT l.segment AS buyer_segment, {filled}, {r2('a.q50')} AS median_awards_per_buyer, {r2('v.q50')} AS median_buyer_value, {of_all} FROM ({labels(SEGMENTS, 'segment')}) l
            LEFT JOIN (SELECT segment, {sums} FROM overview GROUP BY segment) x ON l.segment = x.segment
            LEFT JOIN segment_award_quantiles a ON l.segment = a.k LEFT JOIN segment_value_quantiles v ON l.segment = v.k""",
        "mart_buyer_data_quality": _listed(d, [{"metric": f"'{m}'", "count": f"v{k}"} for k, m in enumerate((
            "Analytical award records", "Unique buyer entities", "Unique buyer names", "Unique buyer IDs", "Records with unknown buyer name", "Records without buyer ID"))],
            {f"v{k}": x for k, x in enumerate(("count(*)", "count(DISTINCT buyer_key)", "count(DISTINCT buyer_name)", "count(DISTINCT buyer_id)", n(where="buyer_name IS NULL"), n(where="buyer_id IS NULL")))}, "dataset")
            + " UNION ALL SELECT 'Buyer entities with multiple buyer names' AS metric, count(*) AS count FROM buyer_facts WHERE names > 1",
        "mart_review_population": f"""SELECT award_id, release_id, ocid, release_date, award_date, {money('award_value')} AS award_value, award_title, buyer_name, procurement_method, procurement_category, contract_start,
            contract_end, {r2('duration_days / 365.25')} AS contract_duration_years, usable_suppliers AS usable_supplier_count, usable_names AS supplier_names,
            CASE WHEN reference_texts > 0 THEN 1 ELSE 0 END AS supplier_reference_text_flag, CASE WHEN review > 0 THEN 1 ELSE 0 END AS supplier_identity_review_flag, value_points, duration_points, method_points,
            single_supplier_points, score AS pri_score, category AS pri_category, rationale AS review_rationale FROM dataset WHERE score >= 4""",
    }
