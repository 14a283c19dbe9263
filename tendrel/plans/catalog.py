"""The catalogue of named analyses: each a SELECT over the procurement tables."""

from __future__ import annotations

from .dialect import Dialect, mean, money, n, pct, r2
from .tables import NAME_QUALITY, SUPPLIER_COUNT_BANDS, SUPPLIER_VALUE_BANDS, TENDER_BANDS, band, name_quality

TOTAL = money("sum(tender_value)")


def statements(d: Dialect) -> dict[str, str]:
    years = f"({d.days('contract_start', 'contract_end')} / 365.25)"
    usable = f"{name_quality('s.canonical_supplier_name')} = '{NAME_QUALITY[3]}'"
    dated = "contract_start IS NOT NULL AND contract_end >= contract_start"
    category, method = "coalesce(procurement_category, 'Unknown')", "coalesce(procurement_method, 'Unknown')"
    average, least, most = mean("tender_value"), money("min(tender_value)"), money("max(tender_value)")
    top_share = lambda p: f"""SELECT 'Top {p}%' AS segment, count(*) AS procurement_count, {money('sum(tender_value)')} AS tender_value, {pct('sum(tender_value)', 'max(total)')} AS percentage_of_total_value
        FROM (SELECT tender_value, rn, (SELECT count(*) FROM ranked_procurements) AS n, (SELECT sum(tender_value) FROM ranked_procurements) AS total FROM ranked_procurements) x
        WHERE rn <= floor(n * {p} / 100)"""  # noqa: E731
    extreme = lambda key, name: f"""SELECT {key} AS {name}, count(*) AS extreme_tender_count, {TOTAL} AS total_extreme_tender_value, {average} AS average_extreme_tender_value
        FROM procurements WHERE tender_value >= 10000000000 GROUP BY {key}"""  # noqa: E731
    latest_by = lambda key, name: f"""SELECT {key} AS {name}, count(DISTINCT l.award_id) AS award_count, count(l.award_value) AS awards_with_value, {money('sum(coalesce(l.award_value, 0))')} AS recorded_award_value
        FROM latest l JOIN procurements p ON l.ocid = p.ocid WHERE l.award_id IN (SELECT award_id FROM award_suppliers) GROUP BY {key}"""  # noqa: E731
    relations = "award_suppliers a JOIN suppliers s ON a.supplier_key = s.supplier_key JOIN procurements p ON a.ocid = p.ocid"
    many_buyers = f"""SELECT s.supplier_key, s.canonical_supplier_name, count(DISTINCT p.buyer_name) AS buyer_count, count(DISTINCT a.award_id) AS award_count FROM {relations} WHERE %s
        GROUP BY s.supplier_key, s.canonical_supplier_name HAVING count(DISTINCT p.buyer_name) > 1"""
    in_latest = "latest l JOIN award_suppliers a ON l.award_id = a.award_id AND l.release_id = a.release_id"
    with_procurement = "latest l LEFT JOIN procurements p ON l.ocid = p.ocid"
    high_procurements = f"""SELECT l.ocid, p.buyer_name, p.procurement_category, p.procurement_method, count(DISTINCT l.award_id) AS award_count, sum(l.award_value) AS total
        FROM {with_procurement} WHERE l.award_value >= 100000000 GROUP BY l.ocid, p.buyer_name, p.procurement_category, p.procurement_method"""
    award_columns = f"l.award_date, {money('l.award_value')} AS award_value, l.award_currency, l.contract_start, l.contract_end"
    profile = f"SELECT l.award_id, l.ocid, p.buyer_name, p.procurement_category, p.procurement_method, {award_columns}, {r2(years)} AS duration_years FROM {with_procurement} WHERE {dated}"
    points = "value_points, duration_points, method_points, single_supplier_points"
    flag = lambda x: f"CASE WHEN {x} > 0 THEN 1 ELSE 0 END"
    scored_award = f"""award_id, release_id, ocid, buyer_name, procurement_category, procurement_method, award_date, {money('award_value')} AS award_value, award_currency, contract_start, contract_end,
        {r2('duration_days / 365.25')} AS duration_years, usable_suppliers AS usable_supplier_count, {flag('review')} AS supplier_identity_review_flag, {flag('unreliable')} AS unreliable_supplier_id_flag"""
    verdict = "score AS pri_score, category AS pri_category, rationale AS review_rationale"
    counts = lambda **named: ", ".join(f"{n(where=x)} AS {name}" for name, x in named.items())
    cuts = counts(priority_review="score >= 6", high_review="score >= 4 AND score < 6", moderate_review="score >= 2 AND score < 4", lower_review="score < 2")
    return {
        "q03_01_total": "SELECT count(*) AS total_procurements FROM procurements",
        "q03_02_by_category": f"""SELECT {category} AS procurement_category, count(*) AS procurement_count, {pct('count(*)', 'sum(count(*)) OVER ()')} AS percentage_of_procurements
            FROM procurements GROUP BY {category}""",
        "q03_03_by_method": f"""SELECT {method} AS procurement_method, count(*) AS procurement_count, {pct('count(*)', 'sum(count(*)) OVER ()')} AS percentage_of_procurements
            FROM procurements GROUP BY {method}""",
        "q03_04_value_summary": f"""SELECT count(*) AS total_procurements, count(tender_value) AS procurements_with_tender_value, {TOTAL} AS total_tender_value, {average} AS average_tender_value,
            {least} AS minimum_tender_value, {most} AS maximum_tender_value FROM procurements""",
        "q03_05_value_by_category": f"""SELECT {category} AS procurement_category, count(*) AS procurement_count, count(tender_value) AS procurements_with_value, {TOTAL} AS total_tender_value,
            {average} AS average_tender_value FROM procurements GROUP BY {category}""",
        "q03_06_top_buyers_count": """SELECT buyer_name, count(*) AS procurement_count FROM procurements WHERE buyer_name IS NOT NULL GROUP BY buyer_name
            ORDER BY procurement_count DESC, buyer_name LIMIT 20""",
        "q03_07_top_buyers_value": f"""SELECT buyer_name, procurement_count, procurements_with_value, {money('total')} AS total_tender_value, average_tender_value FROM (
            SELECT buyer_name, count(*) AS procurement_count, count(tender_value) AS procurements_with_value, sum(tender_value) AS total, {average} AS average_tender_value
            FROM procurements WHERE buyer_name IS NOT NULL GROUP BY buyer_name) x ORDER BY x.total DESC NULLS LAST, buyer_name LIMIT 20""",
        "q03_08_completeness": f"""SELECT count(*) AS total_procurements, count(tender_value) AS procurements_with_tender_value, count(*) - count(tender_value) AS procurements_missing_tender_value,
            {pct('count(tender_value)', 'count(*)')} AS tender_value_completion_percentage FROM procurements""",
        "q03_09_method_category": f"""SELECT {method} AS procurement_method, {category} AS procurement_category, count(*) AS procurement_count, {TOTAL} AS total_tender_value
            FROM procurements GROUP BY {method}, {category}""",
        "q03_10_largest": f"""SELECT tender_title, buyer_name, procurement_method, procurement_category, {money('x.tender_value')} AS tender_value FROM procurements x
            WHERE x.tender_value IS NOT NULL ORDER BY x.tender_value DESC, ocid LIMIT 20""",
        "q03_11_median": f"SELECT {r2('q50')} AS median_tender_value FROM tender_quantiles",
        "q03_12_value_bands": f"""SELECT {band('tender_value', TENDER_BANDS)} AS value_band, count(*) AS procurement_count, {pct('count(*)', 'sum(count(*)) OVER ()')} AS percentage_of_procurements,
            {TOTAL} AS total_tender_value, {average} AS average_tender_value FROM procurements WHERE tender_value IS NOT NULL GROUP BY {band('tender_value', TENDER_BANDS)}""",
        "q03_13a_top1": top_share(1), "q03_13b_top5": top_share(5), "q03_13c_top10": top_share(10),
        "q03_14_thresholds": f"""SELECT threshold, procurement_count, {money('value')} AS tender_value, {pct('procurement_count', 'procurements')} AS percentage_of_procurements, {pct('value', 'total')} AS percentage_of_total_value
            FROM (SELECT t.threshold, count(p.ocid) AS procurement_count, coalesce(sum(p.tender_value), 0) AS value, (SELECT count(tender_value) FROM procurements) AS procurements,
              (SELECT sum(tender_value) FROM procurements) AS total FROM (SELECT '£1B+' AS threshold, 1000000000 AS least UNION ALL SELECT '£5B+', 5000000000 UNION ALL SELECT '£10B+', 10000000000
              UNION ALL SELECT '£50B+', 50000000000) t LEFT JOIN procurements p ON p.tender_value >= t.least GROUP BY t.threshold) x""",
        "q03_15_buyer_concentration": f"""SELECT buyer_name, procurement_count, {money('total')} AS total_tender_value, {pct('total', 'every')} AS percentage_of_total_value FROM (
            SELECT buyer_name, count(*) AS procurement_count, sum(tender_value) AS total, (SELECT sum(tender_value) FROM procurements) AS every
            FROM procurements WHERE tender_value IS NOT NULL AND buyer_name IS NOT NULL GROUP BY buyer_name) x ORDER BY x.total DESC, buyer_name LIMIT 20""",
        "q03_16_extreme": f"""SELECT ocid, tender_title, buyer_name, procurement_method, procurement_category, {money('tender_value')} AS tender_value, tender_currency
            FROM procurements WHERE tender_value >= 10000000000""",
        "q03_17_extreme_buyer": f"""SELECT buyer_name, count(*) AS extreme_tender_count, {TOTAL} AS total_extreme_tender_value, {average} AS average_extreme_tender_value, {most} AS maximum_tender_value
            FROM procurements WHERE tender_value >= 10000000000 GROUP BY buyer_name""",
        "q03_18_extreme_category": extreme(category, "procurement_category"),
        "q03_19_extreme_method": extreme(method, "procurement_method"),
        "q03_20_without_extreme": f"""SELECT count(*) AS procurements_under_10bn, count(tender_value) AS valued_procurements_under_10bn, {TOTAL} AS total_tender_value_under_10bn,
            {average} AS average_tender_value_under_10bn, {least} AS minimum_tender_value_under_10bn, {most} AS maximum_tender_value_under_10bn FROM procurements WHERE tender_value < 10000000000""",
        "q03_21_top_extreme": f"""SELECT ocid, tender_title, buyer_name, procurement_method, procurement_category, {money('x.tender_value')} AS tender_value FROM procurements x
            WHERE x.tender_value >= 10000000000 ORDER BY x.tender_value DESC, ocid LIMIT 20""",
        "q04_01_activity": "SELECT count(DISTINCT supplier_key) AS unique_suppliers, count(*) AS supplier_relationships, count(DISTINCT award_id) AS awards_with_suppliers FROM award_suppliers",
        "q04_02_identity": "SELECT identity_review_flag, count(*) AS supplier_count FROM suppliers GROUP BY identity_review_flag",
        "q04_03_id_quality": "SELECT supplier_id_quality, count(*) AS supplier_count FROM suppliers GROUP BY supplier_id_quality",
        "q04_04_name_quality": f"""SELECT {name_quality('canonical_supplier_name')} AS supplier_name_quality, count(*) AS supplier_count FROM suppliers
            GROUP BY {name_quality('canonical_supplier_name')}""",
        "q04_05_latest_population": f"""SELECT count(*) AS latest_award_versions, count(DISTINCT award_id) AS unique_awards, count(award_value) AS awards_with_value,
            count(*) - count(award_value) AS awards_missing_value, {pct('count(award_value)', 'count(*)')} AS value_completeness_pct FROM latest WHERE award_id IN (SELECT award_id FROM award_suppliers)""",
        "q04_06_top_by_awards": f"""SELECT s.supplier_key, s.canonical_supplier_name, count(DISTINCT a.award_id) AS award_count, count(DISTINCT a.ocid) AS procurement_count,
            count(DISTINCT p.buyer_name) AS buyer_count FROM {relations} WHERE s.canonical_supplier_name IS NOT NULL GROUP BY s.supplier_key, s.canonical_supplier_name
            ORDER BY award_count DESC, s.supplier_key LIMIT 25""",
        "q04_07_top_by_value": f"""SELECT supplier_key, canonical_supplier_name, award_count, {r2('value')} AS allocated_award_value FROM usable_allocations x
            ORDER BY x.value DESC, supplier_key LIMIT 25""",
        "q04_08_buyer_supplier": f"""SELECT p.buyer_name, s.canonical_supplier_name, count(DISTINCT a.award_id) AS award_count, count(DISTINCT a.supplier_key) AS supplier_key_count FROM {relations}
            WHERE s.canonical_supplier_name IS NOT NULL GROUP BY p.buyer_name, s.canonical_supplier_name ORDER BY award_count DESC, p.buyer_name, s.canonical_supplier_name LIMIT 25""",
        "q04_09_multi_buyer": f"""SELECT b.supplier_key, b.canonical_supplier_name, b.buyer_count, b.award_count, {r2('coalesce(v.value, 0)')} AS allocated_award_value FROM ({many_buyers % usable}) b
            LEFT JOIN allocations v ON b.supplier_key = v.supplier_key ORDER BY b.buyer_count DESC, b.award_count DESC, b.supplier_key LIMIT 25""",
        "q04_10_structure": f"""SELECT {band('supplier_count', SUPPLIER_COUNT_BANDS)} AS supplier_structure, count(*) AS award_count FROM award_counts
            GROUP BY {band('supplier_count', SUPPLIER_COUNT_BANDS)}""",
        "q04_11_structure_value": f"""SELECT CASE WHEN c.supplier_count = 1 THEN 'Single supplier' ELSE 'Multiple suppliers' END AS supplier_structure, count(*) AS award_count,
            {money('sum(l.award_value)')} AS recorded_award_value FROM award_counts c JOIN latest l ON c.award_id = l.award_id WHERE l.award_value IS NOT NULL
            GROUP BY CASE WHEN c.supplier_count = 1 THEN 'Single supplier' ELSE 'Multiple suppliers' END""",
        "q04_12_identity_population": """SELECT supplier_key, supplier_id, canonical_supplier_name, reported_name_count, relationship_count, supplier_id_quality, identity_review_flag
            FROM suppliers WHERE identity_review_flag = 'review_name_variation' ORDER BY relationship_count DESC, supplier_key LIMIT 100""",
        "q04_13_dependency": f"""SELECT buyer_name, canonical_supplier_name, supplier_awards, total_awards, {pct('supplier_awards', 'total_awards')} AS top_supplier_award_share_pct FROM (
            SELECT *, sum(supplier_awards) OVER (PARTITION BY buyer_name) AS total_awards FROM (
              SELECT p.buyer_name, s.canonical_supplier_name, count(DISTINCT a.award_id) AS supplier_awards FROM {relations} WHERE s.canonical_supplier_name IS NOT NULL AND p.buyer_name IS NOT NULL
              GROUP BY p.buyer_name, s.canonical_supplier_name) y) x WHERE total_awards >= 5 ORDER BY top_supplier_award_share_pct DESC, buyer_name, canonical_supplier_name LIMIT 25""",
        "q04_14_diversification": f"{many_buyers % 's.canonical_supplier_name IS NOT NULL'} ORDER BY buyer_count DESC, award_count DESC, s.supplier_key LIMIT 25",
        "q04_15_value_distribution": f"""SELECT {band('value', SUPPLIER_VALUE_BANDS)} AS supplier_value_band, count(*) AS supplier_count, {r2('sum(value)')} AS allocated_award_value
            FROM usable_allocations GROUP BY {band('value', SUPPLIER_VALUE_BANDS)}""",
        "q04_16_concentration": " UNION ALL ".join(f"""SELECT 'Top {p}%' AS supplier_group, {pct('sum(value)', 'max(total)')} AS allocated_award_value_share_pct FROM (
            SELECT value, rn, (SELECT count(*) FROM ranked_allocations) AS n, (SELECT sum(value) FROM ranked_allocations) AS total FROM ranked_allocations) x
            WHERE rn <= ceil(n * {p} / 100.0)""" for p in (1, 5, 10)) + f""" UNION ALL SELECT 'Remaining 90%' AS supplier_group, {pct("max(total) - sum(CASE WHEN rn <= ceil(n * 10 / 100.0) THEN value ELSE 0 END)", 'max(total)')} AS allocated_award_value_share_pct
            FROM (SELECT value, rn, (SELECT count(*) FROM ranked_allocations) AS n, (SELECT sum(value) FROM ranked_allocations) AS total FROM ranked_allocations) x""",
        "q04_17_latest_category": latest_by("coalesce(p.procurement_category, 'Unknown')", "procurement_category"),
        "q04_18_latest_method": latest_by("coalesce(p.procurement_method, 'Unknown')", "procurement_method"),
        "q04_19_large_exposures": f"""SELECT supplier_key, canonical_supplier_name, award_count, {r2('value')} AS allocated_award_value, identity_review_flag FROM usable_allocations x
            WHERE x.value >= 1000000000 ORDER BY x.value DESC, supplier_key LIMIT 25""",
        "q05_01_population": f"""SELECT count(*) AS supplier_award_relationships, count(DISTINCT l.award_id) AS unique_awards, count(DISTINCT l.ocid) AS unique_procurements,
            count(l.award_value) AS awards_with_value, {pct('count(l.award_value)', 'count(*)')} AS value_completeness_pct FROM {in_latest}""",
        "q05_02a_high_value": f"""SELECT award_id, release_id, ocid, award_date, {money('l.award_value')} AS award_value, award_currency, award_status, contract_start, contract_end FROM latest l
            WHERE l.award_value >= 100000000 ORDER BY l.award_value DESC, award_id LIMIT 25""",
        "q05_02b_high_value_procurements": f"""SELECT ocid, buyer_name, procurement_category, procurement_method, award_count, {money('total')} AS total_recorded_award_value
            FROM ({high_procurements}) x ORDER BY x.total DESC, ocid LIMIT 25""",
        "q05_03_by_method": f"""SELECT coalesce(p.procurement_method, 'Unknown') AS procurement_method, count(*) AS high_value_awards, {money('sum(l.award_value)')} AS recorded_award_value
            FROM {with_procurement} WHERE l.award_value >= 100000000 GROUP BY coalesce(p.procurement_method, 'Unknown')""",
        "q05_04_direct": f"""SELECT l.award_id, l.release_id, l.ocid, p.buyer_name, p.procurement_category, p.procurement_method, {award_columns} FROM {with_procurement}
            WHERE lower(trim(p.procurement_method)) = 'direct' AND l.award_value >= 100000000 ORDER BY l.award_value DESC, l.award_id LIMIT 25""",
        "q05_05_exposure": f"""SELECT coalesce(p.procurement_method, 'Unknown') AS procurement_method, count(*) AS award_count, count(l.award_value) AS awards_with_value,
            {pct('count(l.award_value)', 'count(*)')} AS value_completeness_pct, {money('sum(coalesce(l.award_value, 0))')} AS recorded_award_value
            FROM {with_procurement} GROUP BY coalesce(p.procurement_method, 'Unknown')""",
        "q05_06_dependency": f"""SELECT buyer_name, canonical_supplier_name, supplier_awards, total_supplier_awards, {pct('supplier_awards', 'total_supplier_awards')} AS top_supplier_award_share_pct FROM (
            SELECT *, sum(supplier_awards) OVER (PARTITION BY buyer_name) AS total_supplier_awards, row_number() OVER (PARTITION BY buyer_name ORDER BY supplier_awards DESC, supplier_key) AS rn FROM (
              SELECT p.buyer_name, a.supplier_key, a.canonical_supplier_name, count(DISTINCT l.award_id) AS supplier_awards FROM {in_latest} LEFT JOIN procurements p ON l.ocid = p.ocid
              WHERE a.canonical_supplier_name IS NOT NULL AND p.buyer_name IS NOT NULL GROUP BY p.buyer_name, a.supplier_key, a.canonical_supplier_name) y) x
            WHERE rn = 1 AND total_supplier_awards >= 5 ORDER BY top_supplier_award_share_pct DESC, total_supplier_awards DESC, buyer_name LIMIT 25""",
        "q05_08_participation": f"""SELECT h.ocid, h.buyer_name, h.procurement_category, h.procurement_method, h.award_count, {money('h.total')} AS total_recorded_award_value,
            coalesce(c.supplier_count, 0) AS supplier_count, c.supplier_names FROM (SELECT * FROM ({high_procurements}) x ORDER BY x.total DESC, ocid LIMIT 25) h LEFT JOIN (
              SELECT l.ocid, count(DISTINCT a.supplier_key) AS supplier_count, {d.joined('a.canonical_supplier_name')} AS supplier_names FROM {in_latest}
              WHERE a.canonical_supplier_name IS NOT NULL AND l.ocid IN (SELECT ocid FROM latest WHERE award_value >= 100000000) GROUP BY l.ocid) c ON h.ocid = c.ocid""",
        "q05_09_duration_profile": f"""SELECT count(*) AS awards_with_contract_dates, {r2('avg(CAST(days AS DECIMAL(20,1)))', 1)} AS average_duration_days, {r2('avg(CAST(years AS DECIMAL(20,2)))')} AS average_duration_years,
            min(days) AS minimum_duration_days, max(days) AS maximum_duration_days, {', '.join(f"{n(where=f'years >= {k}')} AS contracts_{k}_year{'s' * (k > 1)}_or_more" for k in (1, 3, 5, 10))}
            FROM (SELECT {r2(d.days('contract_start', 'contract_end'), 1)} AS days, {r2(years)} AS years FROM latest WHERE {dated}) x""",
        "q05_10_longest": f"SELECT * FROM ({profile}) x ORDER BY duration_years DESC, award_id LIMIT 25",
        "q05_11_value_and_long": f"SELECT * FROM ({profile}) x WHERE award_value >= 100000000 AND duration_years >= 10 ORDER BY award_value DESC, duration_years DESC, award_id LIMIT 25",
        "q05_12_review_candidates": f"""SELECT x.*, coalesce(c.named, 0) AS identifiable_supplier_count, coalesce(c.review, 0) AS supplier_identity_review_count, coalesce(c.unreliable, 0) AS has_unreliable_supplier_id
            FROM (SELECT *, CASE WHEN award_value >= 1000000000 AND lower(procurement_method) IN ('direct', 'limited') THEN 'Priority review' WHEN award_value >= 500000000 THEN 'High review'
                ELSE 'Moderate review' END AS review_category FROM ({profile}) y WHERE award_value >= 100000000 AND duration_years >= 10) x
            LEFT JOIN (SELECT l.award_id, count(DISTINCT CASE WHEN a.canonical_supplier_name IS NOT NULL THEN a.supplier_key END) AS named,
                count(DISTINCT CASE WHEN a.identity_review_flag = 'review_name_variation' THEN a.supplier_key END) AS review, max(CASE WHEN a.supplier_id_quality = 'unreliable' THEN 1 ELSE 0 END) AS unreliable
                FROM {in_latest} GROUP BY l.award_id) c ON x.award_id = c.award_id
            ORDER BY CASE x.review_category WHEN 'Priority review' THEN 1 WHEN 'High review' THEN 2 ELSE 3 END, x.award_value DESC, x.duration_years DESC, x.award_id LIMIT 50""",
        "q05_13_score_v1": f"SELECT {scored_award}, {points}, quality_points AS supplier_data_quality_points, {verdict} FROM score_v1",
        "q05_14_score_v2": f"SELECT {scored_award}, {flag('reference_texts')} AS supplier_reference_text_flag, {points}, {verdict} FROM score_v2",
        "q05_15_score_v2_summary": f"""SELECT count(*) AS total_records, {cuts}, {', '.join(f"{n(where=f'score = {k}')} AS score_{k}" for k in range(9))}, {counts(
            single_usable_supplier="usable_suppliers = 1", multiple_usable_suppliers="usable_suppliers > 1", no_usable_supplier="usable_suppliers = 0", supplier_identity_review_records="review > 0",
            unreliable_supplier_id_records="unreliable > 0", supplier_reference_text_records="reference_texts > 0", procurement_method_points="method_points > 0",
            single_supplier_points_records="single_supplier_points > 0")} FROM score_v2""",
        "q05_16_score_v2_review": f"""SELECT {scored_award}, {flag('reference_names')} AS supplier_reference_text_flag, {points}, score AS pri_score, category AS pri_category
            FROM score_v2 WHERE score >= 4""",
        "q05_17_score_v3_check": f"""SELECT count(*) AS total_records, {cuts}, {counts(
            supplier_reference_text_records="reference_texts > 0", supplier_identity_review_records="review > 0", single_usable_supplier_records="usable_suppliers = 1",
            multiple_usable_supplier_records="usable_suppliers > 1", no_usable_supplier_records="usable_suppliers = 0", procurement_method_signal_records="method_points > 0",
            single_supplier_signal_records="single_supplier_points > 0")}, min(score) AS minimum_pri_score, max(score) AS maximum_pri_score FROM score_v3""",
        "q05_18_score_v3_diff": f"""SELECT award_id, release_id, buyer_name, tender_title, {money('award_value')} AS award_value, procurement_method, contract_start, contract_end,
            usable_suppliers AS usable_supplier_count, supplier_names, {points}, score AS pri_score FROM score_v3 WHERE score >= 4""",
        "q05_19_score_v3": f"""SELECT award_id, release_id, ocid, release_date, award_status, award_date, {money('award_value')} AS award_value, award_currency, award_title, contract_start, contract_end,
            tender_title, tender_status, buyer_name, buyer_id, procurement_method, procurement_category, cpv_code, {money('tender_value')} AS tender_value, tender_currency,
            {r2('duration_days')} AS contract_duration_days, {r2('duration_days / 365.25')} AS contract_duration_years, usable_suppliers AS usable_supplier_count, usable_names AS supplier_names,
            {flag('reference_texts')} AS supplier_reference_text_flag, {flag('review')} AS supplier_identity_review_flag, {points}, {verdict} FROM score_v3""",
        "q06_01_coverage": f"SELECT count(DISTINCT l.award_id) AS latest_awards, count(DISTINCT a.award_id) AS awards_with_supplier_relationships FROM {in_latest.replace(' JOIN', ' LEFT JOIN')}",
        "q06_02_relationship_quality": f"""SELECT count(*) AS relationship_rows, {counts(
            with_canonical_name="canonical_supplier_name IS NOT NULL", with_supplier_key="supplier_key IS NOT NULL", identity_flag_zero="supplier_identity_flag = 'confirmed_id'",
            identity_flag_one="supplier_identity_flag <> 'confirmed_id'", identity_review_flag_one="identity_review_flag = 'review_name_variation'")} FROM award_suppliers""",
        "q06_03_counts_per_award": f"""SELECT count(*) AS latest_awards, {counts(
            awards_with_relationship_rows="relationship_rows > 0", awards_with_supplier_keys="supplier_keys > 0", awards_with_named_supplier_keys="named > 0",
            awards_with_one_named_supplier="named = 1")} FROM (SELECT l.award_id, l.release_id, count(*) AS relationship_rows, count(DISTINCT a.supplier_key) AS supplier_keys,
              count(DISTINCT CASE WHEN a.canonical_supplier_name IS NOT NULL THEN a.supplier_key END) AS named FROM {in_latest.replace(' JOIN', ' LEFT JOIN')} GROUP BY l.award_id, l.release_id) x""",
        "q06_04_inspect": f"""SELECT l.award_id, l.ocid, {money('l.award_value')} AS award_value, a.supplier_id, a.supplier_name, a.canonical_supplier_name, a.supplier_key, a.supplier_id_quality,
            a.supplier_identity_flag, a.identity_review_flag FROM {in_latest} WHERE l.award_value >= 1000000000 ORDER BY l.award_value DESC, l.award_id, a.supplier_index LIMIT 50""",
    }
