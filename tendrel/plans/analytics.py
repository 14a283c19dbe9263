"""Analyses built on the scored award dataset, data-quality checks, and one query for each relational operator that they use."""

from __future__ import annotations

from .dialect import Dialect, mean, money, n, pct, r2
from .tables import ACTIVITY_BANDS, DURATION_BANDS, REF6, VALUE_BANDS, band, like_any

METHODS = ("Direct", "Limited", "Selective", "Open", "Other", "Unknown")
SEGMENTS = ("High activity / High value", "High activity / Lower value", "Lower activity / High value", "Lower activity / Lower value")


def _rows(values, name: str) -> str:
    return " UNION ALL ".join(f"SELECT '{v}' AS {name}" for v in values)


def _labels(bands: tuple, unknown: bool = False) -> list[str]:
    return [b[1] for b in bands] + ["Unknown"] * unknown


def _one_pass(rows: dict[str, str], src: str) -> str:
    """metric, value of several aggregates of one table, which is read once."""
    named = ", ".join(f"named_struct('metric', '{m}', 'value', v{k})" for k, m in enumerate(rows))
    sums = ", ".join(f"CAST({x} AS DOUBLE) AS v{k}" for k, x in enumerate(rows.values()))
    return f"SELECT inline(array({named})) FROM (SELECT {sums} FROM {src}) y"


def statements(d: Dialect) -> dict[str, str]:
    by = lambda key: f"SELECT {key}, count(*) AS award_count, coalesce({money('sum(award_value)')}, 0) AS allocated_value, {r2('max(q50)')} AS median_value, {pct('count(*)', 'sum(count(*)) OVER ()')} AS award_share, {pct('coalesce(sum(award_value), 0)', 'sum(sum(award_value)) OVER ()')} AS value_share FROM dataset LEFT JOIN {key}_quantiles ON {key} = k GROUP BY {key}"
    kpi = lambda rows, src: _one_pass(rows, src) if d.spark else " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({x} AS DOUBLE) AS value FROM {src}" for m, x in rows.items())
    check = lambda category, test, sql: f"SELECT '{category}' AS category, '{test}' AS test, CASE WHEN v = 0 THEN 'PASS' ELSE 'FAIL' END AS status, v AS value FROM ({sql}) q"
    orphans = lambda child, parent, keys: f"SELECT count(*) AS v FROM {child} c LEFT JOIN (SELECT DISTINCT {', '.join(keys)} FROM {parent}) p ON {' AND '.join(f'c.{k} = p.{k}' for k in keys)} WHERE p.{keys[0]} IS NULL"
    if d.spark:  # both sides are summed by key in one aggregate: nothing is joined, so the counting goes before the shuffle and a hot key is one row a task
        sides = lambda child, parent, keys: f"SELECT {', '.join(keys)}, 1 AS n, 0 AS known FROM {child} UNION ALL SELECT {', '.join(keys)}, 0 AS n, 1 AS known FROM {parent}"
        orphans = lambda child, parent, keys: f"SELECT coalesce(sum(CASE WHEN known = 0 OR {' OR '.join(f'{k} IS NULL' for k in keys)} THEN n END), 0) AS v FROM (SELECT {', '.join(keys)}, sum(n) AS n, max(known) AS known FROM ({sides(child, parent, keys)}) y GROUP BY {', '.join(keys)}) x"
    keys = lambda table, cols: f"SELECT count(*) - count(DISTINCT {' || '.join(f'''coalesce(CAST({c} AS STRING), '<NULL>') || '|' ''' for c in cols)}) + count(CASE WHEN {' OR '.join(f'{c} IS NULL' for c in cols)} THEN 1 END) AS v FROM {table}"
    dims = f"({_rows(_labels(ACTIVITY_BANDS), 'activity_band')}) a JOIN ({_rows(_labels(VALUE_BANDS), 'value_band')}) v ON 1 = 1"
    struct = f"""SELECT structure, count(*) AS awards, coalesce({money('sum(award_value)')}, 0) AS allocated_value, {pct('count(*)', 'sum(count(*)) OVER ()')} AS award_share FROM dataset WHERE structure <> 'No usable supplier' GROUP BY structure"""
    buyers_ranked = f"""SELECT buyer_key, buyer_name, awards, coalesce({money('value')}, 0) AS value, {pct('awards', 'sum(awards) OVER ()')} AS award_share, {pct('value', 'sum(value) OVER ()')} AS value_share,
        rank() OVER (ORDER BY coalesce(value, 0) DESC) AS value_rank, rank() OVER (ORDER BY awards DESC) AS award_rank FROM overview"""
    if d.spark:
        buyers_ranked = f"""SELECT o.buyer_key, o.buyer_name, o.awards, coalesce({money('o.value')}, 0) AS value, {pct('o.awards', '(SELECT sum(v * n) FROM ranked_buyer_awards)')} AS award_share, {pct('o.value', '(SELECT sum(v * n) FROM ranked_buyer_values)')} AS value_share,
            x.running - x.n + 1 AS value_rank, y.running - y.n + 1 AS award_rank FROM overview o JOIN ranked_buyer_values x ON coalesce(o.value, 0) = x.v JOIN ranked_buyer_awards y ON o.awards = y.v"""
    flags = "CASE WHEN award_value IS NULL THEN 1 ELSE 0 END", "CASE WHEN procurement_method IS NULL THEN 1 ELSE 0 END", "CASE WHEN procurement_category IS NULL THEN 1 ELSE 0 END", "CASE WHEN buyer_id IS NULL THEN 1 ELSE 0 END", "CASE WHEN usable_suppliers = 0 THEN 1 ELSE 0 END"
    indicators = f"""SELECT o.buyer_key, o.buyer_name, coalesce(o.value >= t.cut, false) AS top_value, coalesce(CAST(o.single_value AS DOUBLE) / nullif(CAST(o.value AS DOUBLE), 0) >= 0.9, false) AS single_exposure,
        coalesce(CAST(o.direct_value AS DOUBLE) / nullif(CAST(o.value AS DOUBLE), 0) >= 0.25, false) AS direct_exposure, coalesce(o.longest_days / 365.25 >= 10, false) AS long_duration
        FROM overview o JOIN (SELECT q95 AS cut FROM buyer_value_quantiles) t ON 1 = 1"""
    count_of = "CAST(top_value AS INT) + CAST(single_exposure AS INT) + CAST(direct_exposure AS INT) + CAST(long_duration AS INT)"
    reasons = {"top_value": "Allocated value in the top five percent", "single_exposure": "High single supplier exposure", "direct_exposure": "Direct or limited exposure", "long_duration": "Contract of ten years or more"}
    joined = "concat_ws('; ', " + ", ".join(f"CASE WHEN {k} THEN '{t}' END" for k, t in reasons.items()) + ")"
    numeric = lambda table, col: f"SELECT '{table}.{col}' AS field, count({col}) AS present, count(*) - count({col}) AS missing, {pct(f'count(*) - count({col})', 'count(*)')} AS missing_percent, count(DISTINCT {col}) AS distinct_values FROM {table}"
    out = {
        # relational operators
        "j05_orphan_awards": "SELECT s.award_id, s.release_id FROM award_suppliers s LEFT JOIN latest l ON s.award_id = l.award_id AND s.release_id = l.release_id WHERE l.award_id IS NULL",
        "j08_validated_latest": "SELECT l.award_id, p.buyer_name FROM latest l JOIN procurements p ON l.ocid = p.ocid",
        "a07_names_per_release": f"SELECT release_id, {d.joined('supplier_name_normalized', ' | ')} AS names FROM award_suppliers GROUP BY release_id",
        "a10_value_quantile": f"SELECT {r2('q95')} AS p95, {r2('q25')} AS p25 FROM award_quantiles",
        "a13_method_crosstab": f"SELECT category, {', '.join(f'{n(where=f"method_group = {chr(39)}{m}{chr(39)}")} AS {m.lower()}' for m in METHODS)} FROM dataset GROUP BY category",
        "a14_score_combinations": "SELECT value_points, duration_points, method_points, single_supplier_points, count(*) AS awards FROM dataset GROUP BY value_points, duration_points, method_points, single_supplier_points ORDER BY awards DESC, value_points, duration_points, method_points, single_supplier_points LIMIT 20",
        "a15_versions_histogram": "SELECT versions, count(*) AS awards FROM (SELECT award_id, count(*) AS versions FROM award_versions GROUP BY award_id) x GROUP BY versions",
        "w04_versions": "SELECT award_id, release_id, award_version_number, award_version_count, is_latest FROM award_versions",
        "w06_distinct_names_per_id": "SELECT relationship_observation_key, coalesce(supplier_id_name_count, 0) AS supplier_id_name_count FROM award_suppliers",
        "w08_method_share_within_buyer": f"SELECT buyer_key, method_group, count(*) AS awards, {pct('count(*)', 'sum(count(*)) OVER (PARTITION BY buyer_key)')} AS share FROM dataset GROUP BY buyer_key, method_group",
        "w09_cumulative_supplier_share": f"SELECT supplier_key, rn, {pct('running', 'total')} AS cumulative_share FROM supplier_ranks",
        "w10_tag_sequences": ("SELECT sequence, count(*) AS customers FROM (SELECT custkey, array_join(transform(array_sort(collect_list(struct(release_date, release_id, release_tag))), x -> x.release_tag), ' > ') AS sequence FROM releases GROUP BY custkey) x GROUP BY sequence ORDER BY customers DESC, sequence LIMIT 20"
            if d.spark else "SELECT sequence, count(*) AS customers FROM (SELECT custkey, string_agg(release_tag, ' > ' ORDER BY release_date, release_id) AS sequence FROM releases GROUP BY custkey) x GROUP BY sequence ORDER BY customers DESC, sequence LIMIT 20"),
        "u04_exact_duplicates": "SELECT count(*) AS rows_all, count(*) - (SELECT count(*) FROM (SELECT DISTINCT award_id, release_id, award_value FROM raw_awards) x) AS removed FROM raw_awards",
        # data quality
        "d01_null_profile": " UNION ALL ".join(numeric(t, c) for t, c in (("procurements", "buyer_id"), ("procurements", "procurement_method"), ("procurements", "procurement_category"), ("procurements", "tender_value"), ("award_versions", "award_value"), ("award_versions", "contract_end"), ("award_suppliers", "supplier_id"), ("award_suppliers", "supplier_name"))),
        "d03_describe_values": f"SELECT count(tender_value) AS n, {mean('tender_value')} AS mean_value, {money('min(tender_value)')} AS least, {r2('max(q25)')} AS q1, {r2('max(q50)')} AS median_value, {r2('max(q75)')} AS q3, {money('max(tender_value)')} AS most FROM procurements LEFT JOIN tender_quantiles ON 1 = 1",
        "d04_grain_lineitem": "SELECT count(*) AS repeated_keys, count(CASE WHEN contents = 1 THEN 1 END) AS identical, count(CASE WHEN contents > 1 THEN 1 END) AS conflicting, CAST(sum(n) AS BIGINT) AS rows_in_them FROM (SELECT award_id, release_id, count(*) AS n, count(DISTINCT coalesce(CAST(release_date AS STRING), '') || '|' || coalesce(CAST(award_value AS STRING), '<NULL>') || '|' || CAST(suppkey AS STRING)) AS contents FROM raw_awards GROUP BY award_id, release_id HAVING count(*) > 1) x",
        "d05_conflict_fields": "SELECT award_id, release_id, concat_ws('; ', CASE WHEN a > 1 THEN 'award_value' END, CASE WHEN b > 1 THEN 'contract_end' END, CASE WHEN c > 1 THEN 'contract_start' END) AS fields FROM (SELECT award_id, release_id, count(DISTINCT coalesce(CAST(award_value AS STRING), '<NULL>')) AS a, count(DISTINCT coalesce(CAST(contract_end AS STRING), '<NULL>')) AS b, count(DISTINCT coalesce(CAST(contract_start AS STRING), '<NULL>')) AS c FROM raw_awards GROUP BY award_id, release_id HAVING count(*) > 1) x",
        "d06_ids_with_several_names": "SELECT supplier_id, count(*) AS relationships, count(DISTINCT supplier_name_normalized) AS names FROM award_suppliers WHERE supplier_id IS NOT NULL GROUP BY supplier_id HAVING count(DISTINCT supplier_name_normalized) > 1",
        "d07_placeholder_ids": f"""SELECT c.supplier_id, c.relationships, m.names FROM (SELECT supplier_id, count(*) AS relationships FROM award_suppliers WHERE supplier_id_quality = 'unreliable' AND supplier_id IS NOT NULL
            GROUP BY supplier_id) c LEFT JOIN (SELECT supplier_id AS id, {d.joined('supplier_name')} AS names FROM (
              SELECT supplier_id, supplier_name, row_number() OVER (PARTITION BY supplier_id ORDER BY supplier_name) AS rn FROM (
                SELECT DISTINCT supplier_id, supplier_name FROM award_suppliers WHERE supplier_id_quality = 'unreliable' AND supplier_id IS NOT NULL AND supplier_name IS NOT NULL) y) x
              WHERE rn <= 20 GROUP BY supplier_id) m ON c.supplier_id = m.id""",  # the first twenty names in order, so that no id has an unbounded list
        "d08_repeated_keys": "SELECT ocid, count(*) AS n, count(DISTINCT release_id) AS releases, count(DISTINCT award_value) AS award_values, count(DISTINCT contract_end) AS ends FROM raw_awards GROUP BY ocid HAVING count(*) > 1",
        "d09_releases_per_award": "SELECT count(*) AS awards, count(CASE WHEN n = 1 THEN 1 END) AS single, count(CASE WHEN n > 1 THEN 1 END) AS several, max(n) AS most FROM (SELECT award_id, count(*) AS n FROM award_versions GROUP BY award_id) x",
        "d10_tag_distribution": f"SELECT release_tag, count(*) AS releases, {pct('count(*)', 'sum(count(*)) OVER ()')} AS percent FROM releases GROUP BY release_tag",
        "d12_repeated_key_and_tag": "SELECT custkey, release_tag, count(*) AS n FROM releases GROUP BY custkey, release_tag HAVING count(*) > 1",
        "d13_supplier_multiplicity": "SELECT suppliers, count(*) AS awards FROM (SELECT award_id, count(*) AS suppliers FROM award_suppliers GROUP BY award_id) x GROUP BY suppliers",
        "d14_repeated_relationships": "SELECT award_id, supplier_key, count(*) AS n FROM award_suppliers GROUP BY award_id, supplier_key HAVING count(*) > 1",
        "d15_name_normalisation": "SELECT count(DISTINCT supplier_name) AS raw_names, count(DISTINCT supplier_name_normalized) AS normalised FROM award_suppliers",
        "d16_value_quality": f"SELECT count(award_value) AS present, {n(where='award_value = 0')} AS zero, {n(where='award_value < 0')} AS negative, {n(where='award_value > 100000000')} AS over_100m FROM award_versions",
        "d17_date_coverage": "SELECT CAST(extract(YEAR FROM release_date) AS BIGINT) AS year, count(*) AS releases FROM releases GROUP BY CAST(extract(YEAR FROM release_date) AS BIGINT)",
        "d19_award_versions": f"SELECT award_id, release_id, {money('award_value')} AS award_value, contract_start, contract_end FROM award_versions",
        "d20_relationships": "SELECT relationship_observation_key, supplier_key, supplier_id_quality, supplier_identity_flag, canonical_supplier_name, identity_review_flag FROM award_suppliers",
        "d21_supplier_master": "SELECT supplier_key, supplier_id, canonical_supplier_name, reported_name_count, relationship_count, supplier_id_quality, identity_review_flag FROM suppliers",
        "d22_procurement_master": f"SELECT ocid, buyer_name, buyer_id, procurement_method, procurement_category, {money('tender_value')} AS tender_value FROM procurements",
        "d23_resolution_log": " UNION ALL ".join(f"SELECT '{issue}' AS issue, '{action}' AS action, {rows} AS rows_removed" for issue, action, rows in (
            ("release_duplicates", "deduplicated", "(SELECT count(*) FROM releases) - (SELECT count(DISTINCT release_id) FROM releases)"), ("award_versions", "preserved", "(SELECT count(*) FROM raw_awards) - (SELECT count(*) FROM award_versions)"),
            ("supplier_relationship_duplicates", "deduplicated_exact_only", "(SELECT count(*) FROM raw_links) - (SELECT count(DISTINCT relationship_observation_key) FROM award_suppliers)"), ("unreliable_supplier_ids", "name_based_identity", "CAST(0 AS BIGINT)"),
            ("supplier_name_variations", "preserved_and_flagged", "CAST(0 AS BIGINT)"), ("award_lifecycle_updates", "preserved", "CAST(0 AS BIGINT)"))),
        "d24_quality_summary": " UNION ALL ".join(f"SELECT '{metric}' AS metric, count(*) AS value FROM {src}" for metric, src in (
            ("normalized_releases", "releases"), ("final_releases", "(SELECT DISTINCT release_id FROM releases) x"), ("normalized_awards", "raw_awards"), ("final_award_versions", "award_versions"), ("normalized_relationships", "raw_links"), ("final_relationships", "award_suppliers"),
            ("procurements", "procurements"), ("suppliers", "suppliers"), ("relationships_for_review", "award_suppliers WHERE supplier_identity_flag = 'id_multiple_names_review'"), ("unreliable_relationships", "award_suppliers WHERE supplier_id_quality = 'unreliable'"))),
        "d34_structure": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, {c} AS columns_used FROM {t}" for t, c in (("procurements", 10), ("award_versions", 10), ("suppliers", 7), ("award_suppliers", 13))),
        "d31_quality_gate": " UNION ALL ".join([
            check("primary key", "procurements.ocid", keys("procurements", ["ocid"])), check("primary key", "award_versions", keys("award_versions", ["award_id", "release_id"])), check("primary key", "suppliers", keys("suppliers", ["supplier_key"])),
            check("grain", "award_suppliers", keys("award_suppliers", ["award_id", "release_id", "supplier_index"])), check("version", "one latest", "SELECT count(*) AS v FROM (SELECT award_id FROM award_versions GROUP BY award_id HAVING sum(CASE WHEN is_latest THEN 1 ELSE 0 END) <> 1) x"),
            check("reference", "award to procurement", orphans("award_versions", "procurements", ["ocid"])), check("reference", "link to award", orphans("award_suppliers", "award_versions", ["award_id", "release_id"])), check("reference", "link to supplier", orphans("award_suppliers", "suppliers", ["supplier_key"])),
            check("range", "negative value", "SELECT count(*) AS v FROM award_versions WHERE award_value < 0"), check("range", "end before start", "SELECT count(*) AS v FROM award_versions WHERE contract_end < contract_start")]),
        "d32_row_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("procurements", "releases", "award_versions", "award_suppliers", "suppliers")),
        "d33_reconciliation": f"SELECT abs(a.v - b.v) <= 1 + 1e-9 * abs(b.v) AS reconciled, a.n = b.n AS same_count FROM (SELECT {money('sum(value)')} AS v, CAST(sum(awards) AS BIGINT) AS n FROM buyers) a JOIN (SELECT {money('sum(award_value)')} AS v, count(*) AS n FROM dataset) b ON 1 = 1",
        "d37_supplier_quality_populations": f"SELECT count(*) AS awards, {n(where='usable_suppliers = 0')} AS without_supplier, {n(where='reference_texts > 0')} AS with_reference_text, {n(where='usable_suppliers = 1')} AS single, {n(where='usable_suppliers > 1')} AS multiple FROM score_v3",
        "d38_buyer_quality": kpi({"buyers": "count(*)", "with_id": "count(CASE WHEN buyer_key LIKE 'ID:%' THEN 1 END)", "without_id": "count(CASE WHEN buyer_key LIKE 'NAME:%' THEN 1 END)", "several_names": "count(CASE WHEN names > 1 THEN 1 END)", "missing_values": "sum(missing_values)"}, "buyers"),
        # analyses
        "c01_dataset": f"SELECT award_id, method_group, value_band, duration_band, structure, {', '.join(f'{x} AS missing_{k}' for x, k in zip(flags, ('value', 'method', 'category', 'buyer_id', 'supplier')))} FROM dataset",
        "c02_value_kpis": f"SELECT count(*) AS awards, {money('sum(award_value)')} AS total, {mean('award_value')} AS average, {r2('max(q50)')} AS median_value, {money('max(award_value)')} AS most FROM dataset LEFT JOIN dataset_quantiles ON 1 = 1",
        "c03_allocation": f"SELECT supplier_key, award_id, release_id, supplier_count, {r2('share_value')} AS share_value FROM allocated_once",
        "c04_supplier_summary": f"SELECT supplier_key, name, awards, {r2('value')} AS value, rn AS value_rank, {pct('value', 'total')} AS value_share, {band('value', VALUE_BANDS, right=True)} AS value_band FROM supplier_ranks",
        "c05_supplier_concentration": " UNION ALL ".join(f"SELECT {p} AS percentile, count(*) AS suppliers, {r2('sum(value)')} AS value, {pct('sum(value)', 'max(total)')} AS share FROM supplier_ranks WHERE rn <= greatest(1, ceil(suppliers * {p} / 100.0))" for p in (1, 5, 10, 25, 50)),
        "c06_supplier_value_distribution": f"SELECT {band('value', VALUE_BANDS, right=True)} AS value_band, count(*) AS suppliers, {r2('sum(value)')} AS value FROM supplier_totals GROUP BY {band('value', VALUE_BANDS, right=True)}",
        "c07_supplier_diversification": f"SELECT a.supplier_key, count(DISTINCT p.buyer_name) AS buyers, count(DISTINCT a.award_id) AS awards, count(DISTINCT p.procurement_category) AS categories FROM allocated_once a JOIN procurements p ON a.ocid = p.ocid GROUP BY a.supplier_key",
        "c08_high_value_suppliers": f"SELECT supplier_key, name, awards, {r2('value')} AS value FROM supplier_totals WHERE value >= 100000000",
        "c09_structure_summary": struct,
        "c10_buyer_display": f"SELECT b.buyer_key, n.buyer_name, b.names FROM buyers b LEFT JOIN buyer_names n ON b.buyer_key = n.buyer_key",
        "c11_buyer_overview": buyers_ranked,
        "c12_supplier_exposure": f"SELECT d.buyer_key, count(DISTINCT u.supplier_key) AS suppliers, count(DISTINCT d.award_id) AS awards FROM dataset d JOIN usable_links u ON d.award_id = u.award_id AND d.release_id = u.release_id GROUP BY d.buyer_key",
        "c13_top_buyers_by_value": f"SELECT buyer_key, buyer_name, awards, {money('value')} AS value FROM overview o WHERE value IS NOT NULL ORDER BY o.value DESC, buyer_key LIMIT 25",
        "c13_top_buyers_by_count": f"SELECT buyer_key, buyer_name, awards, {money('value')} AS value FROM overview ORDER BY awards DESC, buyer_key LIMIT 25",
        "c14_method_by_buyer": f"SELECT buyer_key, method_group, count(*) AS awards, {money('sum(award_value)')} AS value, {pct('sum(award_value)', 'sum(sum(award_value)) OVER (PARTITION BY buyer_key)')} AS value_share FROM dataset GROUP BY buyer_key, method_group",
        "c15_direct_limited_exposure": f"SELECT buyer_key, {n(where=chr(32).join(('method_group IN', str(('Direct', 'Limited')))))} AS awards, {money('max(b.direct_value)')} AS value, {pct('max(b.direct_value)', 'max(b.value)')} AS share FROM dataset JOIN (SELECT buyer_key AS k, direct_value, value FROM buyers) b ON buyer_key = b.k GROUP BY buyer_key HAVING max(b.direct_value) IS NOT NULL",
        "c16_long_duration_exposure": f"SELECT buyer_key, count(*) AS awards, {money('sum(award_value)')} AS value, {r2('max(duration_days) / 365.25')} AS longest_years FROM dataset WHERE duration_days / 365.25 >= 10 GROUP BY buyer_key",
        "c17_median_segments": f"SELECT o.buyer_key, CASE WHEN o.awards >= m.a THEN 'Higher activity' ELSE 'Lower activity' END || ' / ' || CASE WHEN coalesce(o.value, 0) >= m.v THEN 'higher value' ELSE 'lower value' END AS segment FROM overview o JOIN (SELECT (SELECT q50 FROM buyer_award_quantiles) AS a, (SELECT q50 FROM buyer_filled_value_quantiles) AS v) m ON 1 = 1",
        "c18_buyer_review": f"SELECT buyer_key, buyer_name, {count_of} AS indicators, CASE WHEN {count_of} >= 3 THEN 'Higher review attention' WHEN {count_of} = 2 THEN 'Moderate review attention' WHEN {count_of} = 1 THEN 'Lower review attention' ELSE 'No additional indicator' END AS category, {joined} AS rationale FROM ({indicators}) x",
        "c19_activity_bands": f"SELECT a.activity_band, coalesce(x.buyers, 0) AS buyers, coalesce(x.awards, 0) AS awards, coalesce(x.value, 0) AS value, x.median_awards FROM ({_rows(_labels(ACTIVITY_BANDS), 'activity_band')}) a LEFT JOIN (SELECT activity_band, count(*) AS buyers, CAST(sum(awards) AS BIGINT) AS awards, {money('sum(value)')} AS value, {r2('max(q50)')} AS median_awards FROM overview LEFT JOIN activity_band_quantiles ON activity_band = k GROUP BY activity_band) x ON a.activity_band = x.activity_band",
        "c20_activity_value_matrix": f"SELECT a.activity_band, v.value_band, coalesce(x.buyers, 0) AS buyers, coalesce(x.awards, 0) AS awards, coalesce(x.value, 0) AS value FROM {dims} LEFT JOIN (SELECT activity_band, value_band, count(*) AS buyers, CAST(sum(awards) AS BIGINT) AS awards, {money('sum(value)')} AS value FROM overview GROUP BY activity_band, value_band) x ON a.activity_band = x.activity_band AND v.value_band = x.value_band",
        "c21_segment_summary": f"SELECT s.segment, coalesce(x.buyers, 0) AS buyers, coalesce(x.awards, 0) AS awards, coalesce(x.value, 0) AS value FROM ({_rows(SEGMENTS, 'segment')}) s LEFT JOIN (SELECT segment, count(*) AS buyers, CAST(sum(awards) AS BIGINT) AS awards, {money('sum(value)')} AS value FROM overview GROUP BY segment) x ON s.segment = x.segment",
        "c22_buyer_outliers": f"SELECT buyer_key, buyer_name, segment, awards, {money('value')} AS value FROM overview WHERE segment <> '{SEGMENTS[3]}'",
        "c23_activity_kpis": kpi({"buyers": "count(*)", "awards": "sum(awards)", "value": money("sum(value)"), "single_award_buyers": "count(CASE WHEN awards = 1 THEN 1 END)", "buyers_200": "count(CASE WHEN awards >= 200 THEN 1 END)", "median_awards": r2("max(q50)"), "most_awards": "max(awards)"}, "overview LEFT JOIN buyer_award_quantiles ON 1 = 1"),
        "c24_executive_kpis": kpi({"awards": "count(*)", "value": money("sum(award_value)"), "median_value": r2("max(q50)"), "most": money("max(award_value)"), "missing_value": "count(CASE WHEN award_value IS NULL THEN 1 END)", "missing_method": "count(CASE WHEN procurement_method IS NULL THEN 1 END)", "missing_category": "count(CASE WHEN procurement_category IS NULL THEN 1 END)", "missing_supplier": "count(CASE WHEN usable_suppliers = 0 THEN 1 END)",
            "priority": "count(CASE WHEN score >= 6 THEN 1 END)", "high": "count(CASE WHEN score >= 4 AND score < 6 THEN 1 END)", "most_points": "max(score)", "buyers": "count(DISTINCT buyer_key)"}, "dataset LEFT JOIN dataset_quantiles ON 1 = 1"),
        "c25_method_mart": by("method_group"), "c25_value_mart": by("value_band"), "c25_duration_mart": by("duration_band"),
        "c26_review_population": f"SELECT award_id, release_id, ocid, buyer_name, buyer_key, method_group, {money('award_value')} AS award_value, value_band, {r2('duration_days')} AS duration_days, duration_band, structure, score, category, rationale FROM dataset WHERE category IN ('Priority review', 'High review')",
        "c28_score_validation": f"SELECT score, category, count(*) AS awards, {pct('count(*)', 'sum(count(*)) OVER ()')} AS percent FROM dataset GROUP BY score, category",
        "c29_buyer_search": f"SELECT buyer_key, buyer_name, awards, {money('value')} AS value FROM overview WHERE lower(buyer_name) LIKE '%customer#00000001%'",
        "c30_supplier_search": f"SELECT supplier_key, name, awards, {r2('value')} AS value FROM supplier_totals WHERE lower(name) LIKE '%limited%'",
        "c31_structure_page": f"SELECT buyer_key, {money('direct_value')} AS value FROM buyers b WHERE direct_value IS NOT NULL ORDER BY b.direct_value DESC, buyer_key LIMIT 20",
        "c32_review_page": f"SELECT award_id, buyer_name, score, {money('award_value')} AS award_value FROM dataset WHERE category = 'Priority review'",
    }
    return out
