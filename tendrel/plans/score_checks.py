"""Tables that validate the first review score: how its scores, categories and points are spread, which buyers and awards they point to."""

from __future__ import annotations

from . import oracles
from .dialect import TWIN, Dialect, money, n, pct, r2
from .tables import with_steps

POINTS = ("value_points", "duration_points", "method_points", "single_supplier_points", "quality_points")
CATEGORIES = ("Priority review", "High review", "Moderate review", "Lower review priority")
_NAMED = "value_points, duration_points, method_points, single_supplier_points, quality_points AS supplier_data_quality_points"


def statements(d: Dialect) -> dict[str, str]:
    """For Spark: every table is one pass over the scored awards, the tops are Spark's own top-k."""
    share = f"{pct('count(*)', 'sum(count(*)) OVER ()')} AS percentage"
    counts = ", ".join(f"{n(where=f'{p} > 0')} AS n{k}" for k, p in enumerate(POINTS))
    listed = ", ".join(f"named_struct('component', '{p if p != 'quality_points' else 'supplier_data_quality_points'}', 'records', n{k}, 'percentage', {pct(f'n{k}', 'n')})" for k, p in enumerate(POINTS))
    return {
        "c28_scores": f"SELECT score AS pri_score, count(*) AS records, {share} FROM score_v1 GROUP BY score",
        "c28_categories": f"SELECT category AS pri_category, count(*) AS records, {share} FROM score_v1 GROUP BY category",
        "c28_components": f"SELECT inline(array({listed})) FROM (SELECT count(*) AS n, {counts} FROM score_v1) x",
        "c28_combinations": f"""SELECT {_NAMED}, records FROM (SELECT {', '.join(POINTS)}, count(*) AS records FROM score_v1 GROUP BY {', '.join(POINTS)}) x
            ORDER BY records DESC, {', '.join(POINTS)} LIMIT 20""",
        "c28_methods": f"""SELECT coalesce(procurement_method, 'Unknown') AS procurement_method, {', '.join(f"{n(where=f"category = '{c}'")} AS {c.lower().replace(' ', '_')}" for c in CATEGORIES)}
            FROM score_v1 GROUP BY coalesce(procurement_method, 'Unknown')""",
        "c28_buyers": f"""SELECT buyer_name, review_records, {money('total')} AS total_allocated_award_value, max_pri_score FROM (SELECT buyer_name, count(*) AS review_records, coalesce(sum(award_value), 0) AS total,
            max(score) AS max_pri_score FROM score_v1 WHERE score >= 3 AND buyer_name IS NOT NULL GROUP BY buyer_name) x ORDER BY review_records DESC, total DESC, buyer_name LIMIT 25""",
        "c28_data_quality": """SELECT quality_points AS supplier_data_quality_points, count(*) AS records, CAST(sum(score) AS DOUBLE) / count(*) AS average_pri_score, max(score) AS maximum_pri_score
            FROM score_v1 GROUP BY quality_points""",
        "c28_candidates": f"""SELECT award_id, buyer_name, procurement_category, procurement_method, award_date, {money('x.award_value')} AS award_value, {r2('duration_days / 365.25')} AS duration_years,
            usable_suppliers AS usable_supplier_count, {_NAMED}, score AS pri_score, category AS pri_category FROM score_v1 x WHERE score >= 3
            ORDER BY score DESC, x.award_value DESC NULLS LAST, award_id LIMIT 50""",
    }


def oracle_sql() -> dict[str, str]:
    """For DuckDB, by hand over the first score's own oracle."""
    rows = f"(SELECT *, CASE WHEN score >= 7 THEN 'Priority review' WHEN score >= 5 THEN 'High review' WHEN score >= 3 THEN 'Moderate review' ELSE 'Lower review priority' END AS pri_category FROM ({oracles._V1}) v)"
    percent = "CAST(round(CAST(100 * count(*)::DOUBLE / (SELECT count(*) FROM {0} w)::DOUBLE AS DECIMAL(30,8)), 2) AS DOUBLE)".format(rows)
    points = ("value_points", "duration_points", "method_points", "single_supplier_points", "supplier_data_quality_points")
    found = {
        "c28_scores": f"SELECT score AS pri_score, count(*) AS records, {percent} AS percentage FROM {rows} t GROUP BY score",
        "c28_categories": f"SELECT pri_category, count(*) AS records, {percent} AS percentage FROM {rows} t GROUP BY pri_category",
        "c28_components": " UNION ALL ".join(f"SELECT '{p}' AS component, count(*) AS records, {percent} AS percentage FROM {rows} t WHERE {p} > 0" for p in points),
        "c28_combinations": f"SELECT {', '.join(points)}, count(*) AS records FROM {rows} t GROUP BY ALL ORDER BY records DESC, {', '.join(points)} LIMIT 20",
        "c28_methods": f"""SELECT coalesce(procurement_method, 'Unknown') AS procurement_method, sum((score >= 7)::INT)::BIGINT AS priority_review, sum((score IN (5, 6))::INT)::BIGINT AS high_review,
          sum((score IN (3, 4))::INT)::BIGINT AS moderate_review, sum((score < 3)::INT)::BIGINT AS lower_review_priority FROM {rows} t GROUP BY 1""",
        "c28_buyers": f"""SELECT buyer_name, count(*) AS review_records, CAST(coalesce(sum(award_value), 0) AS DOUBLE) AS total_allocated_award_value, max(score) AS max_pri_score FROM {rows} t
          WHERE score >= 3 AND buyer_name IS NOT NULL GROUP BY buyer_name ORDER BY review_records DESC, coalesce(sum(award_value), 0) DESC, buyer_name LIMIT 25""",
        "c28_data_quality": f"SELECT supplier_data_quality_points, count(*) AS records, avg(score) AS average_pri_score, max(score) AS maximum_pri_score FROM {rows} t GROUP BY 1",
        "c28_candidates": f"""SELECT award_id, buyer_name, procurement_category, procurement_method, award_date, CAST(t.award_value AS DOUBLE) AS award_value, duration_years, usable_supplier_count, {', '.join(points)},
          score AS pri_score, pri_category FROM {rows} t WHERE score >= 3 ORDER BY score DESC, t.award_value DESC NULLS LAST, award_id LIMIT 50""",
    }
    return {k: with_steps(v, TWIN) for k, v in found.items()}
