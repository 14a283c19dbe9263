"""The pages of the report: what a reader's choice leaves, its totals, and the lists under them. Each takes tables and returns tables by name.

Searches take the text literally, whatever its case; an empty one keeps everything, and rows without a name are left out by any other. Totals of nothing are zero.
Ties in lists go by key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tendrel.operators import examples
from tendrel.operators.ranking import settle
from tendrel.operators.relational import search

from . import marts_full
from .dialect import SPARK, TWIN
from .layer import Layer
from .oracles import _SIX, _V3
from .tables import REF6, like_any, usable_name, with_steps

CATEGORIES = ("Priority review", "High review")


def _sum(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def _found(df: DataFrame, column: str, text: str) -> DataFrame:
    return search(df, column, text) if text else df


def buyer_page(buyers: DataFrame, text: str = "", k: int = 15) -> dict[str, DataFrame]:
    """Over buyer_key, buyer_name, award_count, allocated_award_value: totals, the ``k`` largest by value and the ``k`` most active."""
    found = _found(buyers, "buyer_name", text)
    value, awards = F.desc_nulls_last("allocated_award_value"), F.desc_nulls_last("award_count")
    return {
        "totals": found.agg(F.count("*").alias("buyer_entities"), _sum("award_count").alias("awards"), _sum("allocated_award_value").cast("double").alias("allocated_award_value")),
        "largest": found.orderBy(value, "buyer_key").limit(k), "most_active": found.orderBy(awards, value, "buyer_key").limit(k),
    }


def supplier_page(suppliers: DataFrame, text: str = "", k: int = 20) -> dict[str, DataFrame]:
    """Over supplier_key, supplier_name, award_count, allocated_award_value: totals and the ``k`` largest by value."""
    found = _found(suppliers, "supplier_name", text)
    return {
        "totals": found.agg(F.count("*").alias("supplier_entities"), _sum("award_count").alias("awards"), _sum("allocated_award_value").cast("double").alias("allocated_award_value")),
        "largest": found.orderBy(F.desc_nulls_last("allocated_award_value"), "supplier_key").limit(k),
    }


def structure_figures(structure: DataFrame) -> DataFrame:
    """Three figures over the mart of structure."""
    of = lambda label, c: F.max(F.when(F.col("supplier_structure") == label, F.col(c)))
    return structure.agg(of("Single supplier", "award_count").alias("single_supplier_awards"), of("Multiple suppliers", "award_count").alias("multiple_supplier_awards"), of("Multiple suppliers", "value_share_percent").alias("multiple_supplier_value_share_percent"))


def most_value(buyers: DataFrame, column: str, k: int = 20) -> DataFrame:
    """The ``k`` buyers with most of the value in ``column``."""
    return buyers.orderBy(F.desc_nulls_last(column), "buyer_key").limit(k)


def structure_page(structure: DataFrame, direct_limited: DataFrame, long_duration: DataFrame, k: int = 20) -> dict[str, DataFrame]:
    """Over the marts of structure, direct or limited and long awards: three figures and the ``k`` buyers with most value in each list."""
    return {"figures": structure_figures(structure), "direct_limited": most_value(direct_limited, "direct_limited_value", k), "long_duration": most_value(long_duration, "long_duration_value", k)}


def review_page(review: DataFrame, categories: Sequence[str] = CATEGORIES) -> dict[str, DataFrame]:
    """Over the review population: how many of each category there are in all, how many the chosen categories leave, and those in order of score and value."""
    named = {f"{c.lower().replace(' ', '_')}_records": F.count_if(F.col("pri_category") == c) for c in CATEGORIES}
    chosen = review.where(F.col("pri_category").isin(list(categories)))
    shown = ("award_id", "buyer_name", "award_value", "award_date", "procurement_method", "procurement_category", "contract_duration_years", "usable_supplier_count", "supplier_names", "pri_score", "pri_category", "review_rationale")
    return {
        "counts": review.agg(*[c.alias(name) for name, c in named.items()], F.count("*").alias("pool_records"), F.count_if(F.col("pri_category").isin(list(categories))).alias("selected_records")),
        "table": chosen.select(*shown).orderBy(F.desc_nulls_last("pri_score"), F.desc_nulls_last("award_value"), "award_id"),
    }


def _frame(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return Layer(spark, sf_dir).frame(text)


def _mart(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _frame(spark, sf_dir, marts_full.statements(SPARK)[name])


def _buyers(part: str) -> Callable:
    return lambda s, d: _double(buyer_page(_frame(s, d, "SELECT buyer_key, buyer_name, awards AS award_count, coalesce(value, 0) AS allocated_award_value FROM overview"), "CUSTOMER#00000001")[part])


def _suppliers(part: str) -> Callable:
    return lambda s, d: _double(supplier_page(_frame(s, d, "SELECT supplier_key, name AS supplier_name, awards AS award_count, value AS allocated_award_value FROM supplier_totals"), "limited")[part])


def _structure(part: str) -> Callable:
    """A part of the structure page from the one mart under it: a mart that is only built runs jobs as well."""
    mart, made = {"figures": ("supplier_structure", structure_figures), "direct_limited": ("buyer_direct_limited", lambda df: most_value(df, "direct_limited_value")),
                  "long_duration": ("buyer_long_duration", lambda df: most_value(df, "long_duration_value"))}[part]
    return lambda s, d: made(_mart(s, d, f"mart_{mart}"))


def _review(part: str, categories: Sequence[str]) -> Callable:
    return lambda s, d: review_page(_mart(s, d, "mart_review_population"), categories)[part]


def _double(df: DataFrame) -> DataFrame:
    return df.withColumn("allocated_award_value", F.round(F.col("allocated_award_value").cast("decimal(30,6)"), 2).cast("double"))


def _links(s, d):
    return _frame(s, d, "SELECT award_id, release_id, supplier_index, supplier_id, supplier_name, supplier_key FROM award_suppliers")


def _name_examples(s, d):
    """Over the distinct names as they are and in capitals: both are what the names of all links have."""
    names = settle(_frame(s, d, "SELECT DISTINCT supplier_name FROM link_names"))
    return examples.name_examples(names.select(F.explode(F.array("supplier_name", F.upper("supplier_name"))).alias("supplier_name")), "supplier_name")


def _multiplicity(s, d):
    awards = _frame(s, d, "SELECT ocid, release_id, award_id FROM raw_awards")
    return examples.multiplicity({"ocid": (awards, "ocid"), "release_id": (awards, "release_id"), "award_id": (_links(s, d), "award_id")})


def _describe(s, d):
    found = examples.describe(_frame(s, d, "SELECT tender_value FROM procurements"), ["tender_value"])
    cents = lambda c, digits: F.round(F.col(c).cast("decimal(30,8)"), digits).cast("double").alias(c)
    return found.select("column", "count", cents("std", 0), *[cents(c, 2) for c in ("min", "q25", "q50", "q75", "max")])


def _populations(s, d):
    """Nine counts of awards and relationships in one pass over relationships summed by award version."""
    name = "coalesce(nullif(trim(canonical_supplier_name), ''), supplier_name)"
    usable, reference = usable_name("canonical_supplier_name"), like_any(name, REF6)
    count = lambda condition: f"count(CASE WHEN {condition} THEN 1 END)"
    links = f"""SELECT award_id, release_id, {count(usable)} AS usable, {count(f"{usable} AND identity_review_flag = 'review_name_variation'")} AS review,
        {count(f"{usable} AND supplier_identity_flag = 'id_multiple_names_review'")} AS several, {count(reference)} AS reference, {count(f'NOT {usable}')} AS unusable FROM award_suppliers GROUP BY award_id, release_id"""
    metrics = {
        "all_latest_awards": "count(l.award_id)", "latest_awards_with_valid_value": count("l.award_value >= 0"), "latest_awards_with_usable_supplier": count("l.award_value >= 0 AND k.usable > 0"),
        "latest_awards_without_usable_supplier": count("l.award_value >= 0 AND coalesce(k.usable, 0) = 0"), "supplier_relationship_identity_review": "coalesce(sum(CASE WHEN l.award_value >= 0 THEN k.review END), 0)",
        "supplier_relationship_multiple_names_per_id": "coalesce(sum(CASE WHEN l.award_value >= 0 THEN k.several END), 0)", "reference_text_relationships_full_dataset": "coalesce(sum(k.reference), 0)",
        "reference_text_relationships_latest_awards": count("l.award_value >= 0 AND k.reference > 0"), "unusable_supplier_relationships": "coalesce(sum(k.unusable), 0)",
    }
    rows = ", ".join(f"named_struct('metric', '{m}', 'count', v{i})" for i, m in enumerate(metrics))
    sums = ", ".join(f"{x} AS v{i}" for i, x in enumerate(metrics.values()))
    return _frame(s, d, f"SELECT inline(array({rows})) FROM (SELECT {sums} FROM latest l FULL OUTER JOIN ({links}) k ON l.award_id = k.award_id AND l.release_id = k.release_id) x")


_R2 = "CAST(round(CAST({} AS DECIMAL(30,8)), 2) AS DOUBLE)"
_KEY = r"CASE WHEN trim(coalesce(buyer_id, '')) <> '' THEN 'ID:' || trim(buyer_id) ELSE 'NAME:' || upper(trim(regexp_replace(coalesce(buyer_name, 'Unknown buyer'), '\s+', ' ', 'g'))) END"
_AWARDS = f"(SELECT *, {_KEY} AS buyer_key, coalesce(procurement_method, '') AS method FROM ({_V3}) v)"
_BUYERS = f"""(SELECT b.*, n.buyer_name FROM (SELECT buyer_key, count(*) AS award_count, coalesce(sum(award_value), 0) AS value FROM {_AWARDS} a GROUP BY buyer_key) b LEFT JOIN (
  SELECT buyer_key, buyer_name, row_number() OVER (PARTITION BY buyer_key ORDER BY count(*) DESC, buyer_name) AS place FROM {_AWARDS} a WHERE buyer_name IS NOT NULL GROUP BY 1, 2) n
  ON b.buyer_key = n.buyer_key AND place = 1)"""
_FOUND = f"{_BUYERS} b WHERE lower(buyer_name) LIKE '%customer#00000001%'"
_USABLE = f"(SELECT * FROM award_suppliers WHERE trim(coalesce(canonical_supplier_name, '')) <> '' AND NOT ({_SIX}))"
_SUPPLIERS = f"""(SELECT u.supplier_key, max(u.canonical_supplier_name) AS name, count(DISTINCT u.award_id) AS award_count, sum(CAST(CAST(l.award_value AS DOUBLE) / n AS DECIMAL(30,6))) AS value
  FROM {_USABLE} u JOIN (SELECT award_id, release_id, count(DISTINCT supplier_key) AS n FROM {_USABLE} x GROUP BY 1, 2) c ON u.award_id = c.award_id AND u.release_id = c.release_id
  JOIN latest l ON l.award_id = u.award_id AND l.release_id = u.release_id AND l.award_value >= 0 GROUP BY 1)"""
_NAMED = f"{_SUPPLIERS} s WHERE contains(lower(name), 'limited')"
_ROW = f"buyer_key, buyer_name, award_count, {_R2.format('value')} AS allocated_award_value"
_MANY = f"""(SELECT buyer_key, count(*) AS n, coalesce(sum(award_value), 0) AS v, max(days) AS days FROM {_AWARDS} a WHERE {{}} GROUP BY buyer_key) x JOIN {_BUYERS} b ON x.buyer_key = b.buyer_key"""
_PERCENT = "CAST(round(CAST(100 * {}::DOUBLE / nullif({}::DOUBLE, 0) AS DECIMAL(30,8)), 2) AS DOUBLE)"
_RATIONALE = """CASE WHEN score >= 6 THEN 'Multiple material screening signals' ELSE 'Several material screening signals' END"""
_RAW = r"trim(supplier_name, E' \t\n\r')"
_NORM = rf"upper(trim(regexp_replace({_RAW}, '\s+', ' ', 'g')))"
_GROUPS = f"(SELECT {_NORM} AS normalised, count(DISTINCT {_RAW}) AS raw_names FROM award_suppliers WHERE {_RAW} <> '' GROUP BY 1)"
_TEXTS = {"award_value": "CAST(award_value AS DECIMAL(20,2))", "contract_start": "strftime(contract_start, '%Y-%m-%d %H:%M:%S')", "contract_end": "strftime(contract_end, '%Y-%m-%d %H:%M:%S')", "award_status": "award_status"}
_CONFLICTS = " UNION ALL ".join(f"""SELECT ocid, count(*) AS rows, '{c}' AS field, count(DISTINCT coalesce(CAST({x} AS VARCHAR), '<NULL>')) AS distinct_values,
  array_to_string(list_slice(list_sort(list_distinct(list(coalesce(CAST({x} AS VARCHAR), '<NULL>')))), 1, 3), ' | ') AS "values" FROM raw_awards GROUP BY ocid HAVING count(DISTINCT coalesce(CAST({x} AS VARCHAR), '<NULL>')) > 1""" for c, x in _TEXTS.items())
_FIELDS = {"Method": "procurement_method", "Category": "procurement_category", "Buyer": "buyer_name"}


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("values", F.array_join("values", " | "))


_SQL: dict[str, tuple[Callable, str]] = {
    "c29_buyer_totals": (_buyers("totals"), f"SELECT count(*) AS buyer_entities, coalesce(sum(award_count), 0)::BIGINT AS awards, {_R2.format('coalesce(sum(value), 0)')} AS allocated_award_value FROM {_FOUND}"),
    "c29_largest_buyers": (_buyers("largest"), f"SELECT {_ROW} FROM {_FOUND} ORDER BY b.value DESC, buyer_key LIMIT 15"),
    "c29_most_active_buyers": (_buyers("most_active"), f"SELECT {_ROW} FROM {_FOUND} ORDER BY award_count DESC, b.value DESC, buyer_key LIMIT 15"),
    "c30_supplier_totals": (_suppliers("totals"), f"SELECT count(*) AS supplier_entities, coalesce(sum(award_count), 0)::BIGINT AS awards, {_R2.format('coalesce(sum(value), 0)')} AS allocated_award_value FROM {_NAMED}"),
    "c30_largest_suppliers": (_suppliers("largest"), f"SELECT supplier_key, name AS supplier_name, award_count, {_R2.format('value')} AS allocated_award_value FROM {_NAMED} ORDER BY s.value DESC, supplier_key LIMIT 20"),
    "c31_structure_figures": (_structure("figures"), f"""SELECT count(*) FILTER (WHERE usable_supplier_count = 1) AS single_supplier_awards, count(*) FILTER (WHERE usable_supplier_count > 1) AS multiple_supplier_awards,
      {_PERCENT.format('coalesce(sum(award_value) FILTER (WHERE usable_supplier_count > 1), 0)', 'sum(award_value) FILTER (WHERE usable_supplier_count > 0)')} AS multiple_supplier_value_share_percent FROM ({_V3}) v"""),
    "c31_direct_limited": (_structure("direct_limited"), f"""SELECT b.buyer_key, n AS direct_limited_awards, v::DOUBLE AS direct_limited_value, buyer_name, award_count, value::DOUBLE AS allocated_award_value,
      {_PERCENT.format('n', 'award_count')} AS direct_limited_award_share_percent, {_PERCENT.format('v', 'value')} AS direct_limited_value_share_percent
      FROM {_MANY.format("method IN ('direct', 'limited')")} ORDER BY v DESC, b.buyer_key LIMIT 20"""),
    "c31_long_duration": (_structure("long_duration"), f"""SELECT b.buyer_key, n AS long_duration_awards, v::DOUBLE AS long_duration_value, {_R2.format('days / 365.25')} AS maximum_duration_years, buyer_name, award_count,
      value::DOUBLE AS allocated_award_value, {_PERCENT.format('v', 'value')} AS long_duration_value_share_percent FROM {_MANY.format("days >= 10 * 365.25")} ORDER BY v DESC, b.buyer_key LIMIT 20"""),
    "c32_review_counts": (_review("counts", ("High review",)), f"""SELECT count(*) FILTER (WHERE score >= 6) AS priority_review_records, count(*) FILTER (WHERE score < 6) AS high_review_records, count(*) AS pool_records,
      count(*) FILTER (WHERE score < 6) AS selected_records FROM ({_V3}) v WHERE score >= 4"""),
    "c32_review_table": (_review("table", CATEGORIES), f"""SELECT award_id, buyer_name, award_value::DOUBLE AS award_value, award_date, procurement_method, procurement_category, {_R2.format('days / 365.25')} AS contract_duration_years,
      usable_supplier_count, supplier_names, score AS pri_score, CASE WHEN score >= 6 THEN 'Priority review' ELSE 'High review' END AS pri_category, {_RATIONALE} AS review_rationale FROM ({_V3}) v WHERE score >= 4"""),
    "d03_describe": (_describe, f"""SELECT 'tender_value' AS "column", count(tender_value) AS count, CAST(round(CAST(stddev_samp(tender_value::DOUBLE) AS DECIMAL(30,8)), 0) AS DOUBLE) AS std,
      {', '.join(f"{_R2.format(x)} AS {name}" for name, x in {'min': 'min(tender_value)', 'q25': 'quantile_cont(tender_value::DOUBLE, 0.25)', 'q50': 'quantile_cont(tender_value::DOUBLE, 0.5)', 'q75': 'quantile_cont(tender_value::DOUBLE, 0.75)', 'max': 'max(tender_value)'}.items())} FROM procurements"""),
    "d05_conflict_values": (lambda s, d: _joined(examples.conflict_values(_frame(s, d, f"SELECT ocid, {', '.join(_TEXTS)} FROM raw_awards"), ["ocid"], k=3)), _CONFLICTS),
    "d13_multiplicity": (_multiplicity, " UNION ALL ".join(f"SELECT '{p}' AS parent, count(*) AS parents, max(n) AS largest, count(*) FILTER (WHERE n > 1) AS several FROM (SELECT count(*) AS n FROM {t} GROUP BY {p}) x" for p, t in (("ocid", "raw_awards"), ("release_id", "raw_awards"), ("award_id", "award_suppliers")))),
    "d15_name_effect": (lambda s, d: examples.name_effect(_links(s, d), "supplier_name"), f"""SELECT unnest(['raw_names', 'normalised_names', 'revealed', 'groups_with_several']) AS metric,
      unnest([sum(raw_names), count(*), sum(raw_names) - count(*), count(*) FILTER (WHERE raw_names > 1)])::BIGINT AS value FROM {_GROUPS} g"""),
    "d15_name_examples": (_name_examples,
      f"""SELECT DISTINCT normalised, raw_names, {_RAW} AS raw_name FROM (SELECT supplier_name FROM award_suppliers UNION ALL SELECT upper(supplier_name) FROM award_suppliers) a JOIN (
      SELECT {_NORM} AS normalised, count(DISTINCT {_RAW}) AS raw_names FROM (SELECT supplier_name FROM award_suppliers UNION ALL SELECT upper(supplier_name) FROM award_suppliers) b WHERE {_RAW} <> ''
      GROUP BY 1 HAVING count(DISTINCT {_RAW}) > 1 ORDER BY 2 DESC, 1 LIMIT 15) g ON {_NORM} = normalised"""),
    "d37_populations": (_populations, f"""SELECT * FROM (WITH v AS (SELECT * FROM latest WHERE award_value >= 0), u AS {_USABLE}, w AS (SELECT u.* FROM u SEMI JOIN v USING (award_id, release_id)),
      r AS (SELECT * FROM award_suppliers WHERE {_SIX} OR (trim(coalesce(canonical_supplier_name, '')) = '' AND ({_SIX.replace('canonical_supplier_name', 'supplier_name')}))),
      c AS (SELECT (SELECT count(*) FROM latest) AS a, (SELECT count(*) FROM v) AS b, (SELECT count(DISTINCT (award_id, release_id)) FROM w) AS c)
      SELECT 'all_latest_awards' AS metric, a AS count FROM c UNION ALL SELECT 'latest_awards_with_valid_value', b FROM c UNION ALL SELECT 'latest_awards_with_usable_supplier', c FROM c
      UNION ALL SELECT 'latest_awards_without_usable_supplier', b - c FROM c UNION ALL SELECT 'supplier_relationship_identity_review', count(*) FROM w WHERE identity_review_flag = 'review_name_variation'
      UNION ALL SELECT 'supplier_relationship_multiple_names_per_id', count(*) FROM w WHERE supplier_identity_flag = 'id_multiple_names_review' UNION ALL SELECT 'reference_text_relationships_full_dataset', count(*) FROM r
      UNION ALL SELECT 'reference_text_relationships_latest_awards', count(DISTINCT (award_id, release_id)) FROM r SEMI JOIN v USING (award_id, release_id)
      UNION ALL SELECT 'unusable_supplier_relationships', (SELECT count(*) FROM award_suppliers) - (SELECT count(*) FROM u)) z"""),
    "t06_samples": (lambda s, d: _joined(examples.samples(_frame(s, d, f"SELECT {', '.join(_FIELDS.values())} FROM procurements"), _FIELDS | {"Not there": "no_such_column"})), " UNION ALL ".join(
      f"""SELECT '{label}' AS field, array_to_string(list_slice(list_sort(list_distinct(list({c}) FILTER (WHERE {c} IS NOT NULL))), 1, 5), ' | ') AS "values" FROM procurements""" for label, c in _FIELDS.items())),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _SQL.items()}


def oracle_sql() -> dict[str, str]:
    """For DuckDB, written by hand over the procurement tables."""
    return {k: with_steps(sql, TWIN) for k, (_, sql) in _SQL.items()}

