"""The procurement tables as SQL over orders, lineitem, customer and supplier, and the steps that analyses share."""

from __future__ import annotations

import re

from . import ranks
from .dialect import Dialect

# Bands as (code, label, lowest, below); patterns of names that are no supplier's; cuts and labels of the scores.
VALUE_BANDS = (("1", "<£100K", None, 100_000), ("2", "£100K-<£1M", 100_000, 1_000_000), ("3", "£1M-<£10M", 1_000_000, 10_000_000),
               ("4", "£10M-<£100M", 10_000_000, 100_000_000), ("5", "£100M-<£1B", 100_000_000, 1_000_000_000), ("6", "£1B+", 1_000_000_000, None))
TENDER_BANDS = (("1", "< £100K", None, 100_000), ("2", "£100K - < £1M", 100_000, 1_000_000), ("3", "£1M - < £10M", 1_000_000, 10_000_000),
                ("4", "£10M - < £100M", 10_000_000, 100_000_000), ("5", "£100M - < £1B", 100_000_000, 1_000_000_000), ("6", "£1B+", 1_000_000_000, None))
SUPPLIER_VALUE_BANDS = (("1", "< 100K", None, 100_000), ("2", "100K-< 1M", 100_000, 1_000_000), ("3", "1M-< 10M", 1_000_000, 10_000_000),
                        ("4", "10M-< 100M", 10_000_000, 100_000_000), ("5", "100M-< 1B", 100_000_000, 1_000_000_000), ("6", "1B+", 1_000_000_000, None))
DURATION_BANDS = (("1", "<1 year", None, 1), ("2", "1-<3 years", 1, 3), ("3", "3-<5 years", 3, 5), ("4", "5-<10 years", 5, 10), ("5", "10-<20 years", 10, 20), ("6", "20+ years", 20, None))
ACTIVITY_BANDS = (("1", "1 award", None, 2), ("2", "2-9 awards", 2, 10), ("3", "10-49 awards", 10, 50), ("4", "50-199 awards", 50, 200), ("5", "200+ awards", 200, None))
SUPPLIER_COUNT_BANDS = (("1", "Single supplier", None, 2), ("2", "2 suppliers", 2, 3), ("3", "3 suppliers", 3, 4), ("4", "4-5 suppliers", 4, 6), ("5", "6-10 suppliers", 6, 11), ("6", "11+ suppliers", 11, None))
NAME_QUALITY = ("Missing supplier name", "Redacted / unavailable", "Source-text contamination", "Usable supplier name")
REF1 = ("successful supplier",)
REF5 = ("successful supplier", "supplier list", "see webpage", "contract award details", "attachments")
REF6 = (*REF5, "please see")
REDACTED = ("redacted", "foia")
CONTAMINATED = ("successful supplier", "supplier list", "see contracts finder", "see webpage", "contract award details", "attachments")
PLACEHOLDER_IDS = ("GB-COH-0", "GB-COH-NA", "NA", "N/A", "NONE", "NULL", "")
LONG_YEARS, YEAR_DAYS = (10, 20), 365.25


def band(x: str, bands: tuple, unknown: str = "Unknown", right: bool = False) -> str:
    """The label of the band of ``x``; bands take their lower edge, or with ``right`` their upper one."""
    edge = "<=" if right else "<"
    return f"CASE WHEN {x} IS NULL THEN '{unknown}' " + " ".join(f"WHEN {x} {edge} {hi} THEN '{label}'" for _, label, _, hi in bands if hi is not None) + f" ELSE '{bands[-1][1]}' END"


def like_any(x: str, patterns: tuple) -> str:
    return "(" + " OR ".join(f"lower({x}) LIKE '%{p}%'" for p in patterns) + ")"


def usable_name(x: str, patterns: tuple = REF6) -> str:
    return f"({x} IS NOT NULL AND trim({x}) <> '' AND NOT {like_any(x, patterns)})"


def name_quality(x: str) -> str:
    missing, redacted, contaminated, usable = NAME_QUALITY
    return (f"CASE WHEN {x} IS NULL OR trim({x}) = '' THEN '{missing}' WHEN {like_any(x, REDACTED)} THEN '{redacted}' "
            f"WHEN {like_any(x, CONTAMINATED)} THEN '{contaminated}' ELSE '{usable}' END")  # fmt: skip


def method_group(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR trim({x}) = '' THEN 'Unknown' WHEN lower({x}) LIKE '%direct%' THEN 'Direct' WHEN lower({x}) LIKE '%limited%' THEN 'Limited' "
            f"WHEN lower({x}) LIKE '%selective%' THEN 'Selective' WHEN lower({x}) LIKE '%open%' THEN 'Open' ELSE 'Other' END")  # fmt: skip


def score_v(version: int, d: Dialect) -> dict[str, str]:
    """Points of each part over a row with award_value, contract_start, contract_end, procurement_method, usable_suppliers, review, unreliable."""
    days = d.days("contract_start", "contract_end")
    years = f"round(CAST({days} / 365.25 AS DECIMAL(20,8)), 2)"
    ends = (f"{days} >= 20 * 365.25", f"{days} >= 10 * 365.25") if version == 3 else (f"{years} >= 20", f"{years} >= 10")
    method = ("lower(procurement_method) LIKE '%direct%'", "lower(procurement_method) LIKE '%limited%'") if version == 3 else ("lower(procurement_method) = 'direct'", "lower(procurement_method) = 'limited'")
    return {
        "value_points": "CASE WHEN award_value >= 1000000000 THEN 3 WHEN award_value >= 100000000 THEN 2 ELSE 0 END",
        "duration_points": f"CASE WHEN {ends[0]} THEN 2 WHEN {ends[1]} THEN 1 ELSE 0 END",
        "method_points": f"CASE WHEN {method[0]} THEN 2 WHEN {method[1]} THEN 1 ELSE 0 END",
        "single_supplier_points": "CASE WHEN usable_suppliers = 1 THEN 1 ELSE 0 END",
        **({"quality_points": "CASE WHEN review > 0 OR unreliable > 0 THEN 1 ELSE 0 END"} if version == 1 else {}),
    }


CUTS = {1: (7, 5, 3), 2: (6, 4, 2), 3: (6, 4, 2)}


def score_category(x: str, version: int) -> str:
    a, b, c = CUTS[version]
    return f"CASE WHEN {x} >= {a} THEN 'Priority review' WHEN {x} >= {b} THEN 'High review' WHEN {x} >= {c} THEN 'Moderate review' ELSE 'Lower review priority' END"


def score_rationale(x: str, version: int) -> str:
    a, b, c = CUTS[version]
    top = "Multiple high-priority" if version == 1 else "Multiple material"
    return f"CASE WHEN {x} >= {a} THEN '{top} screening signals' WHEN {x} >= {b} THEN 'Several material screening signals' WHEN {x} >= {c} THEN 'At least one material screening signal' ELSE 'Limited screening signals' END"


def steps(d: Dialect) -> dict[str, str]:
    """Name to SELECT, each over tables and steps named before it."""
    factor = lambda x, m, top: "CASE " + " ".join(f"WHEN {x} % {m} = {k} THEN {f}" for k, f in enumerate((1, 10, 100, 1000, 10_000, 100_000)[: top])) + " ELSE 1 END"
    placeholder = f"(supplier_id IS NULL OR upper(trim(supplier_id)) IN ({', '.join(repr(p) for p in PLACEHOLDER_IDS)}))"
    norm = f"upper({d.squeezed('supplier_name')})"
    base = lambda version: ", ".join(f"{sql} AS {name}" for name, sql in score_v(version, d).items())
    total = lambda version: " + ".join(score_v(version, d))
    usable_as = {1: "(canonical_supplier_name IS NOT NULL AND supplier_identity_flag = 'confirmed_id')", 2: usable_name("canonical_supplier_name", REF5), 3: usable_name("canonical_supplier_name", REF6)}
    for_review = {1: "identity_review_flag = 'review_name_variation'", 2: "supplier_identity_flag = 'id_multiple_names_review'", 3: "supplier_identity_flag = 'id_multiple_names_review'"}
    counted = lambda version: f"""count(DISTINCT CASE WHEN {usable_as[version]} THEN supplier_key END) AS usable_suppliers,
        count(CASE WHEN {for_review[version]} THEN 1 END) AS review, count(CASE WHEN supplier_id_quality = 'unreliable' THEN 1 END) AS unreliable,
        count(CASE WHEN {like_any('canonical_supplier_name', REF6 if version == 3 else REF1)} THEN 1 END) AS reference_texts, {d.joined('canonical_supplier_name')} AS supplier_names,
        {d.joined(f"CASE WHEN {usable_as[version]} THEN canonical_supplier_name END")} AS usable_names,
        count(CASE WHEN {like_any('canonical_supplier_name', REF6)} THEN 1 END) AS reference_names"""  # noqa: E731
    counts = lambda version: f"SELECT award_id, release_id, {counted(version)} FROM award_suppliers GROUP BY award_id, release_id"
    # Spark has an award's counts in the row of its latest version, and joins by number
    c, sides = ("l", "l LEFT JOIN procurements p ON l.order_number = p.order_number") if d.spark else ("c", "l LEFT JOIN procurements p ON l.ocid = p.ocid LEFT JOIN counts_v{0} c ON l.award_id = c.award_id AND l.release_id = c.release_id")
    scored = lambda version, where: f"""SELECT *, {total(version)} AS score, {score_category(total(version), version)} AS category, {score_rationale(total(version), version)} AS rationale FROM (
        SELECT l.award_id, l.release_id, l.ocid, l.award_value, l.contract_start, l.contract_end, {d.days('l.contract_start', 'l.contract_end')} AS duration_days, p.buyer_name, p.buyer_id,
          p.procurement_method, p.procurement_category, coalesce({c}.usable_suppliers, 0) AS usable_suppliers, coalesce({c}.review, 0) AS review, coalesce({c}.unreliable, 0) AS unreliable, coalesce({c}.reference_texts, 0) AS reference_texts,
          coalesce({c}.reference_names, 0) AS reference_names, {c}.supplier_names, {c}.usable_names, l.release_date, l.award_status, l.award_date, l.award_currency, l.award_title, p.tender_title, p.tender_status, p.cpv_code,
          p.tender_value, p.tender_currency, {base(version)}
        FROM (SELECT * FROM {f'counted_v{version}' if d.spark else 'latest'} WHERE {where}) {sides.format(version)}) x"""  # noqa: E731
    both_dates = "contract_start IS NOT NULL AND contract_end IS NOT NULL"
    award = f"""SELECT CAST(l_orderkey AS STRING) AS award_id, CAST(l_orderkey AS STRING) AS ocid, CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS release_id, l_shipdate AS release_date, l_linenumber AS award_index,
            CAST(CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(14,2)) * {factor('l_partkey', 6, 6)} END AS DECIMAL(20,2)) AS award_value, l_shipdate AS contract_start,
            CASE WHEN l_tax = 0.08 THEN NULL WHEN l_discount = 0 AND l_quantity < 5 THEN {d.plus_days('l_shipdate', '-30')} ELSE {d.plus_days('l_shipdate', 'l_quantity * 160')} END AS contract_end, l_partkey AS partkey, l_suppkey AS suppkey, {d.plus_days('l_shipdate', '-14')} AS award_date,
            CASE l_linestatus WHEN 'F' THEN 'complete' ELSE 'active' END AS award_status, 'GBP' AS award_currency, 'Award ' || CAST(l_orderkey AS STRING) AS award_title"""
    identity = """CASE WHEN suppkey % 10 = 0 THEN 'GB-COH-0' WHEN suppkey % 10 = 1 THEN NULL ELSE 'GB-COH-' || CAST(suppkey AS STRING) END AS supplier_id,
            CASE WHEN suppkey % 25 = 3 THEN 'See attachments' WHEN suppkey % 25 = 4 THEN 'Please see supplier list' WHEN suppkey % 25 = 5 THEN 'REDACTED under FOIA' WHEN suppkey % 25 = 6 AND partkey % 2 = 0 THEN 'Successful supplier below' WHEN suppkey % 41 = 11 THEN NULL
              WHEN partkey % 3 = 0 THEN upper(s_name) || ' LIMITED' ELSE s_name || ' Ltd.' END AS supplier_name"""
    out = {
        "procurements": f"""SELECT CAST(o_orderkey AS STRING) AS ocid, 'Order ' || CAST(o_orderkey AS STRING) AS tender_title, o_orderstatus AS tender_status,
            CASE WHEN o_orderkey % 4 = 1 THEN upper(c_name) ELSE c_name END AS buyer_name, CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END AS buyer_id,
            CASE o_orderpriority WHEN '1-URGENT' THEN 'direct' WHEN '2-HIGH' THEN 'limited' WHEN '3-MEDIUM' THEN 'selective' WHEN '5-LOW' THEN 'open' END AS procurement_method,
            CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE lower(c_mktsegment) END AS procurement_category,
            CAST(CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(14,2)) * {factor('o_orderkey', 7, 6)} END AS DECIMAL(20,2)) AS tender_value, 'GBP' AS tender_currency,
            CAST(45000000 + o_custkey % 1000 AS STRING) AS cpv_code{', o_orderkey AS order_number' if d.spark else ''}
            FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 97 <> 13""",
        "releases": "SELECT CAST(o_orderkey AS STRING) AS release_id, CAST(o_orderkey AS STRING) AS ocid, o_orderdate AS release_date, CASE o_orderstatus WHEN 'F' THEN 'award' WHEN 'O' THEN 'tender' WHEN 'P' THEN 'awardUpdate' END AS release_tag, o_custkey AS custkey FROM orders",
        "raw_awards": f"{award} FROM lineitem",
        "one_release": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY award_id, release_id ORDER BY release_date DESC, partkey, suppkey) AS rn FROM raw_awards) x WHERE rn = 1",
        "award_versions": """SELECT *, award_version_number = award_version_count AS is_latest FROM (
            SELECT award_id, release_id, ocid, release_date, award_index, award_value, contract_start, contract_end, award_date, award_status, award_currency, award_title, row_number() OVER (PARTITION BY award_id ORDER BY release_date NULLS FIRST, release_id) AS award_version_number,
              count(*) OVER (PARTITION BY award_id) AS award_version_count FROM one_release) x""",
        "latest": "SELECT * FROM award_versions WHERE is_latest",
        "raw_links": f"""SELECT award_id, release_id, ocid, row_number() OVER (PARTITION BY award_id, release_id ORDER BY release_date, partkey, suppkey) - 1 AS supplier_index,
            {identity} FROM raw_awards JOIN supplier ON suppkey = s_suppkey""",
        "keyed_links": f"""SELECT *, {norm} AS supplier_name_normalized, CASE WHEN {placeholder} THEN 'unreliable' ELSE 'usable' END AS supplier_id_quality,
            CASE WHEN NOT {placeholder} THEN 'SUP_ID:' || upper(trim(supplier_id)) WHEN {norm} IS NOT NULL AND {norm} <> '' THEN 'NAME:' || {norm}
              ELSE 'UNKNOWN:' || award_id || ':' || CAST(supplier_index AS STRING) END AS supplier_key FROM raw_links""",
        "id_names": "SELECT supplier_id AS named_id, count(DISTINCT supplier_name_normalized) AS supplier_id_name_count FROM keyed_links WHERE supplier_id_quality = 'usable' GROUP BY supplier_id",
        "name_counts": "SELECT supplier_key, supplier_name_normalized AS name, count(*) AS times FROM keyed_links WHERE supplier_name_normalized IS NOT NULL GROUP BY supplier_key, supplier_name_normalized",
        "canonical": "SELECT supplier_key AS canonical_key, name AS canonical_supplier_name FROM (SELECT *, row_number() OVER (PARTITION BY supplier_key ORDER BY times DESC, name) AS rn FROM name_counts) x WHERE rn = 1",
        "suppliers": """SELECT k.supplier_key, k.supplier_id, c.canonical_supplier_name, k.reported_name_count, k.relationship_count, k.supplier_id_quality,
            CASE WHEN k.reported_name_count > 1 THEN 'review_name_variation' ELSE 'no_name_conflict' END AS identity_review_flag FROM (
              SELECT supplier_key, min(CASE WHEN supplier_id_quality = 'usable' THEN supplier_id END) AS supplier_id, count(DISTINCT supplier_name_normalized) AS reported_name_count, count(*) AS relationship_count,
                CASE WHEN max(CASE WHEN supplier_id_quality = 'usable' THEN 1 ELSE 0 END) = 1 THEN 'usable' ELSE 'unreliable_or_missing' END AS supplier_id_quality FROM keyed_links GROUP BY supplier_key) k
            LEFT JOIN canonical c ON k.supplier_key = c.canonical_key""",
        "award_suppliers": """SELECT k.award_id, k.release_id, k.ocid, k.supplier_index, k.supplier_id, k.supplier_name, k.supplier_name_normalized, k.supplier_id_quality, k.supplier_key, i.supplier_id_name_count,
            CASE WHEN k.supplier_id_quality = 'unreliable' THEN 'unreliable_id_name_based' WHEN i.supplier_id_name_count > 1 THEN 'id_multiple_names_review' ELSE 'confirmed_id' END AS supplier_identity_flag,
            s.canonical_supplier_name, s.identity_review_flag, k.award_id || '|' || k.release_id || '|' || CAST(k.supplier_index AS STRING) AS relationship_observation_key
            FROM keyed_links k JOIN suppliers s ON k.supplier_key = s.supplier_key LEFT JOIN id_names i ON k.supplier_id_quality = 'usable' AND k.supplier_id = i.named_id""",
        "usable_links": f"SELECT * FROM award_suppliers WHERE {usable_name('canonical_supplier_name')}",
        "link_counts": "SELECT award_id, release_id, count(DISTINCT supplier_key) AS supplier_count FROM usable_links GROUP BY award_id, release_id",
        "allocated": """SELECT u.supplier_key, u.canonical_supplier_name, l.award_id, l.release_id, l.ocid, l.award_value, c.supplier_count, CAST(l.award_value AS DOUBLE) / c.supplier_count AS share_value
            FROM latest l JOIN usable_links u ON l.award_id = u.award_id AND l.release_id = u.release_id JOIN link_counts c ON l.award_id = c.award_id AND l.release_id = c.release_id WHERE l.award_value >= 0""",
        "allocated_once": "SELECT DISTINCT supplier_key, canonical_supplier_name, award_id, release_id, ocid, award_value, supplier_count, share_value FROM allocated",
        "supplier_totals": "SELECT supplier_key, max(canonical_supplier_name) AS name, count(DISTINCT award_id) AS awards, sum(CAST(share_value AS DECIMAL(30,6))) AS value FROM allocated GROUP BY supplier_key",
        "award_counts": "SELECT award_id, count(DISTINCT supplier_key) AS supplier_count FROM award_suppliers GROUP BY award_id",
        "allocations": """SELECT a.supplier_key, count(DISTINCT a.award_id) AS award_count, sum(CAST(coalesce(CAST(l.award_value AS DOUBLE) / c.supplier_count, 0) AS DECIMAL(30,6))) AS value
            FROM award_suppliers a JOIN award_counts c ON a.award_id = c.award_id JOIN latest l ON a.award_id = l.award_id GROUP BY a.supplier_key""",
        "usable_allocations": f"""SELECT x.*, s.canonical_supplier_name, s.identity_review_flag FROM allocations x JOIN suppliers s ON x.supplier_key = s.supplier_key
            WHERE {name_quality('s.canonical_supplier_name')} = '{NAME_QUALITY[3]}'""",
        "supplier_ranks": "SELECT *, (SELECT count(*) FROM ranked_suppliers) AS suppliers, (SELECT sum(value) FROM ranked_suppliers) AS total FROM ranked_suppliers",
        "counts_v1": counts(1),
        "counts_v2": counts(2),
        "counts_v3": counts(3),
        "score_v1": scored(1, f"{both_dates} AND contract_end >= contract_start"),
        "score_v2": scored(2, f"{both_dates} AND contract_end >= contract_start"),
        "score_v3": scored(3, both_dates),
        "dataset": f"""SELECT *, {method_group('procurement_method')} AS method_group, {band('award_value', VALUE_BANDS)} AS value_band, {band('duration_days / 365.25', DURATION_BANDS)} AS duration_band,
            CASE WHEN usable_suppliers = 1 THEN 'Single supplier' WHEN usable_suppliers > 1 THEN 'Multiple suppliers' ELSE 'No usable supplier' END AS structure,
            CASE WHEN buyer_id IS NOT NULL AND trim(buyer_id) <> '' THEN 'ID:' || trim(buyer_id) ELSE 'NAME:' || upper({d.squeezed("coalesce(buyer_name, 'Unknown buyer')")}) END AS buyer_key FROM score_v3""",
        "buyers": """SELECT buyer_key, count(*) AS awards, sum(award_value) AS value, max(duration_days) AS longest_days, sum(CASE WHEN structure = 'Single supplier' THEN award_value END) AS single_value,
            sum(CASE WHEN method_group IN ('Direct', 'Limited') THEN award_value END) AS direct_value, count(CASE WHEN award_value IS NULL THEN 1 END) AS missing_values, count(DISTINCT buyer_name) AS names FROM dataset GROUP BY buyer_key""",
        "buyer_facts": f"""SELECT buyer_key, count(*) AS award_count, coalesce(sum(award_value), 0) AS value, count(award_value) AS valued, count(CASE WHEN structure = 'Single supplier' THEN 1 END) AS single,
            count(CASE WHEN structure = 'Multiple suppliers' THEN 1 END) AS multiple, count(CASE WHEN structure = 'No usable supplier' THEN 1 END) AS unsupplied, max(duration_days) AS longest,
            count(DISTINCT buyer_name) AS names, {d.joined('buyer_name', ' | ')} AS variants FROM dataset GROUP BY buyer_key""",
        "buyer_names": "SELECT buyer_key, buyer_name FROM (SELECT buyer_key, buyer_name, row_number() OVER (PARTITION BY buyer_key ORDER BY count(*) DESC, buyer_name) AS rn FROM dataset WHERE buyer_name IS NOT NULL GROUP BY buyer_key, buyer_name) x WHERE rn = 1",
        "overview": f"""SELECT b.*, n.buyer_name, {band('b.awards', ACTIVITY_BANDS)} AS activity_band, {band('b.value', VALUE_BANDS)} AS value_band,
            CASE WHEN b.awards >= 50 AND b.value >= 100000000 THEN 'High activity / High value' WHEN b.awards >= 50 THEN 'High activity / Lower value' WHEN b.value >= 100000000 THEN 'Lower activity / High value' ELSE 'Lower activity / Lower value' END AS segment
            FROM buyers b LEFT JOIN buyer_names n ON b.buyer_key = n.buyer_key""",
    }
    if not d.spark:
        return out
    of_latest = ", ".join(f"max(CASE WHEN place = 1 THEN {x} END) AS {x}" for x in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate"))
    return out | {
        # lines go by the number of their order once, for both windows; ids are made of numbers after them. A line without an order number has no release id
        "one_release": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, line ORDER BY l_shipdate DESC, l_partkey, l_suppkey) AS rn
            FROM (SELECT *, CASE WHEN l_orderkey IS NOT NULL THEN l_linenumber END AS line FROM lineitem DISTRIBUTE BY l_orderkey) r) x WHERE rn = 1""",
        "award_versions": f"""SELECT award_id, release_id, ocid, release_date, award_index, award_value, contract_start, contract_end, award_date, award_status, award_currency, award_title, award_version_number, award_version_count,
            award_version_number = award_version_count AS is_latest FROM ({award}, award_version_number, award_version_count FROM (
              SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate NULLS FIRST, CAST(line AS STRING)) AS award_version_number, count(*) OVER (PARTITION BY l_orderkey) AS award_version_count FROM one_release) v) x""",
        "raw_links": f"""SELECT CAST(l_orderkey AS STRING) AS award_id, CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS release_id, CAST(l_orderkey AS STRING) AS ocid, supplier_index, {identity}
            FROM (SELECT *, l_partkey AS partkey, l_suppkey AS suppkey, row_number() OVER (PARTITION BY l_orderkey, line ORDER BY l_shipdate, l_partkey, l_suppkey) - 1 AS supplier_index
              FROM (SELECT *, CASE WHEN l_orderkey IS NOT NULL THEN l_linenumber END AS line FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) r) x""",
        # a name is normalised once a row
        "keyed_links": f"""SELECT *, CASE WHEN supplier_id_quality = 'usable' THEN 'SUP_ID:' || upper(trim(supplier_id)) WHEN supplier_name_normalized <> '' THEN 'NAME:' || supplier_name_normalized
            ELSE 'UNKNOWN:' || award_id || ':' || CAST(supplier_index AS STRING) END AS supplier_key
            FROM (SELECT *, {norm} AS supplier_name_normalized, CASE WHEN {placeholder} THEN 'unreliable' ELSE 'usable' END AS supplier_id_quality FROM raw_links) n""",
        # the lines of each award's latest release, by one shuffle of lineitem by number; place 1 is the version that the windows of award_versions mark as latest
        "latest_lines": """SELECT * FROM (SELECT *, row_number() OVER own AS place, first_value(l_linenumber) OVER own AS last_line FROM lineitem
            WINDOW own AS (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, CAST(l_linenumber AS STRING) DESC, l_partkey, l_suppkey)) x WHERE l_linenumber <=> last_line""",
        "latest": f"{award} FROM latest_lines WHERE place = 1",
        # what is said of a supplier follows from its id and name: worked out once for each distinct pair. Keys made of an award's id are null here: they have no usable name and count nowhere
        "link_names": f"SELECT suppkey, supplier_id, supplier_name, count(*) AS times FROM (SELECT suppkey, {identity} FROM raw_awards JOIN supplier ON suppkey = s_suppkey) x GROUP BY suppkey, supplier_id, supplier_name",
        "keyed_names": f"""SELECT suppkey, supplier_id, supplier_name, times, name, supplier_id_quality, CASE WHEN supplier_id_quality = 'usable' THEN 'SUP_ID:' || upper(trim(supplier_id)) WHEN name <> '' THEN 'NAME:' || name END AS supplier_key
            FROM (SELECT *, {norm} AS name, CASE WHEN {placeholder} THEN 'unreliable' ELSE 'usable' END AS supplier_id_quality FROM link_names) x""",
        "names_by_id": "SELECT supplier_id AS named_id, count(DISTINCT name) AS supplier_id_name_count FROM keyed_names WHERE supplier_id_quality = 'usable' GROUP BY supplier_id",
        "names_by_key": """SELECT supplier_key AS named_key, name AS canonical_supplier_name, names FROM (SELECT *, row_number() OVER (PARTITION BY supplier_key ORDER BY times DESC, name) AS rn, count(*) OVER (PARTITION BY supplier_key) AS names
            FROM (SELECT supplier_key, name, sum(times) AS times FROM keyed_names WHERE supplier_key IS NOT NULL AND name IS NOT NULL GROUP BY supplier_key, name) y) x WHERE rn = 1""",
        "link_facts": """SELECT k.suppkey AS fact_suppkey, k.supplier_name AS fact_name, k.supplier_key, k.supplier_id_quality, c.canonical_supplier_name,
            CASE WHEN k.supplier_id_quality = 'unreliable' THEN 'unreliable_id_name_based' WHEN i.supplier_id_name_count > 1 THEN 'id_multiple_names_review' ELSE 'confirmed_id' END AS supplier_identity_flag,
            CASE WHEN c.names > 1 THEN 'review_name_variation' ELSE 'no_name_conflict' END AS identity_review_flag
            FROM keyed_names k LEFT JOIN names_by_key c ON k.supplier_key = c.named_key LEFT JOIN names_by_id i ON k.supplier_id_quality = 'usable' AND k.supplier_id = i.named_id""",
        "latest_links": f"""SELECT x.*, f.* FROM (SELECT *, {identity} FROM (SELECT *, l_partkey AS partkey, l_suppkey AS suppkey FROM latest_lines) a LEFT JOIN supplier ON suppkey = s_suppkey) x
            LEFT JOIN link_facts f ON x.s_suppkey = f.fact_suppkey AND x.supplier_name <=> f.fact_name AND l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL""",
        **{f"counted_v{version}": f"""{award}, l_orderkey AS order_number, usable_suppliers, review, unreliable, reference_texts, supplier_names, usable_names, reference_names FROM (
            SELECT l_orderkey, {of_latest}, {counted(version)} FROM latest_links GROUP BY l_orderkey) y""" for version in (1, 2, 3)},
    }


def with_steps(sql: str, d: Dialect) -> str:
    """``sql`` under a WITH of all the steps that it names, in order."""
    known = steps(d) | ({} if d.spark else ranks.twin_steps())
    wanted: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"[a-z_0-9]+", todo.pop())) & known.keys()
        todo += [known[w] for w in words - wanted]
        wanted |= words
    parts, placed = [], set()

    def place(name: str) -> None:
        if name not in placed:
            placed.add(name)
            for w in known:
                if re.search(rf"\b{w}\b", known[name]) and w != name:
                    place(w)
            parts.append(f"{name} AS ({known[name]})")

    for name in known:
        if name in wanted:
            place(name)
    text = f"WITH {', '.join(parts)} {sql}" if parts else sql
    return text if d.spark else re.sub(r"\bSTRING\b", "VARCHAR", text)
