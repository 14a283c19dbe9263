"""Column expressions for notices: cleaning, keys, bands and flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tendrel.plans.tables import CONTAMINATED, CUTS, LONG_YEARS, NAME_QUALITY, PLACEHOLDER_IDS, REDACTED, REF6, YEAR_DAYS

# Company suffixes and their short forms.
SUFFIXES = {"LIMITED": "LTD", "INCORPORATED": "INC", "CORPORATION": "CORP"}


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_name(c: Column) -> Column:
    return F.upper(collapse_ws(c))


def norm_suffix(c: Column) -> Column:
    out = norm_name(F.regexp_replace(c, "[.,]", " "))
    for long, short in SUFFIXES.items():
        out = F.regexp_replace(out, rf"\b{long}\b", short)
    return out


def is_placeholder_id(c: Column) -> Column:
    return c.isNull() | F.upper(F.trim(c)).isin(*PLACEHOLDER_IDS)


def is_suspicious_id(c: Column) -> Column:
    return F.coalesce(c.endswith("-0"), F.lit(False))


def supplier_key(supplier_id: Column, name: Column, award_id: Column, index: Column) -> Column:
    return (F.when(~is_placeholder_id(supplier_id), F.concat(F.lit("SUP_ID:"), F.upper(F.trim(supplier_id))))
            .when(F.coalesce(norm_name(name), F.lit("")) != "", F.concat(F.lit("NAME:"), norm_name(name)))
            .otherwise(F.concat(F.lit("UNKNOWN:"), award_id, F.lit(":"), index.cast("string"))))


def buyer_key(buyer_id: Column, name: Column) -> Column:
    return F.when(blank_to_null(buyer_id).isNotNull(), F.concat(F.lit("ID:"), F.trim(buyer_id))).otherwise(F.concat(F.lit("NAME:"), norm_name(F.coalesce(name, F.lit("Unknown buyer")))))


def row_signature(columns: Sequence[Column]) -> Column:
    """SHA-256 of all columns; a null differs from every text, and parts can't run into each other."""
    return F.sha2(F.to_json(F.struct(*[F.coalesce(c.cast("string"), F.lit("<NULL>")).alias(f"c{k}") for k, c in enumerate(columns)])), 256)


def hash_key(columns: Sequence[Column]) -> Column:
    """SHA-256 of all columns in order: nulls are told apart from every text, and parts can't run into each other."""
    return F.sha2(F.to_json(F.struct(*[c.cast("string").alias(f"c{k}") for k, c in enumerate(columns)]), {"ignoreNullFields": "false"}), 256)


def to_number(c: Column, kind: str = "decimal(20,2)") -> Column:
    return F.trim(c).try_cast(kind)


def to_utc(c: Column) -> Column:
    return F.try_to_timestamp(F.trim(c))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def duration_days(start: Column, end: Column) -> Column:
    return (F.unix_timestamp(end) - F.unix_timestamp(start)) / F.lit(86400.0)


def band(c: Column, bands: Sequence[tuple], unknown: str = "Unknown", right: bool = False) -> Column:
    out = F.when(c.isNull(), unknown)
    for _, label, _, high in bands:
        if high is not None:
            out = out.when((c <= high) if right else (c < high), label)
    return out.otherwise(bands[-1][1])


def reference_text(c: Column, patterns: Sequence[str] = REF6) -> Column:
    return F.coalesce(F.lower(c).rlike("|".join(p.replace(" ", r"\s+") for p in patterns)), F.lit(False))


def join_reasons(reasons: Mapping[str, str]) -> Column:
    return F.concat_ws("; ", *[F.when(F.col(c), text) for c, text in reasons.items()])


def bool_flag(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("true", "1").cast("int")


def label_number(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("int")


def relationship_key(award_id: Column, release_id: Column, index: Column) -> Column:
    return F.concat(award_id, F.lit("|"), release_id, F.lit("|"), index.cast("string"))


def year_month(c: Column) -> dict[str, Column]:
    return {"year": F.year(c), "month": F.month(c), "month_name": F.date_format(c, "MMMM")}


def whole_days(start: Column, end: Column) -> Column:
    """Days between two timestamps, rounded down even below zero."""
    return F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / 86400)


def duration_years(start: Column, end: Column) -> Column:
    return duration_days(start, end) / YEAR_DAYS


def method_group(c: Column) -> Column:
    """The first of the groups named in the text; Unknown if there is none, else Other."""
    out = F.when(blank_to_null(c).isNull(), "Unknown")
    for word in ("direct", "limited", "selective", "open"):
        out = out.when(F.lower(c).contains(word), word.capitalize())
    return out.otherwise("Other")


def name_quality(c: Column) -> Column:
    has = lambda words: F.lower(c).rlike("|".join(words))
    return F.when(blank_to_null(c).isNull(), NAME_QUALITY[0]).when(has(REDACTED), NAME_QUALITY[1]).when(has(CONTAMINATED), NAME_QUALITY[2]).otherwise(NAME_QUALITY[3])


def usable_supplier(key: Column, name: Column, patterns: Sequence[str] = REF6) -> Column:
    return key.isNotNull() & blank_to_null(name).isNotNull() & ~reference_text(name, patterns)


def supplier_structure(usable: Column) -> Column:
    return F.when(usable == 1, "Single supplier").when(usable > 1, "Multiple suppliers").otherwise("No usable supplier")


def equal_share(value: Column, n: Column) -> Column:
    return safe_ratio(value, F.nullif(n, F.lit(0)))


def score_points(value: Column, days: Column, method: Column, usable: Column, version: int = 3, quality: Column | None = None) -> dict[str, Column]:
    """Points of each part of the review score. Version 3 compares raw days and looks for method words; 1 and 2 round years and want the word alone; 1 also has a point for doubtful data."""
    length = days if version == 3 else F.round((days / YEAR_DAYS).cast("decimal(20,8)"), 2)
    long, longest = (years * YEAR_DAYS if version == 3 else years for years in LONG_YEARS)
    is_method = (lambda word: F.lower(method).contains(word)) if version == 3 else (lambda word: F.lower(method) == word)
    out = {"value_points": F.when(value >= 1_000_000_000, 3).when(value >= 100_000_000, 2).otherwise(0), "duration_points": F.when(length >= longest, 2).when(length >= long, 1).otherwise(0),
           "method_points": F.when(is_method("direct"), 2).when(is_method("limited"), 1).otherwise(0), "single_supplier_points": F.when(usable == 1, 1).otherwise(0)}
    return out | ({"quality_points": F.when(quality, 1).otherwise(0)} if version == 1 and quality is not None else {})


def score_category(score: Column, version: int = 3) -> Column:
    labels = ("Priority review", "High review", "Moderate review")
    out = F.when(F.lit(False), "")
    for cut, label in zip(CUTS[version], labels):
        out = out.when(score >= cut, label)
    return out.otherwise("Lower review priority")


def review_category(value: Column, years: Column, method: Column) -> Column:
    long = years >= LONG_YEARS[0]
    return (F.when((value >= 1_000_000_000) & long & F.lower(F.trim(method)).isin("direct", "limited"), "Priority").when((value >= 500_000_000) & long, "High")
            .when((value >= 100_000_000) & long, "Moderate").otherwise("Contextual"))


def indicator_count(flags: Sequence[Column]) -> Column:
    return sum((F.coalesce(f, F.lit(False)).cast("int") for f in flags), F.lit(0))


def indicator_category(count: Column) -> Column:
    return F.when(count >= 3, "Higher review attention").when(count == 2, "Moderate review attention").when(count == 1, "Lower review attention").otherwise("No additional indicator")


def segment(awards: Column, value: Column, min_awards: float = 50, min_value: float = 100_000_000) -> Column:
    return F.concat_ws(" / ", F.when(awards >= min_awards, "High activity").otherwise("Lower activity"), F.when(value >= min_value, "High value").otherwise("Lower value"))


def concat_distinct(c: Column, sep: str = ", ", where: Column | None = None) -> Column:
    """Aggregate: the distinct values in order as one text, null if there are none."""
    return F.nullif(F.array_join(F.array_sort(F.collect_set(c if where is None else F.when(where, c))), sep), F.lit(""))
