"""Resolution of repeated observations: what is equal but for its lineage collapses, what differs stays as a version.

All steps are aggregates by content or key, so that copies collapse before they are shuffled, however many there are of one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tendrel.functions.columns import hash_key, is_placeholder_id, norm_name, relationship_key, supplier_key
from tendrel.operators.ranking import settle
from tendrel.operators.relational import require_columns, version_columns

LINEAGE = ("source_file",)
PROCUREMENT_FIELDS = ("ocid", "tender_title", "tender_status", "buyer_name", "buyer_id", "procurement_method", "procurement_category", "cpv_code", "tender_value", "tender_currency")


def drop_copies(df: DataFrame, keys: Sequence[str], lineage: Sequence[str] = LINEAGE) -> DataFrame:
    """One row of those that are equal in all columns but ``lineage``: the one of the least lineage, nulls last. Rows of one key that differ all stay. Equal nulls
    are equal, in keys too."""
    order = [c for c in lineage if c in df.columns]
    content = [c for c in df.columns if c not in order]
    require_columns(df, keys)
    if not order:
        return df.distinct()
    # the columns themselves are the key: a hash of them beside them would be half of what is shuffled
    place = F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))])
    return df.groupBy(*content).agg(F.min_by(F.struct(*order), place).alias("_row")).select(*[F.col(f"_row.{c}").alias(c) if c in order else F.col(c) for c in df.columns])


def resolve_releases(df: DataFrame, lineage: str = "source_file") -> DataFrame:
    """One row for each release_id: that of the least source file, nulls last, and of the least content hash among equal ones. Rows without an id are one release."""
    content = F.unhex(hash_key([F.col(c) for c in df.columns if c != lineage]))  # in the order of its text, in half of the bytes
    place = F.struct(F.col(lineage).isNull(), F.col(lineage), content)
    return df.groupBy("release_id").agg(F.min_by(F.struct(*df.columns), place).alias("_row")).select("_row.*")


def resolve_award_versions(df: DataFrame) -> DataFrame:
    """Award versions at the grain (award_id, release_id, content): copies go, all that differ stay, and each award's rows are numbered by release date (nulls
    first), release and then their other columns in order; the last is the latest."""
    once = drop_copies(df, ("award_id", "release_id"))
    rest = [c for c in df.columns if c not in ("award_id", "release_id", "release_date", *LINEAGE)]
    order = [F.col("release_date").asc_nulls_first(), F.col("release_id").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in rest]]
    named = {"version_number": "award_version_number", "version_count": "award_version_count", "is_latest": "is_latest_award_version"}
    return version_columns(once, "award_id", order).withColumnsRenamed(named)


def _id_and_name() -> dict:
    return {"supplier_name_normalized": norm_name(F.col("supplier_name")), "supplier_id_quality": F.when(is_placeholder_id(F.col("supplier_id")), "unreliable").otherwise("usable")}


def resolve_relationships(df: DataFrame) -> DataFrame:
    """Supplier relationships without copies, with the observation key, the normalised name, the quality of the supplier's id, the supplier key, the number of names
    that a usable id goes by, and the identity flag."""
    once = drop_copies(df, ("award_id", "release_id", "supplier_index"))
    named = once.withColumns({
        "relationship_observation_key": relationship_key(F.col("award_id"), F.col("release_id"), F.col("supplier_index")), **_id_and_name(),
        "supplier_key": supplier_key(F.col("supplier_id"), F.col("supplier_name"), F.col("award_id"), F.col("supplier_index")),
    })
    # copies add no name, so names are counted before rows are collapsed. Written, they have a known size: relationships are joined in place while Spark finds them small
    pairs = df.select("supplier_id", "supplier_name").distinct()
    names = settle(pairs.withColumns(_id_and_name()).where("supplier_id_quality = 'usable'").groupBy("supplier_id").agg(F.count_distinct("supplier_name_normalized").alias("supplier_id_name_count")))
    flag = F.when(F.col("supplier_id_quality") == "unreliable", "unreliable_id_name_based").when(F.col("supplier_id_name_count") > 1, "id_multiple_names_review")
    usable = F.when(F.col("supplier_id_quality") == "usable", F.col("supplier_id"))
    joined = named.withColumn("_usable_id", usable).join(names.withColumnRenamed("supplier_id", "_usable_id"), "_usable_id", "left").drop("_usable_id")
    return joined.withColumn("supplier_identity_flag", flag.otherwise("confirmed_id"))


def supplier_master(relationships: DataFrame) -> DataFrame:
    """One row a supplier key: its usable id, its most frequent name (the least of equally frequent ones), how many names and relationships it has, and its flags."""
    by_name = relationships.groupBy("supplier_key", "supplier_name_normalized").agg(
        F.count("*").alias("times"), F.min(F.when(F.col("supplier_id_quality") == "usable", F.col("supplier_id"))).alias("supplier_id"))
    named = F.col("supplier_name_normalized").isNotNull()
    out = by_name.groupBy("supplier_key").agg(
        F.min("supplier_id").alias("supplier_id"), F.count_if(named).alias("reported_name_count"), F.sum("times").alias("relationship_count"),
        F.min_by("supplier_name_normalized", F.when(named, F.struct(-F.col("times"), F.col("supplier_name_normalized")))).alias("canonical_supplier_name"))
    return out.withColumns({
        "supplier_id_quality": F.when(F.col("supplier_id").isNull(), "unreliable_or_missing").otherwise("usable"),
        "identity_review_flag": F.when(F.col("reported_name_count") > 1, "review_name_variation").otherwise("no_name_conflict"),
    })


def build_procurements(releases: DataFrame, fields: Sequence[str] = PROCUREMENT_FIELDS) -> DataFrame:
    """The latest release of each ocid, by date (a release without one counts as earliest) and then by id; those of ``fields`` that there are."""
    there = [c for c in fields if c in releases.columns]
    latest = F.struct("release_date", "release_id")
    return releases.groupBy("ocid").agg(F.max_by(F.struct(*there), latest).alias("_row")).select("_row.*")


def resolution_log(counts: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """issue_type, rule, action, rows_removed: what resolving took away, from the tables before and after (``releases``, ``awards``, ``relationships``), each
    counted once. Issues that only flag rows remove none."""
    issues = (
        ("releases", "release_duplicates", "one row a release_id, of the least source file", "deduplicated"),
        ("awards", "award_versions", "rows equal in all but source_file at award_id and release_id become one", "preserved"),
        ("relationships", "supplier_relationship_duplicates", "rows equal in all but source_file at award_id, release_id and supplier_index become one", "deduplicated_exact_only"),
        (None, "unreliable_supplier_ids", "placeholder ids are no keys; the normalised name is", "name_based_identity"),
        (None, "supplier_name_variations", "all names of an id stay, the id is flagged", "preserved_and_flagged"),
        (None, "award_lifecycle_updates", "rows of an award that differ are numbered as versions", "preserved"),
    )
    sides = [df.select(F.lit(name).alias("name"), F.lit(sign).alias("sign")) for name, pair in counts.items() for sign, df in zip((1, -1), pair)]
    every = sides[0]
    for side in sides[1:]:
        every = every.unionAll(side)
    removed = every.groupBy("name").agg(F.sum("sign").alias("removed"))
    listed = removed.sparkSession.createDataFrame([(k, *x) for k, x in enumerate(issues)], "number int, name string, issue_type string, rule string, action string")
    return listed.join(removed, "name", "left").select("issue_type", "rule", "action", F.coalesce("removed", F.lit(0)).cast("long").alias("rows_removed"))
