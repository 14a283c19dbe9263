"""The quality gate of the analytical tables: every table is read once for all of its checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "category string, test string, status string, value long, expected string, notes string"
#: Categories of checks.
KEYS, GRAIN, LIFECYCLE, REFERENCES, IDENTITY, COMPLETENESS, NUMBERS, DATES, STRUCTURE = (
    "Primary keys", "Relationship grain", "Award lifecycle", "Referential integrity", "Supplier identity", "Completeness", "Numeric validity", "Date validity", "Structure")


class Checks:
    """The checks of one table: sums over its rows, and over its keys."""

    def __init__(self, name: str, df: DataFrame, keys: Sequence[str], within: str | None = None):
        """``keys`` are what should be unique; ``within`` is the one of them by which sums ``per_group`` are made."""
        self.name, self.df, self.keys, self.within = name, df, list(keys), within
        self.rows: dict[str, Column] = {"rows": F.lit(1)}
        self.groups: dict[str, tuple[Column, Column]] = {}
        self.out: list[tuple] = []

    def add(self, category: str, test: str, measure: str, bad: str = "FAIL", expected: str = "0", notes: Column | None = None) -> None:
        """One check: PASS where ``measure`` is 0, else ``bad``; INFO stays INFO."""
        value = F.col(measure)
        self.out.append((category, test, F.lit("INFO") if bad == "INFO" else F.when(value == 0, "PASS").otherwise(bad), value, expected, notes))

    def count(self, measure: str, where: Column) -> None:
        self.rows[measure] = F.coalesce(where.cast("long"), F.lit(0))

    def unique(self, category: str, test: str) -> None:
        self.add(category, test, "_surplus")

    def present(self, category: str, test: str, column: str) -> None:
        self.count(f"_null_{column}", F.col(column).isNull())
        self.add(category, test, f"_null_{column}")

    def missing(self, column: str) -> None:
        self.count(f"_null_{column}", F.col(column).isNull())
        share = F.try_divide(F.col(f"_null_{column}") * 100, F.col("rows")).cast("decimal(30,8)")
        self.add(COMPLETENESS, f"{self.name}.{column}.missing", f"_null_{column}", "INFO", "source-dependent",
                 F.concat(F.coalesce(F.round(share, 2).cast("decimal(10,2)"), F.lit(0).cast("decimal(10,2)")).cast("string"), F.lit("% missing")))

    def results(self) -> DataFrame:
        """Rows are summed by key, keys by group where there are checks of groups, and all of it once more."""
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(m) for m, c in self.rows.items()]
        by_key = self.df.groupBy(*self.keys).agg(*sums, *[F.coalesce(F.sum(c), F.lit(0)).alias(m) for m, (c, _) in self.groups.items()]).withColumn("_surplus", F.col("rows") - 1)
        again = [F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in (*self.rows, "_surplus")]
        if self.groups:
            by_key = by_key.groupBy(self.within).agg(*again, *[F.sum(m).alias(m) for m in self.groups])
        one = by_key.agg(*again, *[F.count_if(bad(F.col(m)) if callable(bad) else bad).alias(m) for m, (_, bad) in self.groups.items()])
        self.add(STRUCTURE, f"{self.name}.row_count", "rows", "INFO", "documented")
        one = one.withColumn("_columns", F.lit(len(self.df.columns)))
        self.add(STRUCTURE, f"{self.name}.column_count", "_columns", "INFO", "documented")
        listed = [F.struct(F.lit(c).alias("category"), F.lit(t).alias("test"), s.alias("status"), v.cast("long").alias("value"), F.lit(e).alias("expected"),
                           (F.lit("") if n is None else n).alias("notes")) for c, t, s, v, e, n in self.out]
        return one.select(F.inline(F.array(*listed)))


def edge(test: str, child: DataFrame, parent: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Rows of ``child`` without a row in ``parent``; null keys have no parent. Both sides are summed by key in one aggregate, so that a hot key is one row a task and neither side is
    joined, which Spark would push under the counting."""
    sides = [child.select(*on, F.lit(1).alias("_n"), F.lit(False).alias("_known")), parent.select(*[F.col(p).alias(c) for c, p in on.items()], F.lit(0).alias("_n"), F.lit(True).alias("_known"))]
    keys = sides[0].unionAll(sides[1]).groupBy(*on).agg(F.sum("_n").alias("_n"), F.max("_known").alias("_known"))
    without = reduce(Column.__or__, [F.col(c).isNull() for c in on], ~F.col("_known"))
    return keys.agg(F.coalesce(F.sum(F.when(without, F.col("_n"))), F.lit(0)).alias("value")).select(
        F.lit(REFERENCES).alias("category"), F.lit(test).alias("test"), F.when(F.col("value") == 0, "PASS").otherwise("FAIL").alias("status"), "value", F.lit("0").alias("expected"), F.lit("").alias("notes"))


def quality_gate(procurements: DataFrame, releases: DataFrame, awards: DataFrame, relationships: DataFrame, suppliers: DataFrame) -> DataFrame:
    """category, test, status, value, expected, notes of all checks, and a last row with the verdict: FAIL with any failure, else REVIEW with any review, else PASS.

    PASS and FAIL are about structure, REVIEW about values that may be right, INFO about facts. Each table is read once, and its keys once more for each reference.
    """
    p = Checks("procurements", procurements, ["ocid"])
    p.present(KEYS, "procurements.ocid.null", "ocid")
    p.unique(KEYS, "procurements.ocid.duplicate")
    p.count("_negative", F.col("tender_value") < 0)
    p.add(NUMBERS, "negative_tender_values", "_negative", "REVIEW")
    r = Checks("releases", releases, ["release_id"])
    r.present(KEYS, "releases.release_id.null", "release_id")
    r.unique(KEYS, "releases.release_id.duplicate")
    a = Checks("awards", awards, ["award_id", "release_id"], within="award_id")
    a.present(KEYS, "awards.award_id.null", "award_id")
    a.present(KEYS, "awards.release_id.null", "release_id")
    a.unique(KEYS, "awards.award_id_release_id.duplicate")
    for column in ("award_version_number", "award_version_count", "is_latest_award_version"):
        a.present(LIFECYCLE, f"{column}.null", column)
    a.count("_bad_number", F.col("award_version_number") <= 0)
    a.add(LIFECYCLE, "award_version_number.invalid", "_bad_number")
    a.groups["_latest"] = (F.col("is_latest_award_version").cast("long"), lambda n: F.coalesce(n, F.lit(0)) != 1)
    a.add(LIFECYCLE, "exactly_one_latest_version_per_award", "_latest")
    a.count("_negative", F.col("award_value") < 0)
    a.add(NUMBERS, "negative_award_values", "_negative", "REVIEW")
    a.count("_reversed", F.col("contract_end") < F.col("contract_start"))
    a.add(DATES, "contract_end_before_start", "_reversed", "REVIEW")
    links = Checks("relationships", relationships, ["award_id", "release_id", "supplier_index"])
    links.unique(GRAIN, "award_release_supplier_index_duplicate")
    links.count("_names", F.col("supplier_identity_flag") == "id_multiple_names_review")
    links.add(IDENTITY, "relationships_flagged_multiple_names", "_names", "INFO", "review")
    links.count("_unreliable", F.col("supplier_identity_flag") == "unreliable_id_name_based")
    links.add(IDENTITY, "relationships_unreliable_ids", "_unreliable", "INFO", "review")
    s = Checks("suppliers", suppliers, ["supplier_key"])
    s.present(KEYS, "suppliers.supplier_key.null", "supplier_key")
    s.unique(KEYS, "suppliers.supplier_key.duplicate")
    for table, columns in ((p, ("buyer_name", "buyer_id", "procurement_method", "tender_value")), (r, ("ocid", "release_date")), (a, ("award_value", "contract_start", "contract_end")),
                           (links, ("supplier_id", "supplier_name")), (s, ("supplier_id", "canonical_supplier_name"))):
        for column in columns:
            if column in table.df.columns:
                table.missing(column)
    edges = [
        edge("release_to_procurement", releases, procurements, {"ocid": "ocid"}), edge("award_to_procurement", awards, procurements, {"ocid": "ocid"}),
        edge("relationship_to_award", relationships, awards, {"award_id": "award_id", "release_id": "release_id"}), edge("relationship_to_supplier", relationships, suppliers, {"supplier_key": "supplier_key"}),
    ]
    every = reduce(DataFrame.unionAll, [t.results() for t in (p, r, a, links, s)] + edges)
    status = F.when(F.count_if(F.col("status") == "FAIL") > 0, "FAIL").when(F.count_if(F.col("status") == "REVIEW") > 0, "REVIEW").otherwise("PASS")
    # a row for each check and one more for the verdict, from the same pass
    verdict = F.struct(F.lit("Overall").alias("category"), F.lit("quality_gate").alias("test"), F.col("_status").alias("status"), F.col("_failures").alias("value"), F.lit("0").alias("expected"),
                       F.concat(F.col("_reviews").cast("string"), F.lit(" to review")).alias("notes"))
    whole = every.agg(F.collect_list(F.struct(*every.columns)).alias("_checks"), status.alias("_status"), F.count_if(F.col("status") == "FAIL").alias("_failures"), F.count_if(F.col("status") == "REVIEW").alias("_reviews"))
    return whole.select(F.inline(F.concat("_checks", F.array(verdict))))  # some fifty rows


def expect_counts(tables: Mapping[str, DataFrame], expected: Mapping[str, DataFrame]) -> DataFrame:
    """name, actual, expected, difference, status: rows of each table against those of another that should have as many."""
    sides = [df.select(F.lit(name).alias("name"), F.lit(side).alias("side")) for side, dfs in (("actual", tables), ("expected", expected)) for name, df in dfs.items()]
    counts = reduce(DataFrame.unionAll, sides).groupBy("name").agg(F.count_if(F.col("side") == "actual").alias("actual"), F.count_if(F.col("side") == "expected").alias("expected"))
    gap = F.col("actual") - F.col("expected")
    return counts.select("name", "actual", "expected", gap.alias("difference"), F.when(gap == 0, "PASS").otherwise("FAIL").alias("status"))
