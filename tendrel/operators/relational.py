"""Relational steps that go beyond one DataFrame call."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendrel.functions.columns import row_signature
from tendrel.operators.ranking import ranked


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def find_column(df: DataFrame, candidates: Sequence[str]) -> str:
    """The first of the candidates that ``df`` has."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of the columns {', '.join(candidates)}")


def project(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """New name to source column; all sources must be there."""
    require_columns(df, list(mapping.values()))
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in mapping.items()])


def standardise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def presence_flags(df: DataFrame, columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """Flag name to columns that all must be there."""
    return df.withColumns({name: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cs]) for name, cs in columns.items()})


def missing_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({f"missing_{c}": F.col(c).isNull().cast("int") for c in columns})


def in_year(df: DataFrame, column: str, year: int) -> DataFrame:
    """Rows of a calendar year, as a range that scans can use to skip files."""
    return df.where((F.col(column) >= F.lit(f"{year}-01-01").cast("timestamp")) & (F.col(column) < F.lit(f"{year + 1}-01-01").cast("timestamp")))


def outside_year(df: DataFrame, column: str, year: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts of rows outside a year, by year and ``by``; rows without a date count under a null year."""
    return df.where(F.coalesce(F.year(column) != year, F.lit(True))).groupBy(F.year(column).alias("year"), *by).agg(F.count("*").alias("rows"))


def keep_children(child: DataFrame, parent: DataFrame, on: Sequence[str]) -> DataFrame:
    return child.join(parent.select(*on), list(on), "left_semi")


def search(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose column holds the text, taken literally and whatever its case."""
    return df.where(F.lower(column).contains(text.lower()))


def threshold_counts(df: DataFrame, value: str, thresholds: Sequence[float]) -> DataFrame:
    """threshold, rows, value: how many rows reach each threshold, by one pass with conditional sums."""
    one = df.agg(*[f for k, t in enumerate(thresholds) for f in (F.count_if(F.col(value) >= t).alias(f"n{k}"), F.coalesce(F.sum(F.when(F.col(value) >= t, F.col(value))), F.lit(0)).cast("double").alias(f"v{k}"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n{k}").alias("rows"), F.col(f"v{k}").alias("value")) for k, t in enumerate(thresholds)])))


def assert_unique_mapping(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Raises if a key has several values; else ``df`` as it is."""
    if not df.groupBy(*keys).agg(F.countDistinct(value).alias("_values")).where("_values > 1").isEmpty():
        raise ValueError(f"{', '.join(keys)} has several values of {value}")
    return df


def share_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of each group and their percentage of all rows; the whole is one row."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("rows"))
    return counts.join(df.agg(F.count("*").alias("_all")), how="cross").select(*keys, "rows", (F.col("rows") * 100 / F.col("_all")).alias("share"))


def most_frequent(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The most frequent value of each key, the least one of equally frequent ones; nulls don't count."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("times"))
    return counts.groupBy(*keys).agg(F.min_by(column, F.struct(-F.col("times"), F.col(column))).alias(column), F.max("times").alias("times"))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).count().fillna(0)


def group_size_histogram(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def kpi_table(df: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    """metric, value: one aggregate each, in one pass."""
    one = df.agg(*[c.cast("double").alias(f"m{k}") for k, c in enumerate(metrics.values())])
    return one.select(F.inline(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"m{k}").alias("value")) for k, name in enumerate(metrics)])))


def with_distinct_count(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``df`` with the number of distinct values of each key, by aggregate and join; rows with a null key get null."""
    return df.join(df.groupBy(*keys).agg(F.countDistinct(column).alias(f"{column}_count")), list(keys), "left")


def share_within(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.withColumn("share", F.try_divide(F.col(value).cast("double"), F.sum(F.col(value).cast("double")).over(Window.partitionBy(*keys))) * 100)


def tag_sequences(df: DataFrame, key: str, order: Sequence[str], tag: str, sep: str = " > ") -> DataFrame:
    """How often each sequence of a key's tags occurs."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(tag).alias("_tag"))))
    return df.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["_tag"]), sep).alias("sequence")).groupBy("sequence").agg(F.count("*").alias("keys"))


def count_exact_duplicates(df: DataFrame) -> DataFrame:
    """rows, distinct_rows, duplicates, as one row."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows")).withColumn("duplicates", F.col("rows") - F.col("distinct_rows"))


def profile_fields(df: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """label, field, type, present, missing, missing_percent, distinct_values of each field in one aggregate; absent columns get a row of type NOT FOUND."""
    there = {label: c for label, c in fields.items() if c in df.columns}
    types = dict(df.dtypes)
    one = df.agg(F.count("*").alias("_all"), *[f for k, c in enumerate(there.values()) for f in (F.count(F.col(f"`{c}`")).alias(f"p{k}"), F.countDistinct(F.col(f"`{c}`")).alias(f"d{k}"))])
    none = F.lit(None).cast("long")
    row = lambda label, c, kind, present, distinct: F.struct(F.lit(label).alias("label"), F.lit(c).alias("field"), F.lit(kind).alias("type"), present.alias("present"), (F.col("_all") - present).alias("missing"),
        F.try_divide((F.col("_all") - present) * F.lit(100.0), F.col("_all")).alias("missing_percent"), distinct.alias("distinct_values"))
    rows = [row(label, c, types[c], F.col(f"p{k}"), F.col(f"d{k}")) for k, (label, c) in enumerate(there.items())] + [row(label, c, "NOT FOUND", none, none) for label, c in fields.items() if label not in there]
    return one.select(F.inline(F.array(*rows)))


def top_missing(df: DataFrame, n: int = 15) -> DataFrame:
    """field, missing, missing_percent of the ``n`` columns with most nulls, by one aggregate; columns without any are left out, ties go by name."""
    one = df.agg(F.count("*").alias("_all"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{k}") for k, c in enumerate(df.columns)])
    share = lambda m: F.round(F.try_divide(m * 100, F.col("_all")).cast("decimal(30,8)"), 2).cast("double")
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"m{k}").alias("missing"), share(F.col(f"m{k}")).alias("missing_percent")) for k, c in enumerate(df.columns)])))
    return rows.where("missing > 0").orderBy(F.desc("missing"), "field").limit(n)


def check_pk(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """null_rows, repeated_keys, surplus_rows of a key, as one row."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    groups = df.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_null", missing)
    repeated = ~F.col("_null") & (F.col("_n") > 1)
    return groups.agg(F.coalesce(F.sum(F.when(F.col("_null"), F.col("_n"))), F.lit(0)).alias("null_rows"), F.count_if(repeated).alias("repeated_keys"), F.coalesce(F.sum(F.when(repeated, F.col("_n") - 1)), F.lit(0)).alias("surplus_rows"))


def check_versions(df: DataFrame, key: str) -> DataFrame:
    """Of version_number and is_latest: rows without a proper number, and keys that don't have just one latest row."""
    per_key = df.groupBy(key).agg(F.count_if("is_latest").alias("_latest"), F.count_if(F.coalesce(F.col("version_number") <= 0, F.lit(True))).alias("_bad"))
    return per_key.agg(F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad_numbers"), F.count_if(F.col("_latest") != 1).alias("keys_without_one_latest"))


def validated_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", validate: str = "many_to_one") -> DataFrame:
    """A join whose right (and for one_to_one also left) keys must be unique; raises otherwise."""
    for side, df in (("right", right), *((("left", left),) if validate == "one_to_one" else ())):
        if not df.groupBy(*on).count().where("count > 1").isEmpty():
            raise ValueError(f"{side} keys {', '.join(on)} are not unique")
    return left.join(right, list(on), how)


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``, which should be a total one."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def version_columns(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    own = Window.partitionBy(key)
    out = df.withColumns({"version_number": F.row_number().over(own.orderBy(*order)), "version_count": F.count("*").over(own)})
    return out.withColumn("is_latest", F.col("version_number") == F.col("version_count"))


def orphans(child: DataFrame, parent: DataFrame, on: Sequence[str]) -> DataFrame:
    return child.join(parent.select(*on).distinct(), list(on), "left_anti")


def dense_group(df: DataFrame, dims: dict[str, Sequence[str]], aggs: Sequence[Column], fill: float = 0) -> DataFrame:
    """Aggregates for every combination of the given labels, ``fill`` where there are no rows. The labels are a few literals each."""
    grid = df.sparkSession.range(1).select(*[F.lit(None).alias("_none")])
    for name, labels in dims.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(x) for x in labels])))
    return grid.drop("_none").join(df.groupBy(*dims).agg(*aggs), list(dims), "left").fillna(fill)


def top_share(df: DataFrame, value: str, percent: float, rounding: str = "floor") -> DataFrame:
    """How many rows the top ``percent`` are, and their sum and share of the whole, without sorting all rows in one task.

    Values are counted first; the largest that reach the cut are found from their running counts.
    """
    placed = ranked(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n")), [F.desc(value)], "_n")
    total = placed.agg(F.sum("_n").alias("n"), F.sum(F.col(value) * F.col("_n")).alias("s")).first()
    if not total["n"]:
        return df.sparkSession.createDataFrame([(0, 0.0, None)], "rows long, value double, share double")
    want = int(total["n"] * percent / 100) if rounding == "floor" else max(1, -int(-total["n"] * percent // 100))
    take = F.greatest(F.least(F.col("_n"), F.lit(want) - (F.col("running") - F.col("_n"))), F.lit(0))
    return placed.agg(F.sum(take).alias("rows"), F.sum(F.col(value) * take).cast("double").alias("value")).withColumn("share", F.col("value") * 100 / F.lit(float(total["s"])))


def verify_grain(df: DataFrame, keys: Sequence[str], ignore: Sequence[str] = ("source_file",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, conflicting rows, deduplicated): keys that repeat with equal content lose the copies, those with other content stay whole, null keys are set aside."""
    content = [c for c in df.columns if c not in ignore]
    signed = df.withColumn("_sig", row_signature([F.col(c) for c in content]))
    keyed = signed.dropna(subset=list(keys))
    groups = keyed.groupBy(*keys).agg(F.count("*").alias("_rows"), F.countDistinct("_sig").alias("_contents"))
    summary = groups.agg(F.count("*").alias("keys"), F.count_if(F.col("_rows") > 1).alias("repeated"), F.count_if((F.col("_rows") > 1) & (F.col("_contents") == 1)).alias("identical"), F.count_if(F.col("_contents") > 1).alias("conflicting"))
    both = keyed.join(groups, list(keys))
    conflicts = both.where("_contents > 1").select(*df.columns)
    once = keep_one(both.where("_contents = 1"), keys, [F.col(c).asc_nulls_first() for c in df.columns]).select(*df.columns)
    return summary, conflicts, once.unionByName(conflicts)


def conflict_fields(df: DataFrame, keys: Sequence[str], ignore: Sequence[str] = ("source_file",)) -> DataFrame:
    """For each repeated key the fields that differ, joined by '; '."""
    fields = [c for c in df.columns if c not in (*keys, *ignore)]
    counts = df.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit("<NULL>"))).alias(f"_{c}") for c in fields])
    return counts.where("rows > 1").select(*keys, "rows", F.concat_ws("; ", *[F.when(F.col(f"_{c}") > 1, c) for c in fields]).alias("fields"))


def reconcile(actual: float, expected: float, rtol: float = 1e-9, atol: float = 1.0) -> bool:
    return abs(actual - expected) <= atol + rtol * abs(expected)
