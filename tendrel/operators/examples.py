"""Values and examples for reports: bounded, the same in every run, and worked out where the rows are."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tendrel.functions.columns import blank_to_null, norm_name
from tendrel.operators.ranking import quantiles

NULL = "<NULL>"


def least_values(df: DataFrame, keys: Sequence[str], column: str, k: int) -> DataFrame:
    """keys, values: the ``k`` least distinct values of each group in order. Nulls are no values; groups without any give no row.

    Distinct pairs are found first and then limited by rank within each task before they are shuffled by group, so a hot group sends ``k`` values a task at most.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_value"))
    pairs = df.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("_value")).distinct()
    least = pairs.withColumn("_place", place).where(F.col("_place") <= k)
    return least.groupBy(*keys).agg(F.array_sort(F.collect_list("_value")).alias("values"))


def _long(fields: Mapping[str, Column]) -> Column:
    """field, value as rows."""
    return F.inline(F.array(*[F.struct(F.lit(name).alias("field"), c.cast("string").alias("value")) for name, c in fields.items()]))


def samples(df: DataFrame, fields: Mapping[str, str], k: int = 5) -> DataFrame:
    """field, values: the ``k`` least distinct values of each field as text, none for a field without values. Label to column; columns that aren't there are left out."""
    there = {label: F.col(f"`{c}`") for label, c in fields.items() if c in df.columns}
    labels = df.sparkSession.createDataFrame([(label,) for label in there], "field string")
    if not there:
        return labels.select("field", F.array().cast("array<string>").alias("values"))
    found = least_values(df.select(_long(there)), ["field"], "value", k)
    return labels.join(found, "field", "left").select("field", F.coalesce("values", F.array().cast("array<string>")).alias("values"))


def conflict_values(df: DataFrame, keys: Sequence[str], ignore: Sequence[str] = ("source_file",), k: int = 20) -> DataFrame:
    """keys, rows, field, distinct_values, values: a row for each field that differs between the rows of a key, with its ``k`` least values as text, null as ``<NULL>``.

    Keys in conflict are found by the least and greatest text of each field, without counting distinct values; only rows of such keys are taken apart by field.
    Keys that hold a null are no keys and give nothing. An empty table gives no rows.
    """
    fields = [c for c in df.columns if c not in (*keys, *ignore)]
    text = {c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NULL)) for c in fields}
    differs = [F.when(F.min(x) != F.max(x), F.lit(c)) for c, x in text.items()]
    named = df.dropna(subset=list(keys))
    conflicts = named.groupBy(*keys).agg(F.count("*").alias("rows"), F.array_compact(F.array(*differs)).alias("_differ")).where(F.size("_differ") > 0)
    parts = named.join(conflicts.select(*keys, "_differ"), list(keys)).select(*keys, "_differ", _long(text)).where(F.array_contains("_differ", F.col("field"))).drop("_differ")
    numbers = parts.groupBy(*keys, "field").agg(F.countDistinct("value").alias("distinct_values"))
    found = numbers.join(least_values(parts, [*keys, "field"], "value", k), [*keys, "field"])
    return found.join(conflicts.drop("_differ"), list(keys)).select(*keys, "rows", "field", "distinct_values", "values")


def name_effect(df: DataFrame, column: str) -> DataFrame:
    """metric, value: distinct names as they are and normalised, how many that reveals, and the normalised names with several raw ones. Blank names are no names."""
    groups = _names(df, column).groupBy("normalised").agg(F.count("*").alias("raw_names"))
    counts = groups.agg(F.coalesce(F.sum("raw_names"), F.lit(0)).alias("raw"), F.count("*").alias("normalised"), F.count_if(F.col("raw_names") > 1).alias("several"))
    rows = {"raw_names": F.col("raw"), "normalised_names": F.col("normalised"), "revealed": F.col("raw") - F.col("normalised"), "groups_with_several": F.col("several")}
    return counts.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), x.alias("value")) for m, x in rows.items()])))


def name_examples(df: DataFrame, column: str, k: int = 15) -> DataFrame:
    """normalised, raw_names, raw_name: all raw names of the ``k`` normalised names that have most, of several only; ties go to the name that is less."""
    names = _names(df, column)
    groups = names.groupBy("normalised").agg(F.count("*").alias("raw_names")).where("raw_names > 1")
    most = groups.orderBy(F.desc("raw_names"), "normalised").limit(k)
    return names.join(F.broadcast(most), "normalised").select("normalised", "raw_names", "raw_name")  # k rows


def _names(df: DataFrame, column: str) -> DataFrame:
    raw = blank_to_null(F.regexp_replace(column, r"^\s+|\s+$", ""))
    return df.select(norm_name(raw).alias("normalised"), raw.alias("raw_name")).where("raw_name IS NOT NULL").distinct()


def multiplicity(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """parent, parents, largest, several: for each (table, key) the keys that occur, most rows of one, and the keys with more than one. Null keys don't count."""
    out = None
    for label, (df, key) in tables.items():
        sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
        row = sizes.agg(F.lit(label).alias("parent"), F.count("*").alias("parents"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.count_if(F.col("n") > 1).alias("several"))
        out = row if out is None else out.unionByName(row)
    return out


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, count, mean, std, min, q25, q50, q75, max of numeric columns, with exact quartiles; std is that of a sample. Runs the jobs that rank each column."""
    out = None
    for c in columns:
        x = F.col(c).cast("double")
        one = df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
        row = one.join(quantiles(df, c, (0.25, 0.5, 0.75)), F.lit(True)).select(F.lit(c).alias("column"), "count", "mean", "std", "min", "q25", "q50", "q75", "max")  # one row each
        out = row if out is None else out.unionByName(row)
    return out
