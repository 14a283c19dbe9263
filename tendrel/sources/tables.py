"""Tables in and out: coercion to a schema with rejects, single-file CSV, reports as rows."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, StringType, StructType, TimestampType

from tendrel.functions.columns import blank_to_null
from tendrel.operators.relational import require_columns

BOM = "\ufeff"


def coerced(c: Column, kind: DataType) -> Column:
    """A text as ``kind``, null where it is none. Blank texts are null."""
    text = blank_to_null(c.cast("string"))
    if isinstance(kind, StringType):
        return text
    if isinstance(kind, BooleanType):
        return F.when(F.lower(text).isin("true", "1", "yes"), True).when(F.lower(text).isin("false", "0", "no"), False)
    if isinstance(kind, TimestampType):
        return F.try_to_timestamp(text)
    if isinstance(kind, DateType):
        return F.try_to_timestamp(text).cast("date")
    return text.try_cast(kind)


def load_table(df: DataFrame, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(loaded, rejects): the columns of ``schema``, in its order and types, of the rows that fit, and one row for each value that doesn't.

    A column that is missing is an error; others than those of the schema are left out. A value that can't be read as its type, and a null or blank in a column
    that may have none, reject their row: rejects has column, value, reason and the whole row as JSON. Repeated rows are loaded and rejected as often as they
    are there.
    """
    require_columns(df, schema.fieldNames())
    new = {f.name: coerced(F.col(f"`{f.name}`"), f.dataType) for f in schema}
    faults = []
    for f in schema:
        there = blank_to_null(F.col(f"`{f.name}`").cast("string"))
        reason = F.when(there.isNotNull() & new[f.name].isNull(), f"not a {f.dataType.simpleString()}")
        if not f.nullable:
            reason = F.when(there.isNull(), "missing").otherwise(reason)
        faults.append(F.struct(F.lit(f.name).alias("column"), F.col(f"`{f.name}`").cast("string").alias("value"), reason.alias("reason")))
    found = F.filter(F.array(*faults), lambda x: x["reason"].isNotNull())
    marked = df.select(F.struct(*[new[f.name].alias(f.name) for f in schema]).alias("_new"), found.alias("_faults"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("_row"))
    loaded = marked.where(F.size("_faults") == 0).select("_new.*")
    return loaded, marked.select(F.explode("_faults").alias("x"), F.col("_row").alias("row")).select("x.*", "row")


def write_csv_file(df: DataFrame, path: str, order: Sequence[str], bom: bool = False) -> None:
    """One CSV file at ``path`` with a header, rows in ``order``, columns as they are in ``df``, and a byte order mark if ``bom``.

    Spark writes the parts, dealt by ranges of the order; they are put together as a stream, whatever their size, in a file aside that is then renamed to
    ``path``: it is there whole or not at all, and replaces what was there.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    Path = jvm.org.apache.hadoop.fs.Path
    target, aside = Path(path), Path(f"{path}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(conf)
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(c) if t.startswith("decimal") else F.col(f"`{c}`") for c, t in df.dtypes])
    dealt = texts.repartitionByRange(*[F.col(f"`{c}`").asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(f"`{c}`").asc_nulls_first() for c in order])
    dealt.write.option("header", False).option("emptyValue", "").csv(parts)
    try:
        out = fs.create(aside, False)
        header = ",".join('"' + c.replace('"', '""') + '"' if set(c) & set(',"\n') else c for c in df.columns)
        out.write(bytearray(((BOM if bom else "") + header + "\n").encode()))
        for found in sorted((f.getPath() for f in fs.listStatus(Path(parts)) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName()):
            part = fs.open(found)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            part.close()
        out.close()
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), conf).rename(
            aside, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0) if not fs.exists(target) else _overwrite(spark))
    finally:
        fs.delete(Path(parts), True)


def _overwrite(spark):
    rename = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    return how


def report_rows(df: DataFrame, sections: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """section, metric, value (as text): aggregates of one table by section, in one pass and in the order given."""
    flat = [(s, m, c) for s, metrics in sections.items() for m, c in metrics.items()]
    one = df.agg(*[c.cast("string").alias(f"v{k}") for k, (_, _, c) in enumerate(flat)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), F.col(f"v{k}").alias("value")) for k, (s, m, _) in enumerate(flat)])))
