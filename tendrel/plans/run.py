"""Running the catalogue: one statement a query over the layer of shared steps."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import analytics, catalog, marts_full, notice_files, oracles, pages, resolved, score_checks
from .dialect import SPARK, TWIN
from .layer import SOURCES as SOURCES
from .layer import Layer
from .tables import with_steps

def spark_sql() -> dict[str, str]:
    return {k: v for part in (catalog, analytics, marts_full, score_checks) for k, v in part.statements(SPARK).items()}


def twin_sql() -> dict[str, str]:
    return {k: with_steps(v, TWIN) for part in (catalog, analytics, marts_full) for k, v in part.statements(TWIN).items()} | oracles.statements() | score_checks.oracle_sql() | resolved.oracle_sql() | pages.oracle_sql() | notice_files.oracle_sql()


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return Layer(spark, sf_dir).frame(text)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, text=text: run_sql(spark, sf_dir, text)) for name, text in spark_sql().items()} | resolved.queries() | pages.queries() | notice_files.queries()


def run_catalog(spark: SparkSession, sf_dir: str, out: str, names: Iterable[str] | None = None) -> DataFrame:
    """Write the result of each named query as Parquet under ``out``; what failed is logged and doesn't stop the rest. Returns the log."""
    known, log = queries(), []
    for k, name in enumerate(names or known, 1):
        try:
            known[name](spark, sf_dir).write.mode("overwrite").parquet(f"{out}/{name}")
            log.append((k, name, "OK", spark.read.parquet(f"{out}/{name}").count(), f"{out}/{name}", None))
        except Exception as e:  # the log says which
            log.append((k, name, "FAILED", None, None, str(e)[:500]))
    return spark.createDataFrame(log, "number int, name string, status string, rows long, path string, error string")


def export_query(spark: SparkSession, sf_dir: str, name: str, out: str) -> DataFrame:
    """Write one query's result as CSV with a header; a result without rows is an error."""
    df = queries()[name](spark, sf_dir)
    if df.isEmpty():
        raise ValueError(f"{name} has no rows")
    df.write.mode("overwrite").option("header", True).csv(out)
    return df


def describe_marts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """name, rows, columns and types of each Parquet mart."""
    rows = [(name, (df := spark.read.parquet(p)).count(), len(df.columns), ", ".join(f"{c}: {t}" for c, t in df.dtypes)) for name, p in paths.items()]
    return spark.createDataFrame(rows, "name string, rows long, columns int, types string")


def exact_text(c) -> F.Column:
    """A timestamp as ISO text for export."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ssxx")
