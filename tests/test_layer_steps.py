"""The Spark steps under the scored awards against the windows of their twins, on odd lines; what a written step holds; one mart for a part of a page."""

from __future__ import annotations

from collections import Counter
from datetime import datetime

import duckdb
import pytest

from tendrel.plans import layer, pages, run

TABLES = {
    "customer": ("c_custkey long, c_name string, c_mktsegment string", [(1, "Customer#1", "BUILDING"), (50, "Customer#50", "MACHINERY")]),
    "supplier": ("s_suppkey long, s_name string", [(k, f"Supplier#{k}") for k in (1, 3, 6, 11, 12, 20, 22, 31)]),
    "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_totalprice double, o_orderdate timestamp",
               [(k, 50 if k == 2 else 1, "O", "1-URGENT", 1000.0 * k, datetime(2020, 1, 1)) for k in range(1, 6)]),
}
LINE = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_linestatus string, l_shipdate timestamp"


def _line(order, number, part, supplier, day):
    return (order, number, part, supplier, 30.0, 5000.0 * part, 0.02, 0.01, "F" if part % 2 else "O", None if day is None else datetime(2021, 1, day))


# line numbers that sort otherwise as text, equal keys with several suppliers, no date, one supplier twice, no supplier row, no order
LINES = [
    _line(1, 9, 4, 12, 5), _line(1, 10, 5, 22, 5), _line(2, 1, 4, 12, 3), _line(2, 1, 5, 22, 7), _line(2, 1, 7, 3, 7), _line(2, 1, 8, 22, 1), _line(3, 1, 6, 12, None), _line(3, 2, 7, 31, None),
    _line(4, 1, 9, 99, 2), _line(4, 2, 9, 12, 1), _line(5, 1, 2, 6, 2), _line(5, 1, 3, 6, 2), _line(5, 1, 3, 11, 2), _line(7, 1, 5, 20, 2), _line(7, 1, 5, 1, 1),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("odd"))
    for name, (schema, rows) in (TABLES | {"lineitem": (LINE, LINES)}).items():
        spark.createDataFrame(rows, schema).write.parquet(f"{where}/{name}.parquet")
    return where


@pytest.mark.parametrize("name", ["q05_13_score_v1", "q05_14_score_v2", "q05_15_score_v2_summary", "q05_17_score_v3_check", "q05_19_score_v3", "q04_05_latest_population", "mart_buyer_direct_limited", "c31_long_duration"])
def test_odd_lines(spark, odd, name):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in (*TABLES, "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet/*.parquet'")
    got, twin = run.queries()[name](spark, odd), con.sql(run.twin_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(twin.columns)
    text = lambda v: repr(round(float(v), 4)) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)
    at = [twin.columns.index(c) for c in cols]
    rows = sorted(tuple(text(r[c]) for c in cols) for r in got.collect())
    assert rows and rows == sorted(tuple(text(r[i]) for i in at) for r in twin.fetchall())


def test_a_written_step_holds_what_its_readers_name(spark, sf_dir, monkeypatch):
    held, view = {}, layer.Layer.view
    monkeypatch.setattr(layer.Layer, "view", lambda self, name, rows: held.setdefault(name, set(rows.columns)) and view(self, name, rows))
    run.queries()["mart_buyer_direct_limited"](spark, sf_dir)
    assert {"buyer_key", "award_value", "method_group", "buyer_name"} <= held["dataset"]
    assert not held["dataset"] & {"rationale", "supplier_names", "award_title", "tender_title", "cpv_code", "score"}


def test_scores_shuffle_lines_once_for_latest_and_counts(spark, sf_dir):
    one = layer.Layer(spark, sf_dir)
    times = Counter()

    def visit(text):
        for below, n in one.names(text).items():
            times[below] += n
            visit(one.texts[below])

    visit(run.spark_sql()["q05_19_score_v3"])
    assert times["latest_lines"] == 1 and not times["one_release"] and not times["keyed_links"]


@pytest.mark.parametrize("part", ["figures", "direct_limited", "long_duration"])
def test_a_part_of_the_structure_page_builds_one_mart(spark, sf_dir, monkeypatch, part):
    built, mart = [], pages._mart
    monkeypatch.setattr(pages, "_mart", lambda s, d, name: built.append(name) or mart(s, d, name))
    pages._structure(part)(spark, sf_dir)
    assert len(built) == 1


def test_name_examples_read_lines_once(spark, sf_dir):
    """Names are made distinct before they are taken in capitals, and no shared step of links is built for them."""
    text = "SELECT DISTINCT supplier_name FROM link_names"
    assert layer.Layer(spark, sf_dir).written(text) == set()
    got, con = run.queries()["d15_name_examples"](spark, sf_dir), duckdb.connect()
    for t in (*TABLES, "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(run.twin_sql()["d15_name_examples"]).fetchall())


@pytest.mark.parametrize("name", ["d31_quality_gate", "w04_versions", "d19_award_versions", "d20_relationships", "d13_supplier_multiplicity"])
def test_versions_and_links_by_number(spark, tmp_path, name):
    """Windows go by numbers, not by the ids made of them: lines without an order number or a line number too."""
    lines = [*LINES, _line(None, 1, 4, 12, 5), _line(None, 2, 5, 22, 6), _line(6, None, 4, 12, 5), _line(6, None, 5, 22, 7), _line(6, 3, 5, 22, 8)]
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t, (schema, rows) in (TABLES | {"lineitem": (LINE, lines)}).items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got, twin = run.queries()[name](spark, str(tmp_path)), con.sql(run.twin_sql()[name])
    cols = sorted(got.columns)
    at = [twin.columns.index(c) for c in cols]
    text = lambda v: repr(round(float(v), 4)) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)
    rows = sorted(tuple(text(r[c]) for c in cols) for r in got.collect())
    assert rows and rows == sorted(tuple(text(r[i]) for i in at) for r in twin.fetchall())


def test_versions_shuffle_lines_once_and_references_join_nothing(spark, sf_dir):
    plan = run.queries()["w04_versions"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "hashpartitioning(l_orderkey" in plan
    assert not [x for x in run.spark_sql()["d31_quality_gate"].split("UNION ALL") if " JOIN " in x]
