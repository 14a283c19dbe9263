"""The procurement side: queries against their SQL twins, operators on small rows, ragged files and the incremental ingest."""

from __future__ import annotations

import math
import os

import pytest
from pyspark.sql import functions as F

from tendrel.functions import columns as C
from tendrel.operators import ranking, registry
from tendrel.operators import relational as R
from tendrel.plans import marts, run
from tendrel.plans.tables import VALUE_BANDS
from tendrel.sources import notices
from tendrel.streaming import ingest


def rows_of(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: "" if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 4) if isinstance(v, float) else v
    return sorted(str([plain(r[i]) for i in order]) for r in records)


@pytest.fixture(scope="module")
def twin(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in run.SOURCES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


CHECKED = ["q03_03_by_method", "q03_13b_top5", "q04_07_top_by_value", "q04_16_concentration", "q05_08_participation", "q05_12_review_candidates", "q05_13_score_v1", "q05_19_score_v3", "q06_03_counts_per_award",
           "c18_buyer_review", "c20_activity_value_matrix", "d31_quality_gate", "w10_tag_sequences", "d07_placeholder_ids", "mart_kpis", "mart_buyer_overview", "mart_buyer_segments", "mart_supplier_concentration", "mart_review_population", "c28_components", "c28_methods", "c28_candidates", *registry.queries()]


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows_as_sql(spark, sf_dir, twin, name):
    df = (run.queries() | registry.queries())[name](spark, sf_dir)
    found = twin.execute((run.twin_sql() | registry.oracle_sql())[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.collect(), df.columns) == rows_of(found.fetchall(), columns)


def test_every_query_has_a_twin_and_65_are_in_the_catalogue():
    names = run.queries()
    assert names.keys() == run.twin_sql().keys()
    assert sum(k.startswith("q0") for k in names) == 65


def test_matrix_adds_up_to_bands_and_segments(spark, sf_dir):
    q = run.queries()
    total = lambda name: tuple(q[name](spark, sf_dir).agg(F.sum("buyers"), F.sum("awards"), F.round(F.sum("value"), 2)).first())
    assert total("c20_activity_value_matrix") == total("c19_activity_bands") == total("c21_segment_summary")
    assert q["c20_activity_value_matrix"](spark, sf_dir).count() == 30
    assert q["d33_reconciliation"](spark, sf_dir).first() == (True, True)
    # the tables are made with awards whose order gives no procurement, and with ends before starts
    assert {r.test for r in q["d31_quality_gate"](spark, sf_dir).where("status = 'FAIL'").collect()} == {"award to procurement", "end before start"}


def test_columns(spark):
    df = spark.createDataFrame([(" Acme  Limited. ", "GB-COH-0", "12.345"), (None, " gb-coh-7 ", "x"), ("", None, None)], "name string, id string, v string")
    out = df.select(C.norm_suffix(F.col("name")).alias("n"), C.is_placeholder_id(F.col("id")).alias("p"), C.supplier_key(F.col("id"), F.col("name"), F.lit("A"), F.lit(2)).alias("k"), C.to_number(F.col("v")).cast("string").alias("v"), C.reference_text(F.col("name")).alias("r")).collect()
    assert [tuple(r) for r in out] == [("ACME LTD", True, "NAME:ACME LIMITED.", "12.35", False), (None, False, "SUP_ID:GB-COH-7", None, False), ("", True, "UNKNOWN:A:2", None, False)]
    bands = spark.createDataFrame([(100_000,), (99_999,), (None,), (2_000_000_000,)], "x long").select(C.band(F.col("x"), VALUE_BANDS).alias("l"), C.band(F.col("x"), VALUE_BANDS, right=True).alias("r")).collect()
    assert [tuple(r) for r in bands] == [("£100K-<£1M", "<£100K"), ("<£100K", "<£100K"), ("Unknown", "Unknown"), ("£1B+", "£1B+")]


def test_relational(spark):
    df = spark.createDataFrame([(1, "a", "f"), (1, "a", "g"), (2, "b", "f"), (2, "c", "f"), (None, "d", "f"), (3, "e", "f")], "k int, v string, source_file string")
    summary, conflicts, once = R.verify_grain(df, ["k"])
    assert tuple(summary.first()) == (3, 2, 1, 1) and conflicts.count() == 2 and once.count() == 4
    assert [tuple(r) for r in R.conflict_fields(df, ["k"]).where("k = 2").collect()] == [(2, 2, "v")]
    with pytest.raises(ValueError):
        R.validated_join(df, df, ["k"])
    with pytest.raises(ValueError):
        R.require_columns(df, ["k", "nope"])


def test_ranking(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", float(i % 7)) for i in range(200)] + [(200, "a", None), (201, None, 4.0)], "id int, k string, x double")
    rows = ranking.ranked(df, [F.desc("x"), F.col("id")], "x").orderBy("rn").collect()
    assert [r.id for r in rows] == [r.id for r in df.orderBy(F.desc("x"), "id").collect()] and [r.rn for r in rows] == list(range(1, 203))
    assert rows[200].running == df.agg(F.sum("x")).first()[0]
    got = {r.k: tuple(r)[1:] for r in ranking.quantiles(df, "x", (0.25, 0.95), ["k"]).collect()}
    assert got == {r.k: tuple(r)[1:] for r in df.groupBy("k").agg(F.percentile("x", F.lit(0.25)), F.percentile("x", F.lit(0.95))).collect()}
    assert ranking.quantiles(df.where("false"), "x", (0.5,)).collect() == [(None,)]


def test_ragged_files(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    r = "releases/0/"
    a.write_bytes(("﻿" + ",".join(r + c for c in ("ocid", "id", "date", "awards/0/id", "awards/0/value/amount", "awards/0/suppliers/0/name")) + '\no1,r1,2025-01-02T00:00:00Z,A1,10.5,"Line\nbreak"\n,r9,2025-01-02T00:00:00Z,A9,1,x\n').encode())
    b.write_bytes((",".join(r + c for c in ("ocid", "id", "date", "buyer/name", "awards/0/id", "awards/1/id", "awards/1/suppliers/0/id", "awards/1/suppliers/1/name")) + "\no2,r2,2025-03-01T00:00:00Z,Stra\xdfe,A2,A3,S1,S2\no3,r3,2024-03-01T00:00:00Z,,A4,,,\n").encode("latin-1"))
    df = notices.read_notices(spark, str(tmp_path / "*.csv"))
    out = notices.normalise(df, 2025)
    assert {(x.ocid, x.buyer_name) for x in out["releases"].collect()} == {("o1", None), ("o2", "Straße")}
    assert {(x.award_id, x.award_index) for x in out["awards"].collect()} == {("A1", 0), ("A2", 0), ("A3", 1)}
    assert {(x.award_id, x.supplier_index, x.supplier_id, x.supplier_name) for x in out["award_suppliers"].collect()} == {("A1", 0, None, "Line\nbreak"), ("A3", 0, "S1", None), ("A3", 1, None, "S2")}
    pairs = notices.unpivot_indexed(df, "releases/0/awards", {"award_id": "id"}, ["source_file"])
    assert {(x.source_file, x.position, x.award_id) for x in pairs.collect()} == {("a.csv", 0, "A1"), ("a.csv", 0, "A9"), ("b.csv", 0, "A2"), ("b.csv", 1, "A3"), ("b.csv", 0, "A4")}
    clean = {x.ocid: x for x in notices.clean_records(df).collect()}
    assert clean.keys() == {"o1", "o2", "o3"} and (clean["o1"].month_name, clean["o1"].has_supplier, clean["o1"].has_contract_dates, clean["o1"].award_to_tender_ratio) == ("January", True, False, None)
    assert notices.schema_complexity(notices.discover_headers(spark, str(tmp_path / "*.csv"))).count() == 2


def test_files_over_a_mebibyte(spark, tmp_path):
    size, row = 1 << 20, "o{},{}\n"
    head = "releases/0/ocid,releases/0/buyer/name\n"
    fill = lambda upto: head + "o1," + "x" * (upto - len(head) - 3)
    (tmp_path / "a.csv").write_bytes((fill(size - 1) + "é\n" + row.format(2, "Zoë")).encode())
    (tmp_path / "b.csv").write_bytes((fill(size + 9) + "\n" + row.format(3, "Straße")).encode("latin-1"))
    wide = "releases/0/ocid," + ",".join(f"c{k}" for k in range(150_000))
    assert len(wide) > size
    for name, last in (("c", "releases/0/p"), ("d", "releases/0/q")):
        (tmp_path / f"{name}.csv").write_text(f"{wide},{last}\r\n")
    found = {r.file[-5:]: r for r in notices.discover_headers(spark, str(tmp_path / "*.csv")).collect()}
    assert {k: r.encoding for k, r in found.items()} == {"a.csv": "UTF-8", "b.csv": "ISO-8859-1", "c.csv": "UTF-8", "d.csv": "UTF-8"}
    assert found["c.csv"].header == f"{wide},releases/0/p" and found["d.csv"].header == f"{wide},releases/0/q"
    names = {r[0]: r[1][-6:] for r in notices.read_notices(spark, str(tmp_path / "[ab].csv")).where("`releases/0/ocid` <> 'o1'").select("`releases/0/ocid`", "`releases/0/buyer/name`").collect()}
    assert names == {"o2": "Zoë", "o3": "Straße"}


def test_incremental_ingest(spark, tmp_path):
    schema = spark.createDataFrame([], "award_id string, release_id string, release_date timestamp, award_value double").schema
    source, table = tmp_path / "in", str(tmp_path / "table")
    os.makedirs(source)
    header = "award_id,release_id,release_date,award_value\n"
    for name, rows in (("1", "A,r1,2025-01-01,1\nA,r1,2025-01-01,1\nB,r1,2025-01-01,5\n"), ("2", "A,r3,2025-03-01,3\nB,r1,2025-01-01,5\n"), ("3", "A,r2,2025-02-01,2\n")):  # the last one is late
        (source / f"{name}.csv").write_text(header + rows)
        ingest.ingest_stream(spark, str(source), schema, table, str(tmp_path / "ck")).awaitTermination()
    spark.catalog.clearCache()
    got = {(r.award_id, r.release_id, r.version_number, r.version_count, r.is_latest) for r in ingest.read_versions(spark, table).collect()}
    assert got == {("A", "r1", 1, 3, False), ("A", "r2", 2, 3, False), ("A", "r3", 3, 3, True), ("B", "r1", 1, 1, True)}


def test_small_operators(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 5), (1, "b", None), (2, "a", 7), (None, None, 1)], "k int, v string, n int")
    none = df.where("false")
    assert R.standardise_names(df.toDF(" K y", "V", "n ")).columns == ["k_y", "v", "n"]
    assert R.project(df, {"x": "n"}).columns == ["x"] and R.find_column(df, ["q", "v"]) == "v"
    for bad in (lambda: R.project(df, {"x": "q"}), lambda: R.find_column(df, ["q"]), lambda: R.assert_unique_mapping(df, ["k"], "v")):
        with pytest.raises(ValueError):
            bad()
    assert [tuple(r) for r in R.most_frequent(df, ["k"], "v").orderBy("k").collect()] == [(1, "b", 2), (2, "a", 1)]
    assert tuple(R.check_pk(df, ["k"]).first()) == (1, 1, 2) and tuple(R.check_pk(none, ["k"]).first()) == (0, 0, 0)
    assert tuple(R.count_exact_duplicates(df.unionByName(df)).first()) == (10, 5, 5) and tuple(R.count_exact_duplicates(none).first()) == (0, 0, 0)
    assert [tuple(r) for r in R.threshold_counts(df, "n", [5, 100]).collect()] == [(5, 3, 17.0), (100, 0, 0.0)]
    assert [tuple(r) for r in R.profile_fields(df, {"N": "n", "Q": "q"}).collect()] == [("N", "n", "int", 4, 1, 20.0, 3), ("Q", "q", "NOT FOUND", None, None, None, None)]
    assert R.presence_flags(df, {"both": ["v", "n"]}).where("both").count() == 3 and R.missing_flags(df, ["n"]).where("missing_n = 1").count() == 1
    assert {(r.k, r.share) for r in R.share_within(df, ["k"], "n").collect()} == {(1, 50.0), (1, None), (2, 100.0), (None, 100.0)}
    texts = spark.createDataFrame([(None,), (" ",), ("REDACTED",), ("See webpage",), ("Acme",)], "s string")
    out = texts.select(C.name_quality(F.col("s")).alias("q"), C.usable_supplier(F.lit("K"), F.col("s")).alias("u"), C.method_group(F.col("s")).alias("m")).collect()
    assert [tuple(r) for r in out] == [
        ("Missing supplier name", False, "Unknown"), ("Missing supplier name", False, "Unknown"), ("Redacted / unavailable", True, "Other"),
        ("Source-text contamination", False, "Other"), ("Usable supplier name", True, "Other")]


def test_marts(spark, sf_dir, tmp_path):
    checks = marts.consolidate(spark, sf_dir, str(tmp_path), {"total_awards": 1}).collect()
    assert [r.check for r in checks if r.status == "FAIL"] == ["expected total_awards"]
    assert spark.read.parquet(str(tmp_path / "manifest")).count() == 20 and run.describe_marts(spark, {"kpis": str(tmp_path / "kpis")}).first().rows == 14


def test_catalogue_runner(spark, sf_dir, tmp_path):
    log = run.run_catalog(spark, sf_dir, str(tmp_path), ["q03_01_total", "no_such_query"]).collect()
    assert [(r.name, r.status) for r in log] == [("q03_01_total", "OK"), ("no_such_query", "FAILED")]
