"""Resolution, quality gate, loads and sinks, the delta table of the ingest, and the layer of shared steps, on small rows with nulls, copies, ties and empty tables."""

from __future__ import annotations

import io
import re
from contextlib import redirect_stdout
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DecimalType, IntegerType, StringType, StructField, StructType

from tendrel.functions.columns import hash_key
from tendrel.operators import gate
from tendrel.operators import resolution as R
from tendrel.operators.relational import top_missing
from tendrel.plans import layer, resolved, run
from tendrel.sources import tables as T
from tendrel.streaming import ingest

D = [datetime(2025, 1, k) for k in range(1, 9)]
RELEASE = "release_id string, ocid string, release_date timestamp, tender_status string, tender_value double, source_file string"
AWARD = "award_id string, release_id string, ocid string, release_date timestamp, award_value double, contract_start timestamp, contract_end timestamp, source_file string"
LINK = "award_id string, release_id string, supplier_index int, supplier_id string, supplier_name string, source_file string"


def test_hash_key(spark):
    rows = spark.createDataFrame([(None, "a"), ("null", "a"), ("<NULL>", "a"), ("", "a"), ("a", None), ("ab", ""), ("a", "b")], "x string, y string")
    assert rows.select(hash_key([F.col("x"), F.col("y")]).alias("h")).distinct().count() == 7


def test_releases_and_procurements(spark):
    raw = spark.createDataFrame([
        ("r1", "o1", D[1], "open", 1.0, "b.csv"), ("r1", "o1", D[1], "open", 1.0, "a.csv"), ("r1", "o1", D[1], "open", 1.0, None), ("r2", "o1", None, "none", None, "a.csv"),
        ("r3", "o1", D[1], "later id", 3.0, "a.csv"), ("r4", "o2", None, "undated", 4.0, None), (None, "o3", D[0], "x", 5.0, "a.csv"), (None, "o3", D[0], "x", 5.0, "b.csv"),
    ], RELEASE)
    once = R.resolve_releases(raw)
    assert once.columns == raw.columns
    assert {(r.release_id, r.source_file) for r in once.collect()} == {("r1", "a.csv"), ("r2", "a.csv"), ("r3", "a.csv"), ("r4", None), (None, "a.csv")} and once.count() == 5
    master = {r.ocid: r.tender_status for r in R.build_procurements(once).collect()}
    assert master == {"o1": "later id", "o2": "undated", "o3": "x"}
    assert R.resolve_releases(raw.limit(0)).count() == 0 and R.build_procurements(once.limit(0)).count() == 0


def test_award_versions(spark):
    raw = spark.createDataFrame([
        ("A", "r1", "o1", D[0], 1.0, D[0], D[1], "a"), ("A", "r1", "o1", D[0], 1.0, D[0], D[1], "b"), ("A", "r1", "o1", D[0], 2.0, D[0], D[1], "a"), ("A", "r0", "o1", None, 9.0, D[0], D[1], "a"),
        ("A", "r2", "o1", D[3], None, D[0], D[1], None), ("A", "r2", "o1", D[3], None, D[0], D[1], None), ("B", "r1", "o2", D[0], None, None, None, "a"), (None, None, None, None, None, None, None, None),
    ], AWARD)
    out = R.resolve_award_versions(raw)
    got = {(r.award_id, r.release_id, r.award_value, r.source_file, r.award_version_number, r.award_version_count, r.is_latest_award_version) for r in out.collect()}
    assert got == {("A", "r0", 9.0, "a", 1, 4, False), ("A", "r1", 1.0, "a", 2, 4, False), ("A", "r1", 2.0, "a", 3, 4, False), ("A", "r2", None, None, 4, 4, True), ("B", "r1", None, "a", 1, 1, True),
                   (None, None, None, None, 1, 1, True)}


def test_copies_of_one_row_collapse_before_the_shuffle(spark):
    plan = R.drop_copies(spark.range(10).select(F.lit("k").alias("award_id"), F.lit("f").alias("source_file")), ["award_id"])._jdf.queryExecution().toString()
    assert "partial_min_by" in plan


def test_a_hash_is_not_shuffled_with_the_rows_that_it_is_of(spark):
    raw = spark.createDataFrame([("A", "r1", 1.0, "b"), ("A", "r1", 1.0, "a"), ("A", "r1", 1.0, None), ("A", "r1", 2.0, None), (None, None, None, "b"), (None, None, None, "a")], "award_id string, release_id string, x double, source_file string")
    once = R.drop_copies(raw, ["award_id", "release_id"])
    assert "sha2" not in once._jdf.queryExecution().toString() and once.columns == raw.columns
    assert {tuple(r) for r in once.collect()} == {("A", "r1", 1.0, "a"), ("A", "r1", 2.0, None), (None, None, None, "a")} and once.count() == 3


def test_references_are_counted_without_a_join(spark):
    child = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1), (None, 1), ("c", None)], "k string, n int")
    parent = spark.createDataFrame([("a", 1), ("a", 1), (None, 1), ("c", None)], "key string, m int")
    found = gate.edge("e", child, parent, {"k": "key", "n": "m"})
    assert [r.value for r in found.collect()] == [4] and "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r.value for r in gate.edge("e", child.limit(0), parent, {"k": "key", "n": "m"}).collect()] == [0]


def test_the_gate_writes_no_table(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(resolved, "settle", lambda df: pytest.fail("a table of the gate is written"))
    assert resolved.queries()["d31_gate_with_verdict"](spark, sf_dir).count() > 40


def test_relationships_and_suppliers(spark):
    raw = spark.createDataFrame([
        ("A", "r1", 0, "GB-1", "Acme  Ltd", "a"), ("A", "r1", 0, "GB-1", "Acme  Ltd", "b"), ("A", "r1", 0, "GB-1", "ACME Limited", "a"), ("B", "r2", 0, "GB-COH-0", "Bolt", "a"), ("B", "r2", 1, None, None, None),
        ("C", "r3", 0, "GB-2", "Dyn", "a"), ("C", "r3", 1, "GB-1", "acme ltd", "a"),
    ], LINK)
    links = R.resolve_relationships(raw)
    got = {(r.relationship_observation_key, r.supplier_name, r.supplier_key, r.supplier_id_name_count, r.supplier_identity_flag) for r in links.collect()}
    assert got == {
        ("A|r1|0", "Acme  Ltd", "SUP_ID:GB-1", 2, "id_multiple_names_review"), ("A|r1|0", "ACME Limited", "SUP_ID:GB-1", 2, "id_multiple_names_review"),
        ("B|r2|0", "Bolt", "NAME:BOLT", None, "unreliable_id_name_based"), ("B|r2|1", None, "UNKNOWN:B:1", None, "unreliable_id_name_based"), ("C|r3|0", "Dyn", "SUP_ID:GB-2", 1, "confirmed_id"),
        ("C|r3|1", "acme ltd", "SUP_ID:GB-1", 2, "id_multiple_names_review")}
    master = {r.supplier_key: (r.canonical_supplier_name, r.reported_name_count, r.relationship_count, r.supplier_id_quality, r.identity_review_flag) for r in R.supplier_master(links).collect()}
    assert master["SUP_ID:GB-1"] == ("ACME LTD", 2, 3, "usable", "review_name_variation") and master["UNKNOWN:B:1"] == (None, 0, 1, "unreliable_or_missing", "no_name_conflict")
    log = {r.issue_type: r.rows_removed for r in R.resolution_log({"relationships": (raw, links)}).collect()}
    assert log["supplier_relationship_duplicates"] == 1 and log["release_duplicates"] == 0 and len(log) == 6


def test_gate(spark):
    procurements = spark.createDataFrame([("o1", 5.0), ("o1", -1.0), (None, None)], "ocid string, tender_value double")
    releases = spark.createDataFrame([("r1", "o1"), ("r2", "o9"), ("r2", None)], "release_id string, ocid string")
    awards = spark.createDataFrame([
        ("A", "r1", "o1", -5.0, D[3], D[1], 1, 2, False), ("A", "r2", "o1", 1.0, D[0], D[1], 2, 2, True), ("B", "r1", "o2", None, None, None, 0, 2, True), ("B", "r1", "o2", None, None, None, None, 2, True),
    ], "award_id string, release_id string, ocid string, award_value double, contract_start timestamp, contract_end timestamp, award_version_number int, award_version_count int, is_latest_award_version boolean")
    links = spark.createDataFrame([("A", "r1", 0, "id_multiple_names_review", "K"), ("A", "r9", 0, "unreliable_id_name_based", "L"), ("A", "r9", 0, None, None)],
                                  "award_id string, release_id string, supplier_index int, supplier_identity_flag string, supplier_key string")
    suppliers = spark.createDataFrame([("K",)], "supplier_key string")
    rows = gate.quality_gate(procurements, releases, awards, links, suppliers).collect()
    found = {r.test: (r.status, r.value) for r in rows}
    want = {
        "procurements.ocid.null": ("FAIL", 1), "procurements.ocid.duplicate": ("FAIL", 1), "negative_tender_values": ("REVIEW", 1), "releases.release_id.null": ("PASS", 0),
        "releases.release_id.duplicate": ("FAIL", 1), "awards.award_id_release_id.duplicate": ("FAIL", 1), "award_version_number.null": ("FAIL", 1), "award_version_number.invalid": ("FAIL", 1),
        "exactly_one_latest_version_per_award": ("FAIL", 1), "negative_award_values": ("REVIEW", 1), "contract_end_before_start": ("REVIEW", 1), "award_release_supplier_index_duplicate": ("FAIL", 1),
        "relationships_flagged_multiple_names": ("INFO", 1), "relationships_unreliable_ids": ("INFO", 1), "release_to_procurement": ("FAIL", 2), "award_to_procurement": ("FAIL", 2),
        "relationship_to_award": ("FAIL", 2), "relationship_to_supplier": ("FAIL", 2), "awards.row_count": ("INFO", 4), "awards.column_count": ("INFO", 9), "awards.award_value.missing": ("INFO", 2),
    }
    assert {k: found[k] for k in want} == want
    assert next(r.notes for r in rows if r.test == "awards.award_value.missing") == "50.00% missing"
    assert rows[-1].test == "quality_gate" and rows[-1].status == "FAIL" and found["quality_gate"][1] == sum(r.status == "FAIL" for r in rows[:-1])
    empty = {r.test: r.status for r in gate.quality_gate(*[t.limit(0) for t in (procurements, releases, awards, links, suppliers)]).collect()}
    assert empty["quality_gate"] == "PASS" and empty["procurements.ocid.null"] == "PASS" and empty["awards.row_count"] == "INFO"


def test_gate_reads_each_table_once(spark, tmp_path):
    awards = spark.createDataFrame([("A", "r1", "o1", 1.0, D[0], D[1], 1, 1, True)], "award_id string, release_id string, ocid string, award_value double, contract_start timestamp, contract_end timestamp, award_version_number int, award_version_count int, is_latest_award_version boolean")
    awards.write.parquet(str(tmp_path / "a"))
    checks = gate.Checks("awards", spark.read.parquet(str(tmp_path / "a")), ["award_id", "release_id"], within="award_id")
    checks.unique("x", "y")
    checks.missing("award_value")
    with redirect_stdout(io.StringIO()) as out:
        checks.results().explain()
    assert out.getvalue().count("FileScan") == 1


def test_expected_counts_and_missing(spark):
    a, b = spark.range(3), spark.range(4)
    assert {tuple(r) for r in gate.expect_counts({"x": a, "y": b}, {"x": a, "y": a}).collect()} == {("x", 3, 3, 0, "PASS"), ("y", 4, 3, 1, "FAIL")}
    rows = spark.createDataFrame([(1, None, None, "x"), (None, None, None, "x")], "a int, c int, b int, d string")
    assert [tuple(r) for r in top_missing(rows, 2).collect()] == [("b", 2, 100.0), ("c", 2, 100.0)] and top_missing(rows.limit(0)).count() == 0


def test_load_table(spark):
    schema = StructType([StructField("n", IntegerType()), StructField("k", StringType(), False), StructField("d", DateType()), StructField("b", BooleanType()), StructField("v", DecimalType(8, 2))])
    raw = spark.createDataFrame([(" a ", " 7 ", "2025-01-02", "True", "1.25", "z"), ("b", "x", "never", "maybe", "", "z"), (" ", None, None, None, None, "z"), ("c", "", " ", "0", "12345678901", "z")],
                                "k string, n string, d string, b string, v string, extra string")
    loaded, rejects = T.load_table(raw, schema)
    assert loaded.schema.names == ["n", "k", "d", "b", "v"] and [f.dataType for f in loaded.schema] == [f.dataType for f in schema]
    assert [(r.n, r.k, str(r.d), r.b, float(r.v)) for r in loaded.collect()] == [(7, "a", "2025-01-02", True, 1.25)]
    found = {(r.column, r.value, r.reason) for r in rejects.collect()}
    assert found == {("n", "x", "not a int"), ("d", "never", "not a date"), ("b", "maybe", "not a boolean"), ("k", " ", "missing"), ("v", "12345678901", "not a decimal(8,2)")}
    assert all('"extra":"z"' in r.row for r in rejects.collect())
    with pytest.raises(ValueError, match="missing columns: n"):
        T.load_table(raw.drop("n"), schema)
    assert T.load_table(raw.limit(0), schema)[0].count() == 0


def test_csv_file(spark, tmp_path):
    path = str(tmp_path / "mart.csv")
    rows = spark.createDataFrame([(k, f"Zoë, {k}" if k % 2 else 'say "x"', None) for k in range(40, 0, -1)], "n int, s string, e string").repartition(5)
    T.write_csv_file(rows, path, ["n"], bom=True)
    data = open(path, "rb").read()
    assert data.startswith(b"\xef\xbb\xbfn,s,e\n") and data.count(b"\n") == 41
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    assert [int(r[0]) for r in back.collect()] == list(range(1, 41))
    T.write_csv_file(rows.limit(0), path, ["n"])
    assert open(path, "rb").read() == b"n,s,e\n"
    assert {p.name for p in tmp_path.iterdir()} <= {"mart.csv", ".mart.csv.crc"} or not [p for p in tmp_path.iterdir() if "parts" in p.name]


def test_report_rows(spark):
    rows = T.report_rows(spark.range(4), {"Size": {"rows": F.count("*"), "top": F.max("id")}, "Sums": {"sum": F.sum("id")}})
    assert [tuple(r) for r in rows.collect()] == [("Size", "rows", "4"), ("Size", "top", "3"), ("Sums", "sum", "6")]


BATCH = "award_id string, release_id string, release_date timestamp, award_value double, source_file string"


def versions(spark, table):
    return {(r.award_id, r.release_id, r.award_value, r.version_number, r.version_count, r.is_latest) for r in ingest.read_versions(spark, table).collect()}


def test_delta_table(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    assert ingest.read_versions(spark, table) is None
    ingest.upsert_versions(spark, spark.createDataFrame([("A", "r3", D[3], 3.0, "x"), ("A", "r3", D[3], 3.0, "y"), ("B", "r1", D[0], 5.0, "x"), (None, "r1", None, None, None)], BATCH), table, 0)
    before = versions(spark, table)
    late = spark.createDataFrame([("A", "r1", D[1], 1.0, "z"), ("B", "r1", D[0], 5.0, "again")], BATCH)
    # a crash after the rows are written, and one after the numbers: nothing of either shows, and the next try is whole
    for step in ("_numbered", "advance"):
        with monkeypatch.context() as m:
            m.setattr(*((ingest, step) if step == "_numbered" else (ingest.DeltaTable, step)), lambda *a: (_ for _ in ()).throw(OSError("killed")))
            with pytest.raises(OSError):
                ingest.upsert_versions(spark, late, table, 1)
        assert versions(spark, table) == before
    ingest.upsert_versions(spark, late, table, 1)
    want = {("A", "r1", 1.0, 1, 2, False), ("A", "r3", 3.0, 2, 2, True), ("B", "r1", 5.0, 1, 1, True), (None, "r1", None, 1, 1, True)}
    assert versions(spark, table) == want
    ingest.upsert_versions(spark, late, table, 1)  # the stream was restarted
    assert versions(spark, table) == want
    newest = ingest.DeltaTable(spark, table).pointer()[1]["deltas"][-1]
    assert spark.read.parquet(f"{table}/rows-{newest}").count() == 1 and spark.read.parquet(f"{table}/numbers-{newest}").count() == 2  # only award A
    ingest.DeltaTable(spark, table).compact()
    assert versions(spark, table) == want and len(ingest.DeltaTable(spark, table).pointer()[1]["deltas"]) == 1


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    table, advance, other = str(tmp_path / "t"), ingest.DeltaTable.advance, []

    def slow(self, number, said):
        if not other:
            other.append(1)  # another writer commits between this one's reading and its pointer
            ingest.upsert_versions(spark, spark.createDataFrame([("A", "r2", D[2], 2.0, "x")], BATCH), table)
        return advance(self, number, said)

    monkeypatch.setattr(ingest.DeltaTable, "advance", slow)
    ingest.upsert_versions(spark, spark.createDataFrame([("A", "r1", D[1], 1.0, "x")], BATCH), table)
    assert versions(spark, table) == {("A", "r1", 1.0, 1, 2, False), ("A", "r2", 2.0, 2, 2, True)}


def test_layer(spark, sf_dir):
    """Lines are read twice at most, whatever a statement names how often; no view is left, and none of the caller's is touched."""
    spark.range(3).createOrReplaceTempView("orders")
    statements = run.spark_sql()
    for name in ("c24_executive_kpis", "d31_quality_gate", "d24_quality_summary", "q04_07_top_by_value", "c11_buyer_overview", "q05_19_score_v3", "q06_03_counts_per_award"):
        one = layer.Layer(spark, sf_dir)
        written = one.written(statements[name])
        times = {"": 1}

        def lines(text):
            own = len(re.findall(r"\bFROM lineitem\b", text))
            return own + sum(n * lines(one.texts[x]) for x, n in one.names(text).items() if x not in written)

        assert lines(statements[name]) <= 4 and max((lines(one.texts[x]) for x in written), default=0) <= 2, name
    run.queries()["c24_executive_kpis"](spark, sf_dir).collect()
    assert {t.name for t in spark.catalog.listTables() if t.isTemporary} == {"orders"} and spark.table("orders").count() == 3
    spark.catalog.dropTempView("orders")


@pytest.mark.parametrize("name", sorted(resolved.queries()))
def test_resolved_twins(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in ("orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = resolved.queries()[name](spark, sf_dir)
    twin = con.sql(resolved.oracle_sql()[name])
    assert sorted(got.columns) == sorted(twin.columns)
    cols = sorted(got.columns)
    text = lambda v: repr(round(float(v), 4)) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)
    at = [twin.columns.index(c) for c in cols]
    assert sorted(tuple(text(r[c]) for c in cols) for r in got.collect()) == sorted(tuple(text(r[i]) for i in at) for r in twin.fetchall())
