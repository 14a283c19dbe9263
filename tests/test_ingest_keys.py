"""The ingest's keys: hashes as bytes, and tables begun with hashes as texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendrel.streaming import ingest

SCHEMA = "award_id string, release_id string, release_date date, award_value double, source_file string"


def _versions(spark, path):
    return {(r.award_id, r.release_id, r.version_number, r.version_count, r.is_latest) for r in ingest.read_versions(spark, path).collect()}


def test_hashes_are_bytes_and_older_tables_keep_texts(spark, tmp_path, monkeypatch):
    first = spark.createDataFrame([("A", "r1", None, 1.0, "x"), ("A", "r1", None, 1.0, "y"), (None, "r2", None, 2.0, "x")], SCHEMA)
    second = spark.createDataFrame([("A", "r1", None, 1.0, "z"), (None, "r2", None, 2.0, "x"), ("A", "r3", None, None, "x")], SCHEMA)
    whole = {("A", "r1", 1, 2, False), ("A", "r3", 2, 2, True), (None, "r2", 1, 1, True)}
    for name, kind in (("new", "binary"), ("old", "string")):
        path = str(tmp_path / name)
        with monkeypatch.context() as m:
            if kind == "string":
                m.setattr(ingest.F, "unhex", lambda c: c)  # as tables were written before
            ingest.upsert_versions(spark, first, path)
        ingest.upsert_versions(spark, second, path)
        table = ingest.DeltaTable(spark, path)
        assert dict(table.rows(table.pointer()[1]).dtypes)["_sig"] == kind
        assert _versions(spark, path) == whole
    assert F.unhex is ingest.F.unhex
