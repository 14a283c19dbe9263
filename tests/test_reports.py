"""Examples of values, the report's pages, header discovery by lines, and places within sorted ranges."""

from __future__ import annotations

import decimal
import random
from decimal import Decimal

from pyspark.sql import functions as F

from tendrel.operators import examples, ranking
from tendrel.plans import pages
from tendrel.sources import notices


def test_least_values_of_a_hot_group(spark):
    rows = [("hot", f"v{k % 700:04d}") for k in range(20_000)] + [("b", None), ("c", "x"), ("c", "x"), (None, "n")]
    df = spark.createDataFrame(rows, "k string, v string")
    found = {r.k: r["values"] for r in examples.least_values(df, ["k"], "v", 3).collect()}
    assert found == {"hot": ["v0000", "v0001", "v0002"], "c": ["x"], None: ["n"]}
    plan = examples.least_values(df, ["k"], "v", 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # the limit is applied in tasks before the shuffle by group
    assert examples.least_values(df.where("false"), ["k"], "v", 3).count() == 0


def test_samples(spark):
    df = spark.createDataFrame([(k, None, "a") for k in range(9)], "n int, none string, `odd name` string")
    found = {r.field: r["values"] for r in examples.samples(df, {"N": "n", "Nothing": "none", "Odd": "odd name", "Gone": "gone"}, 2).collect()}
    assert found == {"N": ["0", "1"], "Nothing": [], "Odd": ["a"]}
    assert examples.samples(df, {"Gone": "gone"}).collect() == []


def test_conflict_values_against_plain_python(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("abcd") if rnd.random() > 0.1 else None, rnd.choice([None, 1, 2]), rnd.choice(["x", "x", "y"]), str(k)) for k in range(60)] + [("same", 1, "x", "0"), ("same", 1, "x", "1")]
    found = {(r.k, r.field): (r.rows, r.distinct_values, r["values"]) for r in examples.conflict_values(spark.createDataFrame(rows, "k string, n int, t string, source_file string"), ["k"], k=2).collect()}
    want = {}
    for key in {r[0] for r in rows if r[0] is not None}:
        mine = [r for r in rows if r[0] == key]
        for place, name in ((1, "n"), (2, "t")):
            values = sorted({"<NULL>" if r[place] is None else str(r[place]) for r in mine})
            if len(values) > 1:
                want[key, name] = (len(mine), len(values), values[:2])
    assert found == want and want


def test_names_and_multiplicity(spark):
    df = spark.createDataFrame([(x,) for x in ("Acme  Ltd", "ACME LTD", " acme ltd\t", "Other", "  ", None, "Other")], "name string")
    assert {r.metric: r.value for r in examples.name_effect(df, "name").collect()} == {"raw_names": 4, "normalised_names": 2, "revealed": 2, "groups_with_several": 1}
    assert {tuple(r) for r in examples.name_examples(df, "name").collect()} == {("ACME LTD", 3, x) for x in ("Acme  Ltd", "ACME LTD", "acme ltd")}
    assert {r.value for r in examples.name_effect(df.where("false"), "name").collect()} == {0}
    assert [tuple(r) for r in examples.multiplicity({"p": (df, "name"), "none": (df.where("false"), "name")}).collect()] == [("p", 5, 2, 1), ("none", 0, 0, 0)]


def test_pages(spark):
    buyers = spark.createDataFrame([("1", "North (A)", 5, 10.0), ("2", "north (a) east", 7, 10.0), ("3", None, 9, 99.0), ("4", "South", 1, None)], "buyer_key string, buyer_name string, award_count long, allocated_award_value double")
    page = pages.buyer_page(buyers, "NORTH (")
    assert tuple(page["totals"].first()) == (2, 12, 20.0)
    assert [r.buyer_key for r in page["largest"].collect()] == ["1", "2"] and [r.buyer_key for r in page["most_active"].collect()] == ["2", "1"]
    assert tuple(pages.buyer_page(buyers)["totals"].first()) == (4, 22, 119.0) and tuple(pages.buyer_page(buyers, "nobody")["totals"].first()) == (0, 0, 0.0)
    assert [r.buyer_key for r in pages.buyer_page(buyers, k=2)["largest"].collect()] == ["3", "1"]


def _header(spark, where):
    return {r.file.rsplit("/", 1)[1]: (r.encoding, r.header) for r in notices.discover_headers(spark, f"{where}/*.csv").collect()}


def test_headers_of_files_in_pieces(spark, tmp_path):
    """Files far over the limit of a piece, as files over 2 GB are with the limit's usual value: nothing holds a file whole."""
    long = 'a,"b\nstill b, and ""c""",d' + "\r\n"
    (tmp_path / "quoted.csv").write_bytes((long + '1,"two\nlines",3\n' * 20_000).encode())
    (tmp_path / "late.csv").write_bytes(("a,b\n" + "1,2\n" * 60_000).encode() + "é,2\n".encode("latin-1"))
    (tmp_path / "open.csv").write_bytes(b'a,"never closed\n1,2\n')
    (tmp_path / "marked.csv").write_bytes("﻿a,é\n1,2".encode())
    (tmp_path / "empty.csv").write_bytes(b"")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = _header(spark, tmp_path)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == {"quoted.csv": ("UTF-8", 'a,"b\nstill b, and ""c""",d'), "late.csv": ("ISO-8859-1", "a,b"), "open.csv": ("UTF-8", 'a,"never closed\n1,2'), "marked.csv": ("UTF-8", "a,é")}
    assert found == _header(spark, tmp_path)
    names = spark.createDataFrame([(found["quoted.csv"][1],), ("",), ('"x",,y',)], "header string").select(notices.header_fields(F.col("header"))).collect()
    assert [r[0] for r in names] == [["a", 'b\nstill b, and "c"', "d"], [""], ["x", "", "y"]]


def test_many_small_files_reach_the_driver_once_a_header(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"{k:03d}.csv").write_text(f"a,{'b' if k % 2 else 'c'}\n{k},x\n")
    df = notices.read_notices(spark, str(tmp_path / "*.csv"))
    assert df.columns == ["a", "b", "source_file", "c"] and df.agg(F.count("*"), F.sum(F.col("a").cast("int")), F.count("b")).first() == (300, 44850, 150)


def test_places_and_sums_need_one_shuffle(spark):
    rnd = random.Random(1)
    rows = [(k, Decimal(rnd.randrange(-10**30, 10**30)).scaleb(-2) if k % 11 else None) for k in range(3000)]
    df = spark.createDataFrame(rows, "k int, v decimal(36,2)").repartition(7)
    out = ranking.ranked(df, [F.desc_nulls_last("v"), F.asc("k")], "v")
    assert out.columns == ["k", "v", "rn", "running"]
    want = [(k, v, place) for place, (k, v) in enumerate(sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])), 1)]
    got, so_far = [tuple(r) for r in out.orderBy("rn").collect()], Decimal(0)
    assert [r[:3] for r in got] == want
    with decimal.localcontext(prec=38):
        for _, v, _, running in got:
            so_far += v or 0
            assert running == so_far
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert ranking.ranked(df.where("false"), [F.asc("k")], "v").count() == 0
