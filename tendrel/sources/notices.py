"""Ragged notice files: one release a row, nesting flattened into column names such as releases/0/awards/1/suppliers/0/name."""

from __future__ import annotations

import re
from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendrel.functions.columns import blank_to_null, safe_ratio, to_number, to_utc, whole_days, year_month
from tendrel.operators.ranking import settle
from tendrel.operators.relational import keep_one, presence_flags

RELEASE = "releases/0/"
# Logical name of each release field, and the paths under a release that may hold it.
RELEASE_FIELDS = {
    "ocid": ("ocid",), "release_id": ("id",), "release_date": ("date",), "release_tag": ("tag/0",), "tender_title": ("tender/title",), "tender_status": ("tender/status",),
    "tender_value": ("tender/value/amount",), "tender_currency": ("tender/value/currency",), "procurement_method": ("tender/procurementMethod",), "procurement_category": ("tender/mainProcurementCategory",),
    "buyer_id": ("buyer/id",), "buyer_name": ("buyer/name",), "cpv_code": ("tender/classification/id",), "sme_suitability": ("tender/suitability/sme", "tender/smeFriendly"),
    "vcse_suitability": ("tender/suitability/vcse", "tender/hasElectronicAuction"),
}
AWARD_FIELDS = {"award_id": "id", "award_status": "status", "award_date": "date", "award_value": "value/amount", "award_currency": "value/currency", "award_title": "title",
                "contract_start": "contractPeriod/startDate", "contract_end": "contractPeriod/endDate"}


def _csv(spark: SparkSession, paths: list[str] | str, encoding: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(paths)


def _lines(spark: SparkSession, glob: str) -> DataFrame:
    """file, place, line and whether its quotes are odd. Lines keep their bytes: a newline is never part of a longer character, so files may be cut anywhere between them.
    A place is the start of the piece of the file and the order within it."""
    line = F.col("value")
    odd = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(glob).select(F.col("_metadata.file_path").alias("file"), place.alias("place"), line.alias("line"), odd.alias("odd"))


def discover_headers(spark: SparkSession, glob: str) -> DataFrame:
    """file, encoding, header of each file that has a line: its first record, as UTF-8 if all of its lines are that, else as Latin-1. Raises if there is no file.

    Files are read in pieces, line by line, and only one line a file and task is shuffled. A first line with an odd number of quotes goes on until the next such line;
    only files that begin so are read again. Where there is none, the whole file is the header.
    """
    first = lambda c: F.min_by(c, "place")
    files = _lines(spark, glob).groupBy("file").agg(F.bool_and(F.is_valid_utf8("line")).alias("utf8"), first("line").alias("head"), first("odd").alias("goes_on"))
    files = settle(files)
    if files.isEmpty():
        raise FileNotFoundError(glob)
    whole, broken = files.where("NOT goes_on"), files.where("goes_on")
    if not broken.isEmpty():
        lines = settle(_lines(spark, glob).join(broken.select("file"), "file"))  # written, as places hold for one reading only
        begins = lines.groupBy("file").agg(F.min("place").alias("start"))
        ends = lines.join(begins, "file").where("odd AND place > start").groupBy("file", "start").agg(F.min("place").alias("end"))
        inside = lines.join(begins.join(ends.select("file", "end"), "file", "left"), "file").where("place <= end OR end IS NULL")
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
        whole = whole.unionByName(inside.groupBy("file").agg(text.alias("head")).join(broken.drop("head"), "file"))
    text = F.when(F.col("utf8"), F.col("head")).otherwise(F.decode(F.col("head").cast("binary"), "ISO-8859-1"))
    return whole.select("file", F.when(F.col("utf8"), "UTF-8").otherwise("ISO-8859-1").alias("encoding"), F.regexp_replace(text, "^\ufeff", "").alias("header"))


def read_notices(spark: SparkSession, glob: str) -> DataFrame:
    """All files under one set of columns, with source_file. Files of one header and encoding are read together; the number of distinct headers bounds the plan,
    and a header reaches the driver once, with the names of its files."""
    groups = discover_headers(spark, glob).groupBy("header", "encoding").agg(F.sort_array(F.collect_list("file")).alias("files"))
    parts = [_csv(spark, r.files, r.encoding).withColumn("source_file", F.col("_metadata.file_name")) for r in sorted(groups.collect(), key=lambda r: (r.header, r.encoding))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def array_positions(columns: list[str]) -> dict[int, list[int]]:
    """Award positions, and the supplier positions of each, from the column names."""
    found: dict[int, set[int]] = defaultdict(set)
    for c in columns:
        if m := re.match(rf"{RELEASE}awards/(\d+)/(?:suppliers/(\d+)/)?", c):
            found[int(m[1])].update([int(m[2])] if m[2] else [])
    return {i: sorted(js) for i, js in sorted(found.items())}


def _at(df: DataFrame, *paths: str):
    """The first of the paths that has something in it."""
    there = [blank_to_null(F.col(f"`{p}`")) for p in paths if p in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def extract_releases(df: DataFrame) -> DataFrame:
    out = df.select(*[_at(df, *[RELEASE + p for p in paths]).alias(name) for name, paths in RELEASE_FIELDS.items()], "source_file")
    return out.where("ocid IS NOT NULL").withColumns({"release_date": to_utc(F.col("release_date")), "tender_value": to_number(F.col("tender_value"))})


def explode_awards(df: DataFrame) -> DataFrame:
    """A row for each award that has an id; its place is award_index."""
    keys = [_at(df, RELEASE + "ocid").alias("ocid"), _at(df, RELEASE + "id").alias("release_id"), to_utc(_at(df, RELEASE + "date")).alias("release_date"), F.col("source_file")]
    places = [F.struct(F.lit(i).alias("award_index"), *[_at(df, f"{RELEASE}awards/{i}/{p}").alias(n) for n, p in AWARD_FIELDS.items()]) for i in array_positions(df.columns)]
    if not places:
        places = [F.struct(F.lit(0).alias("award_index"), *[F.lit(None).cast("string").alias(n) for n in AWARD_FIELDS])]
    out = df.select(*keys, F.explode(F.array(*places)).alias("a")).select(*[k for k in ("ocid", "release_id", "release_date", "source_file")], "a.*").where("award_id IS NOT NULL AND ocid IS NOT NULL")
    return out.withColumns({"award_value": to_number(F.col("award_value"))} | {c: to_utc(F.col(c)) for c in ("award_date", "contract_start", "contract_end")})


def explode_suppliers(df: DataFrame) -> DataFrame:
    """A row for each supplier of an award that has an id or a name."""
    places = [F.struct(F.lit(i).alias("award_index"), F.lit(j).alias("supplier_index"), _at(df, f"{RELEASE}awards/{i}/id").alias("award_id"), *[_at(df, f"{RELEASE}awards/{i}/suppliers/{j}/{p}").alias(f"supplier_{p}") for p in ("id", "name")])
              for i, js in array_positions(df.columns).items() for j in js]
    if not places:
        places = [F.struct(F.lit(0).alias("award_index"), F.lit(0).alias("supplier_index"), *[F.lit(None).cast("string").alias(n) for n in ("award_id", "supplier_id", "supplier_name")])]
    return df.select(_at(df, RELEASE + "ocid").alias("ocid"), _at(df, RELEASE + "id").alias("release_id"), "source_file", F.explode(F.array(*places)).alias("s")).select("ocid", "release_id", "source_file", "s.*").where("award_id IS NOT NULL AND (supplier_id IS NOT NULL OR supplier_name IS NOT NULL)")


def header_fields(header):
    """The names in a header, quotes taken off; a comma or a line break within quotes is part of the name."""
    fields = F.regexp_extract_all(header, F.lit(r'(?:^|,)("(?:[^"]++|"")*+"|[^,]*+)'), F.lit(1))
    return F.transform(fields, lambda x: F.when(x.startswith('"'), F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x))


def schema_complexity(headers: DataFrame) -> DataFrame:
    """Files by number of award positions, and by the largest supplier position of any award."""
    names = F.explode(header_fields(F.col("header")))
    found = headers.select("file", names.alias("c")).select("file", F.regexp_extract("c", r"awards/(\d+)/", 1).try_cast("int").alias("i"), F.regexp_extract("c", r"suppliers/(\d+)/", 1).try_cast("int").alias("j"))
    per_file = found.groupBy("file").agg(F.countDistinct("i").alias("awards"), (F.max("j") + 1).alias("suppliers"))
    return per_file.groupBy("awards", "suppliers").agg(F.count("*").alias("files"))


def normalise(df: DataFrame, year: int) -> dict[str, DataFrame]:
    """releases, awards and award_suppliers of one calendar year: exact copies go, children follow their releases."""
    releases = extract_releases(df).where((F.col("release_date") >= F.lit(f"{year}-01-01").cast("timestamp")) & (F.col("release_date") < F.lit(f"{year + 1}-01-01").cast("timestamp"))).dropDuplicates()
    own = releases.select("release_id").distinct()
    return {"releases": releases} | {name: f(df).join(own, "release_id", "left_semi").dropDuplicates() for name, f in (("awards", explode_awards), ("award_suppliers", explode_suppliers))}


def unpivot_indexed(df: DataFrame, prefix: str, fields: dict[str, str], keys: list[str]) -> DataFrame:
    """Columns such as prefix/3/path to one row for each position that has anything in it: keys, position, fields."""
    places = sorted({int(m[1]) for c in df.columns if (m := re.match(rf"{re.escape(prefix)}/(\d+)/", c))})
    kinds = [F.struct(F.lit(i).alias("position"), *[_at(df, f"{prefix}/{i}/{p}").alias(n) for n, p in fields.items()]) for i in places or [0]]
    return df.select(*keys, F.inline(F.array(*kinds))).where(F.coalesce(*[F.col(n) for n in fields]).isNotNull())


def clean_records(df: DataFrame) -> DataFrame:
    """One wide record a procurement: its first award and supplier, parsed and trimmed, with dates taken apart, spans, ratio and flags. Of several rows of one ocid the latest stays."""
    paths = {n: [RELEASE + p for p in ps] for n, ps in RELEASE_FIELDS.items()} | {n: [f"{RELEASE}awards/0/{p}"] for n, p in AWARD_FIELDS.items()}
    paths |= {f"supplier_{p}": [f"{RELEASE}awards/0/suppliers/0/{p}"] for p in ("id", "name")}
    out = df.select(*[_at(df, *ps).alias(n) for n, ps in paths.items()], "source_file").where("ocid IS NOT NULL")
    out = out.withColumns({c: to_utc(F.col(c)) for c in ("release_date", "award_date", "contract_start", "contract_end")} | {c: to_number(F.col(c)) for c in ("tender_value", "award_value")})
    out = out.withColumns(year_month(F.col("release_date")) | {"contract_duration_days": whole_days(F.col("contract_start"), F.col("contract_end")), "tender_to_award_days": whole_days(F.col("release_date"), F.col("award_date")), "award_to_tender_ratio": safe_ratio(F.col("award_value"), F.col("tender_value"))})
    out = presence_flags(out, {"has_award": ["award_id"], "has_supplier": ["supplier_name"], "has_contract_dates": ["contract_start", "contract_end"], "has_award_value": ["award_value"]})
    return keep_one(out, ["ocid"], [F.desc_nulls_last("release_date"), *[F.asc_nulls_last(c) for c in out.columns if c not in ("ocid", "release_date")]])
