"""Places and exact quantiles over a whole table, without any task that holds it all."""

from __future__ import annotations

import decimal
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for written tables. Where none is set, a temporary one serves a session in one process, as in tests; elsewhere that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tendrel-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/tendrel"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that what partitions hold stays as it is."""
    path = f"{shared_folder(df.sparkSession)}/ranked-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _running(df: DataFrame, weight: str) -> DataFrame:
    """``df`` with _upto, the sum of ``weight`` over the rows of the partition up to each; nulls count as nothing. Sums of decimals and whole numbers are exact."""
    kind = df.select(F.sum(weight).alias("x")).schema["x"].dataType
    arrow = to_arrow_type(kind)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = 0
        for batch in batches:
            amounts, upto = batch.column(batch.schema.get_field_index(weight)).to_pylist(), []
            with decimal.localcontext(prec=38):
                for x in amounts:
                    so_far = so_far if x is None else so_far + x
                    upto.append(so_far)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto, arrow)], names=[*batch.schema.names, "_upto"])

    return df.mapInArrow(sums, StructType([*df.schema.fields, StructField("_upto", kind)]))


def ranked(df: DataFrame, order: Sequence[Column], weight: str | None = None) -> DataFrame:
    """``df`` with rn, each row's place in ``order`` from 1, and with ``weight`` also running, its sum up to the row.

    Rows are shuffled once, by ranges of the order, which should be a total one, so that equal leading values can be parted. Places and sums within a range are those of
    its sorted partition. One row a range, with its size, goes into one task and is broadcast: as many rows as ``spark.sql.shuffle.partitions``.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ranges = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    if weight:
        sorted_ranges = _running(sorted_ranges, weight)
    # partition in the upper bits, place in the partition in the lower 33
    dealt = settle(sorted_ranges.withColumn("_id", F.monotonically_increasing_id())).withColumns({"_range": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1})
    amount = F.max_by("_upto", "_place") if weight else F.lit(0)
    sizes = dealt.groupBy("_range").agg(F.max("_place").alias("_rows"), amount.alias("_sum"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_rows", "_sum")])
    out = dealt.join(F.broadcast(before), "_range").withColumn("rn", F.col("_rows_before") + F.col("_place"))
    if weight:
        out = out.withColumn("running", F.col("_sum_before") + F.col("_upto"))
    return out.select(*df.columns, "rn", *["running"] * bool(weight))


def quantiles(df: DataFrame, value: str, probabilities: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation of each key: keys, q25 for 0.25 and so on. Nulls take no part; without keys there is always one row."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_times"))
    placed = ranked(counted, [*[F.col(k).asc() for k in keys], F.col("_x").asc()], "_times")
    totals = placed.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.sum("_times").alias("_all"), F.min(F.col("running") - F.col("_times")).alias("_start"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    rows = placed.join(totals, same or F.lit(True), "inner")
    upto = F.col("running") - F.col("_start")
    at = lambda place: F.max(F.when((place < upto) & (place >= upto - F.col("_times")), F.col("_x")))
    found = []
    for p in probabilities:
        place = F.lit(float(p)) * (F.col("_all") - 1)
        low, share = at(F.floor(place)), F.max(place - F.floor(place))
        found.append((low + (at(F.ceil(place)) - low) * share).alias(f"q{round(p * 100)}"))
    return rows.groupBy(*keys).agg(*found)
