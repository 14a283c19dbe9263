"""Incremental ingest of award versions: each file once, copies dropped, versions kept right even for late releases.

The table is a folder of deltas. A batch writes one delta, under a name of its own: the rows that are new, as they are, and for every award that they touch its
version numbers anew. A small text file names the deltas that count, in order; it is written under a new number that only one writer can take, so that a batch
shows whole or not at all, as far as the file system's rename is atomic. What a crash leaves behind no pointer names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from tendrel.functions.columns import hash_key
from tendrel.operators.relational import version_columns

KEYS = ("award_id", "release_id")
LINEAGE = "source_file"
_NUMBERS = ("version_number", "version_count", "is_latest")


class DeltaTable:
    """Deltas under ``path``: rows-<id> and numbers-<id>, and pointers/<n>.json with the ids that count after n batches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def pointer(self) -> tuple[int, dict]:
        """The number of the newest pointer and what it says; 0 and no deltas if there is none."""
        folder = self._Path(f"{self.path}/pointers")
        if not self.fs.exists(folder):
            return 0, {"deltas": [], "batches": []}
        found = [int(f.getPath().getName().split(".")[0]) for f in self.fs.listStatus(folder) if f.getPath().getName().endswith(".json")]
        if not found:
            return 0, {"deltas": [], "batches": []}
        text = self.spark.read.text(f"{self.path}/pointers/{max(found)}.json", wholetext=True).first()[0]
        return max(found), json.loads(text)

    def advance(self, number: int, said: dict) -> bool:
        """Make ``said`` the pointer after ``number``. False if another writer has taken that place: the file is written aside and renamed, which fails if the
        name is there."""
        aside, target = self._Path(f"{self.path}/pointers/.{uuid.uuid4().hex}"), self._Path(f"{self.path}/pointers/{number + 1}.json")
        out = self.fs.create(aside, False)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        if self.fs.exists(target):
            self.fs.delete(aside, False)
            return False
        return bool(self.fs.rename(aside, target))

    def rows(self, said: dict) -> DataFrame | None:
        """The rows of all deltas, without numbers; None for a table without deltas."""
        return self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/rows-{d}" for d in said["deltas"]]) if said["deltas"] else None

    def read(self, said: dict | None = None) -> DataFrame | None:
        """The rows with their version columns as the pointer has them; None for a table without deltas. The newest numbers of a row count."""
        said = said or self.pointer()[1]
        rows = self.rows(said)
        if rows is None:
            return None
        parts = [self.spark.read.parquet(f"{self.path}/numbers-{d}").withColumn("_age", F.lit(k)) for k, d in enumerate(said["deltas"])]
        numbers = parts[0]
        for part in parts[1:]:
            numbers = numbers.unionByName(part)
        # the hash is of all content, award_id too, so it is the whole key
        newest = numbers.groupBy("_sig").agg(F.max_by(F.struct(*_NUMBERS), "_age").alias("_n")).select("_sig", "_n.*")
        return rows.join(newest, "_sig").select(*rows.columns, *_NUMBERS)

    def compact(self) -> None:
        """All deltas as one. Takes its place by a pointer like any batch; does nothing if a batch came in between."""
        number, said = self.pointer()
        whole = self.read(said)
        if whole is None or len(said["deltas"]) < 2:
            return
        delta = uuid.uuid4().hex
        whole.drop(*_NUMBERS).write.parquet(f"{self.path}/rows-{delta}")
        whole.select("award_id", "_sig", *_NUMBERS).write.parquet(f"{self.path}/numbers-{delta}")
        self.advance(number, {"deltas": [delta], "batches": said["batches"]})


def _numbered(rows: DataFrame) -> DataFrame:
    order = [F.col("release_date").asc_nulls_first(), F.col("release_id").asc_nulls_first(), F.col("_sig")]
    return version_columns(rows, "award_id", order)


def upsert_versions(spark: SparkSession, batch: DataFrame, path: str, batch_id: int | None = None, tries: int = 10) -> None:
    """Add a batch of award versions to the table at ``path``. Rows that are there, equal in all but source_file, add nothing.

    Bytes written follow the batch: its new rows, and three numbers for each version of the awards that it touches. A batch with the number of one that is in the
    table (a stream that was restarted) is left out. If another writer is first, the numbers are worked out again over what it wrote.
    """
    table = DeltaTable(spark, path)
    content = [c for c in batch.columns if c != LINEAGE]
    sig, before = hash_key([F.col(c) for c in content]), table.rows(table.pointer()[1])
    if before is None or before.schema["_sig"].dataType == BinaryType():  # half as long as text, which tables begun with texts keep
        sig = F.unhex(sig)
    signed = batch.withColumn("_sig", sig)
    place = F.struct(F.col(LINEAGE).isNull(), F.col(LINEAGE)) if LINEAGE in batch.columns else F.lit(0)
    once = signed.groupBy("_sig").agg(F.min_by(F.struct(*batch.columns), place).alias("_row")).select("_row.*", "_sig")
    for _ in range(tries):
        number, said = table.pointer()
        if batch_id is not None and batch_id in said["batches"]:
            return
        delta, old, new = uuid.uuid4().hex, table.rows(said), once
        if old is not None:  # the batch is worked out once, where its hashes meet those that are there
            new = once.join(old.select("_sig"), "_sig", "left_anti").select(*once.columns)
        new.write.parquet(f"{table.path}/rows-{delta}")
        added = spark.read.schema(once.schema).parquet(f"{table.path}/rows-{delta}").select("award_id", "_sig", "release_date", "release_id")
        every = added
        if old is not None:  # awards with new rows only
            o, t = old.select(*added.columns).alias("o"), added.select("award_id").distinct().alias("t")
            every = o.join(t, F.col("o.award_id").eqNullSafe(F.col("t.award_id")), "left_semi").unionByName(added)
        _numbered(every).select("award_id", "_sig", *_NUMBERS).write.parquet(f"{table.path}/numbers-{delta}")
        if table.advance(number, {"deltas": [*said["deltas"], delta], "batches": [*said["batches"], *([batch_id] if batch_id is not None else [])]}):
            return
    raise RuntimeError(f"other writers were first {tries} times")


def read_versions(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path`` as its newest pointer has it, with version_number, version_count and is_latest."""
    found = DeltaTable(spark, path).read()
    return None if found is None else found.drop("_sig")


def ingest_stream(spark: SparkSession, source: str, schema: StructType, table: str, checkpoint: str):
    """A stream over CSV files in ``source`` that takes what is there and stops; run again, it takes only new files, and a batch that was cut off once."""
    rows = spark.readStream.schema(schema).option("header", True).csv(source)
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, n: upsert_versions(spark, batch, table, n)).start()


def bounded_ingest(rows: DataFrame, late: str = "30 days") -> DataFrame:
    """Copies dropped with state for ``late`` only; rows later than that are dropped by the watermark."""
    return rows.withWatermark("release_date", late).dropDuplicatesWithinWatermark(list(KEYS))
