"""Helpers that several text operators share."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: For bytes.translate: A-Z lower-cased, all else as it is.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bytes of rows that go to Python at once; a single row may have more.
ARROW_BYTES = 4 << 20


def arrow_rows(spark: SparkSession) -> None:
    """Bound Arrow batches by their bytes, so that many short texts go to Python together and long ones alone. All operators set the same bound."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one if all run in one process, as in tests; otherwise an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tendrel-")  # one machine, as in tests
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: it is computed once, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tendrel/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(table: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """A written table of a few numbers a row, for a join with texts: broadcast if it has ``rows`` rows at most, so that the texts stay where they are; a larger
    one is left to a shuffled join."""
    return F.broadcast(table) if table.count() <= rows else table


def worker_state() -> dict:
    """What a Python worker keeps from task to task: models and caches by name."""
    return vars(sys.modules.setdefault("_tendrel_worker", types.ModuleType("_tendrel_worker")))


def input_rows(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def added(columns: list[str], *names: str) -> list[str]:
    """``names`` for columns that come on top of ``columns``: one that is taken, in whatever case, gets underscores at its end until it is new."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_key(c: Column) -> Column:
    """Tells apart rows that share an id; identical rows get the same results anyway."""
    return F.xxhash64(c)


def flat_text(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the len+1 offsets between them. Null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words ``[^\\x20\\x09-\\x0D]+``, and the index of each text's first word (len+1)."""
    ink = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    n = len(raw)
    starts, ends = ink.copy(), ink.copy()
    if n:
        starts[1:] &= ~ink[:-1]
        ends[:-1] &= ~ink[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        starts[inner] = ink[inner]
        ends[inner - 1] = ink[inner - 1]
    at = np.flatnonzero(starts)
    return at, np.flatnonzero(ends) + 1, np.searchsorted(at, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit words, from prefix sums of a polynomial modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15 | 1
    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    def __init__(self, values: np.ndarray):
        n = len(values)
        cls = type(self)
        if len(cls._up) < n + 1:
            size = max(n + 1, 1 << 16)
            up, down = np.full(size, cls.BASE, np.uint64), np.full(size, pow(cls.BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            cls._up, cls._down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * cls._up[:n], out=self.sums[1:], dtype=np.uint64)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * type(self)._down[starts] + (ends - starts).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """The hash of each stretch of ``k`` values."""
        n = max(0, len(self.sums) - k)
        return mixed((self.sums[k:] - self.sums[:n]) * type(self)._down[:n] + np.uint64(k))


#: A random 64-bit word for each byte value.
BYTE_WORDS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
