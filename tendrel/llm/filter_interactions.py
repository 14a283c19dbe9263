"""What filters remove by themselves and after each other, from a sparse matrix of documents and words.

Texts are counted in blocks, each with the words of its own in order. The words of all blocks are dealt by word and numbered where they meet, which is the
dictionary of the whole corpus, and the numbers go back to the blocks: every block becomes a CSR shard of the whole matrix, where each document begins, its word
numbers, their counts. Row sums are numbers of words, nonzero counts numbers of distinct words. With the flags of the other filters this gives one of 32 patterns
of failure a document; all 120 orders of filters are worked out from the number of documents by part and pattern, never from the documents.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, cut, input_rows, sized

FILTERS = "ABCDE"
MARKS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(65, 91))
TRAILING = bytes(range(0x80, 0xC0))  # bytes that continue a code point
#: Bytes of text after which a block ends; a single text may have more.
BLOCK_BYTES = 8 << 20


class _Block:
    """Documents of a block, their CSR arrays over the words of the block, and these words."""

    def __init__(self, number: int, id_type: pa.DataType):
        self.number, self.id_type = number, id_type
        self.words: dict[bytes, int] = {}
        self.bytes = 0
        self.rows: list[tuple] = []
        self.starts, self.columns, self.times = [0], [], []

    def add(self, doc_id, part, raw: bytes) -> None:
        counts = Counter(raw.split())  # of bytes: at ASCII white space
        number = self.words.setdefault
        self.columns.append(np.fromiter((number(w, len(self.words)) for w in counts), np.int32, len(counts)))
        self.times.append(np.fromiter(counts.values(), np.int32, len(counts)))
        self.starts.append(self.starts[-1] + len(counts))
        capitals = len(raw) - len(raw.translate(None, CAPITALS))
        points = len(raw.translate(None, TRAILING))
        self.rows.append((doc_id, part, hashlib.sha256(raw).digest(), 100 * capitals > 5 * points, MARKS.search(raw) is not None))
        self.bytes += len(raw)

    def batch(self) -> pa.RecordBatch:
        ids, parts, keys, capitals, marks = zip(*self.rows)
        rows = pa.StructArray.from_arrays(
            [pa.array(ids, self.id_type), pa.array(parts, pa.string()), pa.array(keys, pa.binary()), pa.array(capitals), pa.array(marks)],
            ["id", "part", "text_key", "c", "d"])
        words = list(self.words)
        order = sorted(range(len(words)), key=words.__getitem__)  # in order, words take less room on their way
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        starts = np.array(self.starts, np.int64)
        cells = np.repeat(np.arange(len(self.rows)), np.diff(starts)) * len(words) + place[np.concatenate(self.columns)]
        by_column = np.argsort(cells)  # within each document; where documents begin stays
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.number]), one(rows), one(pa.array([words[k] for k in order], pa.binary())),
             *[pa.array([x], pa.binary()) for x in (packed(starts), packed(cells[by_column]), zlib.compress(np.concatenate(self.times)[by_column].tobytes(), 1))]],
            ["block", "docs", "words", "starts", "cells", "times"])


def packed(rising: np.ndarray) -> bytes:
    """Whole numbers that rise, as their differences, in little room."""
    return zlib.compress(np.diff(rising, prepend=0).astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, block = TaskContext.get().partitionId() << 33, None
    for b in batches:
        for doc_id, part, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            block = block or _Block(number, b.schema.field(0).type)
            block.add(doc_id, part, text.as_py())
            if block.bytes >= BLOCK_BYTES or len(block.rows) >= 100_000:
                yield block.batch()
                number, block = number + 1, None
    if block:
        yield block.batch()


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, place, word) in order of word to (block, places, numbers), the words of a block together."""
    number, last, waiting, size = (TaskContext.get().partitionId() << 33) - 1, None, [], 0
    for b in batches:
        words = b.column(2)
        if b.num_rows:
            new = np.empty(b.num_rows, np.int64)
            new[0] = last is None or words[0].as_py() != last
            new[1:] = pc.not_equal(words.slice(1), words.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            numbers = number + np.cumsum(new)
            number, last = int(numbers[-1]), words[b.num_rows - 1].as_py()
            waiting.append((b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64), numbers))
            size += b.num_rows
            if size > 1_000_000:
                yield _by_block(waiting)
                waiting, size = [], 0
    if waiting:
        yield _by_block(waiting)


def _by_block(waiting: list) -> pa.RecordBatch:
    blocks, places, numbers = (np.concatenate(x) for x in zip(*waiting))
    order = np.lexsort((places, blocks))
    blocks, places, numbers = blocks[order], places[order], numbers[order]
    first = np.flatnonzero(np.diff(blocks, prepend=-1))
    upto = [*first[1:], len(blocks)]
    return pa.RecordBatch.from_arrays([
        pa.array(blocks[first]), pa.array([packed(places[a:b]) for a, b in zip(first, upto)], pa.binary()), pa.array([packed(numbers[a:b]) for a, b in zip(first, upto)], pa.binary()),
    ], ["block", "places", "numbers"])


def dictionary_numbers(words: DataFrame) -> DataFrame:
    """(block, place, word) to (block, places, numbers): equal words have equal numbers, others don't, whatever the block. Several rows a block, packed.

    Words are dealt by hash and sorted, and each task numbers those that it has, from a range of its own. Sorted, the numbers are the same if a task is repeated.
    """
    dealt = words.repartition("word").sortWithinPartitions("word").select("block", "place", "word")
    return dealt.mapInArrow(_numbered, "block long, places binary, numbers binary")


def csr_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The document-term matrix in shards: block, docs (id, part, text_key, c, d of each row), starts, columns, times.

    The last three are little-endian int64, int64 and int32 arrays as binaries: where each document begins, its words' numbers in ``dictionary_numbers``, how
    often each stands there. A null text is empty; a null part is an empty string; each row of ``docs`` is a row of the matrix, repeated ones too.
    """
    arrow_rows(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kind = dict(rows.dtypes)["id"]
    listed = f"array<struct<id: {kind}, part: string, text_key: binary, c: boolean, d: boolean>>"
    blocks = cut(rows.mapInArrow(_blocks, f"block long, docs {listed}, words array<binary>, starts binary, cells binary, times binary"), "blocks")
    words = blocks.select("block", F.posexplode("words").alias("place", "word"))
    numbers = dictionary_numbers(words).groupBy("block").agg(F.collect_list(F.struct("places", "numbers")).alias("found"))  # a row a task at most, but for large tasks

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                pieces = [(unpacked(x["places"]), unpacked(x["numbers"])) for x in b.column(4)[k].as_py() or ()]
                number = np.zeros(sum(len(places) for places, _ in pieces), np.int64)
                for places, found in pieces:
                    number[places] = found
                columns = unpacked(b.column(2)[k].as_py())
                columns = number[columns % len(number)] if len(columns) else columns
                new = [unpacked(b.column(1)[k].as_py()).tobytes(), columns.astype(np.int64).tobytes(), zlib.decompress(b.column(3)[k].as_py())]
                yield pa.RecordBatch.from_arrays([b.column(5).slice(k, 1), b.column(0).slice(k, 1), *[pa.array([x], pa.binary()) for x in new]], ["block", "docs", "starts", "columns", "times"])

    joined = blocks.drop("words").join(numbers, "block", "left").select("docs", "starts", "cells", "times", "found", "block")
    return joined.mapInArrow(encoded, f"block long, docs {listed}, starts binary, columns binary, times binary")


def document_flags(shards: DataFrame, least_words: int = 50, least_distinct: int = 65) -> DataFrame:
    """A row for each document: id, part, text_key, n_words, n_distinct, a, b, c, d (whether it fails the filter)."""
    kind = next(f.dataType.elementType["id"].dataType.simpleString() for f in shards.schema if f.name == "docs")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                docs = batch.column(0)[k].values
                starts = np.frombuffer(batch.column(1)[k].as_py(), np.int64)
                upto = np.zeros(starts[-1] + 1, np.int64)
                np.cumsum(np.frombuffer(batch.column(2)[k].as_py(), np.int32), out=upto[1:])
                words, distinct = upto[starts[1:]] - upto[starts[:-1]], np.diff(starts)
                id_, part, key, c, d = docs.flatten()
                yield pa.RecordBatch.from_arrays(
                    [id_, part, key, pa.array(words), pa.array(distinct), pa.array(words < least_words), pa.array(100 * distinct < least_distinct * words), c, d],
                    ["id", "part", "text_key", "n_words", "n_distinct", "a", "b", "c", "d"])

    return shards.select("docs", "starts", "times").mapInArrow(sums, f"id {kind}, part string, text_key binary, n_words long, n_distinct long, a boolean, b boolean, c boolean, d boolean")


def filter_interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: a row for each part, order of the filters and step.

    Each row of ``docs`` is a document, repeated ones too. A row whose id isn't below that of an equal text passes E; a null id never fails it and makes none
    fail. ``labels`` has the id, quality and toxic; an id with several rows is good or toxic if any says so, one without is neither. Documents without rows
    give none.
    """
    flags = cut(document_flags(csr_shards(docs, id_col, text_col, part_col)), "flags")
    copies = cut(flags.groupBy("text_key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("text_key", "first"), "copies")
    known = labels.select(F.col(id_col).alias("id"), "quality", "toxic").where("id IS NOT NULL").groupBy("id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("bad"))
    known = cut(known.where("good OR bad"), "labels")
    judged = flags.join(sized(copies, 300_000), "text_key", "left").join(sized(known, 300_000), "id", "left").select(
        "part", "a", "b", "c", "d", F.coalesce(F.col("id") > F.col("first"), F.lit(False)).alias("e"),
        F.coalesce("good", F.lit(False)).cast("int").alias("good"), F.coalesce("bad", F.lit(False)).cast("int").alias("bad"))
    pattern = sum((F.col(x).cast("int") * (1 << k) for k, x in enumerate("abcde")), F.lit(0))
    by_pattern = judged.groupBy("part", pattern.alias("pattern")).agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    of = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("pattern") == k, F.col(c))), F.lit(0)) for k in range(32)]).alias(c)
    parts = by_pattern.groupBy("part").agg(of("n"), of("good"), of("bad"))

    orders = F.array(*[F.lit("".join(o)) for o in itertools.permutations(FILTERS)])
    steps = parts.withColumn("filter_order", F.explode(orders)).select("*", F.posexplode(F.split("filter_order", "")).alias("before", "letter")).where("letter <> ''")
    bit = lambda c: F.expr(f"shiftleft(1, ascii({c}) - 65)")
    steps = steps.withColumn("own", bit("letter")).withColumn(
        "earlier", F.expr("aggregate(transform(sequence(0, 4), i -> CASE WHEN i < before THEN shiftleft(1, ascii(substring(filter_order, i + 1, 1)) - 65) ELSE 0 END), 0, (s, x) -> s | x)"))
    total = lambda c, where: F.expr(f"aggregate(filter(sequence(0, 31), k -> {where}), CAST(0 AS BIGINT), (s, k) -> s + {c}[k])")
    now = "(k & own) <> 0 AND (k & earlier) = 0"
    out = steps.select(
        "part", "filter_order", (F.col("before") + 1).alias("step"), "letter", total("n", "(k & (own | earlier)) = 0").alias("kept"), total("n", now).alias("removed"),
        total("n", "(k & own) <> 0 AND (k & earlier) <> 0").alias("redundant"), total("n", "k = own").alias("unique_fails"), total("good", now).alias("good_lost"),
        total("bad", now).alias("toxic_lost"))
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all orders over all documents, by source."""
    return filter_interactions(input_rows(spark, sf_dir).select("doc_id", "source", "text"), input_rows(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
m AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, coalesce(max(CASE WHEN quality = 1 THEN 1 ELSE 0 END), 0) AS good, coalesce(max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 0) AS bad FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(l.good, 0) AS good, coalesce(l.bad, 0) AS bad,
    (CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 5 * length(d.t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN d.doc_id > m.first THEN 'E' ELSE '' END) AS fails
  FROM d JOIN m ON d.t = m.t LEFT JOIN l ON d.doc_id = l.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a JOIN x b ON b.c <> a.c JOIN x c ON c.c NOT IN (a.c, b.c) JOIN x d ON d.c NOT IN (a.c, b.c, c.c) JOIN x e ON e.c NOT IN (a.c, b.c, c.c, d.c)),
s AS (SELECT filter_order, i::INTEGER AS step, filter_order[i] AS own, filter_order[1:i - 1] AS earlier FROM o, (SELECT unnest(range(1, 6)) AS i)),
r AS (SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (WHERE NOT contains(fails, own) AND (earlier = '' OR translate(fails, earlier, '') = fails)), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE contains(fails, own) AND (earlier = '' OR translate(fails, earlier, '') = fails)), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE contains(fails, own) AND earlier <> '' AND translate(fails, earlier, '') <> fails), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE fails = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE contains(fails, own) AND (earlier = '' OR translate(fails, earlier, '') = fails)), 0)::BIGINT AS good_lost,
    coalesce(sum(bad) FILTER (WHERE contains(fails, own) AND (earlier = '' OR translate(fails, earlier, '') = fails)), 0)::BIGINT AS toxic_lost
  FROM g, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
