"""Nearest neighbours by multiprobe p-stable hashing.

Inner products become distances by one more coordinate (the square root of what a vector's norm lacks of the largest). Each table hashes a vector by several
random projections, shifted and cut into steps; a query visits its own bucket and those next to it, in the order of the chance that a near vector fell
there, which is estimated from how far its projections lie from the edges. All buckets of all tables are compared with the queries that visit them, in
blocks, exactly and in double precision; the best of each bucket are merged.

Buckets are parted by hash of the vector's id into as many parts as the table's size asks for, so neither a crowded bucket nor many copies of a vector go
to one task. A query that finds fewer neighbours than wanted is compared with all rows, in blocks of the same kind.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, cut, input_rows

TABLES, HASHES, STEP, PROBES = 4, 4, 2.0, 10
#: Rows of the table for each part of a bucket.
PART = 50_000


def probe_sets(edges: np.ndarray, n: int) -> list[list[tuple[int, int]]]:
    """The ``n`` likeliest perturbations of a bucket, the bucket itself first: lists of (projection, -1 or +1).

    ``edges`` has for each projection the squared distance to its lower and upper edge. Sets of perturbed projections come by the sum of these distances: from
    each set, in sorted order, its last element is moved on, or the next one is added.
    """
    order = np.argsort(edges, axis=None, kind="stable")
    z = edges.ravel()[order]
    out: list[list[tuple[int, int]]] = [[]]
    heap = [(z[0], (0,))]
    while heap and len(out) < n:
        total, chosen = heapq.heappop(heap)
        moves = [(int(order[c]) // 2, 1 if order[c] % 2 else -1) for c in chosen]
        if len({m[0] for m in moves}) == len(moves):
            out.append(moves)
        last = chosen[-1]
        if last + 1 < len(z):
            heapq.heappush(heap, (total - z[last] + z[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + z[last + 1], (*chosen, last + 1)))
    return out


class Hashes:
    """p-stable (normal) projections of vectors of ``width`` coordinates, one more being added to each."""

    def __init__(self, width: int, largest: float, tables: int, hashes: int, step: float, seed: int):
        rng = np.random.default_rng(seed)
        self.largest, self.step = largest, step * largest
        self.by = rng.normal(size=(tables, width + 1, hashes))
        self.shift = rng.uniform(0, 1, (tables, 1, hashes))

    def places(self, v: np.ndarray, query: bool) -> np.ndarray:
        """(table, vector, projection) in steps. A query is scaled to the largest norm, which leaves the order of its neighbours as it is."""
        norm2 = (v * v).sum(1)
        if query:
            v = v * (self.largest / np.sqrt(norm2))[:, None]
            more = np.zeros(len(v))
        else:
            more = np.sqrt(np.maximum(self.largest**2 - norm2, 0))
        full = np.concatenate([v, more[:, None]], axis=1)
        return np.stack([full @ m for m in self.by]) / self.step + self.shift


def _bucket(cells: np.ndarray) -> list[str]:
    return [",".join(map(str, c)) for c in cells.tolist()]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)


def _indexed(hashes: Hashes, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(1))
            cells = np.floor(hashes.places(v, False)).astype(np.int64)
            data = pa.array([x.tobytes() for x in v], pa.binary())
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), pa.array(_bucket(cells[t])), b.column(0), data], names=["_table", "_bucket", "_id", "_v"])

    return run


def _probed(hashes: Hashes, tables: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(1))
            at = hashes.places(v, True)
            cells = np.floor(at).astype(np.int64)
            inside = at - cells
            table, row, bucket = [], [], []
            for t in range(tables):
                for i in range(len(v)):
                    for moves in probe_sets(np.stack([inside[t, i] ** 2, (1 - inside[t, i]) ** 2], axis=1), probes):
                        cell = cells[t, i].copy()
                        for k, by in moves:
                            cell[k] += by
                        table.append(t)
                        row.append(i)
                        bucket.append(cell)
            data = pa.array([x.tobytes() for x in v], pa.binary())
            rows = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(table, pa.int32()), pa.array(_bucket(np.array(bucket).reshape(len(row), -1))), b.column(0).take(rows), data.take(rows)], names=["_table", "_bucket", "_query", "_q"])

    return run


def nearest(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of the ``k`` largest inner products of each query, ties to the smaller id, itself left out.

    A block product finds what may be among them, with a margin for its rounding; the scores of these are then summed in one fixed order each, so that equal
    vectors tie exactly.
    """
    out: tuple[list, list, list] = ([], [], [])
    step = max(1, 4_000_000 // max(1, len(ids)))
    for lo in range(0, len(query_ids), step):
        s = queries[lo : lo + step] @ vectors.T
        s[query_ids[lo : lo + step, None] == ids[None, :]] = -np.inf
        if len(ids) > k:
            least = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
        else:
            least = np.full(len(s), -np.finfo(float).max)
        for i in range(len(s)):
            some = np.flatnonzero(s[i] >= least[i] - 1e-9 * (1 + abs(least[i]))) if np.isfinite(least[i]) and len(ids) > k else np.flatnonzero(s[i] > -np.inf)
            score = (vectors[some] * queries[lo + i]).sum(axis=1)
            best = np.lexsort((ids[some], -score))[:k]
            out[0].append(np.full(len(best), query_ids[lo + i]))
            out[1].append(ids[some][best])
            out[2].append(score[best])
    return tuple(np.concatenate(x) if x else np.zeros(0, d) for x, d in zip(out, (np.int64, np.int64, np.float64)))  # type: ignore[return-value]


def _compared(k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        queries = queries.drop_duplicates("_query")
        v, q = (np.frombuffer(b"".join(x), np.float64).reshape(len(x), -1) for x in (vectors["_v"], queries["_q"]))
        a, b, s = nearest(q, queries["_query"].to_numpy(np.int64), v, vectors["_id"].to_numpy(np.int64), k)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    return run


FOUND = "query_id long, vec_id long, score double"


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, hashes: int = HASHES, step: float = STEP, probes: int = PROBES, seed: int = 7) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest that each query finds, by inner product, ties to the smaller id.

    Queries are the rows for which ``is_query`` holds, candidates all rows but the query's own. Null or empty vectors, zero ones, ones with null or non-finite
    components, ones of another length than most, and rows without an id take no part. Of rows that repeat an id one counts, the least vector.
    """
    spark = vectors.sparkSession
    arrow_rows(spark)
    v = F.col(vector_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.coalesce(good, F.lit(False))).groupBy(F.col(id_col).cast("long").alias("_id")).agg(
        F.min(v).alias("_v"), F.bool_or(is_query).alias("_is_query"))
    rows = cut(rows.withColumn("_n2", F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x)), "vectors")
    widths = rows.groupBy(F.size("_v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, n = widths[0]
    rows = rows.where(F.size("_v") == width)
    largest = float(np.sqrt(rows.agg(F.max("_n2")).first()[0]))
    by = Hashes(width, largest, tables, hashes, step, seed)
    parts = max(1, round(n / PART))
    queries = rows.where("_is_query").select("_id", "_v")
    part = F.pmod(F.xxhash64("_id"), F.lit(parts)).cast("int").alias("_part")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part")
    index = rows.select("_id", "_v").mapInArrow(_indexed(by, tables), "_table int, _bucket string, _id long, _v binary").select("*", part)
    visits = queries.mapInArrow(_probed(by, tables, probes), "_table int, _bucket string, _query long, _q binary").select("*", every)
    keys = ["_table", "_bucket", "_part"]
    met = index.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(_compared(k), FOUND)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda found: found.distinct().select("*", F.row_number().over(rank).alias("rank")).where(F.col("rank") <= k)
    found = cut(best(met), "neighbours")
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, n - 1)).select(F.col("query_id").alias("_id"))
    short = cut(queries.join(full, "_id", "left_anti"), "short")
    as_bytes = lambda df, name: df.mapInArrow(_raw, "_id long, _v binary").withColumnsRenamed(name)
    exact = as_bytes(rows.select("_id", "_v"), {}).select("*", part).groupBy("_part").cogroup(
        as_bytes(short, {"_id": "_query", "_v": "_q"}).select("*", every).groupBy("_part")).applyInPandas(_compared(k), FOUND) if not short.isEmpty() else None
    out = found.join(short, found["query_id"] == short["_id"], "left_anti")
    if exact is not None:
        out = out.unionByName(best(exact))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in _matrix(b.column(1))], pa.binary())], names=["_id", "_v"])


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(input_rows(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
