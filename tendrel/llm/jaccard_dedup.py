"""Near copies by word shingles: MinHash bands propose, exact Jaccard decides.

Equal shingle sets are one entry. Entries meet under bands of MinHash values: with 24 bands of 4 values two sets of similarity 0.8 miss each other with
probability (1 - 0.8**4)**24, about 3 in a million. Buckets with the same members are looked at once. First every member of a bucket is held against one of
them, so that a large group of near copies costs one pair a member; only buckets that are still in several components then have their pairs compared
across these, in a task, or block by block where a bucket has many members. A link is made only if the exact similarity of the sets reaches the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_WORDS, Rolling, arrow_rows, cut, flat_text, mixed, sized, text_key, word_bounds
from .components import components
from .routing import chunks, whole_groups

SHINGLE, LIMIT = 5, 0.8
BANDS, ROWS = 24, 4
#: Members of a bucket that a task compares; a bucket with more goes by pairs of blocks.
CROWD = 1000

_SEEDS = mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the shingles of each text (ASCII lower case), and the len+1 offsets between texts. A text of fewer words is one shingle."""
    raw, offsets = flat_text(texts)
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    starts, ends, firsts = word_bounds(raw, offsets)
    n_words = np.diff(firsts)
    n = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    text = np.repeat(np.arange(len(n)), n)
    first = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(firsts[:-1], n)
    h = Rolling(Rolling(BYTE_WORDS[raw]).of(starts, ends)).of(first, np.minimum(first + shingle, firsts[1:][text]))
    order = np.lexsort((h, text))
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.searchsorted(text[new], np.arange(len(n) + 1))


def _banded(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in chunks(b.column(2)):
                h, cuts = shingle_sets(texts, shingle)
                some = np.flatnonzero(np.diff(cuts) > 0)
                if not len(some):
                    continue
                at = cuts[some]
                bands = np.zeros((len(some), BANDS), np.uint64)
                for k in range(BANDS * ROWS):
                    least = np.minimum.reduceat((h ^ _SEEDS[2 * k]) * (_SEEDS[2 * k + 1] | np.uint64(1)), at)
                    bands[:, k // ROWS] = mixed(bands[:, k // ROWS] + least)
                rows = pa.array(first + some)
                lists = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32), pa.array(bands.reshape(-1).view(np.int64)))
                sums = [pa.array(np.add.reduceat(mixed(h ^ np.uint64(s)), at).view(np.int64)) for s in (1, 2)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), *sums, lists], names=["_id", "_tk", "_s1", "_s2", "_bands"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in chunks(b.column(2)):
                h, cuts = shingle_sets(texts, shingle)
                found = [h[lo:hi].tobytes() for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), b.column(1).slice(first, len(texts)), pa.array(found, pa.binary())], names=["_id", "_tk", "_set"])

    return run


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in pairs], pa.int64()), pa.array([x[1] for x in pairs], pa.int64())], names=["a", "b"])


def similar(shared: np.ndarray | int, one: np.ndarray | int, other: np.ndarray | int, limit: float):
    return shared >= limit * (one + other - shared) - 1e-9


def _checked(limit: float):
    """Links of pairs (_id, _set, _other, _with) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for i, x, j, y in zip(*[b.column(k).to_pylist() for k in range(4)]):
                if min(len(x), len(y)) < limit * max(len(x), len(y)) - 1e-9:
                    continue
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                if similar(int((x[at] == y).sum()), len(x), len(y), limit):
                    found.append((i, j))
            yield _links(found)

    return run


def bucket_links(rows: list[dict], limit: float) -> Iterator[tuple[int, int]]:
    """Links that join the similar members (_id, _comp, _set) of one bucket; members of one _comp are linked already."""
    sets = [np.frombuffer(r["_set"], np.uint64) for r in rows]
    sizes = np.array([len(x) for x in sets])
    distinct, flat = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.cumsum(sizes) - sizes
    _, name = np.unique(np.array([r["_comp"] for r in rows]), return_inverse=True)
    mark = np.zeros(len(distinct), np.int64)
    for i in range(len(rows) - 1):
        if not (name[i + 1 :] != name[i]).any():
            continue
        own = flat[at[i] : at[i] + sizes[i]]
        mark[own] = 1
        shared = np.add.reduceat(mark[flat[at[i + 1] :]], at[i + 1 :] - at[i + 1])
        mark[own] = 0
        for j in (i + 1 + np.flatnonzero(similar(shared, sizes[i], sizes[i + 1 :], limit))).tolist():
            if name[i] != name[j]:
                yield rows[i]["_id"], rows[j]["_id"]
                name[name == name[j]] = name[i]


def _compared(limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, 1, "_id"):
            first, found = 0, []
            while first < len(rows):
                upto = first + 1
                while upto < len(rows) and rows[upto]["_key"] == rows[first]["_key"]:
                    upto += 1
                found += bucket_links(rows[first:upto], limit)
                first = upto
            yield _links(found)

    return run


def near_copies(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, limit: float = LIMIT, crowd: int = CROWD) -> DataFrame:
    """(node, component) of the ids of ``docs`` that are linked: the least id that each reaches over links of Jaccard ``limit`` or more, and those of ``known`` (a, b).

    Similarity is that of the sets of ``shingle`` lower-cased words. Texts without words and rows with a null id link nothing; rows of one id are one node.
    """
    arrow_rows(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_key(F.col(text_col)).alias("_tk"), F.col(text_col).alias("_text")).where("_id IS NOT NULL")
    marked = cut(rows.mapInArrow(_banded(shingle), "_id long, _tk long, _s1 long, _s2 long, _bands array<long>"), "bands")
    entries = cut(marked.groupBy("_s1", "_s2").agg(F.min(F.struct("_id", "_tk", "_bands")).alias("e")).select("_s1", "_s2", "e.*"), "entries")
    links = known.union(marked.select("_s1", "_s2", F.col("_id").alias("a")).join(entries.select("_s1", "_s2", F.col("_id").alias("b")), ["_s1", "_s2"]).where("a <> b").select("a", "b"))
    members = cut(entries.select("_id", "_tk", F.posexplode("_bands").alias("_band", "_at")), "members")
    buckets = members.groupBy("_band", "_at").agg(
        F.count("*").alias("_n"), F.bit_xor(F.xxhash64("_id", "_tk")).alias("_m1"), F.bit_xor(F.xxhash64("_tk", "_id", F.lit(1))).alias("_m2"),
        F.min("_id").alias("_lo"), F.min(F.struct(F.xxhash64("_id", "_tk").alias("h"), "_id", "_tk")).alias("_c")).where("_n > 1")
    alike = buckets.groupBy("_m1", "_m2", "_n", "_lo").agg(F.min(F.struct("_band", "_at", "_c")).alias("e"))
    alike = cut(alike.select("_n", "e._band", "e._at", F.col("e._c._id").alias("_other"), F.col("e._c._tk").alias("_otk")), "buckets")
    met = cut(members.join(alike, ["_band", "_at"]), "met")
    wanted = cut(met.select("_id", "_tk").distinct(), "wanted")
    sets = cut(rows.join(sized(wanted), ["_id", "_tk"]).select("_id", "_tk", "_text").mapInArrow(_sets(shingle), "_id long, _tk long, _set binary").dropDuplicates(["_id", "_tk"]), "sets")
    pairs = met.where("_id <> _other OR _tk <> _otk").select("_id", "_tk", "_other", "_otk").distinct()
    pairs = pairs.join(sets, ["_id", "_tk"]).join(sets.select(F.col("_id").alias("_other"), F.col("_tk").alias("_otk"), F.col("_set").alias("_with")), ["_other", "_otk"])
    links = cut(links.union(pairs.select("_id", "_set", "_other", "_with").mapInArrow(_checked(limit), "a long, b long")), "linked")
    joined = components(links)
    named = cut(met.join(joined, F.col("_id") == F.col("node"), "left").select("_band", "_at", "_n", "_id", "_tk", F.coalesce("component", "_id").alias("_comp")), "named")
    apart = named.groupBy("_band", "_at").agg(F.min("_comp").alias("_lo"), F.max("_comp").alias("_hi")).where("_lo < _hi").select("_band", "_at")
    blocks = F.ceil(F.col("_n") / crowd).cast("int")
    block = F.pmod(F.xxhash64("_tk", "_id", F.lit(2)), blocks).cast("int")
    both = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(block, j).alias("i"), F.greatest(block, j).alias("j")))
    left = named.join(apart, ["_band", "_at"]).select("_id", "_tk", "_comp", F.col("_band"), F.col("_at"), F.explode(both).alias("_b"))
    left = left.join(sets, ["_id", "_tk"]).select(F.concat_ws(" ", "_band", "_at", "_b.i", "_b.j").alias("_key"), "_id", "_comp", "_set")
    more = left.repartition("_key").sortWithinPartitions("_key").mapInArrow(_compared(limit), "a long, b long")
    return components(more.union(joined.where("node <> component")))
