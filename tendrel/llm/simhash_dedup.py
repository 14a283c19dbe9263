"""SimHash near-duplicates over a Gray-ordered hierarchical index.

Equal fingerprints are one entry. Entries are routed by the five blocks of their bits: of two fingerprints that differ in four bits at most, at least one
block agrees, so they meet under one of five keys. The keys of a task make one index: under each key, fingerprints are sorted by Gray rank, in which
neighbours share long patterns of bits; nodes hold the bits that all their fingerprints share (a mask and a pattern), and upper nodes those that their nodes
share. From the top of each key down, nodes are held against each other: if their shared bits differ in more places than the limit, the whole pair of groups
is pruned, and if all their members must be within the limit, they are joined without looking at these. Every link is found by this descent.

A key with too many fingerprints for one task (near copies of one text) is routed again, by two of six blocks, then four of eight, then twelve of sixteen. Under the
last, 48 bits are given, so that a key has 65,536 fingerprints at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, cut, flat_text, input_rows, text_key, word_bounds
from .components import components
from .routing import chunks

BITS = 4
#: Fingerprints of one key that a task compares; keys with more are routed by finer blocks.
CROWD = 20_000
LEAF, FAN = 32, 16
#: (blocks, of which so many agree), from key to finer key. For any, blocks less agreeing ones are at least the limit.
ROUTES = ((5, 1), (6, 2), (8, 4), (16, 12))
#: Pairs of nodes or fingerprints that are compared at once.
PAIRS = 2_000_000


def fingerprints(texts: pa.Array, shingle: int = 4) -> np.ndarray:
    """SimHash of each text: lower-cased words, shingles of ``shingle`` words with repeats, XXH64 with seed 42, strict majority of bits."""
    raw, offsets = flat_text(texts)
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    starts, ends, firsts = word_bounds(raw, offsets)
    n_words = np.diff(firsts)
    sizes = ends - starts
    out = np.concatenate([[0], np.cumsum(sizes + 1)])  # where each word begins once words are joined by one space
    ink = np.zeros(len(raw) + 1, np.int8)
    ink[starts] += 1
    ink[ends] -= 1
    letters = np.cumsum(ink[:-1]).astype(bool)
    joined = np.full(int(out[-1]), 32, np.uint8)
    place = np.ones(int(out[-1]), bool)
    place[out[1:] - 1] = False
    joined[place] = raw[letters]
    n = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    text = np.repeat(np.arange(len(n)), n)
    first = np.arange(len(text)) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.repeat(firsts[:-1], n)
    last = np.minimum(first + shingle, firsts[1:][text])
    data, digest = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.array([digest(data[a:b], 42) for a, b in zip(out[first].tolist(), (out[last] - 1).tolist())], np.uint64)
    result = np.zeros(len(n), np.uint64)
    cuts = np.concatenate([[0], np.cumsum(n)])
    for lo in range(0, len(n), 512):
        hi = min(lo + 512, len(n))
        own = h[cuts[lo] : cuts[hi]]
        at = (cuts[lo:hi] - cuts[lo])[n[lo:hi] > 0]
        if not len(at):
            continue
        for bit in range(64):
            ones = np.add.reduceat((own >> np.uint64(bit)) & np.uint64(1), at)
            most = 2 * ones > n[lo:hi][n[lo:hi] > 0].astype(np.uint64)
            result[lo:hi][n[lo:hi] > 0] |= most.astype(np.uint64) << np.uint64(bit)
    return result


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code word in the Gray order."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


class _Sets:
    """Disjoint sets of 0..n-1, named by their least member."""

    def __init__(self, n: int):
        self.name = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.name[a], self.name[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.name, np.maximum(x, y), np.minimum(x, y))
            while (self.name[self.name] != self.name).any():
                self.name = self.name[self.name]


def _products(first_a: np.ndarray, n_a: np.ndarray, first_b: np.ndarray, n_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (x, y) with x among the ``n_a`` numbers from ``first_a`` on and y among the ``n_b`` from ``first_b``, for each place; in parts of bounded size."""
    sizes = n_a * n_b
    upto = np.cumsum(sizes)
    k = 0
    while k < len(sizes):
        end = max(k + 1, int(np.searchsorted(upto, upto[k] - sizes[k] + PAIRS, "right")))
        own = np.repeat(np.arange(k, end), sizes[k:end])
        at = np.arange(len(own)) - np.repeat(upto[k:end] - sizes[k:end] - (upto[k] - sizes[k]), sizes[k:end])
        yield first_a[own] + at // n_b[own], first_b[own] + at % n_b[own]
        k = end


class GrayIndex:
    """Fingerprints in Gray order under a tree of shared bit patterns, one tree for each group: ``ones`` and ``zeros`` are the bits that all fingerprints of a
    node have set, or clear. A level is (ones, zeros, first child, children); ``group`` has sorted numbers."""

    def __init__(self, codes: np.ndarray, group: np.ndarray | None = None):
        group = np.zeros(len(codes), np.int64) if group is None else group
        self.order = np.lexsort((gray_rank(codes), group))
        self.codes = codes[self.order]
        self.levels: list[tuple[np.ndarray, ...]] = []
        self.pruned = 0
        ones, zeros, owner, width = self.codes, ~self.codes, group, LEAF
        while True:
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            place = np.arange(len(owner)) - np.repeat(begin, np.diff(np.append(begin, len(owner))))
            at = np.flatnonzero(place % width == 0)
            if self.levels and len(at) == len(owner):  # one node a group
                return
            ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
            self.levels.append((ones, zeros, at, np.diff(np.append(at, len(owner)))))
            owner, width = owner[at], FAN

    def _span(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first fingerprint of each node, and how many it has."""
        first, last = nodes, nodes
        for k in range(level, -1, -1):
            begin, n = self.levels[k][2:]
            first, last = begin[first], begin[last] + n[last] - 1
        return first, last - first + 1

    def link(self, limit: int) -> _Sets:
        """Sets of fingerprints (in Gray order) that links of ``limit`` bits or fewer join; not all links are looked at."""
        sets = _Sets(len(self.codes))
        a = b = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            ones, zeros, begin, n = self.levels[level]
            least = np.bitwise_count((ones[a] & zeros[b]) | (zeros[a] & ones[b]))  # in which members of the nodes differ at least
            alike = np.bitwise_count((ones[a] & ones[b]) | (zeros[a] & zeros[b]))
            sure, go = alike >= 64 - limit, least <= limit
            self.pruned += int((~go).sum())
            for nodes in (a[sure], b[sure]):  # all members of both nodes belong together
                first, size = self._span(level, nodes)
                for x, y in _products(first, size, self._span(level, a[sure])[0], np.ones(len(first), np.int64)):
                    sets.join(x, y)
            a, b = a[go & ~sure], b[go & ~sure]
            below = [(x[x <= y], y[x <= y]) for x, y in _products(begin[a], n[a], begin[b], n[b])] if level else []
            if level:
                a, b = (np.concatenate([np.zeros(0, np.int64), *[p[k] for p in below]]) for k in (0, 1))
                continue
            for x, y in _products(begin[a], n[a], begin[b], n[b]):
                near = (np.bitwise_count(self.codes[x] ^ self.codes[y]) <= limit) & (x < y)
                sets.join(x[near], y[near])
        return sets


def block_keys(codes: np.ndarray, blocks: int, agree: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number, key) for each choice of ``agree`` of ``blocks`` nearly equal blocks of bits."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    for k, chosen in enumerate(combinations(masks, agree)):
        yield k, codes & np.uint64(sum(chosen))


def _routed(blocks: int, agree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, key in block_keys(codes, blocks, agree):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), k, np.int32)), pa.array(key.view(np.int64)), b.column(0), b.column(1)], names=["_pair", "_key", "_fp", "_rep"])

    return run


def _linked(limit: int):
    """Links, as (rep, least rep of its set), of rows that come sorted by pair and key. Sets of one batch of keys are joined first, so that few links leave."""

    def solve(pair: np.ndarray, key: np.ndarray, codes: np.ndarray, reps: np.ndarray) -> pa.RecordBatch | None:
        fresh = np.ones(len(codes), bool)
        fresh[1:] = (pair[1:] != pair[:-1]) | (key[1:] != key[:-1])
        index = GrayIndex(codes, np.cumsum(fresh))
        root = index.link(limit).name
        moved = np.flatnonzero(root != np.arange(len(codes)))
        if not len(moved):
            return None
        ends = np.unique(np.stack([reps[index.order[moved]], reps[index.order[root[moved]]]]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            cols[2] = cols[2].view(np.uint64)
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            if len(held[0]) >= 50_000:
                k = len(held[0]) - 1
                same = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
                k = int(np.argmax(same))  # where the last key begins: rows are sorted
                if k:
                    if (found := solve(*[x[:k] for x in held])) is not None:
                        yield found
                    held = [x[k:] for x in held]
        if held is not None and len(held[0]) and (found := solve(*held)) is not None:
            yield found

    return run


def near_links(entries: DataFrame, limit: int = BITS, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between the _rep of fingerprints (_fp, _rep; each _fp once) that join all that differ in ``limit`` <= 4 bits or fewer into the right sets.
    A link may come more than once."""
    route = "_pair int, _key long, _fp long, _rep long"
    compare = lambda rows: rows.repartition("_pair", "_key").sortWithinPartitions("_pair", "_key").mapInArrow(_linked(limit), "a long, b long")
    arrow_rows(entries.sparkSession)
    links = None
    for k, (blocks, agree) in enumerate(ROUTES):
        routed = cut(entries.mapInArrow(_routed(blocks, agree), route), "routed")
        last = k == len(ROUTES) - 1
        crowded = None if last else cut(routed.groupBy("_pair", "_key").count().where(F.col("count") > crowd).select("_pair", "_key"), "crowded")
        none = last or crowded.isEmpty()
        found = compare(routed if none else routed.join(crowded, ["_pair", "_key"], "left_anti"))
        links = found if links is None else links.union(found)
        if none:
            break
        entries = cut(routed.join(crowded, ["_pair", "_key"], "left_semi").select("_fp", "_rep").distinct(), "dense")
    return links


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.concatenate([fingerprints(texts) for _, texts in chunks(b.column(2))] or [np.zeros(0, np.uint64)])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["_id", "_tk", "_fp"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = BITS, crowd: int = CROWD) -> DataFrame:
    """A row for each row of ``docs``: _id (long), _tk (hash of its text), _fp (64 bits as a long), _component.

    The component of a document is the least id that it reaches over links of ``limit`` bits or fewer. A text without words, null or empty too, has fingerprint
    zero and is linked like any other. Rows that repeat an id are one node. A row with a null id belongs to no component (null), and links nothing.
    """
    arrow_rows(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_key(F.col(text_col)).alias("_tk"), F.col(text_col).alias("_text"))
    marked = cut(rows.mapInArrow(_fingerprinted, "_id long, _tk long, _fp long"), "fingerprints")
    known = marked.where("_id IS NOT NULL")
    entries = cut(known.groupBy("_fp").agg(F.min("_id").alias("_rep")), "entries")
    # an id that has several fingerprints links them
    own = known.join(entries, "_fp").select(F.col("_id").alias("a"), F.col("_rep").alias("b")).distinct()
    several = own.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    links = near_links(entries, limit, crowd).union(own.join(several, "a", "left_semi"))
    found = components(links)
    named = entries.join(found, entries["_rep"] == found["node"], "left").select("_fp", F.coalesce("component", "_rep").alias("_component"))
    return marked.join(named, "_fp", "left").select("_id", "_tk", "_fp", F.when(F.col("_id").isNotNull(), F.col("_component")).alias("_component"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(input_rows(spark, sf_dir).select("doc_id", "text"))
    return out.select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), F.col("_component").alias("component_id"))
