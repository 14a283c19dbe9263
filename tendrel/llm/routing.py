"""Bringing equal windows of a whole corpus together without shuffling every window.

Every window of W units (words or bytes) gets as its key the least hash of the K-unit grams in it. Equal windows have equal keys, and neighbouring windows
mostly share theirs: a run of such windows is a segment, so that a text makes one row for about (W-K)/2 windows. Keys that can hold no repeat (only one
document has them, or only one segment, in which their gram stands once) go at once. Of the rest, equal segments make a class, and a class goes as one row,
with its number of members and least document, to the task of its key, where a solver says which of its windows repeat. What it says is joined back to
the members.

Keys with many classes (a passage in a third of all documents, each time with other surroundings) are not given to one task. Their segments are parted
again: each window has a place relative to the first of its key's grams in it, windows of one stretch of places go together, and what all windows of such a
stretch share, the core, is hashed as the new key. Stretches get shorter from level to level until a core is a whole window, so that a key at last holds one
class, however common the passage is.

A segment is known by its key and a second 64-bit hash of its units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import BYTE_WORDS, Rolling, arrow_rows, cut, flat_text, mixed, text_key, word_bounds

#: Classes of one key that a solver may get; a key with more is parted.
CROWD = 1000
#: Places in a stretch, by level, when crowded keys are parted.
STRETCHES = (64, 8, 1)
#: Bytes of text that are looked at at once; arrays of eight bytes and more for each of them are made, by every task of an executor.
CHUNK = 500_000


def text_units(texts: pa.Array, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Units of all texts as 64-bit words, their offsets by text, the bytes, and for words their byte bounds."""
    raw, offsets = flat_text(texts)
    if unit == "bytes":
        return BYTE_WORDS[raw], offsets, raw, None, None
    starts, ends, firsts = word_bounds(raw, offsets)
    return Rolling(BYTE_WORDS[raw]).of(starts, ends), firsts, raw, starts, ends


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x if size == width else np.minimum(x[: len(x) - (width - size)], x[width - size :])


def window_runs(values: np.ndarray, offsets: np.ndarray, window: int, gram: int, longest: int) -> tuple[np.ndarray, ...]:
    """Segments as (text, first window, windows, key, hash of the segment, whether its key's gram stands in it twice or more). No window crosses texts;
    ``longest`` bounds the windows of one. Only where that gram repeats can one segment hold equal windows, as in periodic text.
    """
    counts = np.maximum(np.diff(offsets) - window + 1, 0)
    total = int(counts.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, bool),)
    roll = Rolling(values)
    grams, slack = roll.grams(gram), window - gram
    least = sliding_min(grams, slack + 1)
    text = np.repeat(np.arange(len(counts)), counts)
    first_of = np.concatenate([[0], np.cumsum(counts)])[:-1]
    at = np.arange(total) - np.repeat(first_of - offsets[:-1], counts)
    key = least[at]
    fresh = np.ones(total, bool)
    fresh[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(fresh)
    place = np.arange(total) - np.repeat(begin, np.diff(np.append(begin, total)))
    begin = np.flatnonzero(place % longest == 0)
    n = np.diff(np.append(begin, total))
    first = at[begin]
    # a gram is the least of some window if it equals the greatest of the least grams of all windows that hold it
    edge = np.zeros(slack, np.uint64)
    marks = np.flatnonzero(grams == ~sliding_min(~np.concatenate([edge, least, edge]), slack + 1))
    lo, hi = np.searchsorted(marks, first), np.searchsorted(marks, first + n + slack)
    owner = np.repeat(np.arange(len(begin)), hi - lo)
    mark = marks[np.arange(len(owner)) - np.repeat(np.cumsum(hi - lo) - hi, hi - lo)]
    again = np.bincount(owner[grams[mark] == key[begin][owner]], minlength=len(begin)) > 1
    return text[begin], first - offsets[text[begin]], n, key[begin], roll.of(first, first + n + window - 1), again


def chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of about ``most`` bytes each; one long text alone may have more."""
    _, ends = flat_text(texts)
    first = 0
    while first < len(texts):
        upto = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
        yield first, texts.slice(first, upto - first)
        first = upto


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _segments(unit: str, window: int, gram: int, longest: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in chunks(b.column(2)):
                values, offsets, *_ = text_units(texts, unit)
                text, at, n, key, own, again = window_runs(values, offsets, window, gram, longest)
                rows = pa.array(first + text)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), _long(at), _long(n), _long(key), _long(own), pa.array(again)], names=["_id", "_tk", "_at", "_n", "_key", "_own", "_self"])

    return run


def _fetch(unit: str, window: int) -> Callable:
    """Units of the wanted segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wants = b.column(1)
            for first, texts in chunks(b.column(0)):
                values, offsets, raw, *_ = text_units(texts, unit)
                own = wants.slice(first, len(texts))
                flat, row = pc.list_flatten(own), np.repeat(np.arange(len(own)), pc.list_value_length(own).to_numpy(zero_copy_only=False))
                at, n = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("_at", "_n"))
                lo = offsets[row] + at
                data = raw if unit == "bytes" else values
                units = [data[i:j].tobytes() for i, j in zip(lo.tolist(), (lo + n + window - 1).tolist())]
                yield pa.RecordBatch.from_arrays([*[flat.field(x) for x in ("_key", "_own", "_least", "_c", "_n")], pa.array(units, pa.binary())], names=["_key", "_own", "_least", "_c", "_n", "_units"])

    return run


def part_segment(values: np.ndarray, window: int, gram: int, stretch: int) -> Iterator[tuple[int, int, int, int]]:
    """(first window, windows, new key, hash) of the parts of a segment's units: runs of windows with the same first gram of their key and places in one stretch."""
    n = len(values) - window + 1
    roll = Rolling(values)
    grams = roll.grams(gram)
    at = np.flatnonzero(grams == sliding_min(grams, window - gram + 1)[0])
    anchor = at[np.searchsorted(at, np.arange(n))]
    level = (anchor - np.arange(n)) // stretch
    begin = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (level[1:] != level[:-1])]))
    sizes = np.diff(np.append(begin, n))
    core = anchor[begin] - level[begin] * stretch
    keys = mixed(roll.of(core, core + window - stretch + 1) + level[begin].astype(np.uint64))
    yield from zip(begin.tolist(), sizes.tolist(), keys.view(np.int64).tolist(), roll.of(begin, begin + sizes + window - 1).view(np.int64).tolist())


def _parted(unit: str, window: int, gram: int, stretch: int) -> Callable:
    width, kind = (1, np.uint8) if unit == "bytes" else (8, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, cols = [], ([], [], [], [], [])
            for i, units in enumerate(b.column(b.schema.get_field_index("_units")).to_pylist()):
                values = np.frombuffer(units, kind)
                for at, n, key, own in part_segment(BYTE_WORDS[values] if unit == "bytes" else values, window, gram, stretch):
                    row.append(i)
                    for c, x in zip(cols, (at, n, key, own, units[at * width : (at + n + window - 1) * width])):
                        c.append(x)
            rows = pa.array(row, pa.int64())
            get = lambda name: b.column(b.schema.get_field_index(name)).take(rows)
            yield pa.RecordBatch.from_arrays([get("_key"), get("_own"), *[pa.array(c, pa.int64()) for c in cols[:2]], get("_least"), get("_c"), *[pa.array(c, pa.int64()) for c in cols[2:4]], pa.array(cols[4], pa.binary())], names=["_up_key", "_up_own", "_shift", "_n", "_least", "_c", "_key", "_own", "_units"])

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], least: int = 2000, name: str = "_own") -> Iterator[list[dict]]:
    """Rows that come sorted by _key, as lists of at least ``least`` rows (but for the last) that never part a key; a row that repeats the key and ``name`` of the one before goes."""
    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if not held or r[name] != held[-1][name] or r["_key"] != held[-1]["_key"]:
                held.append(r)
        if len(held) >= least:
            last, k = held[-1]["_key"], len(held)
            while k and held[k - 1]["_key"] == last:
                k -= 1
            if k:
                yield held[:k]
                held = held[k:]
    if held:
        yield held


def _solved(solve: Callable[[list[dict]], Iterator[tuple]], schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches):
            found = list(solve(rows))
            if found:
                own = [rows[x[0]] for x in found]
                cols = [[r["_key"] for r in own], [r["_own"] for r in own], *[[x[k] for x in found] for k in (1, 2, 3)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def _found(classes: DataFrame, solve: Callable, unit: str, window: int, gram: int, earlier: bool, crowd: int, stretches: tuple[int, ...]) -> DataFrame:
    """Repeated windows of ``classes`` (_key, _own, _least, _c, _n, _units; one row a class) as (_key, _own, _at, _n, _who), _at from the segment's first on."""
    kind = dict(classes.dtypes)["_least"]
    out = to_arrow_schema(classes.select("_key", "_own", F.lit(0).cast("long").alias("_at"), "_n", F.col("_least").alias("_who")).schema)
    groups = classes.groupBy("_key").agg(F.count("*").alias("_classes"))
    crowded = cut(groups.where(F.col("_classes") > crowd).select("_key"), "crowded") if stretches else None
    some = crowded is not None and not crowded.isEmpty()
    fine = classes.join(crowded, "_key", "left_anti") if some else classes
    solved = fine.repartition("_key").sortWithinPartitions("_key", "_least", "_own").mapInArrow(_solved(solve, out), f"_key long, _own long, _at long, _n long, _who {kind}")
    if not some:
        return solved
    parts = classes.join(crowded, "_key", "left_semi").mapInArrow(_parted(unit, window, gram, stretches[0]), f"_up_key long, _up_own long, _shift long, _n long, _least {kind}, _c long, _key long, _own long, _units binary")
    parts = cut(parts.dropDuplicates(["_up_key", "_up_own", "_shift"]), "parts")  # rows that repeat id and text come from the fetch as often
    finer = parts.groupBy("_key", "_own").agg(F.min("_least").alias("_least"), F.max("_least").alias("_most"), F.sum("_c").alias("_c"), F.first("_n").alias("_n"), F.first("_units").alias("_units"))
    per_key = finer.groupBy("_key").agg(F.min("_least").alias("_lo"), F.max("_most").alias("_hi"), F.sum("_c").alias("_sum"), F.max("_c").alias("_c"))
    open_ = cut(per_key.where((F.col("_hi") > F.col("_lo")) | ((F.col("_c") > 1) if earlier else (F.col("_sum") > 1))).select("_key"), "open")
    finer = cut(finer.drop("_most").join(open_, "_key", "left_semi"), "finer")
    below = cut(_found(finer, solve, unit, window, gram, earlier, crowd, stretches[1:]), "below")
    back = parts.select("_up_key", "_up_own", "_shift", "_key", "_own").join(below, ["_key", "_own"])
    return solved.union(back.select(F.col("_up_key").alias("_key"), F.col("_up_own").alias("_own"), (F.col("_shift") + F.col("_at")).alias("_at"), "_n", "_who"))


def repeated_windows(rows: DataFrame, solve: Callable, unit: str, window: int, gram: int, longest: int, earlier: bool, crowd: int = CROWD) -> DataFrame:
    """Repeated windows of ``rows`` (_id, _tk, _text) as (_id, _tk, _at, _n): _n windows from unit _at on.

    ``earlier``: a window counts if it also stands in a row with a smaller _id; otherwise if it stands anywhere else, the same row included. ``solve`` gets
    the classes of whole keys (_key, _own, _least, _c, _n, _units), with their number of members and least _id, and yields (index of row, _at, _n, _who): runs
    of windows that stand elsewhere in those classes or in several members, and the least _id that has them. Of a class the members with a larger id lose these.
    """
    arrow_rows(rows.sparkSession)
    kind = dict(rows.dtypes)["_id"]
    taken = rows.where(F.col("_id").isNotNull()) if earlier else rows
    segments = cut(taken.mapInArrow(_segments(unit, window, gram, longest), f"_id {kind}, _tk long, _at long, _n long, _key long, _own long, _self boolean"), "segments")
    per_key = segments.groupBy("_key").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi"), F.count("*").alias("_c"), F.bool_or("_self").alias("_self"))
    shared = per_key.where((F.col("_hi") > F.col("_lo")) if earlier else (F.col("_c") > 1) | F.col("_self")).select("_key")
    # Both sides of the join are plain tables, so Spark may split a key that many segments share.
    met = cut(segments.join(cut(shared, "shared"), "_key", "left_semi"), "met")
    classes = met.groupBy("_key", "_own").agg(F.min(F.struct("_id", "_tk", "_at", "_n")).alias("_rep"), F.count("*").alias("_c"))
    wanted = classes.select(F.col("_rep._id").alias("_id"), F.col("_rep._tk").alias("_tk"), F.struct(
        "_key", "_own", F.col("_rep._id").alias("_least"), "_c", F.col("_rep._at").alias("_at"), F.col("_rep._n").alias("_n")).alias("_want"))
    wanted = wanted.groupBy("_id", "_tk").agg(F.collect_list("_want").alias("_wants"))
    r, w = rows.alias("r"), wanted.alias("w")
    fetched = r.join(w, F.col("r._id").eqNullSafe(F.col("w._id")) & (F.col("r._tk") == F.col("w._tk"))).select("r._text", "w._wants").mapInArrow(
        _fetch(unit, window), f"_key long, _own long, _least {kind}, _c long, _n long, _units binary")
    found = cut(_found(cut(fetched, "fetched"), solve, unit, window, gram, earlier, crowd, tuple(x for x in STRETCHES if x < window - gram)), "found")
    members = met.select("_key", "_own", "_id", "_tk", F.col("_at").alias("_first")).join(found, ["_key", "_own"])
    members = members.where(F.col("_id") > F.col("_who")) if earlier else members
    return members.select("_id", "_tk", (F.col("_first") + F.col("_at")).alias("_at"), "_n")


def with_repeats(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with _found: an array of their repeated windows (_at, _n), or null."""
    per_row = found.groupBy("_id", "_tk").agg(F.collect_list(F.struct("_at", "_n")).alias("_found"))
    r, f = rows.alias("r"), per_row.alias("f")
    return r.join(f, F.col("r._id").eqNullSafe(F.col("f._id")) & (F.col("r._tk") == F.col("f._tk")), "left").select("r.*", "f._found")


def covered(n_units: int, found: list | None, window: int) -> np.ndarray:
    """Which units lie in any of the windows."""
    edge = np.zeros(n_units + 1, np.int64)
    for x in found or ():
        edge[x["_at"]] += 1
        edge[x["_at"] + x["_n"] + window - 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def keyed(docs: DataFrame, id_col: str, text_col: str, rest: list[str] = ()) -> DataFrame:
    """_id, _tk (tells apart rows that share an id), _text and, if there are any, the columns ``rest`` as one _rest."""
    more = [F.struct(*rest).alias("_rest")] if rest else []
    return docs.select(F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("_tk"), F.col(text_col).alias("_text"), *more)
