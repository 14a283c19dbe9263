"""Suffix-array dedup of exact byte strings with logarithmic families of indexes.

Passages reach a task by the keys of ``routing``, under which all equal windows meet; equal passages come as one, with their number. A task works off its
passages in batches of whole ones. A batch gets a suffix array: the starts of its windows, sorted by the bytes that follow. It is scanned against the suffix
arrays of the levels that the family holds, in which its windows are looked up in order; then it joins the family, where levels of equal size merge into one
of double size, so that n batches make log n levels. A family takes the passages of several keys, and a new one begins with a new key once it is full, which
bounds what a task holds by that size and the passages of one key.

The family lives in a task: one index of a whole corpus would hold eight bytes for each of its bytes and be rewritten once a level, beyond any disk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, flat_text, input_rows
from .routing import CROWD, chunks, covered, keyed, repeated_windows, with_repeats

BYTES, GRAM, LONGEST = 400, 32, 512
#: Windows in a batch, and in a family before a new one begins.
BATCH, FAMILY = 8_192, 65_536


class SuffixArray:
    """Windows of one width in the order of their bytes: ``windows`` sorted, ``names`` the number of each."""

    def __init__(self, windows: np.ndarray, names: np.ndarray, level: int = 0):
        self.windows, self.names, self.level = windows, names, level

    @classmethod
    def of(cls, data: np.ndarray, starts: np.ndarray, names: np.ndarray, width: int) -> SuffixArray:
        rows = np.lib.stride_tricks.sliding_window_view(data, width)[starts] if len(starts) else np.zeros((0, width), np.uint8)
        # all are of one width, so that bytes strings compare as the bytes do, zeros at the end included
        windows = np.ascontiguousarray(rows).view(f"S{width}")[:, 0]
        order = np.argsort(windows, kind="stable")
        return cls(windows[order], names[order])

    def repeats(self) -> np.ndarray:
        """Names of windows that stand here twice or more."""
        same = np.zeros(len(self.windows) + 1, bool)
        same[1:-1] = self.windows[1:] == self.windows[:-1]
        return self.names[same[1:] | same[:-1]]

    def scan(self, other: SuffixArray) -> np.ndarray:
        """Names, of this, of windows that stand in both, and of the first equal one of ``other``; more of it are among its ``repeats``."""
        if not len(self.windows) or not len(other.windows):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(other.windows, self.windows), len(other.windows) - 1)
        both = other.windows[at] == self.windows
        return np.concatenate([self.names[both], other.names[at[both]]])

    def merged(self, other: SuffixArray) -> SuffixArray:
        """One array of the windows of both, a level up: two sorted runs, which a stable sort merges."""
        windows = np.concatenate([self.windows, other.windows])
        order = np.argsort(windows, kind="stable")
        return SuffixArray(windows[order], np.concatenate([self.names, other.names])[order], self.level + 1)


class IndexFamily:
    """Suffix arrays of geometric sizes; ``add`` returns the names of all windows that a new batch shows to be repeated."""

    def __init__(self) -> None:
        self.levels: list[SuffixArray] = []  # from large to small

    def add(self, batch: SuffixArray) -> np.ndarray:
        found = [batch.repeats(), *[batch.scan(x) for x in self.levels]]
        while self.levels and self.levels[-1].level == batch.level:
            batch = self.levels.pop().merged(batch)
        self.levels.append(batch)
        return np.concatenate(found)


def _families(rows: list[dict], most: int) -> Iterator[tuple[int, int]]:
    """Stretches of whole keys with about ``most`` windows; one key alone may have more."""
    first, n, k = 0, 0, 0
    while k < len(rows):
        upto = k
        own = 0
        while upto < len(rows) and rows[upto]["_key"] == rows[k]["_key"]:
            own += rows[upto]["_n"]
            upto += 1
        if n and n + own > most:
            yield first, k
            first, n = k, 0
        n += own
        k = upto
    if first < len(rows):
        yield first, len(rows)


def solve_bytes(rows: list[dict], window: int = BYTES, batch: int = BATCH, family_windows: int = FAMILY) -> Iterator[tuple[int, int, int, None]]:
    """For rows sorted by key, one a class of _c members: (row, first, windows, None) of the windows that stand twice or more in these or in the members."""
    for first, upto in _families(rows, family_windows):
        family, found = IndexFamily(), []
        sizes = np.array([r["_n"] for r in rows[first:upto]], np.int64)
        firsts = np.concatenate([[0], np.cumsum(sizes)])
        k = first
        while k < upto:
            end = k + 1
            while end < upto and firsts[end + 1 - first] - firsts[k - first] <= batch:
                end += 1
            data = np.frombuffer(b"".join([r["_units"] for r in rows[k:end]]), np.uint8)
            own = sizes[k - first : end - first]
            base, n = int(firsts[k - first]), int(own.sum())
            begin = np.cumsum(own + window - 1) - (own + window - 1)
            starts = np.arange(n) + np.repeat(begin - np.cumsum(own) + own, own)
            found.append(family.add(SuffixArray.of(data, starts, base + np.arange(n), window)))
            k = end
        hit = np.repeat(np.array([r["_c"] > 1 for r in rows[first:upto]]), sizes)
        hit[np.concatenate(found)] = True
        edge = np.zeros(len(hit) + 1, bool)
        edge[firsts] = True
        edge[1:-1] |= hit[1:] != hit[:-1]
        cuts = np.flatnonzero(edge)
        cuts = cuts[:-1][hit[cuts[:-1]]], cuts[1:][hit[cuts[:-1]]]
        owner = np.searchsorted(firsts, cuts[0], "right") - 1
        for i, a, b in zip(owner.tolist(), (cuts[0] - firsts[owner]).tolist(), (cuts[1] - cuts[0]).tolist()):
            yield first + i, a, b, None


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = BYTES, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """A row for each row of ``docs``: id, kept (binary: what remains of the UTF-8 bytes), n_bytes, n_removed, n_spans.

    A byte goes if it lies in a string of ``window`` bytes that begins anywhere else, in the same text too; all its occurrences go. Matches don't cross texts,
    and are judged on the texts as they come. A cut may fall inside a character, so what is kept is binary. Null texts are empty. Repeated rows are
    occurrences of their own, whether their ids are equal or null or not.
    """
    arrow_rows(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    found = repeated_windows(rows, lambda r: solve_bytes(r, window), "bytes", window, gram, LONGEST, earlier=False, crowd=crowd)
    joined = with_repeats(rows, found)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, n_bytes, n_removed, n_spans = [], [], [], []
            for first, part in chunks(b.column(2)):
                raw, offsets = flat_text(part)
                for i, want in enumerate(b.column(3).slice(first, len(part)).to_pylist()):
                    own = raw[offsets[i] : offsets[i + 1]]
                    gone = covered(len(own), want, window)
                    n_bytes.append(len(own))
                    n_removed.append(int(gone.sum()))
                    n_spans.append(int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1)))
                    kept.append(own[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), *[pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)]], names=["_id", "kept", "n_bytes", "n_removed", "n_spans"])

    kind = dict(rows.dtypes)["_id"]
    return joined.mapInArrow(strip, f"_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long").withColumnRenamed("_id", id_col)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(input_rows(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
