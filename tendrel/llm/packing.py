"""Packing of token sequences: best-fit decreasing over a segment tree.

Texts become token ids once, where they are read; ids of pieces and their lengths go on. A document longer than the window is first cut into full windows,
which need no search. What is left of each document is packed by best-fit decreasing: a segment tree over remaining capacities finds the tightest window
that still has room. Pieces are dealt into packing groups by hash of document and position, so groups are of even size whatever the documents are, each is
packed by one task from lengths alone, and the number of groups follows the number of rows.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, arrow_rows, flat_text, input_rows, word_bounds, worker_state

WINDOW = 2048
#: Documents a packing group has on average; sequence ids are group * 2**32 + number.
GROUP_DOCS = 20_000


_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = ~_ALNUM[33:127]
_MARK[39] = False


def part_marks(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with one to three ASCII marks after an ASCII letter or digit fall in two there, as in the tokenizer's own rule, so that fewer are distinct."""
    at, marks = np.zeros(len(stops), np.int64), np.ones(len(stops), bool)
    for r in (1, 2, 3):
        marks &= stops - r > starts
        marks[marks] = _MARK[raw[stops[marks] - r]]
        done = marks & _ALNUM[raw[np.maximum(stops - r - 1, 0)]]
        at[done] = r
    cut = (stops - at)[at > 0]
    return np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([stops, cut]))


class ChunkEncoder:
    """Token ids of whole texts by a ``tokenizers`` file, one distinct stretch between white space at a time.

    Only for tokenizers that drop white space, never join across it, and part letters, single digits and runs of other characters, with a mark in the
    vocabulary for the last token of such a part. A cache of bounded size holds the ids of frequent stretches. New stretches of letters alone are joined by
    spaces and tokenized many at a time: each is one part, so it ends at the next token with that mark.
    """

    END = "</w>"
    #: Stretches that are tokenized as one text.
    JOINED = 500

    def __init__(self, path: str, cache_size: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # every core has a task already
        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.cache_size = Tokenizer.from_file(path), {}, cache_size
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(self.END)]] = True

    def _tokens(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        cache, single = self.cache, [w for w in words if not w.isalpha()]
        letters = [w for w in words if w.isalpha()]
        groups = [letters[k : k + self.JOINED] for k in range(0, len(letters), self.JOINED)]
        for group, ids in zip(groups, self._tokens([" ".join(g) for g in groups])):
            ids = np.array(ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(group):  # letters to one library, not all to the other
                single += group
                continue
            data, ends = ids.tobytes(), (4 * cuts).tolist()
            for w, lo, hi in zip(group, [0, *ends], ends):
                cache[w] = data[lo:hi]
        for w, ids in zip(single, self._tokens(single)):
            cache[w] = array("I", ids).tobytes()

    def _ids(self, words: list[str]) -> list[bytes]:
        found = list(map(self.cache.get, words))
        missing = [w for w, x in zip(words, found) if x is None]
        if missing:
            if len(self.cache) + len(missing) > self.cache_size:
                self.cache.clear()
            self._learn(missing)
            new = map(self.cache.__getitem__, missing)
            found = [next(new) if x is None else x for x in found]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the len+1 offsets between them."""
        raw, offsets = flat_text(texts)
        data = raw.tobytes()
        special = b"<|" in data  # may begin a special token that is written out, whose case matters
        if not special:
            raw = np.frombuffer(data.translate(LOWER), np.uint8)
        starts, stops, _ = word_bounds(raw, offsets)
        if not special:
            starts, stops = part_marks(raw, starts, stops)
        letters = raw[~((raw == 32) | ((raw >= 9) & (raw <= 13)))]
        cuts = np.concatenate([[0], np.cumsum(stops - starts)])
        words = pc.dictionary_encode(pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(letters)))
        found = self._ids(words.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), np.uint32)
        firsts = np.concatenate([[0], np.cumsum(sizes)])
        code = words.indices.to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes[code])])
        at = np.arange(ends[-1]) + np.repeat(firsts[code] - ends[:-1], sizes[code])
        return flat[at], ends[np.searchsorted(starts, offsets)]


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of each length, longest first; equal lengths in the given order.

    Lengths of a whole window get one each, without a search. The leaves of the tree are the remaining capacities 0..window, each with its open windows; an
    inner node counts those below it. The search goes up from the leaf of the wanted length until there is an open window to the right, and down to the
    leftmost one.
    """
    size = 1 << int(window).bit_length()
    count = [0] * (2 * size)
    open_at: list[list[int]] = [[] for _ in range(window + 1)]
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = np.flatnonzero(lengths == window)
    number[full] = np.arange(len(full))
    room = [0] * len(full)

    def change(capacity: int, by: int) -> None:
        k = size + capacity
        while k:
            count[k] += by
            k >>= 1

    for i in np.argsort(-lengths, kind="stable")[len(full) :].tolist():
        need = int(lengths[i])
        k = size + need
        if not count[k]:
            while k > 1 and (k & 1 or not count[k + 1]):
                k >>= 1
            if k > 1:
                k += 1
                while k < size:
                    k = 2 * k if count[2 * k] else 2 * k + 1
        if k > 1:
            have = k - size
            w = open_at[have].pop()
            change(have, -1)
        else:
            have, w = window, len(room)
            room.append(window)
        number[i], offset[i] = w, window - have
        room[w] = have - need
        if room[w]:
            open_at[room[w]].append(w)
            change(room[w], 1)
    return number, offset


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Each document's ids and ``end_id``, cut at full windows: _id, _key (hash of the text), start, length, doc_tokens, ids_crc32 and, if wanted, ids.

    A null or empty text is ``end_id`` alone. Only the pieces leave the task, never a list of a whole text's ids in one row.
    """
    arrow_rows(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("_text"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state().get(f"encoder {tokenizer_path}") or ChunkEncoder(tokenizer_path)
        worker_state()[f"encoder {tokenizer_path}"] = encoder
        for b in batches:
            ids, offsets = encoder.encode(b.column(2))
            row, start, length, crc, total, cut_ids = [], [], [], [], [], []
            for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                own = np.append(ids[lo:hi], np.uint32(end_id)).astype("<u4")
                for s in range(0, len(own), window):
                    piece = own[s : s + window]
                    row.append(i)
                    start.append(s)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(own))
                    if with_ids:
                        cut_ids.append(piece)
            at = pa.array(row, pa.int64())
            cols = {"_id": b.column(0).take(at), "_key": b.column(1).take(at)} | {
                n: pa.array(v, pa.int64()) for n, v in (("start", start), ("length", length), ("doc_tokens", total), ("ids_crc32", crc))}
            if with_ids:
                cuts = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                cols["ids"] = pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([*cut_ids, np.zeros(0, "<u4")]).astype(np.int32)))
            yield pa.RecordBatch.from_pydict(cols)

    kind = dict(rows.dtypes)["_id"]
    return rows.mapInArrow(pieces, f"_id {kind}, _key long, start long, length long, doc_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def assign_windows(pieces: DataFrame, groups: int, window: int = WINDOW) -> DataFrame:
    """``pieces`` with sequence_id and offset: every piece in one window, gapless from 0, no window over its size.

    Full pieces get windows of their own. Pieces of no length must not occur. Repeated rows are packed like any others.
    """
    schema = pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "_id", "_key", "start"], ascending=[False, True, True, True], kind="stable")
        number, offset = best_fit_decreasing(rows["length"].to_numpy(np.int64), window)
        return rows.drop(columns="_group").assign(sequence_id=(int(key[0]) << 32) + number, offset=offset)

    grouped = pieces.withColumn("_group", F.pmod(F.xxhash64("_id", "_key", "start"), F.lit(groups)))
    return grouped.groupBy("_group").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """All pieces of ``docs`` with their place: id, start, length, doc_tokens, ids_crc32, sequence_id, offset (and ids).

    Every id of every document lies in exactly one piece. Null ids are fine, and rows that repeat an id are documents of their own.
    """
    n = docs.count()
    pieces = tokenize_pieces(docs, tokenizer_path, end_id, window, id_col, text_col, with_ids)
    return assign_windows(pieces, max(1, round(n / GROUP_DOCS)), window).drop("_key").withColumnRenamed("_id", id_col)


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The windows of ``pack_documents(with_ids=True)``: sequence_id, ids in order of offset, padded to ``window`` unless their number is a power of two."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    ids = F.flatten(F.transform("_p", lambda p: p["ids"]))
    pad = F.when(F.size(ids).isin([1 << k for k in range(window.bit_length())]), F.lit(0)).otherwise(window - F.size(ids))
    return rows.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad_id), pad)).alias("ids"), F.size(ids).alias("n_ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(input_rows(spark, sf_dir).select("doc_id", "text"), default_tokenizer(), with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
