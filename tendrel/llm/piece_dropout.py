"""SentencePiece merges with seeded dropout, and decoding.

Texts are split where a run of spaces begins, which no piece of the vocabulary crosses, and each distinct stretch is segmented by an agenda of candidate
merges: the best-scored adjacent pair that makes a piece is taken, the leftmost first among equals. A candidate is skipped for good when the hash of
(seed, document, place in the text, span, split) falls below the dropout rate, so every occurrence draws for itself and results do not depend on partitions,
retries or order. A batch of texts first segments each distinct stretch without skips; an occurrence that skips none of the candidates which came up takes
that as it is, and one that does is segmented again under what it skips, along with all others of the same stretch and set, until it skips no more. The
agendas of all distinct stretches and sets are worked off together, one merge of each a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_WORDS, Rolling, arrow_rows, flat_text, input_rows, mixed, worker_state

SPACE = "▁"
RAW = 1 << 20  # symbols that are no piece: RAW + code point
#: Characters of stretches whose agendas are worked off together.
TOGETHER = 100_000


class MergeModel:
    """Pieces, scores and mergeable pairs of a SentencePiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ids = {self.pieces[i]: i for i in normal}
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.char = {p: i for p, i in ids.items() if len(p) == 1}
        symbol = lambda s: ids.get(s, RAW + ord(s) if len(s) == 1 else -1)
        pairs = []
        for i in normal:
            p = self.pieces[i]
            pairs += [(a << 32 | b, i) for k in range(1, len(p)) if (a := symbol(p[:k])) >= 0 and (b := symbol(p[k:])) >= 0]
        pairs.sort()
        self._index(np.array([c for c, _ in pairs], np.int64), np.array([i for _, i in pairs], np.int64))
        order = np.argsort([-sp.get_score(i) for i in range(n)], kind="stable")
        self.rank = np.empty(n, np.int32)
        self.rank[order] = np.arange(n)
        self.symbol_of = np.arange(RAW, RAW + 0x110000, dtype=np.int32)  # by code point
        for p, i in self.char.items():
            self.symbol_of[ord(p)] = i
        self.symbol_of[[32, ord(SPACE)]] = self.char[SPACE], RAW + ord(SPACE)  # a mark that stands in the text itself goes as its bytes, so that it comes back

    def _index(self, codes: np.ndarray, made: np.ndarray) -> None:
        """A table of pairs by hash, with room for each pair in one of a few places: ``merged`` looks them up without a search."""
        size = 1 << (4 * len(codes)).bit_length()
        self.mask, self.table, self.made = np.int64(size - 1), np.full(size + 64, -1, np.int64), np.full(size + 64, -1, np.int32)
        left, home, self.probes = np.arange(len(codes)), self._home(codes), 0
        while len(left):
            at = home[left] + self.probes
            free = self.table[at] < 0
            _, first = np.unique(at, return_index=True)
            first = first[free[first]]
            self.table[at[first]], self.made[at[first]] = codes[left[first]], made[left[first]]
            left = np.delete(left, first)
            self.probes += 1

    def _home(self, code: np.ndarray) -> np.ndarray:
        return (code * np.int64(-7046029254386353131) >> np.int64(33)) & self.mask

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1. Symbols of -1 make none."""
        code = left.astype(np.int64) << 32 | right
        at = self._home(code)
        found = self.table[at]
        piece = np.where(found == code, self.made[at], -1)
        open_ = np.flatnonzero((found != code) & (found >= 0) & (code >= 0))
        for k in range(1, self.probes):
            if not len(open_):
                break
            at = self._home(code[open_]) + k
            found = self.table[at]
            hit = found == code[open_]
            piece[open_[hit]] = self.made[at[hit]]
            open_ = open_[~hit & (found >= 0)]
        return piece

    def segment(self, symbols: np.ndarray, begin: np.ndarray, upto: np.ndarray, keys: np.ndarray, barred: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each stretch ``symbols[begin:upto]`` its piece ids and the candidates that came up and weren't barred, as (ids, first, size, spans, first, size).

        ``barred`` has the skipped candidates of all stretches, parted at ``cuts``; ``keys`` a hash for each stretch with what it skips.
        """
        sizes, n = upto - begin, len(begin)
        places = np.zeros((4, n), np.int64)
        all_ids, all_seen, done, seen_done = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)], 0, 0
        lo = 0
        for hi in (6, 10, 16, 32, 128, 1 << 40):
            own = np.flatnonzero((sizes > lo) & (sizes <= hi))
            step = max(1, TOGETHER // int(sizes[own].max(initial=1)))
            for k in range(0, len(own), step):
                part = own[k : k + step]
                times = cuts[part + 1] - cuts[part]
                spans = barred[np.arange(times.sum()) + np.repeat(cuts[part] - np.cumsum(times) + times, times)]
                row, ids, seen_row, seen = self._together(symbols, begin[part], sizes[part], keys[part], spans, np.repeat(np.arange(len(part)), times))
                at, seen_at = np.searchsorted(row, np.arange(len(part) + 1)), np.searchsorted(seen_row, np.arange(len(part) + 1))
                places[:, part] = done + at[:-1], np.diff(at), seen_done + seen_at[:-1], np.diff(seen_at)
                all_ids.append(ids.astype(np.int32))
                all_seen.append(seen)
                done, seen_done = done + len(ids), seen_done + len(seen)
            lo = hi
        return np.concatenate(all_ids), places[0], places[1], np.concatenate(all_seen), places[2], places[3]

    def _together(self, symbols: np.ndarray, begin: np.ndarray, sizes: np.ndarray, keys: np.ndarray, barred: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
        n, width = len(begin), int(sizes.max())
        inside = np.arange(width)[None, :] < sizes[:, None]
        symbol = np.full((n, width), -1, np.int32)
        symbol[inside] = symbols[np.arange(sizes.sum()) + np.repeat(begin - np.cumsum(sizes) + sizes, sizes)]
        nxt = np.broadcast_to(np.arange(1, width + 1, dtype=np.int32), (n, width)).copy()  # the place of the symbol after this one; width or beyond the end: none
        prv = np.broadcast_to(np.arange(-1, width - 1, dtype=np.int32), (n, width)).copy()
        none = np.iinfo(np.int32).max
        worst = np.full((n, width), none, np.int32)  # rank of the candidate that begins here
        skips = np.sort(mixed(keys[owner] ^ mixed(barred)))
        seen_rows, seen = [], []

        def candidates(row: np.ndarray, at: np.ndarray) -> None:
            then = nxt[row, at]
            ok = (at >= 0) & (then < sizes[row])
            row, at, then = row[ok], at[ok], then[ok]
            piece = self.merged(symbol[row, at], symbol[row, then])
            worst[row, at] = none
            ok = piece >= 0
            row, at, then, piece = row[ok], at[ok], then[ok], piece[ok]
            span = (at.astype(np.uint64) << np.uint64(42)) | (then.astype(np.uint64) << np.uint64(21)) | nxt[row, then].astype(np.uint64)
            if len(skips):
                code = mixed(keys[row] ^ mixed(span))
                ok = skips[np.minimum(np.searchsorted(skips, code), len(skips) - 1)] != code
                row, at, piece, span = row[ok], at[ok], piece[ok], span[ok]
            seen_rows.append(row)
            seen.append(span)
            worst[row, at] = self.rank[piece]

        rows, ats = np.nonzero(inside)
        candidates(rows, ats)
        live = np.arange(n)
        while len(live):
            view = worst[live]
            at = view.argmin(1)
            go = view[np.arange(len(live)), at] < none
            live, at = live[go], at[go]
            then = nxt[live, at]
            symbol[live, at] = self.merged(symbol[live, at], symbol[live, then])
            symbol[live, then] = -1
            worst[live, then] = none
            worst[live, at] = none
            after = nxt[live, then]
            nxt[live, at] = after
            has = after < sizes[live]
            prv[live[has], after[has]] = at[has]
            candidates(live, at)
            before = prv[live, at]
            candidates(live[before >= 0], before[before >= 0])
        row, at = np.nonzero(symbol >= 0)
        ids = symbol[row, at]
        raw = ids >= RAW
        if raw.any():  # characters without a piece go as their bytes
            spelt = [list(chr(int(c) - RAW).encode()) for c in ids[raw]]
            times = np.ones(len(ids), np.int64)
            times[raw] = [len(x) for x in spelt]
            row, ids = np.repeat(row, times), np.repeat(ids, times)
            ids[ids >= RAW] = self.bytes[[b for x in spelt for b in x]]
        seen_row = np.concatenate(seen_rows)
        order = np.argsort(seen_row, kind="stable")
        return row, ids, seen_row[order], np.concatenate(seen)[order]


def encode_batch(model: MergeModel, texts: pa.Array, doc_keys: np.ndarray, seed: int, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts in a row, and the offsets between them. A text gets a leading space first; null and empty texts have no pieces."""
    raw, offsets = flat_text(texts)
    some = np.flatnonzero(np.diff(offsets) > 0)
    raw = np.insert(raw, offsets[some], 32)
    offsets = offsets + np.searchsorted(some, np.arange(len(offsets)))
    space = raw == 32
    begins = space.copy()
    if len(raw):
        begins[1:] &= ~space[:-1]
    inner = offsets[:-1][np.diff(offsets) > 0]
    begins[inner] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(raw))
    firsts = np.searchsorted(starts, offsets)
    count = np.diff(firsts)
    place = np.arange(len(starts)) - np.repeat(firsts[:-1], count)
    salt = mixed(doc_keys.astype(np.int64).view(np.uint64) ^ mixed(np.array([seed], np.uint64)))
    draw = mixed(np.repeat(salt, count) + place.astype(np.uint64))  # a key for each occurrence
    limit = np.uint64(int(dropout * (1 << 32)))
    symbols = model.symbol_of[np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)]
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    begin, upto = chars[starts], chars[ends]
    state = Rolling(BYTE_WORDS[raw]).of(starts, ends)  # of the stretch, and of what it skips
    live, owner, skipped = np.arange(len(starts)), np.zeros(0, np.int64), np.zeros(0, np.uint64)  # skipped: by owner, in order
    chosen, pieces, firsts_of, sizes_of, known, done = np.zeros(len(starts), np.int64), [], [], [], 0, 0
    while len(live):
        states, first, back = np.unique(state[live], return_index=True, return_inverse=True)
        some = live[first]
        lo, hi = np.searchsorted(owner, some), np.searchsorted(owner, some, "right")
        barred = skipped[np.arange((hi - lo).sum()) + np.repeat(lo - np.cumsum(hi - lo) + hi - lo, hi - lo)]
        ids, at, size, spans, span_at, n = model.segment(symbols, begin[some], upto[some], states, barred, np.concatenate([[0], np.cumsum(hi - lo)]))
        chosen[live] = known + back
        pieces.append(ids)
        firsts_of.append(done + at)
        sizes_of.append(size)
        known, done = known + len(some), done + len(ids)
        if not limit:
            break
        n = n[back]
        spans = spans[np.arange(n.sum()) + np.repeat(span_at[back] - np.cumsum(n) + n, n)]
        who = np.repeat(live, n)
        hit = mixed(draw[who] ^ mixed(spans)) >> np.uint64(32) < limit
        who, spans = who[hit], spans[hit]
        live, cuts = np.unique(who, return_index=True)
        if len(live):
            state[live] += np.add.reduceat(mixed(spans ^ np.uint64(0x9E3779B97F4A7C15)), cuts)
        goes_on = np.isin(owner, live)
        owner, skipped = np.concatenate([owner[goes_on], who]), np.concatenate([skipped[goes_on], spans])
        order = np.argsort(owner, kind="stable")
        owner, skipped = owner[order], skipped[order]
    flat, at, size = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (pieces, firsts_of, sizes_of))
    size = size[chosen]
    ends_of = np.concatenate([[0], np.cumsum(size)])
    return flat[np.arange(ends_of[-1]) + np.repeat(at[chosen] - ends_of[:-1], size)], ends_of[firsts]


def decode_ids(model: MergeModel, ids: np.ndarray) -> str:
    """The text of piece ids: byte pieces become bytes, marks become spaces, and the leading space goes."""
    if not hasattr(model, "spelt"):
        model.spelt = [p.replace(SPACE, " ").encode() for p in model.pieces]
        for b, i in enumerate(model.bytes.tolist()):
            model.spelt[i] = bytes([b])
    return b"".join([model.spelt[i] for i in ids.tolist()]).decode("utf-8", "replace")[1:]


def encode_documents(docs: DataFrame, model_path: str, seed: int = 1, dropout: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, ids (array<int>), and text_ok: whether they decode to the very text.

    Null and empty texts have no ids, and decode to the empty text. Rows that repeat id and text get the same ids.
    """
    arrow_rows(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(id_col).alias("_key"), F.col(text_col).alias("_text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_state().get(f"pieces {model_path}") or MergeModel(model_path)
        worker_state()[f"pieces {model_path}"] = model
        for b in batches:
            texts = b.column(2)
            ids, offsets = encode_batch(model, texts, b.column(1).to_numpy(zero_copy_only=False), seed, dropout)
            good = [decode_ids(model, ids[lo:hi]) == (t or "") for t, lo, hi in zip(texts.to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist())]
            lists = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(good)], names=["_id", "ids", "text_ok"])

    kind = dict(rows.dtypes)["_id"]
    return rows.mapInArrow(encoded, f"_id {kind}, ids array<int>, text_ok boolean").withColumnRenamed("_id", id_col)


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of each row; null ids give a null text, an empty list an empty text."""
    arrow_rows(encoded.sparkSession)
    rows = encoded.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = MergeModel(model_path)
        for b in batches:
            texts = [None if x is None else decode_ids(model, np.array(x, np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["_id", "text"])

    return rows.mapInArrow(decoded, f"_id {dict(rows.dtypes)['_id']}, text string").withColumnRenamed("_id", id_col)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(input_rows(spark, sf_dir).select("doc_id", "text"), default_model())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), "text_ok")
