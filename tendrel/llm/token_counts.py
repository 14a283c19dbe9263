"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

In a SentencePiece BPE segmentation any two neighbours are, taken alone, segmented into just these two, and a row of pieces whose neighbours all have this
property is the segmentation of its text. So the last piece of a prefix is the one piece that ends there and goes with the last piece of the prefix before it,
and its count is that prefix's count plus one: one step a character, without agendas. Texts fall apart where a run of spaces begins and between
characters that no piece joins; distinct stretches between are worked out in order, so that shared beginnings count once, and added up along the text. Truncation and budgets are then
looked up in the counts, without encoding again.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import added, arrow_rows, input_rows, worker_state

MARK = "▁"
NEVER = 1 << 60
#: Stretches and pairs of pieces that a worker keeps.
TOTALS, PAIRS = 200_000, 400_000
#: Characters that are split into stretches at once: the more, the more of them share their beginnings.
SLICE = 1 << 22


class PrefixCounter:
    """Counts of a SentencePiece BPE model with byte fallback, identity normalisation and a space added in front."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        scores = {sp.id_to_piece(i).replace(MARK, " "): sp.get_score(i) for i in normal}
        place = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: place[s] for p, s in scores.items()}
        self.longest = max(map(len, self.rank))
        joined = {c for p in self.rank if len(p) > 1 for c in p}
        if any(c not in self.rank for c in joined) or any(" " in p.lstrip(" ") for p in self.rank):
            raise ValueError("pieces with spaces inside, or of characters that are no pieces, aren't supported")
        groups = _linked({p[k : k + 2] for p in self.rank for k in range(len(p) - 1) if p[k] != " "}, joined - {" "})
        inside = ["".join(re.escape(c) for c in sorted(g)) for g in sorted(groups, key=len, reverse=True)]
        self.stretches = re.compile("".join(f" *[{x}]+|" for x in inside) + f" +|[^ {''.join(inside)}]")
        self.tails = {p[k:]: False for p in self.rank for k in range(len(p))} | dict.fromkeys(self.rank, True)  # whether it's a piece itself
        self.runs: dict[str, tuple | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.totals = _Kept()

    def run(self, piece: str) -> tuple | None:
        """How ``piece`` is merged out of its characters: (rank of the next merge, first symbol, last symbol) before each merge and after the last. None if
        something else comes out."""
        if piece not in self.runs:
            symbols, states = list(piece), []
            while True:
                best = min(((self.rank.get(a + b, NEVER), k) for k, (a, b) in enumerate(zip(symbols, symbols[1:]))), default=(NEVER, 0))
                states.append((best[0], symbols[0], symbols[-1]))
                if best[0] == NEVER:
                    break
                symbols[best[1] : best[1] + 2] = [symbols[best[1]] + symbols[best[1] + 1]]
            self.runs[piece] = tuple(states) if len(symbols) == 1 else None
        return self.runs[piece]

    def go_together(self, a: str, b: str) -> bool:
        """Whether a text of the pieces ``a`` and ``b`` is segmented into these two: their merges go on in order of rank, from the left among equals, and none
        across the border comes first."""
        left, right, i, j = self.run(a), self.run(b), 0, 0
        if left is None or right is None:
            return False
        while True:
            (next_left, _, x), (next_right, y, _) = left[i], right[j]
            across = self.rank.get(x + y, NEVER)
            if across < next_left and across <= next_right and across < NEVER:
                return False
            if next_left == next_right == NEVER:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def learn(self, stretches: set[str]) -> dict[str, int]:
        """Tokens of all of some stretches."""
        found, missing = self.totals.find(stretches)
        last, counts, before, new = [""], [0], "", {}
        for stretch in sorted(missing):  # in order, so that what neighbours share at their beginnings is worked out once
            shared = 0
            for x, y in zip(before, stretch):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], counts[shared + 1 :]
            self._extend(stretch, last, counts)
            new[stretch] = counts[-1]
            before = stretch
        self.totals.keep(new)
        return found | new

    def prefixes(self, stretch: str) -> list[int]:
        """The number of tokens of each prefix of a stretch, from one character to all."""
        last, counts = [""], [0]
        self._extend(stretch, last, counts)
        return counts[1:]

    def _extend(self, stretch: str, last: list[str], counts: list[int]) -> None:
        """Go on to the end of ``stretch`` with the last pieces and counts of its prefixes."""
        pairs, tails = self.pairs, self.tails
        if len(pairs) > PAIRS:
            pairs.clear()
        if len(stretch) == 1 and stretch not in tails:
            last.append(stretch)
            counts.append(len(stretch.encode()))
            return
        for end in range(len(last), len(stretch) + 1):
            begin, first = end, end - 1 - len(last[-1])  # often the last piece goes on
            while True:
                if first >= 0:
                    begin, first, back = first, -1, end
                else:
                    begin, back = (back if back else begin) - 1, 0
                piece = stretch[begin:end]
                if not tails.get(piece):
                    continue
                if begin:
                    pair = last[begin], piece
                    fits = pairs.get(pair)
                    if fits is None:
                        fits = pairs[pair] = self.go_together(*pair)
                else:
                    fits = self.run(piece) is not None
                if fits:
                    last.append(piece)
                    counts.append(counts[begin] + 1)
                    break

    def slices(self, text: str) -> Iterator[list[str]]:
        """The stretches of a text with its added space, some at a time."""
        text = " " + text.replace(MARK, " ")
        at = 0
        while at < len(text):
            upto = len(text)
            if upto - at > SLICE:  # a border between stretches: before a space that follows something else
                m = _BORDER.search(text, at + SLICE)
                upto = m.start() + 1 if m else upto
            yield self.stretches.findall(text, at, upto)
            at = upto

    def count_all(self, texts: Sequence[str | None], limits: Sequence[int] = ()) -> list[tuple[int, list[int]]]:
        """Of each text its tokens, and for each limit the code points of its longest prefix with so many tokens at most."""
        out: list[tuple[int, list[int]]] = []
        waiting, size = [], 0
        for text in texts:
            if text and len(text) > SLICE:
                out += self._counts(waiting, limits) + [self._long(text, limits)]
                waiting, size = [], 0
                continue
            waiting.append(text)
            size += len(text or "")
            if size > SLICE:
                out += self._counts(waiting, limits)
                waiting, size = [], 0
        return out + self._counts(waiting, limits)

    def _counts(self, texts: list[str | None], limits: Sequence[int]) -> list[tuple[int, list[int]]]:
        parts = [self.stretches.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        known, out = self.learn(set().union(*parts)), []
        for text, part in zip(texts, parts):
            total = sum(map(known.__getitem__, part))
            fits = [len(text or "") if total <= k else max(0, self._within(part, known, 0, 0, k) - 1) for k in limits]  # without the added space
            out.append((total, fits))
        return out

    def _long(self, text: str, limits: Sequence[int]) -> tuple[int, list[int]]:
        total, chars, fits = 0, 0, [None] * len(limits)
        for part in self.slices(text):
            known = self.learn(set(part))
            more = sum(map(known.__getitem__, part))
            for k, limit in enumerate(limits):
                if fits[k] is None and total + more > limit:
                    fits[k] = max(0, self._within(part, known, total, chars, limit) - 1)
            total += more
            chars += sum(map(len, part))
        return total, [len(text) if f is None else f for f in fits]

    def _within(self, part: list[str], known: dict[str, int], total: int, chars: int, limit: int) -> int:
        """Of stretches that begin at ``chars`` with ``total`` tokens before them: the longest prefix with ``limit`` tokens. One that begins at the limit has more."""
        begin, before, own = chars, total, ""
        for stretch in part:
            if total >= limit:
                break
            begin, before, own = chars, total, stretch
            total += known[stretch]
            chars += len(stretch)
        return max((begin + k for k, n in enumerate(self.prefixes(own), 1) if before + n <= limit), default=begin) if own else begin

    def table(self, text: str | None) -> array:
        """The number of tokens of each prefix of a text, from none of its code points to all."""
        out, total, known = array("i"), 0, {}
        for part in self.slices(text) if text else ():
            for stretch in part:
                counts = known.get(stretch)
                if counts is None:
                    counts = known[stretch] = self.prefixes(stretch)
                out.extend([total + n for n in counts])
                total += counts[-1]
            known.clear()
        return array("i", [0]) + out[1:]


class _Kept:
    """Tokens of the stretches last seen, between TOTALS and twice as many."""

    def __init__(self):
        self.now: dict[str, int] = {}
        self.before: dict[str, int] = {}

    def find(self, wanted: set[str]) -> tuple[dict[str, int], set[str]]:
        """What is known of ``wanted``, and the rest."""
        found = {s: self.now[s] for s in wanted & self.now.keys()}
        again = {s: self.before[s] for s in (wanted - found.keys()) & self.before.keys()}
        self.keep(again)
        found |= again
        return found, wanted - found.keys()

    def keep(self, new: dict[str, int]) -> None:
        if len(self.now) > TOTALS:
            self.now, self.before = {}, self.now
        self.now |= new if max(map(len, new), default=0) <= 100 else {s: n for s, n in new.items() if len(s) <= 100}


_BORDER = re.compile("[^ ] ")


def _linked(pairs: set[str], chars: set[str]) -> list[set[str]]:
    """Groups of characters that stand together in pieces, directly or by others."""
    groups = {c: {c} for c in chars}
    for a, b in pairs:
        if groups[a] is not groups[b]:
            both = groups[a] | groups[b]
            groups |= dict.fromkeys(both, both)
    return list({id(g): g for g in groups.values()}.values())


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _counter(path: str) -> PrefixCounter:
    kept = worker_state()
    if ("prefixes", path) not in kept:
        kept["prefixes", path] = PrefixCounter(path)
    return kept["prefixes", path]


def _rows(docs: DataFrame, text_col: str, keep: Sequence[str] | None) -> DataFrame:
    arrow_rows(docs.sparkSession)
    names = docs.columns if keep is None else list(keep)
    return docs.select(*names, F.col(text_col).alias(added(names, "_counted")[0]))


def count_tokens(docs: DataFrame, limits: Sequence[int] = (), model: str | None = None, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with _n_tokens (long) and, for each limit, _fits_<limit> (long): the code points of the longest prefix
    that has so many tokens at most.

    Counts are those of the model's library for whole texts, without special tokens; strings of special tokens are text. A null or empty text has no tokens.
    Each row is counted by itself, repeated rows too; no rows give none. Names that are taken get underscores. A prefix may have more tokens than a longer one:
    the longest that fits counts. Memory goes with one text and its stretches of a slice; a stretch of any length takes time in proportion to it.
    """
    path, limits = model or default_model(), list(limits)
    rows = _rows(docs, text_col, keep)
    names = added(rows.columns[:-1], "_n_tokens", *[f"_fits_{k}" for k in limits])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for b in batches:
            found = counter.count_all(b.column(b.num_columns - 1).to_pylist(), limits)
            new = [pa.array([n for n, _ in found], pa.int64()), *[pa.array([f[k] for _, f in found], pa.int64()) for k in range(len(limits))]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], [*b.schema.names[:-1], *names])

    schema = rows.drop(rows.columns[-1]).schema
    for name in names:
        schema = schema.add(name, "long")
    return rows.mapInArrow(run, schema)


def prefix_counts(docs: DataFrame, model: str | None = None, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with _prefix_counts (array of int): the tokens of each prefix, from none of the text's code points to all.

    Written once, it answers ``tokens_upto`` and ``longest_within`` for any place or budget. Null and empty texts have the one count 0.
    """
    path = model or default_model()
    rows = _rows(docs, text_col, keep)
    name = added(rows.columns[:-1], "_prefix_counts")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for b in batches:
            for k in range(b.num_rows):  # one row at a time: four bytes for each code point
                counts = counter.table(b.column(b.num_columns - 1)[k].as_py())
                values = pa.Array.from_buffers(pa.int32(), len(counts), [None, pa.py_buffer(counts)])
                found = pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays([*[c.slice(k, 1) for c in b.columns[:-1]], found], [*b.schema.names[:-1], name])

    return rows.mapInArrow(run, rows.drop(rows.columns[-1]).schema.add(name, ArrayType(IntegerType())))


def tokens_upto(counts: Column, chars: Column | int) -> Column:
    """Of a column of prefix counts: the tokens of the first ``chars`` code points, of the whole text if it has fewer."""
    return F.get(counts, F.least(F.lit(chars) if isinstance(chars, int) else chars, F.size(counts) - 1))


def longest_within(counts: Column, limit: int) -> Column:
    """Of a column of prefix counts: the code points of the longest prefix with ``limit`` tokens at most."""
    places = F.sequence(F.lit(0), F.size(counts) - 1)
    return F.array_max(F.filter(places, lambda i: F.get(counts, i) <= limit))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, whether they pass 4,096, and how many code points of each fit in that."""
    docs = input_rows(spark, sf_dir).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    out = count_tokens(docs, limits=(4096,), keep=("doc_id", "n_bytes"))
    return out.select("doc_id", "n_bytes", F.col("_n_tokens").alias("n_tokens"), (F.col("_n_tokens") > 4096).alias("over_limit"), F.col("_fits_4096").alias("fits_chars"))
