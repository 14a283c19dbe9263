"""Substring dedup of passages: suffix automata of reference shards, matching statistics, maximal spans.

The reference of a document is every document with a smaller id, so the automata of all references together grow with the corpus and can't be sent to every
task. The reference is therefore sharded by the keys of ``routing``, under which a window and all its equals meet, and each shard's automaton goes to the one
task that holds the shard: it is built from the distinct passages of a key, every state knows the least document of its occurrences, and all distinct
passages stream through it for their matching statistics. What it says of a passage holds for every document that has it. Windows of full length mark their
words; marked words in a row form the maximal spans that are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import added, arrow_rows, input_rows
from .routing import CROWD, chunks, covered, keyed, repeated_windows, text_units, with_repeats

WORDS, GRAM, LONGEST = 50, 10, 128


class SuffixAutomaton:
    """Of several sequences; ``least[state]`` is the least document in which the strings of a state occur."""

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [None]

    def add(self, sequence: list[int], document) -> None:
        step, link, length, least = self.step, self.link, self.length, self.least
        last = 0
        for c in sequence:
            known = step[last].get(c)
            if known is not None and length[known] == length[last] + 1:
                last = known
            elif known is not None:
                last = self._split(last, c, known)
            else:
                new = len(step)
                step.append({})
                length.append(length[last] + 1)
                least.append(None)
                link.append(0)
                p = last
                while p >= 0 and c not in step[p]:
                    step[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = step[p][c]
                    link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
                last = new
            if least[last] is None or document < least[last]:
                least[last] = document

    def _split(self, p: int, c: int, q: int) -> int:
        step, link, length = self.step, self.link, self.length
        clone = len(step)
        step.append(dict(step[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.least.append(None)
        link[q] = clone
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = clone
            p = link[p]
        return clone

    def close(self) -> None:
        """Hand each state's least document up its suffix links."""
        least, link = self.least, self.link
        for s in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            up = link[s]
            if up > 0 and least[s] is not None and (least[up] is None or least[s] < least[up]):
                least[up] = least[s]

    def matches(self, sequence: list[int], most: int) -> Iterator[tuple[int, object]]:
        """After each element: the length of the longest suffix that the automaton has, ``most`` at most, and the least document that has it."""
        step, link, length, least = self.step, self.link, self.length, self.least
        s = have = 0
        for c in sequence:
            while s and c not in step[s]:
                s = link[s]
                have = length[s]
            if c in step[s]:
                s = step[s][c]
                have += 1
            if have > most:
                have = most
            while s and length[link[s]] >= have:
                s = link[s]
            yield have, least[s]


def solve_words(rows: list[dict], window: int = WORDS) -> Iterator[tuple[int, int, int, object]]:
    """For rows sorted by key, one a class of _c members from document _least on: (row, first, windows, least document) of runs of windows that stand in an
    earlier document, or, in a class of several members, in its least one."""
    first = 0
    while first < len(rows):
        upto = first + 1
        while upto < len(rows) and rows[upto]["_key"] == rows[first]["_key"]:
            upto += 1
        words = [np.frombuffer(r["_units"], np.int64).tolist() for r in rows[first:upto]]
        shard = SuffixAutomaton()
        for r, w in zip(rows[first:upto], words):
            shard.add(w, r["_least"])
        shard.close()
        for i in range(first, upto):
            own = rows[i]["_least"]
            if rows[i]["_c"] == 1 and own == rows[first]["_least"]:  # sorted by document within the key: none is earlier
                continue
            begin = before = None
            for k, (have, who) in enumerate(shard.matches(words[i - first], window)):
                if have < window or (who == own and rows[i]["_c"] == 1):
                    who = None
                if who != before:
                    if before is not None:
                        yield i, begin - window + 1, k - begin, before
                    begin, before = k, who
            if before is not None:
                yield i, begin - window + 1, len(words[i - first]) - begin, before
        first = upto


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WORDS, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """``docs`` with its text cut, and with _n_words and _n_removed (under ``common.added`` names where docs has such columns).

    A word goes if it lies in ``window`` consecutive words that also begin in a document with a smaller id; this is judged on the texts as they come. The words
    that stay keep what stood between them; where words went, one space stands. A text that loses nothing stays as it is. Rows of one id are one document and
    don't judge each other; rows with a null id are left whole and judge none. Null texts stay null. Other columns pass through.
    """
    arrow_rows(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    found = repeated_windows(rows, lambda r: solve_words(r, window), "words", window, gram, LONGEST, earlier=True, crowd=crowd)
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    whole = keyed(docs, id_col, text_col, rest)
    joined = with_repeats(whole, found)
    at = {c: joined.columns.index(c) for c in joined.columns}

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_words, n_removed = [], [], []
            for first, part in chunks(b.column(at["_text"])):
                _, firsts, raw, starts, ends = text_units(part, "words")
                wants = b.column(at["_found"]).slice(first, len(part)).to_pylist()
                for i, (text, found) in enumerate(zip(part.to_pylist(), wants)):
                    lo, hi = int(firsts[i]), int(firsts[i + 1])
                    gone = covered(hi - lo, found, window)
                    k = int(gone.sum())
                    n_words.append(hi - lo)
                    n_removed.append(k)
                    if k:
                        edge = np.flatnonzero(np.diff(np.concatenate([[1], gone, [1]])))
                        text = b" ".join(raw[starts[lo + x] : ends[lo + y - 1]].tobytes() for x, y in zip(edge[::2].tolist(), edge[1::2].tolist())).decode()
                    texts.append(text)
            keep = [b.column(at[c]) for c in ("_id", "_rest") if c in at]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[*[c for c in ("_id", "_rest") if c in at], "_text", "_n_words", "_n_removed"])

    schema = joined.select(*[c for c in ("_id", "_rest") if c in at], "_text", F.lit(0).cast("long").alias("_n_words"), F.lit(0).cast("long").alias("_n_removed")).schema
    out = joined.mapInArrow(strip, schema)
    back = {id_col: F.col("_id"), text_col: F.col("_text")} | {c: F.col("_rest")[c] for c in rest}
    n_words, n_removed = added(docs.columns, "_n_words", "_n_removed")
    return out.select(*[back[c].alias(c) for c in docs.columns], F.col("_n_words").alias(n_words), F.col("_n_removed").alias(n_removed))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_passages(input_rows(spark, sf_dir).select("doc_id", "text"))
    words = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != ""), " ")
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2(words.cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t WHERE len(w) >= 50)),
m AS (SELECT doc_id, i, h, min(doc_id) OVER (PARTITION BY h) AS lo FROM x),
d AS (SELECT DISTINCT doc_id, i FROM m WHERE lo < doc_id),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM t),
near AS (SELECT p.doc_id, p.word, p.pos, max(d.i) OVER (PARTITION BY p.doc_id ORDER BY p.pos) AS i FROM p LEFT JOIN d ON p.doc_id = d.doc_id AND p.pos = d.i),
g AS (SELECT doc_id, word, pos, coalesce(pos - i < 50, false) AS gone FROM near)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(s.n, 0)::BIGINT AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM t LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE gone) AS n, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM g GROUP BY doc_id) s ON t.doc_id = s.doc_id
"""
