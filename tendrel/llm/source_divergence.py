"""How far the words of each source of a language are from those of its other sources and of the language.

Terms in too few documents are found by iceberg prefix refinement. Byte prefixes of 4, 8, 16 and more bytes are the levels. A prefix is in a document if any of
its terms begins with it, so a prefix of too few documents has no term of enough: level by level, only what extends a prefix that stayed is counted, and terms
that end within a level are decided there. One pass over the texts sums documents by level and key within a task, before anything is shuffled; a prefix is
counted once a document there, so sums of what tasks found are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, arrow_rows, cut, flat_text, input_rows, sized, word_bounds
from .routing import chunks

#: For bytes.translate: A-Z lower-cased, spaces for what ``[^\x00-\x40\x5B-\x60\x7B-\x7F]`` doesn't match in UTF-8; what stands between spaces is a term.
TERMS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in LOWER)
FIRST_LEVEL = 4
#: Occurrences of terms, and bytes of them, that a task holds before it sums them and hands them on.
KEYS, KEY_BYTES = 3_000_000, 64 << 20
#: Numbers of a block of the matrix of sources and terms.
BLOCK = 1_000_000
SCALE = 1_000_000_000

_SUMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("level", pa.int32()), ("key", pa.binary()), ("open", pa.bool_()), ("docs", pa.int64()), ("times", pa.int64())])


class _Sums:
    """Documents and occurrences by key of the rows since the last flush. Terms are held as they come, and numbered and counted at the flush, with numpy."""

    def __init__(self):
        self.words: list[pa.Array] = []
        #: of each document: language, source and number of words
        self.docs: tuple[list, list, list] = [], [], []
        self.held = 0

    def full(self) -> bool:
        return sum(map(len, self.words)) > KEYS or self.held > KEY_BYTES

    def add(self, langs: list, sources: list, texts: pa.Array) -> None:
        raw, offsets = flat_text(texts)
        raw = np.frombuffer(raw.tobytes().translate(TERMS), np.uint8)
        starts, ends, firsts = word_bounds(raw, offsets)
        ink = raw[raw != 32]
        at = np.concatenate([[0], np.cumsum(ends - starts)])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(ink)]).dictionary_encode()
        self.words.append(words)
        self.held += words.dictionary.nbytes
        for mine, new in zip(self.docs, (langs, sources, np.diff(firsts).tolist())):
            mine.extend(new)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.words:
            return
        words = pa.chunked_array(self.words).unify_dictionaries().combine_chunks()
        numbers, keys = words.indices.to_numpy(), words.dictionary.cast(pa.binary())
        counts = np.array(self.docs[2], np.int64)
        langs, sources = (pa.array(x, pa.string()).dictionary_encode() for x in self.docs[:2])
        lang_of, source_of = (x.indices.to_numpy().astype(np.int64) for x in (langs, sources))
        langs, sources = langs.dictionary, sources.dictionary
        self.__init__()

        groups, group_of = np.unique(lang_of * len(sources) + source_of, return_inverse=True)
        group_of = group_of.astype(np.int32)
        of_word = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        group, term, times = _split(group_of[of_word], numbers, len(keys))
        lang, source = groups[group] // len(sources), groups[group] % len(sources)
        # documents of a language stand with the first of its sources that has the term
        doc, own, _ = _split(of_word, numbers, len(keys))
        docs = np.zeros(len(term), np.int64)
        docs[np.unique(lang * len(keys) + term, return_index=True)[1]] = _split(lang_of[doc], own, len(keys))[2]
        sizes = pc.binary_length(keys).to_numpy()
        levels = np.full(len(keys), FIRST_LEVEL, np.int32)
        while (levels < sizes).any():
            levels[levels < sizes] *= 2
        yield from _batches(langs.take(pa.array(lang)), sources.take(pa.array(source)), levels[term], keys.take(pa.array(term)), False, docs, times)

        level = FIRST_LEVEL
        while (long := sizes > level).any():
            begun = pc.binary_slice(keys.filter(pa.array(long)), 0, level).dictionary_encode()
            of = np.full(len(keys), -1, np.int64)
            of[long] = begun.indices.to_numpy()
            prefix = of[own]
            each, prefix, _ = _split(doc[prefix >= 0], prefix[prefix >= 0], len(begun.dictionary))
            lang, prefix, docs = _split(lang_of[each], prefix, len(begun.dictionary))
            n = len(docs)
            yield from _batches(langs.take(pa.array(lang)), pa.nulls(n, pa.string()), np.full(n, level, np.int32), begun.dictionary.take(pa.array(prefix)), True, docs, np.zeros(n, np.int64))
            level *= 2


def _split(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of ``a`` and ``b``, in order, and how often each stands there; ``b`` is below ``size``."""
    both = a.astype(np.int64)
    both *= size
    both += b
    both.sort()
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    at = np.flatnonzero(new)
    return *np.divmod(both[at], max(size, 1)), np.diff(np.append(at, len(both)))


def _batches(langs: pa.Array, sources: pa.Array, levels: np.ndarray, keys: pa.Array, open_: bool, docs: np.ndarray, times: np.ndarray, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(keys), rows):
        n = len(keys[k : k + rows])
        yield pa.RecordBatch.from_arrays([
            langs.slice(k, n), sources.slice(k, n), pa.array(levels[k : k + rows]), keys.slice(k, n),
            pa.repeat(pa.scalar(open_), n), pa.array(docs[k : k + rows]), pa.array(times[k : k + rows]),
        ], schema=_SUMS)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = _Sums()
    for b in batches:
        langs, sources = b.column(0).to_pylist(), b.column(1).to_pylist()
        for first, part in chunks(b.column(2).cast(pa.large_binary()).view(pa.large_string())):
            sums.add(langs[first : first + len(part)], sources[first : first + len(part)], part)
            if sums.full():
                yield from sums.flush()
    yield from sums.flush()


def kept_terms(sums: DataFrame, min_docs: int) -> DataFrame:
    """(lang, key) of the terms in ``min_docs`` documents or more of a language, by refinement of the prefixes in ``sums``."""
    top = sums.agg(F.max("level")).first()[0] or 0
    level, alive, kept = FIRST_LEVEL, None, None
    while level <= top:
        rows = sums.where(F.col("level") == level)
        if alive is not None:
            rows = rows.withColumn("prefix", F.substring("key", 1, level // 2)).join(sized(alive, 300_000), ["lang", "prefix"], "left_semi")
        counted = cut(rows.groupBy("lang", "key", "open").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs"), "prefixes")
        terms = counted.where(~F.col("open")).select("lang", "key")
        kept = terms if kept is None else kept.union(terms)
        alive = counted.where("open").select("lang", F.col("key").alias("prefix"))
        if alive.isEmpty():
            break
        level *= 2
    return kept if kept is not None else sums.select("lang", "key").limit(0)


def _p(times: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (times + 1) / (total + terms)), exactly; 0 where there are no terms."""
    whole = (times.cast("decimal(20,0)") + F.lit(1).cast("decimal(1,0)")) * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(terms > 0, F.call_function("div", whole, (total + terms).cast("decimal(20,0)")) + 1).otherwise(F.lit(0))


def _distances(key, terms: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of floor((p - q)^2 / q) over the terms of one block, for every pair of a language's sources. Terms that a source lacks have its least p."""
    names, n = groups["source"].combine_chunks(), len(groups)
    keys = terms["key"].combine_chunks().dictionary_encode()
    total = np.zeros((n, n), np.int64)
    if len(keys):
        p = np.repeat(groups["least"].to_numpy()[:, None], len(keys.dictionary), axis=1)
        p[pc.index_in(terms["source"], names).to_numpy(), keys.indices.to_numpy()] = terms["p"].to_numpy()
        for k in range(n):
            gap = p[k][None, :] - p
            total[k] = (gap * gap // p).sum(axis=1)
    a, b = np.nonzero(~np.eye(n, dtype=bool))
    return pa.table({"lang": pa.repeat(key[0], len(a)), "source": names.take(pa.array(a)), "item": names.take(pa.array(b)), "value": total[a, b]})


def divergence(docs: DataFrame, min_docs: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: for each (lang, source) that occurs its distance from every other source of the language (part ``pair``) and its
    ``top`` most overused kept terms (part ``term``).

    Null texts, languages and sources are empty strings. Every row is a document, repeated rows too. A language without kept terms has pairs of value 0 and no
    terms; one source alone has no pairs; no rows give none. Ties go to the smaller item in UTF-8. Other columns play no part.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text"))
    sums = cut(rows.mapInArrow(_summed, "lang string, source string, level int, key binary, open boolean, docs long, times long"), "sums")
    kept = cut(kept_terms(sums, min_docs), "kept")
    # rows of a term meet once: for its sum in each source, and for that over all of them
    found = sums.where(~F.col("open")).select("key", "lang", "source", "times").join(kept, ["key", "lang"], "left_semi")
    every = F.sum("times").over(Window.partitionBy("key", "lang")).alias("every")
    counts = cut(found.groupBy("key", "lang", "source").agg(F.sum("times").alias("times")).select("*", every), "counts")

    totals = counts.groupBy("lang", "source").agg(F.sum("times").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "terms"])
    groups = groups.withColumn("whole", F.sum("total").over(Window.partitionBy("lang")))
    groups = cut(groups.withColumn("least", _p(F.lit(0), F.col("total"), F.col("terms"))), "groups")
    placed = counts.join(sized(groups, 300_000), ["lang", "source"]).withColumn("p", _p(F.col("times"), F.col("total"), F.col("terms")))

    # the matrix of sources and terms, in blocks of terms
    cells = groups.groupBy("lang").agg((F.count("*") * F.max("terms")).alias("n")).agg(F.sum("n")).first()[0] or 0
    blocks = -(-int(cells) // BLOCK) or 1
    of_block = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "source", "least")
    of_terms = placed.select("lang", "source", "key", "p", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"))
    apart = of_terms.groupBy("lang", "block").cogroup(of_block.groupBy("lang", "block")).applyInArrow(_distances, "lang string, source string, item string, value long")
    pairs = apart.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    over = placed.withColumn("q", _p(F.col("every"), F.col("whole"), F.col("terms"))).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("key").cast("string").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    return ranked.union(over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all sources and their 200 most overused terms, over all documents; terms in three documents of a language count."""
    return divergence(input_rows(spark, sf_dir).select("lang", "source", "text"), min_docs=3, top=200)


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
o AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(ws) AS term FROM d) GROUP BY r, lang, source, term),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(*) >= 3),
c AS (SELECT o.lang, o.source, o.term, sum(n)::HUGEINT AS n FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY o.lang, o.source, o.term),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.total + v.v) AS p
  FROM t JOIN v ON t.lang = v.lang JOIN k ON t.lang = k.lang LEFT JOIN c ON t.lang = c.lang AND t.source = c.source AND k.term = c.term),
q AS (SELECT x.lang, x.term, 1 + (1000000000::HUGEINT * (x.n + 1)) // (y.total + v.v) AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term) x JOIN (SELECT lang, sum(total)::HUGEINT AS total FROM t GROUP BY lang) y ON x.lang = y.lang JOIN v ON x.lang = v.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
over AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p.p - q.q) * (p.p - q.q)) // q.q)::BIGINT AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM over))
WHERE part = 'pair' OR rank <= 200
"""
