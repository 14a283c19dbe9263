"""Host-level quality rules.

Each document is measured and held against rules. Failures are summed by host and rule, every rate is shrunk towards the rates of all hosts by a beta prior
fitted to the hosts themselves (method of moments), and a host whose shrunken rate passes the limit of any rule is rejected; its verdict is joined back to
its documents. The host table is one row a host: counts are summed before the shuffle, so a host with a third of all rows costs one row a task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, cut, input_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: rule -> (condition of failure on a document, limit of a host's shrunken rate)
RULES = {
    "short": ("n_words < 50", 0.9),
    "repetition": ("100 * n_repeat_words > 50 * n_words", 0.5),
    "symbols": ("10 * n_symbols > n_words", 0.8),
    "dup_lines": ("n_dup_lines > 10 AND 20 * n_dup_lines > n_words", 0.8),
}
#: The rules that a document must pass itself.
BASE = ("short", "repetition")


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, and words in three-word windows found twice or more. A null text has none."""
    if not text:
        return 0, 0, 0, 0, 0
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, upto = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    return len(words), sum(map(len, words)), len(SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated


def _measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.concat([b[["_id", "_host"]], pd.DataFrame([measure(t) for t in b["_text"]], columns=MEASURES, index=b.index, dtype="int64")], axis=1)


def measure_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A row for each row of ``docs``: _id, _host, the measures. Whole texts; a null or empty one has zeros."""
    arrow_rows(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), F.col(text_col).alias("_text"))
    kinds = dict(rows.dtypes)
    return rows.mapInPandas(_measured, f"_id {kinds['_id']}, _host {kinds['_host']}, " + ", ".join(f"{m} long" for m in MEASURES))


def host_verdicts(failures: DataFrame, rules: dict = RULES, least_strength: float = 20.0) -> DataFrame:
    """One row a host: _n, shrunken rate by rule, _host_rejected.

    ``failures`` has _host and a boolean fail_<rule> for each rule. The prior of a rule is Beta(a, b) with the mean of all documents and the strength a+b
    that the spread of the hosts' rates implies, weighted by their documents; at least ``least_strength``, so that a host of a few documents is never judged
    by these alone. With one host, or none that differ, the strength is the least. A null host is a host of its own.
    """
    per_host = failures.groupBy("_host").agg(F.count("*").alias("_n"), *[F.sum(F.col(f"fail_{r}").cast("long")).alias(f"_k_{r}") for r in rules])
    rate = lambda r: F.col(f"_k_{r}") / F.col("_n")
    prior = per_host.agg(
        F.sum("_n").alias("_all"), F.count("*").alias("_hosts"),
        *[F.sum(f"_k_{r}").alias(f"_s_{r}") for r in rules],
        *[F.sum(F.col("_n") * rate(r) * rate(r)).alias(f"_q_{r}") for r in rules])
    one = F.lit(1).alias("_one")
    both = per_host.select("*", one).join(F.broadcast(prior.select("*", one)), "_one")  # the prior is one row
    out = [F.col("_host"), F.col("_n")]
    for r in rules:
        mean = F.col(f"_s_{r}") / F.col("_all")
        spread = F.col(f"_q_{r}") / F.col("_all") - mean * mean
        noise = mean * (1 - mean) * F.col("_hosts") / F.col("_all")  # what sampling alone would spread the rates
        between = F.greatest(spread - noise, F.lit(1e-12))
        strength = F.greatest(F.least(mean * (1 - mean) / between - 1, F.lit(1e6)), F.lit(least_strength))
        out.append(((F.col(f"_k_{r}") + strength * mean) / (F.col("_n") + strength)).alias(f"rate_{r}"))
    hosts = both.select(out)
    bad = F.lit(False)
    for r, (_, limit) in rules.items():
        bad = bad | (F.col(f"rate_{r}") > limit)
    return hosts.withColumn("_host_rejected", bad)


def apply_host_rules(docs: DataFrame, rules: dict = RULES, base: tuple = BASE, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """A row for each row of ``docs``: its id, the measures, base_failed, the host's rates, host_rejected and kept.

    A document is kept if it passes the base rules itself and its host isn't rejected. No rows give no rows.
    """
    measured = cut(measure_documents(docs, id_col, text_col, host_col), "measures")
    failures = measured.select("*", *[F.expr(f"coalesce({rule}, false)").alias(f"fail_{r}") for r, (rule, _) in rules.items()])
    hosts = host_verdicts(failures, rules)
    base_failed = F.lit(False)
    for r in base:
        base_failed = base_failed | F.col(f"fail_{r}")
    d, h = failures.alias("d"), hosts.alias("h")
    return d.join(h, F.col("d._host").eqNullSafe(F.col("h._host")), "left").select(
        F.col("d._id").alias(id_col), *[F.col(f"d.{m}") for m in MEASURES], base_failed.alias("base_failed"), *[F.col(f"h.rate_{r}") for r in rules],
        F.col("h._host_rejected").alias("host_rejected"), (~base_failed & ~F.col("h._host_rejected")).alias("kept"))


def op1_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_host_rules(input_rows(spark, sf_dir)).select("doc_id", *MEASURES, "base_failed", "kept")


_PRIOR = "\n".join(
    f""", p_{r} AS (SELECT host, (k_{r} + g * m) / (n + g) AS rate FROM (
  SELECT host, n, k_{r}, m, greatest(least(m * (1 - m) / greatest(q - m * m - m * (1 - m) * hosts / a, 1e-12) - 1, 1e6), 20.0) AS g FROM h,
    (SELECT sum(n)::DOUBLE AS a, count(*)::DOUBLE AS hosts, sum(k_{r})::DOUBLE / sum(n) AS m, sum(n * (k_{r}::DOUBLE / n) * (k_{r}::DOUBLE / n)) / sum(n) AS q FROM h)))"""
    for r in RULES)
OP1_SQL = rf"""
WITH w AS (SELECT doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g),
rep AS (SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS o FROM d WHERE c > 1) GROUP BY doc_id),
li AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
x AS (SELECT w.doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(li.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id LEFT JOIN li ON w.doc_id = li.doc_id),
h AS (SELECT host, count(*)::DOUBLE AS n, {', '.join(f"count(*) FILTER (WHERE {rule})::DOUBLE AS k_{r}" for r, (rule, _) in RULES.items())} FROM x GROUP BY host){_PRIOR},
v AS (SELECT p_short.host, {' OR '.join(f'p_{r}.rate > {limit}' for r, (_, limit) in RULES.items())} AS bad
  FROM p_short {' '.join(f'JOIN p_{r} ON p_short.host IS NOT DISTINCT FROM p_{r}.host' for r in list(RULES)[1:])})
SELECT x.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT v.bad AS kept
FROM x JOIN v ON x.host IS NOT DISTINCT FROM v.host
"""
