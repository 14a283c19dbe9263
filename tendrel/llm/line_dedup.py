"""Line dedup: lines that many documents share go from all of them.

Each text is exploded to its lines, and each line becomes a 128-bit hash of its normalised form with its position, once. Distinct documents are counted by
hash; the positions of lines whose hash is common are gathered by document, and the text, which is shuffled once, drops these positions and keeps the others
in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, added, ascii_lower, cut, input_rows, text_key


def drop_common_lines(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its text replaced, and with _n_lines and _n_dropped (under ``common.added`` names where docs has such columns).

    A line counts once for each document that has it, however often it stands there; rows of one id are one document. Lines of rows with a null id don't count,
    but go if they are common. A null text is one empty line and comes back as an empty text; a text of common lines alone also ends empty. Other columns
    pass through, whatever their names.
    """
    kept = [c for c in docs.columns if c not in (id_col, text_col)]
    n_lines, n_dropped = added(docs.columns, "_n_lines", "_n_dropped")
    rows = docs.select(
        F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("_tk"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        F.struct(*kept).alias("_rest") if kept else F.lit(None).cast("int").alias("_rest"),
    )
    lines = F.split(F.col("_text"), "\n", -1)
    key = ascii_lower(F.btrim("_line", F.lit(SPACES)))
    # Written once: what follows reads hashes, not texts, and both sides of the joins are plain tables, so that Spark may split a line that very many documents share.
    hashed = rows.select("_id", "_tk", F.posexplode(lines).alias("_pos", "_line")).select(
        "_id", "_tk", "_pos", F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit(7), key).alias("_h2"), (F.length(key) > 0).alias("_ink"))
    hashed = cut(hashed, "lines").where("_ink").drop("_ink")
    common = cut(hashed.groupBy("_h1", "_h2").agg(F.count_distinct("_id").alias("_n")).where(F.col("_n") >= min_docs).select("_h1", "_h2"), "common")
    hits = hashed.join(common, ["_h1", "_h2"], "left_semi").groupBy("_id", "_tk").agg(F.collect_list("_pos").alias("_gone"))
    found = rows.alias("r").join(
        hits.alias("c"), F.col("r._id").eqNullSafe(F.col("c._id")) & F.col("r._tk").eqNullSafe(F.col("c._tk")), "left",
    ).select("r.*", "c._gone")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    stay = F.when(F.col("_gone").isNull(), lines).otherwise(F.transform(places, lambda i: F.get(F.col("_lines"), i)))
    out = found.withColumn("_lines", lines).select("_id", "_rest", F.size("_lines").cast("long").alias("_n_lines"), stay.alias("_stay"))
    return out.select(
        F.col("_id").alias(id_col), F.array_join("_stay", "\n").alias(text_col), *[F.col("_rest")[c].alias(c) for c in kept],
        F.col("_n_lines").alias(n_lines), (F.col("_n_lines") - F.size("_stay")).alias(n_dropped),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(input_rows(spark, sf_dir).select("doc_id", "text"), min_docs=10)
    return out.select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").cast("long").alias("n_dropped"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT doc_id, line, pos,
  translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.doc_id, k.line, k.pos, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
