"""A corpus from documents to training sequences, in five stages that each write Parquet for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendrel.llm.common import added, cut, sized, text_key
from tendrel.llm.jaccard_dedup import near_copies
from tendrel.llm.line_dedup import drop_common_lines
from tendrel.llm.packing import default_tokenizer, pack_documents
from tendrel.llm.quality_classifier import classify
from tendrel.llm.simhash_dedup import near_duplicates
from tendrel.llm.substring_dedup import remove_repeated_passages

#: The stages make texts that no SQL gives; tests hold them against brute force.
ORACLE_SQL = None


def _as_documents(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with n_chars counted anew where there is such a column."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. Null and empty texts go."""
    kept = added(docs.columns, "_quality", "_n_words", "_kept")[2]
    return classify(docs).where(kept).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go. Documents stay, even with nothing left."""
    return _as_documents(drop_common_lines(docs, min_docs=10), docs)


def _one_of_each(docs: DataFrame, shingles: bool) -> DataFrame:
    """``docs`` without the rows that are linked to another one of a smaller id (of one id, of a smaller hash of the text). Each row is a document of its own,
    whatever its id: rows of one id with different texts stay. Rows without an id come after all others."""
    node = added(docs.columns, "_node")[0]
    rows = cut(docs.withColumn(node, F.monotonically_increasing_id()), "rows")  # written, so that the numbers stay
    near = near_duplicates(rows, id_col=node).where(F.col("_component") < F.col("_id"))
    near = cut(near.select(F.col("_id").alias("a"), F.col("_component").alias("b")).distinct(), "near")
    if shingles:
        groups = near_copies(rows, near, id_col=node)
    else:
        groups = near.select(F.col("a").alias("node"), F.col("b").alias("component")).union(near.select("b", "b").distinct())
    ids = rows.select(F.col(node).alias("node"), F.struct(F.col("doc_id").isNull(), "doc_id", text_key(F.col("text")), node).alias("place"))
    named = cut(groups.join(ids, "node"), "groups")
    first = cut(named.groupBy("component").agg(F.min("place").alias("first")), "first")
    gone = cut(named.join(first, "component").where("place > first").select(F.col("node").alias(node)), "gone")
    return rows.join(sized(gone), node, "left_anti").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with near fingerprints (op10's rule alone) the one with the least id stays."""
    return _one_of_each(docs, shingles=False)


def near_copies_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As ``near_dedup``, but documents are also linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    return _one_of_each(docs, shingles=True)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller id has go."""
    return _as_documents(remove_repeated_passages(docs), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and the window that each lies in."""
    return pack_documents(docs.select("doc_id", "text"), default_tokenizer(), with_ids=False)


STAGES = [("quality", quality), ("lines", lines), ("near_dedup", near_copies_dedup), ("passages", passages), ("packed", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
