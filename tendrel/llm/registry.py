"""Queries of the text operators, and the SQL that gives the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    ann, filter_interactions, line_dedup, packing, piece_dropout, quality_classifier, quality_rules, simhash_dedup, source_divergence, substring_dedup, suffix_dedup, token_counts,
    url_filters,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        quality_rules.op1_host_rules, packing.op2_packing, piece_dropout.op3_merge_dropout, substring_dedup.op4_substring_dedup, url_filters.op5_url_filters,
        line_dedup.op6_line_dedup, suffix_dedup.op7_suffix_array_dedup, ann.op8_nearest_neighbours, quality_classifier.op9_quality_classifier,
        simhash_dedup.op10_simhash_near_dedup, token_counts.op11_token_counts, source_divergence.op12_source_divergence, filter_interactions.op13_filter_interactions,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_host_rules": quality_rules.OP1_SQL, "op4_substring_dedup": substring_dedup.OP4_SQL, "op5_url_filters": url_filters.OP5_SQL, "op6_line_dedup": line_dedup.OP6_SQL,
        "op12_source_divergence": source_divergence.OP12_SQL, "op13_filter_interactions": filter_interactions.OP13_SQL,
    }
