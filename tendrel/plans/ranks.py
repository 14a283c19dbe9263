"""Ranks and quantiles that analyses share: in Spark views over written tables, in the twin plain window functions."""

from __future__ import annotations

# Name: (rows, ORDER BY, what is summed up to each row).
RANKS = {
    "ranked_suppliers": ("SELECT * FROM supplier_totals", "value DESC, supplier_key", "value"),
    "ranked_allocations": ("SELECT supplier_key, value FROM usable_allocations", "value DESC, supplier_key", "value"),
    "ranked_procurements": ("SELECT ocid, tender_value FROM procurements WHERE tender_value IS NOT NULL", "tender_value DESC, ocid", "tender_value"),
    "ranked_buyer_values": ("SELECT coalesce(value, 0) AS v, count(*) AS n FROM overview GROUP BY coalesce(value, 0)", "v DESC", "n"),
    "ranked_buyer_awards": ("SELECT awards AS v, count(*) AS n FROM overview GROUP BY awards", "v DESC", "n"),
}
# Name: (rows with x and perhaps a key k, probabilities).
QUANTILES = {
    "tender_quantiles": ("SELECT tender_value AS x FROM procurements", (0.25, 0.5, 0.75)),
    "award_quantiles": ("SELECT award_value AS x FROM latest", (0.25, 0.95)),
    "dataset_quantiles": ("SELECT award_value AS x FROM dataset", (0.5,)),
    "method_group_quantiles": ("SELECT method_group AS k, award_value AS x FROM dataset", (0.5,)),
    "value_band_quantiles": ("SELECT value_band AS k, award_value AS x FROM dataset", (0.5,)),
    "duration_band_quantiles": ("SELECT duration_band AS k, award_value AS x FROM dataset", (0.5,)),
    "activity_band_quantiles": ("SELECT activity_band AS k, awards AS x FROM overview", (0.5,)),
    "buyer_quantiles": ("SELECT buyer_key AS k, award_value AS x FROM dataset", (0.5,)),
    "activity_value_quantiles": ("SELECT activity_band AS k, coalesce(value, 0) AS x FROM overview", (0.5,)),
    "segment_award_quantiles": ("SELECT segment AS k, awards AS x FROM overview", (0.5,)),
    "segment_value_quantiles": ("SELECT segment AS k, coalesce(value, 0) AS x FROM overview", (0.5,)),
    "buyer_award_quantiles": ("SELECT awards AS x FROM overview", (0.5,)),
    "buyer_value_quantiles": ("SELECT value AS x FROM overview", (0.95,)),
    "buyer_filled_value_quantiles": ("SELECT coalesce(value, 0) AS x FROM overview", (0.5,)),
}


def keyed(rows: str) -> bool:
    return " AS k," in rows


def twin_steps() -> dict[str, str]:
    out = {name: f"SELECT *, row_number() OVER (ORDER BY {order}) AS rn, sum({weight}) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS running FROM ({rows}) r" for name, (rows, order, weight) in RANKS.items()}
    for name, (rows, probabilities) in QUANTILES.items():
        found = ", ".join(f"quantile_cont(CAST(x AS DOUBLE), {p}) AS q{round(p * 100)}" for p in probabilities)
        out[name] = f"SELECT {'k, ' if keyed(rows) else ''}{found} FROM ({rows}) r" + (" GROUP BY k" if keyed(rows) else "")
    return out
