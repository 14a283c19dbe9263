"""The layer under the analyses: steps that a statement needs more than once are written once, with the columns that are read, and all else is one plan.

A statement names steps after FROM and JOIN. How often each would be worked out if all were pasted in follows from the number of times that it is named and how
often those that name it are; a step of ``SHARED`` that would be worked out twice is written. Ranks and quantiles are always written tables.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendrel.operators.ranking import quantiles, ranked, settle

from . import ranks
from .dialect import SPARK
from .tables import steps

SOURCES = ("orders", "lineitem", "customer", "supplier")
#: Steps with windows, joins or aggregates of whole tables; what only scans a table and works out columns is quicker done again.
SHARED = frozenset((
    "award_versions", "latest_lines", "keyed_names", "link_facts", "raw_links", "keyed_links", "suppliers", "award_suppliers", "link_counts", "allocated", "supplier_totals", "award_counts", "allocations", "usable_allocations",
    "score_v1", "score_v2", "score_v3", "dataset", "buyers", "buyer_facts", "overview",
))
_NAMED = re.compile(r"\b(FROM|JOIN)(\s+)([a-z_0-9]+)\b")


def _texts() -> dict[str, str]:
    return steps(SPARK) | {name: rows for name, (rows, *_) in ranks.RANKS.items()} | {name: rows for name, (rows, _) in ranks.QUANTILES.items()}


class Layer:
    """What one statement needs, over the tables in ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.texts = spark, sf_dir, _texts()
        self.views: dict[str, str] = {}

    def names(self, text: str) -> Counter:
        return Counter(m[3] for m in _NAMED.finditer(text) if m[3] in self.texts)

    def needed(self, text: str) -> list[str]:
        """All steps under a statement, each after those that it names; what is written already has none under it."""
        out: list[str] = []

        def visit(name: str) -> None:
            if name not in out:
                for below in self.names(self.texts[name]) if name not in self.views else ():
                    visit(below)
                out.append(name)

        for name in self.names(text):
            visit(name)
        return out

    def above(self, name: str, needed: list[str]) -> list[str]:
        """The steps of a statement that read ``name``, or read a step that does: what is under it can't ask for its columns."""
        out = {name}
        for step in needed:  # each comes after those that it names
            if not out.isdisjoint(self.names(self.texts[step])):
                out.add(step)
        return [x for x in needed if x in out and x != name]

    def written(self, statement: str) -> set[str]:
        """The steps to write for a statement."""
        needed, times, found = self.needed(statement), self.names(statement), set()
        for name in reversed(needed):
            if name in ranks.RANKS or name in ranks.QUANTILES or (times[name] > 1 and name in SHARED):
                found.add(name)
            for below, n in self.names(self.texts[name]).items():
                times[below] += n if name in found else n * times[name]
        return found

    def frame(self, statement: str) -> DataFrame:
        """The statement's result. Runs the jobs that write its steps; the views made for them are dropped again."""
        try:
            wanted, needed = self.written(statement), self.needed(statement)
            for name in needed:
                if name in wanted:
                    above = self.above(name, needed)
                    self.write(name, [statement, *[self.texts[x] for x in above], *[ranks.RANKS[x][1] for x in above if x in ranks.RANKS]])
            return self.sql(statement)
        finally:
            for view in self.views.values():
                self.spark.catalog.dropTempView(view)

    def write(self, name: str, others: list[str]) -> None:
        """Write a step with those of its columns that the ``others`` of the statement name."""
        rows = self.sql(self.texts[name])
        if name in ranks.RANKS:
            _, order, weight = ranks.RANKS[name]
            rows = ranked(rows, [F.desc(c.split()[0]) if c.endswith(" DESC") else F.asc(c) for c in order.split(", ")], weight)
        elif name in ranks.QUANTILES:
            rows = settle(quantiles(rows, "x", ranks.QUANTILES[name][1], ["k"] if ranks.keyed(self.texts[name]) else []))
        else:
            words = set(re.findall(r"[a-z_0-9]+", " ".join(others)))
            rows = settle(rows.select(*[c for c in rows.columns if c in words]))
        self.view(name, rows)

    def view(self, name: str, rows: DataFrame) -> str:
        self.views[name] = f"_{name}_{uuid.uuid4().hex}"  # no name of the caller's
        rows.createOrReplaceTempView(self.views[name])
        return self.views[name]

    def sql(self, text: str) -> DataFrame:
        pasted = [x for x in self.needed(text) if x not in self.views]
        whole = f"WITH {', '.join(f'{x} AS ({self.texts[x]})' for x in pasted)} {text}" if pasted else text
        for m in list(_NAMED.finditer(whole)):
            if m[3] in SOURCES and m[3] not in self.views:
                self.view(m[3], self.spark.read.parquet(f"{self.sf_dir}/{m[3]}.parquet"))
        return self.spark.sql(_NAMED.sub(lambda m: f"{m[1]}{m[2]}{self.views.get(m[3], m[3])}", whole))
