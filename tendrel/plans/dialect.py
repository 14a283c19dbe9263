"""SQL that Spark runs and its twin for checking: the few functions whose spelling differs."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def plus_days(self, ts: str, days: str) -> str:
        return f"({ts} + make_dt_interval(CAST({days} AS INT)))" if self.spark else f"({ts} + to_days(CAST({days} AS INTEGER)))"

    def seconds(self, ts: str) -> str:
        return f"CAST(unix_timestamp({ts}) AS DOUBLE)" if self.spark else f"CAST(epoch({ts}) AS DOUBLE)"

    def days(self, start: str, end: str) -> str:
        """Fractional days between two timestamps."""
        return f"(({self.seconds(end)} - {self.seconds(start)}) / 86400.0D)" if self.spark else f"(({self.seconds(end)} - {self.seconds(start)}) / CAST(86400.0 AS DOUBLE))"

    def joined(self, x: str, sep: str = ", ") -> str:
        """The distinct values of a group in order, null if there are none."""
        return f"nullif(array_join(array_sort(collect_set({x})), '{sep}'), '')" if self.spark else f"string_agg(DISTINCT {x}, '{sep}' ORDER BY {x})"

    def matches(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE '{pattern}')" if self.spark else f"regexp_matches({x}, '{pattern}')"

    def squeezed(self, x: str) -> str:
        """White-space runs as one space, none at the ends."""
        return f"trim(regexp_replace({x}, '[ \\t\\r\\n]+', ' '))" if not self.spark else f"trim(regexp_replace({x}, r'[ \\t\\r\\n]+', ' '))"


SPARK, TWIN = Dialect(True), Dialect(False)


def r2(x: str, digits: int = 2) -> str:
    """Rounded through a decimal, so that halves go the same way everywhere."""
    return f"CAST(round(CAST({x} AS DECIMAL(30,8)), {digits}) AS DOUBLE)"


def pct(a: str, b: str) -> str:
    return r2(f"100 * CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)")


def money(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def mean(x: str) -> str:
    return r2(f"CAST(sum({x}) AS DOUBLE) / nullif(CAST(count({x}) AS DOUBLE), 0)")


def n(x: str = "*", where: str | None = None) -> str:
    return f"count(CASE WHEN {where} THEN 1 END)" if where else f"count({x})"
