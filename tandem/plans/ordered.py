"""Relations that order whole groups: window functions for another engine, and tandem.functions.orders on Spark."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions import orders
from tandem.sources.sinks import kept


@dataclass(frozen=True)
class OnSpark:
    """A relation whose rows Spark makes otherwise than by its SQL. on_spark gets a function from SQL over relations to a DataFrame."""

    sql: str
    on_spark: Callable[[Callable[[str], DataFrame]], DataFrame]


def _by(columns: Sequence[str]) -> str:
    return f"PARTITION BY {', '.join(columns)} " if columns else ""


def stored(source: str) -> OnSpark:
    """The rows of source, made once for all that read them in a query: what is joined on computed numbers must not be computed twice."""
    return OnSpark(source, lambda frame: kept(frame(source)))


def ordered(source: str, by: Sequence[str], order: Sequence[str], sums: Mapping[str, str] | None = None) -> OnSpark:
    """The rows of source with r, n_all, and of each of sums the running and the whole sum; see orders.in_order()."""
    sums = sums or {}
    over = f"OVER ({_by(by)}ORDER BY {', '.join(order)})"
    more = "".join(f", CAST(sum({x}) {over} AS BIGINT) AS {name}, CAST(sum({x}) OVER ({_by(by)}) AS BIGINT) AS {name}_all" for name, x in sums.items())
    sql = f"SELECT t.*, row_number() {over} AS r, count(*) OVER ({_by(by)}) AS n_all{more} FROM ({source}) t"
    return OnSpark(sql, lambda frame: orders.in_order(frame(source), by, order, {name: F.expr(x) for name, x in sums.items()}))


def counted(source: str, by: Sequence[str], value: str, weight: str = "1") -> OnSpark:
    """Distinct values with c, upto and c_all; see orders.counted()."""
    keys = ", ".join((*by, value))
    sql = f"SELECT {keys}, c, CAST(sum(c) OVER ({_by(by)}ORDER BY {value}) AS BIGINT) AS upto, CAST(sum(c) OVER ({_by(by)}) AS BIGINT) AS c_all FROM (SELECT {keys}, CAST(sum({weight}) AS BIGINT) AS c FROM ({source}) t GROUP BY {keys}) u"
    return OnSpark(sql, lambda frame: orders.counted(frame(source), by, value, F.expr(weight)))


def quantiles(source: str, by: Sequence[str], value: str, shares: Mapping[str, float]) -> OnSpark:
    """Exact percentiles of groups; see orders.quantiles()."""
    keys = ", ".join(by)
    found = ", ".join(f"percentile({value}, {p!r}e0) AS {name}" for name, p in shares.items())
    sql = f"SELECT {keys}{', ' if by else ''}{found} FROM ({source}) t{f' GROUP BY {keys}' if by else ''}"
    return OnSpark(sql, lambda frame: orders.quantiles(frame(source), by, value, shares))
