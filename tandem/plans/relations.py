"""Relations that are defined by SQL over other relations.

A definition names what it reads in braces. The same text becomes a tree of DataFrames for Spark, where Catalyst sees one plan,
or a chain of common table expressions for another engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

#: What Spark spells otherwise than the engine that checks it.
SPELLINGS = ((") IGNORE NULLS OVER", " IGNORE NULLS) OVER"), ("percentile(", "quantile_cont("))
_NAME = re.compile(r"\{(\w+)\}")
_EQUAL = re.compile(r"(\w+)\.(\w+) = (\w+)\.(\w+)")
_EQUALS = re.compile(rf"{_EQUAL.pattern}(?: AND {_EQUAL.pattern})+")


def reads(sql: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(sql)))


def on_episodes(sql: str) -> str:
    """sql with joins on an episode and more columns as joins on the episode, the other equalities ranges of one value.

    Both sides mostly lie by episode already. A join on all columns shuffles both anew; an episode's members and pairs are few, so they are compared where they are.
    """

    def spelled(chain: re.Match) -> str:
        parts = [m.groups() for m in _EQUAL.finditer(chain.group())]
        sides = {frozenset((a, b)) for a, x, b, y in parts if x == y == "episode"}
        ranged = lambda a, x, b, y: frozenset((a, b)) in sides and not x == y == "episode"
        return " AND ".join(f"{a}.{x} BETWEEN {b}.{y} AND {b}.{y}" if ranged(a, x, b, y) else f"{a}.{x} = {b}.{y}" for a, x, b, y in parts)

    return _EQUALS.sub(spelled, sql)


class Relations:
    """definitions: SQL by name, for any engine; on_spark: what Spark runs better for some of them, with the same rows: other SQL, or a function that gets one from SQL, and perhaps what else replaces relations in it, to a DataFrame."""

    def __init__(self, definitions: Mapping[str, str], on_spark: Mapping[str, str | Callable] | None = None) -> None:
        self.definitions, self.on_spark = dict(definitions), dict(on_spark or {})

    def order(self, names: Iterable[str]) -> list[str]:
        """The definitions that names need, each after what it reads."""
        found: dict[str, None] = {}

        def visit(name: str) -> None:
            if name in found or name not in self.definitions:
                return
            for n in reads(self.definitions[name]):
                visit(n)
            found[name] = None

        for n in names:
            visit(n)
        return list(found)

    def frame(self, spark: SparkSession, sql: str, tables: Mapping[str, DataFrame]) -> DataFrame:
        """The result of sql; tables holds what has no definition, and may replace what has one."""
        known = dict(tables)

        def resolve(text: str, own: Mapping[str, DataFrame] | None = None) -> DataFrame:
            if own:
                return self.frame(spark, text, {**known, **own})
            for n in reads(text):
                if n not in known:
                    how = self.on_spark.get(n, self.definitions[n])
                    known[n] = how(resolve) if callable(how) else resolve(how)
            return spark.sql(on_episodes(text), **{n: known[n] for n in reads(text)})

        return resolve(sql)

    def text(self, sql: str) -> str:
        """sql as one statement over the tables without a definition, in the other engine's spelling."""

        def plain(s: str) -> str:
            s = _NAME.sub(r"\1", s).strip()
            for found, other in SPELLINGS:
                s = s.replace(found, other)
            return s

        parts = [f"{n} AS ({plain(self.definitions[n])})" for n in self.order(reads(sql))]
        own = plain(sql)
        recursive = "RECURSIVE " if own.startswith("WITH RECURSIVE ") else ""
        if own.startswith("WITH "):
            parts, own = [*parts, own.removeprefix("WITH ").removeprefix(recursive)], ""
        return f"WITH {recursive}{', '.join(parts)} {own}" if parts else own
