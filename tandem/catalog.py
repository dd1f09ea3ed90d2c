"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tandem.plans.ordered import OnSpark
from tandem.plans.relations import Relations
from tandem.sources.tables import MODEL, MODEL_ON_SPARK, Tables

#: Modules with OPERATORS (SQL over the model, by name), and perhaps RELATIONS (more relations), QUERIES (functions of Spark and
#: the folder) and ORACLES (SQL for those, and other SQL for operators).
MODULES = ("scalars", "joins", "episodes", "interactions", "features", "roles", "pairs", "windows", "ranking", "decoders", "mixtures", "learning", "metrics", "contracts")


def _modules() -> list:
    return [import_module(f"tandem.operators.{m}") for m in MODULES]


def relations() -> Relations:
    found, on_spark = dict(MODEL), dict(MODEL_ON_SPARK)
    for m in _modules():
        for name, how in getattr(m, "RELATIONS", {}).items():
            found[name] = how.sql if isinstance(how, OnSpark) else how
            if isinstance(how, OnSpark):
                on_spark[name] = how.on_spark
    return Relations(found, on_spark)


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    sql = next(m.OPERATORS[name] for m in _modules() if name in m.OPERATORS)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return relations().frame(spark, sql, Tables(spark, sf_dir))

    run.__name__ = name
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {}
    for m in _modules():
        found |= {n: query(n) for n in m.OPERATORS} | getattr(m, "QUERIES", {})
    return found


def oracle_sql() -> dict[str, str]:
    all_, found = relations(), {}
    for m in _modules():
        found |= {n: all_.text(sql) for n, sql in m.OPERATORS.items()} | {n: all_.text(sql) for n, sql in getattr(m, "ORACLES", {}).items()}
    return found
