"""All registered queries of the library with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .domain import table, with_views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


class Tables:
    """``t.docs`` is the domain table docs of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(sql: str | None = None, name: str | None = None):
    """Register a function of ``Tables`` under its name, with the SQL that gives the same rows."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or fn.__name__
        _QUERIES[key] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            _ORACLE[key] = with_views(sql)
        return fn

    return register


def _load() -> None:
    from . import claims, diffs, estate, evidence, flows, sequence  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)


def manifest() -> list[tuple[str, str, bool]]:
    """(name, family, whether SQL checks it) of every registered job."""
    _load()
    return [(name, name.split("_")[0], name in _ORACLE) for name in sorted(_QUERIES)]
