"""All registered queries of the library, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) under its own name, with SQL that gives the same rows."""

    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def _load() -> None:
    from .plans import activity, alignment, beats, bouts, circadian, files, gait, heart, records, series, signals, streams, wear  # noqa: F401


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: gaps and effective duration of every participant's recording."""
    _load()
    return _QUERIES["disconnection_report"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
