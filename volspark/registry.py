"""Registered queries of the volumetric operators, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from volspark.plans import composed, tiled  # noqa: F401  register their queries
from volspark.plans.registered import REGISTERED, finished, finished_sql


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    entry = REGISTERED[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return finished(entry.plan(spark, sf_dir), entry.spec)

    run.__name__ = name
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(name) for name in REGISTERED}


def oracle_sql() -> dict[str, str]:
    return {name: finished_sql(e.sql, e.spec) for name, e in REGISTERED.items() if e.sql}
