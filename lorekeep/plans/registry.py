"""Names of the engine's own queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorekeep.plans import core, more, state, webs, words  # noqa: F401 - the others register their queries with the first


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(core.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(core.SQL)
