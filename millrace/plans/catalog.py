"""Registry of queries and of the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fixtures import SCORES_SQL, TXN_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, view: str | None = None) -> Callable[[Query], Query]:
    """Register a query. ``view`` puts the transaction view (``txn``) or the scored
    view (``scored``) before the SQL, which may go on with further CTEs."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            text = sql.strip()
            if view:
                head = "WITH " + (SCORES_SQL if view == "scored" else TXN_SQL)
                text = f"{head}{'' if text.startswith(',') else ' '}{text}"
            ORACLES[name] = text
        return function

    return register


def rounded(name: str, digits: int = 6) -> Column:
    return F.round(F.col(name), digits).alias(name)


def load_all() -> None:
    """Import every module that registers queries."""
    from . import catalog_evaluation, catalog_features, catalog_quality, catalog_tables, catalog_training  # noqa: F401
