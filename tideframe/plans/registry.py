"""All registered market-data queries: name -> callable(spark, sf_dir), and their DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.sources.adapters import oracle, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *views: str, sql: str | None = None):
    """Register f(*views as DataFrames); a function without views gets (spark, sf_dir)."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[table(spark, sf_dir, v) for v in views]) if views else f(spark, sf_dir)

        run.__name__, run.__doc__ = name, f.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return f

    return add


def r6(*names: str | Column) -> list[Column]:
    """Columns rounded to 6 places, by name: sums in another order differ after that."""
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


for _module in ("candle_queries", "flow_queries", "fund_queries", "book_queries", "risk_queries", "quality_queries", "stream_queries"):
    importlib.import_module(f"tideframe.plans.{_module}")
