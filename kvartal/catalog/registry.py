"""Name, Spark query and oracle of each registered query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kvartal.catalog.views import view
from kvartal.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, **views: str):
    """Register ``fn(**frames)``; each keyword names a view text the function gets as a frame."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return fn(**{name: view(spark, sf_dir, sql) for name, sql in views.items()})

        QUERIES[fn.__name__] = run
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return wrap
