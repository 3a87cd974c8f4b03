"""Registered queries: a builder (spark, folder) -> DataFrame and, where SQL can say it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import tune

Builder = Callable[[SparkSession, str], DataFrame]

BUILDERS: dict[str, Builder] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Builder], Builder]:
    def add(builder: Builder) -> Builder:
        name = builder.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return builder(tune(spark), folder)

        run.__name__ = name
        run.__doc__ = builder.__doc__
        BUILDERS[name] = run
        if sql is not None:
            SQL[name] = sql.strip()
        return builder

    return add
