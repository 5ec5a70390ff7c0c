"""Registration of the checked queries: a Spark function and the SQL it must equal."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from registry.views import Views, oracle
from upswell.session import apply_conf, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, **extra: str):
    """Registers ``fn(views)`` under ``name``; ``sql`` may use views and ``extra`` ones."""

    def register(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            apply_conf(spark)
            return fn(Views(spark, folder))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql, extra)
        return fn

    return register


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the shared one, for tables a query lands and reads back."""
    return f"{shared_dir(spark)}/upswell-{what}-{uuid.uuid4().hex}"
