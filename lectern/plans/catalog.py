"""Every query of the library, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.plans import boxes, decoding, matches, models, published, records, reports, runs, scoring

MODULES = (scoring, decoding, records, boxes, runs, reports, matches, published, models)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for m in MODULES for f, sql in m.QUERIES.items() if sql}
