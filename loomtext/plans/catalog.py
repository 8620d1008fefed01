"""All queries of the core by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus, models, scores, titles

MODULES = (corpus, titles, scores, models)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q[0] for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q[1] for m in MODULES for name, q in m.QUERIES.items() if q[1]}
