"""Collects the core's queries and oracle SQL from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphmill.plans import boxes, detection, extras, multivalue, records, reviews, scores, texts

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (records, texts, boxes, detection, scores, reviews, extras, multivalue)


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
