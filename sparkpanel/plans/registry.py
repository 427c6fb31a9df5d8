"""All queries of the core by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import builders, evidence, experiments, panels, quality, release, texts

MODULES = (quality, panels, experiments, texts, evidence, release, builders)
FLAGSHIP = "risk_flag_pairwise"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
