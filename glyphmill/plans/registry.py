"""The registered queries of the package, without its optional parts."""

from __future__ import annotations

from collections.abc import Callable
from inspect import isfunction

from pyspark.sql import DataFrame, SparkSession

from glyphmill.plans import oracles
from glyphmill.plans import queries as module


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in vars(module).items() if isfunction(f) and f.__module__ == module.__name__ and not name.startswith("_") and name != "table"}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
