"""All queries of the core package, by name."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evalframe.plans import oracle, queries as q

_HELPERS = {"specification_rows"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in vars(q).items() if inspect.isfunction(f) and f.__module__ == q.__name__ and not n.startswith("_") and n not in _HELPERS}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
