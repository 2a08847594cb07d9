"""Python workers that find this package."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parents[2])


def found_by_workers(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``function(spark, ...)`` after its workers were told where the package is.

    A session that was started elsewhere gives its workers no path to it.  On a
    cluster the package is installed at the same place, or shipped.
    """

    @functools.wraps(function)
    def run(spark: SparkSession, *args) -> DataFrame:
        environment = spark.sparkContext.environment
        paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if _ROOT not in paths:
            environment["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])
        return function(spark, *args)

    return run
