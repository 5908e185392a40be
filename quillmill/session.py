"""Making the package known to Python workers of a running session."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

FOLDER = str(Path(__file__).resolve().parent.parent)


def place(spark: SparkSession) -> SparkSession:
    """Let workers that see this folder import the package from it, whatever the driver's
    working directory. Elsewhere the package is installed, or sent with ``--py-files``."""
    environment = spark.sparkContext.environment
    have = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if FOLDER not in have:
        environment["PYTHONPATH"] = os.pathsep.join([*have, FOLDER])
    return spark


def placed(f: Callable) -> Callable:
    """``f``, whose first argument is the session, after ``place``."""

    @functools.wraps(f)
    def run(spark, *args):
        return f(place(spark), *args)

    return run
