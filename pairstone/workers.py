"""Python workers: where they import this package from."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> None:
    """Put this package on the workers' path, for sessions that were started elsewhere."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join(x for x in [root, *have] if x)
