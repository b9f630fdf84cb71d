"""Session settings the engine relies on."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def build(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution."""
    b = SparkSession.builder.master(master).appName("tidemark").config("spark.sql.shuffle.partitions", str(partitions))
    b = b.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Python workers find this package where the driver's folder is not on their path."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
