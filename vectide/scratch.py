"""Where tables that an operation writes for itself go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from .errors import InvalidConfig


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; without one only a local master may go on, in a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise InvalidConfig("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vectide-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/vectide-{name}-{uuid.uuid4().hex}"
