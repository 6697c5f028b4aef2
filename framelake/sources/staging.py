"""Tables for intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder, or in a temporary one where a one-machine session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="framelake-"))
        base = _own[0]
    return f"{base.rstrip('/')}/framelake/{uuid.uuid4().hex}/{name}"
