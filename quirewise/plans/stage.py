"""Tables between the steps of a plan.

A step that several others read is written once to the session's shared checkpoint folder: its work isn't
repeated, later steps plan from a scan, and a lost executor costs a step, not the plan.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame

#: A written step needs its shuffle files no more: Spark removes them at the end of the write.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    path = f"{base.rstrip('/')}/quirewise-plan-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
