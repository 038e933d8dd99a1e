"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import SparkSession

#: Only for sessions in one process without a shared folder, as in tests; gone when the process ends.
OWN_FOLDER = f"/tmp/checkpoints/sketchloom-{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where the session has none and runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        atexit.unregister(_clear)
        atexit.register(_clear)
        found = f"file://{OWN_FOLDER}"
    return found.rstrip("/")


def _clear() -> None:
    shutil.rmtree(OWN_FOLDER, ignore_errors=True)
