"""Session for local runs, tests and the benchmark. On a cluster the submitter configures it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: str | int = 8, name: str = "shelfwise") -> SparkSession:
    steps = os.environ.get("CHECKPOINT_DIR")
    if not steps:
        steps = tempfile.mkdtemp(prefix="shelfwise-")
        atexit.register(shutil.rmtree, steps, ignore_errors=True)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE_PARTITIONS", "8"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", steps)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
