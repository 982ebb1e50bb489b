"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def work_root(spark: SparkSession) -> str:
    """Folder for intermediate tables, the same for the driver and every executor.

    It is the session's ``spark.checkpoint.dir``; where a session has none, a folder in
    its warehouse, which is shared as well.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_steps").rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    return f"{work_root(spark)}/shelfwise/{label}-{uuid4().hex}"


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """Write the rows out and read them back.

    A written table is computed once, survives the loss of any executor, is read back
    by the column, and tells the optimizer its real size.
    """
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
