"""Role rules applied to a log of requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import DEFAULT_ROLE, ROLE_PERMISSIONS
from ..functions.values import text_or


def _checked(requests: DataFrame) -> DataFrame:
    """Adds the effective role and whether its list holds the permission."""
    granted = [
        (F.col("role") == role) & F.col("permission").isin(permissions) for role, permissions in ROLE_PERMISSIONS.items()
    ]
    allowed = reduce(Column.__or__, granted)
    return requests.withColumn("role", text_or("role", DEFAULT_ROLE)).withColumn(
        "_allowed", F.coalesce(allowed, F.lit(False))
    )


def allowed(requests: DataFrame) -> DataFrame:
    return _checked(requests).filter("_allowed").drop("_allowed")


def denied(requests: DataFrame) -> DataFrame:
    """Refused requests with the answer the caller gets."""
    message = F.concat(
        F.lit("Access Denied: Role '"), F.col("role"), F.lit("' does not have '"), F.col("permission"),
        F.lit("' permission."),
    )
    return _checked(requests).filter(~F.col("_allowed")).drop("_allowed").withColumn("error", message)
