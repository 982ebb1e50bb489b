"""Running sums over keys of any size.

A window partitioned by the key alone would bring a hot key's rows to one task.
Here the rows are range-partitioned by key and order and numbered in chunks, so one
key may span many tasks. A running sum is then the sum inside the chunk plus the
key's earlier chunk totals, and only totals are gathered by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

CHUNK_BITS = 16
CHUNK = "_chunk"


def in_chunks(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with a chunk number that ascends with (key, order); at most 2^16 rows a chunk.

    ``order`` must be unique within the key. The numbering depends on the partition
    bounds, so it is written out once and not computed again.
    """
    placed = df.repartitionByRange(key, order).sortWithinPartitions(key, order)
    return cut(placed.withColumn(CHUNK, F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS)), "chunks")


def running_before(df: DataFrame, key: str, order: str, measures: dict[str, Column]) -> DataFrame:
    """Adds, per measure, its sum over the key's strictly earlier rows of a chunked frame."""
    inside = Window.partitionBy(key, CHUNK).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    totals = df.groupBy(key, CHUNK).agg(*[F.sum(m).alias(f"_t_{name}") for name, m in measures.items()])
    earlier = totals.select(
        key, CHUNK, *[F.coalesce(F.sum(f"_t_{name}").over(before), zero).alias(f"_e_{name}") for name in measures]
    )
    summed = df.select(
        "*", *[F.coalesce(F.sum(m).over(inside), zero).alias(f"_i_{name}") for name, m in measures.items()]
    )
    joined = summed.join(earlier, [key, CHUNK])
    helpers = [f"{p}{name}" for name in measures for p in ("_i_", "_e_")]
    for name in measures:
        joined = joined.withColumn(name, F.col(f"_i_{name}") + F.col(f"_e_{name}"))
    return joined.drop(*helpers)
