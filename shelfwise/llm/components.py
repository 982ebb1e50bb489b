"""Connected components of a link table, by alternating star contraction.

Every round hangs a node's larger neighbours, then its smaller ones, on the smallest node
in reach, so the number of rounds grows with the logarithm of the longest chain. Nodes and
links stay distributed; each half round is written out, so a lost executor costs one step,
and joins read written tables, whose hot keys Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut


def _hang(links: DataFrame, both_ways: bool) -> DataFrame:
    """Links (u, v) with u > v, each node's neighbours moved to its smallest one."""
    seen = links
    if both_ways:
        seen = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    joined = seen.join(least, "u")
    if both_ways:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return cut(moved.where("u <> v").distinct(), "stars")


def _digest(links: DataFrame) -> tuple:
    # the sum is taken in decimal: hashes of many links do not fit a long
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def roots(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node that is not its component's smallest node.

    ``links`` has two columns u and v of one ordered type; loops and repeats do no harm.
    No links give no rows.
    """
    ordered = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    state = cut(ordered, "links")
    digest = _digest(state)
    while digest[0]:
        state = _hang(_hang(state, both_ways=True), both_ways=False)
        now = _digest(state)
        if now == digest:
            break
        digest = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
