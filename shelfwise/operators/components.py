"""Connected components of things that share keys, by hooking and pointer doubling.

Rows (thing, key) say that a thing has a key; things that share a key, directly or through
others, are one component. Every round gives each label the least label that any of its
keys meets through a thing, then follows those gifts to their end by doubling, so labels
at least halve in a round that changes any. The next round reads only what is still linked,
things with the labels they have by then, so the rounds together cost little more than the
first. Aggregations are minima, which combine on the map side, so a key of a third of all
rows is no obstacle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def _followed(gifts: DataFrame) -> DataFrame:
    """(label, least) with every chain of gifts followed to its end; a label's gift is never larger than it."""
    while True:
        ends = gifts.select(F.col("label").alias("_via"), F.col("least").alias("_next"))
        moved = gifts.join(ends, gifts["least"] == ends["_via"]).select("label", F.col("_next").alias("least"), (F.col("_next") < F.col("least")).alias("_moved"))
        moved = cut(moved, "followed")
        gifts = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            return gifts


def components(rows: DataFrame, thing: str, key: str) -> DataFrame:
    """(key, root) for every key of ``rows``: the component's least key."""
    links = cut(rows.select(F.col(thing).alias("thing"), F.col(key).alias("label")).distinct(), "links")
    labels = links.select("label").distinct()
    rounds: list[DataFrame] = []
    while True:
        met = links.groupBy("thing").agg(F.min("label").alias("least"), F.count("*").alias("_labels")).where("_labels > 1")
        gifts = cut(links.join(met, "thing").groupBy("label").agg(F.min("least").alias("least")), "gifts")
        if gifts.isEmpty():
            break
        rounds.append(_followed(gifts))
        # what nothing links any more has no gift and is left out
        links = cut(links.join(rounds[-1], "label").select("thing", F.col("least").alias("label")).distinct(), "links")
    placed = None
    for ends in reversed(rounds):  # from a label of a round to its label of the last
        if placed is not None:
            later = placed.select(F.col("label").alias("_via"), "root")
            ends = ends.join(later, ends["least"] == later["_via"], "left").select("label", F.coalesce("root", "least").alias("least"))
        placed = ends.withColumnRenamed("least", "root")
    if placed is None:
        return labels.select(F.col("label").alias(key), F.col("label").alias("root"))
    return labels.join(placed, "label", "left").select(F.col("label").alias(key), F.coalesce("root", "label").alias("root"))
