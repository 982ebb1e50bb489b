"""A balance that never goes below zero: a request that asks for too much uses nothing.

Whether a request passes depends on every earlier one of its key, so a plain running
sum is wrong. The key's rows are cut into chunks of bounded size. A chunk turns a
start balance into an end balance. From ``need`` up, the largest deficit of its running
sum, everything passes and the end is the start plus ``net``; below, the chunk has to
be run. All chunks begin from guessed starts. Each round runs the chunks whose start is
new and too low, then passes balances on along the key: through chunks where all
passes by adding their net, from any other by the end it reached. It stops when no
start changes; then each chunk starts from its predecessor's end, the first from the
truth. A round makes at least one more chunk of a key final.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .running import CHUNK, in_chunks


def _end_balance():
    """End balance of one chunk, folded over its ordered movements."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct("_order", "delta"))), lambda s: s["delta"])
    return F.aggregate(
        steps,
        F.first("_start"),
        lambda balance, delta: F.when(balance + delta >= 0, balance + delta).otherwise(balance),
    )


def _replayer():
    """The per-chunk replay, a closure so that it travels to executors without this package."""

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_order")
        balance = int(rows["_start"].iloc[0])
        passed, after = [], []
        for delta in rows["delta"].tolist():
            ok = balance + delta >= 0
            balance += delta if ok else 0
            passed.append(ok)
            after.append(balance)
        return rows[["key", "_order", "delta"]].assign(accepted=passed, balance=after)

    return replay


def guarded_balance(moves: DataFrame, key: str, order: str, delta: str, opening: DataFrame | None = None) -> DataFrame:
    """Decision and balance after each movement: (key, order, delta, accepted, balance).

    ``delta`` is positive for receipts and negative for issues; ``order`` is a number,
    unique within its key; ``opening`` holds (key, opening balance), zero by default.
    """
    plain = moves.select(
        F.col(key).alias("key"), F.col(order).cast("bigint").alias("_order"), F.col(delta).cast("bigint").alias("delta")
    )
    rows = in_chunks(plain, "key", "_order")
    so_far = F.sum("delta").over(Window.partitionBy("key", CHUNK).orderBy("_order"))
    totals = (
        rows.withColumn("_sum", so_far)
        .groupBy("key", CHUNK)
        .agg(F.sum("delta").alias("net"), F.greatest(-F.min("_sum"), F.lit(0)).alias("need"))
    )
    zero = F.lit(0).cast("bigint")
    if opening is None:
        totals = totals.withColumn("opening", zero)
    else:
        known = opening.toDF("key", "opening").withColumn("opening", F.col("opening").cast("bigint"))
        totals = totals.join(known, "key", "left").withColumn("opening", F.coalesce("opening", zero))
    along = Window.partitionBy("key").orderBy(CHUNK)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    guess = F.greatest(F.col("opening") + F.coalesce(F.sum("net").over(before), zero), zero)
    summary = ["key", CHUNK, "net", "need", "opening"]
    chunks = cut(totals.select(*summary, guess.alias("_start"), F.lit(None).cast("bigint").alias("_end")), "guard")
    passes_all = F.col("_start") >= F.col("need")
    while True:
        due = chunks.filter(F.col("_end").isNull() & ~passes_all).select("key", CHUNK, "_start")
        ends = rows.join(due, ["key", CHUNK]).groupBy("key", CHUNK).agg(_end_balance().alias("_run_end"))
        ran = chunks.join(ends, ["key", CHUNK], "left").withColumn(
            "_end", F.when(passes_all, F.col("_start") + F.col("net")).otherwise(F.coalesce("_run_end", "_end"))
        )
        # The last chunk behind that does not pass everything, and what is added since.
        held = F.last(F.when(~passes_all, F.struct(CHUNK, "_end")), ignorenulls=True).over(before)
        net_before = F.coalesce(F.sum("net").over(before), zero)
        marked = ran.withColumn("_held", held).withColumn("_net_before", net_before)
        net_then = F.last(F.when(~passes_all, F.col("_net_before") + F.col("net")), ignorenulls=True).over(before)
        handed = F.coalesce(F.col("_held._end"), F.col("opening")) + F.col("_net_before") - F.coalesce("_net_then", zero)
        chunks = cut(
            marked.withColumn("_net_then", net_then)
            .withColumn("_next", handed)
            .select(
                *summary,
                F.when(F.col("_next") == F.col("_start"), F.col("_end")).alias("_end"),
                F.col("_next").alias("_start"),
            ),
            "guard",
        )
        if chunks.filter(F.col("_end").isNull()).isEmpty():
            break
    # Where a chunk starts with at least what it needs, every movement passes and the
    # balance is the start plus the sum so far; only the other chunks are run in order.
    done = chunks.select("key", CHUNK, "_start", (F.col("_start") >= F.col("need")).alias("_passes"))
    placed = rows.join(done, ["key", CHUNK])
    summed = placed.filter("_passes").select(
        "key", "_order", "delta", F.lit(True).alias("accepted"), (F.col("_start") + so_far).alias("balance")
    )
    replayed = (
        placed.filter(~F.col("_passes"))
        .drop("_passes")
        .groupBy("key", CHUNK)
        .applyInPandas(_replayer(), "key bigint, _order bigint, delta bigint, accepted boolean, balance bigint")
    )
    return summed.unionByName(replayed).withColumnsRenamed({"key": key, "_order": order, "delta": delta})
