"""Streams that carry one balance per key, in Spark's own keyed state.

A key's balance is a value in the state store; a micro-batch reads and writes the keys it
brings and no others, and a restart goes on from the checkpoint. What a key's movements do
depends on their order, so a micro-batch's movements of one key are taken in order by one
task. The source's bound on a micro-batch (``runs.BYTES_PER_TRIGGER``) bounds them too.
For a whole table at once, with keys of any size, ``operators.guard`` is the batch form.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.values import big, signed_units
from .runs import keyed_state

#: Rows that a task hands on at a time.
ROWS = 100_000
#: Parts that products are dealt to; a part's products are taken by one call. Stored balances depend on it.
PARTS = 1024


def _in_slices(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for at in range(0, len(rows), ROWS):
        yield rows.iloc[at : at + ROWS]


class _Balance(StatefulProcessor):
    """One balance per key; an opening one may be given when the stream first starts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("balance", "balance bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.held.update((int(initialState["balance"].iloc[0]),))

    def balance(self, otherwise: int) -> int:
        return self.held.get()[0] if self.held.exists() else otherwise

    def close(self) -> None:
        pass


class _Guard(_Balance):
    """A movement that asks for more than the balance uses nothing."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        moves = pd.concat(list(rows)).sort_values("order")
        balance, passed, after = self.balance(0), [], []
        for delta in moves["delta"].tolist():
            ok = balance + delta >= 0
            balance += delta if ok else 0
            passed.append(ok)
            after.append(balance)
        self.held.update((balance,))
        yield from _in_slices(moves[["key", "order", "delta"]].assign(accepted=passed, balance=after))


class _Crossings(StatefulProcessor):
    """The movements that take a product's stock from above its level to it or below, for the products of one part at a time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("balances", "product_id bigint", "balance bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        moves = pd.concat(list(rows)).sort_values(["product_id", "txn_date", "txn_number"])
        first = moves.drop_duplicates("product_id")
        start = {}
        for product, opening in zip(first["product_id"].tolist(), first["opening"].tolist()):
            stored = self.held.getValue((product,))
            start[product] = opening if stored is None else stored[0]
        after = moves.groupby("product_id")["delta"].cumsum() + moves["product_id"].map(start)
        moves = moves.assign(stock=after)
        last = moves.drop_duplicates("product_id", keep="last")
        for product, stock in zip(last["product_id"].tolist(), last["stock"].tolist()):
            self.held.updateValue((product,), (stock,))
        low = (moves["stock"] <= moves["min_reorder_level"]) & (moves["stock"] - moves["delta"] > moves["min_reorder_level"])
        yield from _in_slices(moves[["product_id", "txn_number", "stock", "min_reorder_level"]][low])

    def close(self) -> None:
        pass


def guarded_issues(moves: DataFrame, key: str, order: str, delta: str, opening: DataFrame | None = None) -> DataFrame:
    """A stream of decisions (key, order, delta, accepted, balance); ``opening`` holds (key, balance), zero by default."""
    keyed_state(moves.sparkSession)
    plain = moves.select(F.col(key).cast("bigint").alias("key"), F.col(order).cast("bigint").alias("order"), F.col(delta).cast("bigint").alias("delta"))
    start = None if opening is None else opening.toDF("key", "balance").select(F.col("key").cast("bigint").alias("key"), big("balance").alias("balance")).groupBy("key")
    decided = plain.groupBy("key").transformWithStateInPandas(
        _Guard(), "key bigint, order bigint, delta bigint, accepted boolean, balance bigint", "Append", "None", start
    )
    return decided.withColumnsRenamed({"key": key, "order": order, "delta": delta})


def low_stock_alerts(movements: DataFrame, products: DataFrame) -> DataFrame:
    """A stream of alerts: each time a product's stock falls to its reorder level or below.

    Movements count in (txn_date, txn_number) order. ``products`` (id, min_reorder_level,
    opening_stock) is read anew every micro-batch, so products added later alert as well.
    The state is a map per part of the products, of which a micro-batch reads and writes those it brings.
    """
    keyed_state(movements.sparkSession)
    listed = products.select(F.col("id").cast("bigint").alias("product_id"), big("min_reorder_level").alias("min_reorder_level"), big("opening_stock").alias("opening"))
    moves = movements.select(F.col("product_id").cast("bigint").alias("product_id"), "txn_date", "txn_number", big(signed_units()).alias("delta"))
    part = F.pmod(F.xxhash64("product_id"), F.lit(PARTS)).cast("int")
    return moves.join(listed, "product_id").withColumn("part", part).groupBy("part").transformWithStateInPandas(
        _Crossings(), "product_id bigint, txn_number string, stock bigint, min_reorder_level bigint", "Append", "None"
    )
