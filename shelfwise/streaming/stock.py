"""Receipts and bills as streams against a stored stock."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut
from ..plans import bills, receipts
from .runs import KeyedTable, all_of, changed_rows, put


@dataclass(frozen=True)
class StockFolder:
    """Products and batches as stored tables, and per micro-batch ledger rows and refusals.

    A receipt may name its product by SKU or title, so receipts read all products; bills
    read the batches and products of their lines, from their buckets.
    """

    spark: SparkSession
    root: str
    product_table: KeyedTable
    batch_table: KeyedTable
    suppliers: DataFrame | None = None
    users: DataFrame | None = None

    @classmethod
    def start(
        cls, root: str, products: DataFrame, batches: DataFrame, suppliers: DataFrame | None = None, users: DataFrame | None = None
    ) -> StockFolder:
        """A new folder with these tables."""
        spark = products.sparkSession
        batches = batches.withColumn("available_qty", F.col("available_qty").cast("bigint"))
        stored = [KeyedTable(spark, f"{root}/{name}", rows.schema) for name, rows in (("products", products), ("batches", batches))]
        for table, rows in zip(stored, (products, batches)):
            table.open(rows)
        return cls(spark, root, *stored, suppliers, users)

    def products(self, batch_id: int, touched: DataFrame | None = None) -> DataFrame:
        return self.product_table.before(batch_id, touched)

    def batches(self, batch_id: int, touched: DataFrame | None = None) -> DataFrame:
        return self.batch_table.before(batch_id, touched)

    def all_of(self, name: str) -> DataFrame:
        return all_of(self.spark, self.root, name)

    def receive(self, requests: DataFrame, batch_id: int) -> None:
        """Apply one micro-batch of receipts."""
        products, batches = self.products(batch_id), self.batches(batch_id)
        done = receipts.receive(requests, products, batches, self.suppliers, self.users)
        put(self.spark, self.root, "ledger", batch_id, done.ledger)
        put(self.spark, self.root, "rejects", batch_id, done.rejects)
        after = cut(changed_rows(done.batches.select(*batches.columns), batches, "id"), "after")
        added = products.limit(0).unionByName(done.new_products, allowMissingColumns=True)
        self.product_table.change(batch_id, added)
        self.batch_table.change(batch_id, after)

    def issue(self, requests: DataFrame, batch_id: int) -> None:
        """Apply one micro-batch of bills; each is served whole or not at all."""
        asked = cut(bills.bill_lines(requests).select("batch_id", "product_id").distinct(), "asked")
        batches = self.batches(batch_id, asked.select(F.col("batch_id").alias("id")))
        products = self.products(batch_id, asked.select(F.col("product_id").alias("id")))
        done = bills.check_out(requests, products, batches)
        done = bills.CheckedOut(done.lines, cut(done.settled, "settled"))  # read by each of the following
        put(self.spark, self.root, "ledger", batch_id, done.ledger)
        put(self.spark, self.root, "rejects", batch_id, done.rejects)
        sold = done.settled.filter("accepted").select(F.col("batch_id").alias("id")).distinct()
        after = bills.batches_after(batches.join(sold, "id", "left_semi"), done.settled)
        self.batch_table.change(batch_id, after.select(*batches.columns))
