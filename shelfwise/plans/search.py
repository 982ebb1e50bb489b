"""Searches that look into a stored index first.

Products are indexed by id with their title and SKU (and barcode, for the catalog), batches by
id with their number. A movement's own texts are indexed by day: what a term's grams do not
meet on a day cannot match there, so such days' movements are not compared. Everything the
index offers is then compared with the term, so the rows are those of the plain searches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import like_any
from ..operators.lookup import left_lookup
from ..operators.trigrams import GramIndex
from ..sources.tables import Tables
from . import catalog, ledger

PRODUCT, BARCODE, BATCH, DAY = "product", "barcode", "batch", "day"


def index_products(index: GramIndex, load: int, products: DataFrame) -> None:
    index.add(load, products, {PRODUCT: ["id", "title", "sku"], BARCODE: ["id", "barcode"]})


def index_batches(index: GramIndex, load: int, batches: DataFrame) -> None:
    index.add(load, batches, {BATCH: ["id", "batch_number"]})


def index_movements(index: GramIndex, load: int, movements: DataFrame) -> None:
    """``movements`` are complete ledger rows; several loads may hold movements of one day."""
    dated = movements.select(F.to_date("txn_date").alias("day"), "txn_number", "invoice_ref", "customer_name")
    index.add(load, dated, {DAY: ["day", "txn_number", "invoice_ref", "customer_name"]})


def _flagged(rows: DataFrame, found: DataFrame, kind: str, key: str, flag: str) -> DataFrame:
    """Adds whether the index offers the row's key."""
    refs = found.where(F.col("kind") == kind).select(F.col("ref").cast(rows.schema[key].dataType).alias("_ref"), F.lit(True).alias(flag)).distinct()
    return left_lookup(rows, refs, key, "_ref", spread_by="txn_number").withColumn(flag, F.coalesce(flag, F.lit(False)))


def ledger_search(tables: Tables, index: GramIndex, term: str) -> DataFrame:
    """``ledger.ledger`` with a search; a term too short for the index is compared with all rows."""
    found = index.candidates(term)
    if found is None:
        return ledger.ledger(tables, search=term)
    products = tables.products.join(found.where(F.col("kind") == PRODUCT).select(F.col("ref").cast("bigint").alias("id")), "id", "left_semi")
    batches = tables.stock.join(found.where(F.col("kind") == BATCH).select(F.col("ref").cast("bigint").alias("id")), "id", "left_semi")
    hit = [F.lit(kind).alias("kind") for kind in (PRODUCT, BATCH)]
    matched = products.where(like_any(term, "title", "sku")).select(hit[0], F.col("id").cast("string").alias("ref"))
    matched = matched.unionByName(batches.where(like_any(term, "batch_number")).select(hit[1], F.col("id").cast("string").alias("ref")))
    rows = tables.movements.withColumn("_day", F.to_date("txn_date").cast("string"))
    rows = _flagged(_flagged(rows, matched, PRODUCT, "product_id", "_in_product"), matched, BATCH, "batch_id", "_in_batch")
    rows = _flagged(rows, found, DAY, "_day", "_on_day")
    sure = F.col("_in_product") | F.col("_in_batch")
    rows = tables.complete(rows.where(sure | F.col("_on_day")))
    rows = rows.where(sure | like_any(term, "txn_number", "invoice_ref", "customer_name"))
    return ledger.named(tables, rows.drop("_day", "_in_product", "_in_batch", "_on_day")).orderBy(*ledger.newest_first())


def catalog_search(tables: Tables, index: GramIndex, term: str) -> DataFrame:
    """``catalog.catalog`` with a search, over the products that the index offers."""
    found = index.candidates(term)
    if found is None:
        return catalog.catalog(tables, search=term)
    offered = found.where(F.col("kind").isin(PRODUCT, BARCODE)).select(F.col("ref").cast("bigint").alias("id")).distinct()
    few = tables.products.join(offered, "id", "left_semi").select(*tables.products.columns)
    return catalog.catalog(tables.replaced(products=few), search=term)
