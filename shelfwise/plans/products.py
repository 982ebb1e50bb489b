"""Catalog maintenance: create, update, delete."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import DEFAULT_REORDER_LEVEL, NEW_ID_BASE
from ..functions.values import number_or, text_or
from ..operators.claims import first_come
from ..operators.components import components
from ..operators.lineage import cut

# Texts of refusals.
FIELDS_REQUIRED = "SKU, Title, and Category ID are required."
TITLE_REQUIRED = "Product Title is required."
SKU_REQUIRED = "SKU is required."
SKU_USED = "SKU is already in use."
BARCODE_USED = "Barcode is already in use."
SKU_OR_BARCODE_CLAIMED = "SKU or barcode was taken by an earlier request."
HAS_HISTORY = "Product has ledger entries."
NOT_FOUND = "Product not found."

COLUMNS = [
    "sku", "barcode", "title", "category_id", "unit_of_measure", "min_reorder_level", "domain_preset", "brand",
    "storage_location",
]


def _filled() -> dict[str, Column]:
    """Request columns with their defaults."""
    return {
        "sku": F.nullif("sku", F.lit("")),
        "barcode": F.nullif("barcode", F.lit("")),
        "title": F.nullif("title", F.lit("")),
        "category_id": F.nullif("category_id", F.lit(0)),
        "unit_of_measure": text_or("unit_of_measure", "Pcs"),
        "min_reorder_level": number_or("min_reorder_level", DEFAULT_REORDER_LEVEL),
        "domain_preset": text_or("domain_preset", "GENERAL"),
        "brand": F.nullif("brand", F.lit("")),
        "storage_location": F.nullif("storage_location", F.lit("")),
    }


def create(requests: DataFrame, products: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new products, rejects) of create requests served in ``seq`` order."""
    filled = requests.select("seq", *[c.alias(n) for n, c in _filled().items()])
    skus = products.select(F.lower("sku").alias("_sku")).distinct().withColumn("_sku_used", F.lit(True))
    bars = (
        products.filter(F.col("barcode").isNotNull())
        .select(F.lower("barcode").alias("_bar"))
        .distinct()
        .withColumn("_bar_used", F.lit(True))
    )
    known = categories.select(F.col("id").alias("_cat"), F.lit(True).alias("_cat_known"))
    checked = (
        filled.withColumn("_sku", F.lower("sku"))
        .withColumn("_bar", F.lower("barcode"))
        .join(skus, "_sku", "left")
        .join(bars, "_bar", "left")
        .join(known, F.col("category_id") == F.col("_cat"), "left")
    )
    reason = (
        F.when(F.col("sku").isNull() | F.col("title").isNull() | F.col("category_id").isNull(), FIELDS_REQUIRED)
        .when(F.col("_sku_used"), SKU_USED)
        .when(F.col("_bar_used"), BARCODE_USED)
        .when(
            F.col("_cat_known").isNull(),
            F.concat(F.lit("Category ID "), F.col("category_id").cast("string"), F.lit(" not found.")),
        )
    )
    judged = cut(checked.select("seq", *COLUMNS, "_sku", "_bar", reason.alias("reason")), "products")
    granted = first_come(judged.filter(F.col("reason").isNull()), "seq", ["_sku", "_bar"])
    made = judged.join(granted.filter("granted").select("seq"), "seq").select(
        (F.lit(NEW_ID_BASE) + F.col("seq")).alias("id"), *COLUMNS
    )
    late = granted.filter(~F.col("granted")).select("seq", F.lit(SKU_OR_BARCODE_CLAIMED).alias("reason"))
    return made, judged.filter(F.col("reason").isNotNull()).select("seq", "reason").unionByName(late)


def _clerk():
    """Refusals of updates served one by one, component after component, as a closure that needs nothing of this package."""
    used, claimed, nothing = [SKU_USED, BARCODE_USED], SKU_OR_BARCODE_CLAIMED, (None, None)

    def plain(column: pa.Array) -> list[int | None]:
        """The numbers of a column; by way of an array, which takes a tenth of the time of one value after another."""
        if not column.null_count:
            return column.to_numpy().tolist()
        numbers = column.fill_null(0).to_numpy().astype(object)
        numbers[column.is_null().to_numpy(zero_copy_only=False)] = None
        return numbers.tolist()

    def admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, holder, held = None, {}, {}
        for rows in batches:
            seqs, reasons = [], []
            for root, seq, product, *values in zip(*map(plain, rows.columns)):
                if root != at:
                    at, holder, held = root, {}, {}
                wanted, owners, stored = tuple(values[:2]), values[2:4], values[4:6]
                why = None
                for kind in (0, 1):
                    now = holder.get(wanted[kind], owners[kind])
                    if why is None and wanted[kind] is not None and now not in (None, product):
                        why = used[kind] if now == owners[kind] else claimed
                if why is None:
                    for value in held.get(product, stored):
                        if value is not None:
                            holder[value] = None
                    for value in wanted:
                        if value is not None:
                            holder[value] = product
                    held[product] = nothing if wanted == nothing else wanted
                else:
                    seqs.append(seq)
                    reasons.append(why)
            yield pa.record_batch({"seq": pa.array(seqs, pa.int64()), "_why": pa.array(reasons, pa.string())})

    return admit


def _refused(rows: DataFrame) -> DataFrame:
    """(seq, _why) of the sound updates that find a value taken, as if they were served one by one.

    An update lets go of its product's values and takes others. Where all that ask for a
    value are its stored owner, or one product, there is nothing to decide. The rest, the
    contested values, get numbers, and nothing else of a value is handed on. Products that ask
    for, or hold, the same contested values fall into components; components do not touch one
    another, so each is served in order by itself, and Spark packs them into tasks.
    """
    value = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c))
    names = ["_sku", "_bar", "_old_sku", "_old_bar"]
    slots = [F.struct(F.lit(slot).alias("slot"), value(slot % 2, c).alias("value")) for slot, c in enumerate(names)]
    places = rows.select("_row", "id", F.inline(F.array(*slots))).where(F.col("value").isNotNull())
    taken = rows.select(F.explode(F.filter(F.array(
        F.when(F.col("_sku_owner") != F.col("id"), value(0, "_sku")), F.when(F.col("_bar_owner") != F.col("id"), value(1, "_bar")),
    ), lambda v: v.isNotNull())).alias("value"))
    shared = places.where("slot < 2").groupBy("value").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("value")
    contested = cut(taken.unionByName(shared).distinct().withColumn("n", F.monotonically_increasing_id()), "contested")
    numbered = cut(places.join(contested, "value").select("_row", "id", "slot", "n"), "numbered")
    linked = cut(numbered.select("id", "n").distinct(), "linked")
    placed = linked.join(components(linked, "id", "n"), "n").groupBy("id").agg(F.min("root").alias("root"))
    by_row = numbered.groupBy("_row").agg(*[F.max(F.when(F.col("slot") == slot, F.col("n"))).alias(f"n{c}") for slot, c in enumerate(names)])
    dealt = rows.select("_row", "seq", "id", "_sku_owner", "_bar_owner").join(placed, "id").join(by_row, "_row", "left")
    dealt = dealt.select("root", "seq", "id", "n_sku", "n_bar", "_sku_owner", "_bar_owner", "n_old_sku", "n_old_bar")
    dealt = dealt.repartition("root").sortWithinPartitions("root", "seq")
    return dealt.mapInArrow(_clerk(), "seq bigint, _why string")


def update(requests: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(products, rejects) after update requests; the last sound one per product replaces all nine columns.

    A request is sound if its product exists, it has a title and an SKU, and no other product
    has its SKU or barcode by then. A value that an update frees can be taken by the next
    one, so how the requests are cut into runs makes no difference. Columns that a request
    omits become empty or take their default.
    """
    filled = _filled()
    filled["category_id"] = number_or("category_id", 1)
    wanted = requests.select(F.col("seq").cast("bigint").alias("seq"), F.col("id").cast("bigint").alias("id"), *[c.alias(n) for n, c in filled.items()])
    wanted = wanted.withColumn("_sku", F.lower("sku")).withColumn("_bar", F.lower("barcode"))
    sku_owner = products.groupBy(F.lower("sku").alias("_sku")).agg(F.min("id").cast("bigint").alias("_sku_owner"))
    bar_owner = (
        products.filter(F.col("barcode").isNotNull())
        .groupBy(F.lower("barcode").alias("_bar"))
        .agg(F.min("id").cast("bigint").alias("_bar_owner"))
    )
    known = products.select(F.col("id").cast("bigint").alias("_known"), F.lower("sku").alias("_old_sku"), F.lower("barcode").alias("_old_bar"))
    checked = (
        wanted.join(sku_owner, "_sku", "left")
        .join(bar_owner, "_bar", "left")
        .join(known, F.col("id") == F.col("_known"), "left")
    )
    reason = (
        F.when(F.col("_known").isNull(), NOT_FOUND)
        .when(F.col("title").isNull(), TITLE_REQUIRED)
        .when(F.col("sku").isNull(), SKU_REQUIRED)
    )
    keys = ["_sku", "_bar", "_sku_owner", "_bar_owner", "_old_sku", "_old_bar"]
    number = F.monotonically_increasing_id().alias("_row")  # a seq may come twice
    judged = cut(checked.select("seq", "id", *COLUMNS, *keys, number, reason.alias("reason")), "updates")
    fit = judged.filter(F.col("reason").isNull())
    late = cut(_refused(fit), "late")
    sound = fit.join(late, "seq", "left_anti")
    last = sound.groupBy("id").agg(F.max_by(F.struct(*COLUMNS), "seq").alias("_new"))
    changed = F.col("_new").isNotNull()
    rest = [c for c in products.columns if c != "id" and c not in COLUMNS]
    after = products.join(last, "id", "left").select(
        "id",
        *[F.when(changed, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in COLUMNS],
        *rest,
    )
    refused = judged.filter(F.col("reason").isNotNull()).select("seq", "reason")
    return after, refused.unionByName(late.select("seq", F.col("_why").alias("reason")))


def delete_outcome(requests: DataFrame, products: DataFrame, ledger: DataFrame) -> DataFrame:
    """(id, deleted, reason) per requested product id."""
    asked = requests.select("id").filter(F.col("id").isNotNull()).distinct()
    known = products.select("id", F.lit(True).alias("_known"))
    moved = ledger.select(F.col("product_id").alias("id")).distinct().withColumn("_moved", F.lit(True))
    reason = F.when(F.col("_known").isNull(), NOT_FOUND).when(F.col("_moved"), HAS_HISTORY)
    return (
        asked.join(known, "id", "left")
        .join(moved, "id", "left")
        .select("id", reason.isNull().alias("deleted"), reason.alias("reason"))
    )


def delete(
    requests: DataFrame, products: DataFrame, batches: DataFrame, ledger: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(products, batches) after deletion; a product with ledger entries keeps everything."""
    gone = delete_outcome(requests, products, ledger).filter("deleted").select("id")
    left_products = products.join(gone, "id", "left_anti")
    left_batches = batches.join(gone.withColumnRenamed("id", "product_id"), "product_id", "left_anti")
    return left_products, left_batches.select(*batches.columns)
