"""Integrity reports: uniqueness, references, allowed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import DOMAINS, PAYMENT_STATUSES, ROLES, TXN_TYPES, USER_STATUSES
from ..functions.values import big
from ..sources.tables import Tables


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def duplicate_keys(rows: DataFrame, *keys: Column) -> DataFrame:
    """Key values held by more than one row; rows with a NULL in the key do not count."""
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    listed = rows.select(*named).dropna()
    return listed.groupBy(*listed.columns).count().filter(F.col("count") > 1)


def duplicates(tables: Tables) -> DataFrame:
    """Per uniqueness rule, how many values repeat and how many rows are too many."""
    low = lambda c: F.lower(F.col(c))
    rules = [
        ("users.email", tables.users, [low("email")]),
        ("categories.name", tables.categories, [low("name")]),
        ("products.sku", tables.products, [low("sku")]),
        ("products.barcode", tables.products, [low("barcode")]),
        ("product_batches.batch_number", tables.stock, [low("batch_number"), F.col("product_id")]),
        ("transactions.txn_number", tables.movements, [low("txn_number")]),
    ]
    return _union(
        [
            duplicate_keys(rows, *keys).agg(
                F.lit(rule).alias("rule"),
                big(F.count(F.lit(1))).alias("repeated_values"),
                big(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).alias("extra_rows"),
            )
            for rule, rows, keys in rules
        ]
    )


def orphans(tables: Tables) -> DataFrame:
    """Per relation, keys without a parent and the rows that hold them.

    One pass over each child table gives its (relation, key) pairs, which are counted
    before they meet the parents in one join.
    """
    children = [
        (tables.products, {"products.category_id": "category_id"}),
        (tables.stock, {"product_batches.product_id": "product_id"}),
        (tables.movements, {f"transactions.{k}": k for k in ("product_id", "batch_id", "supplier_id", "user_id")}),
    ]
    parents = [
        (tables.categories, ["products.category_id"]),
        (tables.products, ["product_batches.product_id", "transactions.product_id"]),
        (tables.stock, ["transactions.batch_id"]),
        (tables.suppliers, ["transactions.supplier_id"]),
        (tables.users, ["transactions.user_id"]),
    ]

    def pairs(rows: DataFrame, relations: dict[str, str]) -> DataFrame:
        held = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(key).cast("bigint").alias("id")) for rule, key in relations.items()])
        return rows.select(F.explode(held).alias("pair")).select("pair.rule", "pair.id")

    held = _union([pairs(rows, relations) for rows, relations in children])
    held = held.groupBy("rule", "id").agg(F.count(F.lit(1)).alias("_rows"))
    known = _union([pairs(rows.select("id"), dict.fromkeys(rules, "id")) for rows, rules in parents]).distinct()
    found = held.join(known.withColumn("_known", F.lit(True)), ["rule", "id"], "left")
    lost = F.col("_known").isNull() & F.col("id").isNotNull()
    counted = found.groupBy("rule").agg(
        big(F.count_if(lost)).alias("missing_keys"), big(F.coalesce(F.sum(F.when(lost, F.col("_rows"))), F.lit(0))).alias("orphan_rows")
    )
    rules = [rule for _, relations in children for rule in relations]
    every = held.sparkSession.createDataFrame([(r,) for r in rules], "rule string")
    zero = F.lit(0).cast("bigint")
    return every.join(counted, "rule", "left").select(
        "rule", F.coalesce("missing_keys", zero).alias("missing_keys"), F.coalesce("orphan_rows", zero).alias("orphan_rows")
    )


def domain_violations(tables: Tables) -> DataFrame:
    """Per column, values outside its list and missing values; one pass per table."""
    rules = [
        (tables.users, "users", {"role": ROLES, "status": USER_STATUSES}, ["name"]),
        (tables.categories, "categories", {"domain_type": DOMAINS}, ["name"]),
        (tables.products, "products", {"domain_preset": DOMAINS}, ["sku", "title", "category_id"]),
        (
            tables.product_batches, "product_batches", {},
            ["batch_number", "product_id", "available_qty", "purchase_price", "selling_price"],
        ),
        (
            tables.movements, "transactions", {"txn_type": TXN_TYPES, "payment_status": PAYMENT_STATUSES},
            ["txn_number", "product_id", "quantity", "user_id"],
        ),
    ]
    reports = []
    for rows, name, enums, required in rules:
        checks = [
            F.struct(
                F.lit(f"{name}.{c}").alias("column_name"),
                F.lit("allowed values").alias("check"),
                big(F.count_if(~F.col(c).isin(allowed))).alias("violations"),
            )
            for c, allowed in enums.items()
        ] + [
            F.struct(
                F.lit(f"{name}.{c}").alias("column_name"),
                F.lit("not null").alias("check"),
                big(F.count_if(F.col(c).isNull())).alias("violations"),
            )
            for c in required
        ]
        reports.append(rows.agg(F.array(*checks).alias("checks")).select(F.inline("checks")))
    return _union(reports)
