"""Insert, or change one column where the key exists already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .claims import first_come
from .lineage import cut
from .lookup import left_lookup


def seed_upsert(stored: DataFrame, incoming: DataFrame, key: str | list[str], column: str, order: str) -> DataFrame:
    """State after inserting ``incoming`` in ``order`` with ``column`` updated on a repeated key.

    A key is one column or several. The first incoming row of a new key supplies all
    columns, the last one the updated column; keys compare without case. Columns that only
    one side has are NULL on the other. An incoming row without a full key is refused, as
    the table would; a stored one stays.
    """
    parts = [key] if isinstance(key, str) else key
    folded = F.struct(*[F.lower(F.col(p).cast("string")).alias(p) for p in parts])
    incoming = incoming.dropna(subset=parts)
    names = [c for c in stored.columns if c != column]
    given = [c for c in names if c in incoming.columns]
    fresh = incoming.groupBy(folded.alias("_key")).agg(
        F.min_by(F.struct(*given), order).alias("_first"), F.max_by(F.struct(column), order).alias("_last")
    )
    old = stored.select(F.struct(*stored.columns).alias("_old"), folded.alias("_key"))
    both = old.join(fresh, "_key", "full_outer")
    is_old = F.col("_old").isNotNull()

    def value(c: str):
        if c == column:
            return F.when(F.col("_last").isNotNull(), F.col(f"_last.{c}")).otherwise(F.col(f"_old.{c}"))
        new = F.col(f"_first.{c}") if c in given else F.lit(None)
        return F.when(is_old, F.col(f"_old.{c}")).otherwise(new)

    return both.select(*[value(c).alias(c) for c in stored.columns])


def upsert_by_any(stored: DataFrame, incoming: DataFrame, keys: list[str], column: str, order: str) -> DataFrame:
    """State after inserting ``incoming`` in ``order`` where each of several keys is unique by itself.

    A row conflicts with the one that has its first key's value, else its second's, and so on,
    stored or inserted by an earlier row; it then updates ``column`` there and nothing else. One
    without a conflict is inserted and holds its keys from then on. Keys compare without
    case, a NULL key conflicts with nothing, and a row needs the first one. Both frames have an ``id``.
    """
    rows = incoming.dropna(subset=keys[:1])
    folded = [F.lower(F.col(k).cast("string")).alias(f"_k{i}") for i, k in enumerate(keys)]
    names = [f"_k{i}" for i in range(len(keys))]
    placed = rows.select(F.struct("*").alias("_row"), F.col(order).alias("_at"), *folded)
    for i, k in enumerate(keys):
        owner = stored.filter(F.col(k).isNotNull()).groupBy(F.lower(F.col(k).cast("string")).alias("_held")).agg(F.min("id").alias(f"_stored{i}"))
        placed = left_lookup(placed, owner, f"_k{i}", "_held", spread_by="_at")
    placed = cut(placed, "upsert")
    unknown = F.coalesce(*[f"_stored{i}" for i in range(len(keys))]).isNull()
    first = first_come(placed.filter(unknown), "_at", names).filter("granted").select("_at")
    inserted = cut(placed.join(first, "_at"), "inserted")
    found = placed
    for i in range(len(keys)):
        owner = inserted.filter(F.col(f"_k{i}").isNotNull()).select(F.col(f"_k{i}").alias("_held"), F.col("_at").alias(f"_since{i}"), F.col("_row.id").alias(f"_new{i}"))
        found = left_lookup(found, owner, f"_k{i}", "_held", spread_by="_at")
    holders = [c for i in range(len(keys)) for c in (F.col(f"_stored{i}"), F.when(F.col(f"_since{i}") <= F.col("_at"), F.col(f"_new{i}")))]
    last = found.select(F.coalesce(*holders).alias("_id"), "_at", F.struct(F.col(f"_row.{column}").alias("value")).alias("_value"))
    last = last.groupBy("_id").agg(F.max_by("_value", "_at").alias("_last"))
    given = [c for c in stored.columns if c in rows.columns]
    fresh = inserted.select(*[F.col(f"_row.{c}").cast(stored.schema[c].dataType).alias(c) for c in given])
    whole = stored.unionByName(fresh, allowMissingColumns=True).join(last, F.col("id") == F.col("_id"), "left")
    changed = F.when(F.col("_last").isNotNull(), F.col("_last.value")).otherwise(F.col(column)).alias(column)
    return whole.select(*[changed if c == column else F.col(c) for c in stored.columns])
