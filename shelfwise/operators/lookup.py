"""Joins that survive hot and missing keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPREAD = 1024
_BELOW_ALL_IDS = -(1 << 62)


def left_lookup(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, *, spread_by: str) -> DataFrame:
    """Left join to a lookup with one row per key, where many fact rows have no key.

    All rows without a key would meet in one shuffle partition. They can match
    nothing, so each joins on one of many made-up keys instead; the second condition
    keeps them unmatched whatever the lookup holds. Hot real keys are left to Spark's
    skew-join splitting, which may split this (left) side. The lookup's key is dropped.
    """
    slot = F.pmod(F.xxhash64(spread_by), F.lit(SPREAD))
    if isinstance(fact.schema[fact_key].dataType, StringType):
        made_up = F.concat(F.lit("\x00"), slot.cast("string"))
    else:
        made_up = F.lit(_BELOW_ALL_IDS) + slot
    left = fact.withColumn("_join_key", F.coalesce(F.col(fact_key), made_up))
    on = (left["_join_key"] == dim[dim_key]) & left[fact_key].isNotNull()
    return left.join(dim, on, "left").drop("_join_key", dim_key)


def lookup_known(fact: DataFrame, dim: DataFrame, fact_key: Column | str, dim_key: str) -> DataFrame:
    """Left join to a lookup where many rows that are cheap to read have no key.

    Rows without a key can match nothing; they pass by the join and are not shuffled for it.
    The price is that ``fact`` is read once for either kind. The lookup's key is dropped. A key
    that is worked out from other columns is not shuffled beside them.
    """
    key = F.col(fact_key) if isinstance(fact_key, str) else fact_key
    found = fact.filter(key.isNotNull()).join(dim, key == F.col(dim_key), "left").drop(dim_key)
    added = [F.lit(None).cast(f.dataType).alias(f.name) for f in dim.schema if f.name != dim_key]
    return found.unionByName(fact.filter(key.isNull()).select("*", *added))


def pair_lookup(
    fact: DataFrame, dim: DataFrame, first: str, second: str, *, keys: tuple[Column, Column] | None = None, spread_by: Column | None = None
) -> DataFrame:
    """Left join to a lookup that holds the pairs of keys of ``fact``, where either key may be missing.

    A pair without one key is a pair like any other. Rows without both have nothing to look up
    and are spread over made-up keys, by all their columns if not by ``spread_by``. ``keys`` are the
    keys of ``fact`` if it has no columns of these names. The rows are shuffled as they are, without
    columns for their keys.
    """
    missing = F.lit(_BELOW_ALL_IDS - 1)
    one, other = keys or (F.col(first), F.col(second))
    slot = F.lit(_BELOW_ALL_IDS) + F.pmod(F.xxhash64(*([spread_by] if spread_by is not None else fact.columns)), F.lit(SPREAD))
    keyed = dim.filter(F.col(first).isNotNull() | F.col(second).isNotNull())
    keyed = keyed.select(
        F.coalesce(first, missing).alias("_first_of_pair"), F.coalesce(second, missing).alias("_second_of_pair"),
        *[c for c in dim.columns if c not in (first, second)],
    )
    on = F.coalesce(one, F.when(other.isNull(), slot).otherwise(missing)) == F.col("_first_of_pair")
    on &= F.coalesce(other, missing) == F.col("_second_of_pair")
    return fact.join(keyed, on, "left").drop("_first_of_pair", "_second_of_pair")


def lookup_few(rows: DataFrame, dim: DataFrame, row_key: str, dim_key: str, keys_of: DataFrame | None = None) -> DataFrame:
    """Left join of a few written rows to a lookup of any size with one row per key.

    The lookup is cut down to the keys at hand before the join. ``keys_of`` is the written
    frame that holds them, if ``rows`` has been joined since. How each join is run is left
    to Spark, which knows the size of a written frame.
    """
    keys = (rows if keys_of is None else keys_of).select(F.col(row_key).alias(dim_key)).filter(F.col(dim_key).isNotNull()).distinct()
    found = dim.join(keys, dim_key, "left_semi")
    return rows.join(found, rows[row_key] == found[dim_key], "left").drop(dim_key)
