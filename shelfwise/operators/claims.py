"""First come, first served over unique values.

Each row claims one or more values. In order, a row is granted if no earlier granted
row holds any of its values; a refused row holds nothing. Rounds decide this exactly:
a row that comes first on all its values among the undecided is granted, and the
undecided that share a value with a granted row are refused. Every round uses minima
per value, which combine on the map side, so a value claimed by a third of all rows
is no obstacle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .lookup import left_lookup


def _all(tests: list[Column]) -> Column:
    return reduce(Column.__and__, tests)


def _any(tests: list[Column]) -> Column:
    return reduce(Column.__or__, tests)


def first_come(requests: DataFrame, order: str, claims: list[str], owner: str | None = None) -> DataFrame:
    """(order, granted) of each request; ``order`` is unique, a NULL claim claims nothing.

    With ``owner``, requests of one owner do not get in each other's way: a value that one
    of them was granted is open to the owner's later ones.
    """
    columns = [order, *claims, *([owner] if owner else [])]
    undecided = cut(requests.select(*columns), "claims")
    decided: list[DataFrame] = []
    while True:
        seen = undecided
        for c in claims:
            first = undecided.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min(order).alias(f"_first_{c}"))
            seen = left_lookup(seen, first.withColumnRenamed(c, f"_value_{c}"), c, f"_value_{c}", spread_by=order)
        leads = _all([F.coalesce(F.col(f"_first_{c}") == F.col(order), F.lit(True)) for c in claims])
        ranked = seen.withColumn("_lead", leads)
        for c in claims:
            # A value's only possible new holder is its first claimant.
            held = ranked.filter(F.col("_lead") & F.col(c).isNotNull()).select(
                F.col(c).alias(f"_held_{c}"), F.col(owner or order).alias(f"_holder_{c}")
            )
            ranked = left_lookup(ranked, held, c, f"_held_{c}", spread_by=order)
        mine = {c: F.col(f"_holder_{c}") == F.col(owner or order) for c in claims}
        taken = _any([F.coalesce(~mine[c], F.lit(False)) for c in claims])
        verdict = F.when(F.col("_lead"), True).when(taken, False).alias("granted")
        left = [F.when(~F.coalesce(mine[c], F.lit(False)), F.col(c)).alias(c) for c in claims]
        step = cut(ranked.select(order, *left, *columns[1 + len(claims) :], verdict), "claims")
        decided.append(step.filter(F.col("granted").isNotNull()).select(order, "granted"))
        if len(decided) >= 16:  # keeps the plan short however many rounds there are
            decided = [cut(reduce(DataFrame.unionByName, decided), "granted")]
        undecided = step.filter(F.col("granted").isNull()).drop("granted")
        if undecided.isEmpty():
            return reduce(DataFrame.unionByName, decided)
