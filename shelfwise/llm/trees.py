"""Fitted tree ensembles as SQL expressions, so that scoring needs no vectors and no Python."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_LINE = re.compile(r"^( *)(?:(If|Else) \(feature (\d+) (<=|>) ([-0-9.Ee]+|Infinity|-Infinity)\)|Predict: ([-0-9.Ee]+))$")


def _parsed(text: str) -> list[tuple]:
    """Trees of a model's printed form: (feature, threshold, left, right) or a number."""
    trees = []
    for part in re.split(r"^ *Tree \d+.*$", text, flags=re.M)[1:]:
        lines = [m for line in part.splitlines() if (m := _LINE.match(line))]
        at = 0

        def node() -> tuple | float:
            nonlocal at
            m = lines[at]
            at += 1
            if m[6] is not None:
                return float(m[6])
            left = node()
            at += 1  # the line of the other branch
            right = node()
            return left if left == right else (int(m[3]), float(m[5]), left, right)  # a split that does not matter

        trees.append(node())
    return trees


def weighted_sum(model, feature: Callable[[int], Column]) -> Column:
    """Sum of the trees' predictions, each times its weight, on features given by number."""

    known = cache(feature)

    def column(node: tuple | float) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        f, threshold, left, right = node
        return F.when(known(f) <= threshold, column(left)).otherwise(column(right))

    total = F.lit(0.0)
    for tree, weight in zip(_parsed(model.toDebugString), model.treeWeights):
        total = total + column(tree) * F.lit(float(weight))
    return total
