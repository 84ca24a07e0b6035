"""Isolation forest: rows that random cuts part from the others after few steps are outliers.

The forest is fitted on a bounded sample of rows, those of the least hashes of their key, so that it does not hang on how
rows are dealt. All rows are scored by a column expression that walks the trees, which are constants of the plan.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that trees are drawn from at most, trees, rows of a tree, and the steps of a walk.
SAMPLE, TREES, ROWS, DEPTH = 4096, 64, 128, 7
_SHAPE = "array<struct<f: array<int>, t: array<double>, l: array<int>, p: array<double>>>"


def usual_path(n: int) -> float:
    """Steps that an unsuccessful search in a binary tree of n rows takes on average."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


@dataclass(frozen=True)
class Forest:
    """Trees as arrays by node: feature (0 at a leaf, else its place from 1), threshold, left child (the right one follows), path."""

    features: list[str]
    fill: list[float]
    trees: list[dict[str, list]]
    rows: int

    def score(self) -> Column:
        """0..1, about 0.5 for usual rows and more for those that are apart; null for a forest without trees."""
        if not self.trees:
            return F.lit(None).cast("double")
        row = F.array(*[F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")), F.lit(x)) for c, x in zip(self.features, self.fill, strict=True)])
        trees = F.from_json(F.lit(json.dumps(self.trees)), _SHAPE)

        def walked(x: Column) -> Column:
            def path(tree: Column) -> Column:
                def step(node: Column, _: Column) -> Column:
                    feature = F.element_at(tree["f"], node)
                    right = F.when(F.element_at(x, F.greatest(feature, F.lit(1))) < F.element_at(tree["t"], node), 0).otherwise(1)
                    return F.when(feature == 0, node).otherwise(F.element_at(tree["l"], node) + right)

                return F.element_at(tree["p"], F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(1), step))

            return F.aggregate(trees, F.lit(0.0), lambda s, tree: s + path(tree))

        # The row goes through a transform, so that it is made once for all steps.
        total = F.element_at(F.transform(F.array(row), walked), 1)
        return F.pow(F.lit(2.0), -total / float(len(self.trees)) / usual_path(self.rows))


def _grow(x: np.ndarray, dice: np.random.Generator) -> dict[str, list]:
    tree: dict[str, list] = {"f": [0], "t": [0.0], "l": [0], "p": [0.0]}
    todo = [(0, x, 0)]
    while todo:
        node, rows, depth = todo.pop()
        wide = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 and depth < DEPTH else []
        if not len(wide):
            tree["p"][node] = depth + usual_path(len(rows))
            continue
        feature = int(dice.choice(wide))
        cut = float(dice.uniform(rows[:, feature].min(), rows[:, feature].max()))
        below = rows[:, feature] < cut
        if below.all() or not below.any():  # the cut fell on an end
            cut = float(rows[:, feature].max())
            below = rows[:, feature] < cut
        first = len(tree["f"])
        tree["f"][node], tree["t"][node], tree["l"][node] = feature + 1, cut, first + 1
        for c, nothing in (("f", 0), ("t", 0.0), ("l", 0), ("p", 0.0)):
            tree[c] += [nothing, nothing]
        todo += [(first + 1, rows[~below], depth + 1), (first, rows[below], depth + 1)]
    return tree


def fit(rows: DataFrame, features: list[str], key: str, seed: int = 42, sample: int = SAMPLE, trees: int = TREES) -> Forest:
    """A forest over the features of rows. Missing and undefined values count as the sample's median of their feature.

    The sample has no more than `sample` rows, whatever the table; rows of equal hashes go in the order of their features.
    """
    wanted = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, c in enumerate(features)]
    hashed = rows.select(F.xxhash64(F.lit(seed), F.col(f"`{key}`")).alias("h"), *wanted)
    drawn = hashed.orderBy("h", *[f"x{i}" for i in range(len(features))]).limit(sample).collect()
    x = np.array([[np.nan if v is None else v for v in r[1:]] for r in drawn], float).reshape(len(drawn), len(features))
    fill = [float(np.median(c[~np.isnan(c)])) if (~np.isnan(c)).any() else 0.0 for c in x.T] if len(x) else [0.0] * len(features)
    x = np.where(np.isnan(x), fill, x)
    dice, size = np.random.default_rng(seed), min(ROWS, len(x))
    return Forest(list(features), fill, [_grow(x[dice.choice(len(x), size, replace=False)], dice) for _ in range(trees)] if size > 1 else [], size)
