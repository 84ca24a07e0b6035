"""Boosted trees on binned features: each level of a tree is one aggregate of gradients by node, feature and bin.

Gradients are whole millionths, so that their sums, and with them the trees, are the same however rows are dealt. What
comes to the driver is a histogram: nodes of a level, times features, times bins, whatever the table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialize

#: Bins of a feature, rows that their edges are found from at most, trees, levels, learning rate, ballast of a leaf.
BINS, SAMPLE, ROUNDS, DEPTH, RATE, BALLAST = 32, 10_000, 10, 3, 0.3, 1.0
#: Gradients and leaves are multiples of one over this.
UNIT = 1_000_000


@dataclass(frozen=True)
class Tree:
    """Nodes in heap order from 1: a split is (feature's place from 1, highest bin that goes left), a leaf a value in UNITs."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    leaves: dict[int, int] = field(default_factory=dict)

    def _walk(self, bins: Column, node: int, end) -> Column:
        if node not in self.splits:
            return end(node)
        feature, most = self.splits[node]
        return F.when(F.element_at(bins, feature) <= most, self._walk(bins, 2 * node, end)).otherwise(self._walk(bins, 2 * node + 1, end))

    def node(self, bins: Column) -> Column:
        return self._walk(bins, 1, F.lit)

    def value(self, bins: Column) -> Column:
        return self._walk(bins, 1, lambda node: F.lit(self.leaves[node]).cast("bigint"))


@dataclass(frozen=True)
class Boosted:
    """Features with the edges of their bins, and trees whose values add up to the log of the odds."""

    edges: dict[str, list[float]]
    base: int
    trees: list[Tree]

    def bins(self) -> Column:
        """The row's bin of each feature: 0 if it is missing or undefined, else one more than the edges that are below it."""

        def bin_of(name: str, edges: list[float]) -> Column:
            x = F.nanvl(F.col(f"`{name}`").cast("double"), F.lit(None).cast("double"))
            below = F.size(F.filter(F.array(*[F.lit(e) for e in edges]).cast("array<double>"), lambda e: e < x)) + 1
            return F.when(x.isNull(), 0).otherwise(below).cast("int")

        return F.array(*[bin_of(name, edges) for name, edges in self.edges.items()])

    def margin(self, bins: Column) -> Column:
        return sum((t.value(bins) for t in self.trees), F.lit(self.base).cast("bigint"))

    def probability(self, bins: Column | None = None) -> Column:
        return _logistic(self.margin(self.bins() if bins is None else bins))


def _logistic(margin: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-margin / float(UNIT)))


def bin_edges(rows: DataFrame, features: list[str], key: str, bins: int = BINS, sample: int = SAMPLE, seed: int = 42) -> dict[str, list[float]]:
    """Quantiles of each feature in the rows of the least hashes of their key, `sample` at most; each edge once."""
    wanted = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"x{i}") for i, c in enumerate(features)]
    drawn = rows.select(F.xxhash64(F.lit(seed), F.col(f"`{key}`")).alias("h"), *wanted).orderBy("h", *[f"x{i}" for i in range(len(features))]).limit(sample).collect()
    found = {}
    for i, name in enumerate(features):
        values = sorted(r[i + 1] for r in drawn if r[i + 1] is not None)
        found[name] = sorted({values[len(values) * q // bins] for q in range(1, bins)} - {values[-1]}) if values else []
    return found


def best_split(histogram: dict[tuple[int, int], tuple[int, int]], n_features: int, ballast: float = BALLAST) -> tuple[int, int] | None:
    """(feature, highest bin on the left) of the greatest gain, of equals the first; None if no split gains."""
    scale = ballast * UNIT
    best, found = 1e-9, None
    for feature in range(1, n_features + 1):
        mine = sorted((b, gh) for (f, b), gh in histogram.items() if f == feature)
        g_all, h_all = (sum(gh[i] for _, gh in mine) for i in (0, 1))
        g = h = 0
        for b, (gb, hb) in mine[:-1]:
            g, h = g + gb, h + hb
            gain = (g * g / (h + scale) + (g_all - g) ** 2 / (h_all - h + scale) - g_all * g_all / (h_all + scale)) / UNIT
            if gain > best:
                best, found = gain, (feature, b)
    return found


def fit(rows: DataFrame, features: list[str], label: str, key: str, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE) -> Boosted:
    """Boosted trees for the log odds of a boolean label; rows without a label are not looked at.

    Rows of one class alone, or none, give a model without trees.
    """
    edges = bin_edges(rows, features, key)
    model = Boosted(edges, 0, [])
    known = rows.filter(F.col(f"`{label}`").isNotNull()).select(model.bins().alias("bins"), F.col(f"`{label}`").cast("boolean").cast("int").alias("y"))
    held = materialize(known, "binned")
    n, ones = held.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < ones < n:
        return model
    model = Boosted(edges, round(UNIT * math.log(ones / (n - ones))), [])
    for _ in range(rounds):
        tree, open_nodes = Tree(), {1}
        p = _logistic(model.margin(F.col("bins")))
        for level in range(depth + 1):
            graded = held.select("bins", tree.node(F.col("bins")).alias("node"), F.round((p - F.col("y")) * UNIT).cast("bigint").alias("g"), F.round(p * (1.0 - p) * UNIT).cast("bigint").alias("h"))
            if level == depth:
                break
            each = graded.filter(F.col("node").isin(*open_nodes)).select("node", "g", "h", F.posexplode("bins").alias("place", "bin"))
            sums = each.groupBy("node", "place", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()  # nodes * features * bins at most
            following = set()
            for node in sorted(open_nodes):
                split = best_split({(r.place + 1, r.bin): (r.g, r.h) for r in sums if r.node == node}, len(features))
                if split:
                    tree.splits[node] = split
                    following |= {2 * node, 2 * node + 1}
            open_nodes = following
            if not open_nodes:
                break
        for r in held.select(tree.node(F.col("bins")).alias("node"), F.round((p - F.col("y")) * UNIT).cast("bigint").alias("g"), F.round(p * (1.0 - p) * UNIT).cast("bigint").alias("h")).groupBy("node").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            tree.leaves[r.node] = round(-rate * UNIT * r.g / (r.h + BALLAST * UNIT))
        model = Boosted(edges, model.base, [*model.trees, tree])
    return model


def auc(rows: DataFrame, score: str, label: str, digits: int = 4) -> DataFrame:
    """One row: n, ones and auc, how often a row with the label has a higher score than one without; ties count half.

    Scores from 0 to 1 count to `digits` decimals, so that one window holds 10**digits + 1 rows at most. Rows without a
    score or a label are left out; without both classes auc is null.
    """
    known = rows.filter(F.col(f"`{score}`").isNotNull() & F.col(f"`{label}`").isNotNull())
    binned = known.groupBy(F.round(F.least(F.greatest(F.col(f"`{score}`"), F.lit(0.0)), F.lit(1.0)) * 10**digits).cast("bigint").alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col(f"`{label}`").cast("boolean")).alias("ones"))
    zeros = F.col("n") - F.col("ones")
    below = F.coalesce(F.sum(zeros).over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    won = binned.select("n", "ones", (F.col("ones") * (below + zeros / 2.0)).alias("won"))
    return won.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("ones"), F.lit(0)).alias("ones"), F.sum("won").alias("won")).select(
        "n", "ones", F.round(F.try_divide(F.col("won"), (F.col("ones") * (F.col("n") - F.col("ones"))).cast("double")), 6).alias("auc")
    )
