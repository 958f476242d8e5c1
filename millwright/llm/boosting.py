"""Gradient boosting by aggregates: logistic trees over small integer features, fitted from counted vectors.

Rows are distinct feature vectors with how often they occur and how often with label 1, so the table is
small however many rows it stands for. Each level of a tree is one aggregate: sums of gradients and
second derivatives for every (group, node, feature, value). That histogram, of bounded size, is all the
driver sees; it picks the splits. Several independent models, one for each ``group``, grow in the same
jobs. A fitted model is SQL text.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_split(cells: list[tuple[int, int, float, float]], smooth: float, least: float) -> tuple | None:
    """(feature, value, left sums, right sums) with the largest gain over (feature, value, g, h); None if none gains.
    Rows with feature <= value go left. Ties: the smaller feature, then value."""
    score = lambda g, h: g * g / (h + smooth)
    best, found = 1e-9, None
    for feature in sorted({c[0] for c in cells}):
        own = sorted(c[1:] for c in cells if c[0] == feature)
        g_all, h_all = sum(c[1] for c in own), sum(c[2] for c in own)
        g = h = 0.0
        for value, dg, dh in own[:-1]:
            g, h = g + dg, h + dh
            if min(h, h_all - h) < least:
                continue
            gain = score(g, h) + score(g_all - g, h_all - h) - score(g_all, h_all)
            if gain > best + 1e-9:
                best, found = gain, (feature, value, (g, h), (g_all - g, h_all - h))
    return found


class Node:
    """A leaf with its value, or a split with two nodes below. ``key`` is its number in the tree: 1, then 2k and 2k + 1."""

    def __init__(self, key: int, value: float):
        self.key, self.value, self.split, self.below = key, value, None, ()

    def sql(self, names: list[str], leaf) -> str:
        if not self.split:
            return leaf(self)
        low, high = (n.sql(names, leaf) for n in self.below)
        return f"if({names[self.split[0]]} <= {self.split[1]}, {low}, {high})"


class Boosted:
    """``prior`` and trees of one group."""

    def __init__(self, prior: float):
        self.prior, self.trees = prior, []

    def margin(self, names: list[str]) -> str:
        """SQL of the log odds; ``names`` say how the features are read."""
        return " + ".join([f"{self.prior!r}D", *[t.sql(names, lambda n: f"{n.value!r}D") for t in self.trees]])


def fit(vectors: DataFrame, group: str, features: list[str], trees: int = 16, depth: int = 3, rate: float = 0.3, smooth: float = 1.0, least: float = 1.0) -> dict:
    """group -> Boosted, from ``vectors`` (group, features, n, y): y of n rows have label 1.

    Groups with one label only get a prior and no trees. No rows give no models. Null features are no
    value to split by: give every feature one. Groups must be few: one model each comes to the driver.
    """
    totals = {r[0]: (r[1], r[2]) for r in vectors.groupBy(group).agg(F.sum("n"), F.sum("y")).collect()}
    models = {k: Boosted(math.log((y + 0.5) / (n - y + 0.5))) for k, (n, y) in totals.items()}
    live = [k for k, (n, y) in totals.items() if 0 < y < n]
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).cast("int").alias("v")) for i, f in enumerate(features)])).alias("c")
    by_group = lambda of, other: f"case {group} " + " ".join(f"when {k!r} then {of(k)}" for k in live) + f" else {other} end"
    data = vectors.where(F.col(group).isin(live))
    for _ in range(trees if live else 0):
        told = data.withColumn("_p", F.expr(f"1 / (1 + exp(-({by_group(lambda k: models[k].margin(features), '0D')})))"))
        told = told.select(group, *features, (F.col("n") * F.col("_p") - F.col("y")).alias("_g"), (F.col("n") * F.col("_p") * (1 - F.col("_p"))).alias("_h"))
        roots = {k: Node(1, 0.0) for k in live}
        tips = {(k, 1): roots[k] for k in live}
        for _ in range(depth):
            at = F.expr(by_group(lambda k: roots[k].sql(features, lambda n: str(n.key)), "0"))  # noqa: B023
            seen = told.withColumn("_node", at).select(group, "_node", "_g", "_h", cells).groupBy(group, "_node", "c.f", "c.v").agg(F.sum("_g"), F.sum("_h"))
            sums: dict = {}
            for k, node, f, v, g, h in seen.collect():
                sums.setdefault((k, node), []).append((f, v, g, h))
            after = {}
            for place, node in tips.items():
                found = best_split(sums.get(place, []), smooth, least)
                if found:
                    node.split = found[:2]
                    node.below = tuple(Node(2 * node.key + i, -rate * g / (h + smooth)) for i, (g, h) in enumerate(found[2:]))
                    after |= {(place[0], n.key): n for n in node.below}
            tips = after
            if not tips:
                break
        live_now = [k for k in live if roots[k].split]
        for k in live_now:
            models[k].trees.append(roots[k])
        if not live_now:
            break
    return models


def threshold(scored: DataFrame, group: str, score: str, precision: float = 0.9) -> dict:
    """group -> the least score such that, of all rows scored at least that (n of them, y with label 1), the lower end
    of the 95 % Wilson interval of y / n reaches ``precision``; groups without such a score are missing.

    Rows of one score are counted first and summed from the top; there are at most as many scores as
    leaves together.
    """
    from pyspark.sql.window import Window

    counts = scored.groupBy(group, score).agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    top = Window.partitionBy(group).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.select(group, score, F.sum("n").over(top).alias("n"), F.sum("y").over(top).alias("y"))
    p, z2 = F.col("y") / F.col("n"), 1.96**2
    low = (p + z2 / (2 * F.col("n")) - 1.96 * F.sqrt((p * (1 - p) + z2 / (4 * F.col("n"))) / F.col("n"))) / (1 + z2 / F.col("n"))
    return {r[0]: r[1] for r in upto.where(low >= precision).groupBy(group).agg(F.min(score)).collect()}
