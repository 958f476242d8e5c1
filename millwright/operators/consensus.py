"""Consensus over small groups: lines through most points, and boxes in reading order."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def consensus_line(df: DataFrame, group: list[str], x: str, y: str, tolerance: float) -> DataFrame:
    """group, slope, intercept, n, mse, span of the line through two points of the group that has most points within ``tolerance``.

    Ties: the smaller mean square, then the longer span, then the leftmost points. For groups of tens of
    points: the pairs of a group are formed within its row.
    """
    points = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("p"))
    pairs = "flatten(transform(p, (a, i) -> transform(slice(p, i + 2, size(p)), b -> struct(a.x as x0, a.y as y0, b.x as x1, b.y as y1))))"
    lines = points.select(*group, "p", F.explode(F.expr(pairs)).alias("q")).where("q.x1 > q.x0").withColumn("m", F.expr("(q.y1 - q.y0) / (q.x1 - q.x0)")).withColumn("b", F.expr("q.y0 - m * q.x0"))
    near = lines.withColumn("on", F.expr(f"filter(p, o -> abs(o.y - (b + m * o.x)) <= {float(tolerance)!r})")).withColumn("n", F.size("on"))
    scored = near.withColumn("mse", F.round(F.expr("aggregate(on, 0D, (s, o) -> s + pow(o.y - (b + m * o.x), 2)) / n"), 9)).withColumn("span", F.expr("array_max(transform(on, o -> o.x)) - array_min(transform(on, o -> o.x))"))
    order = F.struct("n", -F.col("mse"), "span", -F.col("q.x0"), -F.col("q.x1"), -F.col("q.y0"), -F.col("q.y1"))
    best = scored.groupBy(*group).agg(F.max_by(F.struct("m", "b", "n", "mse", "span"), order).alias("best"))
    return best.select(*group, F.col("best.m").alias("slope"), F.col("best.b").alias("intercept"), "best.n", "best.mse", "best.span")


def reading_order(df: DataFrame, group: list[str], x: str, y: str, height: float, band: float = 0.45) -> DataFrame:
    """``df`` with ``line`` and ``place`` (from 0): boxes by rows, a row reaching ``band`` heights below its topmost centre.

    Rows of a group are told in one pass over its sorted centres, within the group's row.
    """
    reach = float(band * height)
    sorted_ = df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(y).cast("double").alias("_y")))).alias("c"))
    starts = sorted_.select(*group, F.expr(f"aggregate(c, cast(array() as array<double>), (a, v) -> if(size(a) = 0 or v._y > element_at(a, -1) + {reach!r}, concat(a, array(v._y)), a))").alias("_starts"))
    lines = df.join(starts, group).withColumn("line", F.expr(f"size(filter(_starts, s -> s <= {y})) - 1")).drop("_starts")
    from pyspark.sql.window import Window

    return lines.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("line", x, y)) - 1)
