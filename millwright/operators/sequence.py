"""Operators on series: (series, position, value). Frames and offset joins, one series to a partition key."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millwright.functions.scalar import natural_key
from millwright.operators.robust import ranged


def sustained_run(df: DataFrame, series: list[str], position: str, flag, length: int = 4) -> DataFrame:
    """Per series the first position from which ``flag`` holds ``length`` times in a row; null if none."""
    w = Window.partitionBy(*series).orderBy(position).rowsBetween(0, length - 1)
    run = df.withColumn("_n", F.sum(flag.cast("int")).over(w))
    return run.groupBy(*series).agg(F.min(F.when(F.col("_n") == length, F.col(position))).alias("first_run"))


def closing(df: DataFrame, series: list[str], position: str, value: str, half: int = 4) -> DataFrame:
    """Running maximum, then running minimum, over 2 * half + 1 rows; nulls are left out."""
    w = Window.partitionBy(*series).orderBy(position).rowsBetween(-half, half)
    return df.withColumn("_m", F.max(value).over(w)).withColumn("closed", F.min("_m").over(w)).drop("_m")


def smooth(df: DataFrame, series: list[str], position: str, value: str, sigma: float) -> DataFrame:
    """Gaussian mean over radius 3 sigma, the ends repeated beyond the series."""
    radius = math.ceil(3 * sigma)
    w = Window.partitionBy(*series).orderBy(position)
    ends = Window.partitionBy(*series).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = F.lit(0.0)
    for k, g in zip(range(-radius, radius + 1), weights, strict=True):
        v = F.lag(value, -k).over(w) if k < 0 else F.lead(value, k).over(w)
        edge = F.first(value).over(ends) if k < 0 else F.last(value).over(ends)
        v = F.lag(value, abs(k)).over(w) if k < 0 else v
        total = total + g * F.coalesce(v, edge)
    return df.withColumn("smooth", total / sum(weights))


def autocorrelation(df: DataFrame, series: list[str], position: str, value: str, lags: int) -> DataFrame:
    """(series, lag, r) of the values about their mean; each row is sent once to each lag, not to all rows."""
    w = Window.partitionBy(*series)
    own = df.select(*series, F.row_number().over(w.orderBy(position)).alias("_t"), (F.col(value) - F.avg(value).over(w)).alias("_d"))
    base = own.groupBy(*series).agg(F.sum(F.col("_d") * F.col("_d")).alias("_s"))
    ahead = own.select(*series, F.col("_t").alias("_u"), F.col("_d").alias("_e"))
    spread = own.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags)))).withColumn("_u", F.col("_t") + F.col("lag"))
    return spread.join(ahead, [*series, "_u"]).groupBy(*series, "lag").agg(F.sum(F.col("_d") * F.col("_e")).alias("_p")).join(base, series).select(*series, "lag", (F.col("_p") / F.col("_s")).alias("r"))


def peaks(df: DataFrame, series: list[str], position: str, value: str) -> DataFrame:
    """Local maxima and their prominence: height above the higher of both lowest points on the way to
    higher ground (or to the end of the series)."""
    w = Window.partitionBy(*series).orderBy(position)
    r = df.withColumn("_t", F.row_number().over(w)).withColumn("_l", F.lag(value).over(w)).withColumn("_n", F.lead(value).over(w))
    tops = r.where((F.col(value) > F.col("_l")) & (F.col(value) >= F.col("_n"))).select(*series, position, F.col(value).alias("height"), F.col("_t").alias("_top"))
    rows = r.select(*series, "_t", F.col(value).alias("_v"))
    met = tops.join(rows, series)
    left, right = F.col("_t") < F.col("_top"), F.col("_t") > F.col("_top")
    higher = F.col("_v") > F.col("height")
    bounds = met.groupBy(*series, position, "height", "_top").agg(F.max(F.when(left & higher, F.col("_t"))).alias("_a"), F.min(F.when(right & higher, F.col("_t"))).alias("_b"))
    inside = bounds.join(rows, series)
    low_left = F.min(F.when(left & (F.col("_t") > F.coalesce("_a", F.lit(0))), F.col("_v")))
    low_right = F.min(F.when(right & (F.col("_t") < F.coalesce("_b", F.lit(1 << 30))), F.col("_v")))
    got = inside.groupBy(*series, position, "height").agg(low_left.alias("_ll"), low_right.alias("_lr"))
    return got.select(*series, position, "height", (F.col("height") - F.greatest("_ll", "_lr")).alias("prominence"))


def crossings(df: DataFrame, series: list[str], position: str, value: str, level) -> DataFrame:
    """Where the series passes ``level`` between two rows, by linear interpolation of the row number."""
    w = Window.partitionBy(*series).orderBy(position)
    r = df.withColumn("_t", F.row_number().over(w)).withColumn("_n", F.lead(value).over(w)).withColumn("_level", level)
    up = (F.col(value) < F.col("_level")) != (F.col("_n") < F.col("_level"))
    return r.where(up).select(*series, (F.col("_t") + (F.col("_level") - F.col(value)) / (F.col("_n") - F.col(value))).alias("crossing"))


def hysteresis(df: DataFrame, series: list[str], position: str, value: str, low, high) -> DataFrame:
    """Runs above ``low`` that reach ``high``: first, last, rows, peak."""
    w = Window.partitionBy(*series).orderBy(position)
    r = df.withColumn("_t", F.row_number().over(w)).withColumn("_low", low).withColumn("_high", high).where(F.col(value) > F.col("_low"))
    r = r.withColumn("_run", F.col("_t") - F.row_number().over(w))
    got = r.groupBy(*series, "_run").agg(F.min("_t").alias("first"), F.max("_t").alias("last"), F.count("*").alias("rows"), F.max(value).alias("peak"), F.first("_high").alias("_h"))
    return got.where("peak >= _h").drop("_run", "_h")


def natural_order(df: DataFrame, name: str, tie: str) -> DataFrame:
    """``df`` with ``place``, from 1, in the natural order of ``name`` (nulls first), equal ones by ``tie``.

    Written in ranges of the order; each range's rows are numbered on from the count of the ranges before it.
    """
    rows = ranged(df.withColumn("_key", natural_key(name)), ["_key", tie], "order")
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("_before"))  # a row a range
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_key", tie))
    return rows.join(F.broadcast(before), "_range").select(*df.columns, (F.col("_before") + place).alias("place"))
