"""Resampling: bootstrap intervals of a mean."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bootstrap_mean(df: DataFrame, group: list[str], unit: str, value: str, repetitions: int = 1000, seed: int = 0) -> DataFrame:
    """group, mean, low, high: 95 % interval of the mean of ``value`` when whole units are drawn anew.

    Units are summed first; each then gets a Poisson(1) weight in each repetition from a hash of
    (group, unit, repetition), so that nothing is gathered and repeated runs agree.
    """
    units = df.groupBy(*group, unit).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(value).alias("n"))
    chance, total, steps = math.exp(-1), 0.0, []
    for k in range(12):
        total += chance
        steps.append(total)
        chance /= k + 1
    drawn = units.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repetitions)))).withColumn("u", F.pmod(F.xxhash64(*group, unit, "rep", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52))
    w = sum((F.col("u") > s).cast("int") for s in steps)
    means = drawn.groupBy(*group, "rep").agg((F.sum(w * F.col("s")) / F.nullif(F.sum(w * F.col("n")), F.lit(0))).alias("m"))
    bounds = means.groupBy(*group).agg(F.array_sort(F.collect_list("m")).alias("a")).where("size(a) > 0")
    ends = bounds.select(*group, F.expr("a[cast(0.025 * size(a) as int)]").alias("low"), F.expr("a[greatest(0, cast(0.975 * size(a) as int) - 1)]").alias("high"))
    return units.groupBy(*group).agg((F.sum("s") / F.sum("n")).alias("mean")).join(ends, group)
