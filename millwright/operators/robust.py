"""Aggregates that stand outliers: modes, medians, merges with quorums, robust lines, splits."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millwright.store import cut

MAD_SIGMA = 1.4826


def sample_sd(x) -> Column:
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def unique_mode(df: DataFrame, group: list[str], pair: list[str]) -> DataFrame:
    """Per group its most frequent pair, null on a tie; counts are pre-aggregated before any window."""
    counts = df.groupBy(*group, *pair).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.rank().over(Window.partitionBy(*group).orderBy(F.desc("n"))))
    top = ranked.where("r = 1").groupBy(*group).agg(F.count("*").alias("ties"), *[F.first(p).alias(f"mode_{p}") for p in pair])
    return top.select(*group, *[F.when(F.col("ties") == 1, F.col(f"mode_{p}")).alias(f"mode_{p}") for p in pair])


def mode_split(df: DataFrame, group: list[str], pair: list[str]) -> DataFrame:
    """``df`` with its group's mode, ``inlier`` and ``reason``."""
    tied = F.col(f"mode_{pair[0]}").isNull()
    same = F.lit(True)
    for p in pair:
        same = same & (F.col(p) == F.col(f"mode_{p}"))
    made = df.join(unique_mode(df, group, pair), group)
    return made.withColumn("inlier", F.coalesce(same, F.lit(False))).withColumn("reason", F.when(tied, "no unique mode").when(same, "mode").otherwise("differs"))


def ranged(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with ``_range``: written in ranges of ``order``, of which each holds a run of the sorted rows.

    Written once, as a second run of the same plan could draw other borders.
    """
    return cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)


def deltas(df: DataFrame, partition: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Next minus current of each value. Without ``partition`` the rows are one series, in ranges: each range's last row
    takes the first row of the next one, so no task holds the series."""
    if partition:
        w = Window.partitionBy(*partition).orderBy(*order)
        return df.select(*df.columns, *[(F.lead(v).over(w) - F.col(v)).alias(f"delta_{v}") for v in values])
    rows = ranged(df, order, "series")
    first = rows.groupBy("_range").agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_first"))
    after = first.select("_range", F.lead("_first").over(Window.orderBy("_range")).alias("_after"))  # a row a range
    w = Window.partitionBy("_range").orderBy(*order)
    told = rows.withColumn("_next", F.lead(F.struct(*values)).over(w)).join(F.broadcast(after), "_range")
    next_ = F.coalesce("_next", "_after")
    return told.select(*df.columns, *[(next_[v] - F.col(v)).alias(f"delta_{v}") for v in values])


def quantiles(df: DataFrame, group: list[str], value, fractions: dict[str, float], also: Column | None = None) -> DataFrame:
    """Exact quantiles per group, interpolated linearly; columns named by ``fractions``, and ``n``.

    Equal values are counted before any shuffle, and ranks come from sums over the sorted counts, which
    spill: no group's values are held in one buffer. Null and NaN values don't count; ``also`` limits the
    rows. Groups without values have no row.
    """
    v = value if isinstance(value, Column) else F.col(value)
    rows = df.select(*group, v.cast("double").alias("_v"), (F.lit(True) if also is None else also).alias("_use")).where("_use and _v is not null and not isnan(_v)")
    counts = rows.groupBy(*group, "_v").agg(F.count("*").alias("_k"))
    keys = group or [F.lit(0)]
    upto = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_cum", F.sum("_k").over(upto)).withColumn("_n", F.sum("_k").over(Window.partitionBy(*keys)))
    made = []
    for name, f in fractions.items():
        place = (F.col("_n") - 1) * F.lit(float(f))
        at = lambda k: F.max(F.when((F.col("_cum") > k) & (F.col("_cum") - F.col("_k") <= k), F.col("_v")))
        low, high, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        made.append((low + part * (high - low)).alias(name))
    return ranked.groupBy(*group).agg(*made, F.max("_n").alias("n"))


def medians(df: DataFrame, group: list[str], values: dict, also: Column | None = None) -> DataFrame:
    """Medians of several values in one pass: group, the names of ``values`` (name -> column), and ``n_<name>`` of each."""
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (v if isinstance(v, Column) else F.col(v)).cast("double").alias("v")) for k, v in values.items()]))
    rows = df.select(*group, (F.lit(True) if also is None else also).alias("_u"), stacked.alias("_s")).where("_u").select(*group, "_s.k", "_s.v")
    told = quantiles(rows.withColumnRenamed("k", "_which"), [*group, "_which"], "v", {"_m": 0.5})
    pick = lambda c, k: F.max(F.when(F.col("_which") == k, F.col(c)))
    return told.groupBy(*group).agg(*[pick("_m", k).alias(k) for k in values], *[F.coalesce(pick("n", k), F.lit(0)).alias(f"n_{k}") for k in values])


def join_groups(df: DataFrame, few: DataFrame, group: list[str], how: str = "inner") -> DataFrame:
    """One row a group joined to its rows; a null key is a group too. Without keys the one row is attached."""
    if not group:
        return df.crossJoin(F.broadcast(few))  # one row
    named = few.select(*[F.col(g).alias(f"_g_{g}") for g in group], *[c for c in few.columns if c not in group])
    on = F.lit(True)
    for g in group:
        on = on & df[g].eqNullSafe(named[f"_g_{g}"])
    return df.join(named, on, how).drop(*[f"_g_{g}" for g in group])


def outliers(df: DataFrame, group: list[str], value: str, least: float, sigmas: float = 6.0, log: bool = False, upper_only: bool = False) -> DataFrame:
    """Adds median, radius and ``outlier``: farther from the median than max(least, sigmas * 1.4826 * MAD)."""
    x = F.log(F.col(value)) if log else F.col(value).cast("double")
    data = df.withColumn("_x", x)
    off = join_groups(data, quantiles(data, group, "_x", {"median": 0.5}).drop("n"), group).withColumn("_off", F.abs(F.col("_x") - F.col("median")))
    spread = quantiles(off, group, "_off", {"_mad": 0.5}).select(*group, F.greatest(F.lit(float(least)), sigmas * MAD_SIGMA * F.col("_mad")).alias("radius"))
    side = (F.col("_x") - F.col("median")) if upper_only else F.col("_off")
    return join_groups(off, spread, group).withColumn("outlier", side > F.col("radius")).drop("_x", "_off")


def circular(phase) -> tuple[Column, Column]:
    """(mean in [0, 1), resultant length) of phases."""
    angle = 2 * math.pi * phase
    s, c, n = F.sum(F.sin(angle)), F.sum(F.cos(angle)), F.count(phase)
    return F.pmod(F.atan2(s, c) / (2 * math.pi), F.lit(1.0)), F.sqrt(s * s + c * c) / n


def robust_line(df: DataFrame, group: list[str], x: str, y: str, tolerance: float, rounds: int = 6) -> DataFrame:
    """slope, intercept, kept: least squares over the points kept, until what is kept is stable.

    A point is kept if its residual is at most max(tolerance, 3 * 1.4826 * MAD) from the residuals'
    median; median and MAD are those of the points kept so far. Points that left may come back. After
    ``rounds`` rounds the last points kept hold. Groups with fewer than 3 points kept have no line.
    """
    data = df.select(*group, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.lit(True).alias("_in")).where("_x is not null and _y is not null")
    fit = [F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), F.count("*").alias("kept")]
    for k in range(rounds):
        line = data.where("_in").groupBy(*group).agg(*fit)
        rest = join_groups(data, line.where("kept >= 3"), group, "left").withColumn("_r", F.col("_y") - F.col("slope") * F.col("_x") - F.col("intercept"))
        off = join_groups(rest, quantiles(rest, group, "_r", {"_m": 0.5}, F.col("_in")).drop("n"), group, "left").withColumn("_o", F.abs(F.col("_r") - F.col("_m")))
        mad = quantiles(off, group, "_o", {"_s": 0.5}, F.col("_in")).select(*group, F.greatest(F.lit(float(tolerance)), 3 * MAD_SIGMA * F.col("_s")).alias("_t"))
        after = join_groups(off, mad, group, "left").select(*group, "_x", "_y", "_in", F.coalesce(F.col("_o") <= F.col("_t"), F.col("_in")).alias("_next"))
        after = cut(after, f"line-{k}")
        stable = not after.where("_in <> _next").limit(1).count()
        data = after.select(*group, "_x", "_y", F.col("_next").alias("_in"))
        if stable:
            break
    return data.where("_in").groupBy(*group).agg(*fit).where("kept >= 3")


def weighted_merge(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0.0))).alias("merged"), F.sum(weight).alias("coverage"))


def median_merge(df: DataFrame, keys: list[str], value: str, seen: Column, least) -> DataFrame:
    """Median of what was seen, null below the quorum."""
    v = F.when(seen, F.col(value).cast("double"))
    all_ = df.select(*keys).distinct()
    found = join_groups(all_, quantiles(df, keys, v, {"_m": 0.5}).withColumnRenamed("n", "seen"), keys, "left")
    return found.select(*keys, F.coalesce("seen", F.lit(0)).alias("seen"), F.when(F.col("seen") >= least, F.col("_m")).alias("merged"))


def otsu(df: DataFrame, value: str, bins: int = 256) -> DataFrame:
    """The bin border with the largest variance between both sides. The histogram has ``bins`` rows."""
    lim = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    b = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int")
    hist = df.select(value).join(F.broadcast(lim)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    up = Window.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(F.lit(0))
    h = hist.select("bin", F.sum("n").over(up).alias("w"), F.sum(F.col("n") * F.col("bin")).over(up).alias("s"), F.sum("n").over(every).alias("tw"), F.sum(F.col("n") * F.col("bin")).over(every).alias("ts"))
    a, c = F.col("s") / F.col("w"), (F.col("ts") - F.col("s")) / (F.col("tw") - F.col("w"))
    return h.where("w < tw").select("bin", (F.col("w") * 1.0 * (F.col("tw") - F.col("w")) * (a - c) * (a - c)).alias("between")).orderBy(F.desc("between"), "bin").limit(1)


def discrete_quantiles(df: DataFrame, group: list[str], value: str, fraction: float) -> DataFrame:
    """Per group: cut_off (the item n*f, cut off), rounded (the item (n-1)*f, rounded half to even), linear."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    by = Window.partitionBy(*group)
    ranked = counts.withColumn("_cum", F.sum("_k").over(by.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_k").over(by))
    at = lambda k: F.max(F.when((F.col("_cum") > k) & (F.col("_cum") - F.col("_k") <= k), F.col("_v")))
    items = ranked.groupBy(*group).agg(at(F.least(F.col("_n") - 1, F.floor(F.col("_n") * fraction))).alias("cut_off"), at(F.rint((F.col("_n") - 1) * fraction)).alias("rounded"))
    return join_groups(items, quantiles(df, group, value, {"linear": fraction}).drop("n"), group)
