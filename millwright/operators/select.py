"""Selection: cross-support, stability, ladders, cascades, comparisons, keyed classification."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last in ``order``."""
    others = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")


def cross_support(df: DataFrame, group: list[str], kind: str, pitch: str, line: str, score: str, key: str, bonus: float = 1.1, pitch_tolerance: float = 0.02, line_fraction: float = 0.08) -> DataFrame:
    """The best candidate of each group; one that another kind supports counts ``bonus`` times.

    Support: the log pitch ratio and the line distance are small. Candidates meet by group and
    neighbouring pitch cells, not all with all.
    """
    cell = F.floor(F.log(F.col(pitch)) / pitch_tolerance).cast("long")
    a = df.withColumn("_cell", cell)
    b = df.select(*group, F.col(kind).alias("_k"), F.col(pitch).alias("_p"), F.col(line).alias("_l"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    near = (F.col(kind) != F.col("_k")) & (F.abs(F.log(F.col(pitch) / F.col("_p"))) <= pitch_tolerance) & (F.abs(F.col(line) - F.col("_l")) <= line_fraction * F.col(pitch))
    joined = [a[g] == b[g] for g in group] + [a["_cell"] == b["_cell"], near]
    supported = a.join(b, joined, "left_semi").select(*df.columns, F.lit(True).alias("supported"))
    alone = a.join(b, joined, "left_anti").select(*df.columns, F.lit(False).alias("supported"))
    full = supported.unionByName(alone).withColumn("adjusted", F.col(score) * F.when(F.col("supported"), bonus).otherwise(1.0))
    row = F.max_by(F.struct(key, "adjusted", "supported"), F.struct("adjusted", F.negate(F.col(key)))).alias("_row")
    return full.groupBy(*group).agg(row).select(*group, "_row.*")


def first_strong_else_best(df: DataFrame, group: list[str], order: list[str], strong: Column, evidence: Column) -> DataFrame:
    """Per group the first strong item in order, else the one with most evidence; and how many were tried."""
    w = Window.partitionBy(*group).orderBy(*order)
    r = df.withColumn("_rn", F.row_number().over(w)).withColumn("_s", strong).withColumn("_e", evidence)
    first = F.min(F.when(F.col("_s"), F.col("_rn")))
    best = F.max_by("_rn", F.struct("_e", F.negate(F.col("_rn"))))
    return r.groupBy(*group).agg(F.coalesce(first, best).cast("int").alias("chosen"), F.coalesce(first, F.max("_rn")).cast("int").alias("attempts"), first.isNotNull().alias("strong"))


def cascade(df: DataFrame, item: str, method: str, safe: Column, order: list[str]) -> DataFrame:
    """Methods in order; each solves the items it is safe for that none before it solved."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(method))
    first = df.where(safe).withColumn("_r", rank).where("_r > 0").groupBy(item).agg(F.min("_r").alias("_r"))
    solved = first.groupBy("_r").agg(F.count("*").alias("solved"))
    return solved.select(F.get(F.array(*map(F.lit, order)), (F.col("_r") - 1).cast("int")).alias("method"), "solved", (F.col("_r") * F.col("solved")).alias("cost"))


def before_after(before: DataFrame, after: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Each key's change: gained, lost, same, changed; with the difference."""
    b, a = before.select(*keys, F.col(value).alias("_b")), after.select(*keys, F.col(value).alias("_a"))
    d = F.abs(F.col("_a") - F.col("_b"))
    change = F.when(F.col("_b").isNull(), "gained").when(F.col("_a").isNull(), "lost").when(d <= tolerance, "same").otherwise("changed")
    return b.join(a, keys, "full_outer").select(*keys, change.alias("change"), d.alias("difference"))


def leave_one_out(df: DataFrame, group: str, member: str, value: str, least: int) -> DataFrame:
    """Per (group, member) the median over the group's other members, if they have ``least`` values.

    The k-th of the others is among the k-th to the (k + own)-th of all, so a member looks at as many rows as it
    has, and two more: work and rows stay linear however large the group. Null values don't count;
    rows with a null group or member neither. A group's only member has no row.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(member).isNotNull()).select(F.col(group).alias("_g"), F.col(member).alias("_m"), F.col(value).cast("double").alias("_v"))
    sizes = rows.groupBy("_g", "_m").agg(F.count("_v").alias("_own"))
    every = Window.partitionBy("_g")
    sizes = sizes.withColumns({"_n": F.sum("_own").over(every) - F.col("_own"), "_members": F.count("*").over(every)}).where("_members > 1")
    sizes = sizes.withColumns({"_low": F.floor((F.col("_n") - 1) / 2), "_high": F.floor(F.col("_n") / 2)})
    ranked = rows.where("_v is not null").withColumn("_i", F.row_number().over(every.orderBy("_v", "_m")) - 1)
    before = ranked.join(sizes.select("_g", "_m", "_low"), ["_g", "_m"]).groupBy("_g", "_m").agg(F.count_if(F.col("_i") < F.col("_low")).alias("_before"))
    asked = sizes.where("_n > 0").withColumn("_i", F.explode(F.sequence("_low", F.col("_high") + F.col("_own"))))
    met = asked.join(ranked.withColumnRenamed("_m", "_of"), ["_g", "_i"])
    own = (F.col("_of") == F.col("_m")).cast("int")
    inside = F.sum(own).over(Window.partitionBy("_g", "_m").orderBy("_i"))
    met = met.withColumns({"_mine": own, "_inside": inside}).where("_mine = 0").join(before, ["_g", "_m"], "left")
    at = F.col("_i") - F.col("_inside") - F.coalesce("_before", F.lit(0))
    pick = lambda k: F.max(F.when(at == F.col(k), F.col("_v")))
    found = met.groupBy("_g", "_m").agg(((pick("_low") + pick("_high")) / 2).alias("_ref"))
    told = sizes.join(found, ["_g", "_m"], "left")
    return told.select(F.col("_g").alias(group), F.col("_m").alias(member), F.col("_n").alias("n"), F.when(F.col("_n") >= least, F.col("_ref")).alias("reference"))


def reconcile(a, b, tolerance: float = 0.05, divisors=(1, 2, 3)) -> tuple[Column, Column, Column]:
    """(low, high, divisor) of two pitches: their mean if they agree after dividing the larger, else both."""
    low, high = F.least(a, b), F.greatest(a, b)
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    divisor = F.lit(None).cast("int")
    for k in reversed(divisors):
        divisor = F.when(F.abs(high / k - low) <= tolerance * low, k).otherwise(divisor)
    divisor = F.when(both, divisor)
    mean = (low + high / divisor) / 2
    return F.when(divisor.isNotNull(), mean).otherwise(low), F.when(both & divisor.isNull(), high), divisor
