"""Cohorts of registrations: gates, status, a common frame, spreads and shifts."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions import geometry, scalar
from millwright.operators.robust import MAD_SIGMA, join_groups, medians, quantiles
from millwright.store import cut

# fixed values
SCALES, ROTATION, SHEAR, COHORT = (0.80, 1.25), 3.0, 0.05, 0.04
MAP = {k: k for k in geometry.PARTS}


def parts(df: DataFrame, m: dict | None = None) -> DataFrame:
    m = m or MAP
    return df.withColumns(scalar.decompose(*(m[k] for k in "abcd")))


def plausible(df: DataFrame, group: list[str], converged: Column) -> DataFrame:
    """Adds ``accepted``: converged, finite, within the fixed limits, and within the cohort's band of log scales if
    at least three rows of the group are that far."""
    made = parts(df)
    finite = F.lit(True)
    for k in ("scale_x", "scale_y", "rotation_deg", "shear"):
        finite = finite & F.col(k).isNotNull() & ~F.isnan(k) & (F.abs(k) < F.lit(math.inf))
    gate = converged & finite & F.col("scale_x").between(*SCALES) & F.col("scale_y").between(*SCALES) & (F.abs("rotation_deg") <= ROTATION) & (F.abs("shear") <= SHEAR)
    made = made.withColumn("_gate", F.coalesce(gate, F.lit(False)))
    logs = {f"_m{axis}": F.log(F.col(f"scale_{axis}")) for axis in "xy"}
    made = join_groups(made, medians(made, group, logs, F.col("_gate")), group, "left")
    off = {f"_s{axis}": F.abs(logs[f"_m{axis}"] - F.col(f"_m{axis}")) for axis in "xy"}
    made = join_groups(made, medians(made, group, off, F.col("_gate")).select(*group, *off), group, "left")
    accepted = F.col("_gate")
    for axis in "xy":
        radius = F.greatest(F.lit(math.log1p(COHORT)), 6 * MAD_SIGMA * F.col(f"_s{axis}"))
        accepted = accepted & ((F.col(f"n__m{axis}") < 3) | (off[f"_s{axis}"] <= radius))
    return made.select(*df.columns, F.coalesce(accepted, F.lit(False)).alias("accepted"))


def status(df: DataFrame, group: list[str]) -> DataFrame:
    """Adds ``registration_status`` and ``registration_reasons`` (rejections first), and moves the sizes of rejected
    rows to ``candidate_*``."""
    # fixed values: name, least radius, whether logarithms are compared, whether only large values stand out
    checks = [("scale_x", math.log1p(COHORT), True, False), ("scale_y", math.log1p(COHORT), True, False), ("residual_rotation_deg", 2.0, False, False), ("unconstrained_shear", 0.02, False, False), ("residual_rms", 0.15, False, True)]
    x = {n: F.log(F.col(n)) if log else F.col(n).cast("double") for n, _, log, _ in checks}
    made = join_groups(df, medians(df, group, {f"_m_{n}": v for n, v in x.items()}).select(*group, *[f"_m_{n}" for n in x]), group, "left")
    off = {n: F.abs(v - F.col(f"_m_{n}")) for n, v in x.items()}
    made = join_groups(made, medians(made, group, {f"_s_{n}": v for n, v in off.items()}).select(*group, *[f"_s_{n}" for n in x]), group, "left")
    far = {n: (x[n] - F.col(f"_m_{n}") if upper else off[n]) > F.greatest(F.lit(least), 6 * MAD_SIGMA * F.col(f"_s_{n}")) for n, least, _, upper in checks}
    made = made.withColumns({f"_{n}": v for n, v in far.items()})
    # the reasons are output values and fixed
    why = lambda cond, text: F.when(cond, text if isinstance(text, Column) else F.lit(text))
    rejected = F.array_compact(F.array(why(F.col("_scale_x"), "scale_x cohort outlier"), why(F.col("_scale_y"), "scale_y cohort outlier"), why(F.col("accepted_affine_updates") == 0, "no accepted affine refinement")))
    review = F.array_compact(
        F.array(
            why(F.col("alignment_failures") != 0, F.concat(F.col("alignment_failures").cast("string"), F.lit(" ECC failures"))),
            why(F.col("alignment_rejections") != 0, F.concat(F.col("alignment_rejections").cast("string"), F.lit(" implausible ECC updates"))),
            why(F.col("_residual_rotation_deg"), "residual rotation outlier"),
            why(F.col("_unconstrained_shear"), "free shear outlier"),
            why(F.col("_residual_rms"), "residual RMS outlier"),
        )
    )
    out = F.size(rejected) > 0
    sizes = [c for c in df.columns if c.startswith("design_")]
    keep = [F.when(~out, F.col(c)).alias(c) if c in sizes else F.col(c) for c in df.columns]
    moved = [F.when(out, F.col(c)).alias(f"candidate_{c}") for c in sizes]
    return made.select(*keep, *moved, F.when(out, "rejected").when(F.size(review) > 0, "review").otherwise("ok").alias("registration_status"), F.concat(rejected, review).alias("registration_reasons"))


def common_frame(df: DataFrame, group: list[str]) -> DataFrame:
    """The maps after the inverse of their mean: geometric mean scales, mean rotation and mean shift of the group."""
    made = parts(df)
    mean = made.groupBy(*group).agg(F.exp(F.avg(F.log("scale_x"))).alias("_gx"), F.exp(F.avg(F.log("scale_y"))).alias("_gy"), F.radians(F.avg("rotation_deg")).alias("_t"), F.avg("tx").alias("_mx"), F.avg("ty").alias("_my"))
    made = join_groups(made, mean, group)
    cos, sin = F.cos("_t"), F.sin("_t")
    p, q, u, v = cos / F.col("_gx"), sin / F.col("_gx"), -sin / F.col("_gy"), cos / F.col("_gy")
    a, b, c, d = (F.col(k) for k in "abcd")
    dx, dy = -(p * F.col("_mx") + q * F.col("_my")), -(u * F.col("_mx") + v * F.col("_my"))
    new = {"a": a * p + b * u, "b": a * q + b * v, "tx": a * dx + b * dy + F.col("tx"), "c": c * p + d * u, "d": c * q + d * v, "ty": c * dx + d * dy + F.col("ty")}
    return made.select(*[new[k].alias(k) if k in new else F.col(k) for k in df.columns])


def recentred(df: DataFrame, group: list[str], x: float, y: float) -> DataFrame:
    """Rigid maps with the group's median rotation, and its median displacement of (x, y), set to zero."""
    at_x, at_y = geometry.apply_affine(MAP, F.lit(x), F.lit(y))
    made = df.withColumns({"_turn": F.atan2("c", "a"), "_dx": at_x - x, "_dy": at_y - y})
    mids = medians(made, group, {f"{k}_m": k for k in ("_turn", "_dx", "_dy")})
    made = join_groups(made, mids, group)
    turn, dx, dy = (F.col(k) - F.col(f"{k}_m") for k in ("_turn", "_dx", "_dy"))
    cos, sin = F.cos(turn), F.sin(turn)
    new = {"a": cos, "b": -sin, "tx": x + dx - (cos * x - sin * y), "c": sin, "d": cos, "ty": y + dy - (sin * x + cos * y)}
    return made.select(*[new[k].alias(k) if k in new else F.col(k) for k in df.columns])


def trimmed_shift(df: DataFrame, group: list[str], x: str, y: str, least: int = 100, keep: float = 0.85) -> DataFrame:
    """Per group the median vector, again without what is farther from it than the ``keep`` quantile, and the
    MAD scatter of what is left around it. Below ``least`` vectors shift and scatter are 0."""
    given = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))

    def around(rows, name):
        """Rows and their distance from the median vector, written: what follows reads them, and doesn't make them again."""
        near = join_groups(rows, medians(rows, group, {"_cx": "_x", "_cy": "_y"}).select(*group, "_cx", "_cy"), group)
        return cut(near.withColumn("_r", F.hypot(F.col("_x") - F.col("_cx"), F.col("_y") - F.col("_cy"))), name)

    first = around(given, "shift-first")
    kept = join_groups(first, quantiles(first, group, "_r", {"_far": keep}).drop("n"), group).where("_r <= _far")
    last = around(kept.select(*group, "_x", "_y"), "shift-kept")
    mid = join_groups(last, quantiles(last, group, "_r", {"_rm": 0.5}).drop("n"), group).withColumn("_off", F.abs(F.col("_r") - F.col("_rm")))
    spread = quantiles(mid, group, "_off", {"_s": 0.5}).drop("n")
    centre = last.groupBy(*group).agg(F.first("_cx").alias("_cx"), F.first("_cy").alias("_cy"))
    few = first.groupBy(*group).agg(F.count("*").alias("n"))
    none = df.select(*group).distinct()
    found = join_groups(join_groups(join_groups(none, few, group, "left"), centre, group, "left"), spread, group, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    enough = F.col("n") >= least
    return found.select(*group, "n", *[F.when(enough, v).otherwise(0.0).alias(k) for k, v in (("shift_x", F.col("_cx")), ("shift_y", F.col("_cy")), ("scatter", MAD_SIGMA * F.col("_s")))])


def spread(x, y, least: int = 10) -> Column:
    """Square root of the determinant of the covariance; 0 below ``least`` points."""
    det = F.var_samp(x) * F.var_samp(y) - F.covar_samp(x, y) * F.covar_samp(x, y)
    return F.when(F.count(x) < least, 0.0).otherwise(F.sqrt(F.greatest(det, F.lit(0.0))))


def agreement(a, b, seen: Column, least: int = 500) -> Column:
    """Correlation over what both sides see; NaN below ``least`` common rows or without variance."""
    x, y = F.when(seen, scalar.col(a).cast("double")), F.when(seen, scalar.col(b).cast("double"))
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    return F.when((n >= least) & (F.var_pop(x) * F.var_pop(y) > 0), F.corr(x, y)).otherwise(F.lit(float("nan")))


def phase_plane(df: DataFrame, group: list[str], x: str, y: str, phase: str, weight: str, key: str) -> DataFrame:
    """fx, fy: frequency error per group from phase = offset + 2 pi f . centre, by weighted least squares around the
    row with the largest weight (the least ``key`` on ties)."""
    best = df.groupBy(*group).agg(F.max_by(F.struct(x, y, phase), F.struct(F.col(weight), -F.col(key))).alias("_o"))
    rows = join_groups(df, best, group)
    rel = F.pmod(F.col(phase) - F.col(f"_o.{phase}") + math.pi, F.lit(2 * math.pi)) - math.pi
    rows = rows.withColumns({"_x": F.col(x) - F.col(f"_o.{x}"), "_y": F.col(y) - F.col(f"_o.{y}"), "_p": rel, "_w": F.col(weight)})
    terms = {"1": F.lit(1.0), "x": F.col("_x"), "y": F.col("_y"), "p": F.col("_p")}
    sums = {f"_{i}{j}": F.sum(F.col("_w") * terms[i] * terms[j]) for i in "1xy" for j in "1xyp"}
    got = rows.groupBy(*group).agg(*[v.alias(k) for k, v in sums.items()])
    _, fx, fy = geometry.solve3([[F.col(f"_{i}{j}") for j in "1xy"] for i in "1xy"], [F.col(f"_{i}p") for i in "1xy"])
    return got.select(*group, (fx / (2 * math.pi)).alias("fx"), (fy / (2 * math.pi)).alias("fy"))
