"""Sides, methods and impressions compared: predicates, evidence, pairs, splits, consistent choices."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millwright.functions.scalar import circular_mismatch, col
from millwright.operators.robust import join_groups, quantiles

# fixed values
ALIASES = {"t": "top", "b": "bottom", "l": "left", "r": "right", "top": "top", "bottom": "bottom", "left": "left", "right": "right"}
OPPOSITE = {"top": "bottom", "bottom": "top", "left": "right", "right": "left"}
TARGETS = {"horizontal": (14.25, 14.50), "vertical": (14.75, 15.00)}
LEAST_ARCS = 5


def lookup(names: dict, key) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), col(key))


def parse_side(value) -> Column:
    """The side that a name or its first letter stands for; null for anything else."""
    return lookup(ALIASES, F.lower(F.trim(col(value))))


def reliable(has_line, source, arcs) -> Column:
    return F.coalesce(col(has_line) & (col(source) == "circle_arcs") & (col(arcs) >= LEAST_ARCS), F.lit(False))


def finite_both(a, b) -> Column:
    """Both values there and finite."""
    ok = lambda x: col(x).isNotNull() & ~F.isnan(col(x)) & (F.abs(col(x)) < F.lit(math.inf))
    return ok(a) & ok(b)


def confidence(circles, coverage, ok, rms) -> Column:
    """Evidence to compare by: circles, coverage, whether ok, then small residuals; no residual counts as the worst."""
    return F.struct(col(circles).alias("circles"), F.coalesce(col(coverage).cast("double"), F.lit(0.0)).alias("coverage"), col(ok).alias("ok"), F.coalesce(-col(rms).cast("double"), F.lit(-math.inf)).alias("fit"))


def recovery_targets(sides: DataFrame, key: list[str], tolerance: float = 1.5) -> DataFrame:
    """``sides`` (key, side, reliable, angle in degrees or null, confidence) with ``target``: not reliable, or the
    weaker member of an opposite pair that is more than ``tolerance`` apart and has no target yet.

    Of equal confidence the first of top/bottom and left/right is the target.
    """
    other = lookup(OPPOSITE, "side")
    twin = sides.select(*key, F.col("side").alias("_side"), F.col("angle").alias("_angle"), F.col("reliable").alias("_reliable"), F.col("confidence").alias("_confidence"))
    both = sides.withColumn("_side", other).join(twin, [*key, "_side"], "left")
    apart = F.coalesce(F.abs(F.col("angle") - F.col("_angle")) > tolerance, F.lit(False))
    first = F.col("side").isin("top", "left")
    weaker = (F.col("confidence") < F.col("_confidence")) | ((F.col("confidence") == F.col("_confidence")) & first)
    target = ~F.col("reliable") | (apart & F.col("reliable") & F.col("_reliable") & weaker)
    return both.select(*sides.columns, target.alias("target"))


def axis_value(values: dict, names: list[str], both: bool = False) -> Column:
    """Mean of the published values of some sides (name -> (value, published)); with ``both`` null unless all are."""
    given = [F.when(col(values[n][1]), col(values[n][0])) for n in names]
    n = sum((g.isNotNull().cast("int") for g in given[1:]), given[0].isNotNull().cast("int"))
    total = sum((F.coalesce(g, F.lit(0.0)) for g in given[1:]), F.coalesce(given[0], F.lit(0.0)))
    return F.when(n >= (len(names) if both else 1), total / n)


def axis_pairs(sides: DataFrame, key: list[str]) -> DataFrame:
    """(key, axis, a, b, difference) of opposite sides that both publish a gauge."""
    axis = F.when(F.col("side").isin("top", "bottom"), "tb").when(F.col("side").isin("left", "right"), "lr")
    of = lambda *names: F.max(F.when(F.col("side").isin(*names) & F.col("published"), F.col("gauge")))
    made = sides.where(axis.isNotNull()).groupBy(*key, axis.alias("axis")).agg(of("top", "left").alias("a"), of("bottom", "right").alias("b"))
    return made.where("a is not null and b is not null").withColumn("difference", F.abs(F.col("a") - F.col("b")))


def residual(side, gauge) -> Column:
    """Distance from the nearest target of the side's axis."""
    near = lambda names: F.least(*[F.abs(col(gauge) - t) for t in TARGETS[names]])
    return F.when(col(side).isin("top", "bottom"), near("horizontal")).otherwise(near("vertical"))


def enriched(df: DataFrame, side: str = "side", gauge: str = "gauge", opposite: str = "opposite_gauge", trusted: str = "reliable") -> DataFrame:
    """Adds ``delta`` to the opposite side, ``theory_residual`` and ``safe`` (trusted, delta <= .25, residual <= .50)."""
    made = df.withColumn("delta", F.abs(F.col(gauge) - F.col(opposite))).withColumn("theory_residual", residual(side, gauge))
    return made.withColumn("safe", F.coalesce(F.col(trusted) & (F.col("delta") <= 0.25) & (F.col("theory_residual") <= 0.50), F.lit(False)))


def method_summary(df: DataFrame, method: list[str], fits: str) -> DataFrame:
    """Of enriched rows: published, safe, bad, quantiles and most of delta over the published, and costs."""
    shown = F.col("reliable") & F.col("delta").isNotNull()
    counts = df.groupBy(*method).agg(
        F.count_if("reliable").alias("published"), F.count_if("safe").alias("safe"), F.count_if(shown & (F.col("delta") > 0.25)).alias("bad"),
        F.max(F.when(shown, F.col("delta"))).alias("most"), F.sum(F.coalesce(F.col(fits), F.lit(0))).alias("fits"), F.avg(F.coalesce(F.col(fits), F.lit(0))).alias("mean_fits"),
    )
    return join_groups(counts, quantiles(df, method, "delta", {"median": 0.5, "p90": 0.9}, shown).drop("n"), method, "left")


def nearest_class(value, classes: dict[str, float]) -> Column:
    """The name of the nearest value, the first on ties."""
    off = [F.abs(col(value) - F.lit(v)) for v in classes.values()]
    least = F.least(*off)
    return F.coalesce(*[F.when(o == least, F.lit(n)) for o, n in zip(off, classes, strict=True)])


def partition_agreement(df: DataFrame, group: list[str], first: str, second: str) -> DataFrame:
    """agreement, flipped, n of two labellings in 0 and 1, whichever way round the first is better read; the mean of
    both groups' recalls. Other labels don't count."""
    both = df.where(F.col(first).isin(0, 1) & F.col(second).isin(0, 1))
    rates = [F.avg(F.when(F.col(second) == g, (F.col(first) == g).cast("double"))) for g in (0, 1)]
    mean = lambda x, y: F.coalesce((x + y) / 2, x, y)
    made = both.groupBy(*group).agg(rates[0].alias("_r0"), rates[1].alias("_r1"), F.count("*").alias("n"))
    direct, flipped = mean(F.col("_r0"), F.col("_r1")), mean(1 - F.col("_r0"), 1 - F.col("_r1"))
    return made.select(*group, F.greatest(direct, flipped).alias("agreement"), (flipped > direct).alias("flipped"), "n")


def preservation_split(scores: DataFrame, group: list[str], key: str, score: str) -> DataFrame:
    """``scores`` with ``relative`` and ``selected``: the rows above one conspicuous gap of the sorted log scores.

    Without a gap that stands out, or if a small high tail stands over a bright rest, all readable rows
    (score above 0) stay; one row alone above the gap takes the next best with it. Ties by key.
    """
    live = scores.where(F.col(score) > 0).withColumn("_l", F.log(F.col(score)))
    order = Window.partitionBy(*group).orderBy("_l", key)
    every = Window.partitionBy(*group)
    gaps = live.select(*group, key, score, "_l", F.row_number().over(order).alias("_i"), (F.lead("_l").over(order) - F.col("_l")).alias("_gap"), F.count("*").over(every).alias("_n"), F.max(score).over(every).alias("_top"))
    best = gaps.where("_gap is not null").groupBy(*group).agg(F.max_by(F.struct("_i", "_gap", score), F.struct(F.col("_gap"), -F.col("_i"))).alias("_b"), F.max("_n").alias("_n2"), F.max("_top").alias("_t2"))
    rest = join_groups(gaps.where("_gap is not null"), best.select(*group, F.col("_b._i").alias("_at")), group).where("_i <> _at")
    typical = quantiles(rest, group, "_gap", {"_typical": 0.5}).drop("n")
    told = join_groups(best, typical, group, "left")
    gap, n = F.col("_b._gap"), F.col("_n2")
    distinct = F.when(n == 2, gap >= math.log(2.0)).otherwise((gap >= math.log(1.5)) & (gap >= 1.5 * F.greatest(F.coalesce("_typical", F.lit(0.0)), F.lit(1e-9))))
    tail = (n - F.col("_b._i") < F.ceil(n / 2)) & (F.col(f"_b.{score}") / F.col("_t2") >= 0.5)
    told = told.select(*group, F.when(distinct & ~tail, F.least(F.col("_b._i"), n - 2)).alias("_cut"))
    marked = join_groups(gaps.select(*group, key, "_i", "_top"), told, group, "left").select(*group, key, "_top", (F.col("_i") > F.coalesce("_cut", F.lit(0))).alias("selected"))
    out = scores.join(marked, [*group, key], "left")
    return out.select(*scores.columns, F.coalesce(F.col(score) / F.col("_top"), F.lit(0.0)).alias("relative"), F.coalesce("selected", F.lit(False)).alias("selected"))


def closest_to_average(df: DataFrame, key: str, pixel: list[str], value: str, count: int) -> DataFrame:
    """The ``count`` keys whose seen pixels differ least from the mean of all, missing pixels costing 255 a share."""
    mean = df.where(F.col(value).isNotNull()).groupBy(*pixel).agg(F.avg(value).alias("_mean"))
    all_ = mean.agg(F.count("*").alias("_all"))
    off = df.where(F.col(value).isNotNull()).join(mean, pixel).groupBy(key).agg(F.avg(F.abs(F.col(value) - F.col("_mean"))).alias("difference"), F.count("*").alias("shared"))
    made = off.crossJoin(F.broadcast(all_))  # one row
    return made.select(key, (F.col("difference") + 255.0 * (1 - F.col("shared") / F.greatest(F.col("_all"), F.lit(1)))).alias("cost")).orderBy("cost", key).limit(count)


def consistent_rule(candidates: DataFrame, group: list[str], side: str, rank: str, width: str, sides: list[str], tolerance: float = 1.5, deepest: int = 10) -> DataFrame:
    """Per group one candidate a side, so that the widths agree within ``tolerance``: the choice with the least sum of
    ranks, then the least ranks side by side. Ranks count from 0 outermost; only sums up to ``deepest`` are tried,
    so a side has at most ``deepest + 1`` candidates in play, and a group is never larger than that."""
    near = candidates.where((F.col(rank) <= deepest) & (F.col(width) > 0))
    made = None
    for k, s in enumerate(sides):
        own = near.where(F.col(side) == s).select(*group, F.col(rank).alias(f"r{k}"), F.col(width).alias(f"w{k}"))
        made = own if made is None else made.join(own, group)
        ranks, widths = [F.col(f"r{i}") for i in range(k + 1)], [F.col(f"w{i}") for i in range(k + 1)]
        if k:
            made = made.where((sum(ranks[1:], ranks[0]) <= deepest) & (F.greatest(*widths) <= tolerance * F.least(*widths)))
    depth = sum((F.col(f"r{i}") for i in range(1, len(sides))), F.col("r0"))
    pick = made.groupBy(*group).agg(F.min(F.struct(depth.alias("depth"), *[f"r{i}" for i in range(len(sides))], *[f"w{i}" for i in range(len(sides))])).alias("_b"))
    return pick.select(*group, "_b.*")


def corner_phases(corners: DataFrame, holes: DataFrame, key: list[str], most: float = 1.25) -> DataFrame:
    """corners (key, x, y, h_pitch, v_pitch) and holes (key, side h or v, hx, hy): phases of the nearest hole on both
    sides, their mismatch and the holes' separation in pitches. Corners with a nearest hole beyond ``most`` go."""
    at = corners.join(holes, key).withColumn("_d", F.hypot(F.col("hx") - F.col("x"), F.col("hy") - F.col("y")))
    near = at.groupBy(*key, "x", "y", "h_pitch", "v_pitch").agg(*[F.min(F.when(F.col("side") == s, F.struct("_d", "hx", "hy"))).alias(s) for s in "hv"]).where("h is not null and v is not null")
    h, v = F.col("h._d") / F.col("h_pitch"), F.col("v._d") / F.col("v_pitch")
    apart = F.hypot(F.col("h.hx") - F.col("v.hx"), F.col("h.hy") - F.col("v.hy")) / F.sqrt(F.col("h_pitch") * F.col("v_pitch"))
    phases = near.where(F.greatest(h, v) <= most).select(*key, (h % 1.0).alias("horizontal_phase"), (v % 1.0).alias("vertical_phase"), apart.alias("center_separation"))
    return phases.withColumn("phase_mismatch", circular_mismatch("horizontal_phase", "vertical_phase"))


def two_clusters(df: DataFrame, x: str, y: str, rounds: int = 100) -> DataFrame:
    """x, y, n, rms, separation of two clusters, seeded by the points with the least and the largest sum; the first
    on ties by value. Each round is one aggregate; the two centres are all that comes to the driver."""
    points = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    total = F.col("x") + F.col("y")
    ends = points.agg(F.min_by(F.struct("x", "y"), F.struct(total, "x", "y")).alias("a"), F.max_by(F.struct("x", "y"), F.struct(total, -F.col("x"), -F.col("y"))).alias("b"), F.count("*").alias("n")).first()
    empty = df.sparkSession.createDataFrame([], "x double, y double, n long, rms double, separation double")
    if ends["n"] < 2:
        return empty
    centers = [tuple(ends["a"]), tuple(ends["b"])]
    for _ in range(rounds):
        off = [F.hypot(F.col("x") - cx, F.col("y") - cy) for cx, cy in centers]
        label = F.when(off[0] <= off[1], 0).otherwise(1)
        got = {r["c"]: r for r in points.groupBy(label.alias("c")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"), F.sum(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("q")).collect()}
        if len(got) < 2:
            return empty
        new = [(got[k]["x"], got[k]["y"]) for k in (0, 1)]
        if new == centers:
            break
        centers = new
    order = sorted((0, 1), key=lambda k: sum(centers[k]))
    n = sum(got[k]["n"] for k in (0, 1))
    squared = sum(got[k]["q"] - got[k]["n"] * (centers[k][0] ** 2 + centers[k][1] ** 2) for k in (0, 1))
    rms, apart = math.sqrt(max(squared, 0.0) / n), math.dist(*centers)
    return df.sparkSession.createDataFrame([(centers[k][0], centers[k][1], got[k]["n"], rms, apart) for k in order], empty.schema)


def best_score(df: DataFrame, group: list[str], score, ok, preferred, key: str) -> DataFrame:
    """Per group the usable row (score above 0) with the largest (score, ok, preferred); the least key on ties."""
    usable = df.where(col(score) > 0)
    rank = F.struct(col(score).alias("s"), col(ok).alias("o"), col(preferred).alias("p"), (-F.col(key)).alias("k"))
    return usable.groupBy(*group).agg(F.max_by(F.struct(*[c for c in df.columns if c not in group]), rank).alias("_b")).select(*group, "_b.*")


def opposite_choice(df: DataFrame, group: list[str], score: str, pitch: str, opposite: str, key: str, tolerance: float = 0.05) -> DataFrame:
    """Per group the best usable row whose pitch is within ``tolerance`` in log ratio of the opposite side's."""
    near = df.where((F.col(score) > 0) & (F.abs(F.log(F.col(pitch) / F.col(opposite))) <= tolerance))
    return near.groupBy(*group).agg(F.max_by(F.struct(key, score, pitch), F.struct(F.col(score), -F.col(key))).alias("_b")).select(*group, "_b.*")


def positive_among_first(df: DataFrame, group: list[str], order: list[str], score: str, visited: str) -> DataFrame:
    """How many of the first ``visited`` candidates of a group score above 0."""
    placed = df.withColumn("_i", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return placed.groupBy(*group).agg(F.count_if((F.col("_i") <= F.col(visited)) & (F.col(score) > 0)).alias("fits"))


def quarter_bounds(values: str) -> tuple[Column, Column]:
    """Bounds on quarter steps around a column's values, never equal."""
    low, high = F.floor((F.min(values) - 0.02) * 4) / 4, F.ceil((F.max(values) + 0.02) * 4) / 4
    return F.when(high <= low, low - 0.25).otherwise(low), F.when(high <= low, high + 0.25).otherwise(high)


def number_ranges(text) -> Column:
    """The sorted distinct numbers of a list such as '1-3,7'; null unless all are numbers from 1 on."""
    parts = F.filter(F.transform(F.split(col(text), ","), lambda p: F.trim(p)), lambda p: p != "")
    good = (F.size(parts) > 0) & F.forall(parts, lambda p: p.rlike(r"^[1-9]\d*(\s*-\s*\d+)?$"))
    ends = lambda p: F.transform(F.split(p, "-"), lambda x: F.trim(x).try_cast("int"))
    spans = F.transform(parts, lambda p: F.when(F.element_at(ends(p), -1) >= F.element_at(ends(p), 1), F.sequence(F.element_at(ends(p), 1), F.element_at(ends(p), -1))).otherwise(F.array().cast("array<int>")))
    found = F.array_sort(F.array_distinct(F.flatten(spans)))
    return F.when(good & (F.size(found) > 0), found)


def window_corner(cells: DataFrame, size: int) -> DataFrame:
    """y, x, total of the ``size`` x ``size`` window of a full grid of cells (y, x, v) with the largest sum, the first
    on ties. Sums run over one row, then over one column of row sums, so no grid is held whole."""
    across = Window.partitionBy("y").orderBy("x").rowsBetween(0, size - 1)
    rows = cells.withColumns({"_s": F.sum("v").over(across), "_n": F.count("*").over(across)}).where(F.col("_n") == size)
    down = Window.partitionBy("x").orderBy("y").rowsBetween(0, size - 1)
    return rows.withColumns({"total": F.sum("_s").over(down), "_m": F.count("*").over(down)}).where(F.col("_m") == size).select("y", "x", "total").orderBy(F.desc("total"), "y", "x").limit(1)


def column_depth(pixels: DataFrame, column: list[str], paper: str, start: int, height: int, least: int = 4) -> DataFrame:
    """Depth of each column of a binary band: start + height - its paper pixels; null below ``least`` of them."""
    n = F.count_if(F.col(paper))
    return pixels.groupBy(*column).agg(F.when(n >= least, F.lit(start + height) - n).alias("depth"))


def whole_periods(df: DataFrame, group: list[str], dx: str, dy: str, wx: float, wy: float) -> DataFrame:
    """Shifts snapped to whole periods across a wave and re-centred along it; median across and along are zero. A wave of no
    length only takes the medians away."""
    length = math.hypot(wx, wy)
    if length < 1e-12:
        made = df
        for k in (dx, dy):
            made = join_groups(made, quantiles(made, group, k, {f"_{k}": 0.5}).drop("n"), group).withColumn(k, F.col(k) - F.col(f"_{k}")).drop(f"_{k}")
        return made.select(*df.columns)
    nx, ny, pitch = wx / length, wy / length, 1 / length
    made = df.withColumns({"_across": F.rint((F.col(dx) * nx + F.col(dy) * ny) / pitch) * pitch, "_along": F.col(dx) * -ny + F.col(dy) * nx})
    for k in ("_across", "_along"):
        made = join_groups(made, quantiles(made, group, k, {f"{k}_m": 0.5}).drop("n"), group)
    across, along = F.col("_across") - F.rint(F.col("_across_m") / pitch) * pitch, F.col("_along") - F.col("_along_m")
    new = {dx: across * nx - along * ny, dy: across * ny + along * nx}
    return made.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def area_mean(cells: DataFrame, key: list[str], factor: int, value: str) -> DataFrame:
    """Cells (key, y, x, value) reduced by ``factor``: the mean of each block."""
    return cells.groupBy(*key, F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")).agg(F.avg(value).alias(value))
