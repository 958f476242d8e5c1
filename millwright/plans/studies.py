"""Queries on sides, registrations, pixels and colours, bound to the supplied tables, with SQL for the same rows.

Sides of a piece are the lines of an order, four in turn, pixels the 64 numbers of an embedding as 8 x 8,
and affine maps and colours are formed from a part's or a supplier's numbers.
"""

from pyspark.sql import functions as F

from millwright.functions import colour, geometry, scalar
from millwright.operators import registration, robust, study

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(x, n=5):
    return F.round(x, n)


_SIDES = """sides AS (SELECT l_orderkey AS k, CASE (l_linenumber - 1) % 4 WHEN 0 THEN 'top' WHEN 1 THEN 'bottom' WHEN 2 THEN 'left' ELSE 'right' END AS side,
14 + max(l_discount) * 12 AS gauge, CAST(floor(max(l_quantity) / 4) AS BIGINT) AS arcs, bool_or(l_returnflag <> 'N') AS has_line, bool_and(l_linestatus = 'F') AS circles,
max(l_tax) * 50 AS angle, max(l_discount) * 10 AS coverage, min(l_tax) AS rms FROM lineitem GROUP BY 1, 2),
trusted AS (SELECT *, has_line AND circles AND arcs >= 5 AS reliable FROM sides)"""


def sides(spark, sf_dir):
    names = {0: "top", 1: "bottom", 2: "left", 3: "right"}
    made = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), study.lookup(names, (F.col("l_linenumber") - 1) % 4).alias("side")).agg(
        (14 + F.max("l_discount") * 12).alias("gauge"), F.floor(F.max("l_quantity") / 4).alias("arcs"), F.bool_or(F.col("l_returnflag") != "N").alias("has_line"),
        F.when(F.bool_and(F.col("l_linestatus") == "F"), "circle_arcs").otherwise("line").alias("source"), (F.max("l_tax") * 50).alias("angle"), (F.max("l_discount") * 10).alias("coverage"), F.min("l_tax").alias("rms"),
    )
    return made.withColumn("reliable", study.reliable("has_line", "source", "arcs"))


@query(f"WITH {_SIDES} SELECT k, side, arcs, reliable FROM trusted")
def reliable_sides(spark, sf_dir):
    return sides(spark, sf_dir).select("k", "side", "arcs", "reliable")


@query("SELECT n_nationkey, CASE lower(substr(n_name, 1, 1)) WHEN 't' THEN 'top' WHEN 'b' THEN 'bottom' WHEN 'l' THEN 'left' WHEN 'r' THEN 'right' END AS side FROM nation")
def side_alias(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_nationkey", study.parse_side(F.substring("n_name", 1, 1)).alias("side"))


@query("""WITH g AS (SELECT doc_id, ln(CAST(n_chars AS DOUBLE) / 1000) AS a, CASE WHEN doc_id % 3 > 0 THEN 1.0 / nullif(doc_id % 5, 0) END AS b FROM documents)
SELECT doc_id FROM g WHERE a IS NOT NULL AND isfinite(a) AND b IS NOT NULL AND isfinite(b)""")
def finite_gap_rows(spark, sf_dir):
    g = t(spark, sf_dir, "documents").select("doc_id", F.log(F.col("n_chars") / 1000).alias("a"), F.when(F.col("doc_id") % 3 > 0, F.expr("1.0 / nullif(doc_id % 5, 0)").cast("double")).alias("b"))
    return g.where(study.finite_both("a", "b")).select("doc_id")


@query(f"""WITH {_SIDES}, j AS (SELECT s.*, o.angle AS oangle, o.reliable AS oreliable, s.arcs < o.arcs OR s.arcs = o.arcs AND (s.coverage < o.coverage OR s.coverage = o.coverage AND
(s.has_line < o.has_line OR s.has_line = o.has_line AND (s.rms > o.rms OR s.rms = o.rms AND s.side IN ('top', 'left')))) AS weaker
FROM trusted s LEFT JOIN trusted o ON s.k = o.k AND o.side = CASE s.side WHEN 'top' THEN 'bottom' WHEN 'bottom' THEN 'top' WHEN 'left' THEN 'right' ELSE 'left' END)
SELECT k, side, NOT reliable OR coalesce(abs(angle - oangle) > 1.5 AND oreliable AND weaker, false) AS target FROM j""")
def recovery_targets(spark, sf_dir):
    s = sides(spark, sf_dir).withColumn("confidence", study.confidence("arcs", "coverage", "has_line", "rms"))
    return study.recovery_targets(s.select("k", "side", "reliable", "angle", "confidence"), ["k"]).select("k", "side", "target")


@query(f"""WITH {_SIDES}, p AS (SELECT k, max(gauge) FILTER (side = 'top' AND reliable) AS a, max(gauge) FILTER (side = 'bottom' AND reliable) AS b FROM trusted GROUP BY k)
SELECT k, round(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END, 5) AS one, round((a + b) / 2, 5) AS both FROM p""")
def axis_values(spark, sf_dir):
    of = lambda s: F.max(F.when((F.col("side") == s) & F.col("reliable"), F.col("gauge")))
    p = sides(spark, sf_dir).groupBy("k").agg(of("top").alias("a"), of("bottom").alias("b"))
    values = {"top": ("a", F.col("a").isNotNull()), "bottom": ("b", F.col("b").isNotNull())}
    return p.select("k", r(study.axis_value(values, ["top", "bottom"])).alias("one"), r(study.axis_value(values, ["top", "bottom"], both=True)).alias("both"))


@query(f"""WITH {_SIDES} SELECT a.k, CASE a.side WHEN 'top' THEN 'tb' ELSE 'lr' END AS axis, round(a.gauge, 5) AS a, round(b.gauge, 5) AS b, round(abs(a.gauge - b.gauge), 5) AS difference
FROM trusted a JOIN trusted b ON a.k = b.k AND (a.side = 'top' AND b.side = 'bottom' OR a.side = 'left' AND b.side = 'right') WHERE a.reliable AND b.reliable""")
def opposite_pairs(spark, sf_dir):
    p = study.axis_pairs(sides(spark, sf_dir).withColumnRenamed("reliable", "published"), ["k"])
    return p.select("k", "axis", r("a").alias("a"), r("b").alias("b"), r("difference").alias("difference"))


_ENRICHED = f"""WITH {_SIDES}, e AS (SELECT s.*, abs(s.gauge - o.gauge) AS delta, CASE WHEN s.side IN ('top', 'bottom') THEN least(abs(s.gauge - 14.25), abs(s.gauge - 14.5)) ELSE least(abs(s.gauge - 14.75), abs(s.gauge - 15.0)) END AS theory
FROM trusted s LEFT JOIN trusted o ON s.k = o.k AND o.side = CASE s.side WHEN 'top' THEN 'bottom' WHEN 'bottom' THEN 'top' WHEN 'left' THEN 'right' ELSE 'left' END),
v AS (SELECT *, coalesce(reliable AND delta <= 0.25 AND theory <= 0.5, false) AS safe FROM e)"""


def enriched(spark, sf_dir):
    s = sides(spark, sf_dir)
    twin = s.select("k", study.lookup(study.OPPOSITE, "side").alias("side"), F.col("gauge").alias("opposite_gauge"))
    return study.enriched(s.join(twin, ["k", "side"], "left"))


@query(f"{_ENRICHED} SELECT k, side, round(delta, 5) AS delta, round(theory, 5) AS theory_residual, safe FROM v")
def enriched_sides(spark, sf_dir):
    return enriched(spark, sf_dir).select("k", "side", r("delta").alias("delta"), r("theory_residual").alias("theory_residual"), "safe")


@query(f"""{_ENRICHED} SELECT side, count(*) FILTER (reliable) AS published, count(*) FILTER (safe) AS safe, count(*) FILTER (reliable AND delta > 0.25) AS bad, round(max(delta) FILTER (reliable), 5) AS most,
CAST(sum(arcs) AS BIGINT) AS fits, round(avg(arcs), 5) AS mean_fits, round(median(delta) FILTER (reliable), 5) AS median, round(quantile_cont(delta, 0.9) FILTER (reliable), 5) AS p90 FROM v GROUP BY side""")
def method_summary(spark, sf_dir):
    m = study.method_summary(enriched(spark, sf_dir), ["side"], "arcs")
    return m.select("side", "published", "safe", "bad", r("most").alias("most"), F.col("fits").cast("long").alias("fits"), *[r(c).alias(c) for c in ("mean_fits", "median", "p90")])


@query("""WITH o AS (SELECT p_partkey, abs(p_size / 1e1 + 12 - 13) AS c, abs(p_size / 1e1 + 12 - 14) AS m, abs(p_size / 1e1 + 12 - 14.5) AS f FROM part)
SELECT p_partkey, CASE WHEN c <= m AND c <= f THEN 'coarse' WHEN m <= f THEN 'middle' ELSE 'fine' END AS class FROM o""")
def nearest_class(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", study.nearest_class(F.col("p_size").cast("double") / 10 + 12, {"coarse": 13.0, "middle": 14.0, "fine": 14.5}).alias("class"))


@query("""WITH b AS (SELECT o_orderpriority AS g, CAST(o_custkey % 3 AS INTEGER) AS f, CAST((o_custkey + o_orderkey % 2) % 3 AS INTEGER) AS s FROM orders), c AS (SELECT * FROM b WHERE f < 2 AND s < 2),
m AS (SELECT g, avg((f = s)::INT) FILTER (s = 0) AS r0, avg((f = s)::INT) FILTER (s = 1) AS r1, count(*) AS n FROM c GROUP BY g)
SELECT g, round(greatest((r0 + r1) / 2, 1 - (r0 + r1) / 2), 5) AS agreement, (1 - r0 + 1 - r1) / 2 > (r0 + r1) / 2 AS flipped, n FROM m""")
def partition_agreement(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), (F.col("o_custkey") % 3).cast("int").alias("f"), ((F.col("o_custkey") + F.col("o_orderkey") % 2) % 3).cast("int").alias("s"))
    return study.partition_agreement(o, ["g"], "f", "s").withColumn("agreement", r("agreement"))


@query("SELECT l_returnflag AS g, round(min(l_quantity), 5) AS low_q, round(max(l_quantity), 5) AS high_q, round(min(l_extendedprice), 4) AS low_p, round(max(l_extendedprice), 4) AS high_p, round(coalesce(stddev_samp(l_quantity), 0), 5) AS sd FROM lineitem GROUP BY 1")
def cluster_axis_ranges(spark, sf_dir):
    g = t(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g"))
    return g.agg(F.min("l_quantity").alias("low_q"), F.max("l_quantity").alias("high_q"), r(F.min("l_extendedprice"), 4).alias("low_p"), r(F.max("l_extendedprice"), 4).alias("high_p"), r(robust.sample_sd("l_quantity")).alias("sd"))


@query("""WITH s AS (SELECT c_nationkey AS g, c_mktsegment AS k, sum(greatest(c_acctbal, 0)) AS v FROM customer GROUP BY ALL),
l AS (SELECT g, k, v, ln(v) AS l, row_number() OVER (PARTITION BY g ORDER BY ln(v), k) AS i, lead(ln(v)) OVER (PARTITION BY g ORDER BY ln(v), k) - ln(v) AS gap, count(*) OVER (PARTITION BY g) AS n, max(v) OVER (PARTITION BY g) AS top FROM s WHERE v > 0),
b AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY gap DESC, i) AS rk FROM l WHERE gap IS NOT NULL),
o AS (SELECT b.g, median(l.gap) AS typical FROM b JOIN l ON l.g = b.g AND l.gap IS NOT NULL AND l.i <> b.i WHERE rk = 1 GROUP BY b.g),
d AS (SELECT b.g, CASE WHEN (CASE WHEN n = 2 THEN gap >= ln(2.0) ELSE gap >= ln(1.5) AND gap >= 1.5 * greatest(coalesce(typical, 0), 1e-9) END) AND NOT (n - i < ceil(n / 2.0) AND v / top >= 0.5) THEN least(i, n - 2) ELSE 0 END AS cut FROM b LEFT JOIN o USING (g) WHERE rk = 1)
SELECT s.g, s.k, round(coalesce(s.v / l.top, 0), 5) AS relative, coalesce(l.i > coalesce(d.cut, 0), false) AS selected FROM s LEFT JOIN l ON s.g = l.g AND s.k = l.k LEFT JOIN d ON s.g = d.g""")
def preservation_split(spark, sf_dir):
    s = t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("g"), F.col("c_mktsegment").alias("k")).agg(F.sum(F.greatest(F.col("c_acctbal"), F.lit(0.0))).alias("v"))
    return study.preservation_split(s, ["g"], "k", "v").select("g", "k", r("relative").alias("relative"), "selected")


# pixels ------------------------------------------------------------------------------------------

_PIXELS = "px AS (SELECT vec_id, label, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) q(i))"


def pixels(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    return e.select("vec_id", "label", F.expr("i div 8").cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


@query(f"WITH {_PIXELS} SELECT vec_id, y // 2 AS y, x // 2 AS x, round(avg(v), 5) AS v FROM px GROUP BY 1, 2, 3")
def pyramid_level(spark, sf_dir):
    return study.area_mean(pixels(spark, sf_dir), ["vec_id"], 2, "v").withColumn("v", r("v"))


@query(f"WITH {_PIXELS} SELECT vec_id, x, CASE WHEN count(*) FILTER (v > 0) >= 4 THEN CAST(3 + 8 - count(*) FILTER (v > 0) AS BIGINT) END AS depth FROM px GROUP BY 1, 2")
def column_depth(spark, sf_dir):
    return study.column_depth(pixels(spark, sf_dir).withColumn("paper", F.col("v") > 0), ["vec_id", "x"], "paper", 3, 8)


@query(f"""WITH {_PIXELS}, s AS (SELECT y, x, sum(round(v * 1000)) AS v FROM px GROUP BY 1, 2),
w AS (SELECT a.y, a.x, sum(b.v) AS total FROM s a JOIN s b ON b.y BETWEEN a.y AND a.y + 2 AND b.x BETWEEN a.x AND a.x + 2 WHERE a.y <= 5 AND a.x <= 5 GROUP BY 1, 2)
SELECT y, x, total FROM w ORDER BY total DESC, y, x LIMIT 1""")
def window_corner(spark, sf_dir):
    s = pixels(spark, sf_dir).groupBy("y", "x").agg(F.sum(F.round(F.col("v") * 1000)).alias("v"))
    return study.window_corner(s, 3)


@query(f"""WITH {_PIXELS}, m AS (SELECT y, x, avg(v) AS mean FROM px WHERE v > -0.1 GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM m),
o AS (SELECT vec_id, avg(abs(v - mean)) AS d, count(*) AS k FROM px JOIN m USING (y, x) WHERE v > -0.1 GROUP BY 1)
SELECT vec_id, round(d + 255 * (1 - k * 1.0 / n), 5) AS cost FROM o, n ORDER BY d + 255 * (1 - k * 1.0 / n), vec_id LIMIT 5""")
def closest_to_average(spark, sf_dir):
    seen = pixels(spark, sf_dir).withColumn("v", F.when(F.col("v") > -0.1, F.col("v")))
    return study.closest_to_average(seen, "vec_id", ["y", "x"], "v", 5).withColumn("cost", r("cost"))


@query(f"""WITH {_PIXELS}, m AS (SELECT label, y, x, avg(v) AS mean FROM px GROUP BY ALL)
SELECT label, CASE WHEN count(*) >= 500 THEN round(corr(v, mean), 5) ELSE 'NaN'::DOUBLE END AS agreement, count(*) AS n FROM px JOIN m USING (label, y, x) WHERE v > -0.2 AND mean < 0.2 GROUP BY label""")
def masked_agreement(spark, sf_dir):
    p = pixels(spark, sf_dir)
    both = p.join(p.groupBy("label", "y", "x").agg(F.avg("v").alias("mean")), ["label", "y", "x"])
    seen = (F.col("v") > -0.2) & (F.col("mean") < 0.2)
    return both.groupBy("label").agg(r(registration.agreement("v", "mean", seen)).alias("agreement"), F.count_if(seen).alias("n"))


@query(f"""WITH {_PIXELS} SELECT vec_id, CASE WHEN count(*) < 10 THEN 0.0 ELSE round(sqrt(greatest(var_samp(x) * var_samp(y) - covar_samp(x, y) * covar_samp(x, y), 0)), 5) END AS spread FROM px WHERE v > 0.05 GROUP BY 1""")
def group_spread(spark, sf_dir):
    return pixels(spark, sf_dir).where("v > 0.05").groupBy("vec_id").agg(r(registration.spread("x", "y")).alias("spread"))


@query(f"""WITH {_PIXELS}, f AS (SELECT label, vec_id, y, x, v, lead(v) OVER (PARTITION BY vec_id, y ORDER BY x) AS u FROM px), g AS (SELECT label, v AS a, u AS b FROM f WHERE u IS NOT NULL),
n AS (SELECT label, count(*) AS n FROM g GROUP BY 1), c AS (SELECT label, median(a) AS ca, median(b) AS cb FROM g GROUP BY 1), d AS (SELECT g.*, sqrt(pow(a - ca, 2) + pow(b - cb, 2)) AS r FROM g JOIN c USING (label)),
q AS (SELECT label, quantile_cont(r, 0.85) AS far FROM d GROUP BY 1), k AS (SELECT d.label, a, b FROM d JOIN q USING (label) WHERE r <= far), c2 AS (SELECT label, median(a) AS ca, median(b) AS cb FROM k GROUP BY 1),
e AS (SELECT k.label, sqrt(pow(a - ca, 2) + pow(b - cb, 2)) AS r FROM k JOIN c2 USING (label)), rm AS (SELECT label, median(r) AS rm FROM e GROUP BY 1), s AS (SELECT e.label, median(abs(r - rm)) AS s FROM e JOIN rm USING (label) GROUP BY 1)
SELECT label, n, round(ca, 5) AS shift_x, round(cb, 5) AS shift_y, round(1.4826 * s, 5) AS scatter FROM n JOIN c2 USING (label) JOIN s USING (label)""")
def trimmed_shift(spark, sf_dir):
    from pyspark.sql.window import Window

    f = pixels(spark, sf_dir).withColumn("u", F.lead("v").over(Window.partitionBy("vec_id", "y").orderBy("x"))).where("u is not null")
    return registration.trimmed_shift(f, ["label"], "v", "u").select("label", "n", *[r(c).alias(c) for c in ("shift_x", "shift_y", "scatter")])


# affine maps -------------------------------------------------------------------------------------

#: Numbers in exponent form are doubles in both dialects; plain decimals would be exact decimals of few digits.
_MAP = {"a": "1 + p_size / 4e2", "b": "p_size / 3e3 - 1e-2", "tx": "p_partkey % 9 - 4e0", "c": "1e-2 - p_size / 25e2", "d": "1 - p_size / 5e2", "ty": "p_partkey % 7 - 3e0"}
_MAPS = "maps AS (SELECT p_partkey AS k, p_brand AS g, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _MAP.items()) + " FROM part)"
_DECOMPOSED = f"""WITH {_MAPS}, parts AS (SELECT *, sqrt(a * a + c * c) AS sx, abs(a * d - b * c) / sqrt(a * a + c * c) AS sy, degrees(atan2(c, a)) AS rot, (a * b + c * d) / (a * a + c * c) AS sh FROM maps)"""


def maps(spark, sf_dir):
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("g"), *[F.expr(f"cast({e} as double)").alias(n) for n, e in _MAP.items()])


@query(f"""{_DECOMPOSED}, gate AS (SELECT *, k % 11 <> 0 AND sx BETWEEN 0.8 AND 1.25 AND sy BETWEEN 0.8 AND 1.25 AND abs(rot) <= 3 AND abs(sh) <= 0.05 AS ok FROM parts),
m AS (SELECT g, count(*) AS n, median(ln(sx)) AS mx, median(ln(sy)) AS my FROM gate WHERE ok GROUP BY 1),
s AS (SELECT g, median(abs(ln(sx) - mx)) AS dx, median(abs(ln(sy) - my)) AS dy FROM gate JOIN m USING (g) WHERE ok GROUP BY 1)
SELECT k, coalesce(ok AND (n < 3 OR abs(ln(sx) - mx) <= greatest(ln(1.04), 6 * 1.4826 * dx) AND abs(ln(sy) - my) <= greatest(ln(1.04), 6 * 1.4826 * dy)), false) AS accepted FROM gate LEFT JOIN m USING (g) LEFT JOIN s USING (g)""")
def plausible_updates(spark, sf_dir):
    return registration.plausible(maps(spark, sf_dir), ["g"], F.col("k") % 11 != 0).select("k", "accepted")


@query(f"""{_DECOMPOSED}, m AS (SELECT g, exp(avg(ln(sx))) AS gx, exp(avg(ln(sy))) AS gy, radians(avg(rot)) AS th, avg(tx) AS mx, avg(ty) AS my FROM parts GROUP BY 1),
i AS (SELECT g, cos(th) / gx AS p, sin(th) / gx AS q, -sin(th) / gy AS u, cos(th) / gy AS w, -(cos(th) * mx + sin(th) * my) / gx AS ix, (sin(th) * mx - cos(th) * my) / gy AS iy FROM m)
SELECT k, round(a * p + b * u, 5) AS a, round(a * q + b * w, 5) AS b, round(a * ix + b * iy + tx, 5) AS tx, round(c * p + d * u, 5) AS c, round(c * q + d * w, 5) AS d, round(c * ix + d * iy + ty, 5) AS ty FROM parts JOIN i USING (g)""")
def common_frame(spark, sf_dir):
    return registration.common_frame(maps(spark, sf_dir), ["g"]).select("k", *[r(c).alias(c) for c in geometry.PARTS])


@query(f"""WITH {_MAPS}, o AS (SELECT *, atan2(c, a) AS t, a * 30.1237 + b * 20.4571 + tx - 30.1237 AS dx, c * 30.1237 + d * 20.4571 + ty - 20.4571 AS dy FROM maps), m AS (SELECT g, median(t) AS mt, median(dx) AS mx, median(dy) AS my FROM o GROUP BY 1),
n AS (SELECT k, t - mt AS t, dx - mx AS dx, dy - my AS dy FROM o JOIN m USING (g))
SELECT k, round(cos(t), 9) AS a, round(-sin(t), 9) AS b, round(30.1237 + dx - (cos(t) * 30.1237 - sin(t) * 20.4571), 9) AS tx, round(sin(t), 9) AS c, round(cos(t), 9) AS d, round(20.4571 + dy - (sin(t) * 30.1237 + cos(t) * 20.4571), 9) AS ty FROM n""")
def recentred_maps(spark, sf_dir):
    return registration.recentred(maps(spark, sf_dir), ["g"], 30.1237, 20.4571).select("k", *[r(c, 9).alias(c) for c in geometry.PARTS])


@query(f"{_DECOMPOSED} SELECT k, round(cos(radians(rot)) * sx, 5) AS a, round(-sin(radians(rot)) * sy, 5) AS b, round(sin(radians(rot)) * sx, 5) AS c, round(cos(radians(rot)) * sy, 5) AS d, round(a * 7 + b * 5 + tx, 5) AS x, round(c * 7 + d * 5 + ty, 5) AS y FROM parts")
def maps_without_shear(spark, sf_dir):
    m = geometry.without_shear(registration.MAP)
    x, y = geometry.apply_affine(registration.MAP, F.lit(7.0), F.lit(5.0))
    return maps(spark, sf_dir).select("k", *[r(m[c]).alias(c) for c in "abcd"], r(x).alias("x"), r(y).alias("y"))


@query("""WITH q AS (SELECT s_suppkey AS k, CAST(s_suppkey % 7 AS DOUBLE) / 10 AS e, CAST(s_suppkey % 5 AS DOUBLE) / 5 AS f FROM supplier)
SELECT k, round(degrees(atan2(e, 10.0)), 5) AS angle, round((10.0 - f) * sqrt(1 + e * e / 100), 5) AS width, CASE WHEN k % 4 = 0 THEN NULL ELSE round(f, 5) END AS left FROM q""")
def side_quads(spark, sf_dir):
    k = F.col("s_suppkey")
    e, f = (k % 7).cast("double") / 10, (k % 5).cast("double") / 5
    d = lambda v: F.lit(float(v))
    lines = {"top": (d(0), d(0), d(10), e), "bottom": (d(0), d(8), d(10), e + 8), "left": (f, d(0), f, d(8)), "right": (d(10), d(0), d(10), d(8))}
    quad = geometry.quad_of_lines(lines)
    gone = geometry.quad_of_lines(lines | {"left": tuple(F.when(k % 4 != 0, c) for c in lines["left"])})
    return t(spark, sf_dir, "supplier").select(k.alias("k"), r(geometry.quad_angle(quad)).alias("angle"), r(geometry.quad_size(quad)[0]).alias("width"), r(gone["top_left"][0]).alias("left"))


@query("""WITH p AS (SELECT s_nationkey AS g, s_suppkey AS k, s_suppkey % 13 AS x, s_suppkey % 17 AS y, fmod(s_suppkey * 0.37, 6.0) AS ph, 1.0 + s_suppkey % 3 AS w FROM supplier),
b AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY w DESC, k) AS rk FROM p), o AS (SELECT g, x AS ox, y AS oy, ph AS oph FROM b WHERE rk = 1),
n AS (SELECT g, w, x - ox AS x, y - oy AS y, (ph - oph + pi()) - 2 * pi() * floor((ph - oph + pi()) / (2 * pi())) - pi() AS p FROM p JOIN o USING (g)),
s AS (SELECT g, sum(w) AS s1, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * p) AS sp, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, sum(w * y * y) AS syy, sum(w * x * p) AS sxp, sum(w * y * p) AS syp FROM n GROUP BY 1),
c AS (SELECT g, s1 * (sxx * syy - sxy * sxy) - sx * (sx * syy - sxy * sy) + sy * (sx * sxy - sxx * sy) <> 0 AS ok, sxx - sx * sx / s1 AS cxx, sxy - sx * sy / s1 AS cxy, syy - sy * sy / s1 AS cyy, sxp - sx * sp / s1 AS cxp, syp - sy * sp / s1 AS cyp FROM s)
SELECT g, CASE WHEN ok THEN round((cxp * cyy - cyp * cxy) / (cxx * cyy - cxy * cxy) / (2 * pi()), 4) END AS fx, CASE WHEN ok THEN round((cyp * cxx - cxp * cxy) / (cxx * cyy - cxy * cxy) / (2 * pi()), 4) END AS fy FROM c""")
def phase_plane(spark, sf_dir):
    k = F.col("s_suppkey")
    p = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), k.alias("k"), (k % 13).cast("double").alias("x"), (k % 17).cast("double").alias("y"), (k * 0.37 % 6.0).cast("double").alias("ph"), (1.0 + k % 3).cast("double").alias("w"))
    return registration.phase_plane(p, ["g"], "x", "y", "ph", "w", "k").select("g", r("fx", 4).alias("fx"), r("fy", 4).alias("fy"))


@query("""WITH p AS (SELECT p_brand AS g, p_partkey AS k, CAST(p_size AS DOUBLE) AS dx, CAST(p_partkey % 23 AS DOUBLE) AS dy FROM part), q AS (SELECT *, round_even((dx * 0.6 + dy * 0.8) / 4, 0) * 4 AS ac, dy * 0.6 - dx * 0.8 AS al FROM p),
m AS (SELECT g, round_even(median(ac) / 4, 0) * 4 AS ma, median(al) AS ml FROM q GROUP BY 1) SELECT k, round((ac - ma) * 0.6 - (al - ml) * 0.8, 5) AS dx, round((ac - ma) * 0.8 + (al - ml) * 0.6, 5) AS dy FROM q JOIN m USING (g)""")
def whole_periods(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("dx"), (F.col("p_partkey") % 23).cast("double").alias("dy"))
    return study.whole_periods(p, ["g"], "dx", "dy", 0.6 / 4, 0.8 / 4).select("k", r("dx").alias("dx"), r("dy").alias("dy"))


# colours -----------------------------------------------------------------------------------------

_BGR = "c AS (SELECT p_partkey AS k, p_brand AS g, CAST(p_partkey * 7 % 256 AS DOUBLE) AS b, CAST(p_size * 5 AS DOUBLE) AS gr, CAST(p_partkey * 3 % 251 AS DOUBLE) AS re FROM part)"


def bgr(spark, sf_dir):
    k = F.col("p_partkey")
    return t(spark, sf_dir, "part").select(k.alias("k"), F.col("p_brand").alias("g"), (k * 7 % 256).cast("double").alias("b"), (F.col("p_size") * 5).cast("double").alias("gr"), (k * 3 % 251).cast("double").alias("re"))


def _lin(x):
    return f"(CASE WHEN {x} / 255 <= 0.04045 THEN {x} / 255 / 12.92 ELSE pow(({x} / 255 + 0.055) / 1.055, 2.4) END)"


def _den(x, paper):
    return f"least(greatest(-log10(least(greatest({_lin(x)} / {_lin(paper)}, 1e-4), 1.0)), 0), 4)"


PAPER = (210.0, 230.0, 240.0)
RAYS = [(0.8, 0.6, 0.0), (0.0, 0.6, 0.8)]
_DENSITY = f"WITH {_BGR}, d AS (SELECT k, g, {_den('b', '210.0')} AS x, {_den('gr', '230.0')} AS y, {_den('re', '240.0')} AS z FROM c)"


def densities(spark, sf_dir):
    return bgr(spark, sf_dir).select("k", "g", *[colour.density(c, F.lit(p)).alias(n) for c, p, n in zip(("b", "gr", "re"), PAPER, "xyz", strict=True)])


@query(f"{_DENSITY} SELECT k, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z, round(sqrt(x * x + y * y + z * z), 5) AS magnitude FROM d")
def optical_density(spark, sf_dir):
    d = densities(spark, sf_dir)
    return d.select("k", *[r(c).alias(c) for c in "xyz"], r(colour.norm([F.col(c) for c in "xyz"])).alias("magnitude"))


@query(f"""{_DENSITY}, a AS (SELECT k, x, y, z, 0.8 * x + 0.6 * y AS a0, 0.6 * y + 0.8 * z AS a1, (x + y + z) / sqrt(3.0) AS a2 FROM d),
e AS (SELECT *, sqrt(pow(x - 0.8 * a0, 2) + pow(y - 0.6 * a0, 2) + z * z) AS e0, sqrt(x * x + pow(y - 0.6 * a1, 2) + pow(z - 0.8 * a1, 2)) AS e1, sqrt(pow(x - a2 / sqrt(3.0), 2) + pow(y - a2 / sqrt(3.0), 2) + pow(z - a2 / sqrt(3.0), 2)) AS e2 FROM a)
SELECT k, round(CASE WHEN e0 <= least(e0, e1, e2) + 1e-9 THEN a0 WHEN e1 <= least(e0, e1, e2) + 1e-9 THEN a1 ELSE a2 END, 4) AS amount FROM e""")
def unmixed(spark, sf_dir):
    v = [F.col(c) for c in "xyz"]
    amounts = colour.unmix(v, RAYS)
    return densities(spark, sf_dir).select("k", r(amounts[0] + amounts[1] + amounts[2], 4).alias("amount"))


@query(f"WITH {_BGR} SELECT k, CAST(round(0.114 * b + 0.587 * gr + 0.299 * re) AS INTEGER) AS luma, round({_lin('b')}, 5) AS linear FROM c")
def luma(spark, sf_dir):
    return bgr(spark, sf_dir).select("k", colour.luma("b", "gr", "re").alias("luma"), r(colour.to_linear("b")).alias("linear"))


@query(f"""WITH {_BGR}, m AS (SELECT g, CAST(round_even(median(b), 0) AS INTEGER) AS b, CAST(round_even(median(gr), 0) AS INTEGER) AS gr, CAST(round_even(median(re), 0) AS INTEGER) AS re FROM c GROUP BY 1)
SELECT g, printf('#%02X%02X%02X', re, gr, b) AS hex FROM m""")
def median_colour(spark, sf_dir):
    made = robust.medians(bgr(spark, sf_dir), ["g"], {c: c for c in ("b", "gr", "re")})
    return made.select("g", colour.bgr_hex("b", "gr", "re").alias("hex"))


# choices -----------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT p_type AS g, p_partkey AS k, p_size * 10.0 - 100 AS score, p_brand < 'Brand#15' AS ok, p_name LIKE 'red%' AS pref FROM part), w AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, ok DESC, pref DESC, k) AS rn FROM c WHERE score > 0)
SELECT g, k, CAST(score AS DOUBLE) AS score FROM w WHERE rn = 1""")
def best_score(spark, sf_dir):
    c = t(spark, sf_dir, "part").select(F.col("p_type").alias("g"), F.col("p_partkey").alias("k"), (F.col("p_size") * 10.0 - 100).cast("double").alias("score"), (F.col("p_brand") < "Brand#15").alias("ok"), F.col("p_name").like("red%").alias("pref"))
    return study.best_score(c, ["g"], "score", "ok", "pref", "k").select("g", "k", "score")


@query("""WITH c AS (SELECT o_custkey AS g, o_orderkey AS k, o_totalprice - 50000 AS score, 20 + o_orderkey % 50 AS pitch, 30 + o_custkey % 20 AS opp FROM orders),
w AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, k) AS rn FROM c WHERE score > 0 AND abs(ln(pitch * 1.0 / opp)) <= 0.05) SELECT g, k, CAST(pitch AS BIGINT) AS pitch FROM w WHERE rn = 1""")
def opposite_choice(spark, sf_dir):
    c = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("k"), (F.col("o_totalprice") - 50000).alias("score"), (20 + F.col("o_orderkey") % 50).alias("pitch"), (30 + F.col("o_custkey") % 20).alias("opp"))
    return study.opposite_choice(c, ["g"], "score", "pitch", "opp", "k").select("g", "k", "pitch")


@query("""WITH c AS (SELECT o_custkey AS g, o_totalprice - 100000 AS score, 1 + o_custkey % 6 AS visited, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) SELECT g, count(*) FILTER (i <= visited AND score > 0) AS fits FROM c GROUP BY g""")
def positive_among_first(spark, sf_dir):
    c = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("k"), (F.col("o_totalprice") - 100000).alias("score"), (1 + F.col("o_custkey") % 6).alias("visited"))
    return study.positive_among_first(c, ["g"], ["k"], "score", "visited")


@query("""WITH c AS (SELECT p_brand AS g, p_partkey % 4 AS side, CAST(row_number() OVER (PARTITION BY p_brand, p_partkey % 4 ORDER BY p_retailprice, p_partkey) - 1 AS INTEGER) AS rk, CAST(p_size AS DOUBLE) AS w FROM part),
n AS (SELECT * FROM c WHERE rk <= 10), j AS (SELECT a.g, a.rk AS r0, b.rk AS r1, c.rk AS r2, d.rk AS r3, a.w AS w0, b.w AS w1, c.w AS w2, d.w AS w3, a.rk + b.rk + c.rk + d.rk AS depth
FROM n a JOIN n b ON a.g = b.g AND b.side = 1 JOIN n c ON a.g = c.g AND c.side = 2 JOIN n d ON a.g = d.g AND d.side = 3 WHERE a.side = 0),
w AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY depth, r0, r1, r2, r3) AS rn FROM j WHERE depth <= 10 AND least(w0, w1, w2, w3) > 0 AND greatest(w0, w1, w2, w3) / least(w0, w1, w2, w3) <= 1.5)
SELECT g, depth, r0, r1, r2, r3, w0, w1, w2, w3 FROM w WHERE rn = 1""")
def consistent_rule(spark, sf_dir):
    from pyspark.sql.window import Window

    p = t(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), (F.col("p_partkey") % 4).alias("side"), F.col("p_size").cast("double").alias("w"), "p_retailprice", "p_partkey")
    c = p.withColumn("rk", F.row_number().over(Window.partitionBy("g", "side").orderBy("p_retailprice", "p_partkey")) - 1)
    return study.consistent_rule(c.select("g", "side", "rk", "w"), ["g"], "side", "rk", "w", [0, 1, 2, 3])


@query("SELECT o_orderpriority AS g, CASE WHEN hi <= lo THEN lo - 0.25 ELSE lo END AS low, CASE WHEN hi <= lo THEN hi + 0.25 ELSE hi END AS high FROM (SELECT o_orderpriority, floor((min(o_totalprice) - 0.02) * 4) / 4 AS lo, ceil((max(o_totalprice) + 0.02) * 4) / 4 AS hi FROM orders GROUP BY 1)")
def quarter_bounds(spark, sf_dir):
    low, high = study.quarter_bounds("o_totalprice")
    return t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("g")).agg(low.alias("low"), high.alias("high"))


@query("SELECT s_suppkey AS k, least(250.0, round(p10 + s_suppkey % 60, 4)) AS threshold FROM supplier, (SELECT quantile_cont(l_quantity * 4, 0.1) AS p10 FROM lineitem)")
def scan_threshold(spark, sf_dir):
    p10 = robust.quantiles(t(spark, sf_dir, "lineitem").withColumn("v", F.col("l_quantity") * 4), [], "v", {"p10": 0.1})
    k = F.col("s_suppkey")
    return robust.join_groups(t(spark, sf_dir, "supplier").select("s_suppkey"), p10, []).select(k.alias("k"), F.least(F.lit(250.0), r(F.col("p10") + k % 60, 4)).alias("threshold"))


@query("""WITH c AS (SELECT l_orderkey AS k, l_linenumber % 2 AS s, min(l_quantity) AS hx, min(l_extendedprice) / 2000 AS hy FROM lineitem GROUP BY 1, l_linenumber, 2),
o AS (SELECT o_orderkey AS k, min(o_totalprice) / 20000 AS x, min(o_totalprice) / 40000 + 5 AS y FROM orders GROUP BY 1),
d AS (SELECT o.k, s, hx, hy, sqrt(pow(hx - x, 2) + pow(hy - y, 2)) AS d FROM o JOIN c USING (k)), n AS (SELECT *, row_number() OVER (PARTITION BY k, s ORDER BY d, hx, hy) AS rn FROM d),
p AS (SELECT h.k, h.d / 10 AS h, v.d / 12 AS v, sqrt(pow(h.hx - v.hx, 2) + pow(h.hy - v.hy, 2)) / sqrt(120) AS sep FROM n h JOIN n v ON h.k = v.k AND h.s = 0 AND v.s = 1 AND h.rn = 1 AND v.rn = 1)
SELECT k, round(fmod(h, 1), 5) AS horizontal_phase, round(fmod(v, 1), 5) AS vertical_phase, round(sep, 5) AS center_separation, round(least(abs(fmod(h, 1) - fmod(v, 1)), 1 - abs(fmod(h, 1) - fmod(v, 1))), 5) AS phase_mismatch FROM p WHERE greatest(h, v) <= 1.25""")
def corner_phases(spark, sf_dir):
    holes = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), "l_linenumber").agg(F.min("l_quantity").alias("hx"), (F.min("l_extendedprice") / 2000).alias("hy"))
    holes = holes.select("k", F.when(F.col("l_linenumber") % 2 == 0, "h").otherwise("v").alias("side"), "hx", "hy")
    corners = t(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("k")).agg((F.min("o_totalprice") / 20000).alias("x"), (F.min("o_totalprice") / 40000 + 5).alias("y")).withColumns({"h_pitch": F.lit(10.0), "v_pitch": F.lit(12.0)})
    got = study.corner_phases(corners, holes, ["k"])
    return got.select("k", *[r(c).alias(c) for c in ("horizontal_phase", "vertical_phase", "center_separation", "phase_mismatch")])


@query("""WITH d AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 11 > 0 THEN s_suppkey % 10 / 1e1 END AS tilt, CASE WHEN s_suppkey % 13 > 0 THEN s_suppkey % 6 / 5e0 END AS scatter, s_suppkey % 29 / 2e0 AS strength, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 4 / 1e2 END AS held FROM supplier)
SELECT k, CAST(greatest(1, ceil(0.6::DOUBLE * k)) AS INTEGER) AS quorum, coalesce(CASE WHEN scatter = 0 THEN tilt > 0 ELSE tilt >= 0.9::DOUBLE * scatter END, false) AS resolved,
CASE WHEN strength >= 10 THEN 'accept' WHEN strength < 4.5 THEN 'reject' WHEN held >= 0.01::DOUBLE THEN 'accept' ELSE 'reject' END AS decision, round(tilt * 7 / (2 * pi()) - floor(tilt * 7 / (2 * pi())), 6) AS turn FROM d""")
def collection_decisions(spark, sf_dir):
    k = F.col("s_suppkey")
    d = t(spark, sf_dir, "supplier").select(k.alias("k"), F.when(k % 11 > 0, k % 10 / 10).alias("tilt"), F.when(k % 13 > 0, k % 6 / 5).alias("scatter"), (k % 29 / 2).alias("strength"), F.when(k % 3 > 0, k % 4 / 100).alias("held"))
    return d.select("k", scalar.quorum("k").alias("quorum"), scalar.direction_resolved("tilt", "scatter").alias("resolved"), scalar.screen_decision("strength", "held").alias("decision"), r(scalar.turn(F.col("tilt") * 7), 6).alias("turn"))


@query("""WITH s AS (SELECT p_partkey AS k, p_size AS a, p_partkey % 7 AS b FROM part), n AS (SELECT k, unnest(CASE WHEN b = 6 THEN [] ELSE list_concat(range(a, a + b), [a + 1, 60]) END) AS v FROM s)
SELECT s.k, string_agg(DISTINCT v, ' ' ORDER BY v) AS numbers FROM s LEFT JOIN n ON s.k = n.k GROUP BY 1""")
def listed_numbers(spark, sf_dir):
    a, b = F.col("p_size"), F.col("p_partkey") % 7
    text = F.when(b == 6, F.concat(a.cast("string"), F.lit("-x"))).otherwise(F.concat_ws(",", F.concat(a.cast("string"), F.lit("-"), (a + b - 1).cast("string")), F.lit(" 60 "), (a + 1).cast("string"), F.lit("")))
    found = study.number_ranges("text")
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), text.alias("text")).select("k", F.when(found.isNotNull(), F.array_join(F.transform(found, lambda x: x.cast("string")), " ")).alias("numbers"))


_COHORT = """co AS (SELECT p_partkey AS k, p_brand AS g, CASE WHEN p_partkey % 83 = 0 THEN 15e-1 ELSE 1 + p_partkey % 97 / 5e3 END AS scale_x, CASE WHEN p_partkey % 71 = 1 THEN NULL ELSE 1 + p_partkey % 89 / 5e3 END AS scale_y,
CASE WHEN p_partkey % 67 = 2 THEN 9e0 ELSE p_partkey % 13 / 1e1 END AS residual_rotation_deg, CASE WHEN p_partkey % 61 = 3 THEN 3e-1 ELSE p_partkey % 11 / 1e3 END AS unconstrained_shear, CASE WHEN p_partkey % 59 = 4 THEN 2e0 WHEN p_partkey % 59 = 5 THEN -2e0 ELSE p_partkey % 17 / 1e2 END AS residual_rms,
CASE WHEN p_partkey % 53 = 0 THEN 0 ELSE 3 END AS accepted_affine_updates, CASE WHEN p_partkey % 47 = 0 THEN 2 ELSE 0 END AS alignment_failures, CASE WHEN p_partkey % 43 = 0 THEN 1 ELSE 0 END AS alignment_rejections, 20 + p_size / 1e1 AS design_width_mm FROM part)"""
_CHECKED = {"scale_x": "ln(scale_x)", "scale_y": "ln(scale_y)", "residual_rotation_deg": "residual_rotation_deg", "unconstrained_shear": "unconstrained_shear", "residual_rms": "residual_rms"}


def _far(name: str, least: str, upper: bool = False) -> str:
    x = _CHECKED[name]
    return f"coalesce({f'{x} - m_{name}' if upper else f'abs({x} - m_{name})'} > greatest({least}, 6 * 1.4826 * s_{name}), false)"


@query(f"""WITH {_COHORT}, m AS (SELECT g, {", ".join(f"median({x}) AS m_{n}" for n, x in _CHECKED.items())} FROM co GROUP BY g),
s AS (SELECT g, {", ".join(f"median(abs({x} - m_{n})) AS s_{n}" for n, x in _CHECKED.items())} FROM co JOIN m USING (g) GROUP BY g),
f AS (SELECT co.*, {_far("scale_x", "ln(1.04::DOUBLE)")} AS fx, {_far("scale_y", "ln(1.04::DOUBLE)")} AS fy, {_far("residual_rotation_deg", "2.0")} AS fr, {_far("unconstrained_shear", "0.02")} AS fs, {_far("residual_rms", "0.15", True)} AS fm FROM co JOIN m USING (g) JOIN s USING (g)),
r AS (SELECT *, concat_ws('; ', CASE WHEN fx THEN 'scale_x cohort outlier' END, CASE WHEN fy THEN 'scale_y cohort outlier' END, CASE WHEN accepted_affine_updates = 0 THEN 'no accepted affine refinement' END) AS out,
concat_ws('; ', CASE WHEN alignment_failures <> 0 THEN alignment_failures || ' ECC failures' END, CASE WHEN alignment_rejections <> 0 THEN alignment_rejections || ' implausible ECC updates' END, CASE WHEN fr THEN 'residual rotation outlier' END, CASE WHEN fs THEN 'free shear outlier' END, CASE WHEN fm THEN 'residual RMS outlier' END) AS rev FROM f)
SELECT k, CASE WHEN out <> '' THEN 'rejected' WHEN rev <> '' THEN 'review' ELSE 'ok' END AS registration_status, concat_ws('; ', nullif(out, ''), nullif(rev, '')) AS reasons, CASE WHEN out = '' THEN design_width_mm END AS design_width_mm, CASE WHEN out <> '' THEN design_width_mm END AS candidate_design_width_mm FROM r""")
def registration_status(spark, sf_dir):
    p, size = F.col("p_partkey"), F.col("p_size")
    rows = t(spark, sf_dir, "part").select(
        p.alias("k"), F.col("p_brand").alias("g"), F.when(p % 83 == 0, 1.5).otherwise(1 + p % 97 / 5000).alias("scale_x"), F.when(p % 71 != 1, 1 + p % 89 / 5000).alias("scale_y"), F.when(p % 67 == 2, 9.0).otherwise(p % 13 / 10).alias("residual_rotation_deg"),
        F.when(p % 61 == 3, 0.3).otherwise(p % 11 / 1000).alias("unconstrained_shear"), F.when(p % 59 == 4, 2.0).when(p % 59 == 5, -2.0).otherwise(p % 17 / 100).alias("residual_rms"), F.when(p % 53 == 0, 0).otherwise(3).alias("accepted_affine_updates"),
        F.when(p % 47 == 0, 2).otherwise(0).alias("alignment_failures"), F.when(p % 43 == 0, 1).otherwise(0).alias("alignment_rejections"), (20 + size / 10).alias("design_width_mm"),
    )
    return registration.status(rows, ["g"]).select("k", "registration_status", F.array_join("registration_reasons", "; ").alias("reasons"), "design_width_mm", "candidate_design_width_mm")


@query(f"""{_DENSITY}, a AS (SELECT k, x, y, z, 0.8 * x + 0.6 * y AS p, 0.6 * y + 0.8 * z AS q, 0.36::DOUBLE AS h FROM d), e AS (SELECT *, (p - h * q) / (1 - h * h) AS s, (q - h * p) / (1 - h * h) AS u FROM a)
SELECT k, round(CASE WHEN s >= 0 AND u >= 0 THEN s WHEN p >= q THEN greatest(p, 0) ELSE 0 END, 6) AS first, round(CASE WHEN s >= 0 AND u >= 0 THEN u WHEN p >= q THEN 0 ELSE greatest(q, 0) END, 6) AS second FROM e""")
def unmixed_two(spark, sf_dir):
    one, two = colour.unmix_two([F.col(c) for c in "xyz"], *RAYS)
    return densities(spark, sf_dir).select("k", r(one, 6).alias("first"), r(two, 6).alias("second"))


def _layered(k: int) -> str:
    paper = _lin(str(PAPER[k]))
    x = f"least(greatest({paper} * pow(10.0::DOUBLE, -(greatest(p, 0) * {RAYS[0][k]} + greatest(q, 0) * {RAYS[1][k]})), 0), 1)"
    return f"CAST(floor(least(greatest(CASE WHEN {x} <= 0.0031308 THEN {x} * 12.92 ELSE 1.055 * pow({x}, 1 / 2.4::DOUBLE) - 0.055 END * 255, 0), 255)) AS INTEGER)"


@query(f"""WITH l AS (SELECT p_partkey AS k, (p_partkey % 37 - 5) / 3e1 AS p, (p_size - 3) / 4e1 AS q FROM part) SELECT k, {_layered(0)} AS b, {_layered(1)} AS gr, {_layered(2)} AS re FROM l""")
def rebuilt_colour(spark, sf_dir):
    amounts = [(F.col("p_partkey") % 37 - 5) / 30, (F.col("p_size") - 3) / 40]
    made = colour.rebuilt(amounts, RAYS, [F.lit(p) for p in PAPER])
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), *[m.alias(n) for m, n in zip(made, ("b", "gr", "re"), strict=True)])


@query()
def two_clusters(spark, sf_dir):
    p = t(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return study.two_clusters(p, "x", "y").select(*[r(c, 6).alias(c) for c in ("x", "y")], "n", *[r(c, 6).alias(c) for c in ("rms", "separation")])


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
