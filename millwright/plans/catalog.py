"""The library's own queries, bound to the supplied tables, with SQL for the same rows.

Floating results are rounded on both sides, as sums depend on their order.
"""

import math

from pyspark.sql import functions as F

from millwright.functions import scalar
from millwright.operators import cluster, consensus, kmeans, resample, robust, select, sequence

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(x, n=6):
    return F.round(x, n)


DAILY = "SELECT CAST(l_shipdate AS DATE) AS d, sum(l_extendedprice * (1 - l_discount)) AS v FROM lineitem GROUP BY 1"


def daily(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    return rows.select(F.lit(0).alias("s"), "d", r("v", 2).alias("v"))


DAILY0 = f"SELECT 0 AS s, d, round(v, 2) AS v FROM ({DAILY})"

MODE = """
counts AS (SELECT l_suppkey, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL),
ranked AS (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY n DESC) AS rk FROM counts),
mode AS (SELECT l_suppkey, CASE WHEN count(*) = 1 THEN min(l_returnflag) END AS mf, CASE WHEN count(*) = 1 THEN min(l_linestatus) END AS ms
         FROM ranked WHERE rk = 1 GROUP BY 1),
split AS (SELECT l.*, m.mf, m.ms, coalesce(l.l_returnflag = m.mf AND l.l_linestatus = m.ms, false) AS inlier FROM lineitem l JOIN mode m USING (l_suppkey))
"""


@query(f"""WITH {MODE},
means AS (SELECT l_suppkey, count(*) AS n, avg(l_quantity) AS mq, avg(l_extendedprice) AS mp FROM split WHERE inlier GROUP BY 1)
SELECT l_suppkey, n, round(mq, 6) AS mean_quantity, round(mp, 4) AS mean_price,
  round(lead(mq) OVER (ORDER BY l_suppkey) - mq, 6) AS delta_quantity, round(lead(mp) OVER (ORDER BY l_suppkey) - mp, 4) AS delta_price FROM means""")
def unique_mode_filter(spark, sf_dir):
    """Rows of each supplier's unique most frequent status pair, their means, and consecutive changes."""
    split = robust.mode_split(t(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_returnflag", "l_linestatus"])
    means = split.where("inlier").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mq"), F.avg("l_extendedprice").alias("mp"))
    d = robust.deltas(means, [], ["l_suppkey"], ["mq", "mp"])
    return d.select("l_suppkey", "n", r("mq").alias("mean_quantity"), r("mp", 4).alias("mean_price"), r("delta_mq").alias("delta_quantity"), r("delta_mp", 4).alias("delta_price"))


@query(f"""WITH {MODE} SELECT l_suppkey, CASE WHEN mf IS NULL THEN 'no unique mode' WHEN inlier THEN 'mode' ELSE 'differs' END AS reason, inlier, count(*) AS n FROM split GROUP BY ALL""")
def mode_reasons(spark, sf_dir):
    return robust.mode_split(t(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_returnflag", "l_linestatus"]).groupBy("l_suppkey", "reason", "inlier").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT o_orderpriority AS p, o_orderstatus AS s, avg(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY ALL)
SELECT p, s, n, round(v, 4) AS v, round(lead(v) OVER (PARTITION BY p ORDER BY s) - v, 4) AS delta_v FROM m""")
def group_gap_deltas(spark, sf_dir):
    m = t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s")).agg(F.avg("o_totalprice").alias("v"), F.count("*").alias("n"))
    return robust.deltas(m, ["p"], ["s"], ["v"]).select("p", "s", "n", r("v", 4).alias("v"), r("delta_v", 4).alias("delta_v"))


def _outlier_sql(table, group, value, key, least, sigmas, expr, side):
    return f"""WITH a AS (SELECT {key} AS k, {group} AS g, {expr} AS x FROM {table}), m AS (SELECT g, median(x) AS med FROM a GROUP BY g),
o AS (SELECT a.*, m.med, abs(x - med) AS off FROM a JOIN m USING (g)), s AS (SELECT g, greatest({least}, {sigmas} * 1.4826 * median(off)) AS radius FROM o GROUP BY g)
SELECT k, g, round(med, 6) AS median, round(radius, 6) AS radius FROM o JOIN s USING (g) WHERE {side} > radius"""


@query(_outlier_sql("documents", "lang", "n_chars", "doc_id", 1.0, 6.0, "CAST(n_chars AS DOUBLE)", "off"))
def robust_outliers(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.col("lang").alias("g"), "n_chars")
    return robust.outliers(d, ["g"], "n_chars", 1.0, 6.0).where("outlier").select("k", "g", r("median").alias("median"), r("radius").alias("radius"))


@query(_outlier_sql("part", "p_brand", "p_retailprice", "p_partkey", round(math.log(1.04), 12), 1.2, "ln(CAST(p_retailprice AS DOUBLE))", "x - med"))
def robust_outliers_log_upper(spark, sf_dir):
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("g"), "p_retailprice")
    return robust.outliers(p, ["g"], "p_retailprice", round(math.log(1.04), 12), 1.2, log=True, upper_only=True).where("outlier").select("k", "g", r("median").alias("median"), r("radius").alias("radius"))


def _line_sql(rounds=6, tolerance=1.0):
    out = ["d0 AS MATERIALIZED (SELECT l_returnflag AS g, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y, true AS ok FROM lineitem)"]
    fit = "SELECT g, regr_slope(y, x) AS sl, regr_intercept(y, x) AS ic, count(*) AS kept"
    for k in range(rounds):
        out.append(f"f{k} AS ({fit} FROM d{k} WHERE ok GROUP BY g HAVING count(*) >= 3)")
        out.append(f"r{k} AS MATERIALIZED (SELECT d.*, y - (sl * x + ic) AS res FROM d{k} d LEFT JOIN f{k} USING (g))")
        out.append(f"m{k} AS (SELECT g, median(res) AS med FROM r{k} WHERE ok GROUP BY g)")
        out.append(f"s{k} AS (SELECT g, median(abs(res - med)) AS mad FROM r{k} JOIN m{k} USING (g) WHERE ok GROUP BY g)")
        out.append(f"d{k + 1} AS MATERIALIZED (SELECT g, x, y, coalesce(abs(res - med) <= greatest({tolerance}, 3 * 1.4826 * mad), ok) AS ok FROM r{k} LEFT JOIN m{k} USING (g) LEFT JOIN s{k} USING (g))")
    return f"WITH {', '.join(out)} SELECT g, round(sl, 4) AS slope, round(ic, 3) AS intercept, kept FROM ({fit} FROM d{rounds} WHERE ok GROUP BY g HAVING count(*) >= 3)"


@query(_line_sql())
def iterated_robust_line(spark, sf_dir):
    line = robust.robust_line(t(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "g"), ["g"], "l_quantity", "l_extendedprice", 1.0)
    return line.select("g", r("slope", 4).alias("slope"), r("intercept", 3).alias("intercept"), "kept")


@query("SELECT l_linestatus AS g, round(regr_slope(l_extendedprice, l_quantity), 4) AS gain, round(regr_intercept(l_extendedprice, l_quantity), 3) AS shift, round(corr(l_extendedprice, l_quantity), 6) AS r FROM lineitem GROUP BY 1")
def gain_offset_match(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("g")).agg(r(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("gain"), r(F.regr_intercept("l_extendedprice", "l_quantity"), 3).alias("shift"), r(F.corr("l_extendedprice", "l_quantity")).alias("r"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance, TRY_CAST(c_name AS DOUBLE) AS from_text FROM customer")
def finite_positive(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", scalar.finite_positive("c_acctbal").alias("balance"), scalar.finite_positive("c_name").alias("from_text"))


@query("""WITH g AS (SELECT p_partkey, p_size, 20.0 * 600 / (25.4 * (p_size + 20)) AS g FROM part)
SELECT p_partkey, round(g, 6) AS gauge, CASE WHEN p_size >= 5 AND g BETWEEN 5 AND 22 THEN round(g, 6) END AS gated,
CAST(greatest(1, ceil(30.0 / (20.0 / g) - 1e-9)) AS INTEGER) AS intervals FROM g""")
def gauge_convert_gate(spark, sf_dir):
    p = t(spark, sf_dir, "part").withColumn("pitch", F.col("p_size") + 20.0)
    g = scalar.gauge("pitch", 600)
    return p.select("p_partkey", r(g).alias("gauge"), r(scalar.gated_gauge("pitch", "p_size", F.lit(True), 600)).alias("gated"), scalar.intervals(F.lit(30.0), g).alias("intervals"))


_TYPES = ("click", "view", "purchase", "signup", "error")


@query("""SELECT user_id, max(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 END) AS worst_phase, count(*) AS n FROM events GROUP BY 1""")
def phase_lookup_worst(spark, sf_dir):
    phases = F.create_map(*[F.lit(x) for k, v in zip(_TYPES[:4], range(1, 5), strict=True) for x in (k, v)])
    return t(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.try_element_at(phases, F.col("event_type"))).alias("worst_phase"), F.count("*").alias("n"))


@query("SELECT d.doc_id, d.source, coalesce(CAST(l.quality AS VARCHAR), '') AS class FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)")
def keyed_left_classify(spark, sf_dir):
    labels = select.last_wins(t(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"], ["quality"])
    return t(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left").select("doc_id", "source", F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("class"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def sibling_anti(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", "source").join(t(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("""WITH b AS (SELECT o_custkey, avg(o_totalprice) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), a AS (SELECT o_custkey, avg(o_totalprice) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT CASE WHEN b.v IS NULL THEN 'gained' WHEN a.v IS NULL THEN 'lost' WHEN abs(a.v - b.v) <= 10000 THEN 'same' ELSE 'changed' END AS change, count(*) AS n,
round(quantile_cont(CAST(abs(a.v - b.v) AS DOUBLE), 0.5), 4) AS median, round(quantile_cont(CAST(abs(a.v - b.v) AS DOUBLE), 0.9), 4) AS p90, round(max(abs(a.v - b.v)), 4) AS most
FROM b FULL OUTER JOIN a USING (o_custkey) GROUP BY 1""")
def before_after_compare(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    side = lambda k: o.where(F.col("o_orderkey") % 2 == k).groupBy("o_custkey").agg(F.avg("o_totalprice").alias("v"))
    c = select.before_after(side(0), side(1), ["o_custkey"], "v", 10000)
    return c.groupBy("change").agg(F.count("*").alias("n"), r(F.percentile("difference", 0.5), 4).alias("median"), r(F.percentile("difference", 0.9), 4).alias("p90"), r(F.max("difference"), 4).alias("most"))


@query("""WITH c AS (SELECT p_type, p_brand, p_partkey AS k, CAST(p_retailprice AS DOUBLE) AS pitch, CAST(p_size AS DOUBLE) AS line, p_size * 10.0 AS score FROM part),
s AS (SELECT c.*, EXISTS (SELECT 1 FROM c o WHERE o.p_type = c.p_type AND o.p_brand <> c.p_brand AND abs(ln(c.pitch / o.pitch)) <= 0.02 AND abs(c.line - o.line) <= 0.08 * c.pitch) AS supported FROM c),
a AS (SELECT *, score * CASE WHEN supported THEN 1.1 ELSE 1.0 END AS adjusted FROM s),
w AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY adjusted DESC, k) AS rn FROM a)
SELECT p_type, k, round(adjusted, 6) AS adjusted, supported FROM w WHERE rn = 1""")
def cross_support_select(spark, sf_dir):
    c = t(spark, sf_dir, "part").select("p_type", "p_brand", F.col("p_partkey").alias("k"), F.col("p_retailprice").cast("double").alias("pitch"), F.col("p_size").cast("double").alias("line"), (F.col("p_size") * 10.0).alias("score"))
    return select.cross_support(c, ["p_type"], "p_brand", "pitch", "line", "score", "k").select("p_type", "k", r("adjusted").alias("adjusted"), "supported")


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem),
f AS (SELECT l_orderkey, min(rn) FILTER (WHERE l_quantity >= 45) AS first, max(rn) AS n FROM o GROUP BY 1),
b AS (SELECT l_orderkey, rn, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, rn) AS k FROM o)
SELECT f.l_orderkey, CAST(coalesce(first, b.rn) AS INTEGER) AS chosen, CAST(coalesce(first, n) AS INTEGER) AS attempts, first IS NOT NULL AS strong FROM f JOIN b ON f.l_orderkey = b.l_orderkey AND b.k = 1""")
def first_strong_else_best(spark, sf_dir):
    return select.first_strong_else_best(t(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], F.col("l_quantity") >= 45, F.col("l_quantity"))


@query("""WITH s AS (SELECT user_id, min(CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 END) AS k FROM events WHERE value > 90 GROUP BY 1)
SELECT CASE k WHEN 1 THEN 'purchase' WHEN 2 THEN 'click' ELSE 'view' END AS method, count(*) AS solved, k * count(*) AS cost FROM s WHERE k IS NOT NULL GROUP BY k""")
def ordered_cascade(spark, sf_dir):
    return select.cascade(t(spark, sf_dir, "events"), "user_id", "event_type", F.col("value") > 90, ["purchase", "click", "view"])


@query("""WITH m AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)
SELECT m.o_custkey, m.o_orderpriority, count(o.o_totalprice) AS n, CASE WHEN count(o.o_totalprice) >= 4 THEN round(median(CAST(o.o_totalprice AS DOUBLE)), 4) END AS reference
FROM m JOIN orders o ON m.o_custkey = o.o_custkey AND m.o_orderpriority <> o.o_orderpriority GROUP BY 1, 2""")
def opposite_leave_one_out(spark, sf_dir):
    return select.leave_one_out(t(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_totalprice", 4).withColumn("reference", r("reference", 4))


PAIRS = "SELECT l_partkey, min(CAST(l_quantity AS DOUBLE)) AS a, max(CAST(l_quantity AS DOUBLE)) AS b FROM lineitem GROUP BY 1"


@query(f"""WITH p AS ({PAIRS}), d AS (SELECT *, CASE WHEN abs(b - a) <= 0.05 * a THEN 1 WHEN abs(b / 2 - a) <= 0.05 * a THEN 2 WHEN abs(b / 3 - a) <= 0.05 * a THEN 3 END AS k FROM p),
e AS (SELECT l_partkey, CASE WHEN k IS NOT NULL THEN (a + b / k) / 2 ELSE a END AS low, CASE WHEN k IS NULL THEN b END AS high, k FROM d)
SELECT l_partkey, round(low, 6) AS low, high, CAST(k AS INTEGER) AS divisor, CASE WHEN high IS NULL OR low = high THEN printf('%.2f', low) ELSE '(' || printf('%.2f', low) || '/' || printf('%.2f', high) || ')' END AS label FROM e""")
def reconcile_harmonics(spark, sf_dir):
    p = t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min(F.col("l_quantity").cast("double")).alias("a"), F.max(F.col("l_quantity").cast("double")).alias("b"))
    low, high, divisor = select.reconcile("a", "b")
    return p.select("l_partkey", r(low).alias("low"), high.alias("high"), divisor.alias("divisor"), scalar.number_label(low, high).alias("label"))


_PHASE_SQL = "(extract(hour FROM ts) + extract(minute FROM ts) / 60.0) / 24.0"


@query(f"""WITH p AS (SELECT event_type, sum(sin(2 * pi() * {_PHASE_SQL})) AS s, sum(cos(2 * pi() * {_PHASE_SQL})) AS c, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, n, round(atan2(s, c) / (2 * pi()) - floor(atan2(s, c) / (2 * pi())), 6) AS phase, round(sqrt(s * s + c * c) / n, 6) AS resultant FROM p""")
def circular_summary(spark, sf_dir):
    phase = (F.hour("ts") + F.minute("ts") / 60.0) / 24.0
    mean, length = robust.circular(F.col("p"))
    return t(spark, sf_dir, "events").withColumn("p", phase).groupBy("event_type").agg(F.count("*").alias("n"), r(mean).alias("phase"), r(length).alias("resultant"))


@query(f"""WITH p AS (SELECT user_id, min({_PHASE_SQL}) AS a, max({_PHASE_SQL}) AS b FROM events GROUP BY 1) SELECT user_id, round(least(b - a, 1 - (b - a)), 6) AS mismatch FROM p""")
def circular_mismatch(spark, sf_dir):
    phase = (F.hour("ts") + F.minute("ts") / 60.0) / 24.0
    p = t(spark, sf_dir, "events").groupBy("user_id").agg(F.min(phase).alias("a"), F.max(phase).alias("b"))
    return p.select("user_id", r(scalar.circular_mismatch("a", "b")).alias("mismatch"))


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2),
x AS (SELECT *, sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS k FROM d)
SELECT user_id, min(d) FILTER (WHERE k = 4) AS first_run FROM x GROUP BY 1""")
def sustained_run(spark, sf_dir):
    d = t(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    return sequence.sustained_run(d, ["user_id"], "d", F.col("n") >= 2)


@query("""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2),
m AS (SELECT *, max(n) OVER (PARTITION BY event_type ORDER BY d ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS mx FROM d)
SELECT event_type, d, n, min(mx) OVER (PARTITION BY event_type ORDER BY d ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS closed FROM m""")
def rank_closing(spark, sf_dir):
    d = t(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    return sequence.closing(d, ["event_type"], "d", "n")


_G = [math.exp(-0.5 * (k / 2.0) ** 2) for k in range(-6, 7)]
_SMOOTH = " + ".join(f"{g!r} * coalesce({'lag' if k < 0 else 'lead'}(v, {abs(k)}) OVER w, {'first' if k < 0 else 'last'}_value(v) OVER e)" for k, g in zip(range(-6, 7), _G, strict=True))


@query(f"""WITH d AS ({DAILY0}), s AS (SELECT d, v, ({_SMOOTH}) / {sum(_G)!r} AS sm FROM d WINDOW w AS (ORDER BY d), e AS (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
x AS (SELECT v - sm AS res FROM s), m AS (SELECT median(res) AS med FROM x)
SELECT round(1.4826 * median(abs(res - med)), 2) AS noise, count(*) AS n FROM x, m""")
def gaussian_smooth_noise(spark, sf_dir):
    s = sequence.smooth(daily(spark, sf_dir), ["s"], "d", "v", 2.0).select("s", (F.col("v") - F.col("smooth")).alias("res"))
    off = s.join(s.groupBy("s").agg(F.median("res").alias("med")), "s")
    return off.agg(r(1.4826 * F.median(F.abs(F.col("res") - F.col("med"))), 2).alias("noise"), F.count("*").alias("n"))


@query(f"""WITH d AS ({DAILY0}), o AS (SELECT row_number() OVER (ORDER BY d) AS i, v - avg(v) OVER () AS x FROM d), b AS (SELECT sum(x * x) AS s FROM o)
SELECT CAST(p.i - o.i AS INTEGER) AS lag, round(sum(o.x * p.x) / any_value(b.s), 6) AS r FROM o JOIN o p ON p.i - o.i BETWEEN 1 AND 30, b GROUP BY 1""")
def autocorrelation(spark, sf_dir):
    return sequence.autocorrelation(daily(spark, sf_dir), ["s"], "d", "v", 30).select("lag", r("r").alias("r"))


@query(f"""WITH d AS ({DAILY0}), n AS (SELECT d, v, row_number() OVER (ORDER BY d) AS i, lag(v) OVER (ORDER BY d) AS l, lead(v) OVER (ORDER BY d) AS nx FROM d),
p AS (SELECT * FROM n WHERE v > l AND v >= nx),
b AS (SELECT p.d, p.v, p.i, (SELECT max(q.i) FROM n q WHERE q.i < p.i AND q.v > p.v) AS a, (SELECT min(q.i) FROM n q WHERE q.i > p.i AND q.v > p.v) AS z FROM p),
g AS (SELECT d, v AS height, (SELECT min(q.v) FROM n q WHERE q.i < b.i AND q.i > coalesce(b.a, 0)) AS lo, (SELECT min(q.v) FROM n q WHERE q.i > b.i AND q.i < coalesce(b.z, 1000000000)) AS hi FROM b),
k AS (SELECT d, height, round(height - greatest(lo, hi), 2) AS prominence FROM g)
SELECT * FROM k ORDER BY prominence DESC, d LIMIT 12""")
def local_maxima_prominence(spark, sf_dir):
    p = sequence.peaks(daily(spark, sf_dir), ["s"], "d", "v").select("d", "height", r("prominence", 2).alias("prominence"))
    return p.orderBy(F.desc("prominence"), "d").limit(12)


@query(f"""WITH d AS ({DAILY0}), m AS (SELECT avg(v) AS a FROM d), n AS (SELECT row_number() OVER (ORDER BY d) AS i, v, lead(v) OVER (ORDER BY d) AS x FROM d)
SELECT round(i + (a - v) / (x - v), 6) AS crossing FROM n, m WHERE (v < a) <> (x < a)""")
def level_crossing(spark, sf_dir):
    d = daily(spark, sf_dir)
    d = d.join(F.broadcast(d.groupBy("s").agg(F.avg("v").alias("a"))), "s")
    return sequence.crossings(d, ["s"], "d", "v", F.col("a")).select(r("crossing").alias("crossing"))


@query(f"""WITH d AS ({DAILY0}), m AS (SELECT quantile_cont(v, 0.5) AS lo, quantile_cont(v, 0.95) AS hi FROM d), n AS (SELECT row_number() OVER (ORDER BY d) AS i, v FROM d),
x AS (SELECT i, v, hi, i - row_number() OVER (ORDER BY i) AS run FROM n, m WHERE v > lo)
SELECT CAST(min(i) AS INTEGER) AS first, CAST(max(i) AS INTEGER) AS last, count(*) AS rows, max(v) AS peak FROM x GROUP BY run HAVING max(v) >= any_value(hi)""")
def hysteresis_components(spark, sf_dir):
    d = daily(spark, sf_dir)
    d = d.join(F.broadcast(d.groupBy("s").agg(F.percentile("v", 0.5).alias("lo"), F.percentile("v", 0.95).alias("hi"))), "s")
    return sequence.hysteresis(d, ["s"], "d", "v", F.col("lo"), F.col("hi")).select("first", "last", "rows", "peak")


def dims(spark, sf_dir):
    return t(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))


DIMS = "SELECT vec_id, label, CAST(i - 1 AS INTEGER) AS dim, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, 65) AS g(i)"


@query(f"WITH d AS ({DIMS}) SELECT label, dim, round(sum(value * (1 + vec_id % 3)) / sum(1.0 + vec_id % 3), 6) AS merged, sum(1.0 + vec_id % 3) AS coverage FROM d GROUP BY ALL")
def quorum_weighted_merge(spark, sf_dir):
    d = dims(spark, sf_dir).withColumn("w", 1.0 + F.col("vec_id") % 3)
    return robust.weighted_merge(d, ["label", "dim"], "value", "w").select("label", "dim", r("merged").alias("merged"), "coverage")


@query(f"WITH d AS ({DIMS}) SELECT label, dim, count(*) FILTER (WHERE value > 0) AS seen, CASE WHEN count(*) FILTER (WHERE value > 0) >= 12 THEN round(median(value) FILTER (WHERE value > 0), 6) END AS merged FROM d GROUP BY 1, 2")
def quorum_median_merge(spark, sf_dir):
    return robust.median_merge(dims(spark, sf_dir), ["label", "dim"], "value", F.col("value") > 0, 12).select("label", "dim", "seen", r("merged").alias("merged"))


@query(f"""WITH d AS ({DIMS}), h AS (SELECT label, dim, avg(value) FILTER (WHERE vec_id % 2 = 0) AS a, avg(value) FILTER (WHERE vec_id % 2 = 1) AS b FROM d GROUP BY 1, 2)
SELECT label, round(corr(a, b), 6) AS agreement, count(*) AS n FROM h WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def half_set_agreement(spark, sf_dir):
    v = F.col("value")
    h = dims(spark, sf_dir).groupBy("label", "dim").agg(F.avg(F.when(F.col("vec_id") % 2 == 0, v)).alias("a"), F.avg(F.when(F.col("vec_id") % 2 == 1, v)).alias("b")).dropna()
    return h.groupBy("label").agg(r(F.corr("a", "b")).alias("agreement"), F.count("*").alias("n"))


POINTS = "SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings"


def points(spark, sf_dir):
    return t(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


def seeds(p):
    return p.where("label < 4").groupBy(F.col("label").alias("c")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


_STEP = "SELECT p.vec_id, p.label, p.x, p.y, k.c, (p.x - k.x) * (p.x - k.x) + (p.y - k.y) * (p.y - k.y) AS d2, row_number() OVER (PARTITION BY vec_id ORDER BY (p.x - k.x) * (p.x - k.x) + (p.y - k.y) * (p.y - k.y), c) AS rn FROM p, {} k"
_LLOYD = f"""WITH p AS ({POINTS}), k0 AS (SELECT label AS c, avg(x) AS x, avg(y) AS y FROM p WHERE label < 4 GROUP BY 1), a0 AS ({_STEP.format("k0")}),
k1 AS (SELECT c, avg(x) AS x, avg(y) AS y, count(*) AS n, sum(d2) AS inertia FROM a0 WHERE rn = 1 GROUP BY 1), a1 AS ({_STEP.format("k1")}),
k2 AS (SELECT c, avg(x) AS x, avg(y) AS y, count(*) AS n, sum(d2) AS inertia FROM a1 WHERE rn = 1 GROUP BY 1)"""


@query(_LLOYD + " SELECT c, round(x, 6) AS x, round(y, 6) AS y, n, round(inertia, 5) AS inertia, row_number() OVER (ORDER BY x + y, x, y) - 1 AS canonical FROM k2")
def lloyd_step(spark, sf_dir):
    p = points(spark, sf_dir)
    k = cluster.order_clusters(cluster.lloyd(p, seeds(p), ["x", "y"], 2), ["x", "y"])
    return k.select("c", r("x").alias("x"), r("y").alias("y"), "n", r("inertia", 5).alias("inertia"), F.col("canonical").cast("long").alias("canonical"))


@query(_LLOYD + " SELECT vec_id, c, round(d2, 6) AS d2 FROM a0 WHERE rn = 1 ORDER BY d2 DESC, vec_id DESC LIMIT 6")
def farthest_from_centroid(spark, sf_dir):
    p = points(spark, sf_dir)
    return cluster.farthest(cluster.assign(p, seeds(p), ["x", "y"]), "vec_id").select("vec_id", "c", r("d2").alias("d2"))


@query()
def silhouette(spark, sf_dir):
    return cluster.silhouette(points(spark, sf_dir).repartition(24, "vec_id"), "label", "vec_id", ["x", "y"]).withColumn("silhouette", r("silhouette"))


@query("""WITH l AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), h AS (SELECT CAST(least(255, floor((l_extendedprice - lo) / (hi - lo) * 256)) AS INTEGER) AS bin, count(*) AS n FROM lineitem, l GROUP BY 1),
c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS w, sum(n * bin) OVER (ORDER BY bin) AS s, sum(n) OVER () AS tw, sum(n * bin) OVER () AS ts FROM h)
SELECT bin FROM c WHERE w < tw ORDER BY w * 1.0 * (tw - w) * power(CAST(s AS DOUBLE) / w - CAST(ts - s AS DOUBLE) / (tw - w), 2) DESC, bin LIMIT 1""")
def otsu_split(spark, sf_dir):
    return robust.otsu(t(spark, sf_dir, "lineitem"), "l_extendedprice").select("bin")


@query("""SELECT o_orderpriority AS g, list_sort(list(o_totalprice))[least(count(*), CAST(floor(count(*) * 0.9) AS BIGINT) + 1)] AS cut_off,
list_sort(list(o_totalprice))[CAST(round_even((count(*) - 1) * 0.9, 0) AS BIGINT) + 1] AS rounded, round(quantile_cont(CAST(o_totalprice AS DOUBLE), 0.9), 4) AS linear FROM orders GROUP BY 1""")
def discrete_quantiles(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), "o_totalprice")
    return robust.discrete_quantiles(o, ["g"], "o_totalprice", 0.9).withColumn("linear", r("linear", 4))


@query("""WITH s AS (SELECT l_suppkey, l_returnflag, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY l_suppkey) AS share FROM lineitem GROUP BY 1, 2), n AS (SELECT count(DISTINCT l_suppkey) AS k FROM lineitem)
SELECT l_returnflag, count(*) AS suppliers FROM s, n WHERE share >= 0.25 GROUP BY 1, k HAVING count(*) >= k // 2 + 1""")
def majority_presence(spark, sf_dir):
    c = t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    total = c.groupBy("l_suppkey").agg(F.sum("n").alias("all"))
    k = total.agg(F.count("*").alias("k"))
    found = c.join(total, "l_suppkey").where(F.col("n") / F.col("all") >= 0.25).groupBy("l_returnflag").agg(F.count("*").alias("suppliers"))
    return found.join(F.broadcast(k)).where(F.expr("suppliers >= k div 2 + 1")).select("l_returnflag", "suppliers")


@query("""SELECT o_orderstatus AS g, round(coalesce(CASE WHEN count(*) FILTER (WHERE o_orderpriority = '1-URGENT') >= 50 THEN quantile_cont(CAST(o_totalprice AS DOUBLE), 0.72) FILTER (WHERE o_orderpriority = '1-URGENT') END, quantile_cont(CAST(o_totalprice AS DOUBLE), 0.72)), 4) AS p72 FROM orders GROUP BY 1""")
def percentile_fallback(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("g"), "o_orderpriority", "o_totalprice")
    few = robust.quantiles(o, ["g"], "o_totalprice", {"few": 0.72}, F.col("o_orderpriority") == "1-URGENT").where("n >= 50").drop("n")
    every = robust.quantiles(o, ["g"], "o_totalprice", {"every": 0.72}).drop("n")
    return robust.join_groups(every, few, ["g"], "left").select("g", r(F.coalesce("few", "every"), 4).alias("p72"))


_AFFINE = {"a": "1 + p_size / 1e2", "b": "p_size / 5e2 - 5e-2", "c": "p_size / 4e2 - 6e-2", "d": "1 - p_size / 2e2"}


@query(f"""WITH m AS (SELECT p_partkey, {", ".join(f"CAST({e} AS DOUBLE) AS {k}" for k, e in _AFFINE.items())} FROM part)
SELECT p_partkey, round(sqrt(a * a + c * c), 6) AS scale_x, round(abs(a * d - b * c) / sqrt(a * a + c * c), 6) AS scale_y, round(degrees(atan2(c, a)), 6) AS rotation_deg, round((a * b + c * d) / (a * a + c * c), 6) AS shear FROM m""")
def affine_decompose(spark, sf_dir):
    m = t(spark, sf_dir, "part").select("p_partkey", *[F.expr(f"cast({e} as double)").alias(k) for k, e in _AFFINE.items()])
    return m.select("p_partkey", *[r(v).alias(k) for k, v in scalar.decompose("a", "b", "c", "d").items()])


@query("""WITH q AS (SELECT s_suppkey AS k, 0.0 AS x1, s_suppkey % 7 * 1.0 AS y1, 10.0 AS x2, s_suppkey % 5 * 1.0 AS y2, 0.0 AS x3, 3.0 AS y3, 10.0 AS x4, s_suppkey % 11 * 1.0 AS y4 FROM supplier),
d AS (SELECT *, (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4) AS den FROM q)
SELECT k, CASE WHEN abs(den) > 1e-9 THEN round(CAST(((x1 * y2 - y1 * x2) * (x3 - x4) - (x1 - x2) * (x3 * y4 - y3 * x4)) AS DOUBLE) / den, 6) END AS x,
CASE WHEN abs(den) > 1e-9 THEN round(CAST(((x1 * y2 - y1 * x2) * (y3 - y4) - (y1 - y2) * (x3 * y4 - y3 * x4)) AS DOUBLE) / den, 6) END AS y FROM d""")
def line_intersection(spark, sf_dir):
    k = F.col("s_suppkey")
    d = lambda x: F.lit(float(x))
    x, y = scalar.lines_meet(d(0), (k % 7).cast("double"), d(10), (k % 5).cast("double"), d(0), d(3), d(10), (k % 11).cast("double"))
    return t(spark, sf_dir, "supplier").select(k.alias("k"), r(x).alias("x"), r(y).alias("y"))


@query(f"""WITH d AS ({DAILY0}), n AS (SELECT row_number() OVER (ORDER BY d) - 1 AS i, v FROM d), s AS (SELECT avg(v * cos(2 * pi() * i / 7.0)) AS re, -avg(v * sin(2 * pi() * i / 7.0)) AS im FROM n)
SELECT round(re, 4) AS re, round(im, 4) AS im, round(sqrt(re * re + im * im), 4) AS amplitude FROM s""")
def fourier_coefficient(spark, sf_dir):
    from pyspark.sql.window import Window

    n = daily(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("s").orderBy("d")) - 1)
    a = 2 * math.pi * F.col("i") / 7.0
    s = n.agg(F.avg(F.col("v") * F.cos(a)).alias("re"), (-F.avg(F.col("v") * F.sin(a))).alias("im"))
    return s.select(r("re", 4).alias("re"), r("im", 4).alias("im"), r(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2), 4).alias("amplitude"))


@query("""WITH c AS (SELECT c_custkey, lower(regexp_replace(c_name, '\\d+$', '')) AS stem, CAST(regexp_extract(c_name, '(\\d+)$', 1) AS BIGINT) AS number FROM customer)
SELECT c_custkey, number, row_number() OVER (ORDER BY stem, number, c_custkey) AS place FROM c""")
def natural_order(spark, sf_dir):
    c = sequence.natural_order(t(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", "c_custkey")
    return c.select("c_custkey", F.regexp_extract("c_name", r"(\d+)$", 1).cast("long").alias("number"), "place")


@query("SELECT event_type, count(*) AS n, sum(CAST(props->>'$.k' AS BIGINT)) AS total, count(*) FILTER (WHERE props->>'$.k' IS NULL) AS bad FROM events GROUP BY 1")
def json_flatten(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k.cast("long")).alias("total"), F.count_if(k.isNull()).alias("bad"))


@query("""
WITH p AS (SELECT l_orderkey, CAST(l_linenumber AS DOUBLE) AS x, CAST(l_quantity AS DOUBLE) AS y FROM lineitem),
c AS (SELECT DISTINCT a.l_orderkey, a.x AS x0, b.x AS x1, a.y AS y0, b.y AS y1, (b.y - a.y) / (b.x - a.x) AS m, a.y - (b.y - a.y) / (b.x - a.x) * a.x AS b0
      FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.x < b.x),
s AS (SELECT c.l_orderkey, x0, x1, y0, y1, m, b0, count(*) AS n, round(avg(pow(p.y - (b0 + m * p.x), 2)), 9) AS mse, max(p.x) - min(p.x) AS span
      FROM c JOIN p ON p.l_orderkey = c.l_orderkey AND abs(p.y - (b0 + m * p.x)) <= 2.5 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, mse, span DESC, x0, x1, y0, y1) AS rk FROM s)
SELECT l_orderkey, round(m, 6) AS slope, round(b0, 6) AS intercept, n, round(mse, 6) AS mse, span FROM k WHERE rk = 1
""")
def consensus_line(spark, sf_dir):
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    found = consensus.consensus_line(lines, ["l_orderkey"], "l_linenumber", "l_quantity", 2.5)
    return found.select("l_orderkey", r("slope").alias("slope"), r("intercept").alias("intercept"), F.col("n").cast("long").alias("n"), r("mse").alias("mse"), "span")


@query()
def kmeans_restarts(spark, sf_dir):
    got = kmeans.centres(points(spark, sf_dir), ["x", "y"], 4)
    return got.select("c", r("x").alias("x"), r("y").alias("y"), "n", r("inertia", 5).alias("inertia"))


@query()
def gap_statistic(spark, sf_dir):
    return kmeans.gap_statistic(t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("a"), F.count("*").alias("n")), ["a", "n"])


@query()
def bootstrap_mean(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").select("o_orderpriority", "o_custkey", "o_totalprice")
    return resample.bootstrap_mean(orders, ["o_orderpriority"], "o_custkey", "o_totalprice")
