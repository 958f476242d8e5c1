"""Pure Column expressions: validation, unit conversion, geometry, decisions."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MM_PER_INCH, GAUGE_MM = 25.4, 20.0


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite_positive(name: str) -> Column:
    """The value as a double if it can be cast and is finite and above 0, else null."""
    x = F.expr(f"try_cast({name} as double)")
    return F.when(~F.isnan(x) & (x > 0) & (x < float("inf")), x)


def gauge(pitch, dpi: float) -> Column:
    """Periods in 20 mm; null unless the pitch is above 0."""
    p = col(pitch)
    return F.when(p > 0, GAUGE_MM * dpi / (MM_PER_INCH * p))


def gated_gauge(pitch, count, supported, dpi: float, least: int = 5, low: float = 5.0, high: float = 22.0) -> Column:
    g = gauge(pitch, dpi)
    return F.when(col(supported) & (col(count) >= least) & g.between(low, high), g)


def intervals(span_mm, gauge_) -> Column:
    """Whole periods that cover a span, at least one."""
    return F.greatest(F.lit(1), F.ceil(col(span_mm) / (GAUGE_MM / col(gauge_)) - 1e-9)).cast("int")


def circular_mismatch(a, b) -> Column:
    """Distance of two phases on the unit circle, 0 to 0.5."""
    d = F.abs(col(a) - col(b)) % 1
    return F.least(d, 1 - d)


def quorum(count) -> Column:
    return F.greatest(F.lit(1), F.ceil(0.6 * col(count))).cast("int")


def direction_resolved(tilt, scatter) -> Column:
    t, s = col(tilt), col(scatter)
    known = t.isNotNull() & s.isNotNull() & ~F.isnan(t) & ~F.isnan(s)
    return F.coalesce(known & F.when(s == 0, t > 0).otherwise(t >= 0.9 * s), F.lit(False))


def screen_decision(strength, held_out) -> Column:
    """accept from 10, reject under 4.5; between them the held-out gain decides."""
    s, h = col(strength), col(held_out)
    return F.when(s >= 10, "accept").when(s < 4.5, "reject").when(h >= 0.01, "accept").otherwise("reject")


def lines_meet(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2, eps: float = 1e-9) -> tuple[Column, Column]:
    """Where two lines through two points each meet; null if they are parallel."""
    x1, y1, x2, y2, x3, y3, x4, y4 = map(col, (ax1, ay1, ax2, ay2, bx1, by1, bx2, by2))
    d = (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4)
    a, b = x1 * y2 - y1 * x2, x3 * y4 - y3 * x4
    ok = F.abs(d) > eps
    return F.when(ok, (a * (x3 - x4) - (x1 - x2) * b) / d), F.when(ok, (a * (y3 - y4) - (y1 - y2) * b) / d)


def decompose(a, b, c, d) -> dict[str, Column]:
    """Scales, rotation in degrees and shear of [[a, b], [c, d]] = rotation * upper triangle."""
    a, b, c, d = map(col, (a, b, c, d))
    sx = F.hypot(a, c)
    return {"scale_x": sx, "scale_y": F.abs(a * d - b * c) / sx, "rotation_deg": F.degrees(F.atan2(c, a)), "shear": (a * b + c * d) / (sx * sx)}


def number_label(low, high) -> Column:
    """'--' for nothing, the number with two decimals, or '(a/b)' for a pair."""
    lo, hi = col(low), col(high)
    one = lambda x: F.format_string("%.2f", x)
    return F.when(lo.isNull(), "--").when(hi.isNull() | (lo == hi), one(lo)).otherwise(F.concat(F.lit("("), one(lo), F.lit("/"), one(hi), F.lit(")")))


def squared_distance(pairs) -> Column:
    total = F.lit(0.0)
    for a, b in pairs:
        total = total + (col(a) - col(b)) * (col(a) - col(b))
    return total


def natural_key(name) -> Column:
    """Sort key in which digit runs compare as numbers and letters without case.

    Each digit run is led by its length, so that plain string order is the natural order.
    """
    parts = F.regexp_extract_all(F.lower(col(name)), F.lit(r"(\d+|\D+)"), 1)
    bare = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    return F.concat_ws("", F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lpad(F.length(bare(x)).cast("string"), 3, "0"), bare(x))).otherwise(x)))


def turn(x) -> Column:
    """An angle's phase in [0, 1)."""
    return F.pmod(col(x) / (2 * math.pi), F.lit(1.0))
