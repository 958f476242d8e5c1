"""Colour of pixels as Column expressions: transfer curves, density, unmixing."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from millwright.functions.scalar import col

#: the grey direction
NEUTRAL = (1 / math.sqrt(3.0),) * 3


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def to_linear(value) -> Column:
    """Linear reflectance of an sRGB value 0..255."""
    x = clip(col(value) / 255.0, 0.0, 1.0)
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def to_srgb(value) -> Column:
    """sRGB value 0..255 of a linear reflectance."""
    x = clip(col(value), 0.0, 1.0)
    return clip(F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055) * 255.0, 0.0, 255.0)


def density(value, paper) -> Column:
    """Optical density of a channel against paper, 0 to 4."""
    return clip(-F.log10(clip(to_linear(value) / F.greatest(to_linear(paper), F.lit(1e-9)), 1e-4, 1.0)), 0.0, 4.0)


def norm(values) -> Column:
    return F.sqrt(sum((v * v for v in values[1:]), values[0] * values[0]))


def dot(values, ray) -> Column:
    return sum((v * F.lit(float(r)) for v, r in zip(values[1:], ray[1:], strict=True)), values[0] * F.lit(float(ray[0])))


#: Residuals this near count as equal: directions that fit a pixel alike differ by rounding only.
TIE = 1e-9


def unmix(values: list[Column], rays: list[tuple]) -> list[Column]:
    """Amounts of each ray and of grey: all of a pixel goes to the one direction that leaves the least
    residual with an amount of at least 0, the first of those within TIE of it."""
    directions = [*rays, NEUTRAL]
    amounts = [dot(values, ray) for ray in directions]
    rests = [norm([v - a * F.lit(float(r)) for v, r in zip(values, ray, strict=True)]) for a, ray in zip(amounts, directions, strict=True)]
    costs = [F.when(a >= 0, rest).otherwise(F.lit(math.inf)) for a, rest in zip(amounts, rests, strict=True)]
    least = F.least(*costs)
    out, free = [], least < F.lit(math.inf)
    for a, cost in zip(amounts, costs, strict=True):
        mine = free & (cost <= least + TIE)
        out.append(F.when(mine, a).otherwise(0.0))
        free = free & ~mine
    return out


def unmix_two(values: list[Column], first: tuple, second: tuple) -> tuple[Column, Column]:
    """Exact non-negative least squares for two directions, made unit vectors first."""
    one, two = (tuple(x / max(math.sqrt(sum(y * y for y in ray)), 1e-12) for x in ray) for ray in (first, second))
    g = sum(x * y for x, y in zip(one, two, strict=True))
    p, q = dot(values, one), dot(values, two)
    det = 1 - g * g
    # parallel directions share the amount, as the pseudo-inverse does
    a, b = ((p - g * q) / det, (q - g * p) / det) if det > 1e-15 else ((p + q) / 4, (p + q) / 4)
    zero = F.lit(0.0)
    tries = [(F.greatest(a, zero), F.greatest(b, zero)), (F.greatest(p, zero), zero), (zero, F.greatest(q, zero)), (zero, zero)]
    errors = []
    for x, y in tries:
        off = [x * F.lit(u) + y * F.lit(w) - v for u, w, v in zip(one, two, values, strict=True)]
        errors.append(off[0] * off[0] + off[1] * off[1] + off[2] * off[2])
    least = F.least(*errors)
    pick = lambda k: F.coalesce(*[F.when(e == least, t[k]) for e, t in zip(errors, tries, strict=True)])
    return pick(0), pick(1)


def luma(blue, green, red) -> Column:
    """Luma of 8-bit blue, green and red, rounded."""
    return F.round(0.114 * col(blue) + 0.587 * col(green) + 0.299 * col(red)).cast("int")


def bgr_hex(blue, green, red) -> Column:
    """#RRGGBB of rounded, clipped channels."""
    part = lambda x: F.lpad(F.hex(clip(F.rint(col(x)), 0.0, 255.0).cast("long")), 2, "0")
    return F.concat(F.lit("#"), part(red), part(green), part(blue))


def rebuilt(amounts: list[Column], rays: list[tuple], paper: list) -> list[Column]:
    """8-bit channels of paper under layers of ink: amounts below 0 count as 0."""
    layers = [F.greatest(a, F.lit(0.0)) for a in amounts]
    out = []
    for k, p in enumerate(paper):
        total = sum((a * F.lit(float(ray[k])) for a, ray in zip(layers[1:], rays[1:], strict=True)), layers[0] * F.lit(float(rays[0][k])))
        out.append(F.floor(to_srgb(to_linear(p) * F.pow(F.lit(10.0), -total))).cast("int"))
    return out
