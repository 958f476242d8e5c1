"""Affine maps, quadrilaterals and planes as Column expressions.

A map is six columns a, b, tx, c, d, ty: x' = a x + b y + tx, y' = c x + d y + ty.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from millwright.functions.scalar import col, decompose, lines_meet

PARTS = ("a", "b", "tx", "c", "d", "ty")


def apply_affine(m: dict, x, y) -> tuple[Column, Column]:
    a, b, tx, c, d, ty = (col(m[k]) for k in PARTS)
    return a * col(x) + b * col(y) + tx, c * col(x) + d * col(y) + ty


def rigid_scaled(scale_x, scale_y, degrees) -> dict[str, Column]:
    """The linear part of a rotation after scaling along the axes."""
    turn = F.radians(col(degrees))
    return {"a": F.cos(turn) * col(scale_x), "b": -F.sin(turn) * col(scale_y), "c": F.sin(turn) * col(scale_x), "d": F.cos(turn) * col(scale_y)}


def without_shear(m: dict) -> dict[str, Column]:
    """The map with its shear dropped: scales, rotation and shift stay."""
    p = decompose(*(m[k] for k in "abcd"))
    return rigid_scaled(p["scale_x"], p["scale_y"], p["rotation_deg"]) | {"tx": col(m["tx"]), "ty": col(m["ty"])}


def quad_of_lines(lines: dict[str, tuple]) -> dict[str, tuple[Column, Column]]:
    """Corners of four lines (x1, y1, x2, y2) named top, right, bottom, left; null unless all four corners exist."""
    corners = {f"{h}_{v}": lines_meet(*lines[h], *lines[v]) for h, v in (("top", "left"), ("top", "right"), ("bottom", "right"), ("bottom", "left"))}
    whole = F.lit(True)
    for x, _ in corners.values():
        whole = whole & x.isNotNull()
    return {k: (F.when(whole, x), F.when(whole, y)) for k, (x, y) in corners.items()}


def quad_angle(q: dict) -> Column:
    """Angle in degrees of a quadrilateral's two horizontal edges together."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = (q[k] for k in ("top_left", "top_right", "bottom_right", "bottom_left"))
    return F.degrees(F.atan2((by - ay) + (cy - dy), (bx - ax) + (cx - dx)))


def quad_size(q: dict) -> tuple[Column, Column]:
    """Mean width and mean height of a quadrilateral."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = (q[k] for k in ("top_left", "top_right", "bottom_right", "bottom_left"))
    return (F.hypot(bx - ax, by - ay) + F.hypot(cx - dx, cy - dy)) / 2, (F.hypot(dx - ax, dy - ay) + F.hypot(cx - bx, cy - by)) / 2


def solve3(m: list[list], v: list) -> list[Column]:
    """Three unknowns by Cramer's rule; null if the determinant is 0."""

    def det(r):
        return r[0][0] * (r[1][1] * r[2][2] - r[1][2] * r[2][1]) - r[0][1] * (r[1][0] * r[2][2] - r[1][2] * r[2][0]) + r[0][2] * (r[1][0] * r[2][1] - r[1][1] * r[2][0])

    full = det(m)
    swapped = [[[v[i] if j == k else m[i][j] for j in range(3)] for i in range(3)] for k in range(3)]
    return [F.when(full != 0, det(s) / full) for s in swapped]
