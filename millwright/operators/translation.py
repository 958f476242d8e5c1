"""Correlation of two masked images at every whole shift, from six sums over what both show.

Images are tables (image, y, x, v), a row a pixel that the mask keeps. The reference is cut into tiles; a pixel of
the moving image goes to each tile it may meet within the limit. A task holds one tile and its halo, whatever the
image's size, and gives six sums a shift, which add up over the tiles.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.operators.robust import join_groups

SUMS = ("n", "a", "aa", "b", "bb", "ab")
# fixed values: least common pixels, and their least share of the reference's
LEAST, SHARE = 1000, 0.30


def _tile(reference: pd.DataFrame, moving: pd.DataFrame, limit: int, tile: int) -> list[tuple]:
    """(dy, dx, sums) for each shift at which the tile's pixels meet any of the halo's."""
    wide = tile + 2 * limit
    a, ma, b, mb = np.zeros((tile, tile)), np.zeros((tile, tile)), np.zeros((wide, wide)), np.zeros((wide, wide))
    y, x = reference["y"].to_numpy() % tile, reference["x"].to_numpy() % tile
    a[y, x], ma[y, x] = reference["v"].to_numpy(), 1
    top, left = moving["_ty"].to_numpy() * tile - limit, moving["_tx"].to_numpy() * tile - limit
    y, x = moving["y"].to_numpy() - top, moving["x"].to_numpy() - left
    b[y, x], mb[y, x] = moving["v"].to_numpy(), 1
    aa, bb, out = a * a, b * b, []
    for dy in range(2 * limit + 1):
        for dx in range(2 * limit + 1):
            part, seen = b[dy : dy + tile, dx : dx + tile], mb[dy : dy + tile, dx : dx + tile]
            n = float((ma * seen).sum())
            if n:
                out.append((dy - limit, dx - limit, n, float((a * seen).sum()), float((aa * seen).sum()), float((part * ma).sum()), float((bb[dy : dy + tile, dx : dx + tile] * ma).sum()), float((a * part).sum())))
    return out


def surface(reference: DataFrame, moving: DataFrame, image: list[str], limit: int, least: float = LEAST, share: float = SHARE, tile: int = 64) -> DataFrame:
    """(image, dy, dx, overlap, score) for every shift up to ``limit`` either way: how moving (y + dy, x + dx) correlates
    with reference (y, x) over the pixels that both have.

    ``score`` is null below ``least`` common pixels or ``share`` of the reference's, and where either side is
    flat. Images missing on the moving side have overlap 0 throughout; images missing in the reference have no rows. Pixels with a
    null place or value are masked; a pixel given twice is the mean of its values. An empty reference gives no rows.
    """
    clean = lambda df: df.where(" and ".join(f"{c} is not null" for c in (*image, "y", "x", "v"))).groupBy(*image, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).agg(F.avg(F.col("v").cast("double")).alias("v"))
    ref, mov = clean(reference), clean(moving)
    keys = [*image, "_ty", "_tx"]
    ref_tiles = ref.withColumns({"_ty": F.floor(F.col("y") / tile), "_tx": F.floor(F.col("x") / tile)})
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - limit) / tile), F.floor((F.col(c) + limit) / tile)))
    mov_tiles = mov.withColumn("_ty", span("y")).withColumn("_tx", span("x"))
    mov_tiles = mov_tiles.toDF(*mov_tiles.columns)  # both sides may come from one table
    names = [*image, "dy", "dx", *SUMS]
    types = {f.name: f.dataType.simpleString() for f in ref.schema.fields}
    schema = ", ".join([f"`{k}` {types[k]}" for k in image] + ["dy int", "dx int"] + [f"{s} double" for s in SUMS])

    def work(key, one, two):
        rows = _tile(one, two, limit, tile) if len(one) and len(two) else []
        return pd.DataFrame([(*key[: len(image)], *r) for r in rows], columns=names)

    parts = ref_tiles.groupBy(*keys).cogroup(mov_tiles.groupBy(*keys)).applyInPandas(work, schema)
    told = parts.groupBy(*image, "dy", "dx").agg(*[F.sum(s).alias(s) for s in SUMS])
    sizes = ref.groupBy(*image).agg(F.count("*").alias("_size"))
    shifts = F.sequence(F.lit(-limit), F.lit(limit))
    grid = sizes.withColumn("dy", F.explode(shifts)).withColumn("dx", F.explode(shifts))
    met = grid.join(told, [*image, "dy", "dx"], "left")
    n, a, aa, b, bb, ab = (F.col(s) for s in SUMS)
    spread = F.sqrt(F.greatest(aa - a * a / n, F.lit(0.0)) * F.greatest(bb - b * b / n, F.lit(0.0)))
    good = (n >= F.greatest(F.lit(float(least)), share * F.col("_size"))) & (spread > 1e-12)
    return met.select(*image, "dy", "dx", F.coalesce(n, F.lit(0.0)).cast("long").alias("overlap"), F.when(good, (ab - a * b / n) / spread).alias("score"))


def best_shift(df: DataFrame, image: list[str]) -> DataFrame:
    """(image, dy, dx, overlap, score) of the highest score, of equal ones (to 9 digits) the shortest shift, then the least; null
    shifts where no shift has a score."""
    known = df.where("score is not null")
    rank = F.struct(-F.round("score", 9), F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx"), "dy", "dx")
    best = known.groupBy(*image).agg(F.min_by(F.struct("dy", "dx", "overlap", "score"), rank).alias("_b")).select(*image, "_b.*")
    return join_groups(df.select(*image).distinct(), best, image, "left")
