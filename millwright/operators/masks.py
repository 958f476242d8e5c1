"""Connected components of pixel masks: runs of rows, links between runs of neighbouring rows, contracted labels.

A mask is a table (image, y, x, on), a row a pixel. Rows become runs (image, y, x0, x1, on); an image of any size
is many rows, never one. Runs of one colour that touch in neighbouring rows are linked, found by joining on the
row and on spans of columns. A component's label is its first pixel in reading order.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millwright.store import Cut

#: Columns that two runs are compared within; bounds the pairs a join looks at.
SPAN = 64


def runs(mask: DataFrame, image: list[str], y: str = "y", x: str = "x", on: str = "on") -> DataFrame:
    """(image, y, x0, x1, on): the runs of both colours. Pixels with a null place don't count, null colours are off;
    a pixel given twice is on if either is. Missing pixels end a run and belong to no colour."""
    told = mask.where(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(*image, F.col(y).cast("long").alias("y"), F.col(x).cast("long").alias("x")).agg(F.coalesce(F.bool_or(on), F.lit(False)).alias("on"))
    island = F.col("x") - F.row_number().over(Window.partitionBy(*image, "y", "on").orderBy("x"))
    return told.withColumn("_i", island).groupBy(*image, "y", "on", "_i").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).select(*image, "y", "x0", "x1", "on")


def merged(df: DataFrame, image: list[str]) -> DataFrame:
    """Runs again, after some have changed colour: neighbours of one colour are joined."""
    w = Window.partitionBy(*image, "y").orderBy("x0")
    new = ~((F.lag("on").over(w) == F.col("on")) & (F.lag("x1").over(w) + 1 == F.col("x0")))
    told = df.withColumn("_n", F.coalesce(new, F.lit(True)).cast("int")).withColumn("_g", F.sum("_n").over(w))
    return told.groupBy(*image, "y", "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.first("on").alias("on")).select(*image, "y", "x0", "x1", "on")


def pixels(df: DataFrame, image: list[str]) -> DataFrame:
    """(image, y, x, on) of runs."""
    return df.select(*image, "y", F.explode(F.sequence("x0", "x1")).alias("x"), "on")


def contracted(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, label): the least node that each node of ``edges`` (keys, a, b) reaches, itself included.

    Alternating steps hang every node's larger neighbours, then its smaller ones, on the least of them, until only
    stars are left: a number of steps that grows with the logarithm of the longest way. Each
    step is two minima and two joins, written to the shared folder. Nodes sort as their type does.
    """
    given = edges.where(F.col("a") != F.col("b")).select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    held, before = Cut(given, "links"), None
    while True:
        e = held.df
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return e.select(*keys, F.col("a").alias("node"), F.col("b").alias("label"))
        before = state
        both = e.unionByName(e.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*keys, "a").agg(F.min("b").alias("m")).select(*keys, "a", F.least("a", "m").alias("m"))
        large = both.join(low, [*keys, "a"]).where(F.col("b") > F.col("a")).select(*keys, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        small = large.join(down, [*keys, "a"]).select(*keys, F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = Cut(small.unionByName(down.select(*keys, "a", F.col("m").alias("b"))).distinct(), "links")
        held.drop(shuffles=False)
        held = after


def links(df: DataFrame, image: list[str], diagonal: bool) -> DataFrame:
    """(image, on, a, b): runs of one colour in neighbouring rows that share a column, or with ``diagonal`` a corner; ends
    are (y, x0)."""
    reach = 1 if diagonal else 0
    spans = lambda a, b: F.explode(F.sequence(F.floor(a / SPAN), F.floor(b / SPAN)))
    above = df.select(*image, "on", "y", F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), spans(F.col("x0") - reach, F.col("x1") + reach).alias("_s"))
    below = df.select(*image, "on", (F.col("y") - 1).alias("y"), "x0", "x1", spans(F.col("x0"), F.col("x1")).alias("_s"))
    at = F.greatest(F.col("x0"), F.col("_x0") - reach)
    # a pair that meets in several spans counts in the one where it first does
    met = above.join(below, [*image, "on", "y", "_s"]).where((F.col("x0") <= F.col("_x1") + reach) & (F.col("_x0") - reach <= F.col("x1")) & (F.floor(at / SPAN) == F.col("_s")))
    return met.select(*image, "on", F.struct(F.col("y").alias("y"), F.col("_x0").alias("x")).alias("a"), F.struct((F.col("y") + 1).alias("y"), F.col("x0").alias("x")).alias("b"))


def labelled(df: DataFrame, image: list[str], diagonal: bool = True) -> DataFrame:
    """Runs with ``label``, the (y, x) of their component's first pixel. Components are of one image and one colour."""
    keys = [*image, "on"]
    told = contracted(links(df, image, diagonal), keys)
    own = df.withColumn("node", F.struct(F.col("y"), F.col("x0").alias("x")))
    return own.join(told, [*keys, "node"], "left").select(*df.columns, F.coalesce("label", "node").alias("label"))


def components(df: DataFrame, image: list[str], diagonal: bool = True) -> DataFrame:
    """(image, on, label, area, top, bottom, left, right) of each component of runs."""
    size = F.sum(F.col("x1") - F.col("x0") + 1)
    return labelled(df, image, diagonal).groupBy(*image, "on", "label").agg(size.alias("area"), F.min("y").alias("top"), F.max("y").alias("bottom"), F.min("x0").alias("left"), F.max("x1").alias("right"))


def _flip(df: DataFrame, image: list[str], which: DataFrame, diagonal: bool) -> DataFrame:
    """Runs whose component is in ``which`` (image, on, label) change colour."""
    marked = which.select(*image, "on", "label", F.lit(True).alias("_flip"))
    told = labelled(df, image, diagonal).join(marked, [*image, "on", "label"], "left")
    return merged(told.withColumn("on", F.col("on") != F.coalesce("_flip", F.lit(False))).select(*df.columns), image)


def drop_small(df: DataFrame, image: list[str], least: int, on: bool = True) -> DataFrame:
    """Runs without the components of colour ``on`` that have fewer than ``least`` pixels; 8-neighbourhood."""
    small = components(df, image).where((F.col("on") == on) & (F.col("area") < least))
    return _flip(df, image, small, True)


def area_filtered(df: DataFrame, image: list[str], least: int) -> DataFrame:
    """Specks go first, then pinholes of what is left; borders of the rest don't move."""
    return drop_small(drop_small(df, image, least), image, least, on=False)


def interior_connected(df: DataFrame, image: list[str], rows: int = 3) -> DataFrame:
    """Only the components that reach the last ``rows`` rows of their image stay; all do where none reaches them."""
    last = df.groupBy(*image).agg(F.max("y").alias("_last"))
    told = components(df, image).where("on").join(last, image).withColumn("_in", F.col("bottom") > F.col("_last") - rows)
    some = told.groupBy(*image).agg(F.bool_or("_in").alias("_some"))
    return _flip(df, image, told.join(some, image).where("_some and not _in"), True)


def filled(df: DataFrame, image: list[str]) -> DataFrame:
    """Holes become on: off components, by 4-neighbourhood, that don't reach their image's first row."""
    first = df.groupBy(*image).agg(F.min("y").alias("_first"))
    holes = components(df, image, diagonal=False).where("not on").join(first, image).where(F.col("top") > F.col("_first"))
    return _flip(df, image, holes, False)
