"""Windows: which pixels of a grid lie in boxes of coordinates, and which blocks of a swath a target can meet.

Pixels with coordinates of their own are summed up in blocks, by one aggregate with partial extremes: the
block index.  Boxes meet blocks by equal cells of lattices, from one about as large as a block upwards by twos: each box on that where it covers
two cells each way at most, so a large box is in as few cells as a small one.  A pair is counted in one of the cells it shares only.  Blocks inside a box give their window at once; blocks that a box cuts are joined with their parts, and parts that it cuts with their pixels, by
number.  So a box never meets the pixels in its inside, and no join compares ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.grid import GridMapping
from .tiles import tile_frame

#: Rows and columns of a block, and rows of a table up to which it is broadcast to a join.
BLOCK, FEW = 64, 100_000
#: Rows and columns of the parts of a block that a box cuts.
PART = 8

_BOX = ["x0", "y0", "x1", "y1"]
_WINDOW = ["i0", "j0", "i1", "j1"]


def _finite(pixels: DataFrame) -> DataFrame:
    return pixels.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")


def block_index(pixels: DataFrame, size: int = BLOCK, *, quads: bool = False) -> DataFrame:
    """(bj, bi, x0, y0, x1, y1, i0, j0, i1, j1): extremes of the pixels (j, i, x, y) with coordinates in each block, and where they are.

    With quads, a block also holds the next row and column, and so all corners of the quads that begin in it.
    """
    number = lambda axis, back: F.expr(f"(greatest({axis} - {back}, 0)) div {size}")
    held = [F.struct(number("j", dj).alias("bj"), number("i", di).alias("bi")) for dj, di in (((0, 0), (0, 1), (1, 0), (1, 1)) if quads else ((0, 0),))]
    df = _finite(pixels).select("j", "i", "x", "y", F.explode(F.array_distinct(F.array(*held))).alias("b")).select("j", "i", "x", "y", "b.*")
    ends = [f(c).alias(f"{c}{k}") for k, f in ((0, F.min), (1, F.max)) for c in "xyij"]
    return df.groupBy("bj", "bi").agg(*ends).select("bj", "bi", *_BOX, *_WINDOW)


def few_or_merged(df: DataFrame) -> DataFrame:
    """A side of a join, broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= FEW else df.hint("merge")


def met_pixels(pixels: DataFrame, box: tuple[float, float, float, float], size: int = BLOCK) -> tuple[DataFrame, tuple[int, int, int, int] | None]:
    """Those pixels whose blocks of quads reach into a box, and the window (i0, j0, i1, j1), ends included, around them; None if there are none."""
    x0, y0, x1, y1 = (F.lit(float(v)) for v in box)
    met = block_index(pixels, size, quads=True).where((F.col("x0") <= x1) & (F.col("x1") >= x0) & (F.col("y0") <= y1) & (F.col("y1") >= y0))
    # One row comes back, whatever the number of blocks.
    i0, j0, i1, j1, rows = met.agg(F.min("bi") * size, F.min("bj") * size, (F.max("bi") + 1) * size, (F.max("bj") + 1) * size, F.count("*")).first()
    if not rows:
        return pixels.limit(0), None
    within = F.col("j").between(j0, j1) & F.col("i").between(i0, i1)
    return pixels.where(within).withColumns({"_bj": F.expr(f"j div {size}"), "_bi": F.expr(f"i div {size}")}).join(
        few_or_merged(_with_next(met.select("bj", "bi"))), F.expr("_bj = bj AND _bi = bi"), "left_semi"
    ).drop("_bj", "_bi"), (i0, j0, i1, j1)


def _with_next(blocks: DataFrame) -> DataFrame:
    """Blocks and those below and to the right, whose first rows and columns their quads end in."""
    near = F.array(*(F.struct((F.col("bj") + dj).alias("bj"), (F.col("bi") + di).alias("bi")) for dj in (0, 1) for di in (0, 1)))
    return blocks.select(F.explode(near).alias("b")).select("b.*").distinct()


def _grown(boxes: DataFrame, border: float) -> DataFrame:
    ends = boxes.select(*(F.col(c).cast("double").alias(f"_{c}") for c in _BOX)).distinct()
    return ends.where(" AND ".join(f"NOT isnan(_{c}) AND _{c} IS NOT NULL" for c in _BOX)).select(
        *(f"_{c}" for c in _BOX), *((F.col(f"_{c}") + (border if c[1] == "1" else -border)).alias(c) for c in _BOX)
    )


def _along(low: Column, high: Column, start: float, step: float, count: int) -> tuple[Column, Column]:
    """The first and last of the numbers k of centres start + step * (k + 1/2) between low and high."""
    centre = lambda k: F.lit(float(start)) + F.lit(float(step)) * (k + F.lit(0.5))
    near = lambda v: F.greatest(F.least(F.floor((v - F.lit(float(start))) / F.lit(float(step)) - 0.5), F.lit(float(count))), F.lit(-2.0)).cast("long")
    a, b = near(low), near(high)
    # Rounding may put the guess one off; the centres themselves decide.
    first = F.when(centre(a - 1) >= low, a - 1).when(centre(a) >= low, a).when(centre(a + 1) >= low, a + 1).otherwise(a + 2)
    last = F.when(centre(b + 2) <= high, b + 2).when(centre(b + 1) <= high, b + 1).when(centre(b) <= high, b).otherwise(b - 1)
    return F.greatest(first, F.lit(0)), F.least(last, F.lit(count - 1))


def _regular_windows(grid: GridMapping, grown: DataFrame) -> DataFrame:
    i0, i1 = _along(F.col("x0"), F.col("x1"), grid.x_min, grid.x_res, grid.width)
    if grid.is_j_axis_up:
        j0, j1 = _along(F.col("y0"), F.col("y1"), grid.y_min, grid.y_res, grid.height)
    else:
        j0, j1 = _along(-F.col("y1"), -F.col("y0"), -grid.y_max, grid.y_res, grid.height)
    return grown.select(*(f"_{c}" for c in _BOX), i0.alias("i0"), j0.alias("j0"), i1.alias("i1"), j1.alias("j1")).where("i0 <= i1 AND j0 <= j1")


def _pixel_windows(pixels: DataFrame, grown: DataFrame, size: int) -> DataFrame:
    blocks = block_index(pixels, size)
    # One row: the lattice's bounds and the blocks' mean extent.
    x_low, y_low, x_high, y_high, dx, dy = blocks.agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1"), F.avg(F.col("x1") - F.col("x0")), F.avg(F.col("y1") - F.col("y0"))).first()
    if x_low is None:
        return grown.select(*(f"_{c}" for c in _BOX), *(F.lit(0).cast("long").alias(c) for c in _WINDOW)).limit(0)
    # A box is put on the level of the lattice on which it covers two cells each way at most; blocks are on all levels that boxes are on.
    step = lambda mean, low, high: max(mean, (high - low) / 65536) or 1.0  # noqa: E731  no more than 65536 cells each way
    sx, sy = step(dx, x_low, x_high), step(dy, y_low, y_high)
    held = lambda v, low, high: F.greatest(F.least(v, F.lit(high)), F.lit(low)) - F.lit(low)
    cx = lambda v: F.floor(held(v, x_low, x_high) / (F.lit(sx) * F.pow(F.lit(2.0), "level"))).cast("int")
    cy = lambda v: F.floor(held(v, y_low, y_high) / (F.lit(sy) * F.pow(F.lit(2.0), "level"))).cast("int")

    def in_cells(df: DataFrame) -> DataFrame:
        return df.withColumn("cx", F.explode(F.sequence(cx(F.col("x0")), cx(F.col("x1"))))).withColumn("cy", F.explode(F.sequence(cy(F.col("y0")), cy(F.col("y1")))))

    asked = grown.where(F.expr(f"x0 <= x1 AND y0 <= y1 AND x1 >= {x_low!r} AND x0 <= {x_high!r} AND y1 >= {y_low!r} AND y0 <= {y_high!r}"))
    extent = F.greatest((held(F.col("x1"), x_low, x_high) - held(F.col("x0"), x_low, x_high)) / sx, (held(F.col("y1"), y_low, y_high) - held(F.col("y0"), y_low, y_high)) / sy)
    asked = asked.withColumn("level", F.ceil(F.log2(F.greatest(extent, F.lit(1.0)))).cast("int"))
    levels = asked.select("level").distinct()
    own = in_cells(blocks.crossJoin(F.broadcast(levels))).select("level", "cx", "cy", "bj", "bi", *_WINDOW, *(F.col(c).alias(f"b{c}") for c in _BOX))
    met = in_cells(asked).join(few_or_merged(own), ["level", "cx", "cy"]).where("x0 <= bx1 AND bx0 <= x1 AND y0 <= by1 AND by0 <= y1")
    met = met.where((F.col("cx") == cx(F.greatest("x0", "bx0"))) & (F.col("cy") == cy(F.greatest("y0", "by0"))))
    inside = F.expr("x0 <= bx0 AND bx1 <= x1 AND y0 <= by0 AND by1 <= y1")
    keys = [f"_{c}" for c in _BOX]
    whole = met.where(inside).select(*keys, *_WINDOW)
    cut = met.where(~inside).select(*keys, *_BOX, "bj", "bi")
    if size % PART == 0 and size > PART:
        # A cut block's parts come before its pixels: a box's edge cuts few of them.
        parts = block_index(pixels, PART).select(F.expr(f"bj div {size // PART}").alias("bj"), F.expr(f"bi div {size // PART}").alias("bi"), F.col("bj").alias("pj"), F.col("bi").alias("pi"), *_WINDOW, *(F.col(c).alias(f"b{c}") for c in _BOX))
        partly = parts.join(cut, ["bj", "bi"]).where("x0 <= bx1 AND bx0 <= x1 AND y0 <= by1 AND by0 <= y1")
        whole = whole.union(partly.where(inside).select(*keys, *_WINDOW))
        cut, size = partly.where(~inside).select(*keys, *_BOX, F.col("pj").alias("bj"), F.col("pi").alias("bi")), PART
    single = _finite(pixels).select("j", "i", "x", "y", F.expr(f"j div {size}").alias("bj"), F.expr(f"i div {size}").alias("bi"))
    hits = single.join(cut, ["bj", "bi"]).where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1").select(*keys, F.col("i").alias("i0"), F.col("j").alias("j0"), F.col("i").alias("i1"), F.col("j").alias("j1"))
    return whole.union(hits).groupBy(*keys).agg(F.min("i0").alias("i0"), F.min("j0").alias("j0"), F.max("i1").alias("i1"), F.max("j1").alias("j1"))


def ij_windows(grid: GridMapping, boxes: DataFrame, *, xy_border: float = 0.0, ij_border: int = 0, block: int = BLOCK) -> DataFrame:
    """boxes (x0, y0, x1, y1, ...) with i0, j0, i1, j1: the least window of the pixels whose centres are in the grown box, i1 and j1 excluded; all -1 if there are none.

    Columns of the windows' names are replaced.
    """
    boxes = boxes.drop(*_WINDOW)
    grown = _grown(boxes, float(xy_border))
    found = _regular_windows(grid, grown) if grid.is_regular and grid.pixels is None else _pixel_windows(grid.pixel_frame(boxes.sparkSession), grown, block)
    met = boxes.join(found, [F.col(c).cast("double") == F.col(f"_{c}") for c in _BOX], "left")
    end = {"i0": F.greatest(F.lit(0), F.col("i0") - ij_border), "j0": F.greatest(F.lit(0), F.col("j0") - ij_border), "i1": F.least(F.lit(grid.width), F.col("i1") + 1 + ij_border), "j1": F.least(F.lit(grid.height), F.col("j1") + 1 + ij_border)}
    return met.select(*boxes.columns, *(F.when(F.col("i0").isNull(), F.lit(-1)).otherwise(v).cast("long").alias(c) for c, v in end.items()))


def source_windows(grid: GridMapping, target: GridMapping, *, xy_border: float | None = None, ij_border: int = 1, spark: SparkSession | None = None) -> DataFrame:
    """(tile_id, i0, j0, i1, j1): for each tile of the target the window of the grid's pixels in and around it; all -1 if there are none."""
    spark = spark or SparkSession.active()
    border = 2.0 * max(*map(float, grid.xy_res), *map(float, target.xy_res)) if xy_border is None else xy_border
    tiles = tile_frame(target, spark).select("tile_id", *_BOX)
    return ij_windows(grid, tiles, xy_border=border, ij_border=ij_border).select("tile_id", *_WINDOW)
