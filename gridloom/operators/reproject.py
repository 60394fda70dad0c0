"""Reprojection: target pixel centres are taken into the source's reference system, and values gathered there.

A large target is looked at by tiles first, and by parts of those that are near: a few probes in and around each tell where it lies in the source, and
the centres of tiles that can't meet the source aren't worked out; their pixels are made in place, as filled.
"""

from __future__ import annotations

import math
from dataclasses import replace
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.crs import CRS, project, project_bounds
from ..plans.grid import GridMapping, scale_size
from ..plans.options import SCALE_LIMIT, downscale_methods, fill_of, method_of
from ..sources.frame import GridFrame, clip_by_bbox
from .affine import affine_transform_dataset
from .gather import gather

#: Rows and columns of a tile of target pixels, and of a part of a tile.  Probes are at a quarter's distance, from one before the tile to one behind it.
TILE, PART, PROBES = 64, 16, 7
#: An index beyond this lies in no source; target pixels of one task at most (about), and those for which it pays.
NOWHERE, MOST_PIXELS, LEAST_PIXELS = 1e12, 4_000_000, 100_000


def _pixel_extent(target: GridMapping, crs: CRS) -> tuple[float, float]:
    """The largest extents in another system of single pixels of a target: of those at its corners, edges and middle."""
    found = []
    for a in (0.0, 0.25, 0.5, 0.75, 1.0):
        for b in (0.0, 0.25, 0.5, 0.75, 1.0):
            x, y = target.x_min + a * (target.width - 1) * target.x_res, target.y_min + b * (target.height - 1) * target.y_res
            try:
                x0, y0, x1, y1 = project_bounds(target.crs, crs, (x, y, x + target.x_res, y + target.y_res), 1)
            except (ArithmeticError, ValueError):
                continue
            if math.isfinite(x1 - x0) and math.isfinite(y1 - y0):
                found.append((x1 - x0, y1 - y0))
    across, up = zip(*found or [(math.inf, math.inf)], strict=True)
    return max(across), max(up)


def _scaled_down(frame: GridFrame, target: GridMapping, interp_methods: Any, agg_methods: Any, recover_nans: Any) -> GridFrame:
    """A source that is finer than the target, clipped to the target's bounds and brought near its resolution."""
    grid = frame.grid
    x0, y0, x1, y1 = project_bounds(target.crs, grid.crs, target.xy_bbox)
    # The bounds of a long target that lies aslant are wider than its pixels together.
    x_res, y_res = (min(a, b) for a, b in zip(((x1 - x0) / target.width, (y1 - y0) / target.height), _pixel_extent(target, grid.crs), strict=True))
    polar = grid.crs.is_geographic and not target.crs.is_geographic and 90 in (-y0, y1)
    if polar:
        x_res = y_res  # around a pole, longitudes tell nothing of a pixel's width
    x_scale, y_scale = grid.x_res / x_res, grid.y_res / y_res
    if x_scale >= SCALE_LIMIT and y_scale >= SCALE_LIMIT:
        return frame
    dx, dy = 2 * grid.x_res, 2 * grid.y_res
    # A box across the source's seam needs columns of both sides.
    seam = grid.crs.is_geographic and (x0 < grid.x_min or x1 > grid.x_max)
    columns = (grid.x_min, grid.x_max) if seam else (x0 - dx, x1 + dx)
    frame = clip_by_bbox(frame, (columns[0], y0 - dy, columns[1], y1 + dy))
    grid = frame.grid
    size = scale_size(grid.size, x_scale, y_scale)
    if polar:  # no pixel reaches beyond the pole
        x_res, y_res = (grid.x_max - grid.x_min) / size[0], (grid.y_max - grid.y_min) / size[1]
    coarse = GridMapping.regular(size, (grid.x_min, grid.y_min), (x_res, y_res), grid.crs, tile_size=(min(size[0], grid.tile_width), min(size[1], grid.tile_height)))
    return affine_transform_dataset(frame, coarse, interp_methods=downscale_methods(interp_methods), agg_methods=agg_methods, recover_nans=recover_nans)


def reach(grid: GridMapping, target: GridMapping) -> tuple[list[int], list[list[int]]]:
    """The range of rows, and the ranges of columns, of a grid near a target's bounds."""
    x0, y0, x1, y1 = project_bounds(target.crs, grid.crs, target.xy_bbox)
    dx, dy = 2 * grid.x_res + 0.1 * (x1 - x0), 2 * grid.y_res + 0.1 * (y1 - y0)
    turns = (-360, 0, 360) if grid.crs.is_geographic else (0,)
    columns = [[math.floor((x + turn - grid.x_min) / grid.x_res) for x in (x0 - dx, x1 + dx)] for turn in turns]
    rows = [math.floor((grid.y_max - y) / grid.y_res) for y in (y1 + dy, y0 - dy)]
    return rows, [c for c in columns if c[1] >= 0 and c[0] < grid.width]


def _within(frame: GridFrame, target: GridMapping) -> GridFrame:
    """The frame's pixels near the target's bounds, by ranges of rows and columns that a scan can be told of."""
    rows, columns = reach(frame.grid, target)
    some = reduce(or_, (F.col("i").between(*c) for c in columns), F.lit(False))
    return replace(frame, df=frame.df.where(F.col("j").between(*rows) & some))


def target_indices(grid: GridMapping, target_gm: GridMapping, centres: DataFrame) -> DataFrame:
    """Target pixels (j, i, x, y, ...) as (j, i, sj, si, ...): where their centres lie in a regular grid of another system."""
    others = [c for c in centres.columns if c not in ("j", "i", "x", "y")]
    centres = project(centres, target_gm.crs, grid.crs)
    if grid.crs.is_geographic:
        # Longitudes count within half a turn of the source's middle, so that sources of 0 to 360 degrees are met too.
        middle = (grid.x_min + grid.x_max) / 2
        centres = centres.withColumn("x", F.col("x") - 360 * F.floor((F.col("x") - middle + 180) / 360))
    index = lambda c, low, res: (F.col(c) - F.lit(float(low))) / F.lit(float(res))
    row = index("y", grid.y_max - grid.y_res / 2, -grid.y_res)
    if grid.crs.is_geographic and grid.y_min <= -90:
        row = F.least(row, F.lit(grid.height - 0.5 - 1e-9))  # the pole itself lies in the last row
    return centres.select("j", "i", row.alias("sj"), index("x", grid.x_min + grid.x_res / 2, grid.x_res).alias("si"), *others)


def _told(grid: GridMapping, target: GridMapping, tiles: DataFrame, size: int) -> DataFrame:
    """Tiles (tj, ti) of this size as (tj, ti, size, near): whether one of a tile's pixels may lie in the grid.

    A tile is near if its probes' box, widened by half of its larger extent, meets the grid, or if only some of its probes have a place.
    Probes span six quarters of a tile and no pixel is further than 0.71 quarters from one, so that leaves room for a map that is four
    times as steep between probes as across them.  Probes around the tile tell seams and ends of a system that run through it.
    Tiles at the target's edge, which have no probes around, are always near.
    """
    step, c = size // 4, F.col
    edge = (c("tj") == 0) | (c("ti") == 0) | ((c("tj") + 1) * size + step >= target.height) | ((c("ti") + 1) * size + step >= target.width)
    probes = tiles.where(~edge).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(PROBES * PROBES - 1)))).select(
        "tj", "ti", (c("tj") * size + step * (F.expr(f"k div {PROBES}") - 1)).alias("j"), (c("ti") * size + step * (c("k") % PROBES - 1)).alias("i"))
    placed = target_indices(grid, target, probes.select("j", "i", target.x_of("i").alias("x"), target.y_of("j").alias("y"), "tj", "ti"))
    placed = placed.withColumn("told", (F.abs("sj") < NOWHERE) & (F.abs("si") < NOWHERE))
    ends = [f(F.when(c("told"), c(n))).alias(f"{n}{k}") for n in ("sj", "si") for k, f in ((0, F.min), (1, F.max))]
    boxes = placed.groupBy("tj", "ti").agg(F.count_if("told").alias("n"), *ends)
    x_res, y_res = float(grid.x_res), float(grid.y_res)
    wide = F.greatest((c("si1") - c("si0")) * x_res, (c("sj1") - c("sj0")) * y_res) / 2
    meets = lambda n, size, res: (c(f"{n}1") + wide / res + 2 >= 0) & (c(f"{n}0") - wide / res - 2 <= size)
    near = F.when(c("n") == PROBES * PROBES, meets("sj", grid.height, y_res) & meets("si", grid.width, x_res)).otherwise(c("n") > 0)
    return boxes.select("tj", "ti", F.lit(size).alias("size"), near.alias("near")).union(tiles.where(edge).select("tj", "ti", F.lit(size), F.lit(True)))


def split_targets(grid: GridMapping, target: GridMapping, spark: SparkSession) -> tuple[DataFrame, DataFrame | None]:
    """(j, i, sj, si) of the target's pixels that may lie in the grid, and (j, i) of the others, if there are any."""
    if min(target.width, target.height) < 3 * PART or target.pixels is not None or target.x_values is not None or target.y_values is not None:
        return target_indices(grid, target, target.pixel_frame(spark)), None
    # Tiles are few bytes of which many pixels come, so it's pixels that say how many tasks there are; dealt by another key than the aggregation's, whose tasks may be merged.
    count, across, each = target.width * target.height, -(-target.width // TILE), TILE // PART
    parts = max(count // MOST_PIXELS, min(int(spark.conf.get("spark.sql.shuffle.partitions")), count // LEAST_PIXELS), 1)
    tiles = spark.range(across * -(-target.height // TILE)).select(F.expr(f"id div {across}").alias("tj"), F.expr(f"id % {across}").alias("ti"))
    dealt = lambda df: df.repartition(parts, F.xxhash64("tj", "ti"))
    tiles = dealt(_told(grid, target, tiles, TILE))
    part = lambda t, size: F.explode(F.sequence(F.col(t) * each, F.least(F.col(t) * each + (each - 1), F.lit((size - 1) // PART)))).alias(t)
    inner = tiles.where("near").select("ti", part("tj", target.height)).select("tj", part("ti", target.width))
    tiles = dealt(tiles.where("NOT near").union(_told(grid, target, inner, PART)))
    line = lambda t, size: F.explode(F.sequence(F.col(t) * F.col("size"), F.least((F.col(t) + 1) * F.col("size"), F.lit(size)) - 1))
    pixels = lambda some: some.select("ti", "size", line("tj", target.height).alias("j")).select("j", line("ti", target.width).alias("i"))
    centres = pixels(tiles.where("near")).select("j", "i", target.x_of("i").alias("x"), target.y_of("j").alias("y"))
    return target_indices(grid, target, centres), pixels(tiles.where("NOT near"))


def reproject_dataset(source: GridFrame, target_gm: GridMapping, source_gm: GridMapping | None = None, *, variables: Any = None, interp_methods: Any = None, agg_methods: Any = None, recover_nans: Any = False, fill_values: Any = None) -> GridFrame:
    """A frame on a regular target grid of another reference system."""
    frame = source if source_gm is None else replace(source, grid=source_gm)
    frame.grid.assert_regular("source_gm")
    target_gm.assert_regular("target_gm")
    frame = frame.with_rows_up(False).select(variables)
    methods = {n: method_of(interp_methods, n, k) for n, k in frame.variables.items()}
    fills = {n: fill_of(fill_values, n, k) for n, k in frame.variables.items()}
    frame = _scaled_down(frame, target_gm, interp_methods, agg_methods, recover_nans)
    grid = frame.grid
    targets, beyond = split_targets(grid, target_gm, frame.df.sparkSession)
    df = gather(_within(frame, target_gm), targets, methods, fills, ties="even", high="ceil", truncate={n: m == "triangular" for n, m in methods.items()}, beyond=beyond)
    return replace(frame, df=df, grid=target_gm).with_spatial_ref()
