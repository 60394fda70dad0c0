"""Rectification: rasters whose pixels have coordinates of their own, brought onto a regular grid.

Four neighbouring pixels form a quad of two triangles.  Each quad offers itself to the target
pixels in its bounds; those whose centre lies in a triangle get their fractional source
index from it, and of several quads the first one in row order counts.  Quads come from one
aggregation of pixels by corner, candidates from generated ranges, and the first quad from
one aggregation with partial minima: no join compares ranges.  Where the target doesn't hold the whole
swath, an index of the source's blocks says first which of them can meet it; only their pixels make quads, and
only their rows and columns are read.
"""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.crs import project
from ..plans.grid import GridMapping, scale_size
from ..plans.options import SCALE_LIMIT, UV_DELTA, downscale_methods, fill_of, method_of
from ..sources.frame import GridFrame
from .affine import resample
from .gather import gather, spread
from .windows import BLOCK, met_pixels

#: Candidates in one band of rows of a quad; larger quads are cut into bands before candidates are made.
BAND_ROWS = 64


def quads(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(qj, qi, x0..x3, y0..y3): corners (j, i), (j, i + 1), (j + 1, i), (j + 1, i + 1) of each quad."""
    offers = F.array(*(F.struct(F.lit(k).alias("k"), (F.col("j") - dj).alias("qj"), (F.col("i") - di).alias("qi")) for k, (dj, di) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1)))))
    given = pixels.select("x", "y", F.explode(offers).alias("o")).select("x", "y", "o.*")
    given = given.where(F.col("qj").between(0, height - 2) & F.col("qi").between(0, width - 2))
    corner = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}")
    return given.groupBy("qj", "qi").agg(*(corner(c, k) for c in "xy" for k in range(4)))


def _cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def window_of(grid: GridMapping, target: GridMapping, block: int = BLOCK) -> tuple[DataFrame, tuple[int, int, int, int] | None]:
    """The grid's pixels that the target can meet, and their window (i0, j0, i1, j1), ends included; the whole grid where the target holds most of it."""
    pixels = grid.pixel_frame()
    # A triangle reaches up to UV_DELTA of its sides beyond its corners: less than a pixel of either grid.
    dx, dy = (float(max(a, b)) for a, b in zip(grid.xy_res, target.xy_res, strict=True))
    box = (target.x_min - dx, target.y_min - dy, target.x_max + dx, target.y_max + dy)
    across, up = (min(box[k + 2], grid.xy_bbox[k + 2]) - max(box[k], grid.xy_bbox[k]) for k in (0, 1))
    # An index of blocks pays where it spares at least as many pixels as it reads.
    if across > 0 and up > 0 and 2 * across * up >= (grid.x_max - grid.x_min) * (grid.y_max - grid.y_min):
        return pixels, (0, 0, grid.width, grid.height)
    return met_pixels(pixels, box, block)


def source_indices(grid: GridMapping, target: GridMapping, delta: float = UV_DELTA, pixels: DataFrame | None = None) -> DataFrame:
    """(j, i, sj, si) of those target pixels that lie in a triangle of the grid's pixels (or of some of them)."""
    x_from, y_from = float(target.x_min), float(target.y_min if target.is_j_axis_up else target.y_max)
    x_step, y_step = float(target.x_res), float(target.y_res if target.is_j_axis_up else -target.y_res)
    c = F.col
    q = quads(grid.pixel_frame() if pixels is None else pixels, grid.width, grid.height)
    cell = lambda v, low, step: F.floor((v - F.lit(low)) / F.lit(step)).cast("long")
    missing = lambda k: F.isnan(c(f"x{k}")) | F.isnan(c(f"y{k}")) | c(f"x{k}").isNull() | c(f"y{k}").isNull()
    q = q.withColumns({f"m{k}": missing(k) for k in range(4)}).withColumns({"a_whole": ~(c("m0") | c("m1") | c("m2")), "b_whole": ~(c("m3") | c("m1") | c("m2"))})
    # A triangle without one of its corners meets nothing: the range is that of the others.
    counts = {0: c("a_whole"), 3: c("b_whole"), 1: c("a_whole") | c("b_whole"), 2: c("a_whole") | c("b_whole")}
    ends = lambda f, axis: f(*(F.when(counts[k], c(f"{axis}{k}")) for k in range(4)))
    i_ends = [cell(ends(f, "x"), x_from, x_step) for f in (F.least, F.greatest)]
    j_ends = [cell(ends(f, "y"), y_from, y_step) for f in (F.least, F.greatest)]
    q = q.where("a_whole OR b_whole").withColumns({
        "ia": F.greatest(F.least(*i_ends), F.lit(0)), "ib": F.least(F.greatest(*i_ends), F.lit(target.width - 1)),
        "ja": F.greatest(F.least(*j_ends), F.lit(0)), "jb": F.least(F.greatest(*j_ends), F.lit(target.height - 1)),
    }).where("ia <= ib AND ja <= jb")
    det = lambda o, u, v: F.nanvl(_cross(c(f"x{u}") - c(f"x{o}"), c(f"y{u}") - c(f"y{o}"), c(f"x{v}") - c(f"x{o}"), c(f"y{v}") - c(f"y{o}")), F.lit(0.0))
    q = q.withColumns({"da": det(0, 1, 2), "db": det(3, 2, 1)}).where("da <> 0 OR db <> 0")
    bands = q.withColumn("band", F.explode(F.sequence(F.expr(f"ja div {BAND_ROWS}"), F.expr(f"jb div {BAND_ROWS}"))))
    rows = bands.withColumn("j", F.explode(F.sequence(F.greatest("ja", c("band") * BAND_ROWS), F.least("jb", c("band") * BAND_ROWS + (BAND_ROWS - 1)))))
    cells = rows.withColumn("i", F.explode(F.sequence("ia", "ib"))).withColumns({"px": F.lit(x_from) + (c("i") + 0.5) * x_step, "py": F.lit(y_from) + (c("j") + 0.5) * y_step})

    def within(o: int, u: int, v: int, d: str) -> tuple[Column, Column, Column]:
        """Fractions along the sides from corner o to u and to v, and whether they are in the triangle."""
        dx, dy = c("px") - c(f"x{o}"), c("py") - c(f"y{o}")
        det_ = F.nullif(c(d), F.lit(0.0))
        fu = _cross(dx, dy, c(f"x{v}") - c(f"x{o}"), c(f"y{v}") - c(f"y{o}")) / det_
        fv = _cross(c(f"x{u}") - c(f"x{o}"), c(f"y{u}") - c(f"y{o}"), dx, dy) / det_
        hit = (fu >= -delta) & (fv >= -delta) & (fu + fv <= 1 + 2 * delta)
        return F.greatest(F.least(fu, F.lit(1.0)), F.lit(0.0)), F.greatest(F.least(fv, F.lit(1.0)), F.lit(0.0)), F.coalesce(hit & ~F.isnan(fu) & ~F.isnan(fv), F.lit(False))

    (au, av, a_hit), (bu, bv, b_hit) = within(0, 1, 2, "da"), within(3, 2, 1, "db")
    hits = cells.select(
        "qj", "qi", "j", "i",
        F.when(a_hit, c("qj") + av).when(b_hit, c("qj") + 1 - bv).alias("sj"), F.when(a_hit, c("qi") + au).when(b_hit, c("qi") + 1 - bu).alias("si"),
    ).where("sj IS NOT NULL")
    first = hits.groupBy("j", "i").agg(F.min(F.struct("qj", "qi", "sj", "si")).alias("s"))
    return first.select("j", "i", "s.sj", "s.si")


def _scaled_down(frame: GridFrame, target: GridMapping, interp_methods: Any, agg_methods: Any, recover_nans: Any) -> GridFrame:
    """A source that is finer than the target, brought near its resolution together with its coordinates."""
    grid = frame.grid
    x_scale, y_scale = grid.x_res / target.x_res, grid.y_res / target.y_res
    if x_scale >= SCALE_LIMIT and y_scale >= SCALE_LIMIT:
        return frame
    from ..sources.infer import grid_from_pixels

    size, matrix = scale_size(grid.size, x_scale, y_scale), ((1 / x_scale, 0.0, 0.0), (0.0, 1 / y_scale, 0.0))
    methods = downscale_methods(interp_methods)
    df = resample(frame, matrix, size, interp_methods=methods, agg_methods=agg_methods, recover_nans=recover_nans)
    places = GridFrame(grid.pixel_frame(frame.df.sparkSession).select("j", "i", "x", "y"), grid, {"x": "float64", "y": "float64"})
    own = lambda option: option if not isinstance(option, dict) else None
    pixels = resample(places, matrix, size, interp_methods=own(methods), agg_methods=own(agg_methods), recover_nans=own(recover_nans) or False)
    tiles = (min(size[0], grid.tile_width), min(size[1], grid.tile_height))
    return replace(frame, df=df, grid=grid_from_pixels(pixels, grid.crs, xy_var_names=grid.xy_var_names, xy_dim_names=grid.xy_dim_names, tile_size=tiles))


def rectify_dataset(source: GridFrame, target_gm: GridMapping | None = None, source_gm: GridMapping | None = None, *, variables: Any = None, interp_methods: Any = None, agg_methods: Any = None, recover_nans: Any = False, fill_values: Any = None, tile_size: Any = None) -> GridFrame:
    """A frame on a regular target grid; by default one made from the source's own bounds and resolution."""
    from ..sources.infer import grid_from_pixels

    frame = source if source_gm is None else replace(source, grid=source_gm)
    target = target_gm or frame.grid.to_regular(tile_size=tile_size)
    target.assert_regular("target_gm")
    grid = frame.grid
    if not grid.crs.agrees(target.crs):
        names = ("lon", "lat") if target.crs.is_geographic else ("transformed_x", "transformed_y")
        moved = project(grid.pixel_frame(frame.df.sparkSession), grid.crs, target.crs)
        frame = replace(frame, grid=grid_from_pixels(moved, target.crs, xy_var_names=names, xy_dim_names=grid.xy_dim_names, tile_size=grid.tile_size))
    frame = frame.select(variables)
    methods = {n: method_of(interp_methods, n, k) for n, k in frame.variables.items()}
    fills = {n: fill_of(fill_values, n, k) for n, k in frame.variables.items()}
    frame = _scaled_down(frame, target, interp_methods, agg_methods, recover_nans)
    pixels, window = window_of(frame.grid, target)
    indices = source_indices(frame.grid, target, pixels=pixels)
    if window is not None and window != (0, 0, *frame.grid.size):
        i0, j0, i1, j1 = window
        frame = replace(frame, df=frame.df.where(F.col("j").between(j0, j1) & F.col("i").between(i0, i1)))
    # Only target pixels in a triangle are joined; the others, whose number may grow with the square of the swath's length, are filled in last.
    df = gather(frame, indices, methods, fills, ties="low", high="next", truncate={n: True for n in methods})
    df = spread(frame, df, target.size, fills)
    return replace(frame, df=df, grid=target).with_spatial_ref()
