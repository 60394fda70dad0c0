"""Grid geometry: size, bounds, resolution, reference system, orientation and tiles of a raster.

A GridMapping lives on the driver and is never changed.  Regular grids carry no
coordinates; grids of explicit coordinates carry one-dimensional vectors, or a DataFrame
(j, i, x, y) where every pixel has its own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from fractions import Fraction
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .crs import CRS, project, project_bounds

BBox = tuple[float, float, float, float]
Matrix = tuple[tuple[float, float, float], tuple[float, float, float]]

#: Default tolerance of comparisons, and the mean radius of the Earth in metres.
TOLERANCE, EARTH_RADIUS = 1e-5, 6371000.0


def number(x: float, eps: float = 1e-5) -> float | int:
    """x as an int where it is one within a relative eps."""
    whole = round(x)
    return whole if x == whole or abs(x - whole) < eps * abs(x) else float(x)


def edge(x: float, res: float, share: float = 1e-6) -> float | int:
    """x as an int where it is one within a share of a pixel, so that large coordinates aren't moved by more than small ones."""
    whole = round(x)
    return whole if abs(x - whole) <= share * res else float(x)


def pair(value: Any, name: str, kind: type | tuple[type, ...] = (int, float)) -> tuple:
    """A value given once or twice, as two values."""
    both = (value, value) if isinstance(value, kind) and not isinstance(value, bool) else tuple(value)
    if len(both) != 2:
        raise ValueError(f"{name} must be a number or a pair of numbers")
    return both


def to_lon_360(x: float) -> float:
    """Longitudes below 0 moved into 180 to 360."""
    return x + 360 if x < 0 else x


def from_lon_360(x: float) -> float:
    """Longitudes over 180 moved into -180 to 0."""
    return x - 360 if x > 180 else x


def lon_360_column(x: Column) -> Column:
    return F.when(x < 0, x + 360).otherwise(x)


def lon_180_column(x: Column) -> Column:
    return F.when(x > 180, x - 360).otherwise(x)


def round_to_fraction(value: float, digits: int = 2, resolution: float = 1) -> Fraction:
    """value rounded, exactly, to significant digits of which the last comes in steps of the resolution."""
    steps = {0.1: Fraction(1, 10), 0.2: Fraction(1, 5), 0.25: Fraction(1, 4), 0.5: Fraction(1, 2), 1.0: Fraction(1)}
    if digits < 1:
        raise ValueError("digits must be a positive integer")
    step = next((s for r, s in steps.items() if math.isclose(r, resolution)), None)
    if step is None:
        raise ValueError(f"resolution must be one of {set(steps)}")
    if value == 0:
        return Fraction(0)
    unit = step * Fraction(10) ** (math.floor(math.log10(abs(value))) - digits + 1)
    return round(value / unit) * unit


def scale_size(size: tuple[int, int], x_scale: float, y_scale: float) -> tuple[int, int]:
    """A scaled size in whole pixels, two at least each way."""
    return max(2, round(x_scale * size[0])), max(2, round(y_scale * size[1]))


def _cut(size: int, tile: int) -> list[tuple[int, int]]:
    return [(a, min(a + tile, size)) for a in range(0, size, tile)]


@dataclass(frozen=True)
class GridMapping:
    """The geometry of a raster of `size` (width, height); `xy_bbox` are its outer edges."""

    size: tuple[int, int]
    xy_bbox: BBox
    xy_res: tuple[float, float]
    crs: CRS
    tile_size: tuple[int, int]
    xy_var_names: tuple[str, str]
    xy_dim_names: tuple[str, str]
    is_regular: bool | None = True
    is_lon_360: bool | None = False
    is_j_axis_up: bool | None = False
    x_values: tuple[float, ...] | None = field(default=None, compare=False, repr=False)
    y_values: tuple[float, ...] | None = field(default=None, compare=False, repr=False)
    pixels: DataFrame | None = field(default=None, compare=False, repr=False)

    def __post_init__(self) -> None:
        if min(self.size) < 2:
            raise ValueError("invalid size")
        if min(self.tile_size) < 2:
            raise ValueError("invalid tile_size")

    # -- making grids

    @staticmethod
    def regular(size: int | tuple[int, int], xy_min: tuple[float, float], xy_res: float | tuple[float, float], crs: CRS | str, *, tile_size: int | tuple[int, int] | None = None, is_j_axis_up: bool = False) -> GridMapping:
        """A regular grid of a size, anchored at its lower left corner."""
        width, height = pair(size, "size", int)
        if width < 2 or height < 2:
            raise ValueError("invalid size")
        x_res, y_res = pair(xy_res, "xy_res")
        if not (x_res > 0 and y_res > 0):
            raise ValueError("invalid xy_res")
        crs = CRS.from_any(crs)
        x0, y0 = (edge(v, r) for v, r in zip(pair(xy_min, "xy_min"), (x_res, y_res), strict=True))
        x1, y1 = edge(x0 + x_res * width, x_res), edge(y0 + y_res * height, y_res)
        if crs.is_geographic and y0 < -90:
            raise ValueError("invalid y_min")
        if crs.is_geographic and y1 > 90:
            raise ValueError("invalid size, y_min combination")
        names = default_names(crs)
        return GridMapping(
            (width, height), (x0, y0, x1, y1), (number(x_res, 1e-9 / width), number(y_res, 1e-9 / height)), crs, pair(tile_size or (width, height), "tile_size", int), names, names,
            is_lon_360=bool(x1 > 180 and crs.is_geographic), is_j_axis_up=is_j_axis_up,
        )

    def derive(self, *, xy_var_names: tuple[str, str] | None = None, xy_dim_names: tuple[str, str] | None = None, tile_size: int | tuple[int, int] | None = None, is_j_axis_up: bool | None = None) -> GridMapping:
        """This grid with some properties changed; turning the j axis reverses the rows' coordinates."""
        changes: dict[str, Any] = {}
        if xy_var_names:
            changes["xy_var_names"] = checked_names(xy_var_names, "xy_var_names")
        if xy_dim_names:
            changes["xy_dim_names"] = checked_names(xy_dim_names, "xy_dim_names")
        if tile_size is not None:
            changes["tile_size"] = pair(tile_size, "tile_size", int)
        if is_j_axis_up is not None and is_j_axis_up != self.is_j_axis_up:
            changes["is_j_axis_up"] = is_j_axis_up
            if self.y_values is not None:
                changes["y_values"] = self.y_values[::-1]
            if self.pixels is not None:
                changes["pixels"] = self.pixels.withColumn("j", F.lit(self.height - 1) - F.col("j"))
        return replace(self, **changes)

    def scale(self, xy_scale: float | tuple[float, float], tile_size: int | tuple[int, int] | None = None) -> GridMapping:
        """This regular grid with a scaled number of pixels over the same lower left corner."""
        self._assert_regular()
        xs, ys = pair(xy_scale, "xy_scale")
        size = scale_size(self.size, xs, ys)
        tiles = pair(tile_size, "tile_size", int) if tile_size is not None else self.tile_size
        return GridMapping.regular(
            size, (self.x_min, self.y_min), (self.x_res / xs, self.y_res / ys), self.crs,
            tile_size=(min(size[0], tiles[0]), min(size[1], tiles[1])), is_j_axis_up=bool(self.is_j_axis_up),
        ).derive(xy_var_names=self.xy_var_names, xy_dim_names=self.xy_dim_names)

    def to_regular(self, tile_size: int | tuple[int, int] | None = None, is_j_axis_up: bool = False) -> GridMapping:
        """A regular grid over this grid's bounds, with square pixels of its finer resolution and one pixel to spare."""
        if self.is_regular:
            if tile_size is None and is_j_axis_up == self.is_j_axis_up:
                return self
            return self.derive(tile_size=tile_size, is_j_axis_up=is_j_axis_up)
        res = min(self.xy_res) or max(self.xy_res)
        width, height = (max(2, round((high - low + res) / res)) for low, high in ((self.x_min, self.x_max), (self.y_min, self.y_max)))
        return GridMapping.regular((width, height), (self.x_min, self.y_min), res, self.crs, tile_size=tile_size or self.tile_size, is_j_axis_up=is_j_axis_up)

    def transform(self, crs: CRS | str, *, xy_res: float | tuple[float, float] | None = None, tile_size: int | tuple[int, int] | None = None, xy_var_names: tuple[str, str] | None = None, tolerance: float = TOLERANCE, spark: SparkSession | None = None) -> GridMapping:
        """This grid's pixel centres in another system, as a grid of explicit coordinates."""
        target = CRS.from_any(crs)
        if xy_var_names:
            checked_names(xy_var_names, "xy_var_names")
        if self.crs.equals(target):
            return self.derive(tile_size=tile_size, xy_var_names=xy_var_names) if tile_size is not None or xy_var_names else self
        moved = project(self.pixel_frame(spark), self.crs, target)
        names = xy_var_names or ("transformed_x", "transformed_y")
        tiles = tile_size if tile_size is not None else self.tile_size
        if xy_res is None:
            from ..sources.infer import grid_from_pixels

            return grid_from_pixels(moved, target, xy_var_names=names, xy_dim_names=self.xy_dim_names, tile_size=tiles, tolerance=tolerance)
        xr, yr = pair(xy_res, "xy_res")
        x0, y0, x1, y1 = project_bounds(self.crs, target, self.xy_bbox, 101)
        bbox = (x0 - xr / 2, y0 - yr / 2, x1 + xr / 2, y1 + yr / 2)
        return GridMapping(
            self.size, bbox, (number(xr), number(yr)), target, pair(tiles, "tile_size", int), names, self.xy_dim_names,
            is_regular=False, is_lon_360=bool(target.is_geographic and bbox[2] > 180), is_j_axis_up=self.is_j_axis_up, pixels=moved,
        )

    # -- properties

    width = property(lambda self: self.size[0])
    height = property(lambda self: self.size[1])
    tile_width = property(lambda self: self.tile_size[0])
    tile_height = property(lambda self: self.tile_size[1])
    is_tiled = property(lambda self: self.size != self.tile_size)
    x_min = property(lambda self: self.xy_bbox[0])
    y_min = property(lambda self: self.xy_bbox[1])
    x_max = property(lambda self: self.xy_bbox[2])
    y_max = property(lambda self: self.xy_bbox[3])
    x_res = property(lambda self: self.xy_res[0])
    y_res = property(lambda self: self.xy_res[1])
    spatial_unit_name = property(lambda self: self.crs.unit_name)
    ij_bbox = property(lambda self: (0, 0, self.width, self.height))

    @property
    def x_coords(self) -> tuple[float, ...]:
        """Pixel centres along x."""
        if self.x_values is not None:
            return self.x_values
        self._assert_regular()
        return tuple(self.x_min + self.x_res * (i + 0.5) for i in range(self.width))

    @property
    def y_coords(self) -> tuple[float, ...]:
        """Pixel centres along y, in the order of rows."""
        if self.y_values is not None:
            return self.y_values
        self._assert_regular()
        up = [self.y_min + self.y_res * (j + 0.5) for j in range(self.height)]
        return tuple(up if self.is_j_axis_up else reversed(up))

    def pixel_frame(self, spark: SparkSession | None = None) -> DataFrame:
        """(j, i, x, y) of all pixels."""
        if self.pixels is not None:
            return self.pixels
        spark = spark or SparkSession.active()
        cells = spark.range(self.width * self.height).select(F.expr(f"id div {self.width}").alias("j"), F.expr(f"id % {self.width}").alias("i"))
        if self.x_values is not None or self.y_values is not None:
            xs = spark.createDataFrame(list(enumerate(self.x_coords)), "i long, x double")
            ys = spark.createDataFrame(list(enumerate(self.y_coords)), "j long, y double")
            return cells.join(F.broadcast(xs), "i").join(F.broadcast(ys), "j").select("j", "i", "x", "y")
        return cells.select("j", "i", self.x_of("i").alias("x"), self.y_of("j").alias("y"))

    def x_of(self, i: str) -> Column:
        """The centre's x of column number i of a regular grid."""
        return F.lit(float(self.x_min)) + F.lit(float(self.x_res)) * (F.col(i) + F.lit(0.5))

    def y_of(self, j: str) -> Column:
        if self.is_j_axis_up:
            return F.lit(float(self.y_min)) + F.lit(float(self.y_res)) * (F.col(j) + F.lit(0.5))
        return F.lit(float(self.y_max)) - F.lit(float(self.y_res)) * (F.col(j) + F.lit(0.5))

    # -- index and coordinate algebra

    @property
    def ij_to_xy_transform(self) -> Matrix:
        """From pixel corners to coordinates."""
        self._assert_regular()
        if self.is_j_axis_up:
            return (self.x_res, 0.0, self.x_min), (0.0, self.y_res, self.y_min)
        return (self.x_res, 0.0, self.x_min), (0.0, -self.y_res, self.y_max)

    @property
    def xy_to_ij_transform(self) -> Matrix:
        return inverted(self.ij_to_xy_transform)

    def ij_transform_to(self, other: GridMapping) -> Matrix:
        """From this grid's indices to the other's."""
        other.assert_regular("other")
        return composed(other.xy_to_ij_transform, self.ij_to_xy_transform)

    def ij_transform_from(self, other: GridMapping) -> Matrix:
        """From the other grid's indices to this one's."""
        return inverted(self.ij_transform_to(other))

    @property
    def ij_bboxes(self) -> list[tuple[int, int, int, int]]:
        """Index boxes (i0, j0, i1, j1) of the tiles, row by row."""
        return [(i0, j0, i1, j1) for j0, j1 in _cut(self.height, self.tile_height) for i0, i1 in _cut(self.width, self.tile_width)]

    @property
    def xy_bboxes(self) -> list[BBox]:
        """Coordinate boxes of the tiles."""
        (a, _, c), (_, e, f) = self.ij_to_xy_transform if self.is_regular else (
            (self.x_res, 0.0, self.x_min), (0.0, self.y_res if self.is_j_axis_up else -self.y_res, self.y_min if self.is_j_axis_up else self.y_max)
        )
        out = []
        for i0, j0, i1, j1 in self.ij_bboxes:
            low, high = sorted((f + e * j0, f + e * j1))
            out.append((c + a * i0, low, c + a * i1, high))
        return out

    def ij_bbox_from_xy_bbox(self, xy_bbox: BBox, xy_border: float = 0.0, ij_border: int = 0) -> tuple[int, int, int, int]:
        """The least index box of the pixels whose centres are in the grown box; all -1 if there are none."""
        return self.ij_bboxes_from_xy_bboxes([xy_bbox], xy_border, ij_border)[0]

    def ij_bboxes_from_xy_bboxes(self, xy_bboxes: Sequence[BBox], xy_border: float = 0.0, ij_border: int = 0) -> list[tuple[int, int, int, int]]:
        """ij_bbox_from_xy_bbox for many boxes: by search along the axes, or by the windows of operators.windows; a single box by one aggregate over all pixels."""
        grown = [(x0 - xy_border, y0 - xy_border, x1 + xy_border, y1 + xy_border) for x0, y0, x1, y1 in xy_bboxes]
        if self.pixels is not None and len(grown) > 1:
            from ..operators.windows import ij_windows

            spark = self.pixels.sparkSession
            asked = spark.createDataFrame([(n, *map(float, b)) for n, b in enumerate(xy_bboxes)], "n int, x0 double, y0 double, x1 double, y1 double")
            rows = ij_windows(self, asked, xy_border=xy_border, ij_border=ij_border).select("n", "i0", "j0", "i1", "j1").collect()  # as many as were given
            return [tuple(r[1:]) for r in sorted(rows)]
        if self.pixels is not None:
            found = []
            for x0, y0, x1, y1 in grown:
                inside = F.col("x").between(x0, x1) & F.col("y").between(y0, y1)
                found.append(tuple(self.pixels.where(inside).agg(F.min("i"), F.min("j"), F.max("i"), F.max("j")).first()))
        else:
            found = []
            axes = [np.asarray(a, float) for a in (self.x_coords, self.y_coords)]
            for x0, y0, x1, y1 in grown:
                ii, jj = (np.flatnonzero((axis >= low) & (axis <= high)) for axis, low, high in ((axes[0], x0, x1), (axes[1], y0, y1)))
                found.append((int(ii[0]), int(jj[0]), int(ii[-1]), int(jj[-1])) if len(ii) and len(jj) else (None,) * 4)
        w, h, b = self.width, self.height, ij_border
        return [(-1, -1, -1, -1) if f[0] is None else (max(0, f[0] - b), max(0, f[1] - b), min(w, f[2] + 1 + b), min(h, f[3] + 1 + b)) for f in found]

    def to_coords(
        self, xy_var_names: tuple[str, str] | None = None, *, xy_dim_names: tuple[str, str] | None = None, reuse_coords: bool = False, exclude_bounds: bool = False, spark: SparkSession | None = None
    ) -> tuple[DataFrame, DataFrame]:
        """Axis coordinates as (i, <x>, <x>_bnds) and (j, <y>, <y>_bnds); longitudes lie between -180 and 180.

        With xy_dim_names the columns i and j have these names.  With reuse_coords a grid read from axes gives their own
        values, as they are and without bounds; other grids give computed ones.
        """
        spark = spark or SparkSession.active()
        x_name, y_name = checked_names(xy_var_names, "xy_var_names") if xy_var_names else self.xy_var_names
        across, down = checked_names(xy_dim_names, "xy_dim_names") if xy_dim_names else ("i", "j")
        kinds = ("longitude", "latitude") if self.crs.is_geographic else ("projection_x_coordinate", "projection_y_coordinate")
        told = [{"standard_name": kind} for kind in kinds]
        if reuse_coords and self.x_values is not None and self.y_values is not None:
            own = ((across, x_name, self.x_values, told[0]), (down, y_name, self.y_values, told[1]))
            frames = [spark.createDataFrame([(n, float(v)) for n, v in enumerate(values)], f"`{dim}` long, `{name}` double") for dim, name, values, _ in own]
            return tuple(df.withMetadata(name, meta) for df, (_, name, _, meta) in zip(frames, own, strict=True))
        wrap = lon_180_column if self.is_lon_360 else lambda c: c
        step = lambda axis, t, res, low, up: (F.lit(float(low)) + F.lit(float(res)) * (F.col(axis) + F.lit(t))) if up else (F.lit(float(low)) - F.lit(float(res)) * (F.col(axis) + F.lit(t)))
        up, y_from = bool(self.is_j_axis_up), self.y_min if self.is_j_axis_up else self.y_max
        x, y = spark.range(self.width).withColumnRenamed("id", across), spark.range(self.height).withColumnRenamed("id", down)
        x_at, y_at = (lambda t: wrap(step(across, t, self.x_res, self.x_min, True))), (lambda t: step(down, t, self.y_res, y_from, up))
        bounds = lambda at, name: [] if exclude_bounds else [F.array(at(0.0), at(1.0)).alias(f"{name}_bnds")]
        xs = x.select(across, x_at(0.5).alias(x_name, metadata=told[0]), *bounds(x_at, x_name))
        return xs, y.select(down, y_at(0.5).alias(y_name, metadata=told[1]), *bounds(y_at, y_name))

    # -- comparisons

    def is_close(self, other: GridMapping, tolerance: float = TOLERANCE) -> bool:
        """Whether the other grid has the same shape, tiles, system and orientation, and bounds within the tolerance."""
        if self is other:
            return True
        same = (self.is_j_axis_up, self.is_lon_360, self.is_regular, self.size, self.tile_size) == (other.is_j_axis_up, other.is_lon_360, other.is_regular, other.size, other.tile_size)
        near = lambda a, b: all(math.isclose(u, v, abs_tol=tolerance) for u, v in zip(a, b, strict=True))
        return same and self.crs.equals(other.crs) and near(self.xy_res, other.xy_res) and near(self.xy_bbox, other.xy_bbox)

    def assert_regular(self, name: str = "grid mapping") -> None:
        if not self.is_regular:
            raise ValueError(f"{name} must be a regular grid mapping")

    def _assert_regular(self) -> None:
        if not self.is_regular:
            raise NotImplementedError("Operation not implemented for non-regular grid mappings")


def inverted(m: Matrix) -> Matrix:
    (a, b, c), (d, e, f) = m
    det = a * e - b * d
    ia, ib, id_, ie = e / det, -b / det, -d / det, a / det
    return (ia, ib, -c * ia - f * ib), (id_, ie, -c * id_ - f * ie)


def composed(left: Matrix, right: Matrix) -> Matrix:
    """The map that applies right first."""
    (a, b, c), (d, e, f) = left
    (p, q, r), (s, t, u) = right
    return (a * p + b * s, a * q + b * t, a * r + b * u + c), (d * p + e * s, d * q + e * t, d * r + e * u + f)


def checked_names(names: Sequence[str], name: str) -> tuple[str, str]:
    if len(names) != 2 or not all(isinstance(n, str) and n for n in names) or names[0] == names[1]:
        raise ValueError(f"invalid {name}")
    return names[0], names[1]


def default_names(crs: CRS) -> tuple[str, str]:
    return ("lon", "lat") if crs.is_geographic else ("x", "y")
