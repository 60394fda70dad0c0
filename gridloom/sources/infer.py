"""Grids inferred from coordinates, and coordinates found in a dataset's metadata by the CF conventions."""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.crs import CRS, CRS_WGS84
from ..plans.grid import EARTH_RADIUS, TOLERANCE, GridMapping, edge, lon_360_column, number, pair, round_to_fraction

#: What marks a pair of coordinates as of a family, as (CRS kind, standard names, common names).
FAMILIES = (
    ("latitude_longitude", ("longitude", "latitude"), (("lon", "longitude"), ("lat", "latitude"))),
    ("rotated_latitude_longitude", ("grid_longitude", "grid_latitude"), (("rlon", "rlongitude"), ("rlat", "rlatitude"))),
    (None, ("projection_x_coordinate", "projection_y_coordinate"), (("x", "xc", "transformed_x"), ("y", "yc", "transformed_y"))),
)


def _close(values: np.ndarray, to: float, tolerance: float) -> bool:
    return bool(np.allclose(values, to, atol=tolerance))


def _box(x_ends: tuple[float, float], y_ends: tuple[float, float], res: tuple[float, float]) -> tuple[float, float, float, float]:
    (x0, x1), (y0, y1), (xr, yr) = x_ends, y_ends, res
    own = lambda v, r: edge(v, r, min(1e-5 * abs(v) / r, 0.01))  # noqa: E731  coordinates may have few digits
    return own(x0 - xr / 2, xr), own(y0 - yr / 2, yr), own(x1 + xr / 2, xr), own(y1 + yr / 2, yr)


def grid_from_axes(x: Sequence[float], y: Sequence[float], crs: CRS | str, *, xy_var_names: tuple[str, str] | None = None, xy_dim_names: tuple[str, str] | None = None, tile_size: Any = None, tolerance: float = TOLERANCE) -> GridMapping:
    """The grid of two coordinate vectors, regular if their steps are all the same."""
    if not (isinstance(tolerance, float) and tolerance > 0):
        raise ValueError("tolerance must be greater zero")
    crs = CRS.from_any(crs)
    if len(x) < 2 or len(y) < 2:
        raise ValueError("sizes of x_coords and y_coords 1D arrays must be >= 2")
    xs, ys = np.asarray(x, float), np.asarray(y, float)
    steps = lambda v: (lambda d: np.where(np.isclose(d, 0), np.nan, d))(np.abs(np.diff(v)))
    wide = bool(crs.is_geographic and (xs > 180).any())
    dx, dy = steps(xs), steps(ys)
    if crs.is_geographic and not wide and np.nanmax(dx) > 180:
        xs = np.where(xs < 0, xs + 360, xs)
        dx, wide = steps(xs), True
    regular = _close(dx, dx[0], tolerance) and _close(dy, dy[0], tolerance)
    res = tuple(float(round_to_fraction(float(d[0]), 5, 0.25) if regular else round_to_fraction(float(np.nanmedian(d)), 2, 0.5)) for d in (dx, dy))
    if not min(res) > 0:
        raise RuntimeError("internal error: x_res and y_res could not be determined")
    up = bool(ys[0] < ys[-1])
    res = (number(res[0]), number(res[1]))
    bbox = _box((xs[0], xs[-1]), (min(ys[0], ys[-1]), max(ys[0], ys[-1])), res)
    from ..plans.grid import default_names

    size = (len(xs), len(ys))
    return GridMapping(
        size, bbox, res, crs, pair(tile_size or size, "tile_size", int), xy_var_names or default_names(crs), xy_dim_names or xy_var_names or default_names(crs),
        is_regular=regular, is_lon_360=wide, is_j_axis_up=up, x_values=None if regular else tuple(xs), y_values=None if regular else tuple(ys),
    )


def grid_from_pixels(pixels: DataFrame, crs: CRS | str, *, xy_var_names: tuple[str, str] | None = None, xy_dim_names: tuple[str, str] = ("x", "y"), tile_size: Any = None, tolerance: float = TOLERANCE) -> GridMapping:
    """The grid of pixels (j, i, x, y) with coordinates of their own.

    One aggregate gives size and extremes and one gives the range of cell areas; only the pixels
    on the image's edge, whose number grows with its perimeter, come to the driver.
    """
    crs = CRS.from_any(crs)
    pixels = pixels.select(F.col("j").cast("long").alias("j"), F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    h, w, largest = pixels.agg(F.max("j") + 1, F.max("i") + 1, F.max(F.nanvl("x", F.lit(None).cast("double")))).first()
    if not h or h < 2 or w < 2:
        raise ValueError("invalid size")
    rim = pixels.where((F.col("j").isin(0, h - 1)) | (F.col("i").isin(0, w - 1))).toPandas()
    line = lambda axis, at, by: (lambda part: (part["x"].to_numpy(), part["y"].to_numpy()))(rim[rim[axis] == at].sort_values(by))
    top, bottom, left, right = line("j", 0, "i"), line("j", h - 1, "i"), line("i", 0, "j"), line("i", w - 1, "j")
    wide = bool(crs.is_geographic and largest is not None and largest > 180)
    steps = lambda v: np.nan_to_num(np.where(np.isclose(np.abs(np.diff(v)), 0), 0, np.abs(np.diff(v))))
    if crs.is_geographic and not wide and max(steps(top[0]).max(), steps(left[0]).max()) > 180:
        wide = True
        pixels = pixels.withColumn("x", lon_360_column(F.col("x")))
        top, bottom, left, right = ((np.where(a < 0, a + 360, a), b) for a, b in (top, bottom, left, right))
    xx, xy, yx, yy = steps(top[0]), steps(left[0]), steps(top[1]), steps(left[1])
    res: tuple[float, float] = (float(xx[0]), float(yy[0]))
    regular = _close(xx, res[0], tolerance) and _close(yy, res[1], tolerance) and _close(xy, 0, tolerance) and _close(yx, 0, tolerance)
    if not regular:
        res = (_estimated(pixels, w, h, crs),) * 2
    if not min(res) > 0:
        raise RuntimeError("internal error: x_res and y_res could not be determined")
    up = bool((top[1] < bottom[1]).all())
    res = (number(res[0]), number(res[1]))
    low, high = (top, bottom) if up else (bottom, top)
    bbox = _box((np.nanmin(left[0]), np.nanmax(right[0])), (np.nanmin(low[1]), np.nanmax(high[1])), res)
    from ..plans.grid import default_names

    return GridMapping(
        (int(w), int(h)), bbox, res, crs, pair(tile_size or (int(w), int(h)), "tile_size", int), xy_var_names or default_names(crs), xy_dim_names,
        is_regular=regular, is_lon_360=wide, is_j_axis_up=up, pixels=pixels,
    )


def _estimated(pixels: DataFrame, w: int, h: int, crs: CRS) -> float:
    """A resolution between the least and the largest edge length of cells of equal area."""
    by_row, by_col = Window.partitionBy("j").orderBy("i"), Window.partitionBy("i").orderBy("j")

    def step(c: str, window, last) -> Any:
        ahead, behind = F.lead(c).over(window) - F.col(c), F.col(c) - F.lag(c).over(window)
        return F.nanvl(F.abs(F.when(last, behind).otherwise(ahead)), F.lit(0.0))

    last_col, last_row = F.col("i") == w - 1, F.col("j") == h - 1
    d = pixels.select("j", "i", "x", "y", *(step(c, by_row, last_col).alias(f"{c}x") for c in "xy")).select("*", *(step(c, by_col, last_row).alias(f"{c}y") for c in "xy"))
    ex, ey = F.hypot("xx", "xy"), F.hypot("yx", "yy")
    if crs.is_geographic:
        ex, ey = F.lit(EARTH_RADIUS) * F.cos(F.radians(ex)) * F.radians(ey), F.lit(EARTH_RADIUS) * F.radians(ey)
    area = d.select((ex * ey).alias("a")).where("a > 0").agg(F.min("a"), F.max("a")).first()
    if area[0] is None:
        return 0.0
    edge = 0.7 * math.sqrt(area[0]) + 0.3 * math.sqrt(area[1])
    if crs.is_geographic:
        edge = math.degrees(edge / EARTH_RADIUS)
    return float(round_to_fraction(edge, 1, 0.5))


def xy_bbox_of(pixels: DataFrame) -> tuple[float, float, float, float]:
    """(x_min, y_min, x_max, y_max) of pixels' centres without regard to NaN; all NaN if there are none."""
    clean = {c: F.nanvl(c, F.lit(None).cast("double")) for c in "xy"}
    row = pixels.agg(F.min(clean["x"]), F.min(clean["y"]), F.max(clean["x"]), F.max(clean["y"])).first()
    return tuple(math.nan if v is None else v for v in row)  # type: ignore[return-value]


@dataclass(frozen=True)
class Variable:
    """What is known of a dataset's variable: its dimensions, attributes, and values of one dimension or chunk sizes."""

    dims: tuple[str, ...] = ()
    attrs: Mapping[str, Any] = field(default_factory=dict)
    values: Sequence[float] | None = None
    chunks: tuple[int, ...] | None = None
    size: int | None = None

    @property
    def count(self) -> int:
        return self.size if self.size is not None else len(self.values) if self.values is not None else 2


@dataclass(frozen=True)
class Dataset:
    """A dataset's variables and attributes; `pixels` holds (j, i, and a column for each variable of two dimensions)."""

    variables: Mapping[str, Variable]
    attrs: Mapping[str, Any] = field(default_factory=dict)
    pixels: DataFrame | None = None


@dataclass
class Found:
    """A reference system with the names of its coordinates."""

    crs: CRS
    kind: str | None
    x: str | None = None
    y: str | None = None


def _crs_of(attrs: Mapping[str, Any]) -> tuple[CRS, str | None] | None:
    if "grid_mapping_name" not in attrs:
        return None
    try:
        return CRS.from_any(attrs), attrs["grid_mapping_name"]
    except ValueError:
        return None


def coordinate_candidates(ds: Dataset) -> list[str]:
    """Variables of one or two dimensions that aren't bounds, those of the global attribute "coordinates" first."""
    bounds = {v.attrs["bounds"] for v in ds.variables.values() if v.attrs.get("bounds") in ds.variables}
    for name in ds.variables:
        base, _, suffix = name.rpartition("_")
        if suffix in ("bnds", "bounds") and base in ds.variables:
            bounds.add(name)
    fits = lambda n: n in ds.variables and len(ds.variables[n].dims) in (1, 2) and n not in bounds
    named = str(ds.attrs.get("coordinates", "")).split()
    return list(dict.fromkeys(n for n in (*named, *ds.variables) if fits(n)))


def find_grid_mappings(ds: Dataset, *, missing: Mapping[str | None, CRS] | None = None, emit_warnings: bool = False) -> dict[str | None, Found]:
    """The dataset's complete grid mappings by the variable that describes each (None if none does)."""
    systems: dict[str | None, Found] = {}
    for v in ds.variables.values():
        name = v.attrs.get("grid_mapping")
        if name in ds.variables and name not in systems:
            got = _crs_of(ds.variables[name].attrs)
            if got is None:
                raise ValueError(f"grid mapping variable {name!r} describes no known CRS")
            systems[name] = Found(*got)
    if not systems:
        own = next(((n, got) for n, v in ds.variables.items() if (got := _crs_of(v.attrs))), None)
        if own:
            systems[own[0]] = Found(*own[1])
        elif got := _crs_of(ds.attrs):
            systems[None] = Found(*got)

    names = coordinate_candidates(ds)
    coords: dict[str | None, list[str | None]] = {}
    for kind, standard, common in FAMILIES:
        ends: list[str | None] = [None, None]
        for k in (0, 1):
            ends[k] = next((n for n in names if ds.variables[n].attrs.get("standard_name") == standard[k]), None)
            ends[k] = ends[k] or next((n for n in names if n in common[k]), None)
        coords[kind] = ends
    for f in systems.values():
        f.x, f.y = coords[f.kind if f.kind in ("latitude_longitude", "rotated_latitude_longitude") else None]
    defaults: dict[str | None, CRS] = {"latitude_longitude": CRS_WGS84, **(missing or {})}
    for kind, ends in coords.items():
        if ends == [None, None]:
            continue
        match = next((f for f in systems.values() if kind is None or f.kind == kind), None)
        if match is None and kind in defaults:
            match = systems[None] = Found(defaults[kind], kind)
        if match is not None and match.x is None and match.y is None:
            match.x, match.y = ends
        elif match is not None and match.x is None:
            match.x = ends[0]

    out = {}
    for name, f in systems.items():
        x, y = ds.variables.get(f.x or ""), ds.variables.get(f.y or "")
        if x and y and x.count >= 2 and y.count >= 2 and len(x.dims) == len(y.dims):
            if len(x.dims) == 1 or x.dims == y.dims:
                out[name] = f
        elif emit_warnings:
            warnings.warn(f'CRS "{f.kind}": missing x- and/or y-coordinates (grid mapping variable "{name}": grid_mapping_name="{f.kind}")', stacklevel=2)
    return out


def chunk_sizes(ds: Dataset) -> dict[str, int]:
    """For each dimension the chunk size that most variables have."""
    seen: dict[str, list[int]] = {}
    for v in ds.variables.values():
        if v.chunks:
            for d, c in zip(v.dims, v.chunks, strict=True):
                seen.setdefault(d, []).append(c)
    return {d: max(sorted(set(c)), key=c.count) for d, c in seen.items()}


def grid_from_dataset(ds: Dataset, *, crs: CRS | str | None = None, tile_size: Any = None, prefer_is_regular: bool | None = True, prefer_crs: CRS | str | None = None, emit_warnings: bool = False, tolerance: float = TOLERANCE) -> GridMapping:
    """The grid mapping of a dataset; of several, the preferred one by system and then by regularity."""
    given = CRS.from_any(crs) if crs is not None else None
    missing = {k: given for k, _, _ in FAMILIES} if given else None
    found = list(find_grid_mappings(ds, missing=missing, emit_warnings=emit_warnings).values())
    chunks = chunk_sizes(ds)
    grids = []
    for f in found:
        x, y = ds.variables[f.x], ds.variables[f.y]  # type: ignore[index]
        dims = (x.dims[-1], y.dims[0])
        tiles = tile_size or ((chunks[dims[0]], chunks[dims[1]]) if dims[0] in chunks and dims[1] in chunks else None)
        options = {"xy_var_names": (f.x, f.y), "xy_dim_names": dims, "tile_size": tiles, "tolerance": tolerance}
        if len(x.dims) == 1:
            grids.append(grid_from_axes(x.values, y.values, f.crs, **options))  # type: ignore[arg-type]
        else:
            grids.append(grid_from_pixels(ds.pixels.select("j", "i", F.col(f.x).alias("x"), F.col(f.y).alias("y")), f.crs, **options))  # type: ignore[union-attr, arg-type]
    if not grids:
        raise ValueError("cannot find any grid mapping in dataset")
    wanted = CRS.from_any(prefer_crs) if prefer_crs is not None else None
    same = lambda g: wanted is not None and g.crs.equals(wanted)
    alike = lambda g: wanted is not None and g.crs.is_geographic and wanted.is_geographic
    shaped = lambda g: prefer_is_regular is not None and bool(g.is_regular) == prefer_is_regular
    for rule in (lambda g: same(g) and shaped(g), lambda g: alike(g) and shaped(g), same, alike, shaped):
        if best := next((g for g in grids if rule(g)), None):
            return best
    return grids[0]


def spatial_dims(ds: Dataset) -> tuple[str, str]:
    """The names of a dataset's spatial dimensions: lon and lat, or else x and y."""
    present = {d for v in ds.variables.values() for d in v.dims}
    for pair_ in (("lon", "lat"), ("x", "y")):
        if set(pair_) <= present:
            return pair_
    raise KeyError("No standard spatial dimensions found in dataset.")


def grid_mapping_name(ds: Dataset) -> str | None:
    """The one variable that describes the dataset's grid mapping, or None; several are an error."""
    names = {v.attrs["grid_mapping"] for v in ds.variables.values() if "grid_mapping" in v.attrs}
    names |= {n for n in ("crs", "spatial_ref") if n in ds.variables}
    if len(names) > 1:
        raise AssertionError(f"Multiple grid mapping names found: {sorted(names)}")
    return next(iter(names), None)


def normalized(ds: Dataset, grid: GridMapping) -> Dataset:
    """ds with its grid mapping told by one variable, spatial_ref, that all spatial variables name."""
    old = grid_mapping_name(ds)
    y_x = (grid.xy_dim_names[1], grid.xy_dim_names[0])
    kept = {
        n: Variable(v.dims, {**v.attrs, "grid_mapping": "spatial_ref"} if tuple(v.dims[-2:]) == y_x else dict(v.attrs), v.values, v.chunks, v.size)
        for n, v in ds.variables.items() if n != old
    }
    return Dataset({**kept, "spatial_ref": Variable((), grid.crs.to_cf())}, ds.attrs, ds.pixels)


def frame_from_dataset(ds: Dataset, grid: GridMapping | None = None, *, side: Mapping[str, DataFrame] | None = None) -> Any:
    """A GridFrame of ds's variables whose last dimensions are (y, x).

    Variables without spatial dimensions stand beside it, as far as `side` has their tables; those with one
    spatial dimension only, or with transposed ones, are left out.
    """
    from .frame import GridFrame

    grid = grid or grid_from_dataset(ds)
    y_x = (grid.xy_dim_names[1], grid.xy_dim_names[0])
    own = [n for n, v in ds.variables.items() if tuple(v.dims[-2:]) == y_x and n not in grid.xy_var_names]
    leading = tuple(dict.fromkeys(d for n in own for d in ds.variables[n].dims[:-2]))
    beside = {n: t for n, t in (side or {}).items() if n in ds.variables and not set(ds.variables[n].dims) & set(y_x)}
    return GridFrame.from_dataframe(ds.pixels, grid, variables=own, leading=leading, side=beside, attrs=ds.attrs)
