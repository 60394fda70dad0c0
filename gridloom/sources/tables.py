"""Reading and writing pixel tables, and the reference system kept with them."""

from __future__ import annotations

import json
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.crs import CRS
from ..plans.grid import GridMapping
from .frame import GridFrame

#: The column metadata keys in which a table carries its geometry and number kinds.
GRID_KEY, KIND_KEY = "grid", "dtype"


def _described(grid: GridMapping) -> dict[str, Any]:
    keys = ("size", "xy_bbox", "xy_res", "tile_size", "xy_var_names", "xy_dim_names", "is_regular", "is_lon_360", "is_j_axis_up", "x_values", "y_values")
    return {k: getattr(grid, k) for k in keys} | {"crs": grid.crs.to_cf(), "crs_name": grid.crs.name}


def _restored(told: dict[str, Any], pixels: DataFrame | None) -> GridMapping:
    crs = CRS.from_any(told.pop("crs_name")) if told["crs_name"].startswith(("EPSG", "OGC")) else CRS.from_any(told["crs"])
    told.pop("crs", None)
    told.pop("crs_name", None)
    fixed = {k: tuple(v) if isinstance(v, list) else v for k, v in told.items()}
    return GridMapping(crs=crs, pixels=pixels, **fixed)


def add_spatial_ref(df: DataFrame, grid: GridMapping, *, column: str = "j") -> DataFrame:
    """df with the grid's geometry and reference system in the metadata of a column; parquet files keep it."""
    return df.withMetadata(column, {GRID_KEY: json.dumps(_described(grid))})


#: Zones that a written table is parted into at most, each a folder; a zone is a square of tiles.
ZONES = 1024


def _spread(v: Column) -> Column:
    """The lower 16 bits of v, with a bit's room between each two."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _zone_of(row: int, column: int) -> int:
    return sum((row >> b & 1) << 2 * b + 1 | (column >> b & 1) << 2 * b for b in range(16))


def zone_side(grid: GridMapping) -> int:
    """Tiles along a zone's side: the least power of two that leaves few enough zones."""
    down, across, side = -(-grid.height // grid.tile_height), -(-grid.width // grid.tile_width), 1
    while -(-down // side) * -(-across // side) > ZONES:
        side *= 2
    return side


def write_frame(frame: GridFrame, path: str, *, tiles: bool = True) -> None:
    """Writes a frame as parquet, clustered along both axes: zones of tiles are folders, and files hold ranges of tiles in the order of a space-filling curve.

    No row of tiles, and no tile, has to be in one task.  Pixels of a grid with coordinates of their own are kept as columns x and y.
    """
    df = frame.df
    if frame.grid.pixels is not None:
        df = df.join(frame.grid.pixels, ["j", "i"])
    for n, kind in frame.variables.items():
        df = df.withMetadata(n, {KIND_KEY: kind})
    df = add_spatial_ref(df, frame.grid)
    if not tiles:
        df.write.parquet(path)
        return
    side = zone_side(frame.grid)
    tile = lambda axis, size: F.expr(f"CAST({axis} div {size} AS bigint)")
    curve = lambda step: _spread(tile("j", frame.grid.tile_height * step)) * 2 + _spread(tile("i", frame.grid.tile_width * step))
    placed = df.withColumns({"zone": curve(side).cast("int"), "_tile": curve(1)})
    order = ["zone", "_tile", "j", "i"]
    placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tile").write.partitionBy("zone").parquet(path)


def read_frame(spark: SparkSession, path: str, *, leading: tuple[str, ...] = (), window: tuple[int, int, int, int] | None = None) -> GridFrame:
    """A frame written by write_frame; of a window (i0, j0, i1, j1; ends excluded) only the pixels in it, in their places, from its zones' files."""
    df = spark.read.parquet(path)
    told = json.loads(df.schema["j"].metadata[GRID_KEY])
    grid = _restored(told, None)
    if window is not None:
        i0, j0, i1, j1 = window
        if "zone" in df.columns:
            step = zone_side(grid)
            rows, columns = (range(max(a, 0) // (size * step), (b - 1) // (size * step) + 1) for a, b, size in ((j0, min(j1, grid.height), grid.tile_height), (i0, min(i1, grid.width), grid.tile_width)))
            df = df.where(F.col("zone").isin([_zone_of(r, c) for r in rows for c in columns]))
        df = df.where(F.col("j").between(j0, j1 - 1) & F.col("i").between(i0, i1 - 1))
    df = df.drop("zone")
    if {"x", "y"} <= set(df.columns):
        grid = replace(grid, pixels=df.select("j", "i", "x", "y").distinct())
    return GridFrame.from_dataframe(df, grid, leading=leading)
