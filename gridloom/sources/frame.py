"""GridFrame: a raster as a pixel table with the geometry of its grid.

The table has one row for each pixel (leading dimensions such as time first, then the
row j and the column i) and one column for each variable.  NaN is the missing value of floating
variables; a pixel without a row counts as missing.  Variables without spatial dimensions
stand beside the table and pass through every operation.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.grid import GridMapping

#: Spark types by the kind of number that a column holds; unsigned kinds are widened.
SPARK_TYPES = {
    "float32": "float", "float64": "double", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint",
    "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "bool": "double",
}
_KINDS = {T.FloatType: "float32", T.DoubleType: "float64", T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64", T.BooleanType: "bool", T.DecimalType: "float64"}


def kind_of(entry: T.StructField) -> str:
    """A column's number kind: its metadata's "dtype", or what its type says."""
    return entry.metadata.get("dtype") if entry.metadata and "dtype" in entry.metadata else _KINDS[type(entry.dataType)]


@dataclass(frozen=True)
class GridFrame:
    """A pixel table, its grid, and the kinds of its variables."""

    df: DataFrame
    grid: GridMapping
    variables: Mapping[str, str]
    leading: tuple[str, ...] = ()
    side: Mapping[str, DataFrame] = field(default_factory=dict)
    attrs: Mapping[str, Any] = field(default_factory=dict)

    @staticmethod
    def from_dataframe(df: DataFrame, grid: GridMapping, *, leading: Iterable[str] = (), variables: Iterable[str] | None = None, kinds: Mapping[str, str] | None = None, side: Mapping[str, DataFrame] | None = None, attrs: Mapping[str, Any] | None = None) -> GridFrame:
        """A frame of df's columns j, i, leading ones and variables (all others that hold numbers, by default)."""
        lead = tuple(leading)
        numbers = (T.NumericType, T.BooleanType)
        names = list(variables) if variables is not None else [f.name for f in df.schema if f.name not in (*lead, "j", "i", "x", "y") and isinstance(f.dataType, numbers)]
        own = {n: (kinds or {}).get(n) or kind_of(df.schema[n]) for n in names}
        columns = [F.col(n).cast("double").alias(n) if own[n] == "bool" else F.col(n) for n in names]
        table = df.select(*lead, F.col("j").cast("long").alias("j"), F.col("i").cast("long").alias("i"), *columns)
        return GridFrame(table, grid, own, lead, dict(side or {}), dict(attrs or {}))

    def select(self, variables: str | Iterable[str] | None) -> GridFrame:
        """The frame with some of its variables; None stands for all."""
        if variables is None:
            return self
        names = [variables] if isinstance(variables, str) else list(variables)
        for n in names:
            if n not in self.variables and n not in self.side:
                raise KeyError(n)
        return replace(
            self, df=self.df.select(*self.leading, "j", "i", *(n for n in names if n in self.variables)),
            variables={n: k for n, k in self.variables.items() if n in names}, side={n: d for n, d in self.side.items() if n in names},
        )

    def with_rows_up(self, up: bool) -> GridFrame:
        """The frame with rows counted the other way if need be."""
        if bool(self.grid.is_j_axis_up) == up:
            return self
        return replace(self, df=self.df.withColumn("j", F.lit(self.grid.height - 1) - F.col("j")), grid=self.grid.derive(is_j_axis_up=up))

    def with_spatial_ref(self, name: str = "spatial_ref") -> GridFrame:
        """The frame with its reference system told in attributes, and named by each variable."""
        kept = {k: v for k, v in self.attrs.items() if k not in (self.attrs.get("grid_mapping"), "grid_mapping")}
        return replace(self, attrs={**kept, name: self.grid.crs.to_cf(), "grid_mapping": name})

    def image(self, variable: str) -> list:
        """The whole image of one variable as nested lists, for small frames: rows, or leading values and rows."""
        import numpy as np

        rows = self.df.select(*self.leading, "j", "i", variable).toPandas()
        shape = (self.grid.height, self.grid.width)

        def plane(part) -> list:
            out = np.full(shape, np.nan)
            out[part["j"].astype(int), part["i"].astype(int)] = part[variable].astype(float)
            return out.tolist()

        if not self.leading:
            return plane(rows)
        return [plane(part) for _, part in sorted(rows.groupby(list(self.leading)), key=lambda x: x[0])]


def clip_by_bbox(frame: GridFrame, bbox: tuple[float, float, float, float]) -> GridFrame:
    """The pixels whose centres lie in a box, both ends included, numbered from 0; an empty result is logged."""
    from ..plans.options import LOG

    if len(bbox) != 4:
        raise ValueError("bbox must have 4 values: x_min, y_min, x_max, y_max")
    grid = frame.grid
    i0, j0, i1, j1 = grid.ij_bbox_from_xy_bbox(bbox)
    if i0 < 0:
        LOG.warning("Clipped dataset contains at least one zero-sized dimension.")
        return replace(frame, df=frame.df.limit(0))
    df = frame.df.where(F.col("j").between(j0, j1 - 1) & F.col("i").between(i0, i1 - 1))
    df = df.withColumns({"j": F.col("j") - j0, "i": F.col("i") - i0})
    if i1 - i0 < 2 or j1 - j0 < 2:
        return replace(frame, df=df)
    if grid.pixels is not None:
        pixels = grid.pixels.where(F.col("j").between(j0, j1 - 1) & F.col("i").between(i0, i1 - 1)).withColumns({"j": F.col("j") - j0, "i": F.col("i") - i0})
        new = replace(grid, size=(i1 - i0, j1 - j0), tile_size=(min(grid.tile_width, i1 - i0), min(grid.tile_height, j1 - j0)), pixels=pixels)
        return replace(frame, df=df, grid=new)
    low_j = j0 if grid.is_j_axis_up else grid.height - j1
    box = (grid.x_min + grid.x_res * i0, grid.y_min + grid.y_res * low_j, grid.x_min + grid.x_res * i1, grid.y_min + grid.y_res * (low_j + j1 - j0))
    cut = lambda v, a, b: None if v is None else v[a:b]
    new = replace(grid, size=(i1 - i0, j1 - j0), tile_size=(min(grid.tile_width, i1 - i0), min(grid.tile_height, j1 - j0)), xy_bbox=box, x_values=cut(grid.x_values, i0, i1), y_values=cut(grid.y_values, j0, j1))
    return replace(frame, df=df, grid=new)
