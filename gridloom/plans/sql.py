"""The engine in SQL: a frame's pixels, grid and tiles as views, and the reference systems as functions of columns."""

from __future__ import annotations

from ..operators.tiles import tile_frame
from ..sources.frame import GridFrame
from .crs import CRS, sql_of, transformation


def register(frame: GridFrame, name: str) -> None:
    """Makes the views <name> (j, i, variables), <name>_grid (j, i, x, y) and <name>_tiles."""
    frame.df.createOrReplaceTempView(name)
    frame.grid.pixel_frame(frame.df.sparkSession).createOrReplaceTempView(f"{name}_grid")
    if frame.grid.is_regular:
        tile_frame(frame.grid, frame.df.sparkSession).createOrReplaceTempView(f"{name}_tiles")


def projection_sql(source: CRS | str, target: CRS | str, table: str) -> str:
    """A query that takes columns x, y of a table from one system to the other; it runs in Spark and in DuckDB.

    Spark spells the exclusion of columns EXCEPT and DuckDB EXCLUDE; this is DuckDB's form.
    """
    return sql_of(transformation(CRS.from_any(source), CRS.from_any(target)), table)
