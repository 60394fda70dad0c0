"""Tiles: the blocks of a grid as rows, functions over whole blocks, and coarsening by windows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.selection import reduced
from ..plans.grid import GridMapping
from ..plans.options import reducer_of
from ..sources.frame import SPARK_TYPES, GridFrame


def tile_frame(grid: GridMapping, spark: SparkSession | None = None) -> DataFrame:
    """(tile_id, i0, j0, i1, j1, x0, y0, x1, y1) of a grid's tiles, made by arithmetic on their numbers."""
    spark = spark or SparkSession.active()
    across, down = -(-grid.width // grid.tile_width), -(-grid.height // grid.tile_height)
    t = spark.range(across * down).withColumnRenamed("id", "tile_id")
    t = t.withColumns({"i0": F.expr(f"tile_id % {across} * {grid.tile_width}"), "j0": F.expr(f"tile_id div {across} * {grid.tile_height}")})
    t = t.withColumns({"i1": F.least(F.col("i0") + grid.tile_width, F.lit(grid.width)), "j1": F.least(F.col("j0") + grid.tile_height, F.lit(grid.height))})
    x = lambda c: F.lit(float(grid.x_min)) + F.lit(float(grid.x_res)) * F.col(c)
    if grid.is_j_axis_up:
        y0, y1 = (F.lit(float(grid.y_min)) + F.lit(float(grid.y_res)) * F.col(c) for c in ("j0", "j1"))
    else:
        y0, y1 = (F.lit(float(grid.y_max)) - F.lit(float(grid.y_res)) * F.col(c) for c in ("j1", "j0"))
    return t.select("tile_id", "i0", "j0", "i1", "j1", x("i0").alias("x0"), y0.alias("y0"), x("i1").alias("x1"), y1.alias("y1"))


def compute_from_blocks(grid: GridMapping, func: Callable[..., np.ndarray], name: str = "v", dtype: str = "float64", args: tuple[Any, ...] = (), spark: SparkSession | None = None) -> DataFrame:
    """(j, i, <name>): values that func(block, *args) gives for each tile.

    block is a dict of the tile's id, index (row and column of tiles), shape and slices.  Only here do
    blocks go through Python, as functions of this kind can't be told in columns.
    """
    across = -(-grid.width // grid.tile_width)

    def run(frames):
        import pandas as pd

        for frame in frames:
            for r in frame.itertuples(index=False):
                block = {
                    "block_id": r.tile_id, "block_index": (r.tile_id // across, r.tile_id % across), "block_shape": (r.j1 - r.j0, r.i1 - r.i0),
                    "block_slices": ((r.j0, r.j1), (r.i0, r.i1)), "dtype": dtype, "name": name,
                }
                values = np.asarray(func(block, *args), dtype=dtype)
                jj, ii = np.mgrid[r.j0 : r.j1, r.i0 : r.i1]
                yield pd.DataFrame({"j": jj.ravel(), "i": ii.ravel(), name: values.ravel()})

    tiles = tile_frame(grid, spark)
    return tiles.repartition(tiles.sparkSession.sparkContext.defaultParallelism, "tile_id").mapInPandas(run, f"j long, i long, {name} {SPARK_TYPES[dtype]}")


def coarsen(frame: GridFrame, rows: int, cols: int, agg_methods: Any = None) -> DataFrame:
    """(leading..., j, i, variables) of windows of rows x cols pixels; windows that aren't whole are left out."""
    whole = frame.df.where((F.col("j") < frame.grid.height // rows * rows) & (F.col("i") < frame.grid.width // cols * cols))
    cell = whole.withColumns({"tj": F.expr(f"j div {rows}"), "ti": F.expr(f"i div {cols}"), "wj": F.col("j") % rows, "wi": F.col("i") % cols})
    keyed = cell.drop("j", "i").withColumnsRenamed({"tj": "j", "ti": "i"})
    return reduced(keyed, [*frame.leading, "j", "i"], frame.variables, {n: reducer_of(agg_methods, n, k) for n, k in frame.variables.items()}, rows, cols)
