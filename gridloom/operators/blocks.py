"""Blocks: rasters kept as one row a tile, with an array of pixels for each variable, and gathering from them.

A block holds its tile's pixels row by row, and with them the next row and column, so that all corners around a fractional index
lie in the block of the upper left one.  A target pixel therefore meets one row, by its block's
number, and picks its values by place in the arrays: it is moved once, where a table of pixels is asked up to five times, and
comes out without being brought together again; and source pixels are moved as values without
their numbers.  Rows of blocks suit images that are resampled often; all else works on pixels, from which
blocks are made by one aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.grid import GridMapping
from ..plans.options import SCALE_LIMIT, fill_of, method_of
from ..sources.frame import SPARK_TYPES, GridFrame
from .affine import SNAP, affine_transform_dataset, leading_values
from .gather import outputs, parted, places
from .reproject import _scaled_down, reach, split_targets

#: Rows and columns of a block, where none are given.
SIZE = (64, 64)


@dataclass(frozen=True)
class BlockFrame:
    """A table (leading..., tj, ti, variables): blocks of `size` (columns, rows) pixels, and one row and column more, as arrays with nulls for missing pixels."""

    df: DataFrame
    grid: GridMapping
    variables: Mapping[str, str]
    size: tuple[int, int] = SIZE
    leading: tuple[str, ...] = ()
    attrs: Mapping[str, Any] = field(default_factory=dict)

    @staticmethod
    def from_frame(frame: GridFrame, size: tuple[int, int] = SIZE) -> BlockFrame:
        """The blocks of a frame's pixels."""
        tw, th = size
        tile = lambda dj, di: F.struct(F.expr(f"greatest(j - {dj}, 0) div {th}").alias("tj"), F.expr(f"greatest(i - {di}, 0) div {tw}").alias("ti"))
        held = F.array_distinct(F.array(*(tile(dj, di) for dj in (0, 1) for di in (0, 1))))
        rows = frame.df.select(*frame.leading, "j", "i", *frame.variables, F.explode(held).alias("t")).select("*", "t.*")
        place = ((F.col("j") - F.col("tj") * th) * (tw + 1) + F.col("i") - F.col("ti") * tw).cast("int")
        count = (tw + 1) * (th + 1)
        cell = "struct<_at: int, " + ", ".join(f"`{n}`: {SPARK_TYPES[k]}" for n, k in frame.variables.items()) + ">"
        df = rows.groupBy(*frame.leading, "tj", "ti").agg(F.collect_list(F.struct(place.alias("_at"), *frame.variables).cast(cell)).alias("_cells"))
        # Only blocks with gaps, as those at the image's end, are filled up.
        missing = F.transform(F.array_except(F.sequence(F.lit(0), F.lit(count - 1)), F.col("_cells")["_at"]), lambda k: F.struct(k.alias("_at"), *(F.lit(None).alias(n) for n in frame.variables)).cast(cell))
        df = df.withColumn("_cells", F.sort_array(F.when(F.size("_cells") == count, F.col("_cells")).otherwise(F.concat("_cells", missing))))
        return BlockFrame(df.select(*frame.leading, "tj", "ti", *(F.col("_cells")[n].alias(n) for n in frame.variables)), frame.grid, frame.variables, size, frame.leading, frame.attrs)

    def to_frame(self) -> GridFrame:
        """The pixels of the blocks; those that are null in all variables are left out."""
        tw, th = self.size
        names = list(self.variables)
        cells = self.df.select(*self.leading, "tj", "ti", F.posexplode(F.arrays_zip(*names)).alias("_at", "_v"))
        row, column = F.expr(f"_at div {tw + 1}"), F.col("_at") % (tw + 1)
        own = cells.where((row < th) & (column < tw)).select(*self.leading, (F.col("tj") * th + row).alias("j"), (F.col("ti") * tw + column).alias("i"), *(F.col("_v")[n].alias(n) for n in names))
        return GridFrame(own.where(reduce(or_, (F.col(n).isNotNull() for n in names))), self.grid, self.variables, self.leading, {}, self.attrs)

    def select(self, variables: Any) -> BlockFrame:
        """The blocks with some of their variables; None stands for all."""
        names = list(self.variables) if variables is None else [variables] if isinstance(variables, str) else list(variables)
        return replace(self, df=self.df.select(*self.leading, "tj", "ti", *names), variables={n: self.variables[n] for n in names})


def gather_blocks(blocks: BlockFrame, targets: DataFrame, methods: dict[str, str], fills: dict[str, float], *, ties: str, high: str, truncate: dict[str, bool], fit: bool = False, beyond: DataFrame | None = None) -> DataFrame:
    """What gather gives for the pixels of these blocks."""
    w, h = blocks.grid.size
    tw, th = blocks.size
    frame = GridFrame(blocks.df, blocks.grid, blocks.variables, blocks.leading)
    near, (j0, j1), (i0, i1) = places(w, h, ties, high)
    tile = lambda low, size, step: F.expr(f"cast(floor(greatest(least({low}, {size - 1}), 0)) AS bigint) div {step}")
    inside, outside = parted(targets, w, h, high, beyond)
    asked = inside.withColumns({"_tj": F.coalesce(tile("sj", h, th), F.lit(-1)), "_ti": F.coalesce(tile("si", w, tw), F.lit(-1))})
    own = [F.col(n).alias(f"_{n}") for n in blocks.variables]
    held = blocks.df.select(*(F.col(d).alias(f"_{d}") for d in blocks.leading), F.col("tj").alias("_bj"), F.col("ti").alias("_bi"), *own)
    values = leading_values(frame)
    on = (F.col("_tj") == F.col("_bj")) & (F.col("_ti") == F.col("_bi"))
    if values is not None:
        asked, outside = asked.crossJoin(values), outside.crossJoin(values)
        on = reduce(lambda c, d: c & (F.col(d) == F.col(f"_{d}")), blocks.leading, on)
    met = asked.join(held, on, "left")

    def at(n: str, pj: Column, pi: Column) -> Column:
        place = (pj - F.col("_tj") * th) * (tw + 1) + pi - F.col("_ti") * tw
        inside = (pj >= 0) & (pj < h) & (pi >= 0) & (pi < w)
        return F.coalesce(F.when(inside, F.get(f"_{n}", place.cast("int"))), F.lit(fills[n]).cast(SPARK_TYPES[blocks.variables[n]]))

    corners = lambda n: [at(n, a, b) for a, b in ((j0, i0), (j0, i1), (j1, i0), (j1, i1))]
    out = met.select(*blocks.leading, "j", "i", *outputs(frame, methods, fills, high, truncate, lambda n: at(n, *near), corners, fit))
    fill = {n: F.lit(fills[n]).cast(SPARK_TYPES[k]) for n, k in blocks.variables.items()}
    rest = outputs(frame, methods, fills, high, truncate, lambda n: fill[n], lambda n: [fill[n]] * 4, fit)
    return out.union(outside.select(*blocks.leading, "j", "i", *rest))


def _options(blocks: BlockFrame, interp_methods: Any, fill_values: Any, **allowed: Any) -> tuple[dict[str, str], dict[str, float]]:
    kinds = blocks.variables
    return {n: method_of(interp_methods, n, k, **allowed) for n, k in kinds.items()}, {n: fill_of(fill_values, n, k) for n, k in kinds.items()}


def reproject_blocks(source: BlockFrame, target_gm: GridMapping, *, variables: Any = None, interp_methods: Any = None, agg_methods: Any = None, recover_nans: Any = False, fill_values: Any = None) -> GridFrame:
    """reproject_dataset for blocks whose rows count from above; a source that is scaled down first is taken by its pixels."""
    source.grid.assert_regular("source_gm")
    target_gm.assert_regular("target_gm")
    if source.grid.is_j_axis_up:
        raise ValueError("blocks must count their rows from above")
    blocks = source.select(variables)
    methods, fills = _options(blocks, interp_methods, fill_values)
    pixels = blocks.to_frame()
    scaled = _scaled_down(pixels, target_gm, interp_methods, agg_methods, recover_nans)
    if scaled is not pixels:
        blocks = BlockFrame.from_frame(scaled, blocks.size)
    grid, (tw, th) = blocks.grid, blocks.size
    rows, columns = reach(grid, target_gm)
    some = reduce(or_, (F.col("ti").between(a // tw, b // tw) for a, b in columns), F.lit(False))
    blocks = replace(blocks, df=blocks.df.where(F.col("tj").between(rows[0] // th, rows[1] // th) & some))
    targets, beyond = split_targets(grid, target_gm, blocks.df.sparkSession)
    df = gather_blocks(blocks, targets, methods, fills, ties="even", high="ceil", truncate={n: m == "triangular" for n, m in methods.items()}, beyond=beyond)
    return GridFrame(df, target_gm, blocks.variables, blocks.leading, {}, blocks.attrs).with_spatial_ref()


def affine_blocks(source: BlockFrame, target_gm: GridMapping, *, variables: Any = None, interp_methods: Any = None, agg_methods: Any = None, recover_nans: Any = False, fill_values: Any = None) -> GridFrame:
    """affine_transform_dataset for blocks; where pixels are reduced or gaps left out, it goes by the pixels."""
    grid = source.grid
    blocks = source.select(variables)
    (xs, _, xo), (_, ys, yo) = matrix = target_gm.ij_transform_to(grid)
    if xs > 1 or ys > 1 or min(xs, ys) < 0 or recover_nans or not grid.crs.agrees(target_gm.crs):
        options = {"interp_methods": interp_methods, "agg_methods": agg_methods, "recover_nans": recover_nans, "fill_values": fill_values}
        return affine_transform_dataset(blocks.to_frame(), target_gm, **options)
    assert matrix[0][1] == matrix[1][0] == 0
    methods, fills = _options(blocks, interp_methods, fill_values, allowed=("nearest", "bilinear"))

    def index(axis: str, scale: float, offset: float, size: int) -> Column:
        v = F.lit(float(scale)) * F.col(axis) + F.lit(float(offset))
        v = F.when(F.abs(v - F.rint(v)) < SNAP, F.rint(v)).otherwise(v)
        return F.when(v.between(0, size - 1), v)

    spark: SparkSession = blocks.df.sparkSession
    cells = spark.range(target_gm.width * target_gm.height).select(F.expr(f"id div {target_gm.width}").alias("j"), F.expr(f"id % {target_gm.width}").alias("i"))
    both = cells.select("j", "i", index("j", ys, yo, grid.height).alias("sj"), index("i", xs, xo, grid.width).alias("si"))
    out = F.col("sj").isNull() | F.col("si").isNull()
    targets = both.withColumns({"sj": F.when(~out, F.col("sj")), "si": F.when(~out, F.col("si"))})
    df = gather_blocks(blocks, targets, methods, fills, ties="up", high="ceil", truncate=dict.fromkeys(methods, False), fit=True)
    return GridFrame(df, target_gm, blocks.variables, blocks.leading, {}, blocks.attrs).with_spatial_ref()
