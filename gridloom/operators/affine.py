"""Affine resampling: a target pixel (j, i) takes its value at a scaled and shifted source index.

The map is diagonal, so rows and columns are looked up apart: two tables, one per
axis, say which source line feeds which target line at which weight.  A source pixel meets
the rows of both by its j and its i, so source and target grids are never
joined on pixels; what is left is one aggregation over target pixels, with partial sums.
"""

from __future__ import annotations

import math
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.selection import reduced
from ..plans.grid import GridMapping, Matrix
from ..plans.options import fill_of, is_integer, method_of, recover_of, reducer_of
from ..sources.frame import SPARK_TYPES, GridFrame

#: Source indices this near a whole number are taken as it, so rounding errors don't decide at edges.
SNAP = 1e-9
#: Entries of an axis table up to which it is broadcast.
SMALL_AXIS = 1_000_000


def snap(x: Column) -> Column:
    return F.when(F.abs(x - F.rint(x)) < SNAP, F.rint(x)).otherwise(x)


def axis_table(frame: GridFrame, scale: float, offset: float, targets: int, size: int, t: str, s: str, w: str, method: str) -> DataFrame:
    """(t, s, w): target line t is fed by source line s at weight w; lines outside the source have no rows."""
    lines = frame.df.sparkSession.range(targets).select(F.col("id").alias(t), snap(F.col("id") * F.lit(float(scale)) + F.lit(float(offset))).alias("at"))
    if method == "nearest":
        # Halves go up; the index counts as inside if the unrounded one is.
        return lines.where(F.col("at").between(0, size - 1)).select(t, F.least(F.floor(F.col("at") + 0.5), F.lit(size - 1)).cast("long").alias(s), F.lit(1.0).alias(w))
    low = F.floor("at")
    inside = lines.where(F.col("at").between(0, size - 1)).select(t, F.explode(F.array(
        F.struct(low.alias(s), (1 - (F.col("at") - low)).alias(w)), F.struct((low + 1).alias(s), (F.col("at") - low).alias(w)),
    )).alias("e")).select(t, F.col(f"e.{s}").cast("long").alias(s), F.col(f"e.{w}").alias(w))
    return inside.where(F.col(s) < size)


def _axis(table: DataFrame, entries: int) -> DataFrame:
    return F.broadcast(table) if entries <= SMALL_AXIS else table


def leading_values(frame: GridFrame) -> DataFrame | None:
    """The distinct leading values; None if the frame has no leading dimension."""
    return frame.df.select(*frame.leading).distinct() if frame.leading else None


def target_cells(frame: GridFrame, width: int, height: int) -> DataFrame:
    """(leading..., j, i) of every target pixel."""
    cells = frame.df.sparkSession.range(width * height).select(F.expr(f"id div {width}").alias("j"), F.expr(f"id % {width}").alias("i"))
    values = leading_values(frame)
    return cells if values is None else cells.crossJoin(values).select(*frame.leading, "j", "i")


def fitted(value: Column, kind: str) -> Column:
    """A floating value in a variable's kind: integers are rounded half away from zero and held within the kind's range."""
    if not is_integer(kind):
        return value.cast(SPARK_TYPES[kind])
    bits = int(kind.removeprefix("u").removeprefix("int"))
    low, high = (0, 2**bits - 1) if kind.startswith("u") else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)
    if bits == 64:
        return F.round(value).cast(SPARK_TYPES[kind])
    # greatest and least pass over nulls, which stand for no value here.
    return F.when(value.isNotNull(), F.least(F.greatest(F.round(value), F.lit(float(low))), F.lit(float(high)))).cast(SPARK_TYPES[kind])


def _literal(value: float, kind: str) -> Column:
    return F.lit(float(value)) if not is_integer(kind) else F.lit(value).cast(SPARK_TYPES[kind])


def _sample(frame: GridFrame, matrix: Matrix, size: tuple[int, int], names: list[str], method: str, recover: dict[str, bool], fills: dict[str, float]) -> DataFrame:
    """(leading..., j, i, variables) of all target pixels, by one method; values of floating kinds are doubles."""
    (xs, _, xo), (_, ys, yo) = matrix
    width, height = size
    rows = axis_table(frame, ys, yo, height, frame.grid.height, "tj", "j", "wy", method)
    cols = axis_table(frame, xs, xo, width, frame.grid.width, "ti", "i", "wx", method)
    # The lines that targets can reach, as ranges that a scan can be told of.
    reach = lambda scale, offset, n: (math.floor(min(offset, offset + scale * (n - 1))) - 1, math.ceil(max(offset, offset + scale * (n - 1))) + 1)
    source = frame.df.where(F.col("j").between(*reach(ys, yo, height)) & F.col("i").between(*reach(xs, xo, width))).select(*frame.leading, "j", "i", *names)
    fed = source.join(_axis(rows, 2 * height), "j").join(_axis(cols, 2 * width), "i")
    cells = target_cells(frame, width, height).withColumnsRenamed({"j": "tj", "i": "ti"})
    fed = fed.select(*frame.leading, "tj", "ti", (F.col("wy") * F.col("wx")).alias("w"), *names)
    empty = [F.lit(None).cast(frame.df.schema[n].dataType).alias(n) for n in names]
    both = fed.unionByName(cells.select(*frame.leading, "tj", "ti", F.lit(None).cast("double").alias("w"), *empty))
    gaps = _with_nan(frame, [n for n in names if recover[n] and method != "nearest" and not is_integer(frame.variables[n]) and not math.isnan(fills[n])])
    out = []
    for n in names:
        kind, v, w = frame.variables[n], F.col(n), F.col("w")
        if method == "nearest":
            value = F.max(v)
        elif recover[n] and not is_integer(kind):
            good = F.when(~F.isnan(v), 1.0).otherwise(0.0)
            weight = F.sum(w * good)
            value = F.when(F.abs(weight) <= 1e-8, F.lit(math.nan)).otherwise(F.sum(w * F.when(F.isnan(v), 0.0).otherwise(v)) / F.nullif(weight, F.lit(0.0)))
        else:
            value = fitted(F.sum(w * v.cast("double")), kind) if is_integer(kind) else F.sum(w * v.cast("double"))
        outside = fills[n]
        if n in gaps:
            outside = math.nan if outside == 0 else 1.0  # value and weight are both filled, then divided
        out.append(F.coalesce(value, _literal(outside, kind)).alias(n))
    return both.groupBy(*frame.leading, F.col("tj").alias("j"), F.col("ti").alias("i")).agg(*out)


def _with_nan(frame: GridFrame, names: list[str]) -> set[str]:
    """Those of the variables that hold any NaN, by one aggregate for all; none is asked for without a fill value of its own."""
    if not names:
        return set()
    row = frame.df.agg(*(F.coalesce(F.bool_or(F.isnan(n)), F.lit(False)).alias(n) for n in names)).first()
    return {n for n in names if row[n]}


def resample(frame: GridFrame, matrix: Matrix, size: tuple[int, int], *, interp_methods: Any = None, agg_methods: Any = None, recover_nans: Any = False, fill_values: Any = None) -> DataFrame:
    """The pixel table of size (width, height) whose pixel (j, i) is at `matrix` times (i, j) in the frame.

    Where the map shrinks columns, pixels that aren't taken from the nearest are sampled on a
    finer grid first and then reduced by windows.
    """
    (xs, _, xo), (shear, ys, yo) = matrix
    kinds = frame.variables
    methods = {n: method_of(interp_methods, n, k, ("nearest", "bilinear")) for n, k in kinds.items()}
    recover = {n: recover_of(recover_nans, n, k) for n, k in kinds.items()}
    fills = {n: fill_of(fill_values, n, k) for n, k in kinds.items()}
    shrinks = xs > 1 or shear > 1
    parts: list[DataFrame] = []
    groups = {
        "nearest": [n for n in kinds if methods[n] == "nearest"],
        "bilinear": [n for n in kinds if methods[n] == "bilinear" and not shrinks],
        "reduced": [n for n in kinds if methods[n] == "bilinear" and shrinks],
    }
    for group, names in groups.items():
        if not names:
            continue
        if group != "reduced":
            parts.append(_sample(frame, matrix, size, names, group, recover, fills))
            continue
        dj, di = math.ceil(abs(ys)), math.ceil(abs(xs))
        fine = _fine(frame, ((xs / di, 0.0, xo), (0.0, ys / dj, yo)), (size[0] * di, size[1] * dj), names, recover, fills)
        cell = fine.withColumns({"tj": F.expr(f"j div {dj}"), "ti": F.expr(f"i div {di}"), "wj": F.col("j") % dj, "wi": F.col("i") % di})
        keyed = cell.drop("j", "i").withColumnsRenamed({"tj": "j", "ti": "i"})
        parts.append(reduced(keyed, [*frame.leading, "j", "i"], {n: kinds[n] for n in names}, {n: reducer_of(agg_methods, n, kinds[n]) for n in names}, dj, di))
    if not parts:
        return target_cells(frame, *size)
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, [*frame.leading, "j", "i"])
    return out.select(*frame.leading, "j", "i", *(F.col(n).cast(SPARK_TYPES[kinds[n]]).alias(n) for n in kinds))


def _fine(frame: GridFrame, matrix: Matrix, size: tuple[int, int], names: list[str], recover: dict[str, bool], fills: dict[str, float]) -> DataFrame:
    """Samples on the finer grid; where each is a source pixel itself, the source's rows are taken as they are."""
    (xs, _, xo), (_, ys, yo) = matrix
    w, h = frame.grid.size
    aligned = xs == 1 and ys == 1 and abs(xo - round(xo)) < SNAP and abs(yo - round(yo)) < SNAP
    covered = aligned and round(xo) >= 0 and round(yo) >= 0 and round(xo) + size[0] <= w and round(yo) + size[1] <= h
    if not covered:
        return _sample(frame, matrix, size, names, "bilinear", recover, fills)
    j0, i0 = round(yo), round(xo)
    cut = frame.df.where(F.col("j").between(j0, j0 + size[1] - 1) & F.col("i").between(i0, i0 + size[0] - 1))
    return cut.select(*frame.leading, (F.col("j") - j0).alias("j"), (F.col("i") - i0).alias("i"), *names)


def affine_transform_dataset(source: GridFrame, target_gm: GridMapping, source_gm: GridMapping | None = None, *, variables: Any = None, interp_methods: Any = None, agg_methods: Any = None, recover_nans: Any = False, fill_values: Any = None) -> GridFrame:
    """A frame on a regular target grid of the same reference system (all geographic ones count as the same)."""
    own = source_gm or source.grid
    own.assert_regular("source_gm")
    target_gm.assert_regular("target_gm")
    if not own.crs.agrees(target_gm.crs):
        raise AssertionError(f"CRS of source_gm and target_gm must be equal, was {own.crs.name!r} and {target_gm.crs.name!r}.")
    frame = replace(source.with_spatial_ref().select(variables), grid=own)
    df = resample(frame, target_gm.ij_transform_to(own), target_gm.size, interp_methods=interp_methods, agg_methods=agg_methods, recover_nans=recover_nans, fill_values=fill_values)
    return replace(frame, df=df, grid=target_gm).with_spatial_ref()
