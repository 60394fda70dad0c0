"""Reducers of windows of pixels, as aggregate columns.

A window has rows and columns numbered from 0; NaN counts as missing where a reducer
skips missing values.  SQL's own aggregates skip nulls, so NaN is turned to null first:
max and min would order it as the largest value, and sums would carry it on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.options import REDUCERS, is_integer

NAN = float("nan")


def present(v: Column) -> Column:
    """v, or null for NaN."""
    return F.nanvl(v.cast("double"), F.lit(None).cast("double"))


def at(v: Column, wj: Column, wi: Column, j: int, i: int) -> Column:
    return F.max(F.when((wj == j) & (wi == i), v))


def reducer(name: str, v: Column, wj: Column, wi: Column, rows: int, cols: int, dtype: str = "float64") -> Column:
    """The aggregate of a window of rows x cols; integers are rounded half to even where a mean is taken."""
    if name not in REDUCERS:
        raise KeyError(name)
    whole = is_integer(dtype)
    seen = v.cast("double") if whole else present(v)
    nan = lambda c: c if whole else F.coalesce(c, F.lit(NAN))
    # Rounded to nine digits first, so that the order of adding doesn't decide halves.
    mean = lambda c: F.rint(F.round(c, 9)) if whole else F.coalesce(c, F.lit(NAN))
    if name == "center":
        return at(v, wj, wi, rows // 2, cols // 2)
    if name == "first":
        return at(v, wj, wi, 0, 0)
    if name == "last":
        return at(v, wj, wi, rows - 1, cols - 1)
    if name == "count":
        return F.sum(F.when(v != 0, 1).otherwise(0))
    if name == "prod":
        return F.coalesce(F.product(seen), F.lit(1.0))
    if name == "sum":
        return F.coalesce(F.sum(v if whole else seen), F.lit(0 if whole else 0.0))
    if name == "max":
        return nan(F.max(v if whole else seen))
    if name == "min":
        return nan(F.min(v if whole else seen))
    if name == "mode":
        return F.mode(v.cast("long"), True)
    return mean({"mean": F.avg, "median": F.median, "std": F.stddev_pop, "var": F.var_pop}[name](seen))
