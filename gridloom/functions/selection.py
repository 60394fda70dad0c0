"""Medians and modes of windows of any size: exact selection by passes of counts.

SQL's aggregates of this kind hold all values of a group in one state.  Here values are counted: for a mode by value,
for a median by part of the range that may still hold it.  Each pass cuts that range into PARTS parts, counts and
bounds each one by partial aggregation, and keeps the part of the middle value; once it has few values, they
are sorted.  No state has more than PARTS or FEW_VALUES values, whatever the window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.options import is_integer
from .reducers import NAN, present, reducer

#: Pixels of a window from which selection replaces SQL's aggregates; parts of a range; values that are sorted at once; rows that are broadcast.
LARGE, PARTS, FEW_VALUES, FEW_ROWS = 1 << 16, 1 << 12, 1 << 14, 100_000


def settled(df: DataFrame) -> DataFrame:
    """df, worked out once and kept in the folder of checkpoints, which executors share."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    return df.checkpoint()


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW_ROWS else df.hint("merge")


def medians(df: DataFrame, keys: Sequence[str], column: str, few_values: int | None = None) -> DataFrame:
    """(keys..., column): the exact median of each group's values, as a double; groups without values have no row."""
    few_values = few_values or FEW_VALUES
    keys = list(keys)
    rows = df.select(*keys, present(F.col(column)).alias("_v")).where("_v IS NOT NULL")
    base = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    # Of an even number of values there are two in the middle.
    middle = F.posexplode(F.array_distinct(F.array(F.expr("(_n - 1) div 2"), F.expr("_n div 2")))).alias("_t", "_rank")
    state = settled(base.select(*keys, middle, "_n", "_low", "_high"))
    while not (wide := state.where(f"_n > {few_values} AND _low < _high")).isEmpty():
        met = rows.join(_few(wide.select(*keys, "_t", "_low", "_high")), keys).where("_v BETWEEN _low AND _high")
        # Ranges of several octaves are cut by octaves, so that few passes lead from the widest range to one of them.  Halves keep linear
        # ranges finite; the narrowest ones have none.
        octave = lambda c: F.signum(c) * (F.coalesce(F.log2(F.nullif(F.abs(c), F.lit(0.0))), F.lit(-1075.0)) + 1075)
        v, low, high = F.col("_v"), F.col("_low"), F.col("_high")
        octaves, width = octave(high) - octave(low), high / 2 - low / 2
        share = F.when(octaves > 4, (octave(v) - octave(low)) / F.nullif(octaves, F.lit(0.0))).when(width > 0, (v / 2 - low / 2) / F.nullif(width, F.lit(0.0))).when(v > low, F.lit(1.0)).otherwise(F.lit(0.0))
        part = F.least(F.floor(share * PARTS), F.lit(PARTS - 1)).cast("int")
        counted = met.groupBy(*keys, "_t", part.alias("_p")).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        below = F.expr(f"sum(_n) OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)}, _t ORDER BY _p) - _n")
        ranked = counted.withColumn("_below", below).join(wide.select(*keys, "_t", "_rank"), [*keys, "_t"])
        found = ranked.where("_below <= _rank AND _rank < _below + _n").select(*keys, "_t", (F.col("_rank") - F.col("_below")).alias("_rank"), "_n", "_low", "_high")
        state = settled(state.where(f"NOT (_n > {few_values} AND _low < _high)").unionByName(found))
    last = state.where("_low < _high").select(*keys, "_t", "_rank", "_low", "_high")
    sorted_ = rows.join(_few(last), keys).where("_v BETWEEN _low AND _high").groupBy(*keys, "_t").agg(F.get(F.sort_array(F.collect_list("_v")), F.max("_rank").cast("int")).alias("_v"))
    both = sorted_.select(*keys, "_v").unionByName(state.where("_low = _high").select(*keys, F.col("_low").alias("_v")))
    return both.groupBy(*keys).agg((F.min("_v") / 2 + F.max("_v") / 2).alias(column))


def modes(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys..., column): each group's most frequent value as a whole number, the smallest of several; groups without values have no row."""
    counted = df.select(*keys, F.col(column).cast("long").alias("_v")).where("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    return counted.groupBy(*keys).agg(F.min_by("_v", F.struct(-F.col("_n"), "_v")).alias(column))


def reduced(cells: DataFrame, keys: Sequence[str], kinds: Mapping[str, str], methods: Mapping[str, str], rows: int, cols: int, large: int | None = None) -> DataFrame:
    """(keys..., variables): reducers of windows (keys..., wj, wi, variables) of rows x cols pixels."""
    keys = list(keys)
    slow = {n for n, m in methods.items() if m in ("median", "mode") and rows * cols > (LARGE if large is None else large)}
    quick = [reducer(methods[n], F.col(n), F.col("wj"), F.col("wi"), rows, cols, kinds[n]).alias(n) for n in kinds if n not in slow]
    out = cells.groupBy(*keys).agg(*quick) if quick else cells.select(*keys).distinct()
    for n in slow:
        whole = is_integer(kinds[n])
        found = modes(cells, keys, n) if methods[n] == "mode" else medians(cells, keys, n)
        if methods[n] == "median":
            found = found.withColumn(n, F.rint(F.round(n, 9)) if whole else F.col(n))
        out = out.join(found, keys, "left")
        if methods[n] == "median" and not whole:
            out = out.withColumn(n, F.coalesce(n, F.lit(NAN)))
    return out.select(*keys, *kinds)
