"""Gathering: values of source pixels at fractional indices, for targets that carry theirs.

Each source pixel is packed with its neighbours to the right and below, by one aggregation whose partial sums
hold nearly all of a partition.  A target asks for one such row, that of the corner above and to the left of its
index, and picks its values there; so one join on (j, i) fetches all, and nothing is brought together again.
Targets outside of the source are moved nowhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.options import is_integer
from ..sources.frame import SPARK_TYPES, GridFrame
from .affine import fitted, leading_values

NEAREST, CORNERS = 0, (1, 2, 3, 4)
#: Columns of a zone in which pixels are filled in.
ZONE = 4096


def _corner(c: Column, high: str, size: int) -> tuple[Column, Column]:
    low = F.floor(c).cast("long")
    if high == "ceil":
        return low, F.ceil(c).cast("long")
    return F.greatest(F.least(low, F.lit(size - 1)), F.lit(0)).cast("long"), F.greatest(F.least(low + 1, F.lit(size - 1)), F.lit(0)).cast("long")


def interpolate(method: str, v: list[Column], u: Column, t: Column) -> Column:
    """The value at fractions u along i and t along j of corners (00, 01, 10, 11), counted row first."""
    v00, v01, v10, v11 = v
    if method == "bilinear":
        upper, lower = v00 + u * (v01 - v00), v10 + u * (v11 - v10)
        return upper + t * (lower - upper)
    near = v00 + u * (v01 - v00) + t * (v10 - v00)
    return F.when(u + t < 1, near).otherwise(v11 + (1 - u) * (v10 - v11) + (1 - t) * (v01 - v11))


def gather(frame: GridFrame, targets: DataFrame, methods: dict[str, str], fills: dict[str, float], *, ties: str, high: str, truncate: dict[str, bool], beyond: DataFrame | None = None) -> DataFrame:
    """(leading..., j, i, variables) for targets (j, i, sj, si); a null index stands for no source, as for targets (j, i) beyond it.

    ties says how the nearest index is taken: "even" rounds halves to even, "low" rounds them
    down.  high says what the upper corners are: "ceil", or "next" within the source.
    Pixels outside the source count as filled.  Truncated variables lose their fractions.
    """
    w, h = frame.grid.size
    near, (j0, j1), (i0, i1) = places(w, h, ties, high)
    nearest_only = set(methods.values()) <= {"nearest"}
    values = leading_values(frame)
    inside, outside = parted(targets, w, h, high, beyond)
    if values is not None:
        inside, outside = inside.crossJoin(values), outside.crossJoin(values)
    key = near if nearest_only else (j0, i0)
    asked = inside.withColumns({"_kj": key[0], "_ki": key[1]})
    held = frame.df.withColumnsRenamed({"j": "_kj", "i": "_ki", **{n: f"{n}__{NEAREST}" for n in frame.variables}}) if nearest_only else _packed(frame)
    met = asked.join(held, [*frame.leading, "_kj", "_ki"], "left")
    fill = {n: F.lit(fills[n]).cast(SPARK_TYPES[k]) for n, k in frame.variables.items()}

    def at(n: str, pj: Column, pi: Column) -> Column:
        """The value at a row and a column of the corners."""
        lower, right = pj != j0, pi != i0
        v = [F.col(f"{n}__{k}") for k in CORNERS]
        return F.coalesce(F.when(lower & right, v[3]).when(lower, v[2]).when(right, v[1]).otherwise(v[0]), fill[n])

    nearest = (lambda n: F.coalesce(F.col(f"{n}__{NEAREST}"), fill[n])) if nearest_only else (lambda n: at(n, *near))
    corners = lambda n: [at(n, a, b) for a, b in ((j0, i0), (j0, i1), (j1, i0), (j1, i1))]
    out = met.select(*frame.leading, "j", "i", *outputs(frame, methods, fills, high, truncate, nearest, corners))
    # Targets that meet no pixel of the source are moved nowhere.
    rest = outputs(frame, methods, fills, high, truncate, lambda n: fill[n], lambda n: [fill[n]] * 4)
    return out.union(outside.select(*frame.leading, "j", "i", *rest))


def parted(targets: DataFrame, w: int, h: int, high: str, beyond: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The targets of which a corner lies within the source, and the others, with those beyond it."""
    # A generated mark keeps the engine from working out indices once more in a filter, each step's text within the next one's.
    marked = targets.withColumn("_here", F.explode_outer(F.array(_meets(w, h, high))))
    inside, outside = marked.where("_here").drop("_here"), marked.where("NOT _here").drop("_here")
    nowhere = F.lit(None).cast("double")
    return inside, outside if beyond is None else outside.union(beyond.select("j", "i", nowhere.alias("sj"), nowhere.alias("si")))


def _meets(w: int, h: int, high: str) -> Column:
    told = F.col("sj").isNotNull() & F.col("si").isNotNull()
    if high == "next":  # corners are held within the source
        return told
    within = (F.col("sj") > -1) & (F.col("sj") < h) & (F.col("si") > -1) & (F.col("si") < w)
    return told & F.coalesce(within, F.lit(False))


def _packed(frame: GridFrame) -> DataFrame:
    """(leading..., _kj, _ki, <variable>__1 to 4): each place with the pixels there, to the right, below, and below to the right."""
    offers = F.array(*(F.struct(F.lit(k).alias("_k"), (F.col("j") - dj).alias("_kj"), (F.col("i") - di).alias("_ki")) for k, (dj, di) in zip(CORNERS, ((0, 0), (0, 1), (1, 0), (1, 1)), strict=True)))
    given = frame.df.withColumn("_o", F.explode(offers)).select(*frame.leading, *frame.variables, "_o.*")
    return given.groupBy(*frame.leading, "_kj", "_ki").agg(*(F.max(F.when(F.col("_k") == k, F.col(n))).alias(f"{n}__{k}") for n in frame.variables for k in CORNERS))


def spread(frame: GridFrame, df: DataFrame, size: tuple[int, int], fills: dict[str, float]) -> DataFrame:
    """Pixels (leading..., j, i, variables) of a grid of size (width, height), and its other pixels as filled.

    The others are made in place, each run of them from the pixel before it: only pixels given, and one mark a row and zone of columns, are moved.
    Zone by zone, the numbers of columns come again and again within a file's pages, which keeps files of wide rows small.
    """
    width, height = size
    zones, values = -(-width // ZONE), leading_values(frame)
    marks = df.sparkSession.range(height * zones).select(F.expr(f"id % {zones}").alias("_zone"), F.expr(f"id div {zones}").alias("j"))
    marks = (marks if values is None else marks.crossJoin(values)).select(
        "_zone", *frame.leading, "j", (F.col("_zone") * ZONE - 1).alias("i"), *(F.lit(None).cast(df.schema[n].dataType).alias(n) for n in frame.variables))
    row = Window.partitionBy(*frame.leading, "_zone", "j").orderBy("i")
    end = F.least((F.col("_zone") + 1) * ZONE, F.lit(width))
    runs = df.select(F.expr(f"i div {ZONE}").alias("_zone"), *frame.leading, "j", "i", *frame.variables).union(marks).withColumn("_next", F.coalesce(F.lead("i").over(row), end))
    runs = runs.withColumn("_from", F.greatest("i", F.col("_zone") * ZONE)).where("_from < _next").withColumn("_at", F.explode(F.sequence("_from", F.col("_next") - 1)))
    own = F.col("_at") == F.col("i")
    return runs.select(*frame.leading, "j", F.col("_at").alias("i"), *(F.when(own, F.col(n)).otherwise(F.lit(fills[n]).cast(df.schema[n].dataType)).alias(n) for n in frame.variables))


def places(w: int, h: int, ties: str, high: str) -> tuple[tuple[Column, Column], tuple[Column, Column], tuple[Column, Column]]:
    """(row, column) of the nearest source pixel of (sj, si), and the rows and the columns of its corners."""
    if ties == "even":
        near = F.rint("sj").cast("long"), F.rint("si").cast("long")
    elif ties == "up":
        near = F.floor(F.col("sj") + 0.5).cast("long"), F.floor(F.col("si") + 0.5).cast("long")
    else:
        up = lambda c, size: F.least(F.floor(c) + F.when(F.col(c) - F.floor(c) > 0.5, 1).otherwise(0), F.lit(size - 1)).cast("long")
        near = up("sj", h), up("si", w)
    return near, _corner(F.col("sj"), high, h), _corner(F.col("si"), high, w)


def outputs(frame: GridFrame, methods: dict[str, str], fills: dict[str, float], high: str, truncate: dict[str, bool], near: Callable[[str], Column], corners: Callable[[str], list[Column]], fit: bool = False) -> list[Column]:
    """Each variable's value from its nearest pixel or its corners (00, 01, 10, 11), with (sj, si) at hand; with fit, integers are rounded."""
    w, h = frame.grid.size
    u, t = F.col("si") - F.floor("si"), F.col("sj") - F.floor("sj")
    if high == "next":
        u, t = F.col("si") - F.least(F.floor("si"), F.lit(w - 1)), F.col("sj") - F.least(F.floor("sj"), F.lit(h - 1))
    out = []
    for n, kind in frame.variables.items():
        if methods[n] == "nearest":
            value = near(n)
        else:
            value = interpolate(methods[n], [c.cast("double") for c in corners(n)], u, t)
            if is_integer(kind) and truncate[n]:
                value = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast(SPARK_TYPES[kind])
            elif is_integer(kind) and fit:
                value = fitted(value, kind)
            elif not is_integer(kind):
                value = value.cast(SPARK_TYPES[kind])
        fill = F.lit(fills[n]).cast("double" if is_integer(kind) and methods[n] != "nearest" and not truncate[n] and not fit else SPARK_TYPES[kind])
        out.append(F.when(F.col("sj").isNull(), fill).otherwise(value).alias(n))
    return out
