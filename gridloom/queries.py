"""The engine's operations over raster views of the synthetic tables, with the same in DuckDB's SQL.

`embeddings` serves as an image: vec_id numbers rows, and an element's place columns.  `events`
serves as a sparse one: users are rows, hours of the day columns, mean values pixels.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.reducers import present
from .functions.selection import reduced
from .operators.affine import affine_transform_dataset
from .operators.blocks import BlockFrame, affine_blocks, reproject_blocks
from .operators.rectify import rectify_dataset
from .operators.reproject import reproject_dataset
from .operators.resample import resample_in_space
from .operators.tiles import coarsen, compute_from_blocks, tile_frame
from .operators.windows import ij_windows, source_windows
from .plans.crs import CRS, CRS_WGS84, project, sql_of, transformation
from .plans.grid import GridMapping, lon_180_column, lon_360_column
from .plans.options import REDUCERS
from .sources.frame import GridFrame, clip_by_bbox
from .sources.infer import grid_from_axes, grid_from_pixels, xy_bbox_of

Query = Callable[[SparkSession, str], DataFrame]
WIDTH = 64
#: CF attributes of the rotated pole of European regional models.
ROTATED = {"grid_mapping_name": "rotated_latitude_longitude", "grid_north_pole_latitude": 39.25, "grid_north_pole_longitude": -162.0}
PLANE, UTM, LAEA = CRS.from_any("EPSG:3857"), CRS.from_any("EPSG:32632"), CRS.from_any("EPSG:3035")


def _rows(spark: SparkSession, sf_dir: str) -> int:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").agg(F.max("vec_id") + 1).first()[0] or 0


def image(spark: SparkSession, sf_dir: str, grid: GridMapping | None = None) -> GridFrame:
    """The embeddings as pixels v (and q, a small whole number, and p, a number near 1) of a grid with unit pixels, or of another one."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("j"), F.posexplode("embedding").alias("i", "v"))
    df = df.select("j", F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"), F.rint(F.col("v").cast("double") * 10).cast("int").alias("q"), (F.col("v").cast("double") + 1).alias("p"))
    return GridFrame.from_dataframe(df, grid or GridMapping.regular((WIDTH, _rows(spark, sf_dir)), (0, 0), 1, PLANE))


IMAGE_SQL = f"(SELECT vec_id AS j, i, e::DOUBLE AS v, CAST(round_even(e::DOUBLE * 10, 0) AS INTEGER) AS q, e::DOUBLE + 1 AS p FROM (SELECT vec_id, unnest(range({WIDTH})) AS i, unnest(embedding) AS e FROM embeddings))"
ROWS_SQL = "(SELECT max(vec_id) + 1 AS h FROM embeddings)"


def shown(df: DataFrame, *values: str) -> DataFrame:
    """j, i and values rounded to six digits, NaN as null."""
    return df.select("j", "i", *(F.round(present(F.col(v)), 6).alias(v) for v in values))


# -- reducers

_REDUCER_SQL = {
    "center": "max(CASE WHEN j % 4 = 2 AND i % 4 = 2 THEN {v} END)", "first": "max(CASE WHEN j % 4 = 0 AND i % 4 = 0 THEN {v} END)", "last": "max(CASE WHEN j % 4 = 3 AND i % 4 = 3 THEN {v} END)",
    "count": "CAST(sum(CASE WHEN {v} <> 0 THEN 1 ELSE 0 END) AS DOUBLE)", "prod": "product({v})", "sum": "sum({v})", "max": "max({v})", "min": "min({v})",
    "mean": "avg({v})", "median": "median({v})", "std": "stddev_pop({v})", "var": "var_pop({v})",
}


def _coarsen(name: str, column: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = image(spark, sf_dir)
        df = coarsen(replace(frame, variables={column: frame.variables[column]}), 4, 4, name)
        return df.select("j", "i", F.round(F.col(column).cast("double"), 6).alias("v"))

    return run


def _coarsen_sql(name: str, column: str) -> str:
    whole = f"SELECT * FROM {IMAGE_SQL}, {ROWS_SQL} WHERE j < h // 4 * 4"
    if name == "mode":
        return f"""SELECT j, i, CAST(arg_max(q, (n, -q)) AS DOUBLE) AS v FROM (
            SELECT CAST(j // 4 AS BIGINT) AS j, CAST(i // 4 AS BIGINT) AS i, q, count(*) AS n FROM ({whole}) GROUP BY ALL) GROUP BY j, i"""
    value = _REDUCER_SQL[name].format(v=column)
    if column == "q" and name in ("mean", "median", "std", "var"):
        value = f"round_even(round({value}, 9), 0) + 0.0"
    return f"SELECT CAST(j // 4 AS BIGINT) AS j, CAST(i // 4 AS BIGINT) AS i, round(CAST({value} AS DOUBLE), 6) + 0.0 AS v FROM ({whole}) GROUP BY 1, 2"


def _coarsen_gaps(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # A little more settles how means of prices round.
        return coarsen(sparse(spark, sf_dir), 4, 4, name).select("j", "i", F.round(present(F.col("v")) + 1e-9, 6).alias("v"))

    return run


def _coarsen_gaps_sql(name: str) -> str:
    value = {"count": "CAST(sum(CASE WHEN v = 0 THEN 0 ELSE 1 END) AS DOUBLE)", "sum": "coalesce(sum(v), 0)"}.get(name) or _REDUCER_SQL[name].format(v="v")
    cells = "FROM (SELECT max(user_id) + 1 AS h FROM events), LATERAL (SELECT unnest(range(CAST(h // 4 * 4 AS BIGINT))) AS j), (SELECT unnest(range(24)) AS i)"
    return f"SELECT CAST(j // 4 AS BIGINT) AS j, CAST(i // 4 AS BIGINT) AS i, round({value} + 1e-9, 6) AS v FROM (SELECT j, i {cells}) LEFT JOIN {SPARSE_SQL} USING (j, i) GROUP BY 1, 2"


def _whole_image(name: str, column: str) -> Query:
    """One window of nearly all pixels, by passes of counts; and four of a quarter of the rows each."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = image(spark, sf_dir)
        quarter = frame.grid.height // 4
        cells = frame.df.where(F.col("j") < 4 * quarter).select(F.expr(f"j div {quarter}").alias("j"), F.lit(0).cast("long").alias("i"), (F.col("j") % quarter).alias("wj"), F.col("i").alias("wi"), column)
        parts = reduced(cells, ["j", "i"], {column: frame.variables[column]}, {column: name}, quarter, WIDTH, large=0)
        whole = reduced(cells.withColumn("j", F.lit(-1).cast("long")), ["j", "i"], {column: frame.variables[column]}, {column: name}, 4 * quarter, WIDTH, large=0)
        return parts.union(whole).select("j", "i", F.round(F.col(column).cast("double"), 6).alias("v"))

    return run


def _whole_image_sql(name: str, column: str) -> str:
    cells = f"(SELECT k AS j, 0 AS i, {column} AS v FROM {IMAGE_SQL}, {ROWS_SQL}, LATERAL (SELECT unnest([CAST(j // (h // 4) AS BIGINT), -1]) AS k) WHERE j < h // 4 * 4)"
    if name == "mode":
        return f"SELECT j, CAST(i AS BIGINT) AS i, CAST(arg_max(v, (n, -v)) AS DOUBLE) AS v FROM (SELECT j, i, v, count(*) AS n FROM {cells} GROUP BY ALL) GROUP BY j, i"
    value = "round_even(round(median(v), 9), 0)" if column == "q" else "round(median(v), 6)"
    return f"SELECT j, CAST(i AS BIGINT) AS i, {value} + 0.0 AS v FROM {cells} GROUP BY j, i"


# -- affine maps

#: name: (size, xy_min, resolution, options); heights are given in shares of the image's.
AFFINE: dict[str, tuple[Any, ...]] = {
    "affine_nearest": (1.0, (0.3, 0.0), (0.4, 0.4), {"interp_methods": "nearest"}),
    "affine_bilinear": (1.0, (0.0, 0.0), (0.5, 0.5), {"interp_methods": "bilinear"}),
    "affine_shift": (1.0, (2.25, -3.5), (1.0, 1.0), {"interp_methods": "bilinear"}),
    "affine_fill": (1.0, (-5.25, 3.0), (1.0, 1.0), {"interp_methods": "bilinear", "fill_values": -9.0}),
    "affine_rows_only": (0.25, (0.0, 0.0), (1.0, 4.0), {"interp_methods": "bilinear"}),
}


def _target(grid: GridMapping, share: float, xy_min: tuple[float, float], res: tuple[float, float], **options: Any) -> GridMapping:
    return GridMapping.regular((WIDTH, max(2, int(grid.height * share))), xy_min, res, grid.crs, **options)


def _affine(name: str) -> Query:
    share, xy_min, res, options = AFFINE[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = image(spark, sf_dir)
        return shown(affine_transform_dataset(frame, _target(frame.grid, share, xy_min, res), variables="v", **options).df, "v")

    return run


def _affine_sql(name: str) -> str:
    share, (x0, y0), (xr, yr), options = AFFINE[name]
    fill = options.get("fill_values", "NULL")
    snap = lambda t: f"CASE WHEN abs({t} - round_even({t}, 0)) < 1e-9 THEN round_even({t}, 0) ELSE {t} END"
    th = f"greatest(2, CAST(floor(h * {share}) AS BIGINT))"
    cells = f"""(SELECT tj, ti, h, {snap('ys')} AS y, {snap('xs')} AS x FROM (
        SELECT tj, ti, h, {xr} * ti + {x0} AS xs, h - ({y0} + {yr} * {th}) + {yr} * tj AS ys
        FROM {ROWS_SQL}, LATERAL (SELECT unnest(range({th})) AS tj), (SELECT unnest(range({WIDTH})) AS ti)))"""
    inside = f"y BETWEEN 0 AND h - 1 AND x BETWEEN 0 AND {WIDTH - 1}"
    if options["interp_methods"] == "nearest":
        return f"""SELECT tj AS j, ti AS i, round(CASE WHEN {inside} THEN s.v ELSE {fill} END, 6) AS v FROM {cells} LEFT JOIN {IMAGE_SQL} s
            ON s.j = floor(y + 0.5) AND s.i = floor(x + 0.5)"""
    weight = "(CASE WHEN dj = 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE WHEN di = 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END)"
    return f"""SELECT tj AS j, ti AS i, round(CASE WHEN any_value({inside}) THEN sum({weight} * s.v) ELSE {fill} END, 6) AS v
        FROM {cells}, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(dj, di) LEFT JOIN {IMAGE_SQL} s ON s.j = floor(y) + dj AND s.i = floor(x) + di GROUP BY tj, ti"""


def _affine_downscale(factor: float, reducer_name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = image(spark, sf_dir)
        target = GridMapping.regular((int(WIDTH / factor), int(frame.grid.height / factor)), (0, frame.grid.height - int(frame.grid.height / factor) * factor), factor, PLANE)
        return shown(affine_transform_dataset(frame, target, variables="v", interp_methods="bilinear", agg_methods=reducer_name).df, "v")

    return run


DOWNSCALE_MEAN_SQL = f"""SELECT CAST(j // 2 AS BIGINT) AS j, CAST(i // 2 AS BIGINT) AS i, round(avg(v), 6) AS v
    FROM {IMAGE_SQL}, {ROWS_SQL} WHERE j < h // 2 * 2 GROUP BY 1, 2"""
#: Windows of 3 x 3 samples at 2.5 / 3 pixels' distance, of which each is interpolated.
DOWNSCALE_MAX_SQL = f"""WITH c AS (
    SELECT fj, fi, CASE WHEN abs(y - round_even(y, 0)) < 1e-9 THEN round_even(y, 0) ELSE y END AS y, CASE WHEN abs(x - round_even(x, 0)) < 1e-9 THEN round_even(x, 0) ELSE x END AS x
    FROM (SELECT fj, fi, fj * (2.5e0 / 3) AS y, fi * (2.5e0 / 3) AS x
        FROM {ROWS_SQL}, LATERAL (SELECT unnest(range(CAST(floor(h / 2.5) AS BIGINT) * 3)) AS fj), (SELECT unnest(range({int(WIDTH / 2.5) * 3})) AS fi))),
  s AS (
    SELECT fj, fi, any_value(y) AS y, any_value(x) AS x, sum((CASE WHEN dj = 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END) * (CASE WHEN di = 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END) * p.v) AS v
    FROM c, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(dj, di) LEFT JOIN {IMAGE_SQL} p ON p.j = floor(y) + dj AND p.i = floor(x) + di GROUP BY fj, fi)
  SELECT CAST(fj // 3 AS BIGINT) AS j, CAST(fi // 3 AS BIGINT) AS i, round(max(CASE WHEN y <= h - 1 AND x <= {WIDTH - 1} THEN v END), 6) AS v FROM s, {ROWS_SQL} GROUP BY 1, 2"""


def sparse(spark: SparkSession, sf_dir: str) -> GridFrame:
    """Mean event values by user and hour; hours without events are NaN."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id IS NOT NULL AND ts IS NOT NULL")
    cells = events.groupBy(F.col("user_id").cast("long").alias("j"), F.hour("ts").cast("long").alias("i")).agg(F.avg("value").alias("v"))
    rows = (events.agg(F.max("user_id")).first()[0] or 0) + 1
    grid = GridMapping.regular((24, max(2, rows)), (0, 0), 1, PLANE)
    full = spark.range(grid.height * 24).select(F.expr("id div 24").alias("j"), F.expr("id % 24").alias("i")).join(cells, ["j", "i"], "left")
    return GridFrame.from_dataframe(full.select("j", "i", F.coalesce("v", F.lit(math.nan)).alias("v")), grid)


def affine_recover_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-pixel shifts, where gaps are left out of the weights."""
    frame = sparse(spark, sf_dir)
    target = GridMapping.regular(frame.grid.size, (0.5, -0.5), 1, PLANE)
    df = affine_transform_dataset(frame, target, interp_methods="bilinear", recover_nans=True).df
    # Means of prices end in a five at the seventh digit at times: a little more settles how they round.
    return df.select("j", "i", F.round(present(F.col("v")) + 1e-9, 6).alias("v"))


SPARSE_SQL = "(SELECT CAST(user_id AS BIGINT) AS j, CAST(hour(ts) AS BIGINT) AS i, avg(value) AS v FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2)"
RECOVER_SQL = f"""WITH h AS (SELECT CAST(max(user_id) AS BIGINT) + 1 AS h FROM events),
  t AS (SELECT tj, ti, h FROM h, LATERAL (SELECT unnest(range(h)) AS tj), (SELECT unnest(range(24)) AS ti))
  SELECT tj AS j, ti AS i, round(CASE WHEN any_value(tj + 0.5 <= h - 1 AND ti + 0.5 <= 23) THEN sum(0.25 * s.v) / nullif(sum(CASE WHEN s.v IS NULL THEN 0 ELSE 0.25 END), 0) + 1e-9 END, 6) AS v
  FROM t, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(dj, di) LEFT JOIN {SPARSE_SQL} s ON s.j = tj + dj AND s.i = ti + di GROUP BY tj, ti"""


def affine_leading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image and its negative as two slices of one leading dimension."""
    frame = image(spark, sf_dir)
    cube = frame.df.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), "j", "i", "v").withColumn("v", F.when(F.col("k") == 0, F.col("v")).otherwise(-F.col("v")))
    share, xy_min, res, options = AFFINE["affine_bilinear"]
    out = affine_transform_dataset(GridFrame.from_dataframe(cube, frame.grid, leading=["k"]), _target(frame.grid, share, xy_min, res), variables="v", **options)
    return out.df.select("k", "j", "i", (F.round(present(F.col("v")), 6) + 0.0).alias("v"))


LEADING_SQL = f"SELECT k, j, i, CASE WHEN k = 0 THEN v ELSE -v END + 0.0 AS v FROM ({_affine_sql('affine_bilinear')}), (VALUES (0), (1)) t(k)"


def axis_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows counted from below, and back from above."""
    frame = image(spark, sf_dir)
    up = frame.with_rows_up(True)
    again = up.with_rows_up(False)
    both = shown(up.df, "v").join(again.df.select(F.col("j").alias("j_again"), F.col("i").alias("i_again"), F.round("v", 6).alias("v_again")), F.expr(f"j_again = {frame.grid.height - 1} - j AND i_again = i"))
    return both.drop("i_again")


FLIP_SQL = f"SELECT CAST(h - 1 - j AS BIGINT) AS j, i, round(v, 6) AS v, j AS j_again, round(v, 6) AS v_again FROM {IMAGE_SQL}, {ROWS_SQL}"


# -- reprojection

#: The image as a raster of 100 m pixels in a UTM zone.
UTM_CORNER = (560000.0, 5900000.0)


def _utm_grid(height: int) -> GridMapping:
    return GridMapping.regular((WIDTH, height), UTM_CORNER, 100, UTM)


def _laea_corner() -> tuple[int, int]:
    from .plans.crs import project_bounds

    x, y = UTM_CORNER
    return tuple(math.floor(v) for v in project_bounds(UTM, LAEA, (x, y, x + 100 * WIDTH, y + 100))[:2])


def _laea_grid(height: int) -> GridMapping:
    """A target of 90 m pixels over the whole image."""
    return GridMapping.regular((80 + height // 50, height * 10 // 9 + 3), _laea_corner(), 90.0, LAEA)


def _reproject(method: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        h = _rows(spark, sf_dir)
        # The resolutions are near enough to do without scaling down first.
        return shown(reproject_dataset(image(spark, sf_dir, _utm_grid(h)), _laea_grid(h), variables="v", interp_methods=method).df, "v")

    return run


def _reproject_sql(method: str) -> str:
    x, y = _laea_corner()
    cells = f"""(SELECT tj, ti, h, {x}.0e0 + 90.0e0 * (ti + 0.5e0) AS x, {y}.0e0 + 90.0e0 * th - 90.0e0 * (tj + 0.5e0) AS y
        FROM (SELECT h, h * 10 // 9 + 3 AS th, 80 + h // 50 AS tw FROM {ROWS_SQL}), LATERAL (SELECT unnest(range(th)) AS tj), LATERAL (SELECT unnest(range(tw)) AS ti))"""
    places = sql_of(LAEA.inverse(), "cells", "tj, ti, h, lon, lat")
    moved = sql_of(UTM.forward(), "(SELECT *, 0.0e0 AS x, 0.0e0 AS y FROM places)", "tj, ti, h, x, y")
    both = f"WITH cells AS MATERIALIZED {cells}, places AS MATERIALIZED ({places}), moved AS MATERIALIZED ({moved}) "
    moved = "SELECT * FROM moved"
    index = f"(SELECT tj, ti, h, (x - {UTM_CORNER[0] + 50}) / 100.0e0 AS si, ({UTM_CORNER[1]} + 100.0e0 * h - 50 - y) / 100.0e0 AS sj FROM ({moved}))"
    return _gathered_sql(both, index, method)


def _gathered_sql(both: str, index: str, method: str) -> str:
    """Values of the image at the fractional indices (tj, ti, sj, si) of a table."""
    if method == "nearest":
        return f"{both} SELECT tj AS j, ti AS i, round(s.v, 6) AS v FROM {index} LEFT JOIN {IMAGE_SQL} s ON s.j = round_even(sj, 0) AND s.i = round_even(si, 0)"
    u, t = "(si - floor(si))", "(sj - floor(sj))"
    corner = lambda k: f"max(CASE WHEN k = {k} THEN s.v END)"
    v00, v01, v10, v11 = map(corner, range(4))
    if method == "bilinear":
        value = f"({v00} + u * ({v01} - {v00})) + t * (({v10} + u * ({v11} - {v10})) - ({v00} + u * ({v01} - {v00})))"
    else:
        value = f"CASE WHEN u + t < 1 THEN {v00} + u * ({v01} - {v00}) + t * ({v10} - {v00}) ELSE {v11} + (1 - u) * ({v10} - {v11}) + (1 - t) * ({v01} - {v11}) END"
    return f"""{both} SELECT tj AS j, ti AS i, round({value}, 6) AS v FROM (SELECT *, {u} AS u, {t} AS t FROM {index}),
        (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 1, 1)) c(k, dj, di)
        LEFT JOIN {IMAGE_SQL} s ON s.j = (CASE WHEN dj = 0 THEN floor(sj) ELSE ceil(sj) END) AND s.i = (CASE WHEN di = 0 THEN floor(si) ELSE ceil(si) END) GROUP BY tj, ti, u, t"""


def _reproject_in_blocks(method: str) -> Query:
    """The same from blocks of 24 x 100 pixels, which aren't whole at the image's end."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        h = _rows(spark, sf_dir)
        blocks = BlockFrame.from_frame(image(spark, sf_dir, _utm_grid(h)).select("v"), (24, 100))
        return shown(reproject_blocks(blocks, _laea_grid(h), interp_methods=method).df, "v")

    return run


def affine_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = image(spark, sf_dir)
    share, xy_min, res, options = AFFINE["affine_shift"]
    return shown(affine_blocks(BlockFrame.from_frame(frame.select("v"), (24, 100)), _target(frame.grid, share, xy_min, res), **options).df, "v")


#: The image on a grid of a rotated pole: 6.4 by 30 degrees, whatever its number of rows.
ROTATED_BOX, ROTATED_TARGET = (-3.2, -10.0, 3.2, 20.0), (9.0, 39.0, 33.0, 72.0)


def _rotated_grid(height: int) -> GridMapping:
    return GridMapping.regular((WIDTH, height), ROTATED_BOX[:2], (0.1, 30.0 / height), CRS.from_any(ROTATED))


def reproject_rotated_pole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a rotated pole's grid to plain degrees."""
    h = _rows(spark, sf_dir)
    x0, y0, x1, y1 = ROTATED_TARGET
    # So fine that the source isn't scaled down first.
    target = GridMapping.regular((360, 2 * h), (x0, y0), ((x1 - x0) / 360, (y1 - y0) / (2 * h)), CRS_WGS84)
    return shown(reproject_dataset(image(spark, sf_dir, _rotated_grid(h)), target, variables="v", interp_methods="bilinear").df, "v")


def _rotated_pole_sql() -> str:
    x0, y0, x1, y1 = ROTATED_TARGET
    cells = f"(SELECT tj, ti, h, {x0} + {x1 - x0}e0 / 360 * (ti + 0.5e0) AS x, {y1} - {y1 - y0}e0 / (2 * h) * (tj + 0.5e0) AS y FROM {ROWS_SQL}, LATERAL (SELECT unnest(range(2 * h)) AS tj), (SELECT unnest(range(360)) AS ti))"
    moved = sql_of(transformation(CRS_WGS84, CRS.from_any(ROTATED)), "cells", "tj, ti, h, x, y")
    both = f"WITH cells AS MATERIALIZED {cells}, moved AS MATERIALIZED ({moved}) "
    return _gathered_sql(both, f"(SELECT tj, ti, (x - {ROTATED_BOX[0] + 0.05}e0) / 0.1e0 AS si, ({ROTATED_BOX[3]}e0 - 15.0e0 / h - y) / (30.0e0 / h) AS sj FROM moved)", "bilinear")


# -- rectification

SWATH = (40, 48)  # rows and columns of a swath whose grid is inferred
LON, LAT = "10.0e0 + 0.1e0 * i + 0.02e0 * j", "50.0e0 - 0.1e0 * j + 0.03e0 * i"
#: The whole image as a swath: its size in degrees hardly depends on its number of rows.
SCALE = "400.0e0"
WHOLE_LON, WHOLE_LAT = "10.0e0 + f * (0.1e0 * i + 0.002e0 * j)", "50.0e0 + f * (0.03e0 * i - 0.1e0 * j)"
RECTIFIED_RES = 0.0971


def swath(spark: SparkSession, sf_dir: str) -> GridFrame:
    h = _rows(spark, sf_dir)
    places = spark.range(h * WIDTH).select(F.expr(f"id div {WIDTH}").alias("j"), F.expr(f"id % {WIDTH}").alias("i"), F.expr(f"{SCALE} / {h}").alias("f"))
    return GridFrame.from_dataframe(image(spark, sf_dir).df, grid_from_pixels(places.select("j", "i", F.expr(WHOLE_LON).alias("x"), F.expr(WHOLE_LAT).alias("y")), CRS_WGS84))


def _rectified(height: int) -> GridMapping:
    """A target over the whole swath, with pixels a little smaller than the swath's."""
    f, size = 400.0 / height, (68 + height // 45, height + height // 25 + 22)
    return GridMapping.regular(size, (10 + f * 0.013, 50 + f * (1.95 - RECTIFIED_RES * size[1])), f * RECTIFIED_RES, CRS_WGS84)


def _rectify(method: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(rectify_dataset(swath(spark, sf_dir), _rectified(_rows(spark, sf_dir)), variables="v", interp_methods=method).df, "v")

    return run


def _size_sql(x0: str = "10 + f * 0.013e0", top: str = "50 + f * 1.95e0", r: str = f"f * {RECTIFIED_RES}e0", w: str = "68 + h // 45", th: str = "h + h // 25 + 22") -> str:
    """One row: the image's height h, the target's left and upper edge, resolution, width and height."""
    return f"(SELECT *, {x0} AS x0, {top} AS top, {r} AS r FROM (SELECT h, {SCALE} / h AS f, {w} AS w, {th} AS th FROM {ROWS_SQL}))"


def _places_sql(size: str, lon: str = WHOLE_LON, lat: str = WHOLE_LAT, missing: str = "false") -> str:
    return f"(SELECT j, i, CASE WHEN NOT ({missing}) THEN {lon} END AS x, CASE WHEN NOT ({missing}) THEN {lat} END AS y FROM {size}, LATERAL (SELECT unnest(range(h)) AS j), (SELECT unnest(range({WIDTH})) AS i))"


def _rectify_sql(method: str, size: str | None = None, pixels: str | None = None) -> str:
    size = size or _size_sql()
    cross = lambda a, b: f"(({a}x) * ({b}y) - ({a}y) * ({b}x))"
    both = f"WITH px AS MATERIALIZED {pixels or _places_sql(size)} "
    pixels = "px"
    quads = f"""(SELECT a.j AS qj, a.i AS qi, a.x AS p0x, a.y AS p0y, b.x AS p1x, b.y AS p1y, c.x AS p2x, c.y AS p2y, d.x AS p3x, d.y AS p3y
        FROM {pixels} a JOIN {pixels} b ON b.j = a.j AND b.i = a.i + 1 JOIN {pixels} c ON c.j = a.j + 1 AND c.i = a.i JOIN {pixels} d ON d.j = a.j + 1 AND d.i = a.i + 1)"""
    ranges = f"""(SELECT *, greatest(0, CAST(floor((least(p0x, p1x, p2x, p3x) - x0) / r) AS BIGINT)) AS ia, least(w - 1, CAST(floor((greatest(p0x, p1x, p2x, p3x) - x0) / r) AS BIGINT)) AS ib,
        greatest(0, CAST(floor((top - greatest(p0y, p1y, p2y, p3y)) / r) AS BIGINT)) AS ja, least(th - 1, CAST(floor((top - least(p0y, p1y, p2y, p3y)) / r) AS BIGINT)) AS jb FROM {quads}, {size})"""
    cells = f"""(SELECT *, x0 + (ti + 0.5) * r AS px, top - (tj + 0.5) * r AS py FROM {ranges}, LATERAL (SELECT unnest(range(ja, jb + 1)) AS tj), LATERAL (SELECT unnest(range(ia, ib + 1)) AS ti))"""
    sides = lambda o, u, v: ", ".join(f"{a}{c} - p{o}{c} AS {n}{o}{c}" for a, n in ((f"p{u}", "u"), (f"p{v}", "v"), ("p", "d")) for c in "xy")
    frac = lambda o: f"{cross(f'd{o}', f'v{o}')} / {cross(f'u{o}', f'v{o}')} AS fu{o}, {cross(f'u{o}', f'd{o}')} / {cross(f'u{o}', f'v{o}')} AS fv{o}"
    hit = lambda o: f"(fu{o} >= -0.001 AND fv{o} >= -0.001 AND fu{o} + fv{o} <= 1.002)"
    clamp = lambda c: f"greatest(least({c}, 1.0), 0.0)"
    hits = f"""(SELECT qj, qi, tj, ti, CASE WHEN {hit(0)} THEN qj + {clamp('fv0')} ELSE qj + 1 - {clamp('fv3')} END AS sj, CASE WHEN {hit(0)} THEN qi + {clamp('fu0')} ELSE qi + 1 - {clamp('fu3')} END AS si
        FROM (SELECT *, {frac(0)}, {frac(3)} FROM (SELECT *, {sides(0, 1, 2)}, {sides(3, 2, 1)} FROM {cells})) WHERE {hit(0)} OR {hit(3)})"""
    first = f"(SELECT tj, ti, arg_min(sj, (qj, qi)) AS sj, arg_min(si, (qj, qi)) AS si FROM {hits} GROUP BY tj, ti)"
    target = f"(SELECT tj, ti, p.sj, p.si, h FROM (SELECT tj, ti, h FROM {size}, LATERAL (SELECT unnest(range(th)) AS tj), LATERAL (SELECT unnest(range(w)) AS ti)) LEFT JOIN {first} p USING (tj, ti))"
    if method == "nearest":
        near = lambda c, n: f"CASE WHEN {c} IS NOT NULL THEN least({n}, CAST(floor({c}) AS BIGINT) + CASE WHEN {c} - floor({c}) > 0.5 THEN 1 ELSE 0 END) END"
        return f"{both} SELECT tj AS j, ti AS i, round(s.v, 6) AS v FROM {target} LEFT JOIN {IMAGE_SQL} s ON s.j = {near('sj', 'h - 1')} AND s.i = {near('si', WIDTH - 1)}"
    v00, v01, v10, v11 = (f"max(CASE WHEN k = {k} THEN s.v END)" for k in range(4))
    if method == "bilinear":
        value = f"({v00} + u * ({v01} - {v00})) + t * (({v10} + u * ({v11} - {v10})) - ({v00} + u * ({v01} - {v00})))"
    else:
        value = f"CASE WHEN u + t < 1 THEN {v00} + u * ({v01} - {v00}) + t * ({v10} - {v00}) ELSE {v11} + (1 - u) * ({v10} - {v11}) + (1 - t) * ({v01} - {v11}) END"
    return f"""{both} SELECT tj AS j, ti AS i, round({value}, 6) AS v FROM (SELECT *, si - floor(si) AS u, sj - floor(sj) AS t FROM {target}),
        (VALUES (0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 1, 1)) c(k, dj, di)
        LEFT JOIN {IMAGE_SQL} s ON s.j = least(h - 1, floor(sj) + dj) AND s.i = least({WIDTH - 1}, floor(si) + di) GROUP BY tj, ti, u, t"""


#: The middle of the swath only: 24 x 20 pixels.
WINDOW_SIZE = _size_sql("10 + f * 2.013e0", "30 + f * 0.37e0", w="24", th="20")
#: A swath whose lower half lies over its upper half, so that each place has two quads, and the first one counts.
FOLDED_LAT = "50.0e0 + f * (0.03e0 * i - 0.1e0 * abs(j - hh))"
FOLDED_SIZE = _size_sql(th="h // 2 + h // 25 + 22")
#: A swath whose edges have no coordinates; its rows and columns aren't evenly spaced.
RAGGED = f"i < (7 * j) % 5 OR i > {WIDTH - 3} + j % 4"
RAGGED_LON, RAGGED_LAT = "10.0e0 + f * (0.1e0 * i + 0.0003e0 * i * i)", "51.0e0 - f * (0.1e0 * j + 0.01e0 * j * j / h)"
RAGGED_SIZE = _size_sql(top="51 + f * 0.05e0", w="80", th="h * 17 // 15 + 22")
#: A swath in a UTM zone, and a target in degrees that holds it.
UTM_X, UTM_Y = "560000.0e0 + 100.0e0 * i + 3.0e0 * j", "5900000.0e0 - 100.0e0 * j + 30.0e0 * i"
UTM_SIZE = _size_sql("9.88e0 - 0.00002e0 * h", "53.29e0", "0.0009e0", "200 + h // 9", "h + h // 20 + 80")


def _pixels(spark: SparkSession, h: int, x: str, y: str, missing: str = "false") -> DataFrame:
    places = spark.range(h * WIDTH).select(F.expr(f"id div {WIDTH}").alias("j"), F.expr(f"id % {WIDTH}").alias("i"), F.expr(f"{SCALE} / {h}").alias("f"), F.lit(h).alias("h"), F.expr(f"{h} div 2").alias("hh"))
    here = lambda text: F.when(~F.expr(missing), F.expr(text)).otherwise(F.lit(math.nan))
    return places.select("j", "i", here(x).alias("x"), here(y).alias("y"))


def rectify_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small target on a large swath: few of its blocks are made into quads."""
    h = _rows(spark, sf_dir)
    f = 400.0 / h
    target = GridMapping.regular((24, 20), (10 + f * 2.013, 30 + f * (0.37 - 20 * RECTIFIED_RES)), f * RECTIFIED_RES, CRS_WGS84)
    return shown(rectify_dataset(swath(spark, sf_dir), target, variables="v", interp_methods="bilinear").df, "v")


def _rectify_places(x: str, y: str, missing: str, grid: Callable[[int], GridMapping], crs: CRS = CRS_WGS84) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        h = _rows(spark, sf_dir)
        frame = GridFrame.from_dataframe(image(spark, sf_dir).df, grid_from_pixels(_pixels(spark, h, x, y, missing), crs))
        return shown(rectify_dataset(frame, grid(h), variables="v", interp_methods="bilinear").df, "v")

    return run


def _folded(height: int) -> GridMapping:
    f, size = 400.0 / height, (68 + height // 45, height // 2 + height // 25 + 22)
    return GridMapping.regular(size, (10 + f * 0.013, 50 + f * (1.95 - RECTIFIED_RES * size[1])), f * RECTIFIED_RES, CRS_WGS84)


def _ragged(height: int) -> GridMapping:
    f, size = 400.0 / height, (80, height * 17 // 15 + 22)
    return GridMapping.regular(size, (10 + f * 0.013, 51 + f * (0.05 - RECTIFIED_RES * size[1])), f * RECTIFIED_RES, CRS_WGS84)


def _degrees(height: int) -> GridMapping:
    size = (200 + height // 9, height + height // 20 + 80)
    low = 53.29 - 0.0009 * size[1]
    # The rows of a larger image's target reach beyond 90; degrees count as a plane's then, as in SQL.
    return GridMapping.regular(size, (9.88 - 0.00002 * height, low), 0.0009, CRS_WGS84 if low >= -90 else PLANE)


def rectify_utm(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _rows(spark, sf_dir)
    return shown(_rectified_utm(image(spark, sf_dir), _pixels(spark, h, UTM_X, UTM_Y), _degrees(h)).df, "v")


def _rectified_utm(frame: GridFrame, pixels: DataFrame, target: GridMapping) -> GridFrame:
    plane = not target.crs.is_geographic
    grid = grid_from_pixels(project(pixels, UTM, CRS_WGS84), PLANE) if plane else grid_from_pixels(pixels, UTM)
    return rectify_dataset(GridFrame.from_dataframe(frame.df, grid), target, variables="v", interp_methods="bilinear")


def _rectify_utm_sql() -> str:
    moved = sql_of(UTM.inverse(), f"(SELECT * FROM {_places_sql(UTM_SIZE, UTM_X, UTM_Y)})", "j, i, lon AS x, lat AS y")
    return _rectify_sql("bilinear", UTM_SIZE, f"({moved})")


#: A swath in degrees, and a target of a rotated pole that holds it.
ROTATED_SIZE = _size_sql("-8.0e0", "1.6e0 + f * 0.3e0", f"f * {RECTIFIED_RES}e0", "40 + CAST(ceil(12.0e0 / (f * 0.0971e0)) AS BIGINT)", "CAST(ceil(42.5e0 / (f * 0.0971e0)) AS BIGINT)")


def rectify_rotated_pole(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _rows(spark, sf_dir)
    f = 400.0 / h
    r = f * RECTIFIED_RES
    size = (40 + math.ceil(12.0 / (f * 0.0971)), math.ceil(42.5 / (f * 0.0971)))
    target = GridMapping.regular(size, (-8.0, 1.6 + f * 0.3 - r * size[1]), r, CRS.from_any(ROTATED))
    return shown(rectify_dataset(swath(spark, sf_dir), target, variables="v", interp_methods="nearest").df, "v")


def _rectify_rotated_sql() -> str:
    moved = sql_of(transformation(CRS_WGS84, CRS.from_any(ROTATED)), f"(SELECT * FROM {_places_sql(ROTATED_SIZE)})", "j, i, x, y")
    return _rectify_sql("nearest", ROTATED_SIZE, f"({moved})")


def source_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of the swath's pixels in the tiles of a target."""
    return source_windows(swath(spark, sf_dir).grid, _rectified(_rows(spark, sf_dir)).derive(tile_size=(16, 50)), xy_border=0.25, spark=spark)


SOURCE_TILES_SQL = f"""WITH p AS {_places_sql(_size_sql())},
  t AS (
    SELECT h, CAST(ty * ceil(w / 16.0) + tx AS BIGINT) AS tile_id, x0 + r * tx * 16 - 0.25 AS ax, x0 + r * least(w, tx * 16 + 16) + 0.25 AS bx, top - r * least(th, ty * 50 + 50) - 0.25 AS ay, top - r * ty * 50 + 0.25 AS b_y
    FROM {_size_sql()}, LATERAL (SELECT unnest(range(CAST(ceil(th / 50.0) AS BIGINT))) AS ty), LATERAL (SELECT unnest(range(CAST(ceil(w / 16.0) AS BIGINT))) AS tx)),
  f AS (SELECT tile_id, max(h) AS h, min(i) AS i0, min(j) AS j0, max(i) AS i1, max(j) AS j1 FROM t LEFT JOIN p ON x BETWEEN ax AND bx AND y BETWEEN ay AND b_y GROUP BY tile_id)
  SELECT tile_id, CASE WHEN i0 IS NULL THEN -1 ELSE greatest(0, i0 - 1) END AS i0, CASE WHEN i0 IS NULL THEN -1 ELSE greatest(0, j0 - 1) END AS j0,
    CASE WHEN i0 IS NULL THEN -1 ELSE least({WIDTH}, i1 + 2) END AS i1, CASE WHEN i0 IS NULL THEN -1 ELSE least(h, j1 + 2) END AS j1 FROM f"""

#: Boxes around places told by events; some lie outside of the swath.
EVENT_BOX = {"x0": "9.5e0 + 0.0139e0 * (37 * user_id % 499)", "y0": "8.0e0 + 0.091e0 * (event_id % 487)", "x1": "9.5e0 + 0.0139e0 * (37 * user_id % 499) + 0.0503e0 * (1 + event_id % 9)", "y1": "8.0e0 + 0.091e0 * (event_id % 487) + 0.0711e0 * (1 + user_id % 13)"}


def _event_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id IS NOT NULL AND user_id IS NOT NULL")
    return events.select("event_id", *(F.expr(text).alias(c) for c, text in EVENT_BOX.items()))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For a box of each event, the window of the swath's pixels in it."""
    return ij_windows(swath(spark, sf_dir).grid, _event_boxes(spark, sf_dir)).select("event_id", "i0", "j0", "i1", "j1")


def event_windows_regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A plane's: the rows of a larger image reach beyond 90.
    grid = GridMapping.regular((WIDTH, _rows(spark, sf_dir)), (10.0, 9.0), (0.1, 0.08), PLANE)
    return ij_windows(grid, _event_boxes(spark, sf_dir), xy_border=0.01, ij_border=2).select("event_id", "i0", "j0", "i1", "j1")


_EVENT_BOXES_SQL = "(SELECT event_id, " + ", ".join(f"{text} AS {c}" for c, text in EVENT_BOX.items()) + " FROM events WHERE event_id IS NOT NULL AND user_id IS NOT NULL)"
#: Pixels meet boxes by whole degrees first, which spares most comparisons.
EVENT_WINDOWS_SQL = f"""WITH p AS MATERIALIZED (SELECT *, CAST(floor(y) AS INTEGER) AS deg FROM {_places_sql(_size_sql())}),
  b AS (SELECT *, unnest(range(CAST(floor(y0) AS INTEGER), CAST(floor(y1) AS INTEGER) + 1)) AS deg FROM {_EVENT_BOXES_SQL}),
  f AS (SELECT event_id, min(i) AS i0, min(j) AS j0, max(i) + 1 AS i1, max(j) + 1 AS j1 FROM b JOIN p USING (deg) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY event_id)
  SELECT event_id, coalesce(i0, -1) AS i0, coalesce(j0, -1) AS j0, coalesce(i1, -1) AS i1, coalesce(j1, -1) AS j1 FROM {_EVENT_BOXES_SQL} LEFT JOIN f USING (event_id)"""
EVENT_REGULAR_SQL = f"""WITH b AS {_EVENT_BOXES_SQL}, h AS {ROWS_SQL},
  x AS (SELECT event_id, min(i) AS i0, max(i) + 1 AS i1 FROM b, (SELECT unnest(range({WIDTH})) AS i) WHERE 10 + 0.1e0 * (i + 0.5) BETWEEN x0 - 0.01 AND x1 + 0.01 GROUP BY event_id),
  y AS (SELECT event_id, min(j) AS j0, max(j) + 1 AS j1 FROM b, h, LATERAL (SELECT unnest(range(h)) AS j) WHERE 9 + 0.08e0 * h - 0.08e0 * (j + 0.5) BETWEEN y0 - 0.01 AND y1 + 0.01 GROUP BY event_id)
  SELECT event_id, CASE WHEN i0 IS NULL OR j0 IS NULL THEN -1 ELSE greatest(0, i0 - 2) END AS i0, CASE WHEN i0 IS NULL OR j0 IS NULL THEN -1 ELSE greatest(0, j0 - 2) END AS j0,
    CASE WHEN i0 IS NULL OR j0 IS NULL THEN -1 ELSE least({WIDTH}, i1 + 2) END AS i1, CASE WHEN i0 IS NULL OR j0 IS NULL THEN -1 ELSE least(h, j1 + 2) END AS j1 FROM (SELECT * FROM b, h) LEFT JOIN x USING (event_id) LEFT JOIN y USING (event_id)"""


# -- the dispatcher

def auto_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = image(spark, sf_dir)
    return shown(resample_in_space(frame, _target(frame.grid, *AFFINE["affine_bilinear"][:3]), variables="v", interp_methods="bilinear").df, "v")


def auto_reproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _rows(spark, sf_dir)
    return shown(resample_in_space(image(spark, sf_dir, _utm_grid(h)), _laea_grid(h), variables="v", interp_methods="bilinear").df, "v")


def auto_rectify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(resample_in_space(swath(spark, sf_dir), _rectified(_rows(spark, sf_dir)), variables="v", interp_methods="nearest").df, "v")


def auto_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = image(spark, sf_dir)
    return shown(resample_in_space(frame, frame.grid).df, "v")


# -- geometry

def clip_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = image(spark, sf_dir)
    return shown(clip_by_bbox(frame, (10.0, 20.5, 30.0, 99.5)).df, "v", "q")


CLIP_SQL = f"""SELECT j - min(j) OVER () AS j, i - 10 AS i, round(v, 6) AS v, CAST(q AS DOUBLE) AS q FROM {IMAGE_SQL}, {ROWS_SQL}
    WHERE i + 0.5 BETWEEN 10 AND 30 AND h - j - 0.5 BETWEEN 20.5 AND 99.5"""


def select_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image(spark, sf_dir).select(["q"]).df


def _tiled(spark: SparkSession, sf_dir: str) -> GridMapping:
    return GridMapping.regular((WIDTH, _rows(spark, sf_dir)), (-20.5, 3.25), (0.5, 0.25), PLANE, tile_size=(24, 100))


def tile_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tile_frame(_tiled(spark, sf_dir), spark)


TILES_SQL = f"""SELECT CAST(ty * 3 + tx AS BIGINT) AS tile_id, i0, j0, i1, j1, -20.5 + 0.5 * i0 AS x0, top - 0.25 * j1 AS y0, -20.5 + 0.5 * i1 AS x1, top - 0.25 * j0 AS y1 FROM (
    SELECT *, tx * 24 AS i0, ty * 100 AS j0, least({WIDTH}, tx * 24 + 24) AS i1, least(h, ty * 100 + 100) AS j1, 3.25 + 0.25 * h AS top
    FROM {ROWS_SQL}, LATERAL (SELECT unnest(range(CAST(ceil(h / 100.0) AS BIGINT))) AS ty), (SELECT unnest(range(3)) AS tx))"""


def pixel_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that a function gives for whole blocks: a block's number times 1000 and the place in it."""
    import numpy as np

    return compute_from_blocks(_tiled(spark, sf_dir), lambda b, f: b["block_id"] * f + np.arange(np.prod(b["block_shape"])).reshape(b["block_shape"]), "v", "int64", (100000,), spark)


BLOCKS_SQL = f"""SELECT j, i, CAST((j // 100 * 3 + i // 24) * 100000 + (j % 100) * least(24, {WIDTH} - i // 24 * 24) + i % 24 AS BIGINT) AS v
    FROM {ROWS_SQL}, LATERAL (SELECT unnest(range(h)) AS j), (SELECT unnest(range({WIDTH})) AS i)"""


def _event_grid(spark: SparkSession, sf_dir: str) -> GridMapping:
    """A grid of one column a user, eastwards from 100 degrees, and one row an hour."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("user_id") + 1).first()[0] or 2
    return GridMapping.regular((users, 24), (100.0, -30.0), (240.0 / users, 1.0), CRS_WGS84)


def to_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre and bounds of the cell of each event's user and hour."""
    xs, ys = _event_grid(spark, sf_dir).to_coords(spark=spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("i"), F.hour("ts").cast("long").alias("j"))
    r = lambda c: F.round(c, 6) + 0.0
    both = events.join(xs, "i").join(ys, "j")
    return both.select("event_id", r(F.col("lon")).alias("lon"), r(F.col("lon_bnds")[0]).alias("lon0"), r(F.col("lon_bnds")[1]).alias("lon1"), "lat", F.col("lat_bnds")[0].alias("lat0"), F.col("lat_bnds")[1].alias("lat1"))


def _coords_sql() -> str:
    at = lambda t: f"100 + 240.0e0 / n * (user_id + {t})"
    wrap = lambda x: f"round(CASE WHEN {x} > 180 THEN {x} - 360 ELSE {x} END, 6) + 0.0"
    return f"""SELECT event_id, {wrap(at('0.5e0'))} AS lon, {wrap(at('0'))} AS lon0, {wrap(at('1'))} AS lon1, CAST(-6.5 - hour(ts) AS DOUBLE) AS lat, CAST(-6.0 - hour(ts) AS DOUBLE) AS lat0, CAST(-7.0 - hour(ts) AS DOUBLE) AS lat1
    FROM events, (SELECT max(user_id) + 1 AS n FROM events) WHERE user_id IS NOT NULL AND ts IS NOT NULL"""


COORDS_SQL = _coords_sql()

BOXES = ((-20.0, 4.0, -10.0, 9.0), (-100.0, -100.0, 100.0, 1000.0), (50.0, 0.0, 60.0, 1.0), (-3.3, 7.7, 2.1, 8.4))


def ij_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index boxes of coordinate boxes, found on a regular grid and on its pixels' coordinates alike."""
    grid = _tiled(spark, sf_dir)
    own = grid.ij_bboxes_from_xy_bboxes(BOXES, ij_border=1)
    explicit = replace(grid, pixels=grid.pixel_frame(spark), is_regular=False).ij_bboxes_from_xy_bboxes(BOXES, ij_border=1)
    rows = [(n, kind, *box) for kind, boxes in (("regular", own), ("pixels", explicit)) for n, box in enumerate(boxes)]
    return spark.createDataFrame(rows, "n int, kind string, i0 long, j0 long, i1 long, j1 long")


IJ_BOXES_SQL = f"""WITH p AS (SELECT h, j, i, -20.5 + 0.5 * (i + 0.5) AS x, 3.25 + 0.25 * h - 0.25 * (j + 0.5) AS y FROM {ROWS_SQL}, LATERAL (SELECT unnest(range(h)) AS j), (SELECT unnest(range({WIDTH})) AS i)),
  b(n, x0, y0, x1, y1) AS (VALUES {', '.join(f'({n}, {a}, {b}, {c}, {d})' for n, (a, b, c, d) in enumerate(BOXES))}),
  f AS (SELECT n, max(h) AS h, min(i) AS i0, min(j) AS j0, max(i) + 1 AS i1, max(j) + 1 AS j1 FROM b LEFT JOIN p ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY n)
  SELECT CAST(n AS INTEGER) AS n, kind, CASE WHEN i0 IS NULL THEN -1 ELSE greatest(0, i0 - 1) END AS i0, CASE WHEN i0 IS NULL THEN -1 ELSE greatest(0, j0 - 1) END AS j0,
    CASE WHEN i0 IS NULL THEN -1 ELSE least({WIDTH}, i1 + 1) END AS i1, CASE WHEN i0 IS NULL THEN -1 ELSE least(h, j1 + 1) END AS j1 FROM f, (VALUES ('regular'), ('pixels')) k(kind)"""


def xy_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = sparse(spark, sf_dir)
    box = xy_bbox_of(frame.df.select(F.when(F.isnan("v"), F.lit(math.nan)).otherwise(F.col("i") * 2.0).alias("x"), F.when(F.isnan("v"), F.lit(math.nan)).otherwise(F.col("v")).alias("y")))
    return spark.createDataFrame([tuple(round(v, 6) for v in box)], "x_min double, y_min double, x_max double, y_max double")


XY_BOX_SQL = f"SELECT round(CAST(min(i) * 2 AS DOUBLE), 6) AS x_min, round(min(v), 6) AS y_min, round(CAST(max(i) * 2 AS DOUBLE), 6) AS x_max, round(max(v), 6) AS y_max FROM {SPARSE_SQL}"


#: A longitude between -180 and 360 for each event, the ends included.
EVENT_LON = "CAST((7 * event_id + user_id) % 541 - 180 AS DOUBLE)"


def lon_wraps(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(EVENT_LON).alias("x"))
    return x.select("event_id", "x", lon_360_column(F.col("x")).alias("to_360"), lon_180_column(F.col("x")).alias("from_360"))


LON_SQL = f"SELECT event_id, x, CAST(CASE WHEN x < 0 THEN x + 360 ELSE x END AS DOUBLE) AS to_360, CAST(CASE WHEN x > 180 THEN x - 360 ELSE x END AS DOUBLE) AS from_360 FROM (SELECT event_id, {EVENT_LON} AS x FROM events)"


def index_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's cell (its user and hour) in coordinates, in a finer grid's indices, and back."""
    a = _event_grid(spark, sf_dir)
    b = GridMapping.regular((a.width * 2, 100), (90.0, -40.0), (120.0 / a.width, 0.5), CRS_WGS84, is_j_axis_up=True)
    at = lambda m, i, j: tuple(F.lit(float(p)) * i + F.lit(float(q)) * j + F.lit(float(r)) for p, q, r in m)
    cell = (F.col("user_id"), F.hour("ts"))
    x, y = at(a.ij_to_xy_transform, *cell)
    i, j = at(a.ij_transform_to(b), *cell)
    i_again, j_again = at(a.ij_transform_from(b), i, j)
    i_own, j_own = at(a.xy_to_ij_transform, x, y)
    named = {"x": x, "y": y, "i": i, "j": j, "i_again": i_again, "j_again": j_again, "i_own": i_own, "j_own": j_own}
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id IS NOT NULL AND ts IS NOT NULL")
    return events.select("event_id", *((F.round(v, 6) + 0.0).alias(n) for n, v in named.items()))


INDEX_SQL = """SELECT event_id, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round((x - 90) / (120.0e0 / n), 6) + 0.0 AS i, round((y + 40) / 0.5, 6) + 0.0 AS j,
    CAST(user_id AS DOUBLE) AS i_again, CAST(hour(ts) AS DOUBLE) AS j_again, CAST(user_id AS DOUBLE) AS i_own, CAST(hour(ts) AS DOUBLE) AS j_own
    FROM (SELECT *, 100 + 240.0e0 / n * user_id AS x, CAST(-6 - hour(ts) AS DOUBLE) AS y FROM events, (SELECT max(user_id) + 1 AS n FROM events) WHERE user_id IS NOT NULL AND ts IS NOT NULL)"""


def inferred_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids inferred from axes and from pixels of the tables, and what is derived from them."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    # Axes are geometry: one number for each column or row of an image.
    axis = lambda text, source: [r[0] for r in source.select(F.expr(text).alias("v")).where("v IS NOT NULL").distinct().orderBy("v").collect()]
    pixels = image(spark, sf_dir).df.select("j", "i", F.expr(LON).alias("x"), F.expr(LAT).alias("y")).where(f"j < {SWATH[0]} AND i < {SWATH[1]}")
    own = grid_from_pixels(pixels, CRS_WGS84)
    hours = axis("50.0e0 - 0.25e0 * hour(ts)", events)[::-1]
    rows = []
    for name, grid in (
        ("axes", grid_from_axes(axis("CAST(10.0e0 + 0.5e0 * pos AS double)", image(spark, sf_dir).df.select(F.col("i").alias("pos"))), hours, CRS_WGS84)),
        ("uneven", grid_from_axes(axis("user_id + 0.1e0 * (user_id % 3)", events), axis("2.0e0 * hour(ts) + 0.5e0 * (hour(ts) % 2)", events), PLANE)),
        ("swath", own),
        ("regular", own.to_regular()),
        ("scaled", image(spark, sf_dir).grid.scale((0.5, 0.25))),
    ):
        rows.append((name, grid.width, grid.height, *(float(v) for v in (*grid.xy_res, *(round(v, 6) for v in grid.xy_bbox))), bool(grid.is_regular), bool(grid.is_j_axis_up)))
    return spark.createDataFrame(rows, "name string, w long, h long, x_res double, y_res double, x0 double, y0 double, x1 double, y1 double, regular boolean, up boolean")


#: The swath's cells are all alike: their edge, between the least and the largest, rounds to a tenth of a degree.
GRIDS_SQL = f"""WITH a AS (SELECT DISTINCT 50 - 0.25 * hour(ts) AS v FROM events WHERE ts IS NOT NULL),
  u AS (SELECT v, v - lag(v) OVER (ORDER BY v) AS d FROM (SELECT DISTINCT user_id + 0.1e0 * (user_id % 3) AS v FROM events WHERE user_id IS NOT NULL)),
  o AS (SELECT v, v - lag(v) OVER (ORDER BY v) AS d FROM (SELECT DISTINCT 2.0e0 * hour(ts) + 0.5e0 * (hour(ts) % 2) AS v FROM events WHERE ts IS NOT NULL)),
  uu AS (SELECT count(*) AS n, round(median(d), 6) AS r, min(v) AS a, max(v) AS b FROM u), oo AS (SELECT count(*) AS n, round(median(d), 6) AS r, min(v) AS a, max(v) AS b FROM o),
  g(name, w, h, x_res, y_res, x0, y0, x1, y1, regular, up) AS (
    SELECT 'axes', {WIDTH}, count(*), 0.5, 0.25, 10 - 0.25, min(v) - 0.125, 10 + 0.5 * {WIDTH - 1} + 0.25, max(v) + 0.125, true, false FROM a
    UNION ALL SELECT 'uneven', uu.n, oo.n, uu.r, oo.r, uu.a - uu.r / 2, oo.a - oo.r / 2, uu.b + uu.r / 2, oo.b + oo.r / 2, false, true FROM uu, oo
    UNION ALL SELECT 'swath', {SWATH[1]}, {SWATH[0]}, 0.1, 0.1, min(x) - 0.05, min(y) - 0.05, max(x) + 0.05, max(y) + 0.05, false, false FROM (SELECT {LON} AS x, {LAT} AS y FROM {IMAGE_SQL} WHERE j < {SWATH[0]} AND i < {SWATH[1]})
    UNION ALL SELECT 'scaled', {WIDTH // 2}, greatest(2, CAST(round_even(h * 0.25, 0) AS BIGINT)), 2.0, 4.0, 0, 0, {WIDTH}, 4 * round_even(h * 0.25, 0), true, false FROM {ROWS_SQL})
  SELECT name, CAST(w AS BIGINT) AS w, CAST(h AS BIGINT) AS h, CAST(x_res AS DOUBLE) AS x_res, CAST(y_res AS DOUBLE) AS y_res, round(CAST(x0 AS DOUBLE), 6) AS x0, round(CAST(y0 AS DOUBLE), 6) AS y0, round(CAST(x1 AS DOUBLE), 6) AS x1, round(CAST(y1 AS DOUBLE), 6) AS y1, regular, up FROM g
  UNION ALL SELECT 'regular', CAST(round_even((x1 - x0 + 0.1) / 0.1, 0) AS BIGINT), CAST(round_even((y1 - y0 + 0.1) / 0.1, 0) AS BIGINT), 0.1, 0.1, round(CAST(x0 AS DOUBLE), 6), round(CAST(y0 AS DOUBLE), 6),
    round(CAST(x0 + 0.1 * round_even((x1 - x0 + 0.1) / 0.1, 0) AS DOUBLE), 6), round(CAST(y0 + 0.1 * round_even((y1 - y0 + 0.1) / 0.1, 0) AS DOUBLE), 6), true, false FROM g WHERE name = 'swath'"""


def _project(crs: CRS) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lonlat = image(spark, sf_dir).df.select("j", "i", F.expr("6.0e0 + 0.1e0 * i").alias("x"), F.expr("47.0e0 + 0.015e0 * (j % 500)").alias("y"))
        moved = project(lonlat, CRS_WGS84, crs)
        again = project(moved.select("j", "i", "x", "y"), crs, CRS_WGS84).select("j", "i", (F.round("x", 6) + 0.0).alias("lon"), (F.round("y", 6) + 0.0).alias("lat"))
        return moved.select("j", "i", (F.round("x", 3) + 0.0).alias("x"), (F.round("y", 3) + 0.0).alias("y")).join(again, ["j", "i"])

    return run


def _project_sql(crs: CRS) -> str:
    points = f"(SELECT j, i, 6.0e0 + 0.1e0 * i AS x, 47.0e0 + 0.015e0 * (j % 500) AS y FROM {IMAGE_SQL})"
    moved = sql_of(transformation(CRS_WGS84, crs), points, "j, i, x, y")
    again = sql_of(transformation(crs, CRS_WGS84), f"({moved})", "j, i, x AS lon, y AS lat")
    return f"SELECT m.j, m.i, round(m.x, 3) + 0.0 AS x, round(m.y, 3) + 0.0 AS y, round(a.lon, 6) + 0.0 AS lon, round(a.lat, 6) + 0.0 AS lat FROM ({moved}) m JOIN ({again}) a ON a.j = m.j AND a.i = m.i"


#: Systems whose projections are shown at the image's places, there and back.
SYSTEMS: dict[str, Any] = {
    "utm": "EPSG:32632", "laea": "EPSG:3035", "lcc": "EPSG:3034", "mercator": "EPSG:3857", "polar_stereographic": "EPSG:3413", "albers": "EPSG:5070", "mercator_ellipsoid": "EPSG:3395",
    "sinusoidal": {"grid_mapping_name": "sinusoidal", "earth_radius": 6371007.181}, "rotated_pole": ROTATED,
    "geostationary": {"grid_mapping_name": "geostationary", "perspective_point_height": 35785831.0, "longitude_of_projection_origin": 9.5, "sweep_angle_axis": "y"},
    "datum_osgb": "EPSG:27700", "datum_dhdn": "EPSG:4314", "datum_ed50": "EPSG:4230",
}

#: Reducers shown over windows with missing values.
GAPS = ("center", "first", "last", "count", "sum", "max", "min", "mean", "median", "std", "var")
QUERIES: dict[str, Query] = {
    **{f"coarsen_{n}": _coarsen(n, {"mode": "q", "prod": "p"}.get(n, "v")) for n in REDUCERS},
    **{f"coarsen_int_{n}": _coarsen(n, "q") for n in ("mean", "median", "std", "var", "sum", "max", "min", "count", "first", "last", "center")},
    **{f"coarsen_gaps_{n}": _coarsen_gaps(n) for n in GAPS},
    "median_large_windows": _whole_image("median", "v"), "median_int_large_windows": _whole_image("median", "q"), "mode_large_windows": _whole_image("mode", "q"),
    **{n: _affine(n) for n in AFFINE}, "affine_leading": affine_leading, "axis_flip": axis_flip,
    "affine_downscale": _affine_downscale(2, "mean"), "affine_downscale_sampled": _affine_downscale(2.5, "max"), "affine_recover_nan": affine_recover_nan,
    **{f"reproject_{m}": _reproject(m) for m in ("nearest", "bilinear", "triangular")},
    **{f"rectify_{m}": _rectify(m) for m in ("nearest", "bilinear", "triangular")},
    "reproject_blocks_bilinear": _reproject_in_blocks("bilinear"), "reproject_blocks_nearest": _reproject_in_blocks("nearest"), "affine_blocks": affine_in_blocks,
    "rectify_window": rectify_window, "rectify_folded": _rectify_places(WHOLE_LON, FOLDED_LAT, "false", _folded),
    "rectify_ragged": _rectify_places(RAGGED_LON, RAGGED_LAT, RAGGED, _ragged), "rectify_utm": rectify_utm,
    "source_windows": source_tiles, "event_windows": event_windows, "event_windows_regular": event_windows_regular,
    "resample_auto_affine": auto_affine, "resample_auto_reproject": auto_reproject, "resample_auto_rectify": auto_rectify, "resample_auto_same": auto_same,
    "clip_bbox": clip_bbox, "select_variables": select_variables, "tile_boxes": tile_boxes, "pixel_blocks": pixel_blocks, "to_coords": to_coords, "ij_boxes": ij_boxes, "xy_box": xy_box,
    "lon_wraps": lon_wraps, "index_transforms": index_transforms, "inferred_grids": inferred_grids,
    **{f"project_{n}": _project(CRS.from_any(c)) for n, c in SYSTEMS.items()}, "reproject_rotated_pole": reproject_rotated_pole, "rectify_rotated_pole": rectify_rotated_pole,
}
ORACLE_SQL: dict[str, str] = {
    **{f"coarsen_{n}": _coarsen_sql(n, {"mode": "q", "prod": "p"}.get(n, "v")) for n in REDUCERS},
    **{f"coarsen_int_{n}": _coarsen_sql(n, "q") for n in ("mean", "median", "std", "var", "sum", "max", "min", "count", "first", "last", "center")},
    **{f"coarsen_gaps_{n}": _coarsen_gaps_sql(n) for n in GAPS},
    "median_large_windows": _whole_image_sql("median", "v"), "median_int_large_windows": _whole_image_sql("median", "q"), "mode_large_windows": _whole_image_sql("mode", "q"),
    **{n: _affine_sql(n) for n in AFFINE}, "affine_leading": LEADING_SQL, "axis_flip": FLIP_SQL,
    "affine_downscale": DOWNSCALE_MEAN_SQL, "affine_downscale_sampled": DOWNSCALE_MAX_SQL, "affine_recover_nan": RECOVER_SQL,
    **{f"reproject_{m}": _reproject_sql(m) for m in ("nearest", "bilinear", "triangular")},
    **{f"rectify_{m}": _rectify_sql(m) for m in ("nearest", "bilinear", "triangular")},
    "reproject_blocks_bilinear": _reproject_sql("bilinear"), "reproject_blocks_nearest": _reproject_sql("nearest"), "affine_blocks": _affine_sql("affine_shift"),
    "rectify_window": _rectify_sql("bilinear", WINDOW_SIZE), "rectify_folded": _rectify_sql("bilinear", FOLDED_SIZE, _places_sql(FOLDED_SIZE, WHOLE_LON, FOLDED_LAT.replace("hh", "h // 2"))),
    "rectify_ragged": _rectify_sql("bilinear", RAGGED_SIZE, _places_sql(RAGGED_SIZE, RAGGED_LON, RAGGED_LAT, RAGGED)), "rectify_utm": _rectify_utm_sql(),
    "source_windows": SOURCE_TILES_SQL, "event_windows": EVENT_WINDOWS_SQL, "event_windows_regular": EVENT_REGULAR_SQL,
    "resample_auto_affine": _affine_sql("affine_bilinear"), "resample_auto_reproject": _reproject_sql("bilinear"), "resample_auto_rectify": _rectify_sql("nearest"),
    "resample_auto_same": f"SELECT j, i, round(v, 6) AS v FROM {IMAGE_SQL}",
    "clip_bbox": CLIP_SQL, "select_variables": f"SELECT j, i, q FROM {IMAGE_SQL}", "tile_boxes": TILES_SQL, "pixel_blocks": BLOCKS_SQL, "to_coords": COORDS_SQL, "ij_boxes": IJ_BOXES_SQL, "xy_box": XY_BOX_SQL,
    "lon_wraps": LON_SQL, "index_transforms": INDEX_SQL, "inferred_grids": GRIDS_SQL,
    **{f"project_{n}": _project_sql(CRS.from_any(c)) for n, c in SYSTEMS.items()}, "reproject_rotated_pole": _rotated_pole_sql(), "rectify_rotated_pole": _rectify_rotated_sql(),
}
