"""Small rasters with known results; n stands for NaN."""

import numpy as np

from gridloom.plans.crs import CRS_WGS84
from gridloom.plans.grid import GridMapping
from gridloom.sources.frame import GridFrame
from gridloom.sources.infer import grid_from_axes, grid_from_pixels


def table(text):
    return np.array([[float("nan") if w == "n" else float(w) for w in row.split()] for row in text.strip().split("/" if "/" in text else "\n")])


GRID_8X6 = table("0 1 0 2 0 3 0 4 / 2 0 3 0 4 0 1 0 / 0 4 0 n 0 2 0 3 / 1 0 2 0 3 0 4 0 / 0 3 0 4 0 1 0 2 / 4 0 1 0 2 0 3 0")


def frame(spark, values, grid, name="refl", schema="double", kinds=None, **options):
    rows = [(j, i, v) for j, row in enumerate(values) for i, v in enumerate(row)]
    return GridFrame.from_dataframe(spark.createDataFrame(rows, f"j long, i long, {name} {schema}"), grid, kinds=kinds, **options)


def grid_8x6(spark, values=GRID_8X6):
    grid = grid_from_axes([50.05 + 0.1 * i for i in range(8)], [10.55 - 0.1 * j for j in range(6)], CRS_WGS84)
    return frame(spark, values.tolist(), grid)


def utm_5x5(spark, up=False):
    ys = [5934300 - 100 * j for j in range(5)]
    values = [[5 * j + i for i in range(5)] for j in range(5)]
    if up:
        ys, values = ys[::-1], values[::-1]
    return frame(spark, values, grid_from_axes([565300 + 100 * i for i in range(5)], ys, "EPSG:32632"), "band_1", "long")


def swath(spark, lon, lat, rad, **options):
    rows = [(j, i, float(lon[j][i]), float(lat[j][i]), float(rad[j][i])) for j in range(len(lon)) for i in range(len(lon[0]))]
    df = spark.createDataFrame(rows, "j long, i long, x double, y double, rad double")
    grid = grid_from_pixels(df.select("j", "i", "x", "y"), CRS_WGS84, **options)
    return GridFrame.from_dataframe(df.select("j", "i", "rad"), grid)


def swath_2x2(spark, bump=0.0, **options):
    return swath(spark, [[1, 6], [0, 2]], [[56, 53], [52, 50]], [[1, 2], [3, 4 + bump]], **options)


def swath_4x4(spark):
    f = lambda g: [[g(j, i) for i in range(4)] for j in range(4)]
    return swath(spark, f(lambda j, i: 1 + i - j), f(lambda j, i: 56 - i - j), f(lambda j, i: 1 + 4 * j + i))


def regular(size, xy_min, res, crs=CRS_WGS84, **options):
    return GridMapping.regular(size, xy_min, res, crs, **options)
