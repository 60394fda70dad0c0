"""Targets of a reprojection that can't meet the source are told by tiles, and not worked out."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom import queries
from gridloom.operators.gather import ZONE, parted, spread
from gridloom.operators.reproject import split_targets, target_indices
from gridloom.plans.crs import CRS, project_bounds
from gridloom.plans.grid import GridMapping
from gridloom.sources.frame import GridFrame

ROTATED = CRS.from_any({"grid_mapping_name": "rotated_latitude_longitude", "grid_north_pole_latitude": 39.25, "grid_north_pole_longitude": -162.0})
VIEW = CRS.from_any({"grid_mapping_name": "geostationary", "longitude_of_projection_origin": 0.0, "perspective_point_height": 35785831.0, "semi_major_axis": 6378137.0, "semi_minor_axis": 6356752.31414, "sweep_angle_axis": "y"})
CORNER = tuple(math.floor(v) for v in project_bounds(CRS.from_any("EPSG:32632"), CRS.from_any("EPSG:3035"), (560000.0, 5900000.0, 566400.0, 5900100.0))[:2])
WORLD = GridMapping.regular((600, 300), (-180, -90), 0.6, "EPSG:4326")
#: Source, target, and the share of the target that is worked out at most.
PAIRS = {
    "strip": (GridMapping.regular((64, 900), (560000.0, 5900000.0), 100, "EPSG:32632"), GridMapping.regular((700, 1000), CORNER, 90.0, "EPSG:3035"), 0.35),
    "beyond the disc": (GridMapping.regular((40, 900), (560000.0, 5900000.0), 20000, "EPSG:32632"), GridMapping.regular((400, 1500), (4300000, 3300000), 20000.0, "EPSG:3035"), 0.7),
    "pole": (GridMapping.regular((360, 20), (-180, 88), (1, 0.1), "EPSG:4326"), GridMapping.regular((700, 700), (-3.5e6, -3.5e6), 10000, "EPSG:3413"), 0.2),
    "antimeridian": (GridMapping.regular((50, 50), (175, 60), 0.2, "EPSG:4326"), GridMapping.regular((500, 500), (-4e6, -1e6), 10000, "EPSG:3413"), 0.35),
    "0 to 360": (GridMapping.regular((60, 45), (300, -20), 1, "EPSG:4326"), GridMapping.regular((500, 500), (-5.5e6, -5.5e6), 22000, VIEW), 0.6),
    "view": (GridMapping.regular((300, 300), (-5.5e6, -5.5e6), 36000, VIEW), WORLD, 0.6),
    "rotated": (GridMapping.regular((64, 300), (-3.2, -10.0), 0.1, ROTATED), WORLD, 0.3),
    "whole": (WORLD, GridMapping.regular((300, 300), (-2.5e6, -2.5e6), 16000, "EPSG:3413"), 1.0),
}


@pytest.mark.parametrize("name", PAIRS)
def test_targets_left_out_meet_nothing(spark, name):
    grid, target, share = PAIRS[name]
    every = target_indices(grid, target, target.pixel_frame(spark))
    some, beyond = split_targets(grid, target, spark)
    met = lambda df: parted(df, *grid.size, "ceil")[0]
    assert met(every).count() > 0 and met(every).exceptAll(met(some)).count() == 0
    worked_out = some.count()
    assert worked_out <= share * target.width * target.height
    both = some.select("j", "i").union(beyond)
    assert both.count() == both.distinct().count() == target.width * target.height
    assert both.agg(F.min("j"), F.max("j"), F.min("i"), F.max("i")).first() == (0, target.height - 1, 0, target.width - 1)


def test_pixels_worked_out_grow_with_the_source(spark):
    """The target grows with the square of the strip's length, and what is worked out with the length."""
    counts = []
    for n in (1, 2, 4):
        grid = GridMapping.regular((64, 1500 * n), (560000.0, 5900000.0), 100, "EPSG:32632")
        target = GridMapping.regular((400 * n, 1667 * n), CORNER, 90.0, "EPSG:3035")
        some = split_targets(grid, target, spark)[0]
        assert parted(some, *grid.size, "ceil")[0].count() > 64 * 1400 * n
        counts.append(some.count())
    assert counts[1] < 2.2 * counts[0] and counts[2] < 2.2 * counts[1]


def test_wide_rows_are_filled_zone_by_zone(spark):
    """The numbers of columns in a stretch of a file's rows are those of one zone, however wide the target is."""
    width, height = 2 * ZONE + 5, 6
    pixels = spark.createDataFrame([(1, 0, 1.0), (1, ZONE - 1, 2.0), (1, ZONE, 3.0), (4, width - 1, 4.0), (5, 7, 5.0)], "j long, i long, v double")
    frame = GridFrame.from_dataframe(pixels, GridMapping.regular((64, 64), (0, 0), 1, "EPSG:3857"))
    df = spread(frame, frame.df, (width, height), {"v": -1.0})
    assert df.count() == df.select("j", "i").distinct().count() == width * height
    assert sorted(tuple(r) for r in df.where("v <> -1").collect()) == sorted(tuple(r) for r in pixels.collect())
    placed = df.select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("k"), F.expr(f"i div {ZONE}").alias("zone"))
    ends = placed.groupBy("p", "zone").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count("*").alias("n"))
    assert ends.where("b - a + 1 <> n").count() == 0


def test_targets_in_degrees_beyond_the_pole(spark):
    """Degrees of long targets count as a plane's, with the same values."""
    assert queries._degrees(600_000).size == (66_866, 630_080) and not queries._degrees(600_000).crs.is_geographic
    assert queries._degrees(100_000).crs.is_geographic
    h = 60
    frame = GridFrame.from_dataframe(spark.range(h * 64).selectExpr("id div 64 AS j", "id % 64 AS i", "sin(id) AS v"), GridMapping.regular((64, h), (0, 0), 1, queries.PLANE))
    degrees = queries._degrees(h)
    plane = GridMapping.regular(degrees.size, (degrees.x_min, degrees.y_min), degrees.xy_res, queries.PLANE)
    one, other = (queries._rectified_utm(frame, queries._pixels(spark, h, queries.UTM_X, queries.UTM_Y), t).df.select("j", "i", F.round("v", 6).alias("v")) for t in (degrees, plane))
    assert one.where("NOT isnan(v)").count() > 1000 and one.exceptAll(other).count() == other.exceptAll(one).count() == 0
