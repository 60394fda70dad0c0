"""Rows of blocks against rows of pixels: equal results, and less to move."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators.affine import affine_transform_dataset
from gridloom.operators.blocks import BlockFrame, affine_blocks, reproject_blocks
from gridloom.operators.reproject import reproject_dataset
from gridloom.plans.grid import GridMapping
from gridloom.sources.frame import GridFrame


def picture(spark, w, h, grid, holes=False):
    rng = random.Random(w)
    rows = [(k, j, i, rng.uniform(-9, 9) if rng.random() > 0.05 else math.nan, rng.randrange(-50, 50)) for k in (0, 1) for j in range(h) for i in range(w) if not holes or (i * j) % 7 or i < 3]
    df = spark.createDataFrame(rows, "k int, j long, i long, v double, q int")
    return GridFrame.from_dataframe(df, grid, leading=["k"])


def values(df):
    same = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 9)
    return {(r.k, r.j, r.i): (same(r.v), same(r.q)) for r in df.collect()}


UTM = GridMapping.regular((37, 29), (560000.0, 5900000.0), 100, "EPSG:32632")


@pytest.mark.parametrize("size", [(8, 5), (64, 64)])
@pytest.mark.parametrize("method", ["nearest", "bilinear", "triangular"])
def test_reprojection_of_blocks(spark, size, method):
    frame = picture(spark, 37, 29, UTM, holes=True)
    x0, y0, x1, y1 = 4255200, 3350000, 4259500, 3354000
    target = GridMapping.regular((55, 50), (x0, y0), 90.0, "EPSG:3035")
    box = UTM.transform("EPSG:3035", spark=spark).xy_bbox
    target = GridMapping.regular((55, 45), (math.floor(box[0]) - 300, math.floor(box[1]) - 200), 90.0, "EPSG:3035")
    blocks = BlockFrame.from_frame(frame, size)
    for fills in (None, {"v": -1.5, "q": 7}):
        got = reproject_blocks(blocks, target, interp_methods=method, fill_values=fills)
        want = reproject_dataset(frame, target, interp_methods=method, fill_values=fills)
        assert values(got.df) == values(want.df) and got.df.dtypes == want.df.dtypes
    assert any(v is not None for v, _ in values(got.df).values())


@pytest.mark.parametrize("method", ["nearest", "bilinear"])
@pytest.mark.parametrize("xy_min,res", [((560025.0, 5899930.0), 100), ((559700.0, 5899000.0), 61.0), ((560000.0, 5900000.0), 300.0)])
def test_affine_maps_of_blocks(spark, method, xy_min, res):
    frame = picture(spark, 37, 29, UTM)
    target = GridMapping.regular((40, 33), xy_min, res, "EPSG:32632")
    got = affine_blocks(BlockFrame.from_frame(frame, (8, 5)), target, interp_methods=method)
    want = affine_transform_dataset(frame, target, interp_methods=method)
    assert values(got.df) == values(want.df) and got.df.dtypes == want.df.dtypes


def test_blocks_and_pixels_there_and_back(spark):
    frame = picture(spark, 37, 29, UTM, holes=True)
    blocks = BlockFrame.from_frame(frame, (8, 5))
    assert blocks.df.count() == 2 * 5 * 6 and {len(r.v) for r in blocks.df.collect()} == {9 * 6}
    assert values(blocks.to_frame().df) == values(frame.df)
    assert blocks.select("q").to_frame().df.columns == ["k", "j", "i", "q"]


def moved(spark, df):
    """Bytes written to shuffles while df is worked out."""
    sc = spark.sparkContext

    def stages():
        got = spark._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {(s := got.apply(k)).stageId(): s.shuffleWriteBytes() for k in range(got.size())}

    done = stages()
    df.write.format("noop").mode("overwrite").save()
    return sum(v for k, v in stages().items() if k not in done)


def test_blocks_move_less_than_half(spark, tmp_path):
    grid = GridMapping.regular((256, 256), (560000.0, 5900000.0), 100, "EPSG:32632")
    pixels = spark.range(256 * 256).select(F.expr("id div 256").alias("j"), F.expr("id % 256").alias("i"), F.rand(1).alias("v"))
    frame = GridFrame.from_dataframe(pixels, grid)
    BlockFrame.from_frame(frame).df.write.parquet(str(tmp_path / "b"))
    frame.df.write.parquet(str(tmp_path / "p"))
    blocks = BlockFrame(spark.read.parquet(str(tmp_path / "b")), grid, frame.variables)
    frame = GridFrame.from_dataframe(spark.read.parquet(str(tmp_path / "p")), grid)
    box = grid.transform("EPSG:3035", spark=spark).xy_bbox
    target = GridMapping.regular((300, 300), (math.floor(box[0]), math.floor(box[1])), 95.0, "EPSG:3035")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, many = (moved(spark, f(x, target, interp_methods="bilinear").df) for f, x in ((reproject_blocks, blocks), (reproject_dataset, frame)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    print(few, many)
    assert 0 < few < many / 2


def test_long_targets_aslant_are_not_scaled_down(spark):
    from gridloom import queries
    from gridloom.operators.reproject import _pixel_extent, _scaled_down

    h = 12000
    source = GridFrame.from_dataframe(spark.range(1).selectExpr("id AS j", "id AS i", "0.5 AS v"), queries._utm_grid(h))
    target = queries._laea_grid(h)
    # Pixels of 90 m, turned by little: their extent is far from 100 m / 0.95.
    assert 89 < min(_pixel_extent(target, source.grid.crs)) <= max(_pixel_extent(target, source.grid.crs)) < 96
    assert _scaled_down(source, target, "bilinear", None, False) is source


def test_only_met_target_pixels_are_joined(spark):
    from gridloom.operators.rectify import rectify_dataset
    from gridloom.plans.crs import CRS_WGS84
    from gridloom.sources.infer import grid_from_pixels

    pixels = spark.range(48).selectExpr("id div 8 AS j", "id % 8 AS i", "10 + 0.1D * (id % 8) + 0.05D * (id div 8) AS x", "50 - 0.1D * (id div 8) AS y")
    frame = GridFrame.from_dataframe(spark.range(48).selectExpr("id div 8 AS j", "id % 8 AS i", "CAST(id AS double) AS v"), grid_from_pixels(pixels, CRS_WGS84))
    target = GridMapping.regular((97, 31), (8.0, 48.0), 0.09, CRS_WGS84)
    out = rectify_dataset(frame, target, interp_methods="bilinear").df
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # No table of all target pixels is made: they are filled in where their row is.
    assert f"Range (0, {97 * 31}," not in plan
    rows = out.collect()
    assert sorted((r.j, r.i) for r in rows) == [(j, i) for j in range(31) for i in range(97)]
    def within(r):
        row = (50 - (50.79 - 0.09 * (r.j + 0.5))) / 0.1
        return 0 <= row <= 5 and 0 <= (8 + 0.09 * (r.i + 0.5) - 10 - 0.05 * row) / 0.1 <= 7

    assert [(r.j, r.i) for r in rows if not math.isnan(r.v)] and all(within(r) != math.isnan(r.v) for r in rows)
