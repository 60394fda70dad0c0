import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import GRID_8X6, frame, grid_8x6, regular, swath, swath_2x2, swath_4x4, table, utm_5x5

from gridloom.operators.affine import affine_transform_dataset
from gridloom.operators.rectify import rectify_dataset
from gridloom.operators.reproject import reproject_dataset
from gridloom.operators.resample import resample_in_space
from gridloom.plans.crs import CRS, project_bounds, project_point
from gridloom.plans.grid import GridMapping
from gridloom.sources.frame import GridFrame

same = np.testing.assert_allclose

AFFINE = [
    ((3, 3), (50, 10), 0.1, {}, "1 0 2 / 0 3 0 / 4 0 1"),
    ((3, 3), (50.1, 10.1), 0.1, {}, "4 n n / 0 2 0 / 3 0 4"),
    ((3, 3), (50.05, 10.05), 0.1, {}, "1.25 1.5 n / 1 1.25 1.5 / 1.75 1 1.25"),
    ((3, 3), (50.05, 10.05), 0.1, {"recover_nans": True}, "1.25 1.5 .66666667 / 1 1.25 1.5 / 1.75 1 1.25"),
    ((8, 6), (50, 10), 0.2, {}, "n n n n n n n n / n n n n n n n n / n n n n n n n n / .75 1 1.75 1.25 n n n n / 1.25 1 1.25 1.75 n n n n / 1.75 1.25 .75 1.25 n n n n"),
    ((8, 6), (50, 10), 0.05, {}, "1 .5 0 1 2 1 0 1.5 / .5 1 1.5 1.25 1 1.5 2 1.75 / 0 1.5 3 1.5 0 2 4 2 / 2 1.75 1.5 1 .5 1.25 2 1.5 / 4 2 0 .5 1 .5 0 1 / n n n n n n n n"),
    ((8, 6), (49.9, 9.95), 0.05, {}, "n n .5 1 1.5 1.25 1 1.5 / n n 0 1.5 3 1.5 0 2 / n n 2 1.75 1.5 1 .5 1.25 / n n 4 2 0 .5 1 .5 / n n n n n n n n / n n n n n n n n"),
    ((8, 6), (50.2, 10.1), 0.1, {}, "n n n n n n n n / 0 2 0 3 0 4 n n / n n 4 0 1 0 n n / n n 0 2 0 3 n n / 2 0 3 0 4 0 n n / 0 4 0 1 0 2 n n"),
    ((8, 6), (49.8, 9.9), 0.1, {}, "n n 2 0 n n 4 0 / n n 0 4 n n 0 2 / n n 1 0 2 0 3 0 / n n 0 3 0 4 0 1 / n n 4 0 1 0 2 0 / n n n n n n n n"),
]


@pytest.mark.parametrize("size,xy_min,res,options,expected", AFFINE)
def test_affine(spark, size, xy_min, res, options, expected):
    out = affine_transform_dataset(grid_8x6(spark), regular(size, xy_min, res), **options)
    same(out.image("refl"), table(expected), atol=1e-7)


def test_affine_downscale_shifted(spark):
    out = affine_transform_dataset(grid_8x6(spark), regular((8, 6), (49.8, 9.8), 0.2))
    rows = "n n n n n n n n / n n n n n n n n / n .75 1 1.75 1.25 n n n / n 1.25 1 1.25 1.75 n n n / n 1.75 1.25 .75 1.25 n n n / n n n n n n n n"
    same(out.image("refl"), table(rows), atol=1e-7)


def test_affine_start_page(spark):
    values = GRID_8X6.copy()
    values[2, 3] = 1
    out = affine_transform_dataset(grid_8x6(spark, values), regular((3, 3), (50.05, 10.05), 0.2)).image("refl")
    same(out[0], [0.875, 1.375, 1.375], atol=1e-7)
    same(out[2], [1.25, 1.5, 1.0], atol=1e-7)


def test_affine_leading_dimension_and_side_variables(spark):
    base = grid_8x6(spark)
    cube = base.df.selectExpr("'a' AS time", "*").union(base.df.selectExpr("'b' AS time", "j", "i", "refl * 2"))
    side = {"flags": spark.range(2)}
    out = affine_transform_dataset(GridFrame.from_dataframe(cube, base.grid, leading=["time"], side=side), regular((3, 3), (50, 10), 0.1))
    first = table("1 0 2 / 0 3 0 / 4 0 1")
    same(out.image("refl"), [first, 2 * first], atol=1e-7)
    assert out.side["flags"].count() == 2


def test_affine_nearest_integers_and_fill(spark):
    values = [[5 * j + i for i in range(5)] for j in range(5)]
    own = frame(spark, values, regular((5, 5), (0, 0), 1), "v", "short", kinds={"v": "uint8"})
    out = affine_transform_dataset(own, regular((3, 3), (3, 3), 1))
    assert out.image("v") == [[255, 255, 255], [3, 4, 255], [8, 9, 255]]
    out = affine_transform_dataset(own, regular((3, 3), (3, 3), 1), fill_values={"v": 7})
    assert out.image("v")[0] == [7, 7, 7]


def test_affine_errors(spark):
    with pytest.raises(AssertionError, match="EPSG:4326.*EPSG:3035"):
        affine_transform_dataset(grid_8x6(spark), regular((3, 3), (50, 10), 0.1, "EPSG:3035"))
    for method, error in ((3, ValueError), ("triangular", KeyError), ("cubic", KeyError)):
        with pytest.raises(error):
            affine_transform_dataset(grid_8x6(spark), regular((3, 3), (50, 10), 0.1), interp_methods=method)
    with pytest.raises(KeyError):
        affine_transform_dataset(grid_8x6(spark), regular((3, 3), (50, 10), 0.1), variables="other")


def test_affine_between_geographic_systems(spark):
    out = affine_transform_dataset(grid_8x6(spark), regular((3, 3), (50, 10), 0.1, "OGC:CRS84"))
    same(out.image("refl"), table("1 0 2 / 0 3 0 / 4 0 1"), atol=1e-7)


REPROJECT = [
    ((5, 5), (4320080, 3382480), 80, "EPSG:3035", "1 1 2 3 4 / 6 6 7 8 9 / 11 12 12 13 14 / 16 17 17 18 19 / 21 17 17 18 19"),
    ((5, 5), (4320080, 3382480), 20, "EPSG:3035", "15 16 16 16 16 / 15 16 16 16 16 / 15 16 16 16 16 / 20 21 21 21 21 / 20 21 21 21 21"),
    ((3, 3), (4320050, 3382500), 120, "EPSG:3035", "0 1 2 / 5 6 7 / 15 16 17"),
    ((5, 5), (9.9886, 53.5499), 0.0006, "EPSG:4326", "7 8 8 8 9 / 12 13 13 13 14 / 12 13 13 13 14 / 17 18 18 18 19 / 22 23 23 23 24"),
    ((5, 5), (9.9886, 53.5499), 0.0003, "EPSG:4326", "12 12 12 13 13 / 17 17 17 18 18 / 17 17 17 18 18 / 22 17 17 18 18 / 22 22 22 23 23"),
]


@pytest.mark.parametrize("size,xy_min,res,crs,expected", REPROJECT)
def test_reproject(spark, size, xy_min, res, crs, expected):
    same(reproject_dataset(utm_5x5(spark), regular(size, xy_min, res, crs)).image("band_1"), table(expected))


def test_reproject_axis_directions(spark):
    size, xy_min, res, crs, expected = REPROJECT[0]
    up = reproject_dataset(utm_5x5(spark), regular(size, xy_min, res, crs, is_j_axis_up=True))
    same(up.image("band_1"), table(expected)[::-1])
    same(reproject_dataset(utm_5x5(spark, up=True), regular(size, xy_min, res, crs)).image("band_1"), table(expected))


@pytest.mark.parametrize("method,corner", [("triangular", 6353.582), ("bilinear", 6353.5823)])
def test_reproject_large_cube(spark, method, corner):
    from gridloom.sources.infer import grid_from_axes

    grid = grid_from_axes(np.linspace(3.9e6, 4.5e6, 100), np.linspace(2.6e6, 3.2e6, 100), "EPSG:3035", tile_size=25)
    df = spark.range(10000).selectExpr("0 AS k", "id div 100 AS j", "id % 100 AS i", "CAST(id AS float) AS temperature")
    cube = GridFrame.from_dataframe(df, grid, leading=["k"])
    out = reproject_dataset(cube, regular((10, 10), (6, 48), 0.2, tile_size=5), interp_methods=method).image("temperature")[0]
    same(out[0][0], corner, rtol=2e-6)
    same(out[-1][-1], 3007.1228, rtol=2e-6)


def test_reproject_method_errors(spark):
    with pytest.raises(NotImplementedError):
        reproject_dataset(utm_5x5(spark), regular((5, 5), (4320080, 3382480), 80, "EPSG:3035"), interp_methods="cubic")


def test_rectify_4x4(spark):
    same(rectify_dataset(swath_2x2(spark), regular((4, 4), (-1, 49), 2), interp_methods="nearest").image("rad"), table("n n n n / n 1 2 n / 3 3 2 n / n 4 n n"))


def test_rectify_default_target(spark):
    out = rectify_dataset(swath_2x2(spark, tile_size=2), interp_methods="nearest")
    assert out.grid.size == (4, 4) and out.grid.xy_bbox == (-2, 48, 14, 64) and out.grid.xy_res == (4, 4) and out.grid.tile_size == (2, 2)
    expected = np.full((4, 4), np.nan)
    expected[2, 1] = 2
    same(out.image("rad"), expected)


RECTIFIED = {
    "nearest": "n 1 n n n n n / n 1 1 n n n n / n 1 1 1 2 n n / n 3 3 1 2 2 2 / 3 3 3 5 2 n n / n 3 5 5 n n n / n n 5 n n n n",
    "triangular": "n 1 n n n n n / n 1.478 1.391 n n n n / n 1.957 1.870 1.784 1.697 n n / n 2.435 2.348 2.261 2.174 2.087 2 / 3 3 3 3 3 n n / n 4 4 4 n n n / n n 5 n n n n",
    "bilinear": "n 1 n n n n n / n 1.488 1.410 n n n n / n 1.994 1.949 1.858 1.722 n n / n 2.520 2.506 2.448 2.344 2.195 2 / 3 3.112 3.163 3.153 3.082 n n / n 4 4.041 4.020 n n n / n n 5 n n n n",
}


@pytest.mark.parametrize("method", RECTIFIED)
def test_rectify_7x7(spark, method):
    out = rectify_dataset(swath_2x2(spark, 1.0), regular((7, 7), (-0.5, 49.5), 1), interp_methods=method)
    same(out.image("rad"), table(RECTIFIED[method]), atol=1.5e-3)


SHARED = table("""
n n 1 n n n n n n n n n n
n n 1 1 n n n n n n n n n
n n 1 1 1 1 n n n n n n n
n n 1 1 1 1 1 1 n n n n n
n 1 1 1 1 1 1 2 2 n n n n
n 3 3 1 1 1 1 2 2 2 2 n n
n 3 3 3 3 1 1 2 2 2 2 2 2
n 3 3 3 3 3 1 2 2 2 2 n n
3 3 3 3 3 4 4 2 2 2 n n n
n 3 3 3 4 4 4 4 2 n n n n
n n 3 4 4 4 4 n n n n n n
n n n 4 4 4 n n n n n n n
n n n n 4 n n n n n n n n
""")


@pytest.mark.parametrize("tile,up", [(13, False), (7, False), (5, True), ((3, 13), False)])
def test_rectify_13x13(spark, tile, up):
    target = regular((13, 13), (-0.25, 49.75), 0.5, tile_size=tile, is_j_axis_up=up)
    same(rectify_dataset(swath_2x2(spark), target, interp_methods="nearest").image("rad"), SHARED[::-1] if up else SHARED)


def test_rectify_antimeridian(spark):
    source = swath(spark, [[179, -176], [178, 180]], [[56, 53], [52, 50]], [[1, 2], [3, 4]])
    target = regular((13, 13), (177.75, 49.75), 0.5)
    assert source.grid.is_lon_360 and target.is_lon_360
    out = rectify_dataset(source, target, interp_methods="nearest")
    same(out.image("rad"), SHARED)
    lon = [r.lon for r in out.grid.to_coords(spark=spark)[0].orderBy("i").collect()]
    same(lon, [178 + 0.5 * i if i <= 4 else -180 + 0.5 * (i - 4) for i in range(13)])


@pytest.mark.parametrize("xy_min", [(10, 50), (-10, 50), (0, 60), (0, 40)])
def test_rectify_without_overlap(spark, xy_min):
    out = rectify_dataset(swath_2x2(spark), regular((5, 5), xy_min, 0.5), interp_methods="nearest")
    assert np.isnan(out.image("rad")).all()


def test_rectify_other_system(spark):
    out = rectify_dataset(swath_4x4(spark), regular((3, 3), (3600000, 3200000), 100000, "EPSG:3035"), interp_methods="nearest")
    same(out.image("rad"), table("10 6 3 / 10 7 3 / 11 11 8"))


@pytest.mark.parametrize("method,expected", [("nearest", "5 2 / 14 8"), ("bilinear", "7.5 4.5 / 12.5 9.5")])
def test_dispatch_to_rectify_with_downscale(spark, method, expected):
    same(resample_in_space(swath_4x4(spark), regular((2, 2), (-1, 51), 2), interp_methods=method).image("rad"), table(expected))


def test_dispatch(spark, caplog):
    own = grid_8x6(spark)
    assert resample_in_space(own, own.grid) is own
    assert resample_in_space(own) is own and "target_gm" in caplog.text
    same(resample_in_space(own, regular((3, 3), (50, 10), 0.1)).image("refl"), table("1 0 2 / 0 3 0 / 4 0 1"), atol=1e-7)
    with pytest.raises(ValueError):
        resample_in_space(own, swath_2x2(spark).grid)
    size, xy_min, res, crs, expected = REPROJECT[0]
    same(resample_in_space(utm_5x5(spark), regular(size, xy_min, res, crs)).image("band_1"), table(expected))


@pytest.fixture(scope="module")
def globe(spark):
    """A source of whole degrees with its own places as values; low is the first longitude."""

    def make(low=-180):
        df = spark.range(180 * 360).select(F.expr("id div 360").alias("j"), F.expr("id % 360").alias("i"))
        df = df.withColumns({"lat": F.expr("89.5D - j"), "lon": F.expr(f"i + {low} + 0.5D - 360 * CAST(i + {low} >= 180 AS int)")})
        return GridFrame.from_dataframe(df, GridMapping.regular((360, 180), (low, -90), 1, "EPSG:4326"))

    return make


@pytest.mark.parametrize("crs, far", [("EPSG:6931", 89), ("EPSG:6932", -89), ({"grid_mapping_name": "lambert_azimuthal_equal_area", "longitude_of_projection_origin": 10, "latitude_of_projection_origin": 80}, 89)])
@pytest.mark.parametrize("size, res", [((40, 40), 150_000), ((15, 15), 160_000)])
def test_targets_around_a_pole_have_data_everywhere(globe, crs, far, size, res):
    target = GridMapping.regular(size, (-size[0] * res / 2, -size[1] * res / 2), res, CRS.from_any(crs))
    rows = reproject_dataset(globe(), target, variables="lat", interp_methods="nearest").df.select("lat").collect()
    assert len(rows) == size[0] * size[1] and not any(math.isnan(r.lat) for r in rows)
    assert (max if far > 0 else min)(r.lat for r in rows) in (far + 0.5, far - 0.5)
    low, _, high, top = project_bounds(target.crs, CRS.from_any("EPSG:4326"), target.xy_bbox)
    assert (low, high) == (-180, 180) and (top == 90 or far < 0)


@pytest.mark.parametrize("low", [-180, 0])
def test_targets_across_the_antimeridian_have_data_everywhere(globe, low):
    target = GridMapping.regular((8, 2), (700_000, 0), 25_000, "EPSG:32660")
    rows = reproject_dataset(globe(low), target, variables="lon", interp_methods="nearest").df.where("j = 1").orderBy("i").collect()
    assert [r.lon for r in rows] == [178.5] + [179.5] * 4 + [-179.5] * 3
    x0, _, x1, _ = project_bounds(target.crs, CRS.from_any("EPSG:4326"), target.xy_bbox)
    assert 178 < x0 < 179 and 180 < x1 < 181


def test_polar_equal_area_goes_there_and_back():
    for code, lat in (("EPSG:6931", 71.25), ("EPSG:6932", -71.25), ("EPSG:3572", 50.0)):
        for lon in (-179.0, -20.0, 135.0, 180.0):
            x, y = project_point(CRS.from_any("EPSG:4326"), CRS.from_any(code), lon, lat)
            assert project_point(CRS.from_any(code), CRS.from_any("EPSG:4326"), x, y) == pytest.approx((lon, lat), abs=1e-7)
