import math
from fractions import Fraction

import numpy as np
import pytest
from samples import regular, swath_2x2

from gridloom.plans import crs
from gridloom.plans.crs import CRS, CRS_CRS84, CRS_WGS84, project, project_bounds, project_point
from gridloom.plans.grid import GridMapping, from_lon_360, number, round_to_fraction, to_lon_360
from gridloom.sources.infer import (
    Dataset, Variable, chunk_sizes, find_grid_mappings, frame_from_dataset, grid_from_axes, grid_from_dataset, grid_from_pixels, grid_mapping_name, normalized, spatial_dims, xy_bbox_of,
)

PLANE = CRS.from_any("EPSG:5243")
WORLD = regular((720, 360), (-180, -90), 0.5, tile_size=(360, 180))


def test_properties():
    assert (WORLD.width, WORLD.height, WORLD.tile_width, WORLD.tile_height, WORLD.is_tiled) == (720, 360, 360, 180, True)
    assert WORLD.ij_bbox == (0, 0, 720, 360) and WORLD.xy_bbox == (-180, -90, 180, 90) and WORLD.xy_res == (0.5, 0.5)
    assert WORLD.spatial_unit_name == "degree" and not WORLD.is_lon_360 and not WORLD.is_j_axis_up
    assert WORLD.ij_bboxes == [(0, 0, 360, 180), (360, 0, 720, 180), (0, 180, 360, 360), (360, 180, 720, 360)]
    assert WORLD.xy_bboxes == [(-180, 0, 0, 90), (0, 0, 180, 90), (-180, -90, 0, 0), (0, -90, 180, 0)]


@pytest.mark.parametrize("options,message", [((1, (0, 0), 1), "invalid size"), (((5, 5), (0, 0), 0), "invalid xy_res"), (((5, 5), (0, -91), 1), "invalid y_min"), (((5, 5), (0, 88), 1), "invalid size, y_min combination")])
def test_invalid_regular_grids(options, message):
    with pytest.raises(ValueError, match=message):
        regular(*options)


def test_tile_boxes_with_axis_up():
    grid = GridMapping.regular((2000, 1000), (10.0, 20.0), 0.1, PLANE).derive(tile_size=500, is_j_axis_up=True)
    np.testing.assert_allclose(grid.xy_bboxes[:5], [(10, 20, 60, 70), (60, 20, 110, 70), (110, 20, 160, 70), (160, 20, 210, 70), (10, 70, 60, 120)])
    np.testing.assert_allclose(grid.derive(is_j_axis_up=False).xy_bboxes[0], (10, 70, 60, 120))


def test_matrices():
    plane = GridMapping.regular((1200, 1200), (0, 0), 1, PLANE)
    assert plane.ij_to_xy_transform == ((1, 0, 0), (0, -1, 1200)) == plane.xy_to_ij_transform
    up = regular((1440, 720), (-180, -90), 0.25, is_j_axis_up=True)
    assert up.ij_to_xy_transform == ((0.25, 0, -180), (0, 0.25, -90)) and up.xy_to_ij_transform == ((4, 0, 720), (0, 4, 360))
    fine = regular((1000, 1000), (10, 50), 0.025, is_j_axis_up=True)
    for got, want in ((up.ij_transform_to(fine), ((10, 0, -7600), (0, 10, -5600))), (fine.ij_transform_from(up), ((10, 0, -7600), (0, 10, -5600))), (fine.ij_transform_to(up), ((0.1, 0, 760), (0, 0.1, 560)))):
        np.testing.assert_allclose(got, want, atol=1e-9)


def test_index_boxes(spark):
    cases = [((-180, -90, 180, 90), 0, (0, 0, 720, 360)), ((-180, -90, 0, 0), 0, (0, 180, 360, 360)), ((0, 0, 180, 90), 0, (360, 0, 720, 180)), ((-180, -90, 0, 0), 1, (0, 179, 361, 360)), ((-190, -100, -170, -80), 1, (0, 339, 21, 360)), ((-190, -100, -180, -90), 1, (-1, -1, -1, -1))]
    for box, border, want in cases:
        assert WORLD.ij_bbox_from_xy_bbox(box, ij_border=border) == want
    small = regular((8, 6), (50, 10), 0.5)
    explicit = GridMapping(**{**small.__dict__, "pixels": small.pixel_frame(spark)})
    boxes = [(50.3, 10.3, 52.1, 12.2), (0, 0, 1, 1), (50, 10, 60, 60)]
    assert explicit.ij_bboxes_from_xy_bboxes(boxes, ij_border=1) == small.ij_bboxes_from_xy_bboxes(boxes, ij_border=1)
    assert small.ij_bbox_from_xy_bbox((50.3, 10.3, 50.4, 10.4), xy_border=0.5) == (0, 4, 2, 6)


def test_derive_and_scale_and_close():
    assert WORLD.derive(xy_var_names=("u", "v")).xy_var_names == ("u", "v")
    with pytest.raises(ValueError):
        WORLD.derive(xy_var_names=("u", "u"))
    half = WORLD.scale(0.5)
    assert half.size == (360, 180) and half.xy_res == (1, 1) and half.tile_size == (360, 180) and half.xy_bbox == WORLD.xy_bbox
    assert WORLD.scale((0.25, 0.5), tile_size=100).size == (180, 180)
    assert WORLD.is_close(regular((720, 360), (-180 + 1e-7, -90), 0.5, tile_size=(360, 180)))
    assert not WORLD.is_close(WORLD.derive(tile_size=180)) and not WORLD.is_close(WORLD.derive(is_j_axis_up=True)) and not WORLD.is_close(half)


def test_irregular_grids_refuse(spark):
    grid = swath_2x2(spark).grid
    with pytest.raises(NotImplementedError):
        _ = grid.ij_to_xy_transform
    with pytest.raises(ValueError, match="must be a regular"):
        grid.assert_regular()


def test_to_coords(spark):
    def ends(grid, names):
        xs, ys = grid.to_coords(names, spark=spark)
        out = []
        for df, n, k in ((xs, names[0], "i"), (ys, names[1], "j")):
            rows = df.orderBy(k).collect()
            out += [rows[0][n], rows[-1][n], tuple(rows[0][f"{n}_bnds"]), tuple(rows[-1][f"{n}_bnds"])]
        return out

    plane = GridMapping.regular((10, 6), (-2600.0, 1200.0), 10.0, PLANE)
    assert ends(plane, ("x", "y")) == [-2595, -2505, (-2600, -2590), (-2510, -2500), 1255, 1205, (1260, 1250), (1210, 1200)]
    assert ends(plane.derive(is_j_axis_up=True), ("x", "y"))[4:] == [1205, 1255, (1200, 1210), (1250, 1260)]
    assert ends(regular((10, 10), (172.0, 53.0), 2.0), ("lon", "lat")) == [173, -169, (172, 174), (-170, -168), 72, 54, (73, 71), (55, 53)]


def test_to_coords_names_dimensions_and_takes_values_of_axes(spark):
    xs, ys = regular((4, 3), (10.0, 50.0), 1.0).to_coords(("u", "v"), xy_dim_names=("col", "row"), exclude_bounds=True, spark=spark)
    assert xs.columns == ["col", "u"] and ys.columns == ["row", "v"]
    uneven = grid_from_axes([0.0, 1.0, 2.5, 3.5], [0.0, 2.0, 4.5], PLANE)
    xs, ys = uneven.to_coords(reuse_coords=True, spark=spark)
    assert [r.x for r in xs.orderBy("i").collect()] == [0.0, 1.0, 2.5, 3.5] and [r.y for r in ys.orderBy("j").collect()] == [0.0, 2.0, 4.5]
    assert xs.columns == ["i", "x"] and xs.schema["x"].metadata["standard_name"] == "projection_x_coordinate"
    # A grid without axes of its own has its coordinates computed.
    xs, _ = regular((4, 3), (10.0, 50.0), 1.0).to_coords(reuse_coords=True, spark=spark)
    assert [r.lon for r in xs.orderBy("i").collect()] == [10.5, 11.5, 12.5, 13.5]
    with pytest.raises(ValueError, match="xy_dim_names"):
        uneven.to_coords(xy_dim_names=("a", "a"), spark=spark)


@pytest.mark.parametrize("value,digits,step,want", [
    (1.2, 1, 0.25, "5/4"), (1.45, 1, 0.25, "3/2"), (1.9, 1, 0.25, "2"), (1.23, 2, 0.25, "49/40"), (1.98, 2, 0.25, "79/40"), (-1, 1, 0.25, "-1"), (0, 2, 1, "0"),
    (5.247476065426347e-09, 2, 1, "13/2500000000"), (84.54360269093455, 2, 1, "85"), (494.86581234602096, 2, 1, "490"), (1143506.2928512183, 2, 1, "1100000"), (0.030607346091352187, 3, 0.25, "153/5000"),
])
def test_rounding_to_fractions(value, digits, step, want):
    assert round_to_fraction(value, digits, step) == Fraction(want)


def test_rounding_errors_and_numbers():
    for options in ({"digits": 0}, {"resolution": 0}, {"resolution": 0.12}):
        with pytest.raises(ValueError):
            round_to_fraction(0.29, **options)
    assert number(3.0000000001) == 3 and isinstance(number(3.0), int) and number(2.5) == 2.5
    assert [to_lon_360(x) for x in (-180, -0.5, 0, 179)] == [180, 359.5, 0, 179] and [from_lon_360(x) for x in (180, 180.5, 360)] == [180, -179.5, 0]


def test_projected_pixel_centres(spark):
    grid = regular((3, 3), (10, 53), 0.1, "OGC:CRS84").transform("EPSG:32632", spark=spark)
    rows = grid.pixels.orderBy("j", "i").collect()
    xs = [570057.076286, 576728.9360228, 583400.7295284, 570220.3304187, 576907.7404859, 583595.0849538, 570383.3684844, 577086.3083212, 583789.1831954]
    ys = [5900595.928991, 5900698.5746648, 5900810.5532744, 5889471.9033896, 5889574.6540572, 5889686.7472201, 5878348.0594403, 5878450.9138481, 5878563.1201969]
    np.testing.assert_allclose([r.x for r in rows], xs, atol=1e-6)
    np.testing.assert_allclose([r.y for r in rows], ys, atol=1e-6)
    assert grid.xy_var_names == ("transformed_x", "transformed_y") and grid.size == (3, 3)


@pytest.mark.parametrize("name", ["EPSG:32633", "EPSG:32733", "EPSG:3035", "EPSG:3857", "EPSG:3034", "EPSG:2154", "EPSG:5243"])
def test_projections_return(spark, name):
    points = [(7.5, 48.25), (13.0, 52.0), (10.0, 52.0)]
    crs = CRS.from_any(name)
    df = spark.createDataFrame([(n, *p, "kept") for n, p in enumerate(points)], "lon int, x double, y double, lat string")
    moved = project(df, CRS_WGS84, crs)
    assert moved.columns == df.columns
    for r in moved.collect():
        np.testing.assert_allclose((r.x, r.y), project_point(CRS_WGS84, crs, *points[r.lon]), rtol=1e-12)
    again = {r.lon: (r.x, r.y) for r in project(moved, crs, CRS_WGS84).collect()}
    np.testing.assert_allclose([again[n] for n in range(3)], points, atol=1e-7)


def test_systems():
    assert CRS_WGS84.equals(CRS_CRS84) and not CRS_WGS84.equals(PLANE) and PLANE.unit_name == "metre"
    told = CRS.from_any({"grid_mapping_name": "transverse_mercator", "longitude_of_central_meridian": 9.0, "scale_factor_at_central_meridian": 0.9996, "false_easting": 500000.0})
    assert told.equals(CRS.from_any("EPSG:32632")) and CRS.from_any(told.to_cf()).equals(told)
    for bad in ("EPSG:999999", {"grid_mapping_name": "vertical_perspective"}, 7):
        with pytest.raises(ValueError, match="unsupported CRS"):
            CRS.from_any(bad)
    box = project_bounds(CRS_WGS84, CRS.from_any("EPSG:3035"), (5, 45, 15, 55))
    assert box[0] < project_point(CRS_WGS84, CRS.from_any("EPSG:3035"), 5, 50)[0] < box[2]


def test_grids_from_axes():
    grid = grid_from_axes([0.5 + i for i in range(8)], [5.5 - j for j in range(6)], "EPSG:4326", tile_size=(4, 3))
    assert grid.is_regular and grid.size == (8, 6) and grid.xy_bbox == (0, 0, 8, 6) and grid.tile_size == (4, 3) and grid.xy_var_names == ("lon", "lat")
    assert grid_from_axes([0.0, 1.0, 2.0], [0.0, 1.0, 2.0], PLANE).is_j_axis_up
    uneven = grid_from_axes([0.0, 1.0, 2.5, 4.5], [0.0, 1.0, 3.0], PLANE)
    assert not uneven.is_regular and uneven.xy_res == (1.5, 1.5) and uneven.x_coords == (0, 1, 2.5, 4.5)
    wide = grid_from_axes([178.5, 179.5, -179.5, -178.5], [1.0, 0.0], CRS_WGS84)
    assert wide.is_lon_360 and wide.xy_bbox[:3:2] == (178, 182)
    with pytest.raises(ValueError):
        grid_from_axes([1.0], [1.0, 2.0], PLANE)
    with pytest.raises(ValueError):
        grid_from_axes([1.0, 2.0], [1.0, 2.0], PLANE, tolerance=0.0)


def test_grids_from_pixels(spark):
    own = swath_2x2(spark, tile_size=2).grid
    assert own.xy_res == (4, 4) and not own.is_regular and not own.is_j_axis_up
    target = own.to_regular()
    assert target.size == (4, 4) and target.xy_bbox == (-2, 48, 14, 64)
    even = regular((6, 5), (10, 50), 0.5)
    got = grid_from_pixels(even.pixel_frame(spark), CRS_WGS84)
    assert got.is_regular and got.size == (6, 5) and got.xy_bbox == even.xy_bbox and got.pixels is not None
    nan = spark.createDataFrame([(0, 0, math.nan, 1.0), (0, 1, 2.0, math.nan), (1, 0, 5.0, 3.0)], "j long, i long, x double, y double")
    assert xy_bbox_of(nan) == (2, 1, 5, 3) and all(math.isnan(v) for v in xy_bbox_of(nan.limit(0)))


def test_to_regular_after_transform(spark):
    grid = regular((1000, 1000), (10, 53), 0.01 / 4, "OGC:CRS84").transform("EPSG:32633", xy_res=1000, spark=spark)
    assert not grid.is_regular and grid.xy_res == (1000, 1000) and grid.to_regular().xy_res == (1000, 1000)


X, Y = Variable(("x",), {}, [0.5, 1.5, 2.5]), Variable(("y",), {}, [2.5, 1.5, 0.5])


def test_grid_mapping_discovery(spark):
    lonlat = {"lon": Variable(("lon",), {}, X.values), "lat": Variable(("lat",), {}, Y.values)}
    assert grid_from_dataset(Dataset(lonlat)).crs.is_geographic
    named = {"a": Variable(("r",), {"standard_name": "projection_x_coordinate"}, X.values), "b": Variable(("s",), {"standard_name": "projection_y_coordinate"}, Y.values), "a_bnds": Variable(("r", "bnds"))}
    utm = Variable((), {"grid_mapping_name": "transverse_mercator", "longitude_of_central_meridian": 9.0, "scale_factor_at_central_meridian": 0.9996, "false_easting": 500000.0})
    ds = Dataset({**named, "crs": utm, "v": Variable(("s", "r"), {"grid_mapping": "crs"}, chunks=(2, 3))})
    found = find_grid_mappings(ds)
    assert {k: (f.x, f.y) for k, f in found.items()} == {"crs": ("a", "b")}
    grid = grid_from_dataset(ds)
    assert grid.crs.equals(CRS.from_any("EPSG:32632")) and grid.tile_size == (3, 2) and grid.xy_dim_names == ("r", "s")
    assert chunk_sizes(ds) == {"s": 2, "r": 3}
    odd = find_grid_mappings(Dataset({**named, "v": Variable(("s", "r"))}, {"grid_mapping_name": "latitude_longitude"}))
    assert [(f.x, f.y, f.crs.is_geographic) for f in odd.values()] == [("a", "b", True)]
    with pytest.warns(UserWarning, match="missing x- and/or y-coordinates"):
        find_grid_mappings(Dataset({"crs": utm, "v": Variable((), {"grid_mapping": "crs"})}), emit_warnings=True)
    with pytest.raises(ValueError, match="cannot find any grid mapping"):
        grid_from_dataset(Dataset({"v": Variable(("s", "r"))}))
    assert grid_from_dataset(Dataset({"x": X, "y": Y}), crs="EPSG:3035").crs.name == "EPSG:3035"
    rotated = Variable((), {"grid_mapping_name": "rotated_latitude_longitude", "grid_north_pole_latitude": 32.5, "grid_north_pole_longitude": 170.0})
    grid = grid_from_dataset(Dataset({"rlon": X, "rlat": Y, "pole": rotated, "v": Variable(("rlat", "rlon"), {"grid_mapping": "pole"})}))
    assert grid.crs.is_geographic and grid.xy_var_names == ("rlon", "rlat")


def test_preference_of_two_grids(spark):
    pixels = swath_2x2(spark).grid.pixels.selectExpr("j", "i", "x AS lon", "y AS lat")
    utm = Variable((), {"grid_mapping_name": "transverse_mercator", "longitude_of_central_meridian": 3.0, "scale_factor_at_central_meridian": 0.9996, "false_easting": 500000.0})
    ds = Dataset({"lon": Variable(("y", "x"), size=4), "lat": Variable(("y", "x"), size=4), "x": Variable(("x",), {}, [0.0, 10.0]), "y": Variable(("y",), {}, [10.0, 0.0]), "tm": utm, "v": Variable(("y", "x"), {"grid_mapping": "tm"})}, pixels=pixels)
    assert not grid_from_dataset(ds).crs.is_geographic
    assert grid_from_dataset(ds, prefer_is_regular=False).crs.is_geographic
    assert grid_from_dataset(ds, prefer_crs="EPSG:4326").crs.is_geographic


def test_datasets_as_frames(spark):
    pixels = spark.createDataFrame([(t, j, i, float(i)) for t in "ab" for j in range(3) for i in range(3)], "time string, j long, i long, v double")
    ds = Dataset({"lon": Variable(("lon",), {}, X.values), "lat": Variable(("lat",), {}, Y.values), "v": Variable(("time", "lat", "lon")), "crs": Variable((), {"grid_mapping_name": "latitude_longitude"}), "series": Variable(("time",)), "t": Variable(("lon", "lat"))}, {"title": "q"}, pixels)
    assert spatial_dims(ds) == ("lon", "lat") and grid_mapping_name(ds) == "crs"
    frame = frame_from_dataset(ds, side={"series": spark.range(2), "t": spark.range(1)})
    assert list(frame.variables) == ["v"] and frame.leading == ("time",) and list(frame.side) == ["series"] and frame.attrs["title"] == "q"
    told = normalized(ds, frame.grid)
    assert "crs" not in told.variables and told.variables["v"].attrs["grid_mapping"] == "spatial_ref" and grid_mapping_name(told) == "spatial_ref"
    with pytest.raises(KeyError):
        spatial_dims(Dataset({"v": Variable(("r", "s"))}))
    with pytest.raises(AssertionError, match="Multiple grid mapping names"):
        grid_mapping_name(Dataset({"a": Variable((), {"grid_mapping": "p"}), "crs": Variable()}))


ELLIPSOID = {"semi_major_axis": 6378137.0, "inverse_flattening": 298.257223563}
FAMILY = {
    "EPSG:3413": [(-45, 70), (10, 80), (150, 61), (0, 89.999)], "EPSG:3031": [(0, -71), (10, -80), (150, -61)], "EPSG:32661": [(44, 73), (10, 80)], "EPSG:32761": [(44, -73)],
    "EPSG:5070": [(-96, 23), (-75, 35), (-110, 48)], "EPSG:3005": [(-126, 45), (-120, 59)], "EPSG:3577": [(132, 0), (150, -35), (115, -20)], "EPSG:3395": [(10, 50), (-179, -70)],
    "sinusoidal": [(10, 50), (-170, -60)], "rotated_latitude_longitude": [(18, 50.75), (10, 50), (-170, -80), (0, 89)], "geostationary": [(10, 50), (0, 0), (-60, -30), (40, 60)],
    "EPSG:27700": [(-1.7, 52.65), (-5, 58)], "EPSG:31467": [(9, 50)], "EPSG:4230": [(9, 50), (-8, 37)],
}


def _system(name):
    own = {
        "sinusoidal": {"earth_radius": 6371007.181}, "rotated_latitude_longitude": {"grid_north_pole_latitude": 39.25, "grid_north_pole_longitude": -162.0},
        "geostationary": {"perspective_point_height": 35785831.0, "longitude_of_projection_origin": 0.0, **ELLIPSOID},
    }
    return crs.CRS.from_any({"grid_mapping_name": name, **own[name]} if name in own else name)


@pytest.mark.parametrize("name", FAMILY)
def test_projections_there_and_back_within_a_millimetre(name):
    system = _system(name)
    for lon, lat in FAMILY[name]:
        x, y = crs.project_point(crs.CRS_WGS84, system, lon, lat)
        a, b = crs.project_point(system, crs.CRS_WGS84, x, y)
        away = max(abs((a - lon + 180) % 360 - 180) * math.cos(math.radians(lat)), abs(b - lat)) * 111_320
        # Datums lose the height between their ellipsoids on the way, some millimetres of place in all.
        assert away < (1e-3 if system.shifts == () else 3e-3)


def test_projections_at_known_places():
    at = lambda name, lon, lat: crs.project_point(crs.CRS_WGS84, _system(name), lon, lat)
    assert at("EPSG:32661", 44, 73) == pytest.approx((3320416.75, 632668.43), abs=0.01)
    assert at("rotated_latitude_longitude", 18, 50.75) == pytest.approx((0, 0), abs=1e-9)
    assert at("rotated_latitude_longitude", -162, 39.25)[1] == pytest.approx(90, abs=1e-6)
    assert at("geostationary", 120, 0)[0] > 1e11 and crs.project_point(_system("geostationary"), crs.CRS_WGS84, 5.5e6, 5.5e6)[1] > 1e11
    assert at("sinusoidal", 10, 0)[0] == pytest.approx(math.radians(10) * 6371007.181)
    # A place of the national grid, whose WGS 84 coordinates are known to some metres by seven parameters.
    assert at("EPSG:27700", 1.716073973, 52.658007833) == pytest.approx((651409.79, 313177.45), abs=5)


def test_systems_are_told_by_datum_and_pole():
    rotated = _system("rotated_latitude_longitude")
    assert rotated.is_geographic and not rotated.agrees(crs.CRS_WGS84) and crs.CRS_WGS84.agrees(crs.CRS_CRS84)
    assert not crs.CRS.from_any("EPSG:4230").agrees(crs.CRS_WGS84) and crs.CRS.from_any("EPSG:4258").agrees(crs.CRS_WGS84)
    named = crs.CRS.from_any({"grid_mapping_name": "latitude_longitude", "horizontal_datum_name": "European_Datum_1950"})
    assert named.equals(crs.CRS.from_any("EPSG:4230"))
    with pytest.raises(ValueError, match="unknown datum"):
        crs.CRS.from_any({"grid_mapping_name": "latitude_longitude", "horizontal_datum_name": "somewhere 1900"})
    for name in FAMILY:
        system = _system(name)
        assert crs.CRS.from_any(system.to_cf()).equals(system)


def test_bounds_across_a_rotated_pole():
    rotated = _system("rotated_latitude_longitude")
    x, y = crs.project_point(rotated, crs.CRS_WGS84, 0.0, 39.25)
    low = crs.project_bounds(rotated, crs.CRS_WGS84, (-5, 30, 5, 45))
    assert low[3] == 90.0 and (low[0], low[2]) == (-180.0, 180.0) and abs(y - 90) < 1e-6


def test_edges_of_large_grids_stay_where_they_are():
    # Within 1e-5 of a whole number, relatively, but half or a quarter of a pixel away from it.
    assert regular((64, 100000), (2.25, -3.5), 1, crs="EPSG:3857").y_max == 99996.5
    assert regular((64, 100003), (-20.5, 3.25), (0.5, 0.25), crs="EPSG:3857").y_max == 25004.0
    assert regular((64, 100001), (-20.5, 3.25), (0.5, 0.25), crs="EPSG:3857").y_max == 25003.5
    assert regular((10, 10), (10.00005, 50.0), 0.0004).x_min == 10.00005
    assert isinstance(regular((10, 10), (10, 50), 0.1).x_max, int)


def test_windows_on_a_grid_that_reaches_beyond_90(spark, tmp_path):
    from gridloom import queries

    spark.range(2000).selectExpr("id AS vec_id", "array_repeat(0.5f, 64) AS embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(0, 0), (1, 1), (486, 2)], "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    rows = {r.event_id: tuple(r)[1:] for r in queries.QUERIES["event_windows_regular"](spark, str(tmp_path)).collect()}
    # Rows are 0.08 high and end at 9 + 0.08 * 2000 = 169.
    assert len(rows) == 3 and rows[0] == (-1, -1, -1, -1) and rows[486][1] == max(0, int((169 - (8 + 0.091 * 486 + 0.0711 * 3 + 0.01)) / 0.08 - 0.5) + 1 - 2)
