import glob
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import GRID_8X6, frame, grid_8x6, regular, swath_2x2, swath_4x4

from gridloom import queries
from gridloom.functions.reducers import reducer
from gridloom.operators.affine import affine_transform_dataset
from gridloom.operators.rectify import rectify_dataset
from gridloom.operators.tiles import coarsen, compute_from_blocks, tile_frame
from gridloom.plans import options
from gridloom.plans.grid import GridMapping
from gridloom.plans.sql import register
from gridloom.sources.frame import GridFrame, clip_by_bbox
from gridloom.sources import tables
from gridloom.sources.tables import read_frame, write_frame
from gridloom.streaming.resample import resample_stream

NAN = math.nan


def reduced(spark, name, values, dtype="float64"):
    rows = [(j, i, v) for j, row in enumerate(values) for i, v in enumerate(row)]
    df = spark.createDataFrame(rows, f"wj long, wi long, v {'long' if dtype.startswith('int') else 'double'}")
    return df.agg(reducer(name, F.col("v"), F.col("wj"), F.col("wi"), len(values), len(values[0]), dtype).alias("r")).first().r


SQUARE = [[1.0, 2.0], [3.0, 4.0]]


@pytest.mark.parametrize("name,want", [("first", 1), ("last", 4), ("center", 4), ("mean", 2.5), ("median", 2.5), ("std", math.sqrt(1.25)), ("var", 1.25), ("sum", 10), ("prod", 24), ("max", 4), ("min", 1), ("count", 4)])
def test_reducers(spark, name, want):
    assert reduced(spark, name, SQUARE) == pytest.approx(want)


@pytest.mark.parametrize("name,want", [("first", NAN), ("center", 0.0), ("mean", 1.0), ("sum", 3.0), ("prod", 0.0), ("max", 2.0), ("min", 0.0), ("count", 3), ("median", 1.0)])
def test_reducers_and_nan(spark, name, want):
    assert reduced(spark, name, [[NAN, 2.0], [1.0, 0.0]]) == pytest.approx(want, nan_ok=True)


@pytest.mark.parametrize("name,want", [("mean", NAN), ("max", NAN), ("std", NAN), ("sum", 0.0), ("prod", 1.0), ("count", 4), ("last", NAN)])
def test_reducers_of_nothing_but_nan(spark, name, want):
    assert reduced(spark, name, [[NAN, NAN], [NAN, NAN]]) == pytest.approx(want, nan_ok=True)


@pytest.mark.parametrize("name,want", [("mean", 2), ("median", 2), ("sum", 10), ("std", 1), ("var", 1), ("max", 4)])
def test_reducers_of_integers(spark, name, want):
    assert reduced(spark, name, [[1, 2], [3, 4]], "int64") == want


def test_mode(spark):
    assert reduced(spark, "mode", [[1, 2, 2], [3, 2, 2]], "int64") == 2 and reduced(spark, "mode", [[3, 1], [1, 3]], "int64") == 1
    with pytest.raises(KeyError):
        reduced(spark, "range", SQUARE)


def test_options(caplog):
    assert options.method_of(None, "v", "float32") == "bilinear" and options.method_of(None, "v", "uint8") == "nearest" and options.method_of(None, "v", "bool") == "bilinear"
    assert options.method_of({"v": 0, "float32": 1}, "v", "float32") == "nearest" and options.method_of({"float32": 1}, "w", "float32") == "bilinear"
    assert options.method_of({"x": 0}, "v", "int16") == "nearest" and "interpolation method of variable 'v'" in caplog.text
    with pytest.raises(KeyError):
        options.method_of(2, "v", "float32")
    with pytest.raises(ValueError):
        options.method_of(2, "v", "float32", ("nearest", "bilinear"))
    assert options.reducer_of(None, "v", "int8") == "center" and options.reducer_of({"float64": "max"}, "v", "float64") == "max"
    assert options.recover_of({"v": True}, "v", "float64") is True and options.recover_of(None, "v", "float64") is False
    assert [options.fill_of(None, "v", k) for k in ("uint8", "uint16", "int64", "uint32")] == [255, 65535, -1, -1] and math.isnan(options.fill_of(None, "v", "float32"))
    assert options.fill_of({"v": 3}, "v", "uint8") == 3
    assert options.downscale_methods({"v": "triangular", "w": 0}) == {"v": "bilinear", "w": 0}


def test_clip(spark, caplog):
    own = grid_8x6(spark)
    cut = clip_by_bbox(own, (50.05, 10.05, 50.25, 10.15))
    assert cut.grid.size == (3, 2)
    np.testing.assert_allclose(cut.image("refl"), GRID_8X6[4:, :3])
    np.testing.assert_allclose(cut.grid.xy_bbox, (50.0, 10.0, 50.3, 10.2))
    with pytest.raises(ValueError, match="4 values"):
        clip_by_bbox(own, (1, 2, 3))
    assert clip_by_bbox(own, (0, 0, 1, 1)).df.count() == 0 and "zero-sized" in caplog.text
    cut = clip_by_bbox(swath_4x4(spark), (0, 53, 3, 57))
    assert cut.df.count() == cut.grid.pixels.count() > 0


def test_selection_and_kinds(spark):
    df = spark.createDataFrame([(0, 0, 1, True, 1.5, "s")], "j int, i int, a short, b boolean, c float, d string")
    own = GridFrame.from_dataframe(df, regular((2, 2), (0, 0), 1), kinds={"a": "uint8"})
    assert own.variables == {"a": "uint8", "b": "bool", "c": "float32"} and own.df.schema["b"].dataType.simpleString() == "double"
    assert list(own.select("c").variables) == ["c"] and list(own.select(["a", "c"]).variables) == ["a", "c"] and own.select(None) is own
    with pytest.raises(KeyError):
        own.select(["nope"])
    assert own.with_spatial_ref().attrs["grid_mapping"] == "spatial_ref"


@pytest.mark.parametrize("make", [grid_8x6, swath_2x2])
def test_written_frames_come_back(spark, tmp_path, make):
    own = make(spark)
    write_frame(own, str(tmp_path / "t"))
    again = read_frame(spark, str(tmp_path / "t"))
    name = next(iter(own.variables))
    np.testing.assert_allclose(again.image(name), own.image(name))
    assert again.grid.size == own.grid.size and again.grid.xy_bbox == own.grid.xy_bbox and again.grid.crs.equals(own.grid.crs) and again.variables == own.variables
    assert (again.grid.pixels is None) == (own.grid.pixels is None)
    files = {os.path.basename(p) for p in glob.glob(str(tmp_path / "t" / "*"))}
    assert "zone=0" in files


def test_tiles_and_blocks(spark):
    grid = regular((7, 5), (0, 0), 1, tile_size=(3, 2))
    assert [tuple(r)[1:5] for r in tile_frame(grid, spark).orderBy("tile_id").collect()] == grid.ij_bboxes
    assert [tuple(r)[5:] for r in tile_frame(grid, spark).orderBy("tile_id").collect()] == [tuple(map(float, b)) for b in grid.xy_bboxes]
    seen = compute_from_blocks(grid, lambda b, k: np.full(b["block_shape"], b["block_index"][0] * 10 + b["block_index"][1] + k), "v", "int64", (100,), spark)
    assert {(r.j, r.i): r.v for r in seen.collect()} == {(j, i): 100 + j // 2 * 10 + i // 3 for j in range(5) for i in range(7)}


def test_coarsen_leaves_out_windows_that_are_not_whole(spark):
    own = frame(spark, [[float(j * 5 + i) for i in range(5)] for j in range(5)], regular((5, 5), (0, 0), 1), "v")
    assert {(r.j, r.i): r.v for r in coarsen(own, 2, 2, "max").collect()} == {(0, 0): 6, (0, 1): 8, (1, 0): 16, (1, 1): 18}


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_plans_stay_in_the_engine(spark):
    """No Python, no range joins, and one exchange for an affine map of a broadcastable axis."""
    own = grid_8x6(spark)
    affine = plan_of(affine_transform_dataset(own, regular((8, 6), (50, 10), 0.05)).df)
    rectified = plan_of(rectify_dataset(swath_2x2(spark), regular((7, 7), (-0.5, 49.5), 1)).df)
    for plan in (affine, rectified):
        physical = plan.split("== Physical Plan ==")[1]
        assert "Python" not in physical and "Pandas" not in physical and "BroadcastNestedLoopJoin" not in physical and "CartesianProduct" not in physical
    assert affine.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1


def test_columns_are_pruned_down_to_the_scan(spark, tmp_path):
    own = frame(spark, GRID_8X6.tolist(), regular((8, 6), (50, 10), 0.1), "refl")
    own.df.withColumn("other", F.lit(1.0)).write.parquet(str(tmp_path / "p"))
    wide = GridFrame.from_dataframe(spark.read.parquet(str(tmp_path / "p")), own.grid)
    plan = plan_of(affine_transform_dataset(wide, regular((3, 3), (50, 10), 0.1), variables="refl").df)
    scan = next(line for line in plan.splitlines() if "ReadSchema" in line)
    assert "other" not in scan.split("ReadSchema")[1]


def test_views(spark):
    register(grid_8x6(spark), "refl_view")
    assert spark.sql("SELECT max(refl) AS m FROM refl_view WHERE NOT isnan(refl)").first().m == 4
    assert spark.sql("SELECT count(*) AS n FROM refl_view_grid").first().n == 48 and spark.sql("SELECT * FROM refl_view_tiles").count() == 1


def test_streams_of_scenes(spark, tmp_path):
    own = grid_8x6(spark)
    own.df.selectExpr("1 AS scene", "*").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("scene int, j long, i long, refl double").parquet(str(tmp_path / "in"))
    query = resample_stream(stream, own.grid, regular((3, 3), (50, 10), 0.1), str(tmp_path / "out"), str(tmp_path / "check"), leading=("scene",))
    query.awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("j", "i").collect()
    assert [r.refl for r in rows] == [1, 0, 2, 0, 3, 0, 4, 0, 1] and {r.scene for r in rows} == {1}


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the synthetic tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = queries.QUERIES[name](spark, DATA).toPandas()
    want = con.execute(queries.ORACLE_SQL[name]).df()[list(got.columns)]
    plain = lambda df: sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    assert plain(got) == plain(want)


def test_small_windows_read_few_files(spark, tmp_path):
    grid = GridMapping.regular((160, 120), (0, 0), 1, "EPSG:3857", tile_size=(10, 10))
    pixels = spark.range(160 * 120).select(F.expr("id div 160").alias("j"), F.expr("id % 160").alias("i"), F.col("id").cast("double").alias("v"))
    tables.write_frame(GridFrame.from_dataframe(pixels, grid), str(tmp_path / "t"))
    whole = tables.read_frame(spark, str(tmp_path / "t"))
    assert whole.df.count() == 160 * 120 and whole.grid == grid and whole.df.columns == ["j", "i", "v"]
    part = tables.read_frame(spark, str(tmp_path / "t"), window=(35, 52, 47, 61))
    assert sorted((r.j, r.i, r.v) for r in part.df.collect()) == [(j, i, 160.0 * j + i) for j in range(52, 61) for i in range(35, 47)]
    files = {f for f in (tmp_path / "t").rglob("*.parquet")}
    zones = {f.parent.name for f in files}
    read = {r.f.split("/")[-2] for r in part.df.select(F.input_file_name().alias("f")).distinct().collect()}
    # Twelve by sixteen tiles are as many zones; the window meets four of them.
    assert len(zones) == 192 and len(read) == 4
    plan = part.df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [zone#" in plan
    assert tables.zone_side(GridMapping.regular((100_000, 50_000), (0, 0), 1, "EPSG:3857", tile_size=(512, 512))) == 8
