"""Windows of pixels in boxes against brute force, and what rectification reads of a swath."""

import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import rectify, windows
from gridloom.operators.rectify import rectify_dataset
from gridloom.plans.grid import GridMapping
from gridloom.sources.frame import GridFrame
from gridloom.sources.infer import grid_from_pixels

NAN = math.nan


def skewed(spark, w, h, missing=lambda j, i: False):
    rows = [(j, i, *((NAN, NAN) if missing(j, i) else (10 + 0.1 * i + 0.02 * j, 50 - 0.1 * j + 0.03 * i))) for j in range(h) for i in range(w)]
    return rows, spark.createDataFrame(rows, "j long, i long, x double, y double")


def plain_window(rows, box, border, w, h, xy_border=0.0):
    x0, y0, x1, y1 = box[0] - xy_border, box[1] - xy_border, box[2] + xy_border, box[3] + xy_border
    hit = [(j, i) for j, i, x, y in rows if x0 <= x <= x1 and y0 <= y <= y1]
    if not hit:
        return (-1, -1, -1, -1)
    js, is_ = [j for j, _ in hit], [i for _, i in hit]
    return max(0, min(is_) - border), max(0, min(js) - border), min(w, max(is_) + 1 + border), min(h, max(js) + 1 + border)


def boxes_of(rng, count):
    out = [(0.0, 0.0, 100.0, 100.0), (12.0, 48.0, 11.0, 49.0), (-5.0, 40.0, -4.0, 60.0), (10.0, 50.0, 10.0, 50.0), (11.0, NAN, 12.0, 50.0)]
    for _ in range(count):
        x, y = rng.uniform(9, 15), rng.uniform(45, 52)
        out.append((x, y, x + rng.choice([0.05, 0.5, 3]) * rng.random(), y + rng.choice([0.05, 0.5, 3]) * rng.random()))
    return out


@pytest.mark.parametrize("block", [4, 64])
def test_windows_of_pixels_against_brute_force(spark, block):
    rows, pixels = skewed(spark, 30, 25, lambda j, i: (i + j) % 11 == 0)
    grid = replace(GridMapping.regular((30, 25), (10, 45), 0.1, "EPSG:4326"), pixels=pixels, is_regular=False)
    boxes = boxes_of(random.Random(block), 120)
    df = spark.createDataFrame([(n, *b, "kept") for n, b in enumerate(boxes + boxes[:3])], "n int, x0 double, y0 double, x1 double, y1 double, i0 string")
    got = {r.n: (r.i0, r.j0, r.i1, r.j1) for r in windows.ij_windows(grid, df, xy_border=0.05, ij_border=1, block=block).collect()}
    assert got == {n: plain_window(rows, b, 1, 30, 25, 0.05) for n, b in enumerate(boxes + boxes[:3])}
    assert windows.ij_windows(grid, df.limit(0)).count() == 0
    empty = replace(grid, pixels=pixels.withColumn("x", F.lit(NAN)))
    assert {tuple(r) for r in windows.ij_windows(empty, df).select("i0", "j0", "i1", "j1").collect()} == {(-1, -1, -1, -1)}


@pytest.mark.parametrize("up", [False, True])
def test_windows_of_regular_grids(spark, up):
    grid = GridMapping.regular((30, 25), (10, 45), (0.1, 0.3), "EPSG:4326", is_j_axis_up=up)
    rows = [(j, i, x, y) for j, y in enumerate(grid.y_coords) for i, x in enumerate(grid.x_coords)]
    centres = [(x, y, x, y) for x in grid.x_coords[::7] for y in grid.y_coords[::6]] + [(grid.x_coords[3], grid.y_coords[9], grid.x_coords[4], grid.y_coords[9] + 0.6)]
    boxes = boxes_of(random.Random(3), 80) + centres
    df = spark.createDataFrame([(n, *b) for n, b in enumerate(boxes)], "n int, x0 double, y0 double, x1 double, y1 double")
    got = {r.n: (r.i0, r.j0, r.i1, r.j1) for r in windows.ij_windows(grid, df).collect()}
    listed = dict(enumerate(grid.ij_bboxes_from_xy_bboxes(boxes)))
    assert listed == {n: plain_window(rows, b, 0, 30, 25) for n, b in enumerate(boxes)}
    # Centres are summed differently in columns and on the driver's axes, so those on a box's edge may differ by rounding.
    assert {n: b for n, b in got.items() if n < len(boxes) - len(centres)} == {n: b for n, b in listed.items() if n < len(boxes) - len(centres)}


def test_many_boxes_do_not_make_the_plan_grow(spark):
    _, pixels = skewed(spark, 20, 20)
    grid = replace(GridMapping.regular((20, 20), (10, 45), 0.1, "EPSG:4326"), pixels=pixels, is_regular=False)
    size = []
    for count in (5, 2000):
        boxes = spark.range(count).select(F.col("id").alias("n"), (10 + F.col("id") % 7).alias("x0"), F.lit(45.0).alias("y0"), (10.5 + F.col("id") % 7).alias("x1"), F.lit(51.0).alias("y1"))
        size.append(len(windows.ij_windows(grid, boxes)._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert size[0] == size[1]


def test_source_windows_hold_what_tiles_need(spark):
    rows, pixels = skewed(spark, 40, 30)
    grid = grid_from_pixels(pixels, "EPSG:4326")
    target = GridMapping.regular((50, 40), (10, 47), 0.1, "EPSG:4326", tile_size=(16, 16))
    held = {r.tile_id: r for r in windows.source_windows(grid, target, spark=spark).collect()}
    assert len(held) == 12
    for r in rectify.source_indices(grid, target).collect():
        w = held[r.j // 16 * 4 + r.i // 16]
        assert w.i0 <= r.si <= w.i1 - 1 and w.j0 <= r.sj <= w.j1 - 1


@pytest.mark.parametrize("xy_min,size", [((12.0, 47.5), (9, 7)), ((9.0, 40.0), (200, 200)), ((90.0, 0.0), (5, 5))])
def test_small_targets_are_made_of_few_blocks(spark, xy_min, size):
    rows, pixels = skewed(spark, 60, 50)
    frame = GridFrame.from_dataframe(spark.createDataFrame([(j, i, float(100 * j + i)) for j, i, _, _ in rows], "j long, i long, v double"), grid_from_pixels(pixels, "EPSG:4326"))
    target = GridMapping.regular(size, xy_min, 0.1, "EPSG:4326")
    used, window = rectify.window_of(frame.grid, target, 8)
    met = windows.met_pixels(pixels, target.xy_bbox, 8)[0].count()
    if size == (9, 7):
        assert met <= 16 * 64 and used.count() < 3000 and window[2] - window[0] < 60
    elif xy_min[0] == 90.0:
        assert met == 0 and window is None
    else:
        assert window == (0, 0, 60, 50)
    whole = rectify.source_indices(frame.grid, target)
    some = rectify.source_indices(frame.grid, target, pixels=used)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.collect()))
    out = rectify_dataset(frame, target, interp_methods="nearest")
    scanned = [np.nan if v is None else v for v in (r.v for r in out.df.orderBy("j", "i").collect())]
    assert len(scanned) == size[0] * size[1]


def test_scan_is_told_the_window(spark, tmp_path):
    rows, pixels = skewed(spark, 300, 200)
    spark.createDataFrame([(j, i, float(j)) for j, i, _, _ in rows], "j long, i long, v double").write.parquet(str(tmp_path / "v"))
    frame = GridFrame.from_dataframe(spark.read.parquet(str(tmp_path / "v")), grid_from_pixels(pixels, "EPSG:4326"))
    out = rectify_dataset(frame, GridMapping.regular((9, 7), (12.0, 47.5), 0.1, "EPSG:4326"), interp_methods="nearest")
    plan = out.df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(j,0)" in plan and "LessThanOrEqual(j,64)" in plan and "GreaterThanOrEqual(i" in plan


def test_quads_at_a_ragged_edge_make_few_candidates(spark):
    rows, pixels = skewed(spark, 23, 30, lambda j, i: i > 20 + j % 3)
    grid = grid_from_pixels(pixels, "EPSG:4326", tolerance=1e-5)
    target = GridMapping.regular((60, 60), (10, 46.5), 0.1, "EPSG:4326")
    got = {(r.j, r.i): (r.sj, r.si) for r in rectify.source_indices(grid, target).collect()}
    assert got and all(si <= 22 for _, si in got.values())
    clean = {(r.j, r.i): (r.sj, r.si) for r in rectify.source_indices(grid_from_pixels(skewed(spark, 23, 30)[1], "EPSG:4326"), target).collect()}
    assert all(clean[k] == v for k, v in got.items())


def test_large_boxes_are_in_few_cells(spark):
    # Two small pieces far apart: on the lattice of small cells alone, a box over both would be in billions.
    rows = [(j, i, 0.001 * i + (1e6 if j >= 16 else 0.0), -0.001 * j - (1e6 if j >= 16 else 0.0)) for j in range(32) for i in range(16)]
    pixels = spark.createDataFrame(rows, "j long, i long, x double, y double")
    boxes = [(-1.0, -2e6, 2e6, 1.0), (0.0, -0.0105, 0.0045, 1.0), (0.0035, -1e6 - 0.0205, 1e6 + 0.0055, -0.0125), (5.0, -9.0, 6.0, -8.0)]
    asked = spark.createDataFrame([(n, *b) for n, b in enumerate(boxes)], "n int, x0 double, y0 double, x1 double, y1 double")
    grid = replace(GridMapping.regular((16, 32), (0, 0), 1, "EPSG:3857"), is_regular=False, pixels=pixels)
    got = {r.n: (r.i0, r.j0, r.i1, r.j1) for r in windows.ij_windows(grid, asked, block=16).collect()}
    assert [got[n] for n in range(4)] == [plain_window(rows, b, 0, 16, 32) for b in boxes]
