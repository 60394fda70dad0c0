"""Zarr stores: reading with and without compression, windows that read few chunks, and tags."""

import gzip
import json
import math
import os
import zlib

import numpy as np
import pytest

from gridloom.plans.crs import CRS
from gridloom.sources.zarr import arrays_of, read_zarr, tag_store


def put(folder, name, values, chunks, dims, compressor=None, mark=".", order="C", missing=(), **attrs):
    os.makedirs(f"{folder}/{name}", exist_ok=True)
    told = {"zarr_format": 2, "shape": list(values.shape), "chunks": list(chunks), "dtype": values.dtype.str, "compressor": compressor and {"id": compressor}, "fill_value": 0, "order": order, "filters": None}
    if mark != ".":
        told["dimension_separator"] = mark
    with open(f"{folder}/{name}/.zarray", "w") as f:
        json.dump(told, f)
    with open(f"{folder}/{name}/.zattrs", "w") as f:
        json.dump({**attrs, "_ARRAY_DIMENSIONS": list(dims)}, f)
    for at in np.ndindex(*(-(-n // c) for n, c in zip(values.shape, chunks, strict=True))):
        if at in missing:
            continue
        block = np.zeros(chunks, values.dtype)
        part = values[tuple(slice(k * c, (k + 1) * c) for k, c in zip(at, chunks, strict=True))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        raw = {"zlib": zlib.compress, "gzip": gzip.compress, None: bytes}[compressor](block.tobytes(order=order))
        path = f"{folder}/{name}/{mark.join(map(str, at))}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(raw)


def store(folder, compressor=None, mark=".", order="C", kind="<f8"):
    rng = np.random.default_rng(1)
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.zgroup", "w") as f:
        json.dump({"zarr_format": 2}, f)
    with open(f"{folder}/.zattrs", "w") as f:
        json.dump({"title": "made up"}, f)
    put(folder, "x", 100.5 + np.arange(30.0), (16,), ["x"])
    put(folder, "y", 50.5 - np.arange(20.0), (20,), ["y"])
    v, q = rng.normal(size=(20, 30)).astype(kind), rng.integers(0, 200, size=(2, 20, 30)).astype("|u1")
    put(folder, "v", v, (8, 7), ["y", "x"], compressor, mark, order)
    put(folder, "q", q, (1, 8, 16), ["time", "y", "x"], compressor, mark, order)
    return v, q


PLANE = CRS.from_any("EPSG:3857")


@pytest.mark.parametrize("compressor,mark,order,kind", [(None, ".", "C", "<f8"), ("zlib", ".", "C", ">f4"), ("gzip", "/", "F", "<f8")])
def test_stores_are_read_as_pixels(spark, tmp_path, compressor, mark, order, kind):
    folder = str(tmp_path / "z")
    v, q = store(folder, compressor, mark, order, kind)
    tag_store(spark, folder, PLANE)
    frame = read_zarr(spark, folder, variables=["v"])
    assert frame.grid.size == (30, 20) and frame.grid.crs.equals(PLANE) and frame.grid.xy_bbox == (100, 31, 130, 51) and frame.variables == {"v": "float32" if "4" in kind else "float64"}
    np.testing.assert_array_equal(np.array(frame.image("v")), v.astype(float))
    cube = read_zarr(spark, folder, variables=["q"])
    assert cube.leading == ("time",) and cube.variables == {"q": "uint8"}
    np.testing.assert_array_equal(np.array(cube.image("q")), q.astype(float))
    with pytest.raises(KeyError):
        read_zarr(spark, folder, variables=["nothing"])


def test_windows_read_few_chunks(spark, tmp_path):
    folder = str(tmp_path / "z")
    v, _ = store(folder, "zlib")
    tag_store(spark, folder, PLANE)
    frame = read_zarr(spark, folder, variables=["v"], window=(13, 9, 20, 15))
    assert {(r.j, r.i): r.v for r in frame.df.collect()} == {(j, i): v[j, i] for j in range(9, 15) for i in range(13, 20)}
    scans = [f.split("/")[-1] for f in frame.df.inputFiles()]
    assert sorted(scans) == ["1.1", "1.2"]
    assert read_zarr(spark, folder, variables=["v"], window=(90, 90, 95, 95)).df.count() == 0


def test_missing_chunks_fill_values_and_scales(spark, tmp_path):
    folder = str(tmp_path / "z")
    store(folder)
    tag_store(spark, folder, PLANE)
    raw = np.arange(600).reshape(20, 30).astype("<i2")
    put(folder, "s", raw, (8, 7), ["y", "x"], missing={(0, 0)}, scale_factor=0.5, add_offset=1, _FillValue=77, grid_mapping="spatial_ref")
    put(folder, "n", raw, (8, 7), ["y", "x"], _FillValue=77)
    frame = read_zarr(spark, folder, variables=["n", "s"])
    rows = {(r.j, r.i): (r.n, r.s) for r in frame.df.collect()}
    assert frame.variables == {"n": "int16", "s": "float64"}
    assert rows[0, 3] == (3, None) and rows[0, 10] == (10, 6.0) and rows[2, 17][0] is None and math.isnan(rows[2, 17][1]) and rows[19, 29] == (599, 300.5)


def test_other_compressors_and_filters_raise(spark, tmp_path):
    folder = str(tmp_path / "z")
    store(folder)
    tag_store(spark, folder, PLANE)
    told = json.load(open(f"{folder}/v/.zarray"))
    json.dump({**told, "compressor": {"id": "blosc"}}, open(f"{folder}/v/.zarray", "w"))
    with pytest.raises(ValueError, match="blosc"):
        read_zarr(spark, folder, variables=["v"])


@pytest.mark.parametrize("crs", ["EPSG:32632", {"grid_mapping_name": "sinusoidal", "earth_radius": 6371007.181}])
def test_tags_are_found_again(spark, tmp_path, crs):
    folder = str(tmp_path / "z")
    store(folder)
    tag_store(spark, folder, CRS.from_any(crs), name="crs_here")
    own = arrays_of(spark, folder)
    assert own["v"][1]["grid_mapping"] == own["q"][1]["grid_mapping"] == "crs_here" and "grid_mapping" not in own["x"][1]
    assert own["crs_here"][0]["shape"] == [] and own["crs_here"][1]["_ARRAY_DIMENSIONS"] == []
    assert read_zarr(spark, folder, variables=["v"]).grid.crs.equals(CRS.from_any(crs))
    whole = json.load(open(f"{folder}/.zmetadata"))["metadata"]
    assert whole["v/.zattrs"]["grid_mapping"] == "crs_here" and whole[".zattrs"] == {"title": "made up"}
    with pytest.raises(ValueError, match="no Zarr group"):
        tag_store(spark, str(tmp_path / "none"), PLANE)
