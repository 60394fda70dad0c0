"""Zarr stores (format 2): arrays read chunk by chunk as pixel rows, and reference systems written into a store's metadata.

Chunks are files that Spark lists and reads (`binaryFile`), so a store may be wherever Spark's other inputs are;
each is decoded by one task into rows of the places in it.  Of a window only the chunks that reach into it are
read.  Metadata and coordinate axes are small and are read on the driver, through the same file systems.

Chunks without compression or with zlib, gzip or zstd are read; other compressors and filters raise.  A chunk without a file is of
the fill value, and so are its places, which count as missing pixels; so do values equal to an array's
`_FillValue`; `scale_factor` and `add_offset` are applied.
"""

from __future__ import annotations

import gzip
import json
import math
import zlib
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.crs import CRS
from ..plans.grid import GridMapping
from .frame import SPARK_TYPES, GridFrame
from .infer import Dataset, Variable, frame_from_dataset, grid_from_dataset

#: Chunks of a window up to which each is named to the reader; of more, the folder is listed.
NAMED = 10_000


def _path(spark: SparkSession, path: str) -> Any:
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str) -> Any:
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _bytes(spark: SparkSession, path: str) -> bytes | None:
    """A small file's bytes, or None if there is none."""
    system = _system(spark, path)
    if not system.exists(_path(spark, path)):
        return None
    stream = system.open(_path(spark, path))
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def _json(spark: SparkSession, path: str) -> dict[str, Any] | None:
    raw = _bytes(spark, path)
    return None if raw is None else json.loads(raw)


def _put_json(spark: SparkSession, path: str, value: Mapping[str, Any]) -> None:
    plain = json.loads(json.dumps(value), parse_constant=lambda name: "inf" if name == "Infinity" else name)
    stream = _system(spark, path).create(_path(spark, path), True)
    try:
        stream.write(bytearray(json.dumps(plain, indent=4).encode()))
    finally:
        stream.close()


def arrays_of(spark: SparkSession, path: str) -> dict[str, tuple[dict[str, Any], dict[str, Any]]]:
    """The (.zarray, .zattrs) of each array in a store's group, by name."""
    out = {}
    for status in _system(spark, path).listStatus(_path(spark, path)):
        name = status.getPath().getName()
        if status.isDirectory() and (told := _json(spark, f"{path}/{name}/.zarray")) is not None:
            out[name] = (told, _json(spark, f"{path}/{name}/.zattrs") or {})
    return dict(sorted(out.items()))


def _decoded(raw: bytes, told: Mapping[str, Any]) -> np.ndarray:
    """A chunk's values in its shape."""
    kind = (told.get("compressor") or {}).get("id")
    if kind == "zstd":
        import zstandard

        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    elif kind is not None:
        raw = {"zlib": zlib.decompress, "gzip": gzip.decompress}[kind](raw)
    values = np.frombuffer(raw, np.dtype(told["dtype"]))
    return values.reshape(told["chunks"], order=told.get("order", "C")).astype(values.dtype.newbyteorder("="))


def _checked(name: str, told: Mapping[str, Any]) -> None:
    kind = (told.get("compressor") or {}).get("id")
    if told.get("zarr_format") != 2 or told.get("filters") or kind not in (None, "zlib", "gzip", "zstd"):
        raise ValueError(f"array {name!r} is of a format, filter or compressor that isn't read: {kind or told.get('filters') or told.get('zarr_format')!r}")


def _scaled(attrs: Mapping[str, Any]) -> bool:
    return "scale_factor" in attrs or "add_offset" in attrs


def _kind(told: Mapping[str, Any], attrs: Mapping[str, Any]) -> str:
    return "float64" if _scaled(attrs) else np.dtype(told["dtype"]).name


def _fill(told: Mapping[str, Any], attrs: Mapping[str, Any]) -> float | None:
    fill = attrs.get("_FillValue", told.get("fill_value") if _scaled(attrs) else None)
    return None if fill is None or isinstance(fill, float) and math.isnan(fill) else float(fill)


def _axis(spark: SparkSession, path: str, name: str, told: Mapping[str, Any], attrs: Mapping[str, Any]) -> list[float]:
    """The values of an array of one dimension: one number for each row or column."""
    size, chunk = told["shape"][0], told["chunks"][0]
    parts = []
    for k in range(-(-size // chunk)):
        raw = _bytes(spark, f"{path}/{name}/{k}")
        parts.append(np.full(chunk, math.nan if told.get("fill_value") in (None, "NaN") else told["fill_value"], float) if raw is None else _decoded(raw, told).astype(float))
    values = np.concatenate(parts)[:size]
    return (values * float(attrs.get("scale_factor", 1)) + float(attrs.get("add_offset", 0))).tolist()


def read_array(spark: SparkSession, path: str, name: str, told: Mapping[str, Any], attrs: Mapping[str, Any], window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(leading dimensions, j, i, <name>) of the pixels of an array whose last two dimensions are rows and columns; leading ones are numbered."""
    _checked(name, told)
    shape, chunks, mark = told["shape"], told["chunks"], told.get("dimension_separator", ".")
    dims = attrs.get("_ARRAY_DIMENSIONS") or [f"dim_{k}" for k in range(len(shape))]
    lead = list(dims[:-2])
    i0, j0, i1, j1 = window or (0, 0, shape[-1], shape[-2])
    i0, j0, i1, j1 = max(i0, 0), max(j0, 0), min(i1, shape[-1]), min(j1, shape[-2])
    kind, fill = _kind(told, attrs), _fill(told, attrs)
    schema = ", ".join([*(f"`{d}` bigint" for d in lead), "j bigint", "i bigint", f"`{name}` {SPARK_TYPES[kind]}"])
    ranges = [range(-(-n // c)) for n, c in zip(shape[:-2], chunks[:-2], strict=True)] + [range(a // c, -(-b // c)) for a, b, c in ((j0, j1, chunks[-2]), (i0, i1, chunks[-1]))]
    if window is not None and math.prod(map(len, ranges)) <= NAMED:
        keys = [mark.join(str(r[k]) for r, k in zip(ranges, at, strict=True)) for at in np.ndindex(*map(len, ranges))]
        system = _system(spark, path)
        files = [f for k in keys if system.exists(_path(spark, f := f"{path}/{name}/{k}"))]
    else:
        files = [f"{path}/{name}"]
    if not files:
        return spark.createDataFrame([], schema)
    scale, offset, floating = float(attrs.get("scale_factor", 1)), float(attrs.get("add_offset", 0)), kind.startswith("float")
    told, number = dict(told), pa.from_numpy_dtype(np.dtype({"uint8": "int16", "uint16": "int32", "uint32": "int64", "bool": "float64"}.get(kind, kind)))

    def pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, raw in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                at = [int(k) for k in where.rstrip("/").replace(mark, "/").split("/")[-len(shape) :]]
                values = _decoded(raw, told)
                places = [(np.arange(c) + k * c) for k, c in zip(at, chunks, strict=True)]
                own = [p < n for p, n in zip(places, shape, strict=True)]
                own[-2] &= (places[-2] >= j0) & (places[-2] < j1)
                own[-1] &= (places[-1] >= i0) & (places[-1] < i1)
                values = values[np.ix_(*own)]
                grid = np.meshgrid(*(p[o] for p, o in zip(places, own, strict=True)), indexing="ij")
                flat = values.ravel()
                gone = np.zeros(len(flat), bool) if fill is None else flat == fill
                if floating:
                    flat = np.where(gone, np.nan, flat.astype(float) * scale + offset)
                columns = [g.ravel() for g in grid] + [flat]
                if not floating and gone.any():
                    columns = [c[~gone] for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * len(shape) + [number], strict=True)], [*lead, "j", "i", name])

    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(mark == "/").lower()).load(files).select("path", "content")
    return found.mapInArrow(pixels, schema)


def read_zarr(spark: SparkSession, path: str, *, variables: Sequence[str] | None = None, window: tuple[int, int, int, int] | None = None, grid: GridMapping | None = None) -> GridFrame:
    """A frame of the arrays of a store whose last dimensions are its spatial ones; of a window (i0, j0, i1, j1; ends excluded) only those pixels, in their places."""
    own = arrays_of(spark, path)
    dims = {n: tuple(a.get("_ARRAY_DIMENSIONS") or (f"dim_{k}" for k in range(len(t["shape"])))) for n, (t, a) in own.items()}
    told = {}
    for n, (t, a) in own.items():
        values = _axis(spark, path, n, t, a) if len(dims[n]) == 1 and dims[n][0] == n else None
        told[n] = Variable(dims[n], {k: v for k, v in a.items() if k != "_ARRAY_DIMENSIONS"}, values, tuple(t["chunks"]) if len(dims[n]) > 1 else None, t["shape"][0] if len(dims[n]) == 1 else None)
    attrs = _json(spark, f"{path}/.zattrs") or {}
    planes = [n for n in own if len(dims[n]) == 2]
    ds = Dataset(told, attrs, None)
    if grid is None:
        if any(len(dims[c]) == 2 for c in own if told[c].attrs.get("standard_name") in ("longitude", "latitude") or c in ("lon", "lat")):
            coordinates = None
            for n in planes:
                part = read_array(spark, path, n, *own[n])
                coordinates = part if coordinates is None else coordinates.join(part, ["j", "i"], "full")
            ds = Dataset(told, attrs, coordinates)
        grid = grid_from_dataset(ds)
    y_x = (grid.xy_dim_names[1], grid.xy_dim_names[0])
    names = [n for n in own if dims[n][-2:] == y_x and n not in grid.xy_var_names and (variables is None or n in variables)]
    if missing := set(variables or ()) - set(names):
        raise KeyError(sorted(missing)[0])
    table = None
    for n in names:
        part = read_array(spark, path, n, *own[n], window=window)
        keys = [*dims[n][:-2], "j", "i"]
        table = part if table is None else table.join(part, keys, "full")
    frame = frame_from_dataset(Dataset({n: v for n, v in told.items() if n in (*names, *grid.xy_var_names)}, attrs, table), grid)
    kinds = {n: _kind(*own[n]) for n in names}
    return GridFrame.from_dataframe(frame.df, grid, leading=frame.leading, variables=names, kinds=kinds, attrs=attrs)


def tag_store(spark: SparkSession, path: str, crs: CRS | str, *, name: str = "spatial_ref", xy_dim_names: tuple[str, str] = ("x", "y")) -> None:
    """Writes a reference system into a store: a scalar array `name` with its attributes, and its name into all arrays whose last dimensions are (y, x).

    Where the store has consolidated metadata, these are brought up to date.
    """
    crs = CRS.from_any(crs)
    if _json(spark, f"{path}/.zgroup") is None:
        raise ValueError(f"no Zarr group: {path}")
    scalar = {"zarr_format": 2, "shape": [], "chunks": [], "dtype": "|u1", "compressor": None, "fill_value": 0, "order": "C", "filters": None}
    _put_json(spark, f"{path}/{name}/.zarray", scalar)
    _put_json(spark, f"{path}/{name}/.zattrs", {**crs.to_cf(), "_ARRAY_DIMENSIONS": []})
    for n, (_, attrs) in arrays_of(spark, path).items():
        if n != name and tuple(attrs.get("_ARRAY_DIMENSIONS", ())[-2:]) == (xy_dim_names[1], xy_dim_names[0]):
            _put_json(spark, f"{path}/{n}/.zattrs", {**attrs, "grid_mapping": name})
    entries = {".zgroup": _json(spark, f"{path}/.zgroup")}
    if (own := _json(spark, f"{path}/.zattrs")) is not None:
        entries[".zattrs"] = own
    for n, (told, attrs) in arrays_of(spark, path).items():
        entries |= {f"{n}/.zarray": told, f"{n}/.zattrs": attrs}
    _put_json(spark, f"{path}/.zmetadata", {"zarr_consolidated_format": 1, "metadata": entries})
