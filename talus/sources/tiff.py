"""GeoTIFF without a library: deflate-compressed strips, georeferenced by pixel scale, tie point and keys."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputDataError
from ..functions.crs import epsg
from ..model import Grid

TYPES = {"uint8": (8, 1), "int16": (16, 2), "int32": (32, 2), "float32": (32, 3), "float64": (64, 3)}
KINDS = {v: k for k, v in TYPES.items()}
ROWS = 64
#: Rasters of more cells are written as several files, each by the task that has its cells.
ONE_FILE, TILE = 1 << 24, 4096


def unlzw(data: bytes) -> bytes:
    """Bytes of a strip or tile packed by TIFF's LZW: codes of 9 to 12 bits, most significant bit first."""
    clear, end = 256, 257
    out = bytearray()
    table: list[bytes] = []
    before, bits, held, n = b"", 9, 0, 0
    for byte in data:
        held, n = held << 8 | byte, n + 8
        if n < bits:
            continue
        n -= bits
        code, held = held >> n, held & (1 << n) - 1
        if code == end:
            break
        if code == clear:
            table, before, bits = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
            continue
        if not table:
            raise InputDataError("an LZW strip doesn't begin with a clear code")
        if code > len(table) or code == len(table) and not before:
            raise InputDataError("damaged LZW data")
        piece = table[code] if code < len(table) else before + before[:1]
        out += piece
        if before:
            table.append(before + piece[:1])
        before = piece
        bits = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12  # a code early
    return bytes(out)


def write_geotiff(path: str | Path, data: np.ndarray, grid: Grid, dtype: str = "float32", nodata: float | None = None, description: str = "") -> None:
    """One band; NaN becomes the no-data value."""
    if data.shape != grid.shape:
        raise InputDataError(f"a raster of {data.shape} doesn't fit a grid of {grid.shape}")
    if nodata is not None and np.issubdtype(data.dtype, np.floating):
        data = np.where(np.isnan(data), nodata, data)
    data = np.ascontiguousarray(data, np.dtype(dtype).newbyteorder("<"))
    strips = [zlib.compress(data[i : i + ROWS].tobytes()) for i in range(0, grid.height, ROWS)]
    bits, kind = TYPES[dtype]
    keys = [1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg(grid.crs) or 32767]
    tags: list[tuple[int, int, list]] = [
        (256, 4, [grid.width]), (257, 4, [grid.height]), (258, 3, [bits]), (259, 3, [8]), (262, 3, [1]), (270, 2, [description]), (273, 4, []),
        (277, 3, [1]), (278, 4, [ROWS]), (279, 4, [len(s) for s in strips]), (339, 3, [kind]), (33550, 12, [grid.res, grid.res, 0.0]),
        (33922, 12, [0.0, 0.0, 0.0, grid.x0, grid.y1, 0.0]), (34735, 3, [1, 1, 0, len(keys) // 4, *keys]), (42112, 2, [f'<GDALMetadata><Item name="METERS_PER_UNIT">{grid.meters_per_unit!r}</Item></GDALMetadata>']),
    ]
    if nodata is not None:
        tags.append((42113, 2, [f"{nodata:g}"]))
    at = 8
    starts = []
    for s in strips:
        starts.append(at)
        at += len(s)
    tags[6] = (273, 4, starts)
    at += at % 2
    extra_at, extra, entries = at + 2 + 12 * len(tags) + 4, b"", b""
    for tag, kind, values in tags:
        packed = (values[0].encode() + b"\0") if kind == 2 else struct.pack(f"<{len(values)}{ {3: 'H', 4: 'L', 12: 'd'}[kind]}", *values)
        count = len(packed) if kind == 2 else len(values)
        entries += struct.pack("<HHL", tag, kind, count)
        if len(packed) <= 4:
            entries += packed.ljust(4, b"\0")
        else:
            entries += struct.pack("<L", extra_at + len(extra))
            extra += packed + b"\0" * (len(packed) % 2)
    body = b"".join(strips)
    Path(path).write_bytes(struct.pack("<2sHL", b"II", 42, at) + body + b"\0" * (at - 8 - len(body)) + struct.pack("<H", len(tags)) + entries + b"\0" * 4 + extra)


def read_geotiff(path: str | Path) -> tuple[np.ndarray, Grid]:
    """A little-endian band in strips or tiles, plain or packed by deflate or LZW; no data as NaN, and its grid."""
    try:
        raw = Path(path).read_bytes()
    except OSError as e:
        raise InputDataError(f"can't read {path}: {e}") from e
    if raw[:4] != b"II*\0":
        raise InputDataError(f"{path} isn't a little-endian TIFF")
    at = struct.unpack("<L", raw[4:8])[0]
    found = {}
    for i in range(struct.unpack("<H", raw[at : at + 2])[0]):
        tag, kind, count = struct.unpack("<HHL", raw[at + 2 + 12 * i : at + 10 + 12 * i])
        width, code = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "L"), 12: (8, "d")}.get(kind, (1, "B"))
        place = at + 10 + 12 * i if width * count <= 4 else struct.unpack("<L", raw[at + 10 + 12 * i : at + 14 + 12 * i])[0]
        part = raw[place : place + width * count]
        found[tag] = part.rstrip(b"\0").decode() if kind == 2 else struct.unpack(f"<{count}{code}", part)
    width, height = found[256][0], found[257][0]
    dtype = KINDS[found[258][0], found.get(339, (1,))[0]]
    unpack = {1: bytes, 5: unlzw, 8: zlib.decompress, 32946: zlib.decompress}.get(found[259][0])
    predictor = found.get(317, (1,))[0]
    if unpack is None or predictor not in (1, 2) or found.get(277, (1,))[0] != 1:
        raise InputDataError("only single bands, plain or packed by deflate or LZW, can be read")
    # Strips are tiles as wide as the raster.
    wide, high = (found[322][0], found[323][0]) if 324 in found else (width, found.get(278, (height,))[0])
    starts, sizes = (found[324], found[325]) if 324 in found else (found[273], found[279])
    across, kind = -(-width // wide), np.dtype(dtype).newbyteorder("<")
    data = np.zeros((-(-height // high) * high, across * wide), kind)
    for k, (o, n) in enumerate(zip(starts, sizes, strict=True)):
        part = np.frombuffer(unpack(raw[o : o + n]), kind)
        part = part[: len(part) // wide * wide].reshape(-1, wide)[:high]
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=kind)
        r, c = k // across * high, k % across * wide
        data[r : r + len(part), c : c + wide] = part
    data = data[:height, :width]
    if 42113 in found:
        data = np.where(data == float(found[42113]), np.nan, data.astype(float))
    keys = found.get(34735, ())
    code = next((keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i] in (3072, 2048)), None)
    unit = found.get(42112, "")
    meters = float(unit.split('"METERS_PER_UNIT">')[1].split("<")[0]) if '"METERS_PER_UNIT">' in unit else 1.0
    res = found[33550][0]
    return data, Grid(found[33922][3], found[33922][4], res, width, height, f"EPSG:{code}" if code else None, meters)


def write_raster(cells: DataFrame, value: Column, grid: Grid, path: str | Path, dtype: str = "float32", nodata: float | None = None, description: str = "", one_file: int = ONE_FILE, tile: int = TILE) -> None:
    """A layer as one GeoTIFF; of more than ``one_file`` cells, as a folder of them, ``row_col.tif``, written by the tasks.

    The folder has to be one that executors share.
    """
    layer = cells.select("row", "col", value.cast("double").alias("v"))
    if grid.n_cells <= one_file:
        write_geotiff(path, to_array(layer, grid, "v"), grid, dtype, nodata, description)
        return
    folder = Path(path).with_suffix("")

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(key[0]) * tile, int(key[1]) * tile
        x, y = grid.corner(r0, c0)
        part = Grid(x, y, grid.res, min(tile, grid.width - c0), min(tile, grid.height - r0), grid.crs, grid.meters_per_unit)
        data = np.full(part.shape, np.nan)
        data[frame["row"] - r0, frame["col"] - c0] = frame["v"].to_numpy(float)
        folder.mkdir(parents=True, exist_ok=True)
        name = f"{key[0]}_{key[1]}.tif"
        half = folder / f".{name}.{uuid.uuid4().hex}"  # a task that is repeated replaces the file whole
        write_geotiff(half, data, part, dtype, nodata, description)
        os.replace(half, folder / name)
        return pd.DataFrame({"name": [name]})

    keyed = layer.withColumn("tr", F.floor(F.col("row") / tile)).withColumn("tc", F.floor(F.col("col") / tile))
    keyed.groupBy("tr", "tc").applyInPandas(run, "name string").count()


def to_array(cells: DataFrame, grid: Grid, value: str) -> np.ndarray:
    """A layer as an array on the driver: for files of a single raster, whose size the grid bounds."""
    out = np.full(grid.shape, np.nan)
    frame = cells.select("row", "col", value).toPandas()
    out[frame["row"], frame["col"]] = frame[value].to_numpy(float, na_value=np.nan)
    return out


def from_array(spark: SparkSession, data: np.ndarray, grid: Grid, value: str = "v") -> DataFrame:
    """An array as a dense raster, NaN as null."""
    rows, cols = np.divmod(np.arange(grid.n_cells), grid.width)
    frame = pd.DataFrame({"cell": np.arange(grid.n_cells), "row": rows.astype(np.int32), "col": cols.astype(np.int32), "v": data.ravel().astype(float)})
    return spark.createDataFrame(frame).select("cell", "row", "col", F.nanvl(F.col("v"), F.lit(None)).alias(value))
