"""LAS as a Spark data source, and its writer; compressed files where a codec is installed.

``spark.read.format("las")`` makes a partition of each range of points of each
file; tiles whose header bounds lie outside the ``bbox`` option are never opened
further, and the crop is applied to each range as it is read.
"""

from __future__ import annotations

import glob
import importlib.util
import math
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import InputDataError, MissingDependencyError
from ..functions.crs import epsg, meters_per_unit, project_bounds
from ..model import PointCloud

CHUNK = 2_000_000
SCHEMA = "x double, y double, z double, classification smallint, source string"

#: Point formats: length, and where the class byte is and how many of its bits count.  Fixed values.
FORMATS = {0: (20, 15, 31), 1: (28, 15, 31), 2: (26, 15, 31), 3: (34, 15, 31), 4: (57, 15, 31), 5: (63, 15, 31), 6: (30, 16, 255), 7: (36, 16, 255), 8: (38, 16, 255), 9: (59, 16, 255), 10: (67, 16, 255)}


@dataclass(frozen=True)
class Header:
    path: str
    version: tuple[int, int]
    offset: int
    point_format: int
    length: int
    count: int
    scale: tuple[float, float, float]
    shift: tuple[float, float, float]
    mins: tuple[float, float, float]
    maxs: tuple[float, float, float]
    crs: str | None
    packed: bool = False


def read_header(path: str) -> Header:
    try:
        with open(path, "rb") as f:
            head = f.read(375)
            if head[:4] != b"LASF":
                raise InputDataError(f"{path} isn't a LAS file")
            major, minor = head[24], head[25]
            size, offset, n_records, kind, length, count = struct.unpack("<HLLBHL", head[94:111])
            scale, shift = struct.unpack("<3d", head[131:155]), struct.unpack("<3d", head[155:179])
            x1, x0, y1, y0, z1, z0 = struct.unpack("<6d", head[179:227])
            if (major, minor) >= (1, 4):
                count = struct.unpack("<Q", head[247:255])[0] or count
            f.seek(size)
            records = f.read(offset - size)
    except (OSError, struct.error, IndexError) as e:
        raise InputDataError(f"can't read {path}: {e}") from e
    packed = bool(kind & 0x80) or path.lower().endswith(".laz")
    kind &= 0x3F
    if packed and importlib.util.find_spec("laspy") is None:
        raise MissingDependencyError(f"{path} is compressed; reading it takes laspy with a LAZ codec")
    if kind not in FORMATS:
        raise InputDataError(f"{path} has point format {kind}, which is unknown")
    return Header(path, (major, minor), offset, kind, length, count, scale, shift, (x0, y0, z0), (x1, y1, z1), records_crs(records, n_records), packed)


def records_crs(data: bytes, n: int) -> str | None:
    """The system that variable-length records name: a WKT, else a projected or geographic code of the GeoTIFF keys."""
    at, keys = 0, None
    for _ in range(n):
        if at + 54 > len(data):
            break
        user, record, size = data[at + 2 : at + 18].rstrip(b"\0"), *struct.unpack("<HH", data[at + 18 : at + 22])
        body = data[at + 54 : at + 54 + size]
        if user == b"LASF_Projection" and record == 2112:
            return body.rstrip(b"\0").decode(errors="replace") or None
        if user == b"LASF_Projection" and record == 34735:
            keys = struct.unpack(f"<{len(body) // 2}H", body[: len(body) // 2 * 2])
        at += 54 + size
    found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0} if keys else {}
    for key in (3072, 2048):
        if found.get(key, 0) not in (0, 32767):
            return f"EPSG:{found[key]}"
    return None


@dataclass
class Range(InputPartition):
    header: Header
    first: int
    n: int


#: A point of format 6.
RECORD6 = np.dtype([("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("flags", "u1"), ("class", "u1"), ("user", "u1"), ("angle", "<i2"), ("source", "<u2"), ("time", "<f8")])


def unpacked(header: Header, first: int, n: int) -> np.ndarray:
    """Raw records of a compressed file, by the codec that is installed."""
    import laspy

    with laspy.open(header.path) as reader:
        reader.seek(first)
        return np.frombuffer(reader.read_points(n).array.tobytes(), np.uint8).reshape(-1, header.length)


class LasReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = expand(options.get("path", "").split(","))
        self.window = tuple(map(float, options["bbox"].split(","))) if options.get("bbox") else None
        self.chunk = int(options.get("chunksize", CHUNK))

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            h = read_header(path)
            if self.window and outside(self.window, h):
                continue
            out += [Range(h, i, min(self.chunk, h.count - i)) for i in range(0, h.count, self.chunk)]
        return out or [Range(read_header(self.paths[0]), 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        assert isinstance(partition, Range)
        h = partition.header
        if h.packed:
            raw = unpacked(h, partition.first, partition.n)
        else:
            with open(h.path, "rb") as f:
                f.seek(h.offset + partition.first * h.length)
                raw = np.frombuffer(f.read(partition.n * h.length), np.uint8).reshape(-1, h.length)
        xyz = raw[:, :12].copy().view("<i4").reshape(-1, 3) * np.array(h.scale) + np.array(h.shift)
        _, place, mask = FORMATS[h.point_format]
        classes = raw[:, place] & mask
        withheld = raw[:, 15] & 4 if h.point_format >= 6 else raw[:, 15] & 128
        keep = withheld == 0
        if self.window:
            west, south, east, north = self.window
            keep &= (xyz[:, 0] >= west) & (xyz[:, 0] < east) & (xyz[:, 1] >= south) & (xyz[:, 1] < north)
        xyz, classes = xyz[keep], classes[keep]
        columns = [pa.array(np.ascontiguousarray(xyz[:, k])) for k in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(classes.astype(np.int16)), pa.array([h.path] * len(xyz), pa.string())], ["x", "y", "z", "classification", "source"])


class LasSource(DataSource):
    """``format("las")``: options path (comma-separated files, folders or patterns), bbox, chunkSize."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> LasReader:
        return LasReader({k.lower(): v for k, v in self.options.items()})


def expand(paths: list[str]) -> list[str]:
    out: list[str] = []
    for p in paths:
        p = p.strip().removeprefix("file:")
        found = sorted(glob.glob(os.path.join(p, "*.la[sz]"))) if os.path.isdir(p) else sorted(glob.glob(p))
        out += found or [p]
    return out


def outside(window: tuple[float, ...], h: Header) -> bool:
    """A tile that touches the window isn't outside."""
    west, south, east, north = window
    return h.maxs[0] < west or h.mins[0] > east or h.maxs[1] < south or h.mins[1] > north


def z_factor(z_units: str, horizontal: float) -> float:
    known = {"auto": horizontal, "m": 1.0, "us-ft": 1200 / 3937, "ft": 0.3048}
    if z_units not in known:
        raise InputDataError(f"unknown height unit {z_units!r}")
    return known[z_units]


def read_las(spark: SparkSession, paths: list[str], bbox_wgs84: tuple[float, float, float, float] | None = None, crs: str | None = None, z_units: str = "auto", chunk_size: int = CHUNK) -> PointCloud:
    """All points of the tiles within the box, heights in meters; the box is the cloud's extent."""
    headers = [read_header(p) for p in expand([str(p) for p in paths])]
    named = {h.path: crs or h.crs for h in headers}
    if missing := [p for p, c in named.items() if not c]:
        raise InputDataError(f"{missing[0]} names no coordinate system")
    if len({epsg(c) or c for c in named.values()}) > 1:
        raise InputDataError("the tiles are in different coordinate systems")
    system = next(iter(named.values()))
    assert system is not None
    unit = meters_per_unit(system)
    window = project_bounds(bbox_wgs84, system) if bbox_wgs84 else None
    spark.dataSource.register(LasSource)
    reader = spark.read.format("las").option("path", ",".join(h.path for h in headers)).option("chunkSize", str(chunk_size))
    if window:
        reader = reader.option("bbox", ",".join(map(repr, window)))
    points = reader.load().withColumn("z", F.col("z") * F.lit(z_factor(z_units, unit)))
    if points.isEmpty():
        raise InputDataError("no point is left inside the box")
    return PointCloud(points, system, unit, window, tuple(h.path for h in headers))


def write_las(cloud: PointCloud, path: str | Path) -> None:
    """One LAS 1.4 file of point format 6: millimeters from whole offsets, the system as a WKT record."""
    low = cloud.points.agg(F.min("x"), F.min("y"), F.min("z"), F.max("x"), F.max("y"), F.max("z"), F.count("*")).first()
    if not low[6]:
        raise InputDataError("there are no points to write")
    shift, scale = [float(math.floor(v)) for v in low[:3]], 0.001
    wkt = (cloud.crs or "").encode() + b"\0"
    record = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 2112, len(wkt), b"WKT") + wkt
    offset, count = 375 + len(record), low[6]
    head = struct.pack("<4sHHLHH8sBB32s32sHHHLLBHL5L", b"LASF", 0, 16, 0, 0, 0, b"", 1, 4, b"talus", b"talus", 1, 2024, 375, offset, 1, 6, 30, 0, *[0] * 5)
    head += struct.pack("<12d", scale, scale, scale, *shift, low[3], low[0], low[4], low[1], low[5], low[2])
    head += struct.pack("<QQLQ15Q", 0, 0, 0, count, count, *[0] * 14)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, RECORD6)
            for k, axis in enumerate("xyz"):
                out[axis] = np.rint((batch.column(k).to_numpy() - shift[k]) / scale)
            out["returns"], out["class"] = 0x11, batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["records"])

    points = cloud.points.select(*(F.col(c).cast("double") for c in "xyz"), F.col("classification").cast("int"))
    with open(path, "wb") as f:
        f.write(head + record)
        # Packed by the tasks; the file is one, so its parts pass through the driver, a partition at a time.
        for row in points.mapInArrow(packed, "records binary").toLocalIterator(prefetchPartitions=True):
            f.write(row["records"])


def sources(points: DataFrame) -> DataFrame:
    """How many points each tile gave."""
    return points.groupBy("source").agg(F.count("*").alias("points"))
