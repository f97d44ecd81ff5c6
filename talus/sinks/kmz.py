"""KMZ of overlays, drainage and zones; the same products make the same bytes."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from html import escape
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import functions as F

from ..functions.crs import project_xy, unproject_xy
from ..lineage import cut
from ..model import Grid
from ..operators import classes, raster, terrain
from ..plans.pipeline import Products
from ..sources.tiff import to_array

STAMP, ORDERS, PIXELS = (1980, 1, 1, 0, 0, 0), 4, 2048
#: Colors of the ramps, from low to high.  Fixed values.
RAMPS = {"dem": list(terrain.ELEVATION_COLORS), "log_area": ["#deebf7", "#6baed6", "#08306b"], "chm": ["#f7f7e8", "#a6cf8e", "#3c8a4b", "#12402a"], "slope": ["#fffbe6", "#f4a259", "#8c2f39"], "hillshade": ["#000000", "#ffffff"]}
WATER = ["#9ecae1", "#6baed6", "#3182bd", "#08519c"]


def rgb(color: str) -> tuple[int, int, int]:
    return int(color[1:3], 16), int(color[3:5], 16), int(color[5:7], 16)


def kml_color(color: str, alpha: int = 255) -> str:
    r, g, b = rgb(color)
    return f"{alpha:02x}{b:02x}{g:02x}{r:02x}"


def png(rgba: np.ndarray) -> bytes:
    height, width, _ = rgba.shape
    raw = np.zeros((height, 1 + width * 4), np.uint8)
    raw[:, 1:] = rgba.reshape(height, -1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">L", len(data)) + kind + data + struct.pack(">L", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">LLBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 9)) + chunk(b"IEND", b"")


def ramp(values: np.ndarray, colors: list[str]) -> np.ndarray:
    """Values as opaque colors between their 2nd and 98th percentile, no data transparent."""
    known = ~np.isnan(values)
    low, high = np.percentile(values[known], [2, 98]) if known.any() else (0.0, 1.0)
    t = np.clip((np.nan_to_num(values) - low) / max(high - low, 1e-9), 0, 1) * (len(colors) - 1)
    table = np.array([rgb(c) for c in colors], float)
    out = np.zeros((*values.shape, 4), np.uint8)
    for k in range(3):
        out[..., k] = np.interp(t, np.arange(len(colors)), table[:, k])
    out[..., 3] = np.where(known, 255, 0)
    return out


def to_wgs84(values: np.ndarray, grid: Grid) -> tuple[np.ndarray, tuple[float, float, float, float]]:
    """The raster on a longitude-latitude lattice around it: each place takes the cell it falls in."""
    west, south, east, north = grid.bounds
    corners = [unproject_xy(x, y, grid.crs or "") for x in (west, east) for y in (south, north)]
    lon0, lon1 = min(c[0] for c in corners), max(c[0] for c in corners)
    lat0, lat1 = min(c[1] for c in corners), max(c[1] for c in corners)
    height, width = grid.shape
    # Over a site the projection is all but affine: places between are interpolated from a coarse lattice.
    k = 9
    lons, lats = np.linspace(lon0, lon1, k), np.linspace(lat1, lat0, k)
    coarse = np.array([[project_xy(lon, lat, grid.crs or "") for lon in lons] for lat in lats])
    u, v = (np.arange(width) + 0.5) / width * (k - 1), (np.arange(height) + 0.5) / height * (k - 1)

    def spread(a: np.ndarray) -> np.ndarray:
        rows = np.array([np.interp(u, np.arange(k), r) for r in a])
        return np.array([np.interp(v, np.arange(k), rows[:, j]) for j in range(width)]).T

    col = np.floor((spread(coarse[..., 0]) - grid.x0) / grid.res).astype(int)
    row = np.floor((grid.y1 - spread(coarse[..., 1])) / grid.res).astype(int)
    inside = (col >= 0) & (col < width) & (row >= 0) & (row < height)
    return np.where(inside, values[np.clip(row, 0, height - 1), np.clip(col, 0, width - 1)], np.nan), (lon0, lat0, lon1, lat1)


def legend(classes: Any) -> bytes:
    out = np.full((20 * len(classes) + 4, 40, 4), 255, np.uint8)
    for i, c in enumerate(classes):
        out[4 + 20 * i : 20 + 20 * i, 4:36, :3] = rgb(c.color)
    return png(out)


def write_kmz(path: str | Path, products: Products, title: str, description: str, drainage: list[dict[str, Any]], zones: list[dict[str, Any]]) -> None:
    files: dict[str, bytes] = {}
    overlays = []
    layers = [("Elevation", "dem", "dem"), ("Canopy height", "chm", "chm"), ("Slope", "slope", "slope"), ("Hillshade", "hillshade", "hillshade"), ("Contributing area", "log_area", "log_area"), ("Vegetation class", "code", None)]
    floor = classes.woody_floor(products.classes)
    drawn = products.cells.select("row", "col", "dem", "slope", "hillshade", "code", F.when(F.col("chm") >= floor, F.col("chm")).alias("chm"), terrain.log_contributing_area(products.grid).alias("log_area"))
    # On the executors, to pictures of bounded size.
    taken = {c: F.mode(c, True) if c == "code" else F.max(c) if c in ("chm", "log_area") else F.avg(c) for _, c, _ in layers}
    drawn, grid = raster.reduced(drawn, products.grid, PIXELS, **taken)
    drawn = cut(drawn)
    for k, (name, column, colors) in enumerate(layers):
        values, (w, s, e, n) = to_wgs84(to_array(drawn, grid, column), grid)
        if colors:
            image = ramp(values, RAMPS[colors])
        else:
            image = np.zeros((*values.shape, 4), np.uint8)
            for c in products.classes:
                image[values == c.code] = (*rgb(c.color), 255 if c.woody else 0)
        files[f"files/{column}.png"] = png(image)
        box = f"<LatLonBox><north>{n:.7f}</north><south>{s:.7f}</south><east>{e:.7f}</east><west>{w:.7f}</west></LatLonBox>"
        overlays.append(f"<GroundOverlay><name>{name}</name><visibility>{int(k == 0)}</visibility><Icon><href>files/{column}.png</href></Icon>{box}</GroundOverlay>")
    files["files/legend.png"] = legend(products.classes)
    styles = "".join(f'<Style id="order{i + 1}"><LineStyle><color>{kml_color(c)}</color><width>{i + 1.5}</width></LineStyle></Style>' for i, c in enumerate(WATER[:ORDERS]))
    styles += '<Style id="zone"><LineStyle><color>ff00ffff</color><width>2</width></LineStyle><PolyStyle><fill>0</fill></PolyStyle></Style>'
    place = lambda ring: " ".join(f"{x:.7f},{y:.7f},0" for x, y in ring)
    lines = "".join(
        f"<Placemark><name>Reach {f['properties']['reach_id']}</name><styleUrl>#order{min(ORDERS, f['properties']['strahler_order'])}</styleUrl><LineString><tessellate>1</tessellate><coordinates>{place(f['geometry']['coordinates'])}</coordinates></LineString></Placemark>"
        for f in drainage
    )
    marks = []
    for f in zones:
        g = f["geometry"]
        polygons = g["coordinates"] if g["type"] == "MultiPolygon" else [g["coordinates"]]
        rings = "".join(
            f"<Polygon><outerBoundaryIs><LinearRing><coordinates>{place(p[0])}</coordinates></LinearRing></outerBoundaryIs>"
            + "".join(f"<innerBoundaryIs><LinearRing><coordinates>{place(r)}</coordinates></LinearRing></innerBoundaryIs>" for r in p[1:])
            + "</Polygon>"
            for p in polygons
        )
        marks.append(f"<Placemark><name>{escape(str(f['properties']['name']))}</name><styleUrl>#zone</styleUrl><MultiGeometry>{rings}</MultiGeometry></Placemark>")
    key = '<ScreenOverlay><name>Legend</name><Icon><href>files/legend.png</href></Icon><overlayXY x="0" y="1" xunits="fraction" yunits="fraction"/><screenXY x="0.01" y="0.99" xunits="fraction" yunits="fraction"/></ScreenOverlay>'
    folders = f"<Folder><name>Rasters</name>{''.join(overlays)}</Folder><Folder><name>Drainage</name>{lines}</Folder><Folder><name>Zones</name>{''.join(marks)}</Folder>{key}"
    kml = f'<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>{escape(title)}</name><description>{escape(description)}</description>{styles}{folders}</Document></kml>\n'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as package:
        for name, data in {"doc.kml": kml.encode(), **files}.items():
            package.writestr(zipfile.ZipInfo(name, STAMP), data, zipfile.ZIP_DEFLATED)
    Path(path).write_bytes(buffer.getvalue())
