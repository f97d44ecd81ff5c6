"""Map plates as SVG: a picture of a layer, lines and outlines over it, a legend, a scale bar and an arrow to the north.

Pictures have at most ``PIXELS`` a side, to which layers are brought on the
executors, so that a plate is of one size however large the site is.
"""

from __future__ import annotations

import base64
import math
from html import escape
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import functions as F

from ..model import SLOPE_EDGES, Grid
from ..operators import classes, hydrology, raster, terrain, zones
from ..plans.pipeline import Products
from ..sources.tiff import to_array
from .kmz import RAMPS, WATER, png, ramp, rgb

PIXELS, SIDE, MARGIN, KEY = 1000, 520, 24, 190
SLOPE_COLORS = ["#f7f4e9", "#f6d99a", "#e8925a", "#a03a2f"]
INK, PALE, OUTLINE = "#222222", "#666666", "#b5179e"


def nice_length(span: float) -> float:
    """Of 1, 2 and 5 times a power of ten, the length nearest to a fifth of the span."""
    target = span / 5.0
    power = math.floor(math.log10(target))
    return min((lead * 10.0**p for p in (power, power + 1) for lead in (1, 2, 5)), key=lambda length: abs(length - target))


class Plate:
    """A drawing in meters from the site's south-west corner, put on a page."""

    def __init__(self, grid: Grid, title: str, subtitle: str, footer: str) -> None:
        _, width, _, height = grid.extent_m
        self.width_m, self.height_m = width, height
        self.scale = SIDE / max(width, height)
        self.parts = [_text(MARGIN, 28, title, 18, INK, "bold"), _text(MARGIN, 48, subtitle, 12, PALE), _text(MARGIN, SIDE + 112, footer, 10, PALE)]
        self.key_at = 80

    def place(self, x: float, y: float) -> tuple[float, float]:
        return MARGIN + x * self.scale, 64 + (self.height_m - y) * self.scale

    def picture(self, rgba: np.ndarray) -> None:
        x, y = self.place(0.0, self.height_m)
        data = base64.b64encode(png(rgba)).decode()
        self.parts.append(f'<image x="{x:.1f}" y="{y:.1f}" width="{self.width_m * self.scale:.1f}" height="{self.height_m * self.scale:.1f}" preserveAspectRatio="none" href="data:image/png;base64,{data}"/>')

    def line(self, points: list[tuple[float, float]], color: str, width: float, closed: bool = False) -> None:
        where = " ".join(f"{x:.1f},{y:.1f}" for x, y in (self.place(*p) for p in points))
        self.parts.append(f'<{"polygon" if closed else "polyline"} points="{where}" fill="none" stroke="{color}" stroke-width="{width:.1f}" stroke-linejoin="round"/>')

    def label(self, x: float, y: float, text: str) -> None:
        at = self.place(x, y)
        self.parts.append(_text(*at, text, 11, INK, "bold", "middle"))

    def key(self, text: str, color: str | None = None) -> None:
        """A row of the legend."""
        x = MARGIN + SIDE + 20
        if color:
            self.parts.append(f'<rect x="{x}" y="{self.key_at - 10}" width="16" height="12" fill="{color}" stroke="{PALE}" stroke-width="0.5"/>')
        self.parts.append(_text(x + (24 if color else 0), self.key_at, text, 11, INK))
        self.key_at += 20

    def ramp_key(self, name: str, colors: list[str], low: float, high: float, unit: str) -> None:
        self.key(name)
        for k in range(len(colors)):
            self.key(f"{low + (high - low) * k / (len(colors) - 1):.4g} {unit}".strip(), colors[k])

    def svg(self) -> str:
        x, y = self.place(0.0, 0.0)
        bar = nice_length(self.width_m)
        scale = f'<rect x="{x:.1f}" y="{y + 14:.1f}" width="{bar * self.scale:.1f}" height="4" fill="{INK}"/>' + _text(x + bar * self.scale + 6, y + 20, f"{bar:g} m", 11, INK)
        right = MARGIN + self.width_m * self.scale
        arrow = f'<path d="M{right - 14:.1f} 92 l6 -18 l6 18 z" fill="{INK}"/>' + _text(right - 8, 106, "N", 11, INK, "bold", "middle")
        width, height = MARGIN * 2 + SIDE + KEY, SIDE + 128
        head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}" font-family="sans-serif"><rect width="{width}" height="{height}" fill="#ffffff"/>'
        return head + "".join(self.parts) + scale + arrow + "</svg>\n"


def _text(x: float, y: float, text: str, size: int, color: str, weight: str = "normal", anchor: str = "start") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" font-size="{size}" fill="{color}" font-weight="{weight}" text-anchor="{anchor}">{escape(text)}</text>'


def _gray(shade: np.ndarray) -> np.ndarray:
    """Hillshade as a pale ground for what lies over it."""
    out = np.full((*shade.shape, 4), 255, np.uint8)
    out[..., :3] = (255 * (0.35 + 0.65 * np.nan_to_num(shade, nan=1.0)))[..., None]
    return out


def _over(under: np.ndarray, upper: np.ndarray, share: float = 0.8) -> np.ndarray:
    """A picture over another, which shows through, and whole where the upper one is transparent."""
    weight = (upper[..., 3:] / 255.0) * share
    out = under.copy()
    out[..., :3] = upper[..., :3] * weight + under[..., :3] * (1 - weight)
    return out


def write_maps(folder: str | Path, products: Products, title: str, footer: str) -> list[Path]:
    """Six plates: terrain, canopy, vegetation, hydrology, slope and an overview."""
    into = Path(folder)
    into.mkdir(parents=True, exist_ok=True)
    floor = classes.woody_floor(products.classes)
    whole = products.cells.withColumn("_log", terrain.log_contributing_area(products.grid)).withColumn("_chm", F.when(F.col("chm") >= floor, F.col("chm")))
    cells, grid = raster.reduced(whole, products.grid, PIXELS, dem=F.avg("dem"), hillshade=F.avg("hillshade"), chm=F.max("_chm"), slope=F.avg("slope"), log_area=F.max("_log"), code=F.mode("code", True))
    cells = terrain.shaded_color(cells)
    layer = {name: to_array(cells, grid, name) for name in ("hillshade", "chm", "slope", "log_area", "code", "red", "green", "blue", "dem")}
    ground = _gray(layer["hillshade"])
    color = np.full((*grid.shape, 4), 255, np.uint8)
    color[..., :3] = np.nan_to_num(255 * np.stack([layer[c] for c in ("red", "green", "blue")], axis=-1), nan=255.0)

    def coded(steps: list[tuple[np.ndarray, str | None]]) -> np.ndarray:
        out = np.zeros((*grid.shape, 4), np.uint8)
        for where, named in steps:
            if named:
                out[where] = (*rgb(named), 255)
        return out

    edges = list(zip(SLOPE_EDGES, SLOPE_EDGES[1:], strict=False))
    height_classes = coded([(layer["code"] == c.code, c.color if c.woody else None) for c in products.classes])
    pictures = {
        "terrain": color,
        "overview": _over(color, height_classes),
        "canopy": _over(ground, ramp(layer["chm"], RAMPS["chm"])),
        "vegetation": _over(ground, height_classes),
        "hydrology": _over(ground, ramp(layer["log_area"], RAMPS["log_area"])),
        "slope": _over(ground, coded([((layer["slope"] >= a) & (layer["slope"] < b), c) for (a, b), c in zip(edges, SLOPE_COLORS, strict=True)])),
    }
    stats = products.stats.first()
    names = {"terrain": "bare-earth terrain", "canopy": "canopy height", "vegetation": "vegetation height classes", "hydrology": "drainage", "slope": "slope", "overview": "overview"}
    streams = _streams(products)
    areas = {r["code"]: r for r in products.class_areas.collect()}
    labels = {r["zone_id"]: (r["row"], r["col"]) for r in zones.label_places(products.cells).collect()} if products.zones else {}
    out = []
    for name, text in names.items():
        plate = Plate(products.grid, f"{title}: {text}", f"{stats['area_acres']:.1f} acres, cells of {products.grid.res_m:g} m", footer)
        plate.picture(pictures[name])
        if name in ("terrain", "hydrology", "overview"):
            for order, points in streams:
                plate.line(points, WATER[min(order, len(WATER)) - 1], 0.8 + 0.7 * order)
        if name in ("vegetation", "overview"):
            _zones(plate, products, labels)
        if name == "canopy":
            _ramp_key(plate, f"Canopy height from {floor:g} m", "chm", layer["chm"], "m")
        elif name == "vegetation":
            for c in products.classes:
                plate.key(f"{c.label}: {areas[c.code]['area_acres']:.2f} ac ({areas[c.code]['percent']:.1f} %)", c.color if c.woody else "#ffffff")
        elif name == "hydrology":
            _ramp_key(plate, "Contributing area, log10 of m2", "log_area", layer["log_area"], "")
        elif name == "slope":
            for (a, b), c in zip(edges, SLOPE_COLORS, strict=True):
                label = f">{a:g}" if b == SLOPE_EDGES[-1] else f"{a:g}-{b:g}"
                plate.key(f"{label} degrees: {stats['slope_share_percent'][label]:.1f} %", c)
        else:
            _ramp_key(plate, "Elevation", "dem", layer["dem"], "m")
        if name == "overview":
            for c in products.classes:
                if c.woody:
                    plate.key(c.label, c.color)
        path = into / f"{name}.svg"
        path.write_text(plate.svg(), encoding="utf-8", newline="\n")
        out.append(path)
    return out


def _ramp_key(plate: Plate, name: str, colors: str, values: np.ndarray, unit: str) -> None:
    known = values[~np.isnan(values)]
    low, high = (known.min(), known.max()) if colors == "dem" and len(known) else np.percentile(known, [2, 98]) if len(known) else (0.0, 0.0)
    plate.ramp_key(name, RAMPS[colors], float(low), float(high), unit)


def _streams(products: Products) -> list[tuple[int, list[tuple[float, float]]]]:
    """Order and line, in meters from the south-west corner, of each reach."""
    lined = products.reaches.withColumn("line", hydrology.reach_line("cells", products.grid)).withColumn("line", hydrology.simplify_staircase("line"))

    def local(p: Any) -> Any:
        x, y = products.grid.local_meters(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    rows = lined.select("reach_id", "strahler_order", F.transform("line", local).alias("line")).orderBy("reach_id").collect()
    return [(r["strahler_order"], [(p["x"], p["y"]) for p in r["line"]]) for r in rows]


def _zones(plate: Plate, products: Products, labels: dict[int, tuple[float, float]]) -> None:
    west, south, *_ = products.grid.bounds
    unit, res = products.grid.meters_per_unit, products.grid.res_m
    for zone in products.zones:
        for polygon in zone.polygons:
            for ring in polygon:
                plate.line([((x - west) * unit, (y - south) * unit) for x, y in ring], OUTLINE, 1.4, closed=True)
        if zone.zone_id in labels:
            row, col = labels[zone.zone_id]
            plate.label((col + 0.5) * res, plate.height_m - (row + 0.5) * res, zone.name)
