"""Slope, aspect and hillshade from the gradient of Horn's eight neighbours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import SLOPE_EDGES, Grid, HillshadeParams
from .raster import around

FLAT = 1e-6
#: The least contributing area that is mapped, the light of full shade, and the colors from low to high.
LEAST_MAPPED_M2, SHADE = 200.0, 0.45
ELEVATION_COLORS = ("#2f5d50", "#a9c58b", "#e8dcb5", "#a0704c")


def horn_gradient(nb: str, res_m: float) -> tuple[Column, Column]:
    """Rise eastward and northward per meter, from the struct of the nine values."""
    g = {k: F.col(f"{nb}.{k}") for k in ("nw", "n", "ne", "w", "e", "sw", "s", "se")}
    span = F.lit(8.0 * res_m)
    dx = ((g["ne"] + F.lit(2.0) * g["e"] + g["se"]) - (g["nw"] + F.lit(2.0) * g["w"] + g["sw"])) / span
    dy = ((g["nw"] + F.lit(2.0) * g["n"] + g["ne"]) - (g["sw"] + F.lit(2.0) * g["s"] + g["se"])) / span
    return dx, dy


def with_gradient(cells: DataFrame, res_m: float, value: str = "dem", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds dz_dx and dz_dy."""
    dx, dy = horn_gradient("_nb", res_m)
    return around(cells, value, into="_nb", by=by).withColumn("dz_dx", dx).withColumn("dz_dy", dy).drop("_nb")


def slope_degrees(dx: str = "dz_dx", dy: str = "dz_dy") -> Column:
    return F.degrees(F.atan(F.hypot(F.col(dx), F.col(dy))))


def aspect_degrees(dx: str = "dz_dx", dy: str = "dz_dy") -> Column:
    """Compass direction of the fall, from 0 up to but without 360; null where it is flat."""
    flat = F.hypot(F.col(dx), F.col(dy)) < FLAT
    return F.when(~flat, F.pmod(F.degrees(F.atan2(-F.col(dx), -F.col(dy))), F.lit(360.0)))


def hillshade(params: HillshadeParams = HillshadeParams(), dx: str = "dz_dx", dy: str = "dz_dy") -> Column:
    """Share of light from the sun's direction, from 0 to 1."""
    azimuth, altitude = math.radians(params.azimuth_deg), math.radians(params.altitude_deg)
    p, q = F.col(dx) * F.lit(params.z_factor), F.col(dy) * F.lit(params.z_factor)
    # Dot product of the sun's direction and the surface's normal (-p, -q, 1).
    facing = F.lit(math.sin(altitude)) - F.lit(math.cos(altitude) * math.sin(azimuth)) * p - F.lit(math.cos(altitude) * math.cos(azimuth)) * q
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), facing / F.sqrt(F.lit(1.0) + p * p + q * q)))


def slope_shares(slope: str = "slope", edges: tuple[float, ...] = SLOPE_EDGES) -> Column:
    """Aggregate: a map from slope bin to its percentage of all cells; a bin has its lower edge."""
    bins = []
    for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        label = f">{low:g}" if i == len(edges) - 2 else f"{low:g}-{high:g}"
        inside = (F.col(slope) >= low) & (F.col(slope) < high)
        bins.append(F.struct(F.lit(label).alias("key"), F.try_divide(F.lit(100.0) * F.coalesce(F.sum(inside.cast("long")), F.lit(0)), F.count(F.lit(1))).alias("value")))
    return F.map_from_entries(F.array(*bins))


def log_contributing_area(grid: Grid, acc: str = "acc") -> Column:
    """Decimal logarithm of the square meters that drain through a cell; null below what is worth a mark."""
    area = F.col(acc) * F.lit(grid.cell_area_m2)
    return F.when(area >= LEAST_MAPPED_M2, F.log10(area))


def shaded_color(cells: DataFrame, value: str = "dem", shade: str = "hillshade", colors: tuple[str, ...] = ELEVATION_COLORS) -> DataFrame:
    """Adds ``red``, ``green`` and ``blue`` from 0 to 1: a ramp over the values, darker where there is less light."""
    low, high = cells.agg(F.min(value), F.max(value)).first()
    if low is None:
        return cells.withColumns(dict.fromkeys(("red", "green", "blue"), F.lit(None).cast("double")))
    share = (F.col(value) - F.lit(low)) / F.lit(max(high - low, 1e-9)) * F.lit(float(len(colors) - 1))
    below = F.least(F.floor(share), F.lit(len(colors) - 2))
    light = F.lit(SHADE) + F.lit(1.0 - SHADE) * F.col(shade)

    def channel(at: int) -> Column:
        steps = F.array(*(F.lit(int(c[1 + 2 * at : 3 + 2 * at], 16) / 255.0) for c in colors))
        first, second = F.get(steps, below.cast("int")), F.get(steps, (below + 1).cast("int"))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (first + (second - first) * (share - below)) * light))

    return cells.withColumns({name: F.when(F.col(value).isNotNull(), channel(i)) for i, name in enumerate(("red", "green", "blue"))})
