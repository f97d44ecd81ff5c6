"""Longitude and latitude to projected coordinates and back, as Column expressions and as plain functions.

Transverse Mercator (UTM by number, others by their WKT) goes by Krueger's series
to the sixth order; Lambert's conformal and Albers' equal-area cone, as their WKT
or a number of a few common ones says.  Ellipsoids of GRS80 and WGS84 are one
here, to a tenth of a millimeter, and so are their datums, to a meter or two.
"""

from __future__ import annotations

import math
import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InputDataError
from ..model import INTERNATIONAL_FOOT, US_SURVEY_FOOT

# The WGS84 ellipsoid and UTM's scale and false origin.
A, FLATTENING, K0, FALSE_EASTING, FALSE_NORTHING = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
N = FLATTENING / (2 - FLATTENING)
E = math.sqrt(FLATTENING * (2 - FLATTENING))
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
ALPHA = (
    N / 2 - 2 / 3 * N**2 + 5 / 16 * N**3 + 41 / 180 * N**4 - 127 / 288 * N**5 + 7891 / 37800 * N**6,
    13 / 48 * N**2 - 3 / 5 * N**3 + 557 / 1440 * N**4 + 281 / 630 * N**5 - 1983433 / 1935360 * N**6,
    61 / 240 * N**3 - 103 / 140 * N**4 + 15061 / 26880 * N**5 + 167603 / 181440 * N**6,
    49561 / 161280 * N**4 - 179 / 168 * N**5 + 6601661 / 7257600 * N**6,
    34729 / 80640 * N**5 - 3418889 / 1995840 * N**6,
    212378941 / 319334400 * N**6,
)
BETA = (
    N / 2 - 2 / 3 * N**2 + 37 / 96 * N**3 - 1 / 360 * N**4 - 81 / 512 * N**5 + 96199 / 604800 * N**6,
    1 / 48 * N**2 + 1 / 15 * N**3 - 437 / 1440 * N**4 + 46 / 105 * N**5 - 1118711 / 3870720 * N**6,
    17 / 480 * N**3 - 37 / 840 * N**4 - 209 / 4480 * N**5 + 5569 / 90720 * N**6,
    4397 / 161280 * N**4 - 11 / 504 * N**5 - 830251 / 7257600 * N**6,
    4583 / 161280 * N**5 - 108847 / 3991680 * N**6,
    20648693 / 638668800 * N**6,
)
#: From the conformal latitude to the geographic one.
DELTA = (
    2 * N - 2 / 3 * N**2 - 2 * N**3 + 116 / 45 * N**4 + 26 / 45 * N**5 - 2854 / 675 * N**6,
    7 / 3 * N**2 - 8 / 5 * N**3 - 227 / 45 * N**4 + 2704 / 315 * N**5 + 2323 / 945 * N**6,
    56 / 15 * N**3 - 136 / 35 * N**4 - 1262 / 105 * N**5 + 73814 / 2835 * N**6,
    4279 / 630 * N**4 - 332 / 35 * N**5 - 399572 / 14175 * N**6,
    4174 / 315 * N**5 - 144838 / 6237 * N**6,
    601676 / 22275 * N**6,
)


class _Plain:
    """Functions of floats, under the names that those of columns have."""

    def __getattr__(self, name: str) -> Any:
        return getattr(math, name)

    @staticmethod
    def let(value: Any, use: Callable[[Any], Any]) -> Any:
        return use(value)


class _Columns:
    def __getattr__(self, name: str) -> Any:
        return getattr(F, name)

    @staticmethod
    def let(value: Column, use: Callable[[Column], Column]) -> Column:
        """``use`` of a value that is computed once, however often it is used."""
        return F.transform(F.array(value), use)[0]


PLAIN, COLUMNS = _Plain(), _Columns()


def epsg(crs: str | None) -> int | None:
    """The EPSG number of an ``EPSG:n`` name or of the outermost authority of a WKT."""
    if not crs:
        return None
    if m := re.fullmatch(r"\s*EPSG:(\d+)\s*", crs, re.IGNORECASE):
        return int(m[1])
    found = re.findall(r"(?:AUTHORITY\[\s*\"EPSG\"\s*,\s*\"?|ID\[\s*\"EPSG\"\s*,\s*)(\d+)", crs)
    return int(found[-1]) if found else None


@dataclass(frozen=True)
class System:
    """A projection: kind, origin and standard parallels in degrees, scale, false origin in units, meters in a unit."""

    kind: str
    lon0: float
    lat0: float = 0.0
    first: float = 0.0
    second: float = 0.0
    scale: float = 1.0
    east: float = 0.0
    north: float = 0.0
    unit: float = 1.0


#: Equal-area systems of the conterminous United States, Alaska and Europe's conformal one.
NUMBERED = {
    5070: System("albers", -96.0, 23.0, 29.5, 45.5),
    6350: System("albers", -96.0, 23.0, 29.5, 45.5),
    3338: System("albers", -154.0, 50.0, 55.0, 65.0),
    3034: System("lambert", 10.0, 52.0, 35.0, 65.0, 1.0, 4_000_000.0, 2_800_000.0),
}
METHODS = {"transversemercator": "mercator", "lambertconformalconic": "lambert", "lambertconicconformal": "lambert", "albersconicequalarea": "albers", "albersequalarea": "albers", "albers": "albers"}
#: What a parameter is by its name's letters, in old and new texts.
NAMES = {
    "lon0": ("centralmeridian", "longitudeofcenter", "longitudeofnaturalorigin", "longitudeoffalseorigin", "longitudeoforigin"),
    "lat0": ("latitudeoforigin", "latitudeofcenter", "latitudeofnaturalorigin", "latitudeoffalseorigin"),
    "first": ("standardparallel1", "latitudeof1ststandardparallel"),
    "second": ("standardparallel2", "latitudeof2ndstandardparallel"),
    "scale": ("scalefactor", "scalefactoratnaturalorigin"),
    "east": ("falseeasting", "eastingatfalseorigin"),
    "north": ("falsenorthing", "northingatfalseorigin"),
}


def system(crs: str | None) -> System:
    """The projection that a number or a WKT names; an error for one that isn't known here."""
    code = epsg(crs)
    if code is not None:
        for base, south in ((32600, False), (32700, True), (26900, False), (25800, False)):
            if 1 <= code - base <= 60:
                return System("mercator", 6 * (code - base) - 183, scale=K0, east=FALSE_EASTING, north=FALSE_NORTHING if south else 0.0)
        if code in NUMBERED:
            return NUMBERED[code]
    letters = lambda text: re.sub(r"[^a-z0-9]", "", text.lower())
    method = re.search(r'(?:PROJECTION|METHOD)\[\s*"([^"]+)"', crs or "")
    kind = METHODS.get(re.sub(r"[12]sp$", "", letters(method[1]))) if method else None
    if kind is None:
        raise InputDataError(f"coordinates of {(crs or '')[:60]!r} can't be converted; it is no transverse Mercator, Lambert or Albers system")
    given = {letters(name): float(value) for name, value in re.findall(r'PARAMETER\[\s*"([^"]+)"\s*,\s*([-+0-9.eE]+)', crs or "")}
    found = {field: next((given[n] for n in names if n in given), None) for field, names in NAMES.items()}
    if kind == "lambert" and found["first"] is None:  # a cone that touches along its origin's parallel
        found["first"] = found["lat0"]
    if found["lon0"] is None or kind != "mercator" and found["first"] is None:
        raise InputDataError(f"{(crs or '')[:60]!r} lacks parameters of its projection")
    found["second"] = found["first"] if found["second"] is None else found["second"]
    return System(kind, unit=meters_per_unit(crs), **{k: v for k, v in found.items() if v is not None})


def meters_per_unit(crs: str | None) -> float:
    """Meters in a unit of a projected system; an error where it is unknown or geographic."""
    if not crs:
        raise InputDataError("the coordinate system is unknown")
    code, text = epsg(crs), crs.upper()
    if code in (4326, 4269, 4979) or text.lstrip().startswith(("GEOGCS", "GEOGCRS", "GEODCRS")):
        raise InputDataError("coordinates are degrees; a projected system is needed")
    if code in NUMBERED:
        return NUMBERED[code].unit
    if code is not None and (32601 <= code <= 32660 or 32701 <= code <= 32760 or 26901 <= code <= 26923 or 25828 <= code <= 25838):
        return 1.0
    units = re.findall(r'(?:LENGTHUNIT|UNIT)\[\s*"([^"]*)"\s*,\s*([0-9.eE+-]+)', crs, re.IGNORECASE)
    lengths = [(name, float(value)) for name, value in units if "degree" not in name.lower()]
    if lengths:
        name, value = lengths[-1]
        if re.search(r"us.*survey|foot_us", name, re.IGNORECASE):
            return US_SURVEY_FOOT
        return INTERNATIONAL_FOOT if re.fullmatch(r"(international )?foot", name, re.IGNORECASE) else value
    warnings.warn(f"the unit of {crs[:60]!r} can't be read; meters are assumed", stacklevel=2)
    return 1.0


def _series(at: Any, across: Any, coefficients: tuple[float, ...], f: Any, first: str, second: str) -> Any:
    """Sum of coefficient j times first(2 j at) times second(2 j across)."""
    out = 0.0
    for j, a in enumerate(coefficients, 1):
        out = getattr(f, first)(at * (2 * j)) * getattr(f, second)(across * (2 * j)) * a + out
    return out


def _mercator(lon: Any, lat: Any, lon0: float, f: Any) -> tuple[Any, Any]:
    """Meters east of the central meridian and north of the equator; ``f`` has the functions, of floats or of columns."""
    lam = (lon - lon0) * (math.pi / 180)
    sine = f.sin(lat * (math.pi / 180))
    t = f.sinh(f.atanh(sine) - f.atanh(sine * E) * E)
    along = lambda t: f.atan2(t, f.cos(lam))
    across = lambda t: f.asinh(f.sin(lam) / f.sqrt(t * t + f.cos(lam) * f.cos(lam)))

    def bound(g: Callable[[Any, Any], Any]) -> Any:
        return f.let(t, lambda v: f.let(along(v), lambda xi: f.let(across(v), lambda eta: g(xi, eta))))

    return bound(lambda xi, eta: (eta + _series(xi, eta, ALPHA, f, "cos", "sinh")) * RADIUS), bound(lambda xi, eta: (xi + _series(xi, eta, ALPHA, f, "sin", "cosh")) * RADIUS)


def _latitude(conformal: Any, f: Any) -> Any:
    return f.let(conformal, lambda chi: sum((f.sin(chi * (2 * j)) * d for j, d in enumerate(DELTA, 1)), chi) * (180 / math.pi))


def _unmercator(x: Any, y: Any, lon0: float, f: Any) -> tuple[Any, Any]:
    xi, eta = y / RADIUS, x / RADIUS
    u, v = xi - _series(xi, eta, BETA, f, "sin", "cosh"), eta - _series(xi, eta, BETA, f, "cos", "sinh")
    return f.atan2(f.sinh(v), f.cos(u)) * (180 / math.pi) + lon0, _latitude(f.asin(f.sin(u) / f.cosh(v)), f)


def _width(degrees: float) -> float:
    """A parallel's radius, the equator's being 1."""
    sine = math.sin(math.radians(degrees))
    return math.cos(math.radians(degrees)) / math.sqrt(1 - (E * sine) ** 2)


def _conformal(sine: Any, f: Any) -> Any:
    """The tangent of half the conformal distance from the pole."""
    return f.exp(f.atanh(sine * E) * E - f.atanh(sine))


def _area(sine: Any, f: Any) -> Any:
    """The area between the equator and a parallel, as that of a cylinder's height."""
    return (sine / (1 - sine * sine * (E * E)) + f.atanh(sine * E) / E) * (1 - E * E)


def _sine(degrees: float) -> float:
    return math.sin(math.radians(degrees))


def _cone(s: System) -> tuple[float, float, float]:
    """The cone's constant, its size, and the radius of the origin's parallel."""
    if s.kind == "lambert":
        t1, t2 = (_conformal(_sine(p), PLAIN) for p in (s.first, s.second))
        n = math.log(_width(s.first) / _width(s.second)) / math.log(t1 / t2) if s.first != s.second else _sine(s.first)
        size = s.scale * _width(s.first) / (n * t1**n)
        return n, size, A * size * _conformal(_sine(s.lat0), PLAIN) ** n
    q1, q2 = (_area(_sine(p), PLAIN) for p in (s.first, s.second))
    n = (_width(s.first) ** 2 - _width(s.second) ** 2) / (q2 - q1) if s.first != s.second else _sine(s.first)
    size = _width(s.first) ** 2 + n * q1
    return n, size, A * math.sqrt(size - n * _area(_sine(s.lat0), PLAIN)) / n


def _forward(lon: Any, lat: Any, s: System, f: Any) -> tuple[Any, Any]:
    """Easting and northing in the system's units."""
    if s.kind == "mercator":
        x, y = _mercator(lon, lat, s.lon0, f)
        base = _mercator(s.lon0, s.lat0, s.lon0, PLAIN)[1] if s.lat0 else 0.0
        return x * (s.scale / s.unit) + s.east, (y - base) * (s.scale / s.unit) + s.north
    n, size, origin = _cone(s)
    sine, theta = f.sin(lat * (math.pi / 180)), (lon - s.lon0) * (n * math.pi / 180)
    radius = f.pow(_conformal(sine, f), n) * (A * size) if s.kind == "lambert" else f.sqrt(size - _area(sine, f) * n) * (A / n)
    return radius * f.sin(theta) / s.unit + s.east, (origin - radius * f.cos(theta)) / s.unit + s.north


def _inverse(x: Any, y: Any, s: System, f: Any) -> tuple[Any, Any]:
    """Longitude and latitude in degrees."""
    x, y = (x - s.east) * s.unit, (y - s.north) * s.unit
    if s.kind == "mercator":
        base = _mercator(s.lon0, s.lat0, s.lon0, PLAIN)[1] if s.lat0 else 0.0
        return _unmercator(x / s.scale, y / s.scale + base, s.lon0, f)
    n, size, origin = _cone(s)
    side = math.copysign(1.0, n)
    radius, theta = f.sqrt(x * x + (origin - y) * (origin - y)), f.atan2(x * side, (origin - y) * side)
    lon = theta * (180 / (n * math.pi)) + s.lon0
    if s.kind == "lambert":
        half = f.pow(radius * (side / (A * size)), 1 / n)
        return lon, _latitude(f.atan(half) * -2.0 + math.pi / 2, f)
    beta = f.asin((size - radius * radius * (n * n / (A * A))) / (n * _area(1.0 - 1e-16, PLAIN)))
    e2, e4, e6 = E**2, E**4, E**6
    terms = (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040, 23 * e4 / 360 + 251 * e6 / 3780, 761 * e6 / 45360)
    return lon, f.let(beta, lambda b: sum((f.sin(b * (2 * j)) * c for j, c in enumerate(terms, 1)), b) * (180 / math.pi))


def project(lon: Column, lat: Column, crs: str) -> tuple[Column, Column]:
    return _forward(lon, lat, system(crs), COLUMNS)


def unproject(x: Column, y: Column, crs: str) -> tuple[Column, Column]:
    return _inverse(x, y, system(crs), COLUMNS)


def project_xy(lon: float, lat: float, crs: str) -> tuple[float, float]:
    return _forward(lon, lat, system(crs), PLAIN)


def unproject_xy(x: float, y: float, crs: str) -> tuple[float, float]:
    return _inverse(x, y, system(crs), PLAIN)


def project_bounds(bbox: tuple[float, float, float, float], crs: str, points: int = 21) -> tuple[float, float, float, float]:
    """The box around a longitude-latitude box's edges, each with ``points`` between its ends."""
    west, south, east, north = bbox
    steps = [i / (points + 1) for i in range(points + 2)]
    along: Callable[[float, float, float], float] = lambda a, b, t: a + (b - a) * t
    edge = [(along(west, east, t), lat) for t in steps for lat in (south, north)] + [(lon, along(south, north, t)) for t in steps for lon in (west, east)]
    xs, ys = zip(*(project_xy(lon, lat, crs) for lon, lat in edge), strict=True)
    return min(xs), min(ys), max(xs), max(ys)
