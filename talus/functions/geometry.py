"""Polygons and lines as nested arrays of (x, y)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POLYGONS = "array<array<array<struct<x:double,y:double>>>>"


def _crossings(ring: str, x: str, y: str) -> str:
    """SQL: how many of a closed ring's edges a ray to the east crosses; an edge has its lower end, not its upper."""
    return (
        f"aggregate(sequence(0, greatest(size({ring}) - 2, 0)), 0, (n, i) -> n + if("
        f"i + 1 < size({ring}) AND ({ring}[i].y <= {y}) != ({ring}[i + 1].y <= {y}) AND "
        f"{x} < {ring}[i].x + ({y} - {ring}[i].y) * try_divide({ring}[i + 1].x - {ring}[i].x, {ring}[i + 1].y - {ring}[i].y), 1, 0))"
    )


def contains(polygons: str, x: str, y: str) -> Column:
    """Whether a place is in any polygon and in none of its holes: the even-odd rule over a polygon's rings."""
    inside = f"aggregate(p, 0, (a, ring) -> a + {_crossings('ring', x, y)}) % 2 = 1"
    return F.expr(f"exists({polygons}, p -> {inside})")


def distance_to_line(line: str, x: str, y: str) -> Column:
    """Distance from a place to the nearest vertex of a line."""
    return F.expr(f"array_min(transform({line}, p -> hypot(p.x - {x}, p.y - {y})))")
