"""Distances on the sphere and planar relations of points, lines and polygons, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth in metres.
RADIUS = 6371008.771415

Point = tuple[float, float]


def distance(lon: Column, lat: Column, point: Point) -> Column:
    """Metres on the sphere between a column's points and a fixed one (haversine)."""
    lon2, lat2 = F.lit(float(point[0])), F.lit(float(point[1]))
    dlat, dlon = F.radians(lat2 - lat), F.radians(lon2 - lon)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * RADIUS) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def near(lon: Column, lat: Column, point: Point, most: float | None = None, least: float | None = None) -> Column:
    """At most, or at least, so many metres away. A box of latitudes comes first: it can be pushed into the scan."""
    d = distance(lon, lat, point)
    if most is not None:
        degrees = most / RADIUS * 57.29577951308232 + 1e-9
        return lat.between(point[1] - degrees, point[1] + degrees) & (d <= most)
    return d >= (least or 0.0)


def in_polygon(lon: Column, lat: Column, ring: list[Point]) -> Column:
    """Inside a simple ring or on its edge. The ring is a literal: one test for each edge in the generated code."""
    odd, edge = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (x1, y1) == (x2, y2):
            continue
        cross = (lon - x1) * (y2 - y1) - (lat - y1) * (x2 - x1)
        edge = edge | ((cross == 0) & lon.between(min(x1, x2), max(x1, x2)) & lat.between(min(y1, y2), max(y1, y2)))
        if y1 != y2:
            low, high = min(y1, y2), max(y1, y2)
            at = F.lit(x1) + (lat - y1) * ((x2 - x1) / (y2 - y1))
            odd = odd + F.when((lat >= low) & (lat < high) & (lon < at), 1).otherwise(0)
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    box = lon.between(min(xs), max(xs)) & lat.between(min(ys), max(ys))
    return box & (edge | (odd % 2 == 1))


def on_line(lon: Column, lat: Column, line: list[Point]) -> Column:
    """On one of the line's segments."""
    out = F.lit(False)
    for (x1, y1), (x2, y2) in zip(line[:-1], line[1:], strict=True):
        cross = (lon - x1) * (y2 - y1) - (lat - y1) * (x2 - x1)
        out = out | ((cross == 0) & lon.between(min(x1, x2), max(x1, x2)) & lat.between(min(y1, y2), max(y1, y2)))
    return out


def relation(name: str, kind: str, coordinates: list, lon: Column, lat: Column) -> Column:
    """within, contains, intersects, equals, disjoint, overlaps of the entity's point to a geometry; heights are ignored.

    A point contains only an equal point and never overlaps anything (their dimensions differ or they are equal).
    """
    flat = lambda p: (float(p[0]), float(p[1]))
    if kind == "Point":
        touch = same = (lon == flat(coordinates)[0]) & (lat == flat(coordinates)[1])
    elif kind == "MultiPoint":
        points = [flat(p) for p in coordinates]
        touch = F.lit(False)
        for x, y in points:
            touch = touch | ((lon == x) & (lat == y))
        same = touch if len(set(points)) == 1 else F.lit(False)
    elif kind in ("LineString", "MultiLineString"):
        lines = [coordinates] if kind == "LineString" else coordinates
        touch, same = F.lit(False), F.lit(False)
        for line in lines:
            touch = touch | on_line(lon, lat, [flat(p) for p in line])
    elif kind in ("Polygon", "MultiPolygon"):
        touch, same = F.lit(False), F.lit(False)
        for rings in [coordinates] if kind == "Polygon" else coordinates:
            here = in_polygon(lon, lat, [flat(p) for p in rings[0]])
            for hole in rings[1:]:
                ring = [flat(p) for p in hole]
                here = here & (~in_polygon(lon, lat, ring) | on_line(lon, lat, [*ring, ring[0]]))
            touch = touch | here
        if name == "within":  # a point on the border isn't within
            for rings in [coordinates] if kind == "Polygon" else coordinates:
                for ring in rings:
                    points = [flat(p) for p in ring]
                    touch = touch & ~on_line(lon, lat, [*points, points[0]])
    else:
        raise ValueError(f"unknown geometry {kind!r}")
    tests = {"within": touch, "intersects": touch, "disjoint": ~touch, "equals": same, "contains": same, "overlaps": F.lit(False)}
    return tests[name]
