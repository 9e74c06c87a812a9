"""Geometry expressions: globe coordinates, visibility, grid bins, box projection."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EARTH_RADIUS_KM, HAZARD_GRID_DEG, MAX_DEPTH_KM, MAX_VISUAL_DEPTH
from .numeric import _c


def cartesian_xyz(lat, lon, depth_km=None) -> tuple[Column, Column, Column]:
    """Unit-globe position of a hypocentre: radius shrinks with depth.

    ``r = (R - d) / R``, polar angle ``90 - lat`` and azimuth ``lon + 180`` in radians,
    ``(-r sin(phi) cos(theta), r cos(phi), r sin(phi) sin(theta))``.
    """
    lat_c, lon_c = _c(lat).cast("double"), _c(lon).cast("double")
    d = F.lit(0.0) if depth_km is None else _c(depth_km).cast("double")
    r = (F.lit(EARTH_RADIUS_KM) - d) / F.lit(EARTH_RADIUS_KM)
    phi = F.radians(F.lit(90.0) - lat_c)
    theta = F.radians(lon_c + F.lit(180.0))
    x = -r * F.sin(phi) * F.cos(theta)
    y = r * F.cos(phi)
    z = r * F.sin(phi) * F.sin(theta)
    return x, y, z


def to_cartesian(lat, lon, depth_km=None) -> Column:
    x, y, z = cartesian_xyz(lat, lon, depth_km)
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def visual_depth_km(depth_km) -> Column:
    """Depth drawn on the globe: 0-700 km mapped to 0-0.15 globe radii."""
    return _c(depth_km).cast("double") / F.lit(MAX_DEPTH_KM) * F.lit(MAX_VISUAL_DEPTH) * F.lit(EARTH_RADIUS_KM)


def facing(lat, lon, camera: tuple[float, float, float]) -> Column:
    """True when the surface point lies on the camera's half of the globe (dot product > 0)."""
    cx, cy, cz = camera
    norm = math.sqrt(cx * cx + cy * cy + cz * cz) or 1.0
    ux, uy, uz = cx / norm, cy / norm, cz / norm
    x, y, z = cartesian_xyz(lat, lon, None)
    return (x * F.lit(ux) + y * F.lit(uy) + z * F.lit(uz)) > F.lit(0.0)


def grid_bin(col, deg: float = HAZARD_GRID_DEG) -> Column:
    """Cell index ``floor(x / deg)``; negatives floor downwards (-0.5 -> -1)."""
    return F.floor(_c(col).cast("double") / F.lit(float(deg)))


def cell_center(bin_col, deg: float = HAZARD_GRID_DEG) -> Column:
    return _c(bin_col).cast("double") * F.lit(float(deg)) + F.lit(deg / 2.0)


def project_box(lat, lon, bounds: dict, width: float, height: float) -> tuple[Column, Column]:
    """Pixel position in a ``width x height`` box over ``bounds`` (y grows downwards)."""
    lat_c, lon_c = _c(lat).cast("double"), _c(lon).cast("double")
    x = (lon_c - F.lit(bounds["min_lon"])) / F.lit(bounds["max_lon"] - bounds["min_lon"]) * F.lit(float(width))
    y = (F.lit(1.0) - (lat_c - F.lit(bounds["min_lat"])) / F.lit(bounds["max_lat"] - bounds["min_lat"])) * F.lit(float(height))
    return x, y


#: Bits of each axis in the space key; 2**16 steps are 300 m of latitude.
SPACE_BITS = 16


def _steps(value: float, low: float, span: float) -> int:
    return max(0, min((1 << SPACE_BITS) - 1, math.floor((value - low) / span * (1 << SPACE_BITS))))


def _axis(col, low: float, span: float) -> Column:
    c = _c(col).cast("double")
    at = F.when(c.between(-1000.0, 1000.0), F.floor((c - F.lit(low)) / F.lit(span) * F.lit(float(1 << SPACE_BITS))))
    at = F.greatest(F.lit(0).cast("long"), F.least(F.lit((1 << SPACE_BITS) - 1).cast("long"), at))
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):    # a zero bit behind each bit
        at = at.bitwiseOR(F.shiftleft(at, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return F.when(c.between(-1000.0, 1000.0), at)


def space_key(lat, lon) -> Column:
    """Position along a space-filling curve: the bits of latitude and longitude in turn, so that rows near
    each other in the order are near each other on the map. Null without a position."""
    return _axis(lon, -180.0, 360.0).bitwiseOR(F.shiftleft(_axis(lat, -90.0, 180.0), 1))


def box_ranges(min_lat: float, max_lat: float, min_lon: float, max_lon: float, most: int = 24) -> list[tuple[int, int]]:
    """Ranges of ``space_key`` (both ends included) that hold every point of the box, about ``most`` of them.

    Quadrants that lie in the box are ranges, those that cross its edge are divided, the largest first,
    until there are enough. The box is widened a little, as stored positions are rounded.
    """
    near = 1e-4
    x0, x1 = (_steps(v, -180.0, 360.0) for v in (min_lon - near, max_lon + near))
    y0, y1 = (_steps(v, -90.0, 180.0) for v in (min_lat - near, max_lat + near))
    if min_lat > max_lat or min_lon > max_lon:
        return []
    inside: list[tuple[int, int]] = []
    crossing = [(0, 0, 0, SPACE_BITS)]          # first key, x, y, bits of a side
    while crossing and len(inside) + len(crossing) < most:
        key, x, y, bits = crossing.pop(0)
        if not bits:
            inside.append((key, key))
            continue
        half = 1 << (bits - 1)
        for quadrant in range(4):
            qx, qy = x + half * (quadrant & 1), y + half * (quadrant >> 1)
            first = key + (quadrant << 2 * (bits - 1))
            if qx > x1 or qx + half - 1 < x0 or qy > y1 or qy + half - 1 < y0:
                continue
            if x0 <= qx and qx + half - 1 <= x1 and y0 <= qy and qy + half - 1 <= y1:
                inside.append((first, first + (1 << 2 * (bits - 1)) - 1))
            else:
                crossing.append((first, qx, qy, bits - 1))
    out: list[tuple[int, int]] = []
    for first, last in sorted([*inside, *((key, key + (1 << 2 * bits) - 1) for key, _, _, bits in crossing)]):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out
