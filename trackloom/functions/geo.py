"""Geometric column expressions. Every operator names its earth radius; there is no global one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The three earth models in use.
R_EQUATOR, R_MEAN, M_PER_DEGREE = 6378137.0, 6371008.8, 111320.0
#: Fixed value: radius of the circle that holds 90 % of a round normal distribution, in standard deviations.
CIRCLE_90 = 2.1460


def to_enu(lat: Column, lon: Column, lat0: Column | float, lon0: Column | float, radius: float = R_EQUATOR) -> tuple[Column, Column]:
    """East and north in metres about an origin (equirectangular)."""
    lat0, lon0 = (F.lit(v) if isinstance(v, (int, float)) else v for v in (lat0, lon0))
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * radius, F.radians(lat - lat0) * radius


def from_enu(x: Column, y: Column, lat0: float, lon0: float, radius: float = R_EQUATOR) -> tuple[Column, Column]:
    """Latitude and longitude; the inverse of to_enu."""
    return F.lit(lat0) + F.degrees(y / radius), F.lit(lon0) + F.degrees(x / (F.cos(F.radians(F.lit(lat0))) * radius))


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = R_MEAN) -> Column:
    """Metres between two near points, by the cosine of their middle latitude."""
    dx = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.hypot(dx, F.radians(lat2 - lat1)) * radius


def wrap(angle: Column) -> Column:
    """Radians to (-pi, pi]."""
    return F.atan2(F.sin(angle), F.cos(angle))


def heading_of_bearing(bearing_deg: Column) -> Column:
    """Compass degrees (0 north, clockwise) to radians from east, counter-clockwise."""
    return F.radians(F.lit(90.0) - bearing_deg)


def rotation_from_angles(azimuth: Column, pitch: Column, roll: Column) -> list[list[Column]]:
    """Rz(azimuth) Rx(pitch) Ry(roll), for right-handed axes, as nine columns by rows."""
    ca, sa, cp, sp, cr, sr = F.cos(azimuth), F.sin(azimuth), F.cos(pitch), F.sin(pitch), F.cos(roll), F.sin(roll)
    return [[ca * cr - sa * sp * sr, -sa * cp, ca * sr + sa * sp * cr], [sa * cr + ca * sp * sr, ca * cp, sa * sr - ca * sp * cr], [-cp * sr, sp, cp * cr]]


def rotate(r: list[list[Column]], v: list[Column]) -> list[Column]:
    return [row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in r]


def confidence_radius(distance_m: Column, k: float = 0.19, least_sigma: float = 2.0, p: float = 0.9) -> Column:
    """Radius that holds the true place with probability p, from the distance since the last fix."""
    return F.greatest(F.lit(k) * distance_m, F.lit(least_sigma)) * F.sqrt(F.lit(-2.0) * F.ln(F.lit(1 - p)))


def yaw_free_channels(ax: Column, ay: Column, az: Column, gx: Column, gy: Column, gz: Column, previous_norm: Column, hz: float) -> dict[str, Column]:
    """Six channels that don't depend on the heading of the mount: levelled input, previous |a| for the jerk."""
    norm = F.sqrt(ax * ax + ay * ay + az * az)
    return {"a_h": F.hypot(ax, ay), "a_v": az, "w_h": F.hypot(gx, gy), "w_z": gz, "a": norm, "jerk": (norm - F.coalesce(previous_norm, norm)) * hz}


def segment_offset(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column, Column]:
    """Clamped projection of p on the segment a-b: share along it, distance squared, and squared length."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    u = F.when(length2 > 0, ((px - ax) * dx + (py - ay) * dy) / length2).otherwise(F.lit(0.0))
    u = F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0))
    ex, ey = ax + u * dx - px, ay + u * dy - py
    return u, ex * ex + ey * ey, length2
