"""Geometry columns: distances and analytic surface geodesics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def euclid3(ax, ay, az, bx, by, bz) -> Column:
    dx, dy, dz = ax - bx, ay - by, az - bz
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def euclid_n(a, b) -> Column:
    """n-dimensional Euclidean distance of two numeric arrays (computed in double)."""
    diff = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(diff, F.lit(0.0), lambda acc, v: acc + v))


def sphere_geodesic(radius, ax, ay, az, bx, by, bz) -> Column:
    """radius * acos(clip(<a/|a|, b/|b|>, -1, 1))."""
    na = F.sqrt(ax * ax + ay * ay + az * az)
    nb = F.sqrt(bx * bx + by * by + bz * bz)
    dot = (ax / na) * (bx / nb) + (ay / na) * (by / nb) + (az / na) * (bz / nb)
    return radius * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))


def cylinder_geodesic(radius, ax, ay, az, bx, by, bz) -> Column:
    """sqrt((r * wrapped dtheta)^2 + dz^2) with dtheta wrapped into [-pi, pi]."""
    d = F.atan2(by, bx) - F.atan2(ay, ax)
    d = (F.when(d > math.pi, d - 2 * math.pi).when(d < -math.pi, d + 2 * math.pi).otherwise(d))
    arc, dz = radius * F.abs(d), F.abs(bz - az)
    return F.sqrt(arc * arc + dz * dz)


def torus_geodesic_approx(major, minor, ax, ay, az, bx, by, bz) -> Column:
    """Euclidean distance times (1 + minor/major * 0.5)."""
    return euclid3(ax, ay, az, bx, by, bz) * (1 + (minor / major) * 0.5)


def analytic_distance(kind, params, ax, ay, az, bx, by, bz) -> Column:
    """Dispatch by surface kind; unknown kinds give NULL."""
    k = F.col(kind) if isinstance(kind, str) else kind
    p = F.col(params) if isinstance(params, str) else params
    return (F.when(k == "sphere", sphere_geodesic(p["radius"], ax, ay, az, bx, by, bz))
             .when(k == "cylinder", cylinder_geodesic(p["radius"], ax, ay, az, bx, by, bz))
             .when(k == "torus", torus_geodesic_approx(p["major"], p["minor"], ax, ay, az, bx, by, bz)))
