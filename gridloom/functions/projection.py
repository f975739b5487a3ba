"""Map projections and spherical tests as column expressions; angles in degrees."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def rotation_matrix(lam: float, phi: float = 0.0, gamma: float = 0.0) -> list[list[float]]:
    """Rotates the unit sphere so that (-lam, -phi) comes to the centre."""
    a, b, c = (math.radians(v) for v in (lam, phi, gamma))
    rz = [[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]]
    ry = [[math.cos(b), 0, -math.sin(b)], [0, 1, 0], [math.sin(b), 0, math.cos(b)]]
    rx = [[1, 0, 0], [0, math.cos(c), -math.sin(c)], [0, math.sin(c), math.cos(c)]]
    mul = lambda p, q: [[sum(p[i][k] * q[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
    return mul(rx, mul(ry, rz))


def central_angle(lon: Column, lat: Column, lon0: float, lat0: float) -> Column:
    """Great-circle distance to a centre, in radians (haversine)."""
    dlat, dlon = F.radians(lat - lat0), F.radians(lon - lon0)
    h = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat)) * math.cos(math.radians(lat0)) * F.pow(F.sin(dlon / 2), F.lit(2.0))
    return 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def visible(lon: Column, lat: Column, lon0: float, lat0: float, clip: float = 90.0) -> Column:
    return central_angle(lon, lat, lon0, lat0) <= math.radians(clip) + 1e-6


@dataclass(frozen=True)
class Projection:
    """kind: equirectangular, mercator or orthographic, with a scale, a translation and a centre."""

    kind: str
    scale: float = 1.0
    tx: float = 0.0
    ty: float = 0.0
    lon0: float = 0.0
    lat0: float = 0.0

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        if self.kind == "orthographic":
            l, p, p0 = F.radians(lon - self.lon0), F.radians(lat), math.radians(self.lat0)  # noqa: E741
            x = F.cos(p) * F.sin(l)
            y = math.cos(p0) * F.sin(p) - math.sin(p0) * F.cos(p) * F.cos(l)
        else:
            x = F.radians(lon - self.lon0)
            y = F.radians(lat) if self.kind == "equirectangular" else F.log(F.tan(math.pi / 4 + F.radians(F.least(F.greatest(lat, F.lit(-85.0)), F.lit(85.0))) / 2))
        return self.tx + self.scale * x, self.ty - self.scale * y

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        u, v = (x - self.tx) / self.scale, (self.ty - y) / self.scale
        if self.kind == "orthographic":
            rho, p0 = F.hypot(u, v), math.radians(self.lat0)
            c = F.asin(F.least(rho, F.lit(1.0)))
            lat = F.asin(F.cos(c) * math.sin(p0) + F.when(rho > 0, v * F.sin(c) * math.cos(p0) / rho).otherwise(0.0))
            lon = F.atan2(u * F.sin(c), rho * math.cos(p0) * F.cos(c) - v * math.sin(p0) * F.sin(c))
            ok = rho <= 1
            return F.when(ok, F.degrees(lon) + self.lon0), F.when(ok, F.degrees(lat))
        lat = v if self.kind == "equirectangular" else 2 * F.atan(F.exp(v)) - math.pi / 2
        return F.degrees(u) + self.lon0, F.degrees(lat)
