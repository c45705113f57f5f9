"""Transverse Mercator as column expressions: Krüger's series to the fourth order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The GRS 80 ellipsoid, the scale and the offsets of UTM.
A, FLAT, SCALE, EAST, SOUTH = 6378137.0, 1 / 298.257222101, 0.9996, 500000.0, 10000000.0
N = FLAT / (2 - FLAT)
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440,
    61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280,
)


def utm_forward(lon: Column, lat: Column, zone: Column, south: Column) -> Column:
    """(x, y) in metres of degrees in a zone; datum shifts are not part of this."""
    e = 2 * math.sqrt(N) / (1 + N)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((EAST + SCALE * RADIUS * x).alias("x"), (F.when(south, SOUTH).otherwise(0.0) + SCALE * RADIUS * y).alias("y"))
