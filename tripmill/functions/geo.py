"""Geometry as column expressions: degrees in, metres or degrees out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
WGS84_A, WGS84_E2 = 6_378_137.0, 0.0066943799901413165


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres on a sphere."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def ellipsoid_step(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance of near points on WGS84 by the radii of curvature at the middle latitude: good to a millimetre over a few hundred metres."""
    mid = F.radians((lat1 + lat2) / 2)
    w = 1 - WGS84_E2 * F.pow(F.sin(mid), 2)
    north = WGS84_A * (1 - WGS84_E2) / F.pow(w, 1.5) * F.radians(lat2 - lat1)
    east = WGS84_A / F.sqrt(w) * F.cos(mid) * F.radians(lon2 - lon1)
    return F.sqrt(north * north + east * east)


def geodesic(lat1: Column, lon1: Column, lat2: Column, lon2: Column, rounds: int = 20) -> Column:
    """Length of the geodesic on WGS84 in metres: steps of under a hundredth of a degree by the radii of curvature, longer ones by the inverse
    formula (Vincenty, 1975) with a fixed number of rounds, good to a millimetre. Its rounds don't settle for nearly opposite points; those, from 179.4 degrees apart, get the
    distance on the sphere."""
    f = 1 - (1 - WGS84_E2) ** 0.5
    b = WGS84_A * (1 - f)
    reduced = lambda lat: F.atan((1 - f) * F.tan(F.radians(lat)))
    dlon = F.radians(F.pmod(lon2 - lon1 + 180, F.lit(360.0)) - 180)
    p = F.struct(F.sin(reduced(lat1)).alias("s1"), F.cos(reduced(lat1)).alias("c1"), F.sin(reduced(lat2)).alias("s2"), F.cos(reduced(lat2)).alias("c2"), dlon.alias("l"))

    def named(x: Column, *more: Callable[[Column], tuple[str, Column]]) -> Column:
        """Adds fields one after the other, each computed once from those before it."""
        with_ = lambda field: lambda y: y.withField(*field(y))
        for field in more:
            x = F.transform(F.array(x), with_(field))[0]
        return x

    def turn(x: Column, y: Column) -> list:
        """The angles that belong to a longitude y on the auxiliary sphere: x holds the fixed parts."""
        return [
            lambda z: ("ss", F.sqrt(F.pow(z.c2 * F.sin(z.y), 2) + F.pow(z.c1 * z.s2 - z.s1 * z.c2 * F.cos(z.y), 2))), lambda z: ("cs", z.s1 * z.s2 + z.c1 * z.c2 * F.cos(z.y)),
            lambda z: ("g", F.atan2(z.ss, z.cs)), lambda z: ("sa", F.when(z.ss == 0, 0.0).otherwise(z.c1 * z.c2 * F.sin(z.y) / z.ss)), lambda z: ("ca", 1 - z.sa * z.sa),
            lambda z: ("m", F.when(z.ca == 0, 0.0).otherwise(z.cs - 2 * z.s1 * z.s2 / z.ca)),
        ]

    def next_(z: Column, _: Column) -> Column:
        z = named(z, *turn(z, z.y), lambda z: ("k", f / 16 * z.ca * (4 + f * (4 - 3 * z.ca))))
        new = lambda z: z.l + (1 - z.k) * f * z.sa * (z.g + z.k * z.ss * (z.m + z.k * z.cs * (2 * z.m * z.m - 1)))
        return F.transform(F.array(z), lambda z: F.struct(z.s1.alias("s1"), z.c1.alias("c1"), z.s2.alias("s2"), z.c2.alias("c2"), z.l.alias("l"), new(z).alias("y")))[0]

    def length(z: Column) -> Column:
        z = named(z, *turn(z, z.y), lambda z: ("u", z.ca * (WGS84_A**2 - b**2) / b**2))
        z = named(z, lambda z: ("a", 1 + z.u / 16384 * (4096 + z.u * (-768 + z.u * (320 - 175 * z.u)))), lambda z: ("b", z.u / 1024 * (256 + z.u * (-128 + z.u * (74 - 47 * z.u)))))
        rest = lambda z: z.b * z.ss * (z.m + z.b / 4 * (z.cs * (2 * z.m * z.m - 1) - z.b / 6 * z.m * (4 * z.ss * z.ss - 3) * (4 * z.m * z.m - 3)))
        return F.transform(F.array(z), lambda z: b * z.a * (z.g - rest(z)))[0]

    whole = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), p.withField("y", dlon), next_, length)
    sphere = haversine(lat1, lon1, lat2, lon2)
    short = (F.abs(lat2 - lat1) < 0.01) & (F.abs(lon2 - lon1) < 0.01)
    return F.when(short, ellipsoid_step(lat1, lon1, lat2, lon2)).when(sphere > 179.4 / 180 * 3.141592653589793 * EARTH_M, sphere).otherwise(whole)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, in [0, 360). The northward part is written so that nothing cancels between near points."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(b)
    x = F.sin(F.radians(lat2 - lat1)) + 2 * F.sin(a) * F.cos(b) * F.pow(F.sin(d / 2), 2)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def cell(value: Column, size: float) -> Column:
    """Index of the grid cell of a coordinate."""
    return F.floor(value / size).cast("long")
