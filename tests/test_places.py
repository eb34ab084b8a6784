"""Zones, hexagons and geodesics against independent loops and known lengths."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripmill.functions import geo, zones
from tripmill.operators import joins


def inside(lat, lon, ring):
    hit = False
    for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
        if (a > lat) != (c > lat) and lon < (d - b) * (lat - a) / (c - a) + b:
            hit = not hit
    return hit


def star(lat, lon, r, points, rng):
    return [(lat + r * k * math.sin(a), lon + r * k * math.cos(a)) for a, k in ((2 * math.pi * i / points, rng.uniform(0.3, 1)) for i in range(points))]


@pytest.fixture(scope="module")
def shapes():
    rng = np.random.default_rng(4)
    rings = [star(49, 1, 0.9, 17, rng), star(49.2, 1.3, 0.6, 5, rng), star(48.8, 0.8, 0.02, 7, rng), [(48.5, 0.5), (48.5, 1.5), (49.5, 1.5), (49.5, 0.5)], [(48.9, 0.9), (48.9, 1.1), (49.1, 1.1), (49.1, 0.9), (48.9, 0.9)]]
    rings += [star(48.5 + k / 10, 0.5 + k / 9, 0.3, 9, rng) for k in range(8)] + [[(49.0, 1.0)], []]
    return [(k, f"z{k % 4}", [(float(a), float(b)) for a, b in ring]) for k, ring in enumerate(rings)] + [(99, "none", None)]


def frames(spark, shapes):
    rng = np.random.default_rng(9)
    at = [(i // 500, i % 500, float(rng.uniform(47.9, 50.2)), float(rng.uniform(-0.2, 2.4))) for i in range(2000)] + [(9, 0, 48.5, 0.5), (9, 1, 49.0, 1.5), (9, 2, 48.9, 0.9), (9, 3, None, 1.0)]
    return at, spark.createDataFrame(at, "trip_id int, seq int, lat double, lon double"), spark.createDataFrame(shapes, "zone_id int, zone_type string, ring array<struct<lat: double, lon: double>>")


@pytest.mark.parametrize("size", [0.05, 0.011, 1.7])
def test_zones_against_ray_casting(spark, shapes, size):
    at, here, there = frames(spark, shapes)
    got = {(r.trip_id, r.seq): r.osm_zone for r in joins.zone_join(here, there, size).collect()}
    want = {(t, s): next((kind for _, kind, ring in reversed(shapes) if ring and lat is not None and inside(lat, lon, ring)), "inconnu") for t, s, lat, lon in at}
    assert got == want


def test_a_zone_has_rows_for_its_border(spark):
    """A country's worth of cells, of which those on the border and few pieces inside are kept."""
    ring = [(40.0, -5.0), (40.0, 9.0), (50.0, 9.0), (50.0, -5.0)]
    banded = zones.bands(spark.createDataFrame([(1, "x", ring)], "zone_id int, zone_type string, ring array<struct<lat: double, lon: double>>"), 0.05)
    border, pieces = banded.agg(F.sum(F.size("border"))).first()[0], zones.inner_pieces(banded, 0.05)
    whole = pieces.agg(F.sum(F.pow(F.lit(8), "level"))).first()[0]
    assert border < 1500 and pieces.count() < 14 * 2 * 200 and whole >= 278 * 199


def test_hexagons(spark, shapes):
    at, here, there = frames(spark, shapes)
    size = 0.03
    rows = joins.hexagon(here, size).where("lat IS NOT NULL").collect()
    for r in rows:  # the nearest centre of all around
        d = math.hypot(r.lat - r.hex_lat, r.lon - r.hex_lon)
        others = [(1.5 * size * (r.hex_r + j), math.sqrt(3) * size * (r.hex_q + i + (r.hex_r + j) / 2)) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
        assert d <= size + 1e-9 and all(d <= math.hypot(r.lat - a, r.lon - b) + 1e-9 for a, b in others)
    kinds = {f"{r.hex_q}:{r.hex_r}": next((kind for _, kind, ring in reversed(shapes) if ring and inside(r.hex_lat, r.hex_lon, ring)), "inconnu") for r in rows}
    got = joins.grid_zone(here, there, size).where("lat IS NOT NULL").collect()
    assert len(got) == len(rows) and {r.grid_id: r.grid_zone for r in got} == kinds


def test_geodesic(spark):
    deg = lambda d, m, s: math.copysign(abs(d) + m / 60 + s / 3600, d)
    known = [
        (deg(-37, 57, 3.72030), deg(144, 25, 29.52440), deg(-37, 39, 10.15610), deg(143, 55, 35.38390), 54972.271),  # a survey's reference line
        (0.0, 0.0, 0.0, 1.0, 6378137 * math.pi / 180), (0.0, 179.5, 0.0, -179.5, 6378137 * math.pi / 180), (90.0, 0.0, -90.0, 0.0, None), (10.0, 20.0, 10.0, 20.0, 0.0), (0.0, 0.0, 90.0, 0.0, 10001965.729), (45.0, 7.0, -45.0, 7.0, 2 * 4984944.378),
        (0.0, 0.0, 0.1, 179.9, None), (48.0, 2.0, 48.00009, 2.0, None),
    ]
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(known)], "i int, a double, b double, c double, d double, want double")
    for r in df.withColumn("m", geo.geodesic(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).withColumn("s", geo.haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect():
        assert r.m == pytest.approx(r.want, abs=2e-3) if r.want is not None else r.m == pytest.approx(r.s, rel=0.006)
    # short steps by the radii of curvature agree with the inverse formula where they meet
    steps = spark.range(200).selectExpr("-80 + id * 0.8 AS a", "id * 1.0 AS b", "-80 + id * 0.8 + 0.0099 AS c", "id + 0.0099 AS d", "-80 + id * 0.8 + 0.0101 AS e", "id + 0.0101 AS f")
    for r in steps.select(geo.geodesic(*map(F.col, "abcd")).alias("x"), geo.geodesic(*map(F.col, "abef")).alias("y")).collect():
        assert r.y / r.x == pytest.approx(0.0101 / 0.0099, rel=3e-5)
