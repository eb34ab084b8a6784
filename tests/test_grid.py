"""Joins by distance against brute force: at high latitudes, across 180 degrees, around the poles, and far from everything."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripmill.functions import grid
from tripmill.operators import joins

PLACES = [(0.0, 0.0), (49.0, 1.0), (65.0, 20.0), (80.0, -40.0), (10.0, 180.0), (-72.0, -179.9999), (89.9995, 10.0), (-90.0, 0.0)]


def metres(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6_371_000.0 * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


def around(rng, lat, lon, n, within):
    """n positions within so many metres, longitudes wrapped."""
    out = []
    for _ in range(n):
        a = min(90.0, max(-90.0, lat + rng.uniform(-within, within) / 111_195))
        wide = min(180.0, within / 111_195 / max(1e-6, math.cos(math.radians(a))))
        out.append((a, (lon + rng.uniform(-wide, wide) + 180) % 360 - 180))
    return out


@pytest.fixture(scope="module")
def crowd():
    rng = np.random.default_rng(5)
    return [(trip, i, *p) for trip, (lat, lon) in enumerate(PLACES) for i, p in enumerate(around(rng, lat, lon, 60, 400))]


def test_cover_misses_nothing(spark, crowd):
    df = spark.createDataFrame(crowd, "trip_id int, seq int, lat double, lon double")
    within = 60.0
    there = grid.cover(df.selectExpr("trip_id", "seq AS s", "lat AS a", "lon AS b"), within, "a", "b")
    pairs = df.withColumns(grid.home(F.col("lat"), F.col("lon"), within)).join(there, ["trip_id", "cell_lat", "cell_lon"]).select("trip_id", "seq", "s").collect()
    assert len(pairs) == len(set(pairs))
    want = {(t, i, j) for t, i, a, b in crowd for u, j, c, d in crowd if t == u and metres(a, b, c, d) < within}
    assert want <= set(map(tuple, pairs)) and len(pairs) < 15 * len(want)


def test_proximity_and_snap_and_revisits(spark, crowd):
    df = spark.createDataFrame([(t, i, i * 1000, a, b, None) for t, i, a, b in crowd], "trip_id int, seq int, ts_us long, lat double, lon double, event string")
    events = [(k, f"e{k}", a, b) for k, (t, i, a, b) in enumerate(crowd) if i % 7 == 0]
    near = joins.proximity_labels(df, spark.createDataFrame(events, "event_order int, label string, lat double, lon double"), 50.0)
    got = {(r.trip_id, r.seq): r.event for r in near.collect()}
    assert got == {(t, i): next((label for _, label, c, d in events if metres(a, b, c, d) < 50), None) for t, i, a, b in crowd}

    pois = [(k, t, a, b) for k, (t, i, a, b) in enumerate(crowd) if i == 30]
    hits = joins.snap_points(df.where("seq <> 30"), spark.createDataFrame(pois, "poi_id int, trip_id int, lat double, lon double"), 100.0)
    want = {}
    for k, t, a, b in pois:
        d, i = min((round(metres(a, b, c, e), 6), j) for u, j, c, e in crowd if u == t and j != 30)
        if d <= 100:
            want[k] = (i, d)
    assert {r.poi_id: (r.seq, pytest.approx(r.distance_m, abs=2e-6)) for r in hits.collect()} == want

    for within in (0.5, 3.0, 20.0):
        got = {r.trip_id: r.revisits for r in joins.revisits(df, within).collect()}
        assert got == {t: any(metres(a, b, c, d) < within for u, i, a, b in crowd if u == t for v, j, c, d in crowd if v == t and j >= i + 10) for t in range(len(PLACES))}


@pytest.mark.parametrize("lat, lon", [(65.0, 20.0), (80.0, 179.9999)])
def test_close_passes_in_high_latitudes(spark, lat, lon):
    """Two samples 28 m apart in every direction, one trip each."""
    rows = []
    for k in range(40):
        a = 2 * math.pi * k / 40
        dlat, dlon = 28 * math.cos(a) / 111_195, 28 * math.sin(a) / 111_195 / math.cos(math.radians(lat))
        rows += [(k, 0, lat + k * 1e-5, lon), (k, 15, lat + k * 1e-5 + dlat, (lon + dlon + 180) % 360 - 180)]
    df = spark.createDataFrame(rows, "trip_id int, seq int, lat double, lon double")
    assert all(r.revisits for r in joins.revisits(df).collect())


@pytest.mark.parametrize("metric", ["degrees", "metres"])
def test_nearest_at_any_distance(spark, metric):
    rng = np.random.default_rng(8)
    near = [p for lat, lon in PLACES for p in around(rng, lat, lon, 6, 30_000)]
    points = [(k, a, b) for k, (a, b) in enumerate([*near, *near[:3]])]
    here = [(k, a, b) for k, (a, b) in enumerate([p for lat, lon in PLACES for p in around(rng, lat, lon, 10, 60_000)] + [(float(rng.uniform(-90, 90)), float(rng.uniform(-180, 180))) for _ in range(80)])]
    got = grid.nearest_points(spark.createDataFrame(here, "k int, lat double, lon double"), spark.createDataFrame(points, "v int, _lat double, _lon double"), ("k",), ("v",), 0.05, metric=metric)
    far = metres if metric == "metres" else lambda a, b, c, d: math.hypot(a - c, b - d)
    want = {k: min((round(far(a, b, c, d), 6 if metric == "metres" else 12), v) for v, c, d in points) for k, a, b in here}
    for r in got.collect():
        assert r.n.d == pytest.approx(want[r.k][0], abs=2e-6) and (r.n.v == want[r.k][1] or abs(want[r.k][0] - r.n.d) < 1e-5)
    assert got.count() == len(here)


def test_nearest_within_a_time(spark):
    """The nearest point may be out of reach in time, in a cell that holds others."""
    rng = np.random.default_rng(2)
    points = [(k, int(rng.integers(0, 1000)), float(rng.normal(40, 3)), float(rng.normal(5, 3))) for k in range(300)]
    here = [(k, int(rng.integers(-300, 1300)), float(rng.normal(20, 15)), float(rng.normal(5, 15))) for k in range(200)]
    got = grid.nearest_points(
        spark.createDataFrame(here, "k int, t long, lat double, lon double"), spark.createDataFrame(points, "v int, u long, _lat double, _lon double"), ("k",), ("v",), 0.01, within=("t", "u", 40)
    )
    want = {k: min(((round(math.hypot(a - c, b - d), 12), v) for v, u, c, d in points if abs(u - t) <= 40), default=None) for k, t, a, b in here}
    assert {r.k: (pytest.approx(r.n.d, abs=1e-11), r.n.v) for r in got.collect()} == {k: w for k, w in want.items() if w}


def test_far_rows_meet_few_cells(spark):
    """A hundred thousand rows far from a thousand points: no row meets more than a few cells, so none meets all points."""
    points = spark.range(1000).selectExpr("id AS v", "48 + id % 40 / 100 AS _lat", "2 + id / 40 / 100 AS _lon")
    here = spark.range(100_000).selectExpr("id AS k", "-60 + id % 317 / 10 AS lat", "-170 + id / 317 / 10 AS lon")
    cells = grid.descend(here, points, ("k",), 0.01, (), "degrees", None)
    per_row = cells.groupBy("k").count()
    assert per_row.count() == 100_000 and per_row.agg(F.max("count"), F.avg("count")).first()[0] <= 12
