"""Where everything lies in one place: results against brute force, and work that grows with the rows, not with their product."""

import math

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import DATA
from tripmill.functions import grid, zones
from tripmill.operators import joins
from tripmill.plans import fixtures, tools
from tripmill.sources import io


def apart(y, x, s):
    """From positions to a segment, in degrees."""
    dy, dx = s[3] - s[1], s[4] - s[2]
    t = np.clip(((y - s[1]) * dy + (x - s[2]) * dx) / (dy * dy + dx * dx), 0, 1) if dy or dx else 0.0
    return np.round(np.hypot(y - s[1] - t * dy, x - s[2] - t * dx), 12)


def test_buffer_among_many_segments(spark):
    rng = np.random.default_rng(3)
    place = lambda n: 49 + rng.uniform(-0.001, 0.001, n), lambda n: 1 + rng.uniform(-0.001, 0.001, n)
    (lat, lon), (a, b, c, d) = (f(400) for f in place), (f(300) for f in (*place, *place))
    segments = [(k, float(a[k]), float(b[k]), float(c[k]), float(d[k]), f"h{k}") for k in range(300)] + [(300 + k, 49.0, 1.0, 49.0, 1.0, "point") for k in range(5)]
    samples = [(1, k, float(y), float(x)) for k, (y, x) in enumerate(zip(lat, lon))] + [(1, 400, 49.0, 1.0), (1, 401, 49.5, 1.0), (1, 402, None, 1.0)]
    df = spark.createDataFrame(samples, "trip_id int, seq int, lat double, lon double")
    got = {r.seq: r.road_tag for r in joins.road_within_buffer(df, spark.createDataFrame(segments, "segment_id int, lat1 double, lon1 double, lat2 double, lon2 double, highway string"), 100.0).collect()}
    near = [min((float(apart(y, x, s)), s[0], s[5]) for s in segments) for _, _, y, x in samples if y]
    assert got == {k: n[2] if n[0] <= 100 / 111_320 else "inconnu" for k, n in enumerate(near)} | {402: "inconnu"}


def test_a_cell_keeps_only_what_is_near(spark):
    """Two thousand points in one coarse cell: the smallest cells keep a few each, and among them the nearest."""
    rng = np.random.default_rng(4)
    points = [(k, 49 + float(rng.uniform(0, 0.002)), 1 + float(rng.uniform(0, 0.002))) for k in range(2000)]
    here = [(k, 49 + float(rng.uniform(0, 0.002)), 1 + float(rng.uniform(0, 0.002))) for k in range(500)]
    distance = lambda p, lat, lon: F.sqrt(F.pow(lat - p._lat, 2) + F.pow(lon - p._lon, 2))
    at = spark.createDataFrame(here, "k int, lat double, lon double").withColumns(grid.leaf(0.002))
    coarse = spark.createDataFrame(points, "v int, _lat double, _lon double").groupBy(F.floor(F.col("_lat") / 0.002).alias("i"), F.floor(F.col("_lon") / 0.002).alias("j")).agg(F.collect_list(F.struct("v", "_lat", "_lon")).alias("items"))
    found = at.join(grid.refine(at.select("i", "j").distinct(), coarse, distance, 0.002), ["i", "j"]).withColumn("n", grid.closest(F.col("items"), distance, ("v",)))
    rows = found.select("k", F.size("items").alias("n_items"), "n.v").collect()
    assert {r.k: r.v for r in rows} == {k: min((round(math.hypot(y - a, x - b), 12), v) for v, a, b in points)[1] for k, y, x in here}
    assert max(r.n_items for r in rows) <= 30


def test_nearest_node_and_weather_make_no_pairs_to_sort(spark):
    """Three hundred nodes and reports within a hundred metres, some in one place: brute force agrees, and no plan groups pairs by sample."""
    rng = np.random.default_rng(6)
    spots = [(49 + float(y), 1 + float(x)) for y, x in rng.uniform(0, 0.001, (250, 2))]
    spots += [spots[0]] * 50
    here = [(1, k, int(rng.integers(0, 500)), 49 + float(y), 1 + float(x)) for k, (y, x) in enumerate(rng.uniform(0, 0.001, (200, 2)))] + [(1, 200, 100, *spots[0]), (1, 201, 100, None, 1.0)]
    df = spark.createDataFrame(here, "trip_id int, seq int, ts_us long, lat double, lon double")
    nodes = [(1000 - k, *p, f"h{k}") for k, p in enumerate(spots)]
    reports = [(int(rng.integers(0, 500)), *p, float(k)) for k, p in enumerate(spots)]
    far = lambda y, x, p: round(math.hypot(y - p[1], x - p[2]), 12)
    road = joins.nearest_road(df, spark.createDataFrame(nodes, "node_id int, lat double, lon double, highway string"))
    assert {r.seq: r.node_id for r in road.collect()} == {k: min((far(y, x, n), n[0]) for n in nodes)[1] if y else None for _, k, _, y, x in here}
    weather = joins.weather_join(df, spark.createDataFrame(reports, "ts_us long, lat double, lon double, temperature double"), 60)
    want = {k: min(((far(y, x, w), w[0], w[3]) for w in reports if abs(w[0] - t) <= 60), default=(0, 0, None))[2] if y else None for _, k, t, y, x in here}
    assert {r.seq: r.temperature for r in weather.collect()} == want
    for frame in (road, weather):
        assert "SortAggregate" not in frame._jdf.queryExecution().executedPlan().toString()


def test_partitions_of_the_trace_grow_with_its_files(spark):
    assert fixtures.parts(spark, f"{DATA}/lineitem.parquet") == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert fixtures.parts(spark, f"{DATA}/lineitem.parquet", each=10_000) > 4
    trace = fixtures.view(spark, DATA)
    plan = trace._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan  # the windows over trips need no other


def test_artifacts_are_compressed_and_whole(spark, tmp_path):
    df = fixtures.view(spark, DATA).where("trip_id = 0").withColumns({"flag_stop": F.lit(0), "flag_wait": F.lit(0)})
    n = io.export_dataset(df, f"{tmp_path}/out", "r", artifacts=True)["n_points"]
    for kind, read in (("csv", lambda p: spark.read.csv(p, header=True)), ("json", spark.read.json)):
        files = [f.name for f in (tmp_path / f"out_{kind}" / "run_id=r").glob("part-*")]
        assert files and all(f.endswith(".gz") for f in files)
        assert read(f"{tmp_path}/out_{kind}").count() == n > 0


def test_rows_are_spread_and_points_are_not(spark, monkeypatch):
    """Anchors are few, samples many: only anchors are copied to the cells around."""
    spread, cover = [], grid.cover
    monkeypatch.setattr(grid, "cover", lambda df, *a: spread.append(set(df.columns)) or cover(df, *a))
    samples = spark.range(100).selectExpr("1 AS trip_id", "CAST(id AS INT) AS seq", "49 + id / 100000 AS lat", "1D AS lon")
    got = joins.anchor_at_geo(samples, spark.createDataFrame([(1, 7, 49.0003, 1.0)], "trip_id int, anchor_id int, lat double, lon double"))
    assert [r.seq for r in got.collect()] == [30] and spread and not any("_lat" in c for c in spread)


def test_last_of_many_zones_in_one_place(spark):
    """Forty boxes on top of each other: a cell keeps its last zone all around and the later ones at its borders, and a position gets the last that holds it."""
    rng = np.random.default_rng(9)
    boxes = [(k, f"z{k}", *(49 + np.sort(rng.uniform(0, 0.01, 2))), *(1 + np.sort(rng.uniform(0, 0.01, 2)))) for k in range(40)]
    rings = [(k, t, [(float(a), float(c)), (float(a), float(d)), (float(b), float(d)), (float(b), float(c))]) for k, t, a, b, c, d in boxes]
    here = [(1, k, 49 + float(y), 1 + float(x)) for k, (y, x) in enumerate(rng.uniform(-0.001, 0.011, (300, 2)))] + [(1, 300, None, 1.0)]
    df = spark.createDataFrame(here, "trip_id int, seq int, lat double, lon double")
    shapes = spark.createDataFrame(rings, "zone_id int, zone_type string, ring array<struct<lat: double, lon: double>>")
    want = {k: max(((z, t) for z, t, a, b, c, d in boxes if y and a <= y < b and c <= x < d), default=(0, "inconnu"))[1] for _, k, y, x in here}
    assert {r.seq: r.osm_zone for r in joins.zone_join(df, shapes).collect()} == want
    assert {r.seq: r.t for r in zones.last_zone_at(df, shapes, 0.0005, "t").na.fill("inconnu").collect()} == want


def test_revisits_of_a_trip_that_stands(spark, monkeypatch):
    """Standing rows are one place: a trip that stands for long revisits by its first and last row, one that stands shortly doesn't."""
    rows = [(1, k, 49.0, 1.0) for k in range(11)] + [(2, k, 49.0, 1.0) for k in range(10)] + [(3, k, 49.0 if k in (0, 10) else 49.1 + k / 100, 1.0) for k in range(11)] + [(4, k, 49 + k / 100, 1.0) for k in range(30)]
    met, cover = [], joins.cover
    monkeypatch.setattr(joins, "cover", lambda df, *a: met.append(df) or cover(df, *a))
    got = joins.revisits(spark.createDataFrame(rows, "trip_id int, seq int, lat double, lon double"))
    assert {r.trip_id: r.revisits for r in got.collect()} == {1: True, 2: False, 3: True, 4: False}
    assert met[0].where("trip_id = 2").count() == 1


def test_labels_are_made_in_one_pass(spark):
    plan = tools.labels(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
