"""Validation, runs on disk, resampling and detectors against loops and small vectors."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_trips import column, trace
from tripmill.operators import clean, detect, quality, recurrences, resample
from tripmill.plans.fixtures import view
from tripmill.sources import io

SMALL = "/root/testdata/sf0.001"


def test_validation_lists_offenders(spark):
    rows = [(t, s, None if s % 3 == 0 else float(s), "7" if s % 4 else "x", "stop" if s % 2 else "go") for t in (2, 1) for s in range(40)]
    df = spark.createDataFrame(rows, "trip_id int, seq int, speed double, code string, event string").repartition(7)
    rules = {"speed": {"nullable": False}, "code": {"type": "int"}, "event": {"values": ["stop"], "nullable": False}, "lat": {}}
    got = {(r.column, r.rule): (r.n_bad, [tuple(k) for k in r.offenders]) for r in quality.validate_dataset(df, rules, most=3).collect()}
    assert got == {
        ("speed", "null"): (28, [(1, 0), (1, 3), (1, 6)]), ("code", "type"): (20, [(1, 0), (1, 4), (1, 8)]), ("event", "null"): (0, []), ("event", "value"): (40, [(1, 0), (1, 2), (1, 4)]),
        ("lat", "missing"): (80, [(1, 0), (1, 1), (1, 2)]), ("trip_id", "extra"): (0, []), ("seq", "extra"): (0, []),
    }
    order = lambda df, *names: {(r.rule, r.n_bad) for r in quality.validate_dataset(df, {n: {} for n in names}, strict_order=True).where("rule <> 'extra'").collect()}
    assert order(df, "trip_id", "seq") == {("order", 0)} and order(df, "seq", "trip_id") == {("order", 1)} and order(df, "speed") == {("order", 1)} and order(df, "lat") == {("missing", 80)}
    assert {(r.n_bad, len(r.offenders)) for r in quality.validate_dataset(df.where("false"), rules).collect()} == {(0, 0)}


def export_frame(spark, n=20):
    names = ("lat", "lon", "speed", "acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z", "heading", "sinuosity", "curvature", "altitude", "slope_percent")
    return trace(spark, {**{c: [1.0] * n for c in names}, "event": [None] * n, "road_type": ["service"] * n, "osm_highway": ["service"] * n})


def test_unfinished_runs_dont_count(spark, tmp_path):
    df, path = export_frame(spark), str(tmp_path / "runs")
    assert io.export_dataset(df.where("false"), str(tmp_path / "other"), "x")["n_points"] == 0
    found = io.export_dataset(df, path, "9", start_us=0, artifacts=True)
    assert found["n_points"] == 20 and found["run_id"] == "9" and found["columns"][-1] == "run_id"
    io.export_dataset(df.limit(5), path, "10", start_us=0)
    latest = io.latest_run(spark, path)
    assert latest.count() == 5 and {r.run_id for r in latest.collect()} == {"10"}  # the last committed, whatever its name
    df.write.parquet(f"{path}/run_id=zz")  # a run whose manifest never came
    assert {r.run_id for r in io.latest_run(spark, path).collect()} == {"10"}
    io.export_dataset(df.limit(3), path, "9", start_us=0)
    assert io.latest_run(spark, path).count() == 3 and io.runs(spark, path).count() == 2
    assert spark.read.json(f"{path}_json").count() == 20 and spark.read.csv(f"{path}_csv", header=True).count() == 20


def test_an_export_computes_its_rows_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    df = export_frame(spark)
    io.export_dataset(df.mapInArrow(look, df.schema), str(tmp_path / "r"), "a", artifacts=True)
    assert calls.value == 20


def test_zone_ids_of_a_folder(spark, tmp_path):
    for name, kinds in (("b", "xy"), ("a", "uvw")):
        zones = {"features": [{"properties": {"zone_type": k}, "geometry": {"coordinates": [[[0, 0], [1, 0], [1, 1]]]}} for k in kinds]}
        (tmp_path / f"{name}.json").write_text(json.dumps(zones))
    assert [(r.zone_id, r.zone_type) for r in io.read_zones(spark, str(tmp_path)).orderBy("zone_id").collect()] == list(enumerate("uvwxy"))


def test_resampling_by_positions(spark):
    """Against a loop: samples off the grid are unknown to it, gaps count in rows."""
    times = [0, 100, 100, 230, 300, 330, 600, 700]
    speed = [1.0, None, 5.0, 9.0, 4.0, 8.0, None, 10.0]
    data = [(1, i, t * 1000, 49.0 + i / 10, s, None if i != 3 else "freinage", "service" if i == 4 else None, i) for i, (t, s) in enumerate(zip(times, speed))]
    df = spark.createDataFrame(data, "trip_id int, seq int, ts_us long, lat double, speed double, event string, osm_highway string, flag int")
    rows = resample.resample_positions(df, 10.0, tolerance_us=80_000).orderBy("seq").collect()
    known = {0: 0, 100: 1, 300: 4, 600: 6, 700: 7}
    assert [r.ts_us for r in rows] == [k * 100_000 for k in range(8)] and [r.seq for r in rows] == list(range(8))
    at = sorted(known)
    np.testing.assert_allclose([r.lat for r in rows], np.interp(range(8), [t / 100 for t in at], [49.0 + known[t] / 10 for t in at]))
    np.testing.assert_allclose([r.speed for r in rows], np.interp(range(8), [0, 3, 7], [1.0, 4.0, 10.0]))
    assert {r.osm_highway for r in rows} == {"service"} and [r.event for r in rows] == [None, None, "freinage", "freinage", None, None, None, None]
    full = df.withColumns({"lon": F.lit(1.0), "lat": 49 + F.col("seq") * 1e-6})
    got, want = resample.resample_full(full, 10.0), recurrences.compose_clean(resample.resample_positions(full, 10.0))
    assert got.orderBy("seq").collect() == want.orderBy("seq").collect() and "distance_m" in got.columns


def test_ends_of_the_grid(spark):
    """Ends that hardly move are 0; a trip no longer than they are keeps its speeds."""
    n = 60
    step = np.r_[0, np.minimum(np.arange(1, n), np.arange(n - 1, 0, -1)) * 0.005]  # metres a tenth of a second
    lat = 49 + np.cumsum(step) / 111_195
    df = trace(spark, {"lat": lat.tolist(), "lon": [1.0] * n, "speed": [1.0] * n, "event": ["stop" if i == 10 else None for i in range(n)]})
    rows = resample.sync_grid(df, 10.0).orderBy("seq").collect()
    v = [r.speed for r in rows]
    assert v[:10] == [0.0] * 10 and v[-10:] == [0.0] * 10 and all(x > 0.3 for x in v[10:-10])
    assert {r.event for r in rows} == {"stop"}
    assert all(r.speed > 0 for r in clean.zero_ends(trace(spark, {"speed": [0.1] * 9})).collect())


def test_variability_limits(spark):
    base = {"lat": [49.0] * 12, "lon": [1.0] * 12, "event": [None] * 12, **{f"gyro_{a}": [0.01 * math.sqrt(11 / 12) * (-1) ** i for i in range(12)] for a in "xyz"}}
    swing = lambda size: [size * math.sqrt(11 / 12) * (-1) ** i for i in range(12)]  # noqa: E731  (its sample deviation is the size)

    def verdict(speed, event=None, **acc):
        columns = {**base, "speed": speed, **{f"acc_{a}": swing(acc.get(a, 1.0)) for a in "xyz"}}
        return quality.realism_report(trace(spark, {**columns, "event": event or base["event"]})).first()

    r = verdict([1.0] * 12, x=0.06, y=3.9, z=4.1)
    assert (r.acc_x_varies, r.acc_y_varies, r.acc_z_varies) == (True, True, False)
    assert not verdict([1.0] * 12, x=0.04).acc_x_varies and verdict([0.25] * 12).acc_x_varies and not verdict([0.19] * 12).acc_x_varies
    assert not verdict([1.0] * 9 + [0.0] * 3).acc_x_varies and verdict([1.0] * 10 + [0.0] * 2).acc_x_varies  # ten moving rows at least
    assert not verdict([1.0] * 12, ["ouverture_porte"] * 3 + [None] * 9).acc_x_varies and verdict([1.0] * 12, ["stop"] * 3 + [None] * 9).acc_x_varies


def test_each_detector_is_its_part_of_all(spark):
    df = view(spark, SMALL)
    every = {}
    for r in detect.window_events(df).collect():
        every.setdefault(r.detector, set()).add((r.trip_id, r.seq))
    alone = {"speed_bump": detect.detect_speed_bump, "pothole": detect.detect_pothole, "curb": detect.detect_curb, "braking": detect.detect_braking, "acceleration": detect.detect_acceleration, "door_open": detect.detect_door_open}
    assert sum(map(len, every.values())) > 0
    for name, fn in alone.items():
        assert {(r.trip_id, r.seq) for r in fn(df).collect()} == every.get(name, set()), name


def test_detectors_by_loop(spark):
    rng = np.random.default_rng(6)
    n = 300
    values = {c: np.round(rng.normal(scale=k, size=n), 3) for c, k in (("acc_x", 3), ("acc_z", 5), ("gyro_x", 2), ("gyro_y", 2), ("gyro_z", 25))}
    df = trace(spark, {c: v.tolist() for c, v in values.items()})
    span = lambda c, i, w: np.ptp(values[c][i : i + w])
    z = lambda i, w: values["acc_z"][i : i + w]
    rules = {
        detect.detect_speed_bump: (8, lambda i: z(i, 8).max() >= 4 and z(i, 8).min() <= -4 and span("gyro_z", i, 8) >= 6), detect.detect_pothole: (8, lambda i: z(i, 8).max() >= 5 and z(i, 8).min() <= -5 and span("gyro_x", i, 8) >= 3),
        detect.detect_curb: (6, lambda i: z(i, 6).max() >= 6 and max(span(f"gyro_{a}", i, 6) for a in "xyz") >= 2), detect.detect_door_open: (6, lambda i: span("gyro_z", i, 6) >= 50),
        detect.detect_braking: (6, lambda i: values["acc_x"][i : i + 6].max() < -3), detect.detect_acceleration: (6, lambda i: values["acc_x"][i : i + 6].min() > 2.5),
    }
    for fn, (window, holds) in rules.items():
        want, last = [], None
        for i in range(n - window):
            if holds(i) and (last is None or i - last >= 20):
                want.append(i)
                last = i
        assert sorted(r.seq for r in fn(df).collect()) == want, fn.__name__


def test_first_stop(spark):
    df = trace(spark, {"event": [None, "stop", "stop", None]})
    assert column(clean.drop_leading_stop(df), "event") == [None, None, "stop", None]
    assert column(clean.drop_leading_stop(df, anywhere=False), "event") == [None, "stop", "stop", None]
    assert column(clean.drop_leading_stop(trace(spark, {"event": ["stop", "stop"]}), anywhere=False), "event") == [None, "stop"]


def test_trips_of_any_number(spark):
    """Start positions of 2 000 trips and more fit into their columns."""
    rows = spark.range(0, 3000 * 750, 750).selectExpr("id AS l_orderkey", "CAST(1 AS INT) AS l_linenumber", "id AS l_partkey", "id AS l_suppkey", "10.0D AS l_quantity", "1.0D AS l_extendedprice", "0.05D AS l_discount", "0.02D AS l_tax")
    from tripmill.plans.fixtures import TRACE

    got = spark.sql(TRACE.replace("FROM lineitem", "FROM {lineitem}"), lineitem=rows).agg(F.count_distinct("trip_id"), F.min("lon"), F.max("lon")).first()
    assert tuple(got) == (3000, 1.0, 1 + 1999 * 0.05)
