"""Exact vectors and independent loops for the trip operators."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripmill.operators import clean, detect, joins, kinematics, plan, quality, recurrences, report, resample
from tripmill.functions.windows import unwrap
from tripmill.sources import io, schema
from tripmill.streaming.trips import speed_windows


def trace(spark, columns, n=None, trip=1):
    n = n or len(next(iter(columns.values())))
    data = []
    for i in range(n):
        data.append((trip, i, i * 100_000, *(v[i] for v in columns.values())))
    kinds = {"event": "string", "osm_highway": "string", "road_type": "string"}
    return spark.createDataFrame(data, "trip_id int, seq int, ts_us long" + "".join(f", {c} {kinds.get(c, 'double')}" for c in columns))


def column(df, c):
    return [r[0] for r in df.orderBy("seq").select(c).collect()]


@pytest.mark.parametrize("events, inside", [
    ([None, "start_delivery", None, None, "end_delivery", None], [0, 1, 1, 1, 0, 0]),
    (["start_delivery", None, "end_delivery", None, "start_delivery", None], [1, 1, 0, 0, 1, 1]),
    ([None, "other", None], [0, 0, 0]),
])
def test_delivery_state(spark, events, inside):
    df = detect.delivery_state(trace(spark, {"event": events}))
    assert column(df, "in_delivery") == inside
    assert column(df, "delivery_state") == ["on_delivery" if x else "in_vehicle" for x in inside]
    assert dict(df.dtypes)["in_delivery"] == "tinyint"


def test_event_categories(spark):
    df = joins.event_categories(trace(spark, {"event": ["nid_de_poule", "acceleration_initiale", "meteo_pluie", None, "inconnu"]}))
    assert column(df, "event_infra") == [1, 0, 0, 0, 0]
    assert column(df, "event_behavior") == [0, 1, 0, 0, 0]
    assert column(df, "event_context") == [0, 0, 1, 0, 0]
    bare = joins.event_categories(trace(spark, {"lat": [1.0, 2.0]}))
    assert column(bare, "event_infra") == [0, 0]


def test_schema(spark):
    df = spark.createDataFrame([(1.0, 2.0, "x")], "lon double, lat double, extra string")
    out = schema.enforce_schema_order(df, ["lat", "lon", "speed"])
    assert out.columns == ["lat", "lon", "speed"] and out.first()["speed"] is None
    assert schema.enforce_schema_order(df, ["lat", "lon"], drop_extras=False).columns == ["lat", "lon", "extra"]
    again = schema.enforce_schema_order(out, ["lat", "lon", "speed"])
    assert again.columns == out.columns
    assert schema.enforce_schema_order(df, []) is df
    bad = spark.createDataFrame([("x", None, "7")], "speed string, event string, lat string")
    got = schema.apply_schema(bad, schema.canonical()).first()
    assert got["speed"] == 0 and got["lat"] == 7 and got["event"] is None and got["timestamp"].year == 1970
    with pytest.raises(ValueError):
        schema.require_columns(df, ["nope"])
    merged = schema.merge_schema(schema.canonical(), schema.load_schema([{"name": "speed"}, {"name": "rain", "dtype": "float64"}]))
    assert merged.names == [*schema.canonical().names, "rain"]


def test_unwrap_and_gradient(spark):
    rng = np.random.default_rng(3)
    a = rng.uniform(-10, 10, 60).tolist()
    t = np.cumsum(rng.uniform(0.05, 0.4, 60)).tolist()
    df = trace(spark, {"a": a, "t": t})
    assert np.allclose(column(unwrap(df, "a", "u"), "u"), np.unwrap(a))
    from tripmill.functions.windows import gradient

    assert np.allclose(column(df.withColumn("g", gradient("a")), "g"), np.gradient(a))
    assert np.allclose(column(df.withColumn("g", gradient("a", "t")), "g"), np.gradient(a, t))


def loop_slew(v, most):
    out = list(v)
    for i in range(1, len(out)):
        out[i] = min(max(out[i], out[i - 1] - most), out[i - 1] + most)
    return out


def test_recurrences(spark):
    rng = np.random.default_rng(5)
    v = rng.uniform(0, 30, 80).tolist()
    df = trace(spark, {"speed": v})
    assert np.allclose(column(recurrences.slew_limit(df, 1.5), "speed"), loop_slew(v, 1.5))
    s, want = v[0], []
    for x in v:
        s = 0.7 * s + 0.3 * x if want else x
        want.append(s)
    assert np.allclose(column(recurrences.ema(df), "speed_ema"), want)
    hits = spark.createDataFrame([(1, i) for i in (0, 5, 19, 20, 21, 39, 40, 90)], "trip_id int, seq int")
    assert sorted(r.seq for r in recurrences.spaced(hits, 20).collect()) == [0, 20, 40, 90]


def test_positions_are_repaired(spark):
    lat = [49.0 + i * 1e-5 for i in range(30)]
    lat[15] += 0.01
    base = {"lat": lat, "lon": [1.0] * 30, "speed": [10.0] * 30, "event": [None] * 30}
    for fn in (recurrences.clamp_gps_jumps, recurrences.cap_absolute_speed, clean.filter_geo_spikes):
        df = fn(trace(spark, base))
        steps = column(kinematics.step_m(df), "step_m")
        assert max(steps) < 50 and df.count() == 30, fn.__name__
    standing = {**base, "event": ["stop"] * 30}
    assert column(recurrences.clamp_gps_jumps(trace(spark, standing)), "lat") == lat
    done = recurrences.compose_clean(trace(spark, base))
    assert done.count() == 30 and {"distance_m", "speed"} <= set(done.columns)


def test_smooth_stops(spark):
    v = [5.0] * 30 + [0.0] * 10 + [5.0] * 30
    got = column(recurrences.smooth_stops(trace(spark, {"speed": v})), "speed")
    assert got[30:40] == [0.0] * 10 and all(a >= b for a, b in zip(got[10:30], got[11:31])) and got[0] == 5.0


def test_unsorted_times(spark):
    df = spark.createDataFrame([(1, 0, 2000), (1, 1, 1000), (1, 2, 2000), (1, 3, 2000)], "trip_id int, seq int, ts_us long")
    assert column(clean.strictly_increasing_ts(df), "ts_us") == [1000, 2000, 3000, 4000]


def test_nulls_and_blanks(spark):
    df = trace(spark, {"lat": [None, 1.0, None, 3.0, None], "lon": [0.0, 1.0, float("nan"), 3.0, 4.0], "speed": [1.0, float("inf"), 3.0, 4.0, 5.0], "event": ["", " ", "stop", None, "x"]})
    assert column(clean.fill_coordinates(df), "lat") == [1.0, 1.0, 2.0, 3.0, 3.0]
    assert clean.drop_nonfinite(df).count() == 1
    assert column(clean.clean_invalid_rows(df), "event") == [None, None]
    empty = df.limit(0)
    for fn in (report.trip_summary, quality.qa_report, detect.detect_all, recurrences.slew_limit, clean.filter_geo_spikes, resample.resample_linear):
        full = empty.withColumns({c: F.lit(0.0) for c in ("acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z")})
        assert fn(full).count() == 0, fn.__name__


def test_detectors_have_both_answers(spark):
    from tests.conftest import DATA
    from tripmill.plans.fixtures import view

    df = view(spark, DATA.replace("sf0.001", "sf0.01")).persist()
    together = sorted(map(tuple, detect.window_events(df).collect()))
    for name in detect.DETECTORS:
        alone = sorted((r.trip_id, r.seq, name) for r in getattr(detect, f"detect_{name}")(df).collect())
        assert alone == [h for h in together if h[2] == name], name
        assert 0 < len({t for t, *_ in alone}) < 20, name
    df.unpersist()


def test_schedule_matches_a_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(1, i, f"s{i}", 49.0, 1.0, 0 if i == 0 else int(rng.integers(100, 500)), int(rng.integers(0, 100)), int(1_735_689_600 + 400 * i + rng.integers(0, 900)) if i % 3 == 2 else None) for i in range(40)]
    got = plan.schedule(spark.createDataFrame(rows, "plan_id int, stop_seq int, stop_id string, lat double, lon double, travel_s int, service_s int, tw_start_s long")).orderBy("stop_seq").collect()
    t = 1_735_689_600
    for r, g in zip(rows, got):
        arrive = t + r[5]
        wait = max(0, (r[7] or 0) - arrive)
        t = arrive + wait + r[6]
        assert (g.arrive_s, g.wait_s, g.depart_s) == (arrive, wait, t)


def test_sources(spark, tmp_path):
    n = 20
    base = {"lat": [49.0] * n, "lon": [1.0] * n, "speed": [i * 0.75 for i in range(n)], **{c: [0.0] * n for c in ("acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z", "heading", "sinuosity", "curvature", "altitude", "slope_percent")}, "event": [None] * n, "road_type": ["residential"] * n, "osm_highway": ["residential"] * n}
    df = trace(spark, base).withColumn("timestamp", F.timestamp_micros("ts_us"))
    io.write_traces_csv(df, str(tmp_path / "t.csv"))
    back = io.read_traces(spark, str(tmp_path / "t.csv"))
    assert back.count() == n and back.columns[:18] == list(schema.EXPORT_COLUMNS)
    with pytest.raises(ValueError):
        io.write_traces_csv(df.drop("heading"), str(tmp_path / "u.csv"))
    io.write_traces_padded(df.drop("heading"), str(tmp_path / "v.csv"))
    for run in ("a", "b"):
        io.export_dataset(df, str(tmp_path / "runs"), run, start_us=0)
    assert io.latest_run(spark, str(tmp_path / "runs")).select("run_id").distinct().collect()[0][0] == "b"
    assert io.manifest(df, "a").first()["n_points"] == n
    io.write_json(trace(spark, base), str(tmp_path / "j"))
    with pytest.raises(ValueError):
        io.write_json(trace(spark, base).union(trace(spark, base)), str(tmp_path / "k"))
    io.write_anomalies(trace(spark, {**base, "speed": [0.0, 50.0] * 10}), str(tmp_path / "anomalies"))
    zones = {"features": [{"properties": {"zone_type": "urban"}, "geometry": {"coordinates": [[[0, 48], [2, 48], [2, 50], [0, 50]]]}}]}
    (tmp_path / "z.json").write_text(json.dumps(zones))
    found = joins.zone_join(trace(spark, base), io.read_zones(spark, str(tmp_path / "z.json")))
    assert set(column(found, "osm_zone")) == {"urban"}
    body = json.dumps({"routes": [{"duration": 9.0, "geometry": {"coordinates": [[1, 49], [1.1, 49], [1.2, 49]]}, "legs": [{"annotation": {"duration": [2.0, 5.0]}, "steps": [{"maneuver": {"type": "roundabout", "location": [1.1, 49]}}]}]}]})
    routes = spark.createDataFrame([(1, body)], "route_id int, body string")
    assert [r.t_rel_s for r in io.flatten_routes(routes).orderBy("pt_idx").collect()] == [0.0, 2.0, 7.0]
    assert io.extract_roundabouts(routes).count() == 1


def test_flags_become_labels(spark):
    df = trace(spark, {"event": [None, None, None]}).withColumn("flag_stop", (F.col("seq") == 1).cast("int")).withColumn("flag_wait", (F.col("seq") >= 1).cast("int"))
    assert column(io.event_from_flags(df), "event") == [None, "stop", "wait"]


def test_stream(spark, tmp_path):
    df = trace(spark, {"speed": [float(i) for i in range(1200)], "event": [None] * 1200}).withColumn("timestamp", F.timestamp_micros("ts_us"))
    df.write.parquet(str(tmp_path / "in"))
    stream = speed_windows(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").agg(F.sum("n")).first()[0] == 1200


def test_revisits_and_nearest_match_brute_force(spark):
    rng = np.random.default_rng(2)
    lat, lon = (49 + rng.uniform(0, 0.004, 120)).tolist(), (1 + rng.uniform(0, 0.004, 120)).tolist()
    df = trace(spark, {"lat": lat, "lon": lon})
    metres = lambda a, b: recurrences._metres(lat[a], lon[a], lat[b], lon[b])
    want = any(metres(i, j) < 30 for i in range(120) for j in range(i + 10, 120))
    assert joins.revisits(df).first()["revisits"] == want
    nodes = spark.createDataFrame([(i, 49 + x, 1 + y, "service") for i, (x, y) in enumerate(rng.uniform(0, 0.004, (50, 2)).tolist())], "node_id long, lat double, lon double, highway string")
    pts = [(r.node_id, r.lat, r.lon) for r in nodes.collect()]
    got = {r.seq: r.node_id for r in joins.nearest_road(df, nodes, size=0.004).collect()}
    for i in range(120):
        best = min(pts, key=lambda p: (round(math.hypot(p[1] - lat[i], p[2] - lon[i]), 12), p[0]))
        assert got[i] == best[0]


def test_small_operators(spark):
    df = trace(spark, {"speed": [1.0, 2.0, 3.0], "acc_x": [9.80665, 0.0, -9.80665], "event": ["Stop", None, "WAIT_1"], "road_type": ["Primary", None, "service"], "altitude": [10.0, None, 9999.0]}).withColumn("delivery", F.col("seq") != 1)
    assert column(clean.number_deliveries(df), "event") == ["stop_001", None, "stop_002"]
    assert column(clean.to_g(df, "acc_x"), "acc_x_g") == [1.0, 0.0, -1.0]
    assert column(clean.normalize_road_type(df), "road_type") == ["primary", "unknown", "service"]
    assert column(report.stop_wait_phases(df), "is_wait") == [0, 0, 1]
    assert column(clean.target_speed_diff(df.withColumn("target_speed", F.lit(2.0))), "speed_diff") == [-1.0, 0.0, 1.0]
    assert quality.elevation_quality(df).first()["elevation_ok"] is False
    assert clean.keep_road_types(df, ("service",)).count() == 1 and clean.exclude_events(df, ("Stop",)).count() == 2
    holds = spark.createDataFrame([(1, 1, "b", 5), (1, 0, "a", 7)], "plan_id int, leg_idx int, stop_id string, hold_s int")
    got = report.hold_summary(holds).first()
    assert (got.n_holds, got.total_s, [i.stop_id for i in got["items"]]) == (2, 12, ["a", "b"])
    assert detect.follow_up_event(trace(spark, {"event": ["stop_001", *[None] * 9, "x", None]})).where("event = 'x|ouverture'").count() == 1


def test_stitch_holds_and_moves(spark):
    points = spark.createDataFrame([(1, leg, i, 49.0 + 0.001 * (leg * 10 + i), 1.0, float(i)) for leg in (0, 1) for i in range(11)], "plan_id int, leg_idx int, pt_idx int, lat double, lon double, t_rel_s double")
    legs = spark.createDataFrame([(1, 0, 10.0, 5), (1, 1, 10.0, 0)], "plan_id int, leg_idx int, duration_s double, service_s int")
    rows = resample.stitch(points, legs, hz=1.0, start_us=0).orderBy("seq").collect()
    assert [r.ts_us for r in rows] == [i * 1_000_000 for i in range(26)]
    want = [49 + 0.001 * min(i, 10) for i in range(15)] + [49.01 + 0.001 * i for i in range(11)]
    assert np.allclose([r.lat for r in rows], want) and rows[12].speed == 0 and rows[5].speed > 50
    dense = resample.densify_1m(trace(spark, {"lat": [49.0, 49.0001], "lon": [1.0, 1.0]})).orderBy("part").collect()
    assert len(dense) == 12 and dense[0].lat == 49.0 and abs(dense[-1].lat - 49.0001) < 1e-12


def test_asof_ties_and_reach(spark):
    grid = spark.createDataFrame([(1, 0, 1000, None), (1, 1, 2000, "own"), (1, 2, 900_000, "own")], "trip_id int, seq int, ts_us long, event string")
    events = spark.createDataFrame([(1, 0, 500, "a"), (1, 1, 1500, "b"), (1, 2, 1500, "c"), (1, 3, 2500, "d")], "trip_id int, seq int, ts_us long, event string")
    assert column(joins.asof_event(grid, events, 600), "event") == ["a", "c", "own"]


def test_anchor_rules(spark):
    rows = [(1, "brake", i, int(t * 1e6), 49.0 + m / 111_195, 1.0) for i, (t, m) in enumerate([(0, 0), (0.5, 50), (1.0, 5), (2.0, 60), (2.1, 300), (5.0, 305)])]
    got = recurrences.anchor_events(spark.createDataFrame(rows, "trip_id int, event_type string, seq int, ts_us long, lat double, lon double"))
    assert sorted(r.seq for r in got.collect()) == [0, 3, 5]


def test_export_schema(spark):
    df = spark.createDataFrame([("x", "1.5", "2020-01-01 00:00:00", "bad")], "extra string, lat string, timestamp string, speed string")
    out = schema.enforce_export_schema(df)
    assert out.columns == ["timestamp", "lat", "speed", "extra"] and out.first()["speed"] is None and out.first()["lat"] == 1.5


def test_defaults_and_thinning(spark):
    df = spark.createDataFrame([(1, 0, "x", float("nan"), None), (1, 1, "2.5", 1.0, "stop"), (1, 2, None, float("inf"), "stop")], "trip_id int, seq int, acc_x string, acc_y double, event string")
    got = clean.fill_imu_defaults(df).orderBy("seq").collect()
    assert [(r.acc_x, r.acc_y, r.gyro_z, r.event) for r in got] == [(0.0, 0.0, 0.0, ""), (2.5, 1.0, 0.0, "stop"), (0.0, 0.0, 0.0, "stop")]
    df = trace(spark, {"event": ["freinage", "freinage", None, "freinage", "stop", "stop"]})
    assert column(clean.thin_consecutive(df), "event") == ["freinage", None, None, "freinage", "stop", "stop"]
    times = spark.createDataFrame([(-1,), (0,), (1_735_689_600_123_456,)], "t long").select(clean.iso_utc("t").alias("t")).collect()
    assert [r.t for r in times] == ["1969-12-31T23:59:59.999999Z", "1970-01-01T00:00:00.000000Z", "2025-01-01T00:00:00.123456Z"]


def test_searches_without_a_limit(spark):
    """Rows far from every node, anchors far from every sample, weather far away: all against brute force."""
    rng = np.random.default_rng(12)
    lat, lon = rng.uniform(-60, 60, 40).tolist(), rng.uniform(-170, 170, 40).tolist()
    df = trace(spark, {"lat": lat, "lon": lon})
    pts = [(int(i), float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-60, 60, 7), rng.uniform(-170, 170, 7)))]
    nodes = spark.createDataFrame([(*p, "service") for p in pts], "node_id long, lat double, lon double, highway string")
    got = {r.seq: r.node_id for r in joins.nearest_road(df, nodes).collect()}
    assert got == {i: min(pts, key=lambda p: (round(math.hypot(p[1] - lat[i], p[2] - lon[i]), 12), p[0]))[0] for i in range(40)}
    weather = spark.createDataFrame([(0 if i % 2 else 50_000_000_000, a, b, float(i)) for i, a, b in pts], "ts_us long, lat double, lon double, temperature double")
    got = {r.seq: r.temperature for r in joins.weather_join(df, weather).collect()}
    assert got == {i: float(min((p for p in pts if p[0] % 2), key=lambda p: math.hypot(p[1] - lat[i], p[2] - lon[i]))[0]) for i in range(40)}
    at = spark.createDataFrame([(1, i, a, b) for i, a, b in pts], "trip_id int, anchor_id long, lat double, lon double")
    got = {r.anchor_id: r.seq for r in joins.anchor_at_geo(df, at).collect()}
    assert got == {i: min(range(40), key=lambda s: (round(recurrences._metres(a, b, lat[s], lon[s]), 6), s)) for i, a, b in pts}
    times = spark.createDataFrame([(1, t) for t in (-5, 149_999, 150_000, 150_001, 99_000_000)], "trip_id int, t_us long")
    assert {r.t_us: r.seq for r in joins.anchor_at_time(df, times).collect()} == {-5: 0, 149_999: 1, 150_000: 1, 150_001: 2, 99_000_000: 39}


def test_expected_duration(spark):
    df = trace(spark, {"lat": [49.0, 49.1, 49.2], "lon": [1.0] * 3, "speed": [1.0] * 3, "event": [None, "stop", None]})
    longer = spark.createDataFrame([(1, 0.55)], "trip_id int, duration_s double")
    rows = resample.resample_linear(df, hz=10.0, expected=longer).orderBy("seq").collect()
    assert [r.ts_us for r in rows] == [i * 100_000 for i in range(7)] or len(rows) == 7
    assert [round(r.lat, 6) for r in rows] == [49.0, 49.1, *[49.2] * 5]
    assert resample.sync_grid(df, expected=longer).count() == 7


def test_plans_and_runs(spark, tmp_path):
    spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "plan_id int, stop_seq int").write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError, match="2"):
        io.read_stop_plan(spark, str(tmp_path / "p"))
    routes = spark.createDataFrame([(1, json.dumps({"routes": [{"duration": 9.0, "geometry": {"coordinates": [[1, 49]] * 4}, "legs": []}]}))], "route_id int, body string")
    assert [r.t_rel_s for r in io.flatten_routes(routes).orderBy("pt_idx").collect()] == [0.0, 3.0, 6.0, 9.0]
