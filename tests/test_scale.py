"""Results that only larger tables show: ties of doubles, and forms that spare a shuffle or a sort against those that don't."""

import math

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import DATA
from tripmill.operators import detect, joins, plan, recurrences, resample
from tripmill.plans import enrich, repair


def standing(spark, n, speed=None):
    return spark.createDataFrame([(1, i, i * 100_000, 49.0, 1.0, 0.0 if speed is None else speed[i], None) for i in range(n)], "trip_id int, seq int, ts_us long, lat double, lon double, speed double, event string")


def test_the_last_seconds_are_decided_as_in_sql(spark):
    """Sample 2992 of 3093 lies 10 s before the end; in tenths times 0.1 it doesn't, and the halt is that of the next one."""
    n = 3093
    assert 2992 * 0.1 < 3092 * 0.1 - 10 and 299.2 >= 309.2 - 10
    got = detect.tag_events(standing(spark, n, [20.0 - 0.1 * max(0, i - 2900) for i in range(n)])).where("event IS NOT NULL")
    assert [(r.seq, r.event) for r in got.collect()] == [(2993, "final_deceleration")]


def test_times_are_exact_sums(spark):
    step, n = 0.1000005, 400
    got = [r.ts_us for r in resample.retime(standing(spark, n).withColumn("target_speed", F.lit(1.0)), least_s=step).orderBy("seq").collect()]
    want = [0] + [math.floor(math.fsum([step] * (i + 1)) * 1e6 + 0.5) for i in range(1, n)]
    plain = np.cumsum([step] * n) * 1e6
    assert got == want != [0] + [math.floor(x + 0.5) for x in plain[1:]]


def straight(spark):
    rng = np.random.default_rng(7)
    stops = [(p, s, 49 + float(rng.integers(0, 9)) / 500, 1 + float(rng.integers(0, 9)) / 500, 60 * int(rng.integers(0, 3))) for p in (1, 2, 3) for s in range(5)]
    stops += [(4, s, 49.0, 1.0, 30) for s in range(3)]  # never moves
    plans = spark.createDataFrame([(*s, f"S{s[0]}-{s[1]}") for s in stops], "plan_id int, stop_seq int, lat double, lon double, service_s int, stop_id string")
    return plan.straight_line_legs(plan.build_legs(plans))


def test_seams_without_a_sort(spark):
    legs = straight(spark)
    fast = resample.seam_dedupe(plan.leg_points(legs, before=True))
    want = resample.seam_dedupe(plan.leg_points(legs))
    assert fast.columns == want.columns and fast.count() == want.count() > 0 and fast.exceptAll(want).isEmpty()
    text = fast._jdf.queryExecution().executedPlan().toString()
    assert text.rindex("Generate explode") < text.index("Window")  # printed from the top: no window, sort or exchange above the points


def test_stitch_of_packed_points(spark):
    """Straight legs against points as rows, and against a loop in plain Python."""
    legs = straight(spark)
    packed = resample.stitch(None, legs, 1.0, 0)
    assert packed.exceptAll(resample.stitch(plan.leg_points(legs), legs, 1.0, 0)).isEmpty()
    got, t0, known = [r for r in packed.where("trip_id = 1").orderBy("seq").collect()], 0.0, {}
    points = [[r for r in plan.leg_points(legs.where("plan_id = 1")).orderBy("leg_idx", "pt_idx").collect() if r.leg_idx == i] for i in range(4)]
    for leg, of_leg in zip(legs.where("plan_id = 1").orderBy("leg_idx").collect(), points):
        times = [(p.t_rel_s, p.lat, p.lon) for p in of_leg] + [(of_leg[-1].t_rel_s + leg.service_s, of_leg[-1].lat, of_leg[-1].lon)]
        for t, lat, lon in times:
            known.setdefault(math.floor((t0 + t) * 1e6 + 0.5), (lat, lon))
        t0 += leg.duration_s + leg.service_s
    at = sorted(known)
    assert [r.ts_us for r in got] == list(range(at[0], at[-1] + 1, 1_000_000)) and [r.seq for r in got] == list(range(len(got)))
    for axis, c in enumerate(("lat", "lon")):
        assert np.allclose([r[c] for r in got], np.interp([r.ts_us for r in got], at, [known[t][axis] for t in at]), rtol=0, atol=1e-9)


def test_buffered_of_trips_with_large_numbers(spark, tmp_path):
    """126 000 trips further everything but the number repeats itself; the trip times 100 000 is no int there."""
    far = 126_000
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet")
    lines.withColumn("l_orderkey", F.col("l_orderkey") + far * 750).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = enrich.buffered(spark, str(tmp_path)).withColumn("trip_id", F.col("trip_id") - far)
    want = enrich.buffered(spark, DATA)
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty() and want.select("road_tag").distinct().count() > 2


def test_segments_and_samples_of_one_place_meet_once(spark, monkeypatch):
    """Fifty halts in one place and a road that ends there: two items a cell, and the halt with the smallest number wins; no array function sees a sample."""
    halts = [(100 - k, 49.0, 1.0, 49.0, 1.0, f"h{k}") for k in range(50)] + [(7, 49.001, 1.0, 49.0, 1.0, "road"), (8, 49.001, 1.0, 49.0, 1.0, "again")]
    segments = spark.createDataFrame(halts, "segment_id int, lat1 double, lon1 double, lat2 double, lon2 double, highway string")
    here = [(1, k, 49.0, 1.0) for k in range(30)] + [(1, 30, 48.9999, 1.0), (1, 31, 49.0005, 1.0), (1, 32, 49.1, 1.0), (1, 33, None, 1.0), (1, 34, 49.0, None)]
    met, refine = [], joins.refine
    monkeypatch.setattr(joins, "refine", lambda leaves, coarse, *a, **k: met.append(coarse) or refine(leaves, coarse, *a, **k))
    df = spark.createDataFrame(here, "trip_id int, seq int, lat double, lon double")
    got = joins.road_within_buffer(df, segments.where("segment_id <> 8"), 20.0)
    assert got.columns == [*df.columns, "road_tag"]
    assert [r.road_tag for r in got.orderBy("seq").collect()] == ["road"] * 32 + ["inconnu"] * 3
    only = joins.road_within_buffer(df, segments.where("segment_id > 8"), 20.0).where("seq <= 30").select("road_tag").distinct().collect()
    assert [r.road_tag for r in only] == ["h49"]
    parted = joins.road_within_buffer(df, segments, 20.0, parts=7)
    assert "7), REPARTITION_BY_NUM" in parted._jdf.queryExecution().executedPlan().toString()
    assert met[2].selectExpr("max(size(items))").first()[0] == 2
    text = got._jdf.queryExecution().executedPlan().toString()
    assert text.index("lambda") > text.index("Generate explode")  # printed from the top: below the rows of pairs there are only cells


def uneven(spark):
    """Legs that meet or don't, holds of zero, of a fraction, unknown and negative, one place, unknown places, plans of one short leg and of many."""
    rng, rows = np.random.default_rng(12), []
    for p in range(12):
        here = rng.uniform(0, 0.02, 2) + (49, 1)
        for leg in range(1 if p < 2 else int(rng.integers(2, 9))):
            there = here if p == 3 else rng.uniform(0, 0.02, 2) + (49, 1)
            a, b = (here + (1e-4 if p == 4 else 0)).tolist(), there.tolist()
            lat = None if p == 5 and leg == 1 else a[0]
            service = [0.0, 0.25, None, 60.0, 61.5, -3.0 if p == 6 else 0.0][int(rng.integers(6))]
            rows.append((p, leg, lat, a[1], b[0], b[1], service))
            here = there
    return plan.straight_line_legs(spark.createDataFrame(rows, "plan_id int, leg_idx int, lat1 double, lon1 double, lat2 double, lon2 double, service_s double").repartition(3))


def loop_stitched(legs, step):
    """One plan, its points sorted by time and place, of one time the first."""
    known, t0 = [], 0.0
    for r in sorted(legs, key=lambda r: r.leg_idx):
        n, nan = r.n_points, math.nan
        y, x, z, w = (nan if v is None else v for v in (r.lat1, r.lon1, r.lat2, r.lon2))
        at = [(t0 + i / (n - 1) * r.duration_s, y + i / (n - 1) * (z - y), x + i / (n - 1) * (w - x)) for i in range(n)]
        if r.service_s and r.service_s > 0:
            at.append((t0 + (r.duration_s + r.service_s), *at[-1][1:]))
        known += [(math.floor(t * 1e6 + 0.5), math.isnan(lat), lat, lon) for t, lat, lon in at]
        t0 += 0.0 if r.service_s is None else r.duration_s + r.service_s
    known.sort()
    known = [k for i, k in enumerate(known) if i == 0 or k[0] != known[i - 1][0]]
    rows, a = [], 0
    for g in range(known[0][0], known[-1][0] + 1, step):
        while a + 1 < len(known) and known[a + 1][0] <= g:
            a += 1
        b = min(a + 1, len(known) - 1)
        s = (g - known[a][0]) / max(known[b][0] - known[a][0], 1)
        rows.append((g, *(known[a][c] + s * (known[b][c] - known[a][c]) for c in (2, 3))))
    v = [0.0] + [recurrences._metres(*p[1:], *q[1:]) / (step / 1e6) for p, q in zip(rows, rows[1:])]
    if len(v) > 1:
        v = [(v[0] + v[1]) / 2] + [math.nan if any(map(math.isnan, v[i - 1 : i + 2])) else sorted(v[i - 1 : i + 2])[1] for i in range(1, len(v) - 1)] + [(v[-2] + v[-1]) / 2]
    return [(*r, x) for r, x in zip(rows, v)]


def test_plans_stitched_many_at_once(spark):
    """Whatever legs are like and however many plans are done at once, rows are those of a loop over one plan's points; the sums of plans are those of their rows."""
    legs = uneven(spark).cache()
    at = resample._started(legs)
    for hz, block in ((1.0, 1), (3.0, 1 << 14), (1.0, 10**9)):
        got, want = {}, {}
        for r in recurrences.stitched_straight(at, hz, 7, block=block).collect():
            got.setdefault(r.trip_id, []).append((r.seq, r.ts_us - 7, r.lat, r.lon, r.speed))
        for r in legs.collect():
            want.setdefault(r.plan_id, []).append(r)
        assert got.keys() == want.keys()
        for p, of_plan in want.items():
            mine, loop = sorted(got[p]), loop_stitched(of_plan, round(1e6 / hz))
            assert [r[:2] for r in mine] == [(i, r[0]) for i, r in enumerate(loop)], (p, hz)
            assert np.allclose([r[2:] for r in mine], [r[1:] for r in loop], rtol=0, atol=1e-8, equal_nan=True), (p, hz)
    whole = resample.stitch(plan.leg_points(legs), legs, 1.0).groupBy("trip_id").agg(F.count("*").alias("n"), F.max("speed").alias("s"), F.avg("lat").alias("l"))
    sums = {r.trip_id: r for r in resample.stitch_summary(legs, 1.0).collect()}
    assert len(sums) == 12
    for r in whole.collect():
        assert r.n == sums[r.trip_id].n and np.allclose([r.s, r.l], [sums[r.trip_id].max_speed, sums[r.trip_id].lat], rtol=0, atol=1e-10, equal_nan=True)


def test_stitched_rows_stay_where_they_are_made(spark):
    """One row a plan leaves the workers, not four hundred a leg; partitions grow with the orders."""
    text = repair.stitched(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in text and text.count("MapInArrow") == 1 and "REPARTITION_BY_NUM" in text
