"""Queries on detection, quality and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmill.functions.labels import EVENT_RULES, PLATEAUS
from tripmill.operators import clean as C
from tripmill.operators import detect as D
from tripmill.operators import joins as J
from tripmill.operators import kinematics as K
from tripmill.operators import quality as Q
from tripmill.operators import recurrences as R
from tripmill.operators import report as A
from tripmill.plans.fixtures import view, with_views
from tripmill.plans.motion import DT, ELLIPSOID, TURN, rounded
from tripmill.plans.sqltext import HEADING, STEP, UPTO, frame, gradient, gradient_at, islands, lag, metres, r6, road_type

BLANK = "(event IS NULL OR trim(event) = '')"


def a1_trip_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.trip_summary(view(spark, d)))


SUMMARY = f"""WITH s AS ({DT}), e AS (SELECT *, event = 'stop' AND {lag('event')} IS DISTINCT FROM 'stop' AS fresh FROM s)
SELECT trip_id, {r6('(max(ts_us) - min(ts_us)) / 1e6')} AS duration_s, {r6('sum(step_m)')} AS distance_m, {r6('avg(speed)')} AS mean_speed, count(*) FILTER (fresh) AS stop_blocks,
  {r6("coalesce(sum(dt_s) FILTER (event = 'stop'), 0e0)")} AS stop_s FROM e GROUP BY trip_id"""


def window_events(spark: SparkSession, d: str) -> DataFrame:
    return D.window_events(view(spark, d))


def _window_events_sql() -> str:
    rng = lambda c, f: f"(max({c}) OVER {f} - min({c}) OVER {f})"
    f8, f6 = frame(0, 7), frame(0, 5)
    rules = {
        "speed_bump": (8, f"max(acc_z) OVER {f8} >= 4 AND min(acc_z) OVER {f8} <= -4 AND {rng('gyro_z', f8)} >= 6"), "pothole": (8, f"max(acc_z) OVER {f8} >= 5 AND min(acc_z) OVER {f8} <= -5 AND {rng('gyro_x', f8)} >= 3"),
        "curb": (6, f"max(acc_z) OVER {f6} >= 6 AND greatest({rng('gyro_x', f6)}, {rng('gyro_y', f6)}, {rng('gyro_z', f6)}) >= 2"), "braking": (6, f"max(acc_x) OVER {f6} < -3"),
        "acceleration": (6, f"min(acc_x) OVER {f6} > 2.5"), "door_open": (6, f"{rng('gyro_z', f6)} >= 50"),
    }
    hits = " UNION ALL ".join(f"SELECT trip_id, seq, '{name}' AS detector FROM (SELECT trip_id, seq, count(*) OVER (PARTITION BY trip_id) AS n, {rule} AS hit FROM trace) z WHERE hit AND seq < n - {w}" for name, (w, rule) in rules.items())
    return f"""WITH RECURSIVE c AS ({hits}), h AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY trip_id, detector ORDER BY seq) AS i FROM c),
k AS (SELECT trip_id, detector, seq, i, true AS kept, seq AS last FROM h WHERE i = 1 UNION ALL
      SELECT h.trip_id, h.detector, h.seq, h.i, h.seq - k.last >= 20, CASE WHEN h.seq - k.last >= 20 THEN h.seq ELSE k.last END FROM k JOIN h ON h.trip_id = k.trip_id AND h.detector = k.detector AND h.i = k.i + 1)
SELECT trip_id, seq, detector FROM k WHERE kept"""


def halts(spark: SparkSession, d: str) -> DataFrame:
    df = view(spark, d)
    return D.detect_stop(df).withColumn("kind", F.lit("stop")).unionByName(D.detect_wait(df).withColumn("kind", F.lit("wait"))).drop("run_id")


HALTS = f"""SELECT trip_id, min(seq) AS start_seq, max(seq) AS end_seq, count(*) AS n_rows, CASE WHEN count(*) >= 1200 THEN 'stop' ELSE 'wait' END AS kind
FROM {islands('speed < 0.1')} z WHERE run_id IS NOT NULL GROUP BY trip_id, run_id HAVING count(*) >= 300"""


def ends(spark: SparkSession, d: str) -> DataFrame:
    df = view(spark, d)
    return D.detect_ends(df).join(D.strong_ends(df.withColumn("speed", F.col("speed") * 3.6)), "trip_id").join(D.event_presence(df), "trip_id").join(D.validate_turns(df), "trip_id")


ENDS = f"""WITH t AS (SELECT *, count(*) OVER (PARTITION BY trip_id) AS n, {TURN} AS turn FROM trace)
SELECT trip_id, min(seq) FILTER (speed > 3 AND speed < 50 AND acc_x > 1 AND seq < least(300, n - 5)) AS initial_seq, max(seq) FILTER (speed > 3 AND speed < 50 AND acc_x < -1 AND seq > greatest(0, n - 300)) AS final_seq,
  count(*) FILTER (seq < 50 AND acc_x > 2.3) >= 45 AND coalesce(max(speed * 3.6) FILTER (seq < 50) > 40, false) AS strong_initial, count(*) FILTER (n - seq <= 40 AND acc_x < -1.5) >= 30 AND coalesce(min(speed * 3.6) FILTER (n - seq <= 40) < 1, false) AS strong_final,
  {", ".join(f"coalesce(bool_or(event = '{e}'), false) AS has_{e}" for e in ("freinage", "acceleration", "trottoir", "nid_de_poule", "dos_dane"))},
  count(*) FILTER (least(turn, 360 - turn) > 30) AS n_turns, coalesce(bool_or(least(turn, 360 - turn) > 30 AND abs(acc_y) > 0.5), false) AS turn_in_acc_y FROM t GROUP BY trip_id"""


def anomalies(spark: SparkSession, d: str) -> DataFrame:
    df = view(spark, d)
    parts = {"jump": D.gps_jumps(df), "speed": D.speed_anomalies(df, 0.3), "space": D.spatiotemporal_anomalies(df), "turn": D.detect_turns(df)}
    out = [p.select("trip_id", "seq", F.col(p.columns[2]).alias("value"), F.lit(k).alias("kind")) for k, p in parts.items()]
    return rounded(out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]))


ANOMALIES = f"""WITH s AS (SELECT *, {STEP} AS step_m, abs(speed - {lag('speed')}) * 3.6e0 AS dv, (ts_us - {lag('ts_us')}) / 1e6 AS dt, {TURN} AS turn FROM trace)
SELECT trip_id, seq - 1 AS seq, {r6('step_m')} AS value, 'jump' AS kind FROM s WHERE step_m > 50 UNION ALL SELECT trip_id, seq - 1, {r6('dv')}, 'speed' FROM s WHERE dv > 0.3
UNION ALL SELECT trip_id, seq, {r6('abs(step_m - speed * dt)')}, 'space' FROM s WHERE abs(step_m - speed * dt) > CASE WHEN speed * 3.6 > 80 THEN 15 WHEN speed * 3.6 > 40 THEN 10 ELSE 5 END
UNION ALL SELECT trip_id, seq, {r6('least(turn, 360 - turn)')}, 'turn' FROM s WHERE least(turn, 360 - turn) > 30"""


def tagged(spark: SparkSession, d: str) -> DataFrame:
    df = view(spark, d).withColumn("flag_stop", (F.col("seq") % 100 < 3).cast("int")).withColumn("flag_wait", (F.col("seq") % 100 < 5).cast("int"))
    return D.tag_events(df).select("trip_id", "seq", "event")


TAGGED = f"""WITH f AS (SELECT trip_id, seq, speed, seq * 0.1e0 AS t, CASE WHEN {BLANK} AND seq % 100 < 3 THEN 'stop' WHEN {BLANK} AND seq % 100 < 5 THEN 'wait' ELSE event END AS event FROM trace),
a AS (SELECT *, round(coalesce({gradient_at('speed', 't')}, 0e0), 9) AS a, max(t) OVER (PARTITION BY trip_id) AS e FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY trip_id, t <= 10 ORDER BY a DESC, seq) AS rh, row_number() OVER (PARTITION BY trip_id, t >= e - 10 ORDER BY a, seq) AS rl FROM a)
SELECT trip_id, seq, CASE WHEN t >= e - 10 AND rl = 1 AND a < -0.5 THEN 'final_deceleration' WHEN t <= 10 AND rh = 1 AND a > 0.5 THEN 'initial_acceleration' ELSE event END AS event FROM r"""


def onsets(spark: SparkSession, d: str) -> DataFrame:
    return D.event_onsets(view(spark, d))


ONSETS = f"SELECT trip_id, seq, event FROM (SELECT *, {lag('event')} AS p FROM trace) z WHERE NOT {BLANK} AND event IS DISTINCT FROM p"


def plateaus(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.speed_plateaus(J.highway_to_road_type(view(spark, d)), default_s=10).drop("run_id"))


PLATEAU_SQL = f"""WITH r AS (SELECT *, speed * 3.6e0 AS kmh, {road_type()} AS road_type FROM trace),
m AS (SELECT *, avg(kmh) OVER w AS m, coalesce(round(stddev_samp(kmh) OVER w, 9) <= 2, false) AS ok FROM r WINDOW w AS (PARTITION BY trip_id, road_type ORDER BY seq ROWS 49 PRECEDING)),
p AS (SELECT *, lag(ok) OVER w AS p, lead(seq) OVER w IS NULL AS last FROM m WINDOW w AS (PARTITION BY trip_id, road_type ORDER BY seq)),
i AS (SELECT *, sum(CASE WHEN ok AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY trip_id, road_type ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM p),
g AS (SELECT trip_id, road_type, run, count(*) AS n_rows, avg(m) AS mean_kmh, bool_or(last) AS o FROM i WHERE ok GROUP BY ALL),
b AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {a}, {z}, {s})" for k, (a, z, s) in PLATEAUS.items())}) v(t, lo, hi, s))
SELECT trip_id, road_type, n_rows, {r6('mean_kmh')} AS mean_kmh FROM g LEFT JOIN b ON road_type = t WHERE NOT o AND n_rows >= coalesce(s, 10) * 10 AND mean_kmh BETWEEN coalesce(lo, 0) AND coalesce(hi, 150)"""


def deliveries(spark: SparkSession, d: str) -> DataFrame:
    return A.delivery_spans(D.delivery_state(view(spark, d))).drop("run_id")


DELIVERIES = f"""WITH s AS (SELECT *, coalesce(last_value(CASE WHEN event IN ('start_delivery', 'end_delivery') THEN event END IGNORE NULLS) OVER {UPTO} = 'start_delivery', false) AS on_ FROM trace)
SELECT trip_id, min(seq) AS start_seq, max(seq) AS end_seq, min(ts_us) AS start_us, max(ts_us) AS end_us FROM {islands('on_', 's')} z WHERE run_id IS NOT NULL GROUP BY trip_id, run_id"""


def detected(spark: SparkSession, d: str) -> DataFrame:
    return D.detect_all(view(spark, d))


def _detected_sql() -> str:
    head = _window_events_sql().removesuffix("SELECT trip_id, seq, detector FROM k WHERE kept").rstrip()
    return f"""{head}, s AS ({HALTS.replace("HAVING count(*) >= 300", "")}),
f AS (SELECT trip_id, bool_or(n_rows >= 1200) AS stop, bool_or(n_rows BETWEEN 300 AND 1199) AS wait FROM s GROUP BY trip_id), e AS ({ENDS})
SELECT e.trip_id, e.initial_seq IS NOT NULL AS initial_acceleration, e.final_seq IS NOT NULL AS final_deceleration, coalesce(f.stop, false) AS stop, coalesce(f.wait, false) AS wait,
  {", ".join(f"EXISTS (SELECT 1 FROM k WHERE k.trip_id = e.trip_id AND detector = '{n}' AND kept) AS {n}" for n in D.DETECTORS)} FROM e LEFT JOIN f ON f.trip_id = e.trip_id"""


def qa_report(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Q.qa_report(view(spark, d)))


QA = f"""WITH t AS (SELECT *, (ts_us - {lag('ts_us')}) / 1e6 AS dt, count(*) OVER (PARTITION BY trip_id) AS n, speed > 0.5 AS mv, speed > 0.5 AND abs(gyro_z) > 0.01 AS tn, speed / greatest(abs(gyro_z), 1e-3) AS r, speed * speed / greatest(abs(acc_y), 1e-3) AS ra FROM trace),
a AS (SELECT trip_id, median(dt) FILTER (dt > 0) AS dtm, min(speed) AS least, median(speed) FILTER (seq < 10) AS st, median(speed) FILTER (n - seq <= 10) AS en, coalesce(median(speed) FILTER (mv), 0e0) AS vm,
  coalesce(stddev_pop(acc_x) FILTER (mv), 0e0) AS ax, coalesce(stddev_pop(gyro_z) FILTER (mv), 0e0) AS gz, coalesce(median(abs(acc_y - speed * gyro_z)) FILTER (tn), 0e0) AS le, coalesce(avg((r > 10 AND r < 3000)::INT) FILTER (tn), 1e0) AS rr, median(r) FILTER (tn) AS rm,
  coalesce(avg((ra > 10 AND ra < 3000)::INT) FILTER (tn), 1e0) AS ar, median(ra) FILTER (tn) AS am, bool_or(tn) AS turns FROM t GROUP BY trip_id),
c AS (SELECT *, coalesce(abs(dtm - 0.1) < 0.02, false) AS cadence_ok, least >= -1e-6 AS speed_nonnegative, st < 0.6 AS start_zero, en < 0.6 AS end_zero, ax > 0.02 AS ax_variability, gz > 0.002 AS gz_variability, NOT turns OR le < 0.5 AS lateral_consistency, NOT turns OR rr > 0.7 AS turn_radius_plausible FROM a),
f AS (SELECT *, concat_ws(', ', {", ".join(f"CASE WHEN NOT {c} THEN '{c}' END" for c in Q.CHECKS)}) AS failed FROM c)
SELECT trip_id, {r6('dtm')} AS dt_median_s, {r6('vm')} AS v_median_mps, {r6('ax')} AS std_ax, {r6('gz')} AS std_gz, {r6('le')} AS lat_err_med, {r6('rr')} AS radius_gz_ratio, {r6('rm')} AS radius_gz_med, {r6('ar')} AS radius_ay_ratio, {r6('am')} AS radius_ay_med,
  {", ".join(Q.CHECKS)}, {r6('1 / dtm')} AS hz_obs, failed, failed = '' AS ok, CASE WHEN failed = '' THEN 'OK' ELSE 'KO: ' || failed END AS summary FROM f"""


def coherence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Q.coherence(view(spark, d)))


COHERENCE = f"""WITH s AS ({DT}), g AS (SELECT *, step_m / dt_s AS geo FROM s),
m AS (SELECT trip_id, median(raw) FILTER (raw > 0) AS med, median(abs(speed / 3.6e0 - geo)) AS k, median(abs(speed - geo)) AS p FROM g GROUP BY trip_id),
v AS (SELECT g.*, med, k, p, CASE WHEN p < k THEN speed ELSE speed / 3.6e0 END AS v FROM g JOIN m ON g.trip_id = m.trip_id),
a AS (SELECT trip_id, 1 / any_value(med) AS hz_obs, sum(step_m) AS dist_geo_m, sum(v * dt_s) AS dist_speed_m, median(abs(v - geo)) AS dv_median, avg((abs(v - geo) > 2)::INT) AS frac_bad, CASE WHEN any_value(p) < any_value(k) THEN 'mps' ELSE 'kmh' END AS speed_unit FROM v GROUP BY trip_id),
b AS (SELECT *, abs(dist_speed_m - dist_geo_m) / greatest(dist_geo_m, 1e-6) AS e FROM a)
SELECT trip_id, {r6('hz_obs')} AS hz_obs, {r6('dist_geo_m')} AS dist_geo_m, {r6('dist_speed_m')} AS dist_speed_m, {r6('dv_median')} AS dv_median, {r6('frac_bad')} AS frac_bad, speed_unit, {r6('e')} AS dist_rel_err,
  abs(hz_obs - 10) <= 0.1 AS hz_ok, e <= 0.03 AS dist_ok, dv_median <= 2 AND frac_bad <= 0.01 AS speed_ok, abs(hz_obs - 10) <= 0.1 AND e <= 0.03 AND dv_median <= 2 AND frac_bad <= 0.01 AS coherent FROM b"""


def realism(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Q.realism_report(view(spark, d)))


POINTS = ("freinage", "acceleration", "trottoir", "nid_de_poule", "dos_dane")
REALISM = f"""WITH q AS (SELECT *, {STEP} AS step_q, (ts_us - {lag('ts_us')}) / 1e6 AS dt, abs(speed * 3.6e0 - {lag('speed')} * 3.6e0) AS dv, speed > 0.2 AND coalesce(event NOT IN ('freinage', 'acceleration', 'trottoir', 'nid_de_poule', 'dos_dane', 'ouverture_porte'), true) AS mv FROM trace),
x AS (SELECT trip_id, abs(median(dt) - 0.1) < 0.01 AS frequency_ok, arg_min(speed, seq) * 3.6 <= 1 AS starts_at_zero, arg_max(speed, seq) * 3.6 <= 1 AS ends_at_zero, max(dv) <= 20 AS smooth, max(step_q) <= 50 AS no_jumps, stddev_samp(speed * 3.6) > 0.5 AS speed_varies,
  {", ".join(f"count(*) FILTER (mv) >= 10 AND coalesce(stddev_samp(acc_{a}) FILTER (mv) > 0.05 AND stddev_samp(acc_{a}) FILTER (mv) < 4.0, false) AS acc_{a}_varies" for a in "xyz")},
  {", ".join(f"count(*) FILTER (mv) >= 10 AND coalesce(stddev_samp(gyro_{a}) FILTER (mv) BETWEEN 0.01 AND 60, false) AS gyro_{a}_varies" for a in "xyz")},
  coalesce(bool_or(event IN ('stop', 'stop_start')), false) AS has_stop, coalesce(bool_or(event IN ('wait', 'wait_start')), false) AS has_wait, {", ".join(f"count(*) FILTER (event = '{e}') AS n_{e}" for e in POINTS)}, {r6('max(speed) * 3.6e0')} AS max_kmh, bool_and(speed = 0) AS all_zero, count(*) FILTER (speed IS NULL) AS null_speeds, count(event) AS labels FROM q GROUP BY trip_id),
y AS (SELECT trip_id, start_seq - lag(end_seq) OVER (PARTITION BY trip_id ORDER BY start_seq) AS gap FROM (SELECT trip_id, min(seq) AS start_seq, max(seq) AS end_seq FROM {islands("event = 'stop'")} i WHERE run_id IS NOT NULL GROUP BY trip_id, run_id) j),
z AS (SELECT trip_id, count(*) AS n_stops, min(gap) AS gap FROM y GROUP BY trip_id),
{COHERENCE[len("WITH ") :].split("SELECT trip_id, round(CAST(hz_obs")[0].rstrip()},
o AS (SELECT trip_id, abs(hz_obs - 10) <= 0.1 AND e <= 0.03 AND dv_median <= 2 AND frac_bad <= 0.01 AS coherent FROM b)
SELECT x.* EXCLUDE (labels), coalesce(n_stops, 0) AS n_stops, CASE WHEN coalesce(n_stops, 0) = 0 THEN labels <= 10 ELSE coalesce(gap > 800, true) OR n_stops <= 6 END AS stop_spacing_ok, coherent FROM x LEFT JOIN z ON x.trip_id = z.trip_id JOIN o ON x.trip_id = o.trip_id"""


def basics(spark: SparkSession, d: str) -> DataFrame:
    rough = view(spark, d, "rough")
    dup = Q.duplicate_keys(rough).groupBy("trip_id").agg(F.count("*").alias("n_duplicate_keys"))
    return Q.basic_checks(rough).join(Q.speed_vs_roadtype(J.highway_to_road_type(view(spark, d))), "trip_id").join(dup, "trip_id", "left").na.fill(0, ["n_duplicate_keys"])


BASICS = f"""WITH q AS (SELECT *, ts_us - {lag('ts_us')} AS d FROM rough), r AS (SELECT *, {road_type()} AS road_type FROM trace),
a AS (SELECT trip_id, count(*) FILTER (d < 0) AS n_falling, count(*) FILTER (d = 0) AS n_equal, CAST(sum({" + ".join(f"({c} IS NULL)::INT" for c in ("ts_us", "lat", "lon", "speed", "acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z"))}) AS BIGINT) AS n_nulls FROM q GROUP BY trip_id),
m AS (SELECT trip_id, road_type, avg(speed * 3.6e0) AS v, list_position(['motorway', 'primary', 'secondary', 'tertiary', 'residential', 'service'], road_type) AS k FROM r GROUP BY ALL),
l AS (SELECT trip_id, v, lag(v) OVER (PARTITION BY trip_id ORDER BY k) AS p FROM m WHERE k > 0),
o AS (SELECT trip_id, NOT coalesce(bool_or(p + 15 < v AND NOT (p < 25 AND v > 45)), false) AS ordered FROM l GROUP BY trip_id),
u AS (SELECT trip_id, count(*) AS n FROM (SELECT trip_id FROM rough GROUP BY trip_id, round_even(ts_us / 1e6, 1), round_even(lat, 6), round_even(lon, 6) HAVING count(*) > 1) z GROUP BY trip_id)
SELECT a.trip_id, n_falling, n_equal, n_nulls, ordered, coalesce(u.n, 0) AS n_duplicate_keys FROM a JOIN o ON a.trip_id = o.trip_id LEFT JOIN u ON a.trip_id = u.trip_id"""


VALID = {"event": {"nullable": True, "values": ["stop", "wait", "freinage"]}, "osm_highway": {"nullable": False}, "speed": {"nullable": False, "type": "int"}, "lat": {"nullable": False}, "altitude": {"nullable": False}}


def validated(spark: SparkSession, d: str) -> DataFrame:
    rough = view(spark, d, "rough")
    found = Q.validate_dataset(rough, VALID, strict_order=True, nulls=True)
    strict = Q.validate_dataset(rough.select("event", "osm_highway", "speed", "lat"), {c: VALID[c] for c in ("osm_highway", "event", "speed", "lat")}, strict_order=True, keys=("event",)).where("rule = 'order'")
    rows = F.array_join(F.transform("offenders", lambda k: F.concat_ws(":", k.trip_id, k.seq)), ",").alias("offenders")
    return found.select("column", "rule", "n_bad", rows).unionByName(strict.select("column", "rule", "n_bad", F.lit("").alias("offenders")))


def _validated_sql() -> str:
    listed = lambda c, r, bad: f"SELECT '{c}' AS \"column\", '{r}' AS rule, count(*) AS n_bad, coalesce(string_agg(trip_id || ':' || seq, ',' ORDER BY trip_id, seq) FILTER (i <= 5), '') AS offenders FROM (SELECT trip_id, seq, row_number() OVER (ORDER BY trip_id, seq) AS i FROM rough WHERE {bad}) z"
    columns = ("trip_id", "seq", "ts_us", "lat", "lon", "speed", "acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z", "event", "osm_highway")
    parts = [listed("event", "value", "event NOT IN ('stop', 'wait', 'freinage')"), listed("osm_highway", "null", "osm_highway IS NULL"), listed("speed", "null", "speed IS NULL"), listed("speed", "type", "speed IS NOT NULL AND NOT isfinite(speed)"), listed("lat", "null", "lat IS NULL"), listed("altitude", "missing", "true")]
    parts += [f"SELECT '{c}', 'extra', 0, ''" for c in columns if c not in VALID] + ["SELECT '*', 'order', 1, ''"]
    return " UNION ALL ".join(parts + [f"SELECT '{c}', 'count', count(*) FILTER ({c} IS NULL), '' FROM rough" for c in columns])


VALIDATED = _validated_sql()


def imu_coherence(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Q.imu_coherence(view(spark, d)))


IMU = f"""WITH t AS (SELECT trip_id, abs(acc_y - speed * gyro_z) AS r, CASE WHEN abs(gyro_z) > 0 THEN speed / abs(gyro_z) END AS radius FROM trace WHERE speed > 0.5)
SELECT trip_id, {r6('sqrt(avg(r * r))')} AS rmse, {r6('quantile_cont(r, 0.95)')} AS p95, {r6('avg((r > 0.2)::INT)')} AS bad_ratio, {", ".join(r6(f"quantile_cont(radius, {q})") + f" AS radius_{n}" for q, n in ((0.1, "p10"), (0.5, "p50"), (0.9, "p90")))} FROM t GROUP BY trip_id"""


def metrics(spark: SparkSession, d: str) -> DataFrame:
    df = J.highway_to_road_type(view(spark, d))
    return rounded(A.trip_metrics(df).join(A.point_event_counts(df), "trip_id").join(A.road_types_seen(df), "trip_id"))


METRICS = f"""WITH s AS (SELECT *, {ELLIPSOID} AS long FROM ({DT}) y), t AS (SELECT *, {road_type()} AS road_type FROM s)
SELECT trip_id, {r6('(max(ts_us) - min(ts_us)) / 1e6')} AS duration_s, {r6('sum(long)')} AS distance_m, {r6('avg(step_m / dt_s * 3.6e0)')} AS gps_kmh, {r6('avg(speed) * 3.6e0')} AS declared_kmh,
  {", ".join(f"count(*) FILTER (event = '{e}') AS n_{e}" for e in POINTS)}, array_to_string(list_sort(list(DISTINCT road_type)), ',') AS road_types FROM t GROUP BY trip_id"""


def event_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.event_counts(view(spark, d))


def heatmap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.acc_heatmap(view(spark, d)))


HEATMAP = f"""WITH s AS (SELECT *, {STEP} AS step_m, acc_x / 9.80665e0 AS gx, acc_y / 9.80665e0 AS gy FROM trace)
SELECT least(CAST(floor((gx + 1) / 0.02e0) AS INT), 99) AS bx, least(CAST(floor((gy + 1) / 0.02e0) AS INT), 99) AS "by", count(*) AS n, {r6('sum(step_m)')} AS metres FROM s WHERE abs(gx) <= 1 AND abs(gy) <= 1 GROUP BY 1, 2"""


def described(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.speed_describe(J.highway_to_road_type(view(spark, d)), "road_type"))


DESCRIBED = f"""SELECT {road_type()} AS road_type, count(speed) AS n, {r6('avg(speed)')} AS mean, {r6('stddev_samp(speed)')} AS std, {r6('min(speed)')} AS min, {r6('quantile_cont(speed, 0.25)')} AS q25, {r6('median(speed)')} AS q50, {r6('quantile_cont(speed, 0.75)')} AS q75, {r6('max(speed)')} AS max FROM trace GROUP BY 1"""


def imu_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.imu_stats(view(spark, d)))


IMU_STATS = " UNION ALL ".join(f"SELECT trip_id, '{a}' AS axis, {r6(f'avg({a})')} AS mean, {r6(f'stddev_samp({a})')} AS std, {r6(f'min({a})')} AS min, {r6(f'max({a})')} AS max FROM trace GROUP BY trip_id" for a in ("acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z"))


def portions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.portion_speeds(J.highway_to_road_type(view(spark, d))))


PORTIONS = f"""SELECT trip_id, CAST(((seq + 1) * 10 - 1) // n AS INT) AS portion, road_type, {r6('avg(speed)')} AS mean_speed, count(*) AS n FROM (SELECT trip_id, seq, speed, {road_type()} AS road_type, count(*) OVER (PARTITION BY trip_id) AS n FROM trace) z GROUP BY 1, 2, 3"""


def windows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.event_windows(view(spark, d), "stop").drop("run_id"))


WINDOWS = f"""WITH e AS (SELECT trip_id, run_id, max(seq) AS e FROM {islands("event = 'stop'")} z WHERE run_id <= 5 GROUP BY trip_id, run_id),
w AS (SELECT trip_id, e, CAST(unnest(range(e - 20, e + 21)) AS INT) AS seq FROM e)
SELECT t.trip_id, t.seq - e AS "offset", t.seq, {r6('speed')} AS speed FROM w JOIN trace t ON t.trip_id = w.trip_id AND t.seq = w.seq"""


def markers(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.map_markers(view(spark, d)))


MARKERS = f"""WITH p AS (SELECT trip_id, event, {r6('round_even(lat, 5)')} AS lat5, {r6('round_even(lon, 5)')} AS lon5, min(seq) AS seq FROM trace WHERE NOT {BLANK} GROUP BY 1, 2, 3, 4),
i AS (SELECT *, count(*) OVER (PARTITION BY trip_id, event) // 30 AS k, row_number() OVER (PARTITION BY trip_id, event ORDER BY seq) - 1 AS i FROM p)
SELECT trip_id, event, lat5, lon5, seq FROM i WHERE i % greatest(1, k) = 0 AND i // greatest(1, k) < 30"""


def spikes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.top_spikes(view(spark, d)))


SPIKES = f"""WITH s AS ({DT}), r AS (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY round(step_m, 6) DESC, seq) AS rank FROM s)
SELECT trip_id, CAST(rank AS INT) AS rank, seq, {r6('step_m')} AS step_m, {r6('least(180 / 3.6e0 * dt_s + 30, 500)')} AS max_step_m, {r6('dt_s')} AS dt_s FROM r WHERE rank <= 5"""


def anchored(spark: SparkSession, d: str) -> DataFrame:
    df = view(spark, d)
    c = df.where("abs(acc_x) > 1.4 OR abs(acc_z) > 7").withColumn("event_type", F.when(F.abs("acc_z") > 7, "speed_bump").when(F.col("acc_x") < 0, "brake").otherwise("accel"))
    return R.anchor_events(c).select("trip_id", "event_type", "seq")


ANCHORED = f"""WITH RECURSIVE c AS (SELECT trip_id, CASE WHEN abs(acc_z) > 7 THEN 'speed_bump' WHEN acc_x < 0 THEN 'brake' ELSE 'accel' END AS event_type, seq, round(ts_us / 1e6, 1) AS t, round(lat, 6) AS lat, round(lon, 6) AS lon FROM trace WHERE abs(acc_x) > 1.4 OR abs(acc_z) > 7),
h AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY trip_id, event_type ORDER BY seq) AS i, CASE event_type {" ".join(f"WHEN '{k}' THEN {a}e0" for k, (a, _) in EVENT_RULES.items())} END AS cool, CASE event_type {" ".join(f"WHEN '{k}' THEN {b}e0" for k, (_, b) in EVENT_RULES.items())} END AS gap FROM c),
n AS (SELECT trip_id, event_type, seq, i, true AS kept, t, lat, lon FROM h WHERE i = 1 UNION ALL
      SELECT trip_id, event_type, seq, i, ok, CASE WHEN ok THEN t ELSE lt END, CASE WHEN ok THEN lat ELSE la END, CASE WHEN ok THEN lon ELSE lo END FROM (
        SELECT h.*, n.t AS lt, n.lat AS la, n.lon AS lo, abs(h.t - n.t) >= cool AND {metres('h.lat', 'h.lon', 'n.lat', 'n.lon')} >= gap AS ok FROM n JOIN h ON h.trip_id = n.trip_id AND h.event_type = n.event_type AND h.i = n.i + 1) z)
SELECT trip_id, event_type, seq FROM n WHERE kept"""


def tracks(spark: SparkSession, d: str) -> DataFrame:
    t = A.map_track(view(spark, d), most=300)
    return rounded(t.select("trip_id", F.size("pts").alias("n_pts"), F.coalesce(F.size("events"), F.lit(0)).alias("n_events"), F.element_at("pts", -1).getField("lat").alias("last_lat")))


TRACKS = f"""WITH n AS (SELECT *, count(*) OVER (PARTITION BY trip_id) AS n FROM trace), k AS (SELECT trip_id, count(*) AS n_pts, arg_max(lat, seq) AS last_lat FROM n WHERE seq % greatest(10, CAST(ceil(n / 300e0) AS INT)) = 0 GROUP BY trip_id),
e AS (SELECT trip_id, count(DISTINCT run_id) AS n FROM {islands("event IN ('stop', 'wait')")} z WHERE run_id IS NOT NULL GROUP BY trip_id)
SELECT k.trip_id, CAST(n_pts AS INT) AS n_pts, CAST(coalesce(e.n, 0) AS INT) AS n_events, {r6('last_lat')} AS last_lat FROM k LEFT JOIN e ON k.trip_id = e.trip_id"""

def bands(spark: SparkSession, d: str) -> DataFrame:
    df = J.event_categories(view(spark, d), {"stop": "still", "wait": "still", "freinage": "act", "acceleration": "act"})
    return A.category_bands(df)


BANDS = " UNION ALL ".join(f"SELECT trip_id, '{c}' AS category, min(seq) AS start_seq, max(seq) AS end_seq FROM {islands(f'event IN {labels}')} z WHERE run_id IS NOT NULL GROUP BY trip_id, run_id" for c, labels in (("still", ("stop", "wait")), ("act", ("freinage", "acceleration"))))


def distribution(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.speed_distribution(C.normalize_road_type(J.highway_to_road_type(view(spark, d)))))


DISTRIBUTION = f"SELECT road_type, {r6('k / 10e0')} AS quantile, {r6('q[k + 1]')} AS speed FROM (SELECT *, unnest(range(0, 11)) AS k FROM (SELECT {road_type()} AS road_type, quantile_cont(speed, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM trace GROUP BY 1) y) z"


def stats(spark: SparkSession, d: str) -> DataFrame:
    df = view(spark, d)
    phases = A.stop_wait_phases(df).groupBy("trip_id").agg(F.sum("is_stop").alias("n_stop"), F.sum("is_wait").alias("n_wait"))
    left = C.exclude_events(df, ("stop", "wait")).groupBy("trip_id").agg(F.count("*").alias("n_left"))
    return rounded(A.speed_stats(df).join(phases, "trip_id").join(left, "trip_id"))


STATS = f"SELECT trip_id, {r6('min(speed)')} AS min, {r6('max(speed)')} AS max, {r6('avg(speed)')} AS mean, count(*) FILTER (event LIKE '%stop%') AS n_stop, count(*) FILTER (event LIKE '%wait%') AS n_wait, count(*) FILTER (event IS NULL OR event NOT IN ('stop', 'wait')) AS n_left FROM trace GROUP BY trip_id"


def lateral(spark: SparkSession, d: str) -> DataFrame:
    return rounded(D.lateral_segments(K.curvature_gradient(K.heading(view(spark, d)))))


LATERAL = f"""WITH g AS (SELECT *, {gradient('radians(h)')} AS g FROM (SELECT *, {HEADING} AS h FROM trace) z), c AS (SELECT *, {gradient('g')} AS c FROM g)
SELECT trip_id, seq, {r6('c')} AS curvature, CASE WHEN c > 0 THEN 'right' ELSE 'left' END AS side FROM c WHERE abs(c) > 0.005"""

def charts(spark: SparkSession, d: str) -> DataFrame:
    c = A.chart_series(view(spark, d), most=300)
    return rounded(c.select("trip_id", F.size("t").alias("n"), F.element_at("t", -1).alias("last_t"), F.array_max("speed").alias("max_kmh"), F.aggregate("acc_x", F.lit(0.0), lambda a, x: a + x).alias("sum_acc_x")))


CHARTS = f"""WITH n AS (SELECT *, count(*) OVER (PARTITION BY trip_id) AS n FROM trace)
SELECT trip_id, CAST(count(*) AS INT) AS n, {r6('max(seq) / 10e0')} AS last_t, {r6('max(speed) * 3.6e0')} AS max_kmh, {r6('sum(acc_x / 9.80665e0)')} AS sum_acc_x FROM n WHERE seq % greatest(10, CAST(ceil(n / 300e0) AS INT)) = 0 GROUP BY trip_id"""


def plateau_order(spark: SparkSession, d: str) -> DataFrame:
    return Q.plateaus_vs_roadtype(D.speed_plateaus(J.highway_to_road_type(view(spark, d))))


PLATEAU_ORDER = f"""WITH p AS ({PLATEAU_SQL}), m AS (SELECT trip_id, road_type, median(mean_kmh) AS v, list_position(['motorway', 'primary', 'secondary', 'tertiary', 'residential'], road_type) AS k FROM p GROUP BY ALL),
l AS (SELECT trip_id, v, lag(v) OVER (PARTITION BY trip_id ORDER BY k) AS p FROM m WHERE k > 0)
SELECT trip_id, NOT coalesce(bool_or(p + 15 < v AND NOT (p < 25 AND v > 45)), false) AS ordered FROM l GROUP BY trip_id"""

QUERIES = {
    "a_charts": charts, "q_plateau_order": plateau_order,
    "a_bands": bands, "a_distribution": distribution, "a_stats": stats, "d_lateral": lateral,
    "a1_trip_summary": a1_trip_summary, "d_window_events": window_events, "d_halts": halts, "d_ends": ends, "d_anomalies": anomalies, "d_tagged": tagged, "d_onsets": onsets, "d_plateaus": plateaus, "d_deliveries": deliveries, "d_detected": detected, "d_anchored": anchored,
    "q_report": qa_report, "q_coherence": coherence, "q_realism": realism, "q_basics": basics, "q_validated": validated, "q_imu_coherence": imu_coherence,
    "a_metrics": metrics, "a_event_counts": event_counts, "a_heatmap": heatmap, "a_described": described, "a_imu_stats": imu_stats, "a_portions": portions, "a_windows": windows, "a_markers": markers, "a_spikes": spikes, "a_tracks": tracks,
}
ORACLES = {k: with_views(v, "rough" if k in ("q_basics", "q_validated") else "trace") for k, v in {
    "a_charts": CHARTS, "q_plateau_order": PLATEAU_ORDER,
    "a_bands": BANDS, "a_distribution": DISTRIBUTION, "a_stats": STATS, "d_lateral": LATERAL,
    "a1_trip_summary": SUMMARY, "d_window_events": _window_events_sql(), "d_halts": HALTS, "d_ends": ENDS, "d_anomalies": ANOMALIES, "d_tagged": TAGGED, "d_onsets": ONSETS, "d_plateaus": PLATEAU_SQL, "d_deliveries": DELIVERIES, "d_detected": _detected_sql(), "d_anchored": ANCHORED,
    "q_report": QA, "q_coherence": COHERENCE, "q_realism": REALISM, "q_basics": BASICS, "q_validated": VALIDATED, "q_imu_coherence": IMU,
    "a_metrics": METRICS, "a_event_counts": f"SELECT event, count(*) AS n FROM trace WHERE NOT {BLANK} GROUP BY event", "a_heatmap": HEATMAP, "a_described": DESCRIBED, "a_imu_stats": IMU_STATS, "a_portions": PORTIONS, "a_windows": WINDOWS, "a_markers": MARKERS, "a_spikes": SPIKES, "a_tracks": TRACKS,
}.items()}
