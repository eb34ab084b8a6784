"""Queries on motion features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmill.functions.rounding import with_rounded
from tripmill.functions.windows import bfill, ffill, unwrap
from tripmill.operators import kinematics as K
from tripmill.operators import quality as Q
from tripmill.operators import recurrences as R
from tripmill.operators import report as A
from tripmill.plans.fixtures import view, with_views
from tripmill.plans.sqltext import AFTER, HEADING, STEP, TIE, UPTO, bearing, clip, frame, gradient, gradient_at, lag, lead, r6


def rounded(df: DataFrame) -> DataFrame:
    """Floating outputs to 6 decimals, without negative zeros. Means of whole cents can lie on a tie of the sixth decimal, where the order of a
    sum would decide: so ties are moved up by a little more than sums can be off."""
    return with_rounded(df, {c: F.col(c) + TIE for c, t in df.dtypes if t == "double"}, 6)


def motion(spark: SparkSession, d: str) -> DataFrame:
    df = K.gps_speed(K.dt_s(K.cumulative_distance(K.step_m_ellipsoid(K.step_m(view(spark, d))))))
    return rounded(df.select("trip_id", "seq", "step_m", "step_ellipsoid_m", "distance_m", "dt_s", "gps_speed_mps", "gps_speed_kmh"))


E2 = "0.0066943799901413165e0"
MID = f"radians((lat + {lag('lat')}) / 2)"
ELL_W = f"(1 - {E2} * sin({MID}) ** 2)"
ELLIPSOID = f"coalesce(sqrt((6378137e0 * (1 - {E2}) / {ELL_W} ** 1.5e0 * radians(lat - {lag('lat')})) ** 2 + (6378137e0 / sqrt({ELL_W}) * cos({MID}) * radians(lon - {lag('lon')})) ** 2), 0e0)"
DT = f"SELECT *, CASE WHEN raw > 0 THEN raw ELSE coalesce(median(CASE WHEN raw > 0 THEN raw END) OVER (PARTITION BY trip_id), 0.1e0) END AS dt_s FROM (SELECT *, (ts_us - {lag('ts_us')}) / 1e6 AS raw, {STEP} AS step_m FROM trace) q"
MOTION = f"""WITH s AS ({DT})
SELECT trip_id, seq, {r6('step_m')} AS step_m, {r6(ELLIPSOID)} AS step_ellipsoid_m, {r6(f'sum(step_m) OVER {UPTO}')} AS distance_m, {r6('dt_s')} AS dt_s, {r6('step_m / dt_s')} AS gps_speed_mps, {r6('step_m / dt_s * 3.6e0')} AS gps_speed_kmh FROM s"""


def headings(spark: SparkSession, d: str) -> DataFrame:
    df = K.turn_angle(K.angular_velocity(K.sinuosity_delta(K.sinuosity_range(K.curvature_diff2(K.curvature_gradient(K.heading(view(spark, d))))))))
    df = unwrap(A.curvature_smooth(df).withColumn("_r", F.radians("heading")), "_r", "unwrapped")
    return rounded(df.select("trip_id", "seq", "heading", "curvature", "curvature_diff2", "sinuosity", "sinuosity_delta", "yaw_deg_s", "turn_deg", "curvature_smooth", "unwrapped"))


PI = "3.141592653589793e0"
TURN = f"abs({bearing('lat', 'lon', lead('lat'), lead('lon'))} - {bearing(lag('lat'), lag('lon'), 'lat', 'lon')})"
HEADINGS = f"""WITH h AS (SELECT *, {HEADING} AS heading, {TURN} AS turn FROM trace),
g AS (SELECT *, radians(heading) AS r, {gradient('radians(heading)')} AS g1 FROM h),
k AS (SELECT *, {gradient('g1')} AS curvature, r - {lag('r')} AS step FROM g),
u AS (SELECT *, CASE WHEN step IS NULL OR abs(step) < {PI} THEN 0e0 ELSE (CASE WHEN w = -{PI} AND step > 0 THEN {PI} ELSE w END) - step END AS fix
      FROM (SELECT *, ((step + {PI}) - 2 * {PI} * floor((step + {PI}) / (2 * {PI}))) - {PI} AS w FROM k) z)
SELECT trip_id, seq, {r6('heading')} AS heading, {r6('curvature')} AS curvature, {r6(f'coalesce(r - 2 * {lag("r")} + {lag("r", 2)}, 0e0)')} AS curvature_diff2,
  CASE WHEN count(r) OVER {frame(5, 5)} = 11 THEN {r6(f'max(r) OVER {frame(5, 5)} - min(r) OVER {frame(5, 5)}')} END AS sinuosity,
  {r6(f'abs(last_value(heading) OVER {frame(5, 4)} - first_value(heading) OVER {frame(5, 4)})')} AS sinuosity_delta,
  {r6(clip(f'({gradient("heading")}) * 10', '-180e0', '180e0'))} AS yaw_deg_s, {r6('least(turn, 360 - turn)')} AS turn_deg,
  {r6(f'avg(curvature) OVER {frame(5, 4)}')} AS curvature_smooth, {r6(f'r + sum(fix) OVER {UPTO}')} AS unwrapped FROM u"""


def inertial(spark: SparkSession, d: str) -> DataFrame:
    df = K.inertial_planar(K.inertial_from_speed_heading(K.linear_acceleration(K.heading(view(spark, d)))))
    return rounded(df.select("trip_id", "seq", "acc_lin", "acc_x_est", "acc_y_est", "acc_x_planar", "acc_y_planar"))


INERTIAL = f"""WITH h AS (SELECT *, {HEADING} AS heading FROM trace),
g AS (SELECT *, {gradient('speed', '0.1e0')} AS dv, {gradient('heading', '0.1e0')} AS dpsi, {gradient('radians(heading)', '0.1e0')} AS drad, ({gradient('speed')}) * 10 AS lin FROM h)
SELECT trip_id, seq, {r6(clip('lin', '-20e0', '20e0'))} AS acc_lin, {r6('dv')} AS acc_x_est, {r6('speed * drad')} AS acc_y_est,
  {r6('dv * cos(heading) - speed * sin(heading) * dpsi')} AS acc_x_planar, {r6('dv * sin(heading) + speed * cos(heading) * dpsi')} AS acc_y_planar FROM g"""


def rolling(spark: SparkSession, d: str) -> DataFrame:
    df = K.declared_speed(K.rolling_std(K.rolling_median(K.rolling_mean(view(spark, d), "speed", 9), "acc_x", 3), "gyro_z", 10))
    df = K.rolling_mean_time(df, "acc_y", 1.2, "acc_y_time_mean")
    return rounded(df.select("trip_id", "seq", "speed_mean", "acc_x_median", "gyro_z_roll_mean", "gyro_z_roll_std", "declared_speed", "acc_y_time_mean"))


ROLLING = f"""SELECT trip_id, seq, {r6(f'avg(speed) OVER {frame(4, 4)}')} AS speed_mean, {r6(f'median(acc_x) OVER {frame(1, 1)}')} AS acc_x_median,
  {r6(f'avg(gyro_z) OVER {frame(9, 0)}')} AS gyro_z_roll_mean, {r6(f'stddev_samp(gyro_z) OVER {frame(9, 0)}')} AS gyro_z_roll_std, {r6(f'greatest(avg(speed) OVER {frame(15, 15)}, 0e0)')} AS declared_speed,
  {r6('avg(acc_y) OVER (PARTITION BY trip_id ORDER BY ts_us RANGE BETWEEN 599999 PRECEDING AND 600000 FOLLOWING)')} AS acc_y_time_mean FROM trace"""


def filled(spark: SparkSession, d: str) -> DataFrame:
    df = view(spark, d)
    return df.select("trip_id", "seq", ffill("event").alias("before"), bfill("event").alias("after"), F.coalesce(ffill("osm_highway"), bfill("osm_highway")).alias("highway"))


FILLED = f"""SELECT trip_id, seq, last_value(event IGNORE NULLS) OVER {UPTO} AS before, first_value(event IGNORE NULLS) OVER {AFTER} AS after,
  coalesce(last_value(osm_highway IGNORE NULLS) OVER {UPTO}, first_value(osm_highway IGNORE NULLS) OVER {AFTER}) AS highway FROM trace"""


def ema(spark: SparkSession, d: str) -> DataFrame:
    return rounded(R.ema(view(spark, d)).select("trip_id", "seq", "speed_ema"))


EMA = f"""WITH RECURSIVE t AS MATERIALIZED (SELECT trip_id, seq, speed FROM trace),
e AS (SELECT trip_id, seq, speed AS s FROM t WHERE seq = 0 UNION ALL SELECT t.trip_id, t.seq, 0.7e0 * e.s + 0.3e0 * t.speed FROM e JOIN t ON t.trip_id = e.trip_id AND t.seq = e.seq + 1)
SELECT trip_id, seq, {r6('least(greatest(s, 0e0), 150e0)')} AS speed_ema FROM e"""


def expected_imu(spark: SparkSession, d: str) -> DataFrame:
    return rounded(K.expected_imu(view(spark, d)).select("trip_id", "seq", "exp_acc_x", "exp_acc_y", "exp_acc_z", "exp_gyro_y", "exp_gyro_z"))


EXPECTED_ROWS = f"""WITH b AS (SELECT *, seq * 0.1e0 AS t, coalesce(radians({bearing(lag('lat'), lag('lon'), 'lat', 'lon')}), 0e0) AS r FROM trace),
k AS (SELECT *, r - {lag('r')} AS step FROM b),
u AS (SELECT *, CASE WHEN step IS NULL OR abs(step) < {PI} THEN 0e0 ELSE (CASE WHEN w = -{PI} AND step > 0 THEN {PI} ELSE w END) - step END AS fix
      FROM (SELECT *, ((step + {PI}) - 2 * {PI} * floor((step + {PI}) / (2 * {PI}))) - {PI} AS w FROM k) z),
p AS (SELECT *, r + sum(fix) OVER {UPTO} AS psi0 FROM u),
m AS (SELECT *, avg(psi0) OVER {frame(2, 2)} AS psi, avg(speed) OVER {frame(2, 2)} AS v FROM p),
g AS (SELECT *, CASE WHEN speed > 0.5 THEN {gradient_at('psi', 't')} ELSE 0e0 END AS yaw, greatest(v, 0e0) / 5 AS lim, {gradient_at('v', 't')} AS a FROM m),
f AS (SELECT *, CASE WHEN yaw > lim THEN lim WHEN yaw < -lim THEN -lim ELSE yaw END AS gz FROM g)"""
EXPECTED = EXPECTED_ROWS + f"""
SELECT trip_id, seq, {r6(clip('a', '-6e0', '6e0'))} AS exp_acc_x, {r6('CASE WHEN speed > 0.5 THEN v * gz ELSE 0e0 END')} AS exp_acc_y, {r6('9.80665e0')} AS exp_acc_z, {r6('0e0')} AS exp_gyro_y, {r6('gz')} AS exp_gyro_z FROM f"""


def imu_errors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(Q.imu_errors(view(spark, d)))


IMU_ERRORS = EXPECTED_ROWS + f""", e AS (SELECT trip_id, 'acc_x' AS signal, acc_x - {clip('a', '-6e0', '6e0')} AS d FROM f UNION ALL SELECT trip_id, 'acc_y', acc_y - CASE WHEN speed > 0.5 THEN v * gz ELSE 0e0 END FROM f UNION ALL SELECT trip_id, 'gyro_z', gyro_z - gz FROM f)
SELECT trip_id, signal, count(*) AS n, {r6('avg(d)')} AS bias, {r6('sqrt(avg(d * d))')} AS rmse FROM e GROUP BY trip_id, signal"""

QUERIES = {"k_motion": motion, "k_headings": headings, "k_inertial": inertial, "k_rolling": rolling, "k_filled": filled, "k_ema": ema, "k_expected_imu": expected_imu, "k_imu_errors": imu_errors}
ORACLES = {k: with_views(v, "trace") for k, v in {"k_motion": MOTION, "k_headings": HEADINGS, "k_inertial": INERTIAL, "k_rolling": ROLLING, "k_filled": FILLED, "k_ema": EMA, "k_expected_imu": EXPECTED, "k_imu_errors": IMU_ERRORS}.items()}
