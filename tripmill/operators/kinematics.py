"""Motion features of traces (trip_id, seq, ts_us, lat, lon, speed in m/s, ...): native windows, one shuffle by trip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmill.functions import geo
from tripmill.functions.windows import bfill, centred, ffill, gradient, lag, lead, ordered, so_far, trip, unwrap

G = 9.80665


def clip(c: Column, low, high) -> Column:
    """Bounds that leave null as null."""
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def step_m(df: DataFrame, out: str = "step_m") -> DataFrame:
    """Great-circle metres from the sample before; 0 for the first."""
    return df.withColumn(out, F.coalesce(geo.haversine(lag("lat"), lag("lon"), F.col("lat"), F.col("lon")), F.lit(0.0)))


def step_m_ellipsoid(df: DataFrame, out: str = "step_ellipsoid_m") -> DataFrame:
    """Geodesic metres on WGS84 from the sample before; 0 for the first."""
    df = df.withColumns({"_lat0": lag("lat"), "_lon0": lag("lon")})
    return df.withColumn(out, F.coalesce(geo.geodesic(F.col("_lat0"), F.col("_lon0"), F.col("lat"), F.col("lon")), F.lit(0.0))).drop("_lat0", "_lon0")


def heading(df: DataFrame, out: str = "heading", spare: str = "last") -> DataFrame:
    """Bearing to the next sample; the last row repeats it (``spare="first"``: bearing from the one before, the first row repeats)."""
    ahead, back = geo.bearing(F.col("lat"), F.col("lon"), lead("lat"), lead("lon")), geo.bearing(lag("lat"), lag("lon"), F.col("lat"), F.col("lon"))
    return df.withColumn(out, F.coalesce(ahead, back, F.lit(0.0)) if spare == "last" else F.coalesce(back, ahead, F.lit(0.0)))


def cumulative_distance(df: DataFrame, out: str = "distance_m") -> DataFrame:
    return step_m(df, "_step").withColumn(out, F.sum("_step").over(so_far())).drop("_step")


def total_distance(df: DataFrame, ellipsoid: bool = False) -> DataFrame:
    """Metres a trip, on the sphere or along geodesics of the ellipsoid."""
    return (step_m_ellipsoid(df, "step_m") if ellipsoid else step_m(df)).groupBy("trip_id").agg(F.sum("step_m").alias("distance_m"))


def dt_s(df: DataFrame, out: str = "dt_s") -> DataFrame:
    """Seconds from the sample before; where that is not positive, the trip's median positive step, or 0.1."""
    df = df.withColumn("_raw", (F.col("ts_us") - lag("ts_us")) / 1e6)
    usual = F.median(F.when(F.col("_raw") > 0, F.col("_raw"))).over(trip())
    return df.withColumn(out, F.when(F.col("_raw") > 0, F.col("_raw")).otherwise(F.coalesce(usual, F.lit(0.1)))).drop("_raw")


def gps_speed(df: DataFrame, most_kmh: float | None = None) -> DataFrame:
    """gps_speed_mps and gps_speed_kmh from positions and time."""
    df = dt_s(step_m(df, "_step"), "_dt").withColumn("gps_speed_mps", F.greatest(F.col("_step") / F.col("_dt"), F.lit(0.0)))
    kmh = F.col("gps_speed_mps") * 3.6
    return df.withColumn("gps_speed_kmh", F.least(kmh, F.lit(most_kmh)) if most_kmh else kmh).drop("_step", "_dt")


def curvature_gradient(df: DataFrame, of: str = "heading", out: str = "curvature") -> DataFrame:
    """Second central gradient of the heading in radians, unit spacing."""
    df = df.withColumn("_h", F.radians(of)).withColumn("_g", gradient("_h"))
    return df.withColumn(out, gradient("_g")).drop("_h", "_g")


def curvature_diff2(df: DataFrame, of: str = "heading", out: str = "curvature_diff2") -> DataFrame:
    """Second difference of the heading in radians; 0 for the first two rows."""
    h = F.radians(of)
    return df.withColumn(out, F.coalesce(h - 2 * lag(h) + lag(h, 2), F.lit(0.0)))


def sinuosity_range(df: DataFrame, window: int = 10, of: str = "heading", out: str = "sinuosity") -> DataFrame:
    """Range of the heading in radians over window // 2 rows to each side; null where the trip does not hold them all."""
    half = window // 2
    frame = ordered().rowsBetween(-half, half)
    h = F.radians(of)
    return df.withColumn(out, F.when(F.count(h).over(frame) == 2 * half + 1, F.max(h).over(frame) - F.min(h).over(frame)))


def sinuosity_delta(df: DataFrame, window: int = 10, of: str = "heading", out: str = "sinuosity_delta") -> DataFrame:
    frame = ordered().rowsBetween(-(window // 2), window // 2 - 1)
    return df.withColumn(out, F.abs(F.last(of).over(frame) - F.first(of).over(frame)))


def linear_acceleration(df: DataFrame, hz: float = 10.0, most: float = 20.0, out: str = "acc_lin") -> DataFrame:
    return df.withColumn(out, clip(gradient("speed") * hz, -most, most))


def angular_velocity(df: DataFrame, hz: float = 10.0, most: float = 180.0, of: str = "heading", out: str = "yaw_deg_s") -> DataFrame:
    """Degrees a second, without unwrapping, as in the definition."""
    return df.withColumn(out, clip(gradient(of) * hz, -most, most))


def inertial_from_speed_heading(df: DataFrame, hz: float = 10.0, of: str = "heading") -> DataFrame:
    df = df.withColumn("_psi", F.radians(of))
    return df.withColumn("acc_x_est", gradient("speed", spacing=1 / hz)).withColumn("acc_y_est", F.col("speed") * gradient("_psi", spacing=1 / hz)).drop("_psi")


def inertial_planar(df: DataFrame, hz: float = 10.0, of: str = "heading") -> DataFrame:
    """Planar acceleration components; the heading is used as it is given."""
    v, psi = F.col("speed"), F.col(of)
    df = df.withColumn("_dv", gradient("speed", spacing=1 / hz)).withColumn("_dpsi", gradient(of, spacing=1 / hz))
    return df.withColumn("acc_x_planar", F.col("_dv") * F.cos(psi) - v * F.sin(psi) * F.col("_dpsi")).withColumn("acc_y_planar", F.col("_dv") * F.sin(psi) + v * F.cos(psi) * F.col("_dpsi")).drop("_dv", "_dpsi")


def grade(df: DataFrame, out: str = "grade") -> DataFrame:
    """slope_percent / 100 if the trace has it, else rise over step from altitude_m, else 0; what is not finite is 0."""
    if "slope_percent" in df.columns:
        value = F.col("slope_percent") / 100
    elif "altitude_m" in df.columns:
        df = step_m(df, "_ds").withColumn("_dz", gradient("altitude_m"))
        value = F.when(F.col("_ds") > 0, F.col("_dz") / F.col("_ds"))
    else:
        value = F.lit(0.0)
    return df.withColumn(out, F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)).drop("_ds", "_dz")


def expected_imu(df: DataFrame, *, smooth_s: float = 0.5, hz: float = 10.0, gravity: bool = True, most_acc: float = 6.0, least_speed: float = 0.5, least_radius: float = 5.0, most_pitch: float = 1.0, flat: bool = False) -> DataFrame:
    """The signals that speed, position and slope imply, to hold against the measured ones: exp_acc_x/y/z, exp_gyro_y/z.

    ``flat``: acc_z is 0 and what counts as moving is the smoothed speed."""
    n = max(1, round(smooth_s * hz))
    df = grade(dt_s(df, "_dt"))
    df = df.withColumn("_t", F.sum(F.when(F.col("seq") == 0, 0.0).otherwise(F.col("_dt"))).over(so_far()))
    df = df.withColumn("_b", F.coalesce(F.radians(geo.bearing(lag("lat"), lag("lon"), F.col("lat"), F.col("lon"))), F.lit(0.0)))
    df = unwrap(df, "_b", "_psi0").withColumn("_psi", F.avg("_psi0").over(centred(n))).withColumn("_th", F.avg(F.atan("grade")).over(centred(n))).withColumn("_v", F.avg("speed").over(centred(n)))
    moving = F.col("_v" if flat else "speed") > least_speed
    limit = F.greatest(F.col("_v"), F.lit(0.0)) / max(1.0, least_radius)
    df = df.withColumn("_yaw", F.when(moving, gradient("_psi", "_t")).otherwise(0.0))
    df = df.withColumn("exp_gyro_z", F.when(F.col("_yaw") > limit, limit).when(F.col("_yaw") < -limit, -limit).otherwise(F.col("_yaw")))
    df = df.withColumn("exp_gyro_y", clip(gradient("_th", "_t"), -most_pitch, most_pitch))
    df = df.withColumn("exp_acc_x", clip(gradient("_v", "_t"), -most_acc, most_acc) + (G * F.sin("_th") if gravity else F.lit(0.0)))
    df = df.withColumn("exp_acc_y", F.when(moving, F.col("_v") * F.col("exp_gyro_z")).otherwise(0.0))
    return df.withColumn("exp_acc_z", G * F.cos("_th") if gravity and not flat else F.lit(0.0)).drop("_dt", "_t", "_b", "_psi0", "_psi", "_th", "_v", "_yaw")


def rolling_mean(df: DataFrame, c: str, n: int, out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"{c}_mean", F.avg(c).over(centred(n)))


def rolling_mean_time(df: DataFrame, c: str, seconds: float, out: str | None = None) -> DataFrame:
    """Mean over the samples in (t - s/2, t + s/2]."""
    half = round(seconds * 5e5)
    frame = trip().orderBy("ts_us").rangeBetween(-half + 1, half)
    return df.withColumn(out or f"{c}_mean", F.avg(c).over(frame))


def rolling_median(df: DataFrame, c: str, n: int = 3, out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"{c}_median", F.percentile(c, F.lit(0.5)).over(centred(n)))


def rolling_std(df: DataFrame, c: str, n: int, out: str | None = None) -> DataFrame:
    """Trailing mean and sample deviation over n rows."""
    frame = ordered().rowsBetween(-(n - 1), 0)
    return df.withColumn(f"{out or c}_roll_mean", F.avg(c).over(frame)).withColumn(f"{out or c}_roll_std", F.stddev_samp(c).over(frame))


def fill(df: DataFrame, *columns: str) -> DataFrame:
    """Forward, then backward."""
    return df.withColumns({c: F.coalesce(ffill(c), bfill(c)) for c in columns})


def declared_speed(df: DataFrame, n: int = 31, out: str = "declared_speed") -> DataFrame:
    base = F.coalesce(F.col("target_speed"), F.col("speed")) if "target_speed" in df.columns else F.col("speed")
    return df.withColumn(out, F.greatest(F.avg(base).over(centred(n)), F.lit(0.0)))


def turn_angle(df: DataFrame, out: str = "turn_deg") -> DataFrame:
    """Least change of bearing between the segments that meet at a sample; null at the ends."""
    ahead, back = geo.bearing(F.col("lat"), F.col("lon"), lead("lat"), lead("lon")), geo.bearing(lag("lat"), lag("lon"), F.col("lat"), F.col("lon"))
    d = F.abs(ahead - back)
    return df.withColumn(out, F.least(d, 360 - d))
