"""Aggregates behind trip reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripmill.functions.labels import POINT_EVENTS, is_blank
from tripmill.functions.quantiles import quantiles
from tripmill.functions.windows import centred, lag, spans, trip
from tripmill.operators.kinematics import G, cumulative_distance, dt_s, gps_speed, step_m, step_m_ellipsoid
from tripmill.operators.resample import downsample


def trip_summary(df: DataFrame) -> DataFrame:
    """Duration, distance, mean speed, stop blocks and seconds standing with a stop label."""
    fresh = (F.col("event") == "stop") & ~F.coalesce(lag("event") == "stop", F.lit(False))
    rows = dt_s(step_m(df), "_dt").withColumn("_new", F.coalesce(fresh, F.lit(False)))
    return rows.groupBy("trip_id").agg(
        ((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("duration_s"), F.sum("step_m").alias("distance_m"), F.avg("speed").alias("mean_speed"),
        F.count_if("_new").alias("stop_blocks"), F.coalesce(F.sum(F.when(F.col("event") == "stop", F.col("_dt"))), F.lit(0.0)).alias("stop_s"),
    )


def trip_metrics(df: DataFrame) -> DataFrame:
    """Duration, geodesic distance, and the mean speeds from positions and as declared."""
    rows = step_m_ellipsoid(gps_speed(step_m(df)))
    return rows.groupBy("trip_id").agg(((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("duration_s"), F.sum("step_ellipsoid_m").alias("distance_m"), F.avg("gps_speed_kmh").alias("gps_kmh"), (F.avg("speed") * 3.6).alias("declared_kmh"))


def event_counts(df: DataFrame, total: bool = False) -> DataFrame:
    """Rows a label, blank ones left out; with ``total`` a last row of that name for all."""
    if total:
        counts = df.where(~is_blank(F.col("event"))).rollup("event").agg(F.count("*").alias("n"))
        return counts.select(F.coalesce("event", F.lit("total")).alias("event"), "n")
    return df.where(~is_blank(F.col("event"))).groupBy("event").agg(F.count("*").alias("n"))


def point_event_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("trip_id").agg(*(F.count_if(F.col("event") == e).alias(f"n_{e}") for e in POINT_EVENTS))


def acc_heatmap(df: DataFrame, bins: int = 100, most_g: float = 1.0) -> DataFrame:
    """Counts and metres in a grid over acc_x and acc_y from -most_g to most_g; the last bin holds its right edge."""
    g = lambda c: F.col(c) / G
    index = lambda c: F.least(F.floor((g(c) + most_g) / (2 * most_g / bins)).cast("int"), F.lit(bins - 1))
    rows = step_m(df).where((F.abs(g("acc_x")) <= most_g) & (F.abs(g("acc_y")) <= most_g))
    return rows.groupBy(index("acc_x").alias("bx"), index("acc_y").alias("by")).agg(F.count("*").alias("n"), F.sum("step_m").alias("metres"))


def speed_describe(df: DataFrame, *by: str) -> DataFrame:
    """Count, mean, spread, ends and exact quartiles of the speed in each group, or of all rows; quartiles by selection, so a group may be of any size."""
    stats = df.groupBy(*by).agg(F.count("speed").alias("n"), F.avg("speed").alias("mean"), F.stddev_samp("speed").alias("std"), F.min("speed").alias("min"), F.max("speed").alias("max"))
    q = quantiles(df, "speed", by, (0.25, 0.5, 0.75)).select(*(F.col(b).alias(f"_{b}") for b in by), "q")
    out = stats.join(q, reduce(Column.__and__, (stats[b].eqNullSafe(q[f"_{b}"]) for b in by), F.lit(True)), "left")
    return out.select(*by, "n", "mean", "std", "min", *(F.col("q")[i].alias(f"q{p}") for i, p in enumerate((25, 50, 75))), "max")


def imu_stats(df: DataFrame) -> DataFrame:
    """axis, mean, std, min, max over all samples of a trip, one row an axis."""
    axes = ("acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z")
    wide = df.groupBy("trip_id").agg(*(F.struct(F.lit(a).alias("axis"), F.avg(a).alias("mean"), F.stddev_samp(a).alias("std"), F.min(a).alias("min"), F.max(a).alias("max")).alias(a) for a in axes))
    return wide.select("trip_id", F.explode(F.array(*axes)).alias("s")).select("trip_id", "s.*")


def portion_speeds(df: DataFrame, parts: int = 10) -> DataFrame:
    """Mean speed by road type in each tenth of a trip."""
    n = F.count("*").over(trip())
    rows = df.withColumn("portion", F.floor(((F.col("seq") + 1) * parts - 1) / n).cast("int"))
    return rows.groupBy("trip_id", "portion", "road_type").agg(F.avg("speed").alias("mean_speed"), F.count("*").alias("n"))


def altitude_profile(df: DataFrame) -> DataFrame:
    return cumulative_distance(df).select("trip_id", "seq", "distance_m", "altitude_m", "slope_percent")


def map_track(df: DataFrame, hz: float = 1.0, most: int = 5000) -> DataFrame:
    """Per trip: the sampled polyline in order and the labelled standing points, as arrays of structs. At most ``most`` points."""
    line = downsample(df, hz, most=most).groupBy("trip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))), lambda p: F.struct(p.lat.alias("lat"), p.lon.alias("lon"))).alias("pts"))
    marks = spans(df, F.col("event").isin("stop", "wait")).join(df.select("trip_id", F.col("seq").alias("start_seq"), "lat", "lon", "event"), ["trip_id", "start_seq"])
    events = marks.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("start_seq", "event", "lat", "lon"))).alias("events"))
    return line.join(events, "trip_id", "left")


def event_windows(df: DataFrame, label: str = "stop", rows: int = 20, most: int = 5) -> DataFrame:
    """Rows around the end of the first ``most`` runs of a label: trip_id, run_id, offset, seq, speed."""
    ends = spans(df, F.col("event") == label).where(F.col("run_id") <= most)
    around = ends.select("trip_id", "run_id", "end_seq", F.explode(F.sequence(F.col("end_seq") - rows, F.col("end_seq") + rows)).alias("seq"))
    return around.join(df.select("trip_id", "seq", "speed"), ["trip_id", "seq"]).select("trip_id", "run_id", (F.col("seq") - F.col("end_seq")).alias("offset"), "seq", "speed")


def map_markers(df: DataFrame, most: int = 30) -> DataFrame:
    """Labels at distinct places (5 decimals), thinned evenly to ``most`` a label and trip."""
    place = df.where(~is_blank(F.col("event"))).withColumns({"lat5": F.bround("lat", 5), "lon5": F.bround("lon", 5)})
    one = place.groupBy("trip_id", "event", "lat5", "lon5").agg(F.min("seq").alias("seq"))
    lane = W.partitionBy("trip_id", "event")
    one = one.withColumn("_n", F.count("*").over(lane)).withColumn("_i", F.row_number().over(lane.orderBy("seq")) - 1)
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / most))
    return one.where(F.col("_i") % step == 0).where(F.floor(F.col("_i") / step) < most).drop("_n", "_i")


def top_spikes(df: DataFrame, k: int = 5, most_kmh: float = 180.0, hard_m: float = 500.0, margin_m: float = 30.0) -> DataFrame:
    """The k largest steps of a trip with what the speed allows: trip_id, rank, seq, step_m, max_step_m, dt_s."""
    rows = dt_s(step_m(df)).withColumn("max_step_m", F.least(most_kmh / 3.6 * F.col("dt_s") + margin_m, F.lit(hard_m)))
    rank = F.row_number().over(W.partitionBy("trip_id").orderBy(F.round("step_m", 6).desc(), "seq"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("trip_id", "rank", "seq", "step_m", "max_step_m", "dt_s")


def delivery_spans(df: DataFrame) -> DataFrame:
    """Runs of in_delivery = 1 with their times."""
    runs = spans(df, F.col("in_delivery") == 1)
    t = df.select("trip_id", "seq", "ts_us")
    start = t.select("trip_id", F.col("seq").alias("start_seq"), F.col("ts_us").alias("start_us"))
    end = t.select("trip_id", F.col("seq").alias("end_seq"), F.col("ts_us").alias("end_us"))
    return runs.join(start, ["trip_id", "start_seq"]).join(end, ["trip_id", "end_seq"]).select("trip_id", "run_id", "start_seq", "end_seq", "start_us", "end_us")


def null_counts(df: DataFrame) -> DataFrame:
    """column, n_null: one row a column."""
    one = df.agg(F.array(*(F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n_null")) for c in df.columns)).alias("r"))
    return one.select(F.explode("r").alias("r")).select("r.*")


def road_types_seen(df: DataFrame) -> DataFrame:
    return df.groupBy("trip_id").agg(F.array_join(F.array_sort(F.collect_set("road_type")), ",").alias("road_types"))


def curvature_smooth(df: DataFrame) -> DataFrame:
    return df.withColumn("curvature_smooth", F.avg("curvature").over(centred(10)))


def max_speed_summary(df: DataFrame) -> DataFrame:
    return step_m(df).agg(F.max("speed").alias("max_speed"), F.sum("step_m").alias("distance_m"), F.count_distinct("trip_id").alias("n_trips"))


def speed_distribution(df: DataFrame, by: str = "road_type", parts: int = 10) -> DataFrame:
    """Exact speed quantiles of each group, one row a quantile: the data of a violin plot."""
    q = quantiles(df, "speed", (by,), tuple(i / parts for i in range(parts + 1)))
    return q.select(by, F.posexplode("q").alias("k", "speed")).select(by, (F.col("k") / parts).alias("quantile"), "speed")


def speed_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("trip_id").agg(F.min("speed").alias("min"), F.max("speed").alias("max"), F.avg("speed").alias("mean"))


def category_bands(df: DataFrame, prefix: str = "event_") -> DataFrame:
    """Runs of each 0/1 category column: trip_id, category, start_seq, end_seq. One window a category, over the same sort."""
    bands = [spans(df, F.col(c) == 1).withColumn("category", F.lit(c[len(prefix) :])) for c in df.columns if c.startswith(prefix) and c not in ("event_id", "event_type")]
    return reduce(DataFrame.unionByName, bands).select("trip_id", "category", "start_seq", "end_seq")


def stop_wait_phases(df: DataFrame) -> DataFrame:
    """is_stop and is_wait by the words in the label."""
    has = lambda w: F.coalesce(F.lower("event").contains(w), F.lit(False)).cast("int")
    return df.withColumns({"is_stop": has("stop"), "is_wait": has("wait")})


def hold_summary(holds: DataFrame) -> DataFrame:
    """(plan_id, leg_idx, stop_id, hold_s) -> plan_id, n_holds, total_s, items in order of legs."""
    return holds.groupBy("plan_id").agg(F.count("*").alias("n_holds"), F.sum("hold_s").alias("total_s"), F.array_sort(F.collect_list(F.struct("leg_idx", "stop_id", "hold_s"))).alias("items"))


def chart_series(df: DataFrame, hz: float = 1.0, most: int = 2000, columns: tuple[str, ...] = ("speed", "acc_x", "acc_y", "acc_z")) -> DataFrame:
    """Per trip: seconds since the start and each signal as arrays in order, speed in km/h and accelerations in g. At most ``most`` points."""
    rows = downsample(df.withColumn("t", (F.col("ts_us") - F.min("ts_us").over(trip())) / 1e6), hz, most=most)
    unit = {c: F.col(c) * 3.6 if c == "speed" else F.col(c) / G if c.startswith("acc") else F.col(c) for c in columns}
    one = rows.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("seq", "t", *(u.alias(c) for c, u in unit.items())))).alias("p"))
    return one.select("trip_id", *(F.col("p")[c].alias(c) for c in ("t", *columns)))
