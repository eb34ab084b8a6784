"""Resampling, retiming and stitching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripmill.functions import geo
from tripmill.functions.labels import is_blank
from tripmill.functions.windows import exact_sum, lag, so_far, trip
from tripmill.operators.clean import zero_ends
from tripmill.operators.kinematics import gps_speed, step_m
from tripmill.operators.recurrences import compose_clean, slew_limit_dt, stitched_plans, stitched_straight


def time_grid(df: DataFrame, hz: float = 10.0, expected: DataFrame | None = None) -> DataFrame:
    """One row a grid time from the first to the last sample of each trip: trip_id, ts_us. With ``expected`` (trip_id, duration_s) exactly
    round(duration * hz) + 1 of them, for the longer of the observed and the expected duration."""
    ends = df.groupBy("trip_id").agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("b"))
    if expected is not None:
        ends = ends.join(expected.select("trip_id", F.col("duration_s").alias("_e")), "trip_id", "left")
        n = F.bround(F.greatest((F.col("b") - F.col("a")) / 1e6, F.coalesce("_e", F.lit(0.0))) * hz).cast("long")
        return ends.select("trip_id", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: F.col("a") + F.round(i * (1e6 / hz)).cast("long"))).alias("ts_us"))
    return ends.select("trip_id", F.explode(F.sequence("a", "b", F.lit(round(1e6 / hz)).cast("long"))).alias("ts_us"))


def _one_a_time(df: DataFrame, values: dict[str, Column], labels: str | None = None) -> DataFrame:
    """One row for each time of a trip, in place: trip_id, ts_us, the ``values`` of the first sample by seq, and _label, that of the last labelled sample.
    _a is the first time of the trip, _at and _b are this time and the next one."""
    order = trip().orderBy("ts_us", "seq")
    first = F.coalesce(F.lag("ts_us").over(order) != F.col("ts_us"), F.lit(True))
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    held = F.struct(F.col("ts_us").alias("t"), F.struct(*(v.alias(c) for c, v in values.items())).alias("v")) if values else F.struct(F.col("ts_us").alias("t"))
    rows = df.where("ts_us IS NOT NULL").withColumns({"_first": first, "_b": F.lead("ts_us").over(order), "_a": F.first("ts_us").over(upto)})
    rows = rows.withColumn("_held", F.last(F.when(F.col("_first"), held), True).over(upto))
    if labels:
        rows = rows.withColumn("_label", F.last(F.when(~is_blank(F.col(labels)), F.struct(F.col("ts_us").alias("t"), F.col(labels).alias("event"))), True).over(upto))
    rows = rows.where("_b IS NULL OR _b > ts_us")
    label = {"_label": F.when(F.col("_label.t") == F.col("ts_us"), F.col("_label"))} if labels else {}
    return rows.select("trip_id", F.col("ts_us").alias("_at"), "_a", "_b", *(F.col("_held.v")[c].alias(c) for c in values), *(v.alias(c) for c, v in label.items()))


def _around(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """<name>_a, the last of a value that is not null up to a row's time, and <name>_b, the first after it."""
    upto, after = trip().orderBy("_at").rowsBetween(W.unboundedPreceding, 0), trip().orderBy(F.desc("_at")).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({f"{c}_a": F.last(v, True).over(upto) for c, v in columns.items()})
    return rows.withColumns({f"{c}_b": F.last(v, True).over(after) for c, v in columns.items()})


def _spread(rows: DataFrame, step: float, last: Column) -> DataFrame:
    """Each row once for every grid time from its own up to the next row's: seq, ts_us. Times are _a + round(seq * step), seq up to ``last``."""
    slack = 0 if step == int(step) else 1
    least = F.ceil((F.col("_at") - F.col("_a")) / step) - slack
    most = F.least(F.when(F.col("_b").isNull(), last).otherwise(F.ceil((F.col("_b") - F.col("_a")) / step) - 1 + slack), last)
    rows = rows.withColumns({"_i": F.greatest(least, F.lit(0)).cast("long"), "_j": most.cast("long")}).where("_i <= _j")
    rows = rows.withColumn("seq", F.explode(F.sequence("_i", "_j"))).withColumn("ts_us", F.col("_a") + (F.col("seq") * int(step) if not slack else F.round(F.col("seq") * step).cast("long")))
    rows = rows.where("ts_us >= _at AND (_b IS NULL OR ts_us < _b)") if slack else rows
    return rows.withColumn("seq", F.col("seq").cast("int")).drop("_i", "_j")


def _on_grid(df: DataFrame, drawn: tuple[str, ...], held: tuple[str, ...], hz: float, expected: DataFrame | None) -> DataFrame:
    """The grid of each trip from its first to its last sample: trip_id, seq, ts_us, ``drawn`` linear by time, ``held`` from the last sample that has them (else
    the next). With ``expected`` (trip_id, duration_s) exactly round(duration * hz) + 1 rows, for the longer of the observed and the expected duration. Grid
    times are made where the samples lie, one shuffle and no join with the samples."""
    rows = _around(_one_a_time(df, {c: F.col(c) for c in (*drawn, *held)}), {c: F.col(c) for c in (*drawn, *held)})
    end = F.max("_at").over(trip())
    if expected is None:
        step = float(round(1e6 / hz))
        rows = rows.withColumn("_n", F.floor((end - F.col("_a")) / step))
    else:
        step = 1e6 / hz
        rows = rows.withColumn("_end", end).join(expected.select("trip_id", F.col("duration_s").alias("_e")), "trip_id", "left")
        rows = rows.withColumn("_n", F.bround(F.greatest((F.col("_end") - F.col("_a")) / 1e6, F.coalesce("_e", F.lit(0.0))) * hz).cast("long"))
    rows = _spread(rows, step, F.col("_n"))
    share = F.when((F.col("ts_us") > F.col("_at")) & F.col("_b").isNotNull(), (F.col("ts_us") - F.col("_at")) / (F.col("_b") - F.col("_at"))).otherwise(0.0)

    def between(c: str) -> Column:
        a, b = F.col(f"{c}_a"), F.when(F.col("ts_us") == F.col("_at"), F.coalesce(c, f"{c}_b")).otherwise(F.col(f"{c}_b"))
        return F.coalesce(a + share * (b - a), a).alias(c)

    return rows.select("trip_id", "seq", "ts_us", *(between(c) for c in drawn), *(F.coalesce(f"{c}_a", f"{c}_b").alias(c) for c in held))


def resample_linear(df: DataFrame, columns: tuple[str, ...] = ("lat", "lon", "speed"), hz: float = 10.0, expected: DataFrame | None = None) -> DataFrame:
    """Values on the grid, linear by time between the samples around, after the last one its own; the samples of one time count once, the first by seq."""
    return _on_grid(df, columns, (), hz, expected)


def retime(df: DataFrame, target: str = "target_speed", least_s: float = 0.05) -> DataFrame:
    """New times from distance over target speed (m/s); the first row's least step counts into all later rows. Times are whole microseconds of exact
    sums: those of plain ones depend on their order."""
    df = step_m(df, "_step").withColumn("_dt", F.greatest(F.col("_step") / F.col(target), F.lit(least_s)))
    after = F.when(F.col("seq") == 0, 0.0).otherwise(exact_sum("_dt", so_far()))
    return df.withColumn("ts_us", (F.first("ts_us").over(so_far()) + F.round(after * 1e6)).cast("long")).drop("_step", "_dt")


def densify_step(points: DataFrame, step: float = 0.83) -> DataFrame:
    """Every segment in max(1, round(length / step)) equal parts; the last point is kept: trip_id, seq, part, lat, lon."""
    order = W.partitionBy("trip_id").orderBy("seq")
    nxt = lambda c: F.lead(c).over(order)
    seg = points.select("trip_id", "seq", "lat", "lon", nxt("lat").alias("lat2"), nxt("lon").alias("lon2"))
    seg = seg.withColumn("n", F.when(F.col("lat2").isNull(), 1).otherwise(F.greatest(F.lit(1), F.bround(geo.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) / step).cast("int"))))
    seg = seg.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    share = F.col("part") / F.col("n")
    place = lambda c: F.coalesce(F.col(c) + share * (F.col(f"{c}2") - F.col(c)), F.col(c)).alias(c)
    return seg.select("trip_id", "seq", "part", place("lat"), place("lon"))


def seam_dedupe(legs: DataFrame) -> DataFrame:
    """Drops the first point of every later leg, then points equal to the one before: plan_id, leg_idx, pt_idx, lat, lon. Points that bring the place
    before them (lat0, lon0 of ``plan.leg_points``) are neither shuffled nor sorted."""
    rows = legs.where("leg_idx = 0 OR pt_idx > 0")
    order = W.partitionBy("plan_id").orderBy("leg_idx", "pt_idx")
    known = {"lat0", "lon0"} <= set(legs.columns)
    before = lambda c: F.col(f"{c}0") if known else F.lag(c).over(order)
    same = (before("lat") == F.col("lat")) & (before("lon") == F.col("lon"))
    return rows.withColumn("_same", F.coalesce(same, F.lit(False))).where("NOT _same").drop("_same", "lat0", "lon0")


def leg_offsets(legs: DataFrame, duration: str = "duration_s") -> DataFrame:
    """t0_s: the summed durations of the legs before."""
    before = W.partitionBy("plan_id").orderBy("leg_idx").rowsBetween(W.unboundedPreceding, -1)
    return legs.withColumn("t0_s", F.coalesce(F.sum(duration).over(before), F.lit(0)))


def retimestamp_by_index(df: DataFrame, hz: float = 10.0) -> DataFrame:
    return df.withColumn("ts_us", F.first("ts_us").over(so_far()) + F.col("seq") * round(1e6 / hz))


def downsample(df: DataFrame, hz: float = 1.0, source_hz: float = 10.0, most: int = 5000) -> DataFrame:
    """Every k-th sample, k the ratio of rates, wider where a trip would have more than ``most`` points; whole if under 2 points are left."""
    n = F.count("*").over(trip())
    k = F.greatest(F.lit(max(1, round(source_hz / hz))), F.ceil(n / most).cast("int"))
    df = df.withColumn("_k", F.when(F.ceil(n / k) < 2, 1).otherwise(k))
    return df.where("seq % _k = 0").drop("_k")


def key_points(df: DataFrame, every: int = 600) -> DataFrame:
    """Labelled rows and every ``every``-th, one a position (the first)."""
    rows = df.where((F.col("event").isNotNull() & (F.trim("event") != "")) | (F.col("seq") % every == 0))
    nth = F.row_number().over(W.partitionBy("trip_id", "lat", "lon").orderBy("seq"))
    return rows.withColumn("_n", nth).where("_n = 1").drop("_n")


def shift_start(df: DataFrame, start_us: int) -> DataFrame:
    return df.withColumn("ts_us", F.col("ts_us") + F.lit(start_us) - F.first("ts_us").over(so_far()))


def consecutive_distinct(df: DataFrame) -> DataFrame:
    """Rows whose position differs from the one before."""
    same = (lag("lat") == F.col("lat")) & (lag("lon") == F.col("lon"))
    return df.withColumn("_same", F.coalesce(same, F.lit(False))).where("NOT _same").drop("_same")


def densify_1m(points: DataFrame) -> DataFrame:
    """Every segment with one point a whole metre, both ends included: trip_id, seq, part, lat, lon."""
    order = W.partitionBy("trip_id").orderBy("seq")
    nxt = lambda c: F.lead(c).over(order)
    seg = points.select("trip_id", "seq", "lat", "lon", nxt("lat").alias("lat2"), nxt("lon").alias("lon2")).where("lat2 IS NOT NULL")
    seg = seg.withColumn("n", F.greatest(F.lit(1), F.floor(geo.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).cast("int"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n"))))
    share = F.col("part") / F.col("n")
    return seg.select("trip_id", "seq", "part", (F.col("lat") + share * (F.col("lat2") - F.col("lat"))).alias("lat"), (F.col("lon") + share * (F.col("lon2") - F.col("lon"))).alias("lon"))


def resample_positions(df: DataFrame, hz: float = 10.0, tolerance_us: int = 500_000) -> DataFrame:
    """The rows of the grid, from the samples at exactly its times (of one time the first by seq): numbers linear by the count of grid rows between two that are known, the
    nearest known one at the ends; other columns from the last known row, else the next; labels from the nearest sample in reach."""
    step = int(1000 / hz) * 1000
    fixed = ("trip_id", "seq", "ts_us")
    numbers = [c for c, t in df.dtypes if c not in fixed and t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")]
    others = [c for c in df.columns if c not in (*fixed, *numbers, "event")]
    rows = _one_a_time(df, {c: F.col(c) for c in (*numbers, *others)}, labels="event" if "event" in df.columns else None)
    nth = (F.col("_at") - F.col("_a")) / step
    known = lambda c, v: F.when((nth == F.floor(nth)) & F.col(c).isNotNull(), v)
    rows = rows.withColumns({c: known(c, F.struct(F.floor(nth).alias("seq"), F.col(c).cast("double").alias("v"))) for c in numbers} | {c: known(c, F.col(c)) for c in others})
    rows = _around(rows, {c: F.col(c) for c in (*numbers, *others, *(("_label",) if "event" in df.columns else ()))})
    rows = _spread(rows.withColumn("_n", F.floor((F.max("_at").over(trip()) - F.col("_a")) / step)), float(step), F.col("_n"))

    def between(c: str) -> Column:
        a, b = F.col(f"{c}_a"), F.col(f"{c}_b")
        return F.when(a.isNull(), b.v).when(b.isNull() | (a.seq == F.col("seq")), a.v).otherwise(a.v + (F.col("seq") - a.seq) / (b.seq - a.seq) * (b.v - a.v)).alias(c)

    gap = lambda c: F.abs(F.col("ts_us") - F.col(f"{c}.t"))
    near = F.when(F.col("_label_b").isNull() | (gap("_label_a") <= gap("_label_b")), F.col("_label_a")).otherwise(F.col("_label_b"))
    event = [F.when(F.abs(F.col("ts_us") - near.t) <= tolerance_us, near.event).alias("event")] if "event" in df.columns else []
    return rows.select(*fixed, *(between(c) for c in numbers), *(F.coalesce(f"{c}_a", f"{c}_b").alias(c) for c in others), *event)


def resample_full(df: DataFrame, hz: float = 10.0, tolerance_us: int = 500_000) -> DataFrame:
    """Onto the grid by positions, then the chain of repairs: jumps, standing still, speed from positions, slew and absolute limits, distance."""
    return compose_clean(resample_positions(df, hz, tolerance_us))


def sync_grid(df: DataFrame, hz: float = 10.0, rate: float = 3.0, expected: DataFrame | None = None) -> DataFrame:
    """A grid of exactly round(duration * hz) + 1 rows for the observed duration or that of ``expected`` (trip_id, duration_s), if longer: positions
    linear by time, all other columns from the last sample that has them (else the next); speed from the positions, slew-limited, and 0 at
    ends that hardly move, over one second each."""
    grid = _on_grid(df, ("lat", "lon"), tuple(c for c in df.columns if c not in ("trip_id", "seq", "ts_us", "lat", "lon", "speed")), hz, expected)
    grid = gps_speed(grid).withColumn("speed", F.col("gps_speed_mps")).drop("gps_speed_mps", "gps_speed_kmh")
    return zero_ends(slew_limit_dt(grid, rate), rows=max(1, int(hz)))


def _started(legs: DataFrame) -> DataFrame:
    before = W.partitionBy("plan_id").orderBy("leg_idx").rowsBetween(W.unboundedPreceding, -1)
    return legs.withColumn("t0", F.coalesce(F.sum(F.col("duration_s") + F.col("service_s")).over(before), F.lit(0.0)))


def stitch(points: DataFrame | None, legs: DataFrame, hz: float = 10.0, start_us: int = 1_735_689_600_000_000) -> DataFrame:
    """Leg points (plan_id, leg_idx, pt_idx, lat, lon, t_rel_s) and legs (plan_id, leg_idx, duration_s, service_s) -> one trace a plan
    (trip_id, seq, ts_us, lat, lon, speed): legs end to end, each followed by a hold of its service time at its last point. points: None for
    straight legs, whose points (those of ``plan.leg_points``) are made for many plans at once: then only legs are shuffled, a plan is one row of them."""
    at = _started(legs)
    if points is None:
        return stitched_straight(at, hz, start_us)
    each = points.groupBy("plan_id", "leg_idx").agg(F.array_sort(F.collect_list(F.struct("pt_idx", "lat", "lon", "t_rel_s"))).alias("_p"))
    at = at.join(each, ["plan_id", "leg_idx"]).withColumns({"lats": F.col("_p.lat"), "lons": F.col("_p.lon"), "times": F.col("_p.t_rel_s")})
    return stitched_plans(at.select("plan_id", "leg_idx", "t0", "service_s", "lats", "lons", "times"), hz, start_us)


def stitch_summary(legs: DataFrame, hz: float = 10.0) -> DataFrame:
    """Of the trace that ``stitch`` makes of straight legs, by plan: trip_id, n rows, max_speed, mean lat. All its rows are made; they are summed up where they are."""
    return stitched_straight(_started(legs), hz, 0, summary=True)
