"""Delivery plans: legs, straight lines, and the schedule in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripmill.functions import geo


def _plan():
    return W.partitionBy("plan_id").orderBy("stop_seq")


def build_legs(plan: DataFrame) -> DataFrame:
    """One row for each two consecutive stops: plan_id, leg_idx, from_stop, to_stop, lat1, lon1, lat2, lon2, service_s."""
    nxt = lambda c: F.lead(c).over(_plan())
    legs = plan.select("plan_id", F.col("stop_seq").alias("leg_idx"), F.col("stop_id").alias("from_stop"), nxt("stop_id").alias("to_stop"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), nxt("lat").alias("lat2"), nxt("lon").alias("lon2"), nxt("service_s").alias("service_s"))
    return legs.where("to_stop IS NOT NULL")


def straight_line_legs(legs: DataFrame, speed: float = 13.9) -> DataFrame:
    """distance_m, duration_s (at least 1) and n_points (at least 200) of each leg in a straight line."""
    metres = geo.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    legs = legs.withColumn("distance_m", metres).withColumn("duration_s", F.greatest(F.col("distance_m") / speed, F.lit(1.0)))
    return legs.withColumn("n_points", F.greatest(F.lit(200), F.floor("duration_s").cast("int") + 1))


def leg_points(legs: DataFrame, before: bool = False) -> DataFrame:
    """The evenly spaced points of each straight leg, of at least two: plan_id, leg_idx, pt_idx, lat, lon, t_rel_s. before: also lat0, lon0, the place
    that comes before it when legs meet (``resample.seam_dedupe``), from the legs themselves, so that points need no sort."""
    extra = []
    if before:
        last = lambda c: F.lag(F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1"))).over(W.partitionBy("plan_id").orderBy("leg_idx"))
        legs = legs.withColumns({f"_{c}0": last(c) for c in ("lat", "lon")})
        seam = (F.col("pt_idx") == 0) | ((F.col("pt_idx") == 1) & (F.col("leg_idx") != 0))
        extra = [F.when(seam, F.col(f"_{c}0")).otherwise(F.col(f"{c}1") + F.col("_r") * (F.col(f"{c}2") - F.col(f"{c}1"))).alias(f"{c}0") for c in ("lat", "lon")]
    rows = legs.withColumn("pt_idx", F.explode(F.sequence(F.lit(0), F.col("n_points") - 1)))
    rows = rows.withColumns({"_s": F.col("pt_idx") / (F.col("n_points") - 1), "_r": (F.col("pt_idx") - 1) / (F.col("n_points") - 1)})
    return rows.select("plan_id", "leg_idx", "pt_idx", (F.col("lat1") + F.col("_s") * (F.col("lat2") - F.col("lat1"))).alias("lat"), (F.col("lon1") + F.col("_s") * (F.col("lon2") - F.col("lon1"))).alias("lon"), (F.col("_s") * F.col("duration_s")).alias("t_rel_s"), *extra)


def schedule(plan: DataFrame, start_s: int = 1_735_689_600) -> DataFrame:
    """arrive_s, wait_s and depart_s of each stop: one waits for the opening of its time window. With P the running sum of travel
    and service, depart = P + running maximum of the start and of (opening - (P - service)): no loop over stops."""
    so_far = _plan().rowsBetween(W.unboundedPreceding, 0)
    rows = plan.withColumn("_p", F.sum(F.col("travel_s") + F.col("service_s")).over(so_far))
    late = F.max(F.col("tw_start_s") - (F.col("_p") - F.col("service_s"))).over(so_far)
    rows = rows.withColumn("depart_s", F.col("_p") + F.greatest(F.lit(start_s), F.coalesce(late, F.lit(0))))
    arrive = F.coalesce(F.lag("depart_s").over(_plan()), F.lit(start_s)) + F.col("travel_s")
    rows = rows.withColumn("arrive_s", arrive).withColumn("wait_s", F.greatest(F.lit(0), F.coalesce(F.col("tw_start_s") - F.col("arrive_s"), F.lit(0))))
    return rows.drop("_p")


def wait_stop_intervals(scheduled: DataFrame) -> DataFrame:
    """plan_id, stop_seq, kind, start_s, end_s of all waits and services."""
    wait = scheduled.where("wait_s > 0").select("plan_id", "stop_seq", F.lit("wait").alias("kind"), F.col("arrive_s").alias("start_s"), (F.col("arrive_s") + F.col("wait_s")).alias("end_s"))
    return wait.unionByName(scheduled.where("service_s > 0").select("plan_id", "stop_seq", F.lit("stop").alias("kind"), (F.col("depart_s") - F.col("service_s")).alias("start_s"), F.col("depart_s").alias("end_s")))


def plan_summary(legs: DataFrame) -> DataFrame:
    return legs.groupBy("plan_id").agg(F.count("*").alias("n_legs"), F.sum("distance_m").alias("distance_m"), F.sum("duration_s").alias("duration_s"))
