"""Quality checks: one row a trip, from as few aggregates as the rules allow."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmill.functions.labels import POINT_EVENTS, ROAD_ORDER
from tripmill.functions.windows import lag, ordered, trip
from tripmill.operators.clean import round_keys
from tripmill.operators.kinematics import expected_imu, step_m


def _median(c: Column, when: Column | None = None) -> Column:
    return F.median(F.when(when, c) if when is not None else c)


def checklist(df: DataFrame, hz: float = 10.0) -> DataFrame:
    """Cadence, sign and ends of the speed, variability, and lateral consistency; speed in m/s. In trips whose speed is 0 throughout the
    sign is that of speed_kmh, if there is such a column."""
    kmh = F.col("speed_kmh") / 3.6 if "speed_kmh" in df.columns else F.lit(None).cast("double")
    df = df.withColumn("_dt", (F.col("ts_us") - lag("ts_us")) / 1e6).withColumn("_n", F.count("*").over(trip()))
    v, gz, ay = F.coalesce("speed", F.lit(0.0)), F.coalesce("gyro_z", F.lit(0.0)), F.coalesce("acc_y", F.lit(0.0))
    tail = max(1, round(hz))
    moving = v > 0.5
    turn = moving & (F.abs(gz) > 0.01)
    radius = v / F.greatest(F.abs(gz), F.lit(1e-3))
    radius_ay = v * v / F.greatest(F.abs(ay), F.lit(1e-3))
    share = lambda c, when: F.avg(F.when(when, c.cast("int")))
    out = df.groupBy("trip_id").agg(
        _median(F.col("_dt"), F.col("_dt") > 0).alias("dt_median_s"), F.when(F.max(F.abs(v)) > 0, F.min(v)).otherwise(F.coalesce(F.min(kmh), F.min(v))).alias("_least"), _median(v, F.col("seq") < tail).alias("_start"), _median(v, F.col("_n") - F.col("seq") <= tail).alias("_end"),
        F.coalesce(_median(v, moving), F.lit(0.0)).alias("v_median_mps"), F.coalesce(F.stddev_pop(F.when(moving, F.coalesce("acc_x", F.lit(0.0)))), F.lit(0.0)).alias("std_ax"),
        F.coalesce(F.stddev_pop(F.when(moving, gz)), F.lit(0.0)).alias("std_gz"), F.coalesce(_median(F.abs(ay - v * gz), turn), F.lit(0.0)).alias("lat_err_med"),
        F.coalesce(share((radius > 10) & (radius < 3000), turn), F.lit(1.0)).alias("radius_gz_ratio"), _median(radius, turn).alias("radius_gz_med"),
        F.coalesce(share((radius_ay > 10) & (radius_ay < 3000), turn), F.lit(1.0)).alias("radius_ay_ratio"), _median(radius_ay, turn).alias("radius_ay_med"), F.max(turn).alias("_turns"),
    )
    checks = {
        "cadence_ok": F.coalesce(F.abs(F.col("dt_median_s") - 1 / hz) < 0.02, F.lit(False)), "speed_nonnegative": F.col("_least") >= -1e-6, "start_zero": F.col("_start") < 0.6, "end_zero": F.col("_end") < 0.6,
        "ax_variability": F.col("std_ax") > 0.02, "gz_variability": F.col("std_gz") > 0.002, "lateral_consistency": ~F.col("_turns") | (F.col("lat_err_med") < 0.5), "turn_radius_plausible": ~F.col("_turns") | (F.col("radius_gz_ratio") > 0.7),
    }
    return out.withColumns(checks).withColumn("hz_obs", 1 / F.col("dt_median_s")).drop("_least", "_start", "_end", "_turns")


CHECKS = ("cadence_ok", "start_zero", "end_zero", "speed_nonnegative", "ax_variability", "gz_variability", "lateral_consistency", "turn_radius_plausible")


def qa_report(df: DataFrame, hz: float = 10.0) -> DataFrame:
    """The checklist with the failed checks and OK or KO."""
    failed = F.array_compact(F.array(*(F.when(~F.col(c), F.lit(c)) for c in CHECKS)))
    return checklist(df, hz).withColumn("failed", F.concat_ws(", ", failed)).withColumn("ok", F.col("failed") == "").withColumn("summary", F.when(F.col("ok"), "OK").otherwise(F.concat(F.lit("KO: "), "failed")))


def _coherence_rows(df: DataFrame) -> DataFrame:
    """Adds step_m, the time step, the speed from positions, the median errors of both units and the speed in the better one."""
    df = step_m(df).withColumn("_raw", (F.col("ts_us") - lag("ts_us")) / 1e6)
    df = df.withColumn("_med", _median(F.col("_raw"), F.col("_raw") > 0).over(trip())).withColumn("_dt", F.when(F.col("_raw") > 0, F.col("_raw")).otherwise(F.col("_med")))
    df = df.withColumn("_geo", F.col("step_m") / F.col("_dt"))
    err = lambda v: F.abs(v - F.col("_geo"))
    df = df.withColumn("_kmh", F.median(err(F.col("speed") / 3.6)).over(trip())).withColumn("_mps", F.median(err(F.col("speed"))).over(trip()))
    return df.withColumn("_v", F.when(F.col("_mps") < F.col("_kmh"), F.col("speed")).otherwise(F.col("speed") / 3.6))


def _coherence_aggregates(most_dv: float) -> list[Column]:
    off = F.abs(F.col("_v") - F.col("_geo"))
    return [
        (1 / F.first("_med")).alias("hz_obs"), F.sum("step_m").alias("dist_geo_m"), F.sum(F.col("_v") * F.col("_dt")).alias("dist_speed_m"), F.median(off).alias("dv_median"),
        F.avg((off > most_dv).cast("int")).alias("frac_bad"), F.when(F.first("_mps") < F.first("_kmh"), "mps").otherwise("kmh").alias("speed_unit"),
    ]


def _coherence_verdict(out: DataFrame, hz: float, most_gap: float, most_dv: float, most_bad: float) -> DataFrame:
    out = out.withColumn("dist_rel_err", F.abs(F.col("dist_speed_m") - F.col("dist_geo_m")) / F.greatest("dist_geo_m", F.lit(1e-6)))
    out = out.withColumns({"hz_ok": F.abs(F.col("hz_obs") - hz) <= 0.1, "dist_ok": F.col("dist_rel_err") <= most_gap, "speed_ok": (F.col("dv_median") <= most_dv) & (F.col("frac_bad") <= most_bad)})
    return out.withColumn("coherent", F.col("hz_ok") & F.col("dist_ok") & F.col("speed_ok"))


def coherence(df: DataFrame, hz: float = 10.0, most_gap: float = 0.03, most_dv: float = 2.0, most_bad: float = 0.01) -> DataFrame:
    """Whether time, distance and speed agree. The unit of speed is the one with the smaller median error against positions."""
    return _coherence_verdict(_coherence_rows(df).groupBy("trip_id").agg(*_coherence_aggregates(most_dv)), hz, most_gap, most_dv, most_bad)


def falling(values: DataFrame, value: str, types: tuple[str, ...] = ROAD_ORDER, tolerance: float = 15.0) -> DataFrame:
    """(trip_id, road_type, value) -> trip_id, ordered: the value does not rise along the road types by more than the tolerance,
    but for a rise from under 25 to over 45."""
    rank = F.array_position(F.array(*(F.lit(t) for t in types)), F.col("road_type"))
    before = F.lag(value).over(W.partitionBy("trip_id").orderBy("_rank"))
    rows = values.withColumn("_rank", rank).where("_rank > 0").withColumn("_before", before)
    bad = (F.col("_before") + tolerance < F.col(value)) & ~((F.col("_before") < 25) & (F.col(value) > 45))
    return rows.groupBy("trip_id").agg((~F.coalesce(F.bool_or(bad), F.lit(False))).alias("ordered"))


def speed_vs_roadtype(df: DataFrame) -> DataFrame:
    return falling(df.groupBy("trip_id", "road_type").agg(F.avg(F.col("speed") * 3.6).alias("v")), "v")


def _stop_rows(df: DataFrame) -> DataFrame:
    """Adds, on the first row of each stop block, the rows since the last stop row before it (0 for the first block)."""
    stop = F.coalesce(F.col("event") == "stop", F.lit(False))
    df = df.withColumn("_stop", stop)
    last = F.last(F.when(F.col("_stop"), F.col("seq")), ignorenulls=True).over(ordered().rowsBetween(W.unboundedPreceding, -1))
    fresh = F.col("_stop") & ~F.coalesce(lag("_stop"), F.lit(False))
    return df.withColumn("_gap", F.when(fresh, F.coalesce(F.col("seq") - last, F.lit(0))))


def _stop_aggregates() -> list[Column]:
    return [F.count("_gap").alias("n_stops"), F.min(F.when(F.col("_gap") > 0, F.col("_gap"))).alias("_least_gap"), F.count("event").alias("_labels")]


def _stop_verdict(least: int) -> Column:
    return F.when(F.col("n_stops") == 0, F.col("_labels") <= 10).otherwise(F.coalesce(F.col("_least_gap") > least, F.lit(True)) | (F.col("n_stops") <= 6))


def stop_spacing(df: DataFrame, least: int = 800) -> DataFrame:
    """Per trip: stop blocks, and whether all gaps between them are over ``least`` rows; up to 6 blocks, or none among up to 10
    labels, are tolerated."""
    return _stop_rows(df).groupBy("trip_id").agg(*_stop_aggregates()).select("trip_id", "n_stops", _stop_verdict(least).alias("stop_spacing_ok"))


def realism_report(df: DataFrame) -> DataFrame:
    """One row a trip: frequency, ends, smoothness, jumps, variability, labels, spacing and coherence, plus counts of point events.
    All of it is one pass: one shuffle, one sort and one aggregate."""
    kmh = F.col("speed") * 3.6
    rows = _stop_rows(_coherence_rows(df)).withColumn("_dv", F.abs(kmh - lag(kmh)))
    # variability counts where the trip moves and no event shakes it, from 10 such rows on; the ends belong to the gyroscope's range only
    moving = F.coalesce((F.col("speed") > 0.2) & ~F.coalesce(F.col("event").isin(*POINT_EVENTS, "ouverture_porte"), F.lit(False)), F.lit(False))
    std = lambda c: F.when(F.count_if(moving) >= 10, F.stddev_samp(F.when(moving, F.col(c))))
    inside = lambda s, v: (v > 0.05) & (v < 4.0) if s == "acc" else v.between(0.01, 60.0)
    has = lambda e: F.coalesce(F.bool_or(F.col("event").isin(e, f"{e}_start")), F.lit(False))
    checks = [
        (F.abs(F.median("_raw") - 0.1) < 0.01).alias("frequency_ok"), (F.min_by(kmh, "seq") <= 1).alias("starts_at_zero"), (F.max_by(kmh, "seq") <= 1).alias("ends_at_zero"),
        (F.coalesce(F.max("_dv"), F.lit(0.0)) <= 20).alias("smooth"), (F.max("step_m") <= 50).alias("no_jumps"), (F.stddev_samp(kmh) > 0.5).alias("speed_varies"),
        *(F.coalesce(inside(s, std(f"{s}_{a}")), F.lit(False)).alias(f"{s}_{a}_varies") for s in ("acc", "gyro") for a in "xyz"),
        has("stop").alias("has_stop"), has("wait").alias("has_wait"), *(F.count_if(F.col("event") == e).alias(f"n_{e}") for e in POINT_EVENTS),
        (F.max("speed") * 3.6).alias("max_kmh"), (F.count_if(F.col("speed") != 0) == 0).alias("all_zero"), F.count_if(F.col("speed").isNull()).alias("null_speeds"),
    ]
    helpers = ["hz_obs", "dist_geo_m", "dist_speed_m", "dv_median", "frac_bad", "speed_unit", "dist_rel_err", "hz_ok", "dist_ok", "speed_ok", "_least_gap", "_labels"]
    out = rows.groupBy("trip_id").agg(*checks, *_stop_aggregates(), *_coherence_aggregates(2.0))
    return _coherence_verdict(out, 10.0, 0.03, 2.0, 0.01).withColumn("stop_spacing_ok", _stop_verdict(800)).drop(*helpers)


def basic_checks(df: DataFrame) -> DataFrame:
    """Times that fall, times that repeat, and nulls in any required column, per trip."""
    need = ("ts_us", "lat", "lon", "speed", "acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z")
    rows = df.withColumn("_d", F.col("ts_us") - lag("ts_us"))
    nulls = sum((F.col(c).isNull().cast("int") for c in need), F.lit(0))
    return rows.groupBy("trip_id").agg(F.count_if(F.col("_d") < 0).alias("n_falling"), F.count_if(F.col("_d") == 0).alias("n_equal"), F.sum(nulls).alias("n_nulls"))


def duplicate_keys(df: DataFrame) -> DataFrame:
    """Keys (time to 0.1 s, place to 6 decimals) that several rows of a trip share."""
    return round_keys(df).groupBy("trip_id", "t_key", "lat_key", "lon_key").agg(F.count("*").alias("n")).where("n > 1")


def _first_offenders(names: list[str], counted: list[str], most: int) -> Callable:
    """(key, one flag a name) -> of each name the number of its rows and, but for ``counted`` ones, the ``most`` smallest keys, once a task."""

    def smallest(keys: pa.StructArray) -> pa.StructArray:
        order = [(f.name, "ascending") for f in keys.type]
        return keys.take(pc.sort_indices(pa.Table.from_struct_array(keys), order, null_placement="at_start")[:most])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        first: dict[str, pa.StructArray] = {}
        kind = None
        for batch in batches:
            keys = batch.column(0)
            kind = keys.type
            for k, flags in zip(names, batch.columns[1:]):
                n[k] += flags.true_count
                if flags.true_count and k not in counted:
                    first[k] = smallest(pa.concat_arrays([*([first[k]] if k in first else []), keys.filter(flags)]))
        found = [k for k in names if n[k]]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([n[k] for k in found]), pa.array([first[k].to_pylist() if k in first else [] for k in found], pa.list_(kind))], names=["k", "n_bad", "offenders"])

    return count


def validate_dataset(df: DataFrame, rules: dict[str, dict], strict_order: bool = False, most: int = 5, keys: tuple[str, ...] = ("trip_id", "seq"), nulls: bool = False) -> DataFrame:
    """One row a rule that can fail: column, rule, n_bad, and offenders, the keys of the first ``most`` rows that break it.

    rules: column -> {"nullable": bool, "values": [...], "type": "double"}, in the order of the schema. Rules: missing (all rows are bad), null, value,
    type (what is there can't be cast); with ``strict_order`` also order, with n_bad 1 if the first columns are not those of the schema; and extra, a
    remark with n_bad 0, for each other column. nulls: also count, the nulls of each column, without offenders. One pass: a task counts and keeps the first
    offenders of each rule, so their lists stay short. Rules that the schema decides read no rows.
    """
    bad: dict[tuple[str, str], Column] = {}
    fixed = [("*", "order", int(list(df.columns[: len(rules)]) != list(rules)))] if strict_order and all(c in df.columns for c in rules) else []
    fixed += [(c, "extra", 0) for c in df.columns if c not in rules]
    for c, rule in rules.items():
        if c not in df.columns:
            bad[c, "missing"] = F.lit(True)
            continue
        if not rule.get("nullable", True):
            bad[c, "null"] = F.col(c).isNull()
        if "values" in rule:
            bad[c, "value"] = F.col(c).isNotNull() & ~F.col(c).isin(rule["values"])
        if "type" in rule:
            bad[c, "type"] = F.expr(f"`{c}` IS NOT NULL AND try_cast(`{c}` AS {rule['type']}) IS NULL")
    counts = {(c, "count"): F.col(c).isNull() for c in df.columns} if nulls else {}
    names = [f"{c}|{r}" for c, r in [*bad, *counts]]
    rows = df.select(F.struct(*keys).alias("key"), *(F.coalesce(v, F.lit(False)).alias(f"f{i}") for i, v in enumerate([*bad.values(), *counts.values()])))
    kind = rows.schema["key"].dataType
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("n_bad", T.LongType()), T.StructField("offenders", T.ArrayType(kind))])
    firsts = F.slice(F.array_sort(F.flatten(F.collect_list("offenders"))), 1, most).alias("offenders")
    look = _first_offenders(names, names[len(bad) :], most)
    parts = rows.mapInArrow(look, schema).groupBy("k", (F.spark_partition_id() % 1000).alias("p")).agg(F.sum("n_bad").alias("n_bad"), firsts)
    found = parts.groupBy("k").agg(F.sum("n_bad").alias("n_bad"), firsts)
    none = F.array().cast(T.ArrayType(kind))
    listed = _listed(df, [(c, r, f"{c}|{r}") for c, r in [*bad, *counts]], "column string, rule string, k string")
    measured = listed.join(found, "k", "left").select("column", "rule", F.coalesce("n_bad", F.lit(0)).cast("long").alias("n_bad"), F.coalesce("offenders", none).alias("offenders"))
    return measured.unionByName(_listed(df, fixed, "column string, rule string, n_bad long").withColumn("offenders", none))


def _listed(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """Rows as literals of the plan: a filter that leaves none of them also drops what is joined to them."""
    if not rows:
        return df.sparkSession.createDataFrame([], schema)
    literal = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({', '.join(map(literal, r))})" for r in rows)
    fields = [f.split() for f in schema.split(", ")]
    return df.sparkSession.sql(f"SELECT * FROM VALUES {values}").toDF(*(n for n, _ in fields)).select(*(F.col(n).cast(t) for n, t in fields))


def imu_coherence(df: DataFrame) -> DataFrame:
    """Lateral acceleration against speed times yaw rate: rmse, 95th percentile, share over 0.2, and turn radii."""
    moving = F.col("speed") > 0.5
    r = F.abs(F.col("acc_y") - F.col("speed") * F.col("gyro_z"))
    radius = F.when(moving & (F.abs("gyro_z") > 0), F.col("speed") / F.abs("gyro_z"))
    on = lambda c: F.when(moving, c)
    q = F.percentile(radius, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = df.groupBy("trip_id").agg(F.sqrt(F.avg(on(r * r))).alias("rmse"), F.percentile(on(r), F.lit(0.95)).alias("p95"), F.avg(on((r > 0.2).cast("int"))).alias("bad_ratio"), q.alias("_q"))
    return out.select("trip_id", "rmse", "p95", "bad_ratio", *(F.col("_q")[i].alias(f"radius_{p}") for i, p in enumerate(("p10", "p50", "p90"))))




def detect_speed_unit(df: DataFrame) -> DataFrame:
    """trip_id, speed_unit: 'mps' if speed as it stands is nearer to the positions, by median error, than speed over 3.6."""
    return coherence(df).select("trip_id", "speed_unit")


def imu_errors(df: DataFrame) -> DataFrame:
    """The measured signals against those that speed and positions imply (``expected_imu``): trip_id, signal, n, bias, rmse."""
    rows = expected_imu(df)
    pairs = F.array(*(F.struct(F.lit(s).alias("signal"), (F.col(s) - F.col(f"exp_{s}")).alias("d")) for s in ("acc_x", "acc_y", "gyro_z")))
    each = rows.select("trip_id", F.explode(pairs).alias("e"))
    return each.groupBy("trip_id", "e.signal").agg(F.count("e.d").alias("n"), F.avg("e.d").alias("bias"), F.sqrt(F.avg(F.col("e.d") * F.col("e.d"))).alias("rmse"))


def max_speed_ok(df: DataFrame, most_kmh: float = 130.0) -> DataFrame:
    """Per trip: the largest speed (m/s in, km/h out) and whether it is within the limit."""
    return df.groupBy("trip_id").agg((F.max("speed") * 3.6).alias("max_kmh")).withColumn("max_speed_ok", F.coalesce(F.col("max_kmh") <= most_kmh, F.lit(True)))


def integrity_flags(df: DataFrame, least_std: float = 1e-3) -> DataFrame:
    """Per trip: speed 0 throughout, missing speeds, and accelerations that hardly vary."""
    flat = lambda c: (F.coalesce(F.stddev_samp(c), F.lit(0.0)) < least_std).alias(f"{c}_flat")
    return df.groupBy("trip_id").agg((F.coalesce(F.max(F.abs("speed")), F.lit(0.0)) == 0).alias("all_zero"), F.count_if(F.col("speed").isNull()).alias("null_speeds"), flat("acc_x"), flat("acc_y"))


def elevation_quality(df: DataFrame, low: float = -450.0, high: float = 9000.0, most: float = 0.01) -> DataFrame:
    """Per trip: the share of altitudes that are missing or out of range, and whether it is small enough."""
    bad = F.avg((~F.coalesce(F.col("altitude").between(low, high), F.lit(False))).cast("int"))
    return df.groupBy("trip_id").agg(bad.alias("reject_rate")).withColumn("elevation_ok", F.col("reject_rate") <= most)


def plateaus_vs_roadtype(plateaus: DataFrame) -> DataFrame:
    """Plateaus (trip_id, road_type, mean_kmh) -> trip_id, ordered: their medians fall along five road types, by the rule of ``falling``."""
    medians = plateaus.groupBy("trip_id", "road_type").agg(F.median("mean_kmh").alias("v"))
    return falling(medians, "v", ROAD_ORDER[:5])
