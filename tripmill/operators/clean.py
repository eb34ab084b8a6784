"""Cleaning and repair of traces with native windows; sequential repairs are in ``recurrences``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripmill.functions.labels import ALIASES, POINT_EVENTS, is_blank, lookup
from tripmill.functions.rounding import with_rounded
from tripmill.functions.windows import bfill, ffill, islands, lag, so_far, spans, trip
from tripmill.operators.kinematics import clip, dt_s, gps_speed, step_m


def clean_invalid_rows(df: DataFrame) -> DataFrame:
    """Blank labels become null; rows without position or time go."""
    return df.withColumn("event", F.when(is_blank(F.col("event")), None).otherwise(F.col("event"))).dropna(subset=["lat", "lon", "ts_us"])


def drop_nonfinite(df: DataFrame) -> DataFrame:
    """Infinite numbers become null; rows without finite lat, lon, speed or time go."""
    finite = lambda c: F.when(F.abs(c) < float("inf"), F.col(c))  # noqa: E731  (NaN counts as more than infinity)
    doubles = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: finite(c) for c in doubles}).dropna(subset=["lat", "lon", "speed", "ts_us"])


def clamp_ranges(df: DataFrame, most_speed: float = 160.0, most_acc: float = 15.0) -> DataFrame:
    bounded = {c: clip(F.col(c), -most_acc, most_acc) for c in ("acc_x", "acc_y", "acc_z") if c in df.columns}
    return df.withColumns({"speed": clip(F.col("speed"), 0.0, most_speed), **bounded})


def clip_imu(df: DataFrame) -> DataFrame:
    return df.withColumns({"speed": clip(F.col("speed"), 0.0, 150.0), "acc_x": clip(F.col("acc_x"), -20.0, 20.0), "acc_y": clip(F.col("acc_y"), -20.0, 20.0), "acc_z": clip(F.col("acc_z"), -30.0, 30.0)})


def event_null_policy(df: DataFrame, ratio: float = 0.3) -> DataFrame:
    """Missing labels become 'unknown' in trips where their share is over ``ratio``, else ''."""
    share = F.avg(F.col("event").isNull().cast("int")).over(trip())
    return df.withColumn("event", F.coalesce("event", F.when(share > ratio, "unknown").otherwise("")))


def valid_coords(df: DataFrame) -> DataFrame:
    return df.where("abs(lat) <= 90 AND abs(lon) <= 180")


def round_keys(df: DataFrame) -> DataFrame:
    """t_key (0.1 s), lat_key and lon_key (6 decimals), half to even."""
    df = with_rounded(df, {"t_key": F.col("ts_us") / 1e6}, 1, even=True)
    return with_rounded(df, {"lat_key": F.col("lat"), "lon_key": F.col("lon")}, 6, even=True)


def canonical_events(df: DataFrame) -> DataFrame:
    label = F.trim("event")
    return df.withColumn("event", F.coalesce(lookup(ALIASES, label), label))


def drop_leading_stop(df: DataFrame, anywhere: bool = True) -> DataFrame:
    """Clears the first 'stop' label of a trip; not ``anywhere``: only one on its first row."""
    if not anywhere:
        return df.withColumn("event", F.when((F.col("event") == "stop") & (F.col("seq") == 0), None).otherwise(F.col("event")))
    nth = F.sum(F.when(F.col("event") == "stop", 1).otherwise(0)).over(so_far())
    return df.withColumn("event", F.when((F.col("event") == "stop") & (nth == 1), None).otherwise(F.col("event")))


def filter_geo_spikes(df: DataFrame, most_kmh: float = 180.0, hard_m: float = 500.0, margin_m: float = 30.0) -> DataFrame:
    """Flags samples whose step is over what the speed allows; a flagged run is drawn linearly, by position, between the samples
    around it, a run at the end of a trip holds the last good one. Speed is then computed anew where a trip had a spike."""
    df = dt_s(step_m(df, "_step"), "_dt")
    most = F.least(most_kmh / 3.6 * F.col("_dt") + margin_m, F.lit(hard_m))
    df = df.withColumn("flag_geo_spike", (F.col("_step") > most).cast("int"))
    good = lambda c: F.when(F.col("flag_geo_spike") == 0, F.col(c))
    df = df.withColumns({f"_{side}_{c}": fn(good(c)) for side, fn in (("a", ffill), ("b", bfill)) for c in ("lat", "lon", "seq")})
    share = (F.col("seq") - F.col("_a_seq")) / (F.col("_b_seq") - F.col("_a_seq"))
    drawn = lambda c: F.coalesce((1 - share) * F.col(f"_a_{c}") + share * F.col(f"_b_{c}"), F.col(f"_a_{c}"))
    spike = F.col("flag_geo_spike") == 1
    df = df.withColumn("_any", F.max("flag_geo_spike").over(trip()))
    df = df.withColumns({c: F.when(spike, drawn(c)).otherwise(F.col(c)) for c in ("lat", "lon")})
    df = gps_speed(df).withColumn("speed", F.when(F.col("_any") == 1, F.col("gps_speed_mps")).otherwise(F.col("speed")))
    return df.drop(*(c for c in df.columns if c.startswith("_")), "gps_speed_mps", "gps_speed_kmh")


def enforce_immobility(df: DataFrame, labels: tuple[str, ...] = ("stop", "wait")) -> DataFrame:
    """Every run of stop or wait labels stands still at its median position."""
    mask = F.lower("event").rlike("|".join(labels))
    df = islands(df, mask, "_run")
    still = F.col("_run").isNotNull()
    # rows of a trip lie together already, so this is a sort and no shuffle; moving rows bring no values to a median
    place = lambda c: F.median(F.when(still, F.col(c))).over(W.partitionBy("trip_id", "_run"))
    df = df.withColumns({f"_m_{c}": place(c) for c in ("lat", "lon")})
    df = df.withColumns({c: F.when(still, F.col(f"_m_{c}")).otherwise(F.col(c)) for c in ("lat", "lon")})
    zero = [c for c in ("speed", "speed_kmh", "step_m", "distance_m", "delta_m") if c in df.columns]
    return df.withColumns({c: F.when(still, 0.0).otherwise(F.col(c)) for c in zero}).drop("_run", "_m_lat", "_m_lon")


def limit_jump_chain(df: DataFrame, most: float = 30.0, c: str = "speed") -> DataFrame:
    """Where the original value jumps by more than ``most``, the previous (repaired) value moves by ``most`` that way. A run of
    jumps is its base plus ``most`` times the running sum of signs."""
    df = df.withColumn("_d", F.col(c) - lag(c)).withColumn("_j", F.coalesce(F.abs("_d") > most, F.lit(False)))
    df = df.withColumn("_base", ffill(F.when(~F.col("_j"), F.col(c)))).withColumn("_s", F.sum(F.when(F.col("_j"), F.signum("_d")).otherwise(0)).over(so_far()))
    df = df.withColumn("_s0", ffill(F.when(~F.col("_j"), F.col("_s"))))
    return df.withColumn(c, F.when(F.col("_j"), F.col("_base") + most * (F.col("_s") - F.col("_s0"))).otherwise(F.col(c))).drop("_d", "_j", "_base", "_s", "_s0")


def limit_to_target(df: DataFrame, margin_kmh: float = 3.0) -> DataFrame:
    """Speed (m/s) not over the target (km/h) plus a margin; no target, no limit."""
    limit = (F.col("target_speed") + margin_kmh) / 3.6
    return df.withColumn("speed", F.least("speed", F.coalesce(limit, F.lit(float("inf")))))


def limit_to_target_ramp(df: DataFrame, rate: float = 2.0, margin_kmh: float = 3.0) -> DataFrame:
    """As ``limit_to_target``, but never falling faster than ``rate`` m/s2: the running maximum of v + rate * t, less rate * t."""
    df = limit_to_target(df, margin_kmh).withColumn("_t", (F.col("ts_us") - F.first("ts_us").over(so_far())) / 1e6)
    return df.withColumn("speed", F.max(F.col("speed") + rate * F.col("_t")).over(so_far()) - rate * F.col("_t")).drop("_t")


def dedupe_labels(df: DataFrame) -> DataFrame:
    """Clears a label that equals the one two rows back over a blank, then one that equals the previous; both steps twice."""
    for _ in range(2):
        label = F.when(is_blank(F.col("event")), None).otherwise(F.col("event"))
        df = df.withColumn("event", label)
        df = df.withColumn("event", F.when((F.col("event") == lag("event", 2)) & lag("event").isNull(), None).otherwise(F.col("event")))
        df = df.withColumn("event", F.when(F.col("event") == lag("event"), None).otherwise(F.col("event")))
    return df


def dedupe_time_event(df: DataFrame) -> DataFrame:
    """Of rows of a trip with one time and label, all but the first lose the label."""
    nth = F.row_number().over(W.partitionBy("trip_id", "ts_us", "event").orderBy("seq"))
    return df.withColumn("event", F.when(nth == 1, F.col("event")))


def strictly_increasing_ts(df: DataFrame) -> DataFrame:
    """Rows in order of time and seq, numbered anew; equal times go on by 1 ms each."""
    order = trip().orderBy("ts_us", "seq")
    df = df.withColumn("seq", (F.row_number().over(order) - 1).cast("int"))
    # t[i] = max(t[i], t'[i-1] + 1 ms): the running maximum of t - i ms, plus i ms
    return df.withColumn("ts_us", F.max(F.col("ts_us") - 1000 * F.col("seq")).over(so_far()) + 1000 * F.col("seq"))


def fill_coordinates(df: DataFrame) -> DataFrame:
    """Missing positions drawn linearly by row between the known ones, else the nearest known."""
    for c in ("lat", "lon"):
        at = F.when(F.col(c).isNotNull(), F.col("seq"))
        df = df.withColumns({"_a": ffill(c), "_b": bfill(c), "_i": ffill(at), "_j": bfill(at)})
        share = (F.col("seq") - F.col("_i")) / (F.col("_j") - F.col("_i"))
        df = df.withColumn(c, F.coalesce(F.col(c), F.col("_a") + share * (F.col("_b") - F.col("_a")), F.col("_b"), F.col("_a")))
    return df.drop("_a", "_b", "_i", "_j")


def sort_and_dropna(df: DataFrame) -> DataFrame:
    """Rows without time go, then rows with any null; the rest in order of time, numbered anew."""
    df = df.dropna()
    return df.withColumn("seq", (F.row_number().over(trip().orderBy("ts_us", "seq")) - 1).cast("int"))


def clean_trace(df: DataFrame) -> DataFrame:
    return fill_coordinates(sort_and_dropna(event_null_policy(limit_jump_chain(clamp_ranges(df)))))


def lock_start(df: DataFrame, seconds: float = 2.0, hz: float = 10.0) -> DataFrame:
    """The first rows stand at the first position with speed 0; blank labels there become 'stop', moving or not."""
    head = F.col("seq") < round(seconds * hz)
    first = lambda c: F.first(c).over(so_far())
    return df.withColumns({"lat": F.when(head, first("lat")).otherwise(F.col("lat")), "lon": F.when(head, first("lon")).otherwise(F.col("lon")), "speed": F.when(head, 0.0).otherwise(F.col("speed")), "event": F.when(head & is_blank(F.col("event")), "stop").otherwise(F.col("event"))})


def lock_end(df: DataFrame, seconds: float = 8.0) -> DataFrame:
    """The last seconds stand at the last position, flag_stop 1; the first of these rows is labelled final_deceleration."""
    tail = F.col("ts_us") >= F.max("ts_us").over(trip()) - int(seconds * 1e6)
    df = df.withColumn("_tail", tail)
    end = lambda c: F.max_by(c, "seq").over(trip())
    first = F.col("_tail") & ~F.coalesce(lag("_tail"), F.lit(False))
    values = {"lat": F.when(F.col("_tail"), end("lat")).otherwise(F.col("lat")), "lon": F.when(F.col("_tail"), end("lon")).otherwise(F.col("lon")), "event": F.when(first, "final_deceleration").otherwise(F.col("event"))}
    if "flag_stop" in df.columns:
        values["flag_stop"] = F.when(F.col("_tail"), 1).otherwise(F.col("flag_stop"))
    return df.withColumns(values).drop("_tail")


def zero_ends(df: DataFrame, rows: int = 10) -> DataFrame:
    """Head := 0 if its median is under 0.6 or its 80th percentile under 1 m/s; tail := 0 if its median is under 0.4. A trip shorter
    than its head, or no longer than its tail, keeps it."""
    n = F.count("*").over(trip())
    df = df.withColumn("_head", (F.col("seq") < rows) & (n >= rows)).withColumn("_tail", (n - F.col("seq") <= rows) & (n > rows))
    q = lambda part, p: F.percentile(F.when(F.col(part), F.col("speed")), F.lit(p)).over(trip())
    still = (F.col("_head") & ((q("_head", 0.5) < 0.6) | (q("_head", 0.8) < 1.0))) | (F.col("_tail") & (q("_tail", 0.5) < 0.4))
    return df.withColumn("_still", still).withColumn("speed", F.when(F.col("_still"), 0.0).otherwise(F.col("speed"))).drop("_head", "_tail", "_still")


def merge_blocks(df: DataFrame, label: str, gap: int) -> DataFrame:
    """Gaps of fewer than ``gap`` unlabelled rows inside blocks of ``label`` take the label; so a gap of 1 changes nothing."""
    before = ffill(F.when(F.col("event") == label, F.col("seq")))
    after = bfill(F.when(F.col("event") == label, F.col("seq")))
    inside = F.coalesce(after - before - 1 < gap, F.lit(False)) & ~F.coalesce(F.col("event") == label, F.lit(False))
    return df.withColumn("_in", inside).withColumn("event", F.when(F.col("_in"), label).otherwise(F.col("event"))).drop("_in")


def remove_events(df: DataFrame, ids: list[str]) -> DataFrame:
    gone = F.col("event_id").isin(ids)
    return df.withColumns({c: F.when(gone, None).otherwise(F.col(c)) for c in ("event", "event_type", "idx_anchor", "t_anchor", "event_id") if c in df.columns})


def lock_mid_stops(df: DataFrame, head: int = 10, tail: int = 10, blend: int = 5) -> DataFrame:
    """Speed 0 from ``head`` rows before to ``tail`` rows after each stop or wait run, with linear blends outside; where runs
    overlap, the later decides. Runs are spread to the rows that they touch and joined back by row."""
    runs = spans(df, F.upper("event").isin("STOP", "WAIT"))
    size = df.groupBy("trip_id").agg((F.max("seq") + 1).alias("n"))
    runs = runs.join(size, "trip_id").select("trip_id", "run_id", F.greatest(F.col("start_seq") - head, F.lit(0)).alias("i0"), F.least(F.col("end_seq") + tail, F.col("n") - 1).alias("i1"), "n")
    rows = runs.withColumn("seq", F.explode(F.sequence(F.greatest(F.col("i0") - blend, F.lit(0)), F.least(F.col("i1") + blend, F.col("n") - 1))))
    up = F.col("i0") - F.greatest(F.col("i0") - blend, F.lit(0))
    down = F.least(F.col("i1") + 1 + blend, F.col("n")) - F.col("i1") - 1
    factor = F.when(F.col("seq") < F.col("i0"), 1 - (F.col("seq") - (F.col("i0") - up)) / up).when(F.col("seq") > F.col("i1"), (F.col("seq") - F.col("i1") - 1) / down).otherwise(0.0)
    last = rows.withColumn("f", factor).groupBy("trip_id", "seq").agg(F.max_by("f", "run_id").alias("_f"))
    return df.join(last, ["trip_id", "seq"], "left").withColumn("speed", F.greatest(F.col("speed") * F.coalesce("_f", F.lit(1.0)), F.lit(0.0))).drop("_f")




def fill_imu_defaults(df: DataFrame, axes: tuple[str, ...] = ("acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z")) -> DataFrame:
    """Accelerations and rates that are missing, no number or not finite become 0, missing labels ''."""

    def number(c: str):
        x = F.expr(f"try_cast(`{c}` AS double)") if c in df.columns else F.lit(None).cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x).otherwise(0.0)

    event = F.coalesce("event", F.lit("")) if "event" in df.columns else F.lit("")
    return df.withColumns({**{c: number(c) for c in axes}, "event": event})


def thin_consecutive(df: DataFrame, labels: tuple[str, ...] = POINT_EVENTS) -> DataFrame:
    """Clears a point event directly after the same event; of a run of equal ones each looks at the label as it was."""
    again = F.col("event").isin(list(labels)) & (lag("event") == F.col("event")) & (lag("seq") == F.col("seq") - 1)
    return df.withColumn("_again", F.coalesce(again, F.lit(False))).withColumn("event", F.when(~F.col("_again"), F.col("event"))).drop("_again")


def iso_utc(c) -> "F.Column":
    """Microseconds since the epoch as YYYY-MM-DDTHH:MM:SS.ffffffZ, whatever the session's time zone."""
    us = F.col(c) if isinstance(c, str) else c
    rest = F.pmod(us, F.lit(86_400_000_000))
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), div(us - rest, 86_400_000_000).cast("int")), "yyyy-MM-dd")
    # 1hhmmssffffff as one number: its digits need no formatter
    digits = (10**12 + div(rest, 3_600_000_000) * 10**10 + div(rest, 60_000_000) % 60 * 10**8 + div(rest, 1_000_000) % 60 * 10**6 + rest % 1_000_000).cast("string")
    at = lambda i, n: F.substring(digits, i, n)
    return F.concat(day, F.lit("T"), at(2, 2), F.lit(":"), at(4, 2), F.lit(":"), at(6, 2), F.lit("."), at(8, 6), F.lit("Z"))


def altitude_alias(df: DataFrame) -> DataFrame:
    """altitude_m from altitude, where there is none yet."""
    return df.withColumn("altitude_m", F.col("altitude")) if "altitude" in df.columns and "altitude_m" not in df.columns else df


def number_deliveries(df: DataFrame, prefix: str = "stop_", flag: str = "delivery") -> DataFrame:
    """Rows with the flag get the labels stop_001, stop_002, ... in order."""
    on = F.coalesce(F.col(flag), F.lit(False))
    nth = F.sum(F.when(on, 1).otherwise(0)).over(so_far())
    return df.withColumn("event", F.when(on, F.format_string("%s%03d", F.lit(prefix), nth)).otherwise(F.col("event")))


def to_g(df: DataFrame, *axes: str, milli: bool = False) -> DataFrame:
    """<axis>_g in units of 9.80665 m/s2, or <axis>_mg in thousandths of 9.81 m/s2."""
    return df.withColumns({f"{a}_mg" if milli else f"{a}_g": F.col(a) / 9.81 * 1000 if milli else F.col(a) / 9.80665 for a in axes})


def target_speed_diff(df: DataFrame) -> DataFrame:
    return df.withColumn("speed_diff", F.col("speed") - F.col("target_speed"))


def normalize_road_type(df: DataFrame) -> DataFrame:
    return df.withColumn("road_type", F.coalesce(F.lower("road_type"), F.lit("unknown")))


def keep_road_types(df: DataFrame, types: tuple[str, ...]) -> DataFrame:
    return df.where(F.col("road_type").isin(list(types)))


def exclude_events(df: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Rows whose label is none of the given; rows without a label stay."""
    return df.where(~F.coalesce(F.col("event").isin(list(labels)), F.lit(False)))
