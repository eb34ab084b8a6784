"""The only Python-worker code of the library: true recurrences, one trip (or one trip and event type) to a group, and the stitching of plans.

Each function gets the least columns and is a small loop; detectors and thinning get only the few candidate rows that native
filters leave. Everything else about these operators stays in columns.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmill.functions.labels import EVENT_RULES, is_blank
from tripmill.functions.windows import islands
from tripmill.operators.clean import enforce_immobility
from tripmill.operators.kinematics import cumulative_distance, dt_s, gps_speed


def _per_trip(df: DataFrame, columns: list[str], out: dict[str, str], fn: Callable[[pd.DataFrame], dict[str, np.ndarray]], parts: int | None = None) -> DataFrame:
    """Applies fn to each trip's ``columns`` in order of seq; its results replace columns or come last. Keys may be of any type. The other
    columns travel along as Arrow data that no Python value is made of, so one shuffle does and nothing is joined back. parts: partitions of the result by trip, else the
    session's number, however large the table."""
    fields = [f for f in df.schema.fields if f.name not in out]
    schema = T.StructType([*fields, *(T.StructField(c, T._parse_datatype_string(t)) for c, t in out.items())])

    def run(trip: pa.Table) -> pa.Table:
        trip = trip.sort_by("seq")
        found = fn(trip.select(columns).to_pandas())
        return pa.table([*(trip.column(f.name) for f in fields), *(pa.array(np.asarray(found[c], float), from_pandas=True) for c in out)], names=schema.names)

    done = df.groupBy("trip_id").applyInArrow(run, schema)
    return done.repartition(parts, "trip_id") if parts else done


def ema(df: DataFrame, c: str = "speed", alpha: float = 0.3, out: str = "speed_ema") -> DataFrame:
    """s = (1 - alpha) * s before + alpha * x from the first value on, in [0, 150]."""
    return _per_trip(df, [c], {out: "double"}, lambda r: {out: r[c].ewm(alpha=alpha, adjust=False).mean().clip(0, 150).to_numpy()})


def slewed(v: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Each value within ``up`` and ``down`` of the one before, as it came out. Plain floats: numpy scalars cost ten times as much."""
    out, last = [], None
    for x, rise, fall in zip(v.astype(float).tolist(), up.tolist(), down.tolist()):
        last = x if last is None else min(max(x, last - fall), last + rise)
        out.append(last)
    return np.array(out, float)


#: The change of speed from one sample to the next, in m/s, that a cleaned trip may have.
SLEW = 5.0 / 3.6


def slew_limit(df: DataFrame, most: float = SLEW, c: str = "speed") -> DataFrame:
    """No change of more than ``most`` from one sample to the next."""
    return _per_trip(df, [c], {c: "double"}, lambda r: {c: slewed(r[c].to_numpy(), np.full(len(r), most), np.full(len(r), most))})


def slew_limit_dt(df: DataFrame, rate: float = 3.0, c: str = "speed") -> DataFrame:
    """No change faster than ``rate`` a second; never below 0."""
    limited = _per_trip(dt_s(df, "_dt"), [c, "_dt"], {c: "double"}, lambda r: {c: np.maximum(slewed(r[c].to_numpy(), rate * r["_dt"].to_numpy(), rate * r["_dt"].to_numpy()), 0)})
    return limited.drop("_dt")


def _metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    if not math.isfinite(lat1 + lon1 + lat2 + lon2):
        return math.nan
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6_371_000.0 * math.atan2(math.sqrt(a), math.sqrt(max(0.0, 1 - a)))


def _doubtful(lat: list[float], lon: list[float], fixed: np.ndarray, most: np.ndarray) -> list[int]:
    """The samples whose step may be longer than ``most``, by numpy and with room for its rounding, and the length of the trip at the end. Most steps of a
    trip are short beyond doubt, so loops look at these samples only, and at those next to what they move."""
    y, x = np.radians(np.array(lat)), np.radians(np.array(lon))
    with np.errstate(invalid="ignore"):
        a = np.sin(np.diff(y) / 2) ** 2 + np.cos(y[:-1]) * np.cos(y[1:]) * np.sin(np.diff(x) / 2) ** 2
        far = 2 * 6_371_000.0 * np.arctan2(np.sqrt(a), np.sqrt(np.maximum(0.0, 1 - a)))
        return [*(np.flatnonzero(~(far * (1 + 1e-9) + 1e-9 <= most[1:]) & ~(fixed[1:] | fixed[:-1])) + 1).tolist(), len(lat)]


def pulled_back(lat: np.ndarray, lon: np.ndarray, fixed: np.ndarray, most: np.ndarray, sweeps: int) -> tuple[np.ndarray, np.ndarray]:
    """Sweeps from the front: a sample further than ``most[i]`` from the one before is drawn towards it to just that distance."""
    still, bound, n = fixed.astype(bool), most, len(lat)
    lat, lon, fixed, most = lat.astype(float).tolist(), lon.astype(float).tolist(), still.tolist(), most.tolist()

    def draw(i: int) -> bool:
        far = _metres(lat[i - 1], lon[i - 1], lat[i], lon[i])
        if far <= most[i] + 1e-6:
            return False
        lat[i] = lat[i - 1] + most[i] / far * (lat[i] - lat[i - 1])
        lon[i] = lon[i - 1] + most[i] / far * (lon[i] - lon[i - 1])
        return True

    for _ in range(sweeps):
        moved, i, near, doubtful = False, 1, 0, _doubtful(lat, lon, still, bound)
        while i < n:
            if i > near:  # no step from here on has changed in this sweep
                i = doubtful[bisect_left(doubtful, i)]
                if i == n:
                    break
            if not fixed[i] and not fixed[i - 1] and draw(i):
                moved, near = True, i + 1
                if i + 1 < n and not fixed[i + 1] and draw(i + 1):
                    near = i + 2
            i += 1
        if not moved:
            break
    return np.array(lat, float), np.array(lon, float)


def _standing(df: DataFrame) -> DataFrame:
    return df.withColumn("_fixed", F.coalesce(F.lower("event").rlike("stop|wait"), F.lit(False)))


def cap_absolute_speed(df: DataFrame, most_kmh: float = 130.0, sweeps: int = 8, slew: float | None = None, parts: int | None = None) -> DataFrame:
    """Positions so that no step is faster than ``most_kmh``; stop and wait rows stay; speed computed anew. slew: ``slew_limit`` by it first, in the same pass."""
    df = dt_s(_standing(df), "_dt")

    def fn(r: pd.DataFrame) -> dict:
        lat, lon = pulled_back(r["lat"].to_numpy(), r["lon"].to_numpy(), r["_fixed"].to_numpy(), np.maximum(most_kmh / 3.6 * np.maximum(r["_dt"].to_numpy(), 1e-3), 1e-3), sweeps)
        limited = {} if slew is None else {"speed": slewed(r["speed"].to_numpy(), np.full(len(r), slew), np.full(len(r), slew))}
        return limited | {"lat": lat, "lon": lon}

    need, out = (["lat", "lon", "_fixed", "_dt"], ["lat", "lon"]) if slew is None else (["speed", "lat", "lon", "_fixed", "_dt"], ["speed", "lat", "lon"])
    df = _per_trip(df, need, {c: "double" for c in out}, fn, parts)
    return gps_speed(df).withColumn("speed", F.col("gps_speed_mps")).drop("_dt", "_fixed", "gps_speed_mps", "gps_speed_kmh")


def evened(lat: np.ndarray, lon: np.ndarray, fixed: np.ndarray, most: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Rounds of repairs from the front: a sample too far from the one before goes to the middle of its neighbours, then three
    quarters back if that is still too far; a step too far after it is repaired likewise and the check goes one back. A round
    makes at most 50 looks a sample, so that a rough trip can't go on for ever: what is left waits for the next round. Each round ends with a median of three away from standing samples; a round without repairs is the last."""
    n, still, bound = len(lat), fixed.astype(bool), most
    free = ~(still[:-2] | still[1:-1] | still[2:]) if n >= 3 else None
    lat, lon, fixed, most = lat.astype(float).tolist(), lon.astype(float).tolist(), still.tolist(), most.tolist()
    step = lambda i: _metres(lat[i - 1], lon[i - 1], lat[i], lon[i])

    def middle(i: int) -> None:
        for x in (lat, lon):
            x[i] = 0.5 * (x[i - 1] + x[i + 1]) if i + 1 < n else x[i - 1]

    for _ in range(rounds):
        repaired, i, budget, near, doubtful = False, 1, 50 * n, 0, _doubtful(lat, lon, still, bound)
        while i < n and budget > 0:
            if i > near:  # no step from here on has changed in this round; what is passed over counts as looked at
                at = doubtful[bisect_left(doubtful, i)]
                budget, i = budget - (at - i), at
                if i == n or budget <= 0:
                    break
            budget -= 1
            if fixed[i] or fixed[i - 1] or step(i) <= most[i]:
                i += 1
                continue
            middle(i)
            near = max(near, i + 1)
            if step(i) > most[i]:
                lat[i], lon[i] = 0.75 * lat[i - 1] + 0.25 * lat[i], 0.75 * lon[i - 1] + 0.25 * lon[i]
            if i + 1 < n and not fixed[i + 1] and step(i + 1) > most[i + 1]:
                middle(i + 1)
                near = max(near, i + 2)
            repaired, i = True, max(1, i - 1)
        if n >= 3:
            for x in (lat, lon):
                y = np.array(x)
                low, high = np.minimum(y[:-2], y[1:-1]), np.maximum(y[:-2], y[1:-1])
                x[1:-1] = np.where(free, np.maximum(low, np.minimum(high, y[2:])), y[1:-1]).tolist()
        if not repaired:
            break
    return np.array(lat, float), np.array(lon, float)


def clamp_gps_jumps(df: DataFrame, most_m: float = 3.0, rounds: int = 20, gain: float = 1.6, margin_m: float = 0.5, parts: int | None = None) -> DataFrame:
    """Repairs steps over max(most_m, gain * speed * dt + margin); stop and wait rows stay."""
    df = dt_s(_standing(df), "_dt")

    def fn(r: pd.DataFrame) -> dict:
        most = np.maximum(most_m, gain * r["speed"].fillna(0).to_numpy() * r["_dt"].to_numpy() + margin_m)
        lat, lon = evened(r["lat"].to_numpy(), r["lon"].to_numpy(), r["_fixed"].to_numpy(), most, rounds)
        return {"lat": lat, "lon": lon}

    return _per_trip(df, ["lat", "lon", "speed", "_fixed", "_dt"], {"lat": "double", "lon": "double"}, fn, parts).drop("_dt", "_fixed")


def compose_clean(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Jumps, standing still, speed from positions, slew limit, absolute limit, standing still, distance. parts: partitions between the passes."""
    df = gps_speed(enforce_immobility(clamp_gps_jumps(df, parts=parts))).withColumn("speed", F.col("gps_speed_mps")).drop("gps_speed_mps", "gps_speed_kmh")
    return cumulative_distance(enforce_immobility(cap_absolute_speed(df, slew=SLEW, parts=parts)))


def smooth_stops(df: DataFrame, in_s: float = 2.0, out_s: float = 2.0, v_in: float = 0.3, v_out: float = 1.0, hz: float = 10.0) -> DataFrame:
    """Around each run of zero speed: down to v_in before it, 0 in it, at least a ramp up to v_out after it; runs in order."""
    n_in, n_out = max(1, round(in_s * hz)), max(1, round(out_s * hz))

    def fn(r: pd.DataFrame) -> dict:
        v = r["speed"].fillna(0).to_numpy().copy()
        still = np.r_[False, v == 0, False]
        for a, b in zip(np.flatnonzero(still[1:] & ~still[:-1]), np.flatnonzero(still[:-1] & ~still[1:]) - 1):
            at = max(0, a - n_in)
            if a > at:
                v[at : a + 1] = np.minimum(np.maximum(v[at : a + 1] * np.linspace(1, 0, a - at + 1), v_in), v[at : a + 1])
            v[a : b + 1] = 0
            to = min(len(v) - 1, b + n_out)
            if to > b:
                v[b : to + 1] = np.maximum(v[b : to + 1], v_out * np.linspace(0, 1, to - b + 1))
        return {"speed": np.maximum(v, 0)}

    return _per_trip(df, ["speed"], {"speed": "double"}, fn)


def spaced(hits: DataFrame, least: int, *keys: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Of candidate rows (trip_id, keys, seq, columns to carry) the greedy choice: a row at least ``least`` samples after the last one
    kept; of one sample the first by the carried columns."""
    schema = hits.select("trip_id", *keys, "seq", *carry).schema

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["seq", *carry])
        kept, last = [], None
        for s in rows["seq"]:
            kept.append(last is None or s - last >= least)
            last = s if kept[-1] else last
        return rows[kept]

    return hits.select("trip_id", *keys, "seq", *carry).groupBy("trip_id", *keys).applyInPandas(run, schema)


def dedupe_labels_window(df: DataFrame, window: int) -> DataFrame:
    """Clears a label within ``window`` rows of the last kept one of its name; only labelled rows leave the JVM."""
    kept = spaced(df.where(~is_blank(F.col("event"))), window + 1, "event").withColumn("_kept", F.lit(True))
    joined = df.join(kept.withColumnRenamed("event", "_event"), ["trip_id", "seq"], "left")
    return joined.withColumn("event", F.when(F.col("_kept"), F.col("event"))).drop("_kept", "_event")


def min_stop_spacing(df: DataFrame, seconds: float = 60.0, hz: float = 10.0) -> DataFrame:
    """Stop blocks that start less than ``seconds`` after the last kept start lose their labels; only block starts leave the JVM."""
    df = islands(df, F.col("event") == "stop", "_run")
    starts = df.where("_run IS NOT NULL").groupBy("trip_id", "_run").agg(F.min("seq").alias("seq"))
    kept = starts.join(spaced(starts, round(seconds * hz)), ["trip_id", "seq"]).select("trip_id", "_run", F.lit(True).alias("_kept"))
    joined = df.join(kept, ["trip_id", "_run"], "left")
    return joined.withColumn("event", F.when(F.col("_run").isNotNull() & F.col("_kept").isNull(), None).otherwise(F.col("event"))).drop("_run", "_kept")


def anchor_events(candidates: DataFrame, rules: dict[str, tuple[float, float]] = EVENT_RULES) -> DataFrame:
    """(trip_id, event_type, seq, ts_us, lat, lon) -> the accepted ones: a new key (type, time to 0.1 s, place to 6 decimals), and
    at least the type's cooldown and gap from the last accepted of its type."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        cooldown, gap = rules[rows["event_type"].iloc[0]]
        kept, last, seen = [], None, set()
        for t, lat, lon in zip(np.round(rows["ts_us"] / 1e6, 1), np.round(rows["lat"], 6), np.round(rows["lon"], 6)):
            ok = (t, lat, lon) not in seen and (last is None or (abs(t - last[0]) >= cooldown and _metres(lat, lon, last[1], last[2]) >= gap))
            kept.append(ok)
            if ok:
                seen.add((t, lat, lon))
                last = (t, lat, lon)
        return rows[kept]

    need = candidates.select("trip_id", "event_type", "seq", "ts_us", "lat", "lon").where(F.col("event_type").isin(list(rules)))
    return need.groupBy("trip_id", "event_type").applyInPandas(run, need.schema)


def _speeds(lat: np.ndarray, lon: np.ndarray, first: np.ndarray, rows: np.ndarray, seconds: float) -> np.ndarray:
    """Speeds from positions at even times, plan after plan (their first places, and numbers, of rows): 0 first, as medians of three (at the ends means of two)."""
    y, x = np.radians(lat), np.radians(lon)
    cos = np.cos(y)
    a = np.sin(np.diff(y) / 2) ** 2 + cos[:-1] * cos[1:] * np.sin(np.diff(x) / 2) ** 2
    v = np.r_[0.0, 2 * 6_371_000.0 * np.arctan2(np.sqrt(a), np.sqrt(1 - a)) / seconds]
    v[first] = 0.0
    out = v.copy()
    low, high = np.minimum(v[:-2], v[1:-1]), np.maximum(v[:-2], v[1:-1])
    out[1:-1] = np.maximum(low, np.minimum(high, v[2:]))
    one, more = first[rows == 1], first[rows > 1]
    last = (first + rows - 1)[rows > 1]
    out[one], out[more], out[last] = 0.0, (v[more] + v[more + 1]) / 2, (v[last - 1] + v[last]) / 2
    return out


def _one_a_us(us: np.ndarray, lat: np.ndarray, lon: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Points of plans (n each) in order of their times, of one time the first by place. They mostly are in order, but where a leg ends and the next begins."""
    first = np.cumsum(n) - n
    ahead = np.diff(us)
    ahead[first[1:] - 1] = 1
    if (ahead < 0).any():
        order = np.lexsort((lon, lat, us, np.repeat(np.arange(len(n)), n)))
        us, lat, lon = us[order], lat[order], lon[order]
        ahead = np.diff(us)
        ahead[first[1:] - 1] = 1
    else:
        tied = np.zeros(len(us), bool)
        tied[:-1] = ahead == 0
        tied[1:] |= ahead == 0
        at = np.flatnonzero(tied)
        run = np.cumsum(np.r_[1, ahead != 0][at])
        order = at[np.lexsort((lon[at], lat[at], run))]
        lat[at], lon[at] = lat[order], lon[order]
    keep = np.r_[True, ahead != 0]
    return us[keep], lat[keep], lon[keep], np.add.reduceat(keep.astype(np.int64), first)


def _on_times(us: np.ndarray, lat: np.ndarray, lon: np.ndarray, n: np.ndarray, step: int) -> tuple[np.ndarray, ...]:
    """Points of plans (n each, at least one) in order, one a time -> the plans on grids of times from their first one, linear between points: the numbers of rows, times, lat,
    lon, speed. Grids are laid end to end, so that a row's point before it is found by counting, for all plans at once."""
    last = np.cumsum(n) - 1
    start = us[last - n + 1]
    rows = (us[last] - start) // step + 1
    first = np.cumsum(rows) - rows
    shift = start - first * step
    total = int(rows.sum())
    a = np.cumsum(np.bincount(-((np.repeat(shift, n) - us) // step), minlength=total + 1)[:total]) - 1
    ahead = lambda x: np.append(np.diff(x), 0)
    wide, up, right = ahead(us), ahead(lat), ahead(lon)
    wide[last], up[last], right[last] = 1, 0.0, 0.0
    grid = np.arange(total) * step + np.repeat(shift, rows)
    share = (grid - us[a]) / wide[a]
    lat, lon = lat[a] + share * up[a], lon[a] + share * right[a]
    return rows, grid, lat, lon, _speeds(lat, lon, first, rows, step / 1e6)


def _laid(n: np.ndarray, t0: np.ndarray, service: np.ndarray, legs: np.ndarray, start_us: int, points: Callable) -> tuple[np.ndarray, ...]:
    """Legs of n points, in order and so many a plan -> times, lat, lon of their points and of the ends of their holds, and their number in each plan. points: legs and the numbers of points in them
    -> lat, lon and seconds from the leg's start."""
    hold = (service > 0) & (n > 0)
    m = n + hold
    leg, end = np.repeat(np.arange(len(n)), m), np.cumsum(m)
    i = np.arange(len(leg)) - np.repeat(end - m, m)
    lat, lon, t = points(leg, np.minimum(i, n[leg] - 1))
    held = end[hold] - 1  # of such a leg the last point once more
    t[held] += service[hold]
    return start_us + np.floor((t0[leg] + t) * 1e6 + 0.5).astype(np.int64), lat, lon, np.add.reduceat(m, np.cumsum(legs) - legs)


def _floats(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


def stitched_plans(legs: DataFrame, hz: float, start_us: int) -> DataFrame:
    """Legs with their start t0 and points (lats, lons, times) -> their plan on a grid of times, linear between points and holds, one plan to a group:
    trip_id, seq, ts_us, lat, lon, speed. As columns the same takes a sort of all points for every step."""
    step = round(1e6 / hz)
    schema = T.StructType([T.StructField("trip_id", legs.schema["plan_id"].dataType), *T._parse_datatype_string(STITCHED).fields])

    def run(plan: pa.Table) -> pa.Table:
        plan = plan.sort_by("leg_idx").combine_chunks()
        n = plan.column("lats").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        lat, lon, t = (plan.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("lats", "lons", "times"))
        before = np.cumsum(n) - n
        points = lambda leg, i: (lat[before[leg] + i], lon[before[leg] + i], t[before[leg] + i])
        us, *at = _laid(n, *(_floats(plan.column(c).combine_chunks()) for c in ("t0", "service_s")), np.array([len(n)]), start_us, points)
        rows, grid, *values = _on_times(*_one_a_us(us, *at), step)
        return pa.table([pa.repeat(plan.column("plan_id")[0], len(grid)), pa.array(np.arange(len(grid), dtype=np.int32)), *map(pa.array, (grid, *values))], names=schema.names)

    return legs.groupBy("plan_id").applyInArrow(run, schema)


STITCHED = "seq int, ts_us long, lat double, lon double, speed double"
#: What is told of a straight leg.
STRAIGHT = ("t0", "service_s", "duration_s", "n_points", "lat1", "lon1", "lat2", "lon2")


def stitched_straight(legs: DataFrame, hz: float, start_us: int, summary: bool = False, block: int = 1 << 14) -> DataFrame:
    """``stitched_plans`` of straight legs (STRAIGHT): a plan is one row of its legs, and so many plans are done at once as have about ``block`` points and rows (of larger arrays
    each comes from the system anew, at twice the time). summary: of each plan only trip_id, n, max_speed and the mean lat of its rows, which then needn't leave the worker one by one."""
    step = round(1e6 / hz)
    columns = "n long, max_speed double, lat double" if summary else STITCHED
    schema = T.StructType([T.StructField("trip_id", legs.schema["plan_id"].dataType), *T._parse_datatype_string(columns).fields])
    plans = legs.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("leg_idx", *STRAIGHT))).alias("legs"))

    def some(of: np.ndarray, leg: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
        n, lat, lon = leg["n_points"].astype(np.int64), leg["lat1"], leg["lon1"]
        up, right, parts, seconds = leg["lat2"] - lat, leg["lon2"] - lon, leg["n_points"] - 1, leg["duration_s"]

        def points(k: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, ...]:
            s = i / parts[k]
            return lat[k] + s * up[k], lon[k] + s * right[k], s * seconds[k]

        return _on_times(*_one_a_us(*_laid(n, leg["t0"], leg["service_s"], of, start_us, points)), step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            held, ids = batch.column("legs"), batch.column("plan_id")
            of, flat = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), held.flatten()
            leg = {c: _floats(flat.field(c)) for c in STRAIGHT}
            end = np.cumsum(of)
            size = np.add.reduceat(leg["n_points"] + hz * (leg["duration_s"] + np.maximum(np.nan_to_num(leg["service_s"]), 0)), end - of)
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // block)) + 1).tolist(), len(of)]
            sums = []
            for a, b in zip(cuts, cuts[1:]):
                at = slice(end[a] - of[a], end[b - 1])
                rows, *values = some(of[a:b], {c: v[at] for c, v in leg.items()})
                first = np.cumsum(rows) - rows
                if summary:
                    _, lat, _, speed = values
                    sums.append((rows, np.maximum.reduceat(speed, first), np.add.reduceat(lat, first) / rows))
                    continue
                seq = (np.arange(len(values[0])) - np.repeat(first, rows)).astype(np.int32)
                yield pa.record_batch([ids.take(pa.array(np.repeat(np.arange(a, b), rows))), *map(pa.array, (seq, *values))], names=schema.names)
            if summary:
                yield pa.record_batch([ids, *(pa.array(np.concatenate(x)) for x in zip(*sums))], names=schema.names)

    return plans.mapInArrow(run, schema)
