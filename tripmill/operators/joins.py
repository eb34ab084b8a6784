"""Enrichment joins: lookups, as-of, nearest, containment and intervals, all as equi-joins on a key or a grid cell.

Joins within a distance take candidates from cells that are as wide as the distance at every latitude and wrap around at 180 degrees
(``functions.grid``), so nothing within it is missed. Searches without a limit go down a pyramid of cells (``grid.nearest_points``).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripmill.functions import geo
from tripmill.functions.labels import EVENT_CATEGORIES, HIGHWAY_TO_ROAD_TYPE, lookup
from tripmill.functions.grid import attach_nearest, cover, home, leaf, let, nearest_points, refine
from tripmill.functions.windows import bfill, centred, ffill, gradient, written
from tripmill.functions.zones import last_zone_at, zones_at
from tripmill.operators.kinematics import step_m
from tripmill.operators.recurrences import spaced


def highway_to_road_type(df: DataFrame, c: str = "osm_highway") -> DataFrame:
    """The road type of a highway tag: 'unknown' without one, 'other' for one that is not in the table."""
    return df.withColumn("road_type", F.when(F.col(c).isNull() | (F.col(c) == "unknown"), "unknown").otherwise(F.coalesce(lookup(HIGHWAY_TO_ROAD_TYPE, F.col(c)), F.lit("other"))))


def target_speed_by_road_type(df: DataFrame, speeds: dict[str, float]) -> DataFrame:
    """Target speed (km/h) of the road type, carried forward and back over rows without one."""
    df = df.withColumn("target_speed", lookup(speeds, F.col("road_type")))
    return df.withColumn("target_speed", F.coalesce(ffill("target_speed"), bfill("target_speed")))


def target_speed_default(df: DataFrame, speeds: dict[str, float], default: float = 50.0) -> DataFrame:
    return df.withColumn("target_speed", F.coalesce(lookup(speeds, F.col("road_type")), F.lit(default)))


def speed_caps(df: DataFrame, caps: dict[str, float], default: float = 90.0) -> DataFrame:
    """The target bounded by the road type's cap, then a mean over 21 rows."""
    df = df.withColumn("context_speed_cap_kmh", F.coalesce(lookup(caps, F.col("road_type")), F.lit(default)))
    df = df.withColumn("target_speed", F.least("target_speed", "context_speed_cap_kmh")).withColumn("_m", F.avg("target_speed").over(centred(21)))
    return df.withColumn("target_speed", F.coalesce(bfill("_m"), ffill("_m"))).drop("_m")


def event_categories(df: DataFrame, mapping: dict[str, str] = EVENT_CATEGORIES) -> DataFrame:
    """event_<category>: 1 for rows whose label is of the category; unknown and missing labels set none."""
    category = lookup(mapping, F.col("event")) if "event" in df.columns else F.lit(None)
    df = df.withColumn("_c", category)
    return df.withColumns({f"event_{c}": F.when(F.col("_c") == c, 1).otherwise(0) for c in sorted(set(mapping.values()))}).drop("_c")


def asof_event(grid: DataFrame, events: DataFrame, tolerance_us: int = 500_000) -> DataFrame:
    """Nearest event by time within a tolerance: a tie goes to the earlier time, equal times to the last row by seq. A match
    replaces the grid's own event. One shuffle: both sides in one window."""
    src = events.where("ts_us IS NOT NULL").groupBy("trip_id", "ts_us").agg(F.struct(F.max_by(F.struct("event"), "seq").getField("event").alias("event"), F.col("ts_us").alias("t")).alias("_e"))
    both = grid.withColumn("_g", F.lit(1)).unionByName(src.withColumn("_g", F.lit(0)), allowMissingColumns=True)
    order = W.partitionBy("trip_id").orderBy("ts_us", "_g")
    both = both.withColumn("_b", F.last("_e", True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    back = W.partitionBy("trip_id").orderBy(F.desc("ts_us"), F.desc("_g"))
    both = both.withColumn("_a", F.last("_e", True).over(back.rowsBetween(W.unboundedPreceding, 0)))
    gap = lambda c: F.abs(F.col("ts_us") - F.col(f"{c}.t"))
    near = F.when(F.col("_a").isNull() | (gap("_b") <= gap("_a")), F.col("_b")).otherwise(F.col("_a"))
    both = both.where("_g = 1").withColumn("_n", near)
    own = F.col("event") if "event" in grid.columns else F.lit(None)
    hit = F.when(gap("_n") <= tolerance_us, F.col("_n.event"))
    return both.withColumn("event", F.coalesce(hit, own)).drop("_g", "_e", "_a", "_b", "_n")


def nearest_road(df: DataFrame, nodes: DataFrame, size: float = 0.0005) -> DataFrame:
    """The nearest node in degree space, however far: highway_near, node_id, nearest_distance_m (true metres); ties to the smaller
    node_id. size: the cell of the first search, in degrees."""
    points = nodes.select("node_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "highway")
    out = attach_nearest(df, points, ("node_id", "highway", "_lat", "_lon"), size)
    metres = geo.haversine(F.col("lat"), F.col("lon"), F.col("n._lat"), F.col("n._lon"))
    return out.withColumns({"node_id": F.col("n.node_id"), "highway_near": F.col("n.highway"), "nearest_distance_m": metres}).drop("n")


def node_highway(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id), (src, dst, edge_order, highway) -> the tag of the first edge out that has one, else in, else 'unknown'."""
    tagged = edges.where("highway IS NOT NULL")
    first = lambda end, name: tagged.groupBy(F.col(end).alias("node_id")).agg(F.min_by("highway", "edge_order").alias(name))
    return nodes.join(first("src", "_out"), "node_id", "left").join(first("dst", "_in"), "node_id", "left").withColumn("highway", F.coalesce("_out", "_in", F.lit("unknown"))).drop("_out", "_in")


def weather_join(df: DataFrame, weather: DataFrame, within_us: int = 1_800_000_000, size: float = 0.05) -> DataFrame:
    """Of the weather points within half an hour the nearest in degrees, then the earliest; its values or nulls. The search is on
    the bucket of the time, with the two beside, and cells from ``size`` degrees on."""
    values = [c for c in weather.columns if c not in ("ts_us", "lat", "lon")]
    bucket = lambda c: F.floor(F.col(c) / within_us)
    there = weather.select(F.col("ts_us").alias("_wt"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), *values)
    there = there.withColumn("_bucket", F.explode(F.array(*(bucket("_wt") + i for i in (-1, 0, 1)))))
    out = attach_nearest(df.withColumn("_bucket", bucket("ts_us")), there, ("_wt", *values), size, ("_bucket",), ("ts_us", "_wt", within_us))
    return out.withColumns({v: F.col(f"n.{v}") for v in values}).drop("_bucket", "n")


def zone_join(df: DataFrame, zones: DataFrame, size: float = 0.05, default: str = "inconnu") -> DataFrame:
    """(zone_id, zone_type, ring) -> osm_zone of each sample: the type of the zone that holds it, of several the last by zone_id. Zones are
    covered by cells of a 64th of ``size`` degrees, so only samples near a border are tested against it (``functions.zones``)."""
    return last_zone_at(df, zones, size / 64, "osm_zone").na.fill(default, ["osm_zone"])


def hexagon(df: DataFrame, size: float = 0.01) -> DataFrame:
    """hex_q, hex_r: the axial coordinates of the hexagon (corner to the north, ``size`` degrees from centre to corner) that holds the sample, by rounding
    its cube coordinates; hex_lat, hex_lon: its centre."""
    q, r = (math.sqrt(3) / 3 * F.col("lon") - F.col("lat") / 3) / size, 2 / 3 * F.col("lat") / size
    half = lambda x: F.floor(x + 0.5)

    def cube(x: Column) -> Column:
        whole = F.struct(*(half(x[c]).alias(c) for c in "qrs"), *(F.abs(half(x[c]) - x[c]).alias(f"{c}d") for c in "qrs"))
        return let(whole, axial)

    def axial(x: Column) -> Column:
        largest_q = (x.qd > x.rd) & (x.qd > x.sd)
        largest_r = ~largest_q & (x.rd > x.sd)
        return F.struct(F.when(largest_q, -x.r - x.s).otherwise(x.q).alias("hex_q"), F.when(largest_r, -x.q - x.s).otherwise(x.r).alias("hex_r"))

    # every value is bound once: as chained columns they are written out again and again, to code that is too long to be compiled
    hexed = let(F.struct(q.alias("q"), r.alias("r")), lambda x: let(F.struct(x.q.alias("q"), x.r.alias("r"), (-x.q - x.r).alias("s")), cube))
    df = df.withColumn("_h", hexed).select(*df.columns, "_h.hex_q", "_h.hex_r")
    return df.withColumns({"hex_lat": 1.5 * size * F.col("hex_r"), "hex_lon": math.sqrt(3) * size * (F.col("hex_q") + F.col("hex_r") / 2)})


def grid_zone(df: DataFrame, zones: DataFrame, size: float = 0.01, default: str = "inconnu") -> DataFrame:
    """grid_id (``q:r`` of the sample's hexagon) and grid_zone, the type of the zone that holds the hexagon's centre: zones are looked up once a
    hexagon that holds samples, not once a sample."""
    df = hexagon(df, size)
    centres = df.select("hex_q", "hex_r", F.col("hex_lat").alias("lat"), F.col("hex_lon").alias("lon")).distinct()
    types = zones_at(centres, zones, ("hex_q", "hex_r"), 5 * size).groupBy("hex_q", "hex_r").agg(F.max_by("zone_type", "zone_id").alias("grid_zone"))
    df = df.join(types, ["hex_q", "hex_r"], "left").na.fill(default, ["grid_zone"])
    return df.withColumn("grid_id", F.concat_ws(":", "hex_q", "hex_r")).drop("hex_q", "hex_r", "hex_lat", "hex_lon")


def elevation_join(df: DataFrame, dem: DataFrame, cells: int = 1000, smooth: int = 21, mode: str = "nearest") -> DataFrame:
    """altitude at the sample, filled along the trip; altitude_smoothed, slope_percent and altitude_m (float). nearest: the value of
    its DEM cell. bilinear: between its cell's corner value and those of the three cells beyond, where all four are known, else
    that of its cell. A DEM of None leaves the samples as they are."""
    if dem is None:
        return df
    df = df.withColumns({"lat_i": F.floor(F.col("lat") * cells).cast("int"), "lon_i": F.floor(F.col("lon") * cells).cast("int")})
    corner = lambda i, j: F.max(F.when((F.col("_i") == i) & (F.col("_j") == j), F.col("altitude_m"))).alias(f"_z{i}{j}")
    spread = F.explode(F.array(*(F.struct(F.lit(i).alias("_i"), F.lit(j).alias("_j")) for i in (0, 1) for j in (0, 1))))
    grid = dem.select("lat_i", "lon_i", "altitude_m", spread.alias("c")).select((F.col("lat_i") - F.col("c._i")).alias("lat_i"), (F.col("lon_i") - F.col("c._j")).alias("lon_i"), "altitude_m", "c._i", "c._j")
    grid = grid.groupBy("lat_i", "lon_i").agg(*(corner(i, j) for i in (0, 1) for j in (0, 1))) if mode == "bilinear" else dem.select("lat_i", "lon_i", F.col("altitude_m").alias("_z00"))
    df = df.join(grid, ["lat_i", "lon_i"], "left")
    altitude = F.col("_z00")
    if mode == "bilinear":
        a, b = F.col("lat") * cells - F.col("lat_i"), F.col("lon") * cells - F.col("lon_i")
        altitude = F.coalesce((1 - a) * ((1 - b) * F.col("_z00") + b * F.col("_z01")) + a * ((1 - b) * F.col("_z10") + b * F.col("_z11")), altitude)
    df = df.withColumn("altitude", altitude).drop("lat_i", "lon_i", "_z00", "_z01", "_z10", "_z11")
    df = df.withColumn("altitude", F.when(F.col("altitude").between(-450, 9000), F.col("altitude")))
    df = df.withColumn("altitude", F.coalesce(ffill("altitude"), bfill("altitude"))).withColumn("altitude_smoothed", F.avg("altitude").over(centred(smooth)))
    df = step_m(df, "_ds").withColumn("_dz", gradient("altitude_smoothed"))
    return df.withColumn("slope_percent", F.when(F.col("_ds") > 0, 100 * F.col("_dz") / F.col("_ds")).otherwise(0.0)).withColumn("altitude_m", F.col("altitude").cast("float")).drop("_ds", "_dz")


def snap_points(df: DataFrame, pois: DataFrame, most_m: float = 100.0, least: int = 800) -> DataFrame:
    """(poi_id, trip_id, lat, lon) -> the closest sample of the trip within ``most_m``, if at least ``least`` samples after the last
    one accepted in its trip: poi_id, trip_id, seq, distance_m."""
    there = cover(pois.select("poi_id", "trip_id", F.col("lat").alias("_plat"), F.col("lon").alias("_plon")), most_m, "_plat", "_plon")
    here = df.select("trip_id", "seq", "lat", "lon").withColumns(home(F.col("lat"), F.col("lon"), most_m))
    d = F.round(geo.haversine(F.col("lat"), F.col("lon"), F.col("_plat"), F.col("_plon")), 6)
    near = here.join(there, ["trip_id", "cell_lat", "cell_lon"]).withColumn("distance_m", d).where(F.col("distance_m") <= most_m)
    hits = near.groupBy("poi_id", "trip_id").agg(F.min(F.struct("distance_m", "seq")).alias("b")).select("poi_id", "trip_id", "b.seq", "b.distance_m")
    return spaced(hits, least, carry=("poi_id", "distance_m")).select("poi_id", "trip_id", "seq", "distance_m")


def anchor_at_time(df: DataFrame, at: DataFrame) -> DataFrame:
    """(trip_id, t_us) -> the nearest sample: trip_id, t_us, seq; ties to the smaller seq. Samples and times in one window."""
    first = df.groupBy("trip_id", "ts_us").agg(F.min("seq").alias("seq")).select("trip_id", F.col("ts_us").alias("t"), F.struct("ts_us", "seq").alias("_e"))
    both = first.unionByName(at.select("trip_id", F.col("t_us").alias("t"), "t_us"), allowMissingColumns=True)
    upto = lambda *order: W.partitionBy("trip_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumns({"_b": F.last("_e", True).over(upto("t", F.col("_e").isNull())), "_a": F.last("_e", True).over(upto(F.desc("t"), F.col("_e").isNull()))})
    ranked = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.ts_us") - F.col("t_us")).alias("d"), F.col(f"{c}.seq").alias("seq")))
    return both.where("t_us IS NOT NULL").select("trip_id", "t_us", F.least(ranked("_b"), ranked("_a"))["seq"].alias("seq"))


def anchor_at_geo(df: DataFrame, at: DataFrame, size: float = 0.002) -> DataFrame:
    """(trip_id, anchor_id, lat, lon) -> the sample of the trip nearest in metres, however far: trip_id, anchor_id, seq, distance_m."""
    samples = df.select("trip_id", "seq", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    best = nearest_points(at.select("trip_id", "anchor_id", "lat", "lon"), samples, ("trip_id", "anchor_id"), ("seq",), size, ("trip_id",), metric="metres")
    return best.select("trip_id", "anchor_id", F.col("n.seq").alias("seq"), F.col("n.d").alias("distance_m"))


def flag_intervals(df: DataFrame, intervals: DataFrame) -> DataFrame:
    """(trip_id, kind 'stop' or 'wait', i0, i1) -> flag_stop and flag_wait on samples inside, speed 0 there. Intervals are
    spread to the rows that they cover: the work is their length, not the product of the tables."""
    rows = intervals.select("trip_id", "kind", F.explode(F.sequence("i0", "i1")).alias("seq"))
    flags = rows.groupBy("trip_id", "seq").agg(*(F.max((F.col("kind") == k).cast("int")).alias(f"flag_{k}") for k in ("stop", "wait")))
    out = df.join(flags, ["trip_id", "seq"], "left").na.fill(0, ["flag_stop", "flag_wait"])
    return out.withColumn("speed", F.when(F.col("flag_stop") + F.col("flag_wait") > 0, 0.0).otherwise(F.col("speed")))


def revisits(df: DataFrame, within_m: float = 30.0, apart: int = 10) -> DataFrame:
    """Per trip: whether two samples at least ``apart`` rows apart are closer than ``within_m``. The rows of one position are one place with its first
    and last row, so standing still makes no pairs. Cells are as wide as the distance; two places far enough apart in rows in one cell of a third of the width
    are certainly close, and decide their trip; the others meet only in cells whose first row is early enough for one of theirs."""
    at = written(df.groupBy("trip_id", "lat", "lon").agg(F.min("seq").alias("first"), F.max("seq").alias("last")))
    small = home(F.col("lat"), F.col("lon"), within_m / 3)  # a cell is at most twice as wide as high between the poles' caps
    ends = at.withColumns(small).groupBy("trip_id", "cell_lat", "cell_lon").agg(F.min(F.struct("first", "lat", "lon")).alias("a"), F.max(F.struct("last", "lat", "lon")).alias("b"))
    close = geo.haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) < within_m
    sure = written(ends.where((F.col("b.last") - F.col("a.first") >= apart) & close).select("trip_id").distinct().withColumn("_sure", F.lit(True)))
    rest = at.withColumns(home(F.col("lat"), F.col("lon"), within_m)).join(sure, "trip_id", "left_anti")
    cells = rest.groupBy("trip_id", "cell_lat", "cell_lon").agg(F.min("first").alias("_from"))
    other = cover(rest.select("trip_id", F.col("last").alias("_s"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon")), within_m, "_lat", "_lon")
    other = other.join(cells, ["trip_id", "cell_lat", "cell_lon"]).where(F.col("_s") >= F.col("_from") + apart)
    pair = rest.join(other, ["trip_id", "cell_lat", "cell_lon"]).where(F.col("_s") >= F.col("first") + apart)
    met = pair.where(geo.haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")) < within_m).select("trip_id").distinct().withColumn("_sure", F.lit(True))
    return at.select("trip_id").distinct().join(sure.union(met), "trip_id", "left").select("trip_id", F.coalesce("_sure", F.lit(False)).alias("revisits"))


def attach_columns(df: DataFrame, enriched: DataFrame, *columns: str) -> DataFrame:
    return df.join(enriched.select("trip_id", "seq", *columns), ["trip_id", "seq"], "left")


def compare_elevation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differences of altitude and slope between two enrichments of the same samples, per trip."""
    right = b.select("trip_id", "seq", F.col("altitude_m").alias("_alt"), F.col("slope_percent").alias("_slope"))
    d = F.col("altitude_m") - F.col("_alt")
    return a.join(right, ["trip_id", "seq"]).groupBy("trip_id").agg(F.count("*").alias("n"), F.avg(d).alias("mean_diff_m"), F.max(F.abs(d)).alias("most_diff_m"), F.avg(F.abs(F.col("slope_percent") - F.col("_slope"))).alias("mean_slope_diff"))


def road_within_buffer(df: DataFrame, segments: DataFrame, buffer_m: float = 10.0, default: str = "inconnu", size: float = 0.002, parts: int | None = None) -> DataFrame:
    """(segment_id, lat1, lon1, lat2, lon2, highway) -> road_tag: that of the nearest segment within the buffer (metres over 111 320 as
    degrees), ties to the smaller segment_id. Segments stand in every cell that their bounding box and the buffer touch; cells are then cut until few segments
    are left in each (``grid.refine``), so a sample meets those around it, not all within the buffer. Of segments in one place only the one that wins their
    tie is met, by each position once. Positions meet them as rows: functions of array items are interpreted, rows are compiled.
    parts: partitions of the positions, else the session's number, however many."""
    reach = buffer_m / 111_320
    s = segments.groupBy("lat1", "lon1", "lat2", "lon2").agg(F.min(F.struct("segment_id", "highway")).alias("_v")).select("lat1", "lon1", "lat2", "lon2", "_v.*")
    for c in ("lat", "lon"):
        lo, hi = F.least(f"{c}1", f"{c}2") - reach, F.greatest(f"{c}1", f"{c}2") + reach
        s = s.withColumn(f"cell_{c}", F.explode(F.sequence(geo.cell(lo, size), geo.cell(hi, size))))
    s = s.withColumns({"dy": F.col("lat2") - F.col("lat1"), "dx": F.col("lon2") - F.col("lon1")})
    square = F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")
    item = F.struct("segment_id", "highway", "lat1", "lon1", "dy", "dx", F.when(square == 0, 1.0).otherwise(square).alias("square"))
    coarse = s.groupBy(F.col("cell_lat").alias("i"), F.col("cell_lon").alias("j")).agg(F.collect_list(item).alias("items"))

    def distance(p: Column, lat: Column, lon: Column, once: Callable = let) -> Column:
        along = ((lat - p.lat1) * p.dy + (lon - p.lon1) * p.dx) / p.square
        return once(F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0)), lambda t: F.sqrt(F.pow(lat - p.lat1 - t * p.dy, 2) + F.pow(lon - p.lon1 - t * p.dx, 2)))

    at = df.withColumns(leaf(size)).where("i IS NOT NULL AND j IS NOT NULL")
    near = refine(written(at.select("i", "j").distinct()), coarse, distance, size, reach=reach)
    place = ("i", "j", "lat", "lon")

    def met(places: DataFrame) -> DataFrame:
        rows = places.join(near, ["i", "j"]).select(*places.columns, F.explode("items").alias("_p"))
        return rows.withColumn("_d", distance(F.col("_p"), F.col("lat"), F.col("lon"), lambda t, fn: fn(t)))

    places = at.select(*place).repartition(*([parts] if parts else []), "i", "j").distinct()
    least = met(places).groupBy(*place).agg(F.min("_d").alias("_least"))
    tied = met(least).where(F.col("_d") <= F.col("_least") + 1e-11)
    best = tied.groupBy(*place).agg(F.min(F.struct(F.round("_d", 12).alias("d"), "_p.segment_id", "_p.highway")).alias("_b"))
    tags = best.where(F.col("_b.d") <= reach).select("lat", "lon", F.col("_b.highway").alias("road_tag"))
    df = df.drop("road_tag")
    return df.join(tags, ["lat", "lon"], "left").select(*df.columns, "road_tag").na.fill(default, ["road_tag"])


def proximity_labels(df: DataFrame, events: DataFrame, within_m: float = 3.0) -> DataFrame:
    """(event_order, label, lat, lon) -> event of each sample: the first by order of those within the distance; else its own."""
    there = cover(events.where("event_order IS NOT NULL").groupBy("lat", "lon").agg(F.min(F.struct("event_order", "label")).alias("e")), within_m, "lat", "lon")
    there = there.groupBy("cell_lat", "cell_lon").agg(F.collect_list(F.struct("e", "lat", "lon")).alias("_there"))
    close = lambda p: geo.haversine(F.col("lat"), F.col("lon"), p.lat, p.lon) < within_m
    near = F.array_min(F.transform(F.filter("_there", close), lambda p: p.e)).getField("label")
    out = df.withColumns(home(F.col("lat"), F.col("lon"), within_m)).join(there, ["cell_lat", "cell_lon"], "left")
    return out.withColumn("event", F.coalesce(near, "event")).drop("cell_lat", "cell_lon", "_there")
