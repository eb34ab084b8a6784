"""Queries on enrichment joins and delivery plans."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripmill.operators import joins as J
from tripmill.operators import plan as L
from tripmill.plans.fixtures import parts, shared, view, with_views
from tripmill.plans.motion import rounded
from tripmill.plans.repair import SPEED_SQL, SPEEDS
from tripmill.plans.sqltext import AFTER, STEP, UPTO, frame, gradient, metres, r6, road_type

CAPS = {"motorway": 90.0, "primary": 70.0, "secondary": 50.0}
CATEGORY = {"freinage": "behavior", "acceleration": "behavior", "dos_dane": "infra", "stop": "context"}


def road_types(spark: SparkSession, d: str) -> DataFrame:
    df = J.event_categories(J.highway_to_road_type(view(spark, d)), CATEGORY)
    a = J.speed_caps(J.target_speed_default(df, SPEEDS), CAPS).select("trip_id", "seq", "road_type", "event_behavior", "event_context", "event_infra", "context_speed_cap_kmh", F.col("target_speed").alias("capped"))
    few = {k: v for k, v in SPEEDS.items() if k in ("motorway", "service")}
    b = J.target_speed_by_road_type(df, few).select("trip_id", "seq", F.col("target_speed").alias("carried"))
    return rounded(J.attach_columns(a, b, "carried"))


FEW = "CASE road_type WHEN 'motorway' THEN 110e0 WHEN 'service' THEN 20e0 END"
ROAD_TYPES = f"""WITH r AS (SELECT *, {road_type()} AS road_type FROM trace), c AS (SELECT *, CASE road_type WHEN 'motorway' THEN 90e0 WHEN 'primary' THEN 70e0 WHEN 'secondary' THEN 50e0 ELSE 90e0 END AS cap, coalesce({SPEED_SQL}, 50e0) AS v, {FEW} AS few FROM r)
SELECT trip_id, seq, road_type, CASE WHEN event IN ('freinage', 'acceleration') THEN 1 ELSE 0 END AS event_behavior, CASE WHEN event = 'stop' THEN 1 ELSE 0 END AS event_context, CASE WHEN event = 'dos_dane' THEN 1 ELSE 0 END AS event_infra,
  {r6('cap')} AS context_speed_cap_kmh, {r6(f'avg(least(v, cap)) OVER {frame(10, 10)}')} AS capped, {r6(f'coalesce(last_value(few IGNORE NULLS) OVER {UPTO}, first_value(few IGNORE NULLS) OVER {AFTER})')} AS carried FROM c"""


def asof(spark: SparkSession, d: str) -> DataFrame:
    df = view(spark, d)
    grid = df.select("trip_id", "seq", (F.col("ts_us") + 50000).alias("ts_us"), F.when(F.col("seq") % 50 == 0, "own").alias("event"))
    events = df.where("event IS NOT NULL").select("trip_id", "seq", "ts_us", "event")
    return J.asof_event(grid, events).select("trip_id", "seq", "event")


ASOF = """WITH g AS (SELECT trip_id, seq, ts_us + 50000 AS ts_us, CASE WHEN seq % 50 = 0 THEN 'own' END AS own FROM trace), e AS (SELECT trip_id, seq, ts_us, event FROM trace WHERE event IS NOT NULL),
m AS (SELECT g.trip_id, g.seq, own, e.event, row_number() OVER (PARTITION BY g.trip_id, g.seq ORDER BY abs(e.ts_us - g.ts_us), e.ts_us, e.seq DESC) AS r FROM g LEFT JOIN e ON g.trip_id = e.trip_id AND e.ts_us BETWEEN g.ts_us - 500000 AND g.ts_us + 500000)
SELECT trip_id, seq, coalesce(event, own) AS event FROM m WHERE r = 1"""


def weather(spark: SparkSession, d: str) -> DataFrame:
    df = shared(spark, d, "trip_id", "seq", "ts_us", "lat", "lon")
    return rounded(J.weather_join(df, view(spark, d, "weather", df), 60_000_000).select("trip_id", "seq", "temperature", "humidity", "wind_speed", "precipitation"))


WEATHER = f"""WITH g AS (SELECT * FROM trace), m AS (SELECT g.trip_id, g.seq, w.temperature, w.humidity, w.wind_speed, w.precipitation, row_number() OVER (PARTITION BY g.trip_id, g.seq ORDER BY round(sqrt((g.lat - w.lat) ** 2 + (g.lon - w.lon) ** 2), 12), w.ts_us, w.temperature, w.humidity) AS r
  FROM g LEFT JOIN weather w ON abs(w.ts_us - g.ts_us) <= 60000000)
SELECT trip_id, seq, {", ".join(r6(c) + f" AS {c}" for c in ("temperature", "humidity", "wind_speed", "precipitation"))} FROM m WHERE r = 1"""


def nearest_road(spark: SparkSession, d: str) -> DataFrame:
    df = shared(spark, d, "trip_id", "seq", "lat", "lon", "osm_highway")
    return rounded(J.nearest_road(df, view(spark, d, "road_nodes", df)).select("trip_id", "seq", "node_id", "highway_near", "nearest_distance_m"))


NEAREST = f"""WITH g AS (SELECT * FROM trace), m AS (SELECT g.trip_id, g.seq, n.node_id, n.highway, {metres('g.lat', 'g.lon', 'n.lat', 'n.lon')} AS m, row_number() OVER (PARTITION BY g.trip_id, g.seq ORDER BY round(sqrt((g.lat - n.lat) ** 2 + (g.lon - n.lon) ** 2), 12), n.node_id) AS r
  FROM g LEFT JOIN road_nodes n ON (g.lat - n.lat) ** 2 + (g.lon - n.lon) ** 2 <= 0.02e0 * 0.02e0 AND n.lat BETWEEN g.lat - 0.02e0 AND g.lat + 0.02e0)
SELECT trip_id, seq, node_id, highway AS highway_near, {r6('m')} AS nearest_distance_m FROM m WHERE r = 1"""


def zones(spark: SparkSession, d: str) -> DataFrame:
    corner = lambda a, b: F.struct(F.col(a).alias("lat"), F.col(b).alias("lon"))
    df = shared(spark, d, "trip_id", "seq", "lat", "lon")
    z = view(spark, d, "zones", df).select("zone_id", "zone_type", F.array(corner("lat_min", "lon_min"), corner("lat_min", "lon_max"), corner("lat_max", "lon_max"), corner("lat_max", "lon_min")).alias("ring"))
    return J.grid_zone(J.zone_join(df, z), z).select("trip_id", "seq", "osm_zone", "grid_id", "grid_zone")


ZONES = f"""WITH m AS (SELECT t.trip_id, t.seq, z.zone_type, row_number() OVER (PARTITION BY t.trip_id, t.seq ORDER BY z.zone_id DESC) AS r FROM trace t
  LEFT JOIN zones z ON t.lat >= lat_min AND t.lat < lat_max AND t.lon >= lon_min AND t.lon < lon_max),
c AS (SELECT trip_id, seq, ({math.sqrt(3) / 3!r} * lon - lat / 3) / 0.01e0 AS q, {2 / 3!r} * lat / 0.01e0 AS r FROM trace),
d AS (SELECT trip_id, seq, CAST(floor(q + 0.5) AS BIGINT) AS q0, CAST(floor(r + 0.5) AS BIGINT) AS r0, CAST(floor(-q - r + 0.5) AS BIGINT) AS s0, q, r, -q - r AS s FROM c),
h AS (SELECT trip_id, seq, CASE WHEN abs(q0 - q) > abs(r0 - r) AND abs(q0 - q) > abs(s0 - s) THEN -r0 - s0 ELSE q0 END AS hq,
  CASE WHEN NOT (abs(q0 - q) > abs(r0 - r) AND abs(q0 - q) > abs(s0 - s)) AND abs(r0 - r) > abs(s0 - s) THEN -q0 - s0 ELSE r0 END AS hr FROM d),
x AS (SELECT hq, hr, {1.5 * 0.01!r} * hr AS lat, {math.sqrt(3) * 0.01!r} * (hq + hr / 2e0) AS lon FROM (SELECT DISTINCT hq, hr FROM h) y),
y AS (SELECT hq, hr, arg_max(zone_type, zone_id) AS t FROM x JOIN zones z ON x.lat >= lat_min AND x.lat < lat_max AND x.lon >= lon_min AND x.lon < lon_max GROUP BY hq, hr)
SELECT m.trip_id, m.seq, coalesce(zone_type, 'inconnu') AS osm_zone, concat(h.hq, ':', h.hr) AS grid_id, coalesce(y.t, 'inconnu') AS grid_zone FROM m JOIN h USING (trip_id, seq) LEFT JOIN y ON y.hq = h.hq AND y.hr = h.hr WHERE m.r = 1"""


def elevation(spark: SparkSession, d: str) -> DataFrame:
    dem = view(spark, d, "dem").where("(lat_i + lon_i) % 3 <> 0")
    return rounded(J.elevation_join(view(spark, d), dem).select("trip_id", "seq", "altitude", "altitude_smoothed", "slope_percent"))


ELEVATION = f"""WITH a AS (SELECT t.*, CASE WHEN (d.lat_i + d.lon_i) % 3 <> 0 THEN d.altitude_m END AS z0 FROM trace t LEFT JOIN dem d ON d.lat_i = CAST(floor(t.lat * 1000) AS INT) AND d.lon_i = CAST(floor(t.lon * 1000) AS INT)),
f AS (SELECT *, coalesce(last_value(z0 IGNORE NULLS) OVER {UPTO}, first_value(z0 IGNORE NULLS) OVER {AFTER}) AS z FROM a), s AS (SELECT *, avg(z) OVER {frame(10, 10)} AS zs, {STEP} AS ds FROM f),
g AS (SELECT *, {gradient('zs')} AS dz FROM s)
SELECT trip_id, seq, {r6('z')} AS altitude, {r6('zs')} AS altitude_smoothed, {r6('CASE WHEN ds > 0 THEN 100 * dz / ds ELSE 0e0 END')} AS slope_percent FROM g"""


def bilinear(spark: SparkSession, d: str) -> DataFrame:
    return rounded(J.elevation_join(view(spark, d), view(spark, d, "dem"), mode="bilinear").select("trip_id", "seq", "altitude", "altitude_smoothed"))


BILINEAR = f"""WITH i AS (SELECT *, CAST(floor(lat * 1000) AS INT) AS i, CAST(floor(lon * 1000) AS INT) AS j FROM trace),
a AS (SELECT i.*, lat * 1000 - i AS a, lon * 1000 - j AS b, z0.altitude_m AS z00, z1.altitude_m AS z01, z2.altitude_m AS z10, z3.altitude_m AS z11 FROM i LEFT JOIN dem z0 ON z0.lat_i = i AND z0.lon_i = j
      LEFT JOIN dem z1 ON z1.lat_i = i AND z1.lon_i = j + 1 LEFT JOIN dem z2 ON z2.lat_i = i + 1 AND z2.lon_i = j LEFT JOIN dem z3 ON z3.lat_i = i + 1 AND z3.lon_i = j + 1),
z AS (SELECT *, coalesce((1 - a) * ((1 - b) * z00 + b * z01) + a * ((1 - b) * z10 + b * z11), z00) AS z FROM a)
SELECT trip_id, seq, {r6('z')} AS altitude, {r6(f'avg(z) OVER {frame(10, 10)}')} AS altitude_smoothed FROM z"""


def anchors(spark: SparkSession, d: str) -> DataFrame:
    df = shared(spark, d, "trip_id", "seq", "ts_us", "lat", "lon")
    pois = df.where("seq % 500 = 250").select(F.col("seq").alias("poi_id"), "trip_id", (F.col("lat") + 0.0003).alias("lat"), "lon")
    a = J.snap_points(df, pois, least=900).select("trip_id", F.col("poi_id").cast("long").alias("at"), "seq", "distance_m", F.lit("place").alias("kind"))
    times = df.groupBy("trip_id").agg((F.min("ts_us") + 12345678).alias("t_us"))
    b = J.anchor_at_time(df, times).select("trip_id", F.col("t_us").alias("at"), "seq", F.lit(None).cast("double").alias("distance_m"), F.lit("time").alias("kind"))
    c = J.anchor_at_geo(df, pois.select("trip_id", F.col("poi_id").cast("long").alias("anchor_id"), "lat", "lon"))
    c = c.select("trip_id", F.col("anchor_id").alias("at"), "seq", "distance_m", F.lit("geo").alias("kind"))
    return rounded(a.unionByName(b).unionByName(c))


ANCHORS = f"""WITH RECURSIVE p AS (SELECT seq AS poi_id, trip_id, lat + 0.0003 AS lat, lon FROM trace WHERE seq % 500 = 250),
m AS (SELECT poi_id, t.trip_id, t.seq, round({metres('t.lat', 't.lon', 'p.lat', 'p.lon')}, 6) AS d FROM p JOIN trace t ON t.trip_id = p.trip_id AND abs(t.lat - p.lat) < 0.002 AND abs(t.lon - p.lon) < 0.002),
b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY seq, poi_id) AS i FROM (SELECT *, row_number() OVER (PARTITION BY poi_id, trip_id ORDER BY d, seq) AS r FROM m WHERE d <= 100) z WHERE r = 1),
k AS (SELECT trip_id, poi_id, seq, d, i, true AS kept, seq AS last FROM b WHERE i = 1 UNION ALL
      SELECT b.trip_id, b.poi_id, b.seq, b.d, b.i, b.seq - k.last >= 900, CASE WHEN b.seq - k.last >= 900 THEN b.seq ELSE k.last END FROM k JOIN b ON b.trip_id = k.trip_id AND b.i = k.i + 1),
g AS (SELECT p.poi_id, p.trip_id, t.seq, round({metres('t.lat', 't.lon', 'p.lat', 'p.lon')}, 6) AS d FROM p JOIN trace t ON t.trip_id = p.trip_id),
h AS (SELECT *, row_number() OVER (PARTITION BY poi_id, trip_id ORDER BY d, seq) AS r FROM g),
t AS (SELECT trip_id, min(ts_us) + 12345678 AS t_us FROM trace GROUP BY trip_id), c AS (SELECT t.trip_id, t_us, seq, row_number() OVER (PARTITION BY t.trip_id ORDER BY abs(ts_us - t_us), seq) AS r FROM t JOIN trace x ON x.trip_id = t.trip_id)
SELECT trip_id, CAST(poi_id AS BIGINT) AS "at", seq, {r6('d')} AS distance_m, 'place' AS kind FROM k WHERE kept UNION ALL SELECT trip_id, t_us, seq, NULL, 'time' FROM c WHERE r = 1 UNION ALL SELECT trip_id, poi_id, seq, {r6('d')}, 'geo' FROM h WHERE r = 1"""


def flagged(spark: SparkSession, d: str) -> DataFrame:
    df = view(spark, d)
    starts = df.where("seq % 1000 = 100").select("trip_id", F.when(F.col("seq") % 2000 == 100, "stop").otherwise("wait").alias("kind"), F.col("seq").alias("i0"), (F.col("seq") + 50 * (1 + F.col("trip_id") % 3)).alias("i1"))
    return rounded(J.flag_intervals(df, starts).select("trip_id", "seq", "flag_stop", "flag_wait", "speed"))


FLAGGED = f"""WITH i AS (SELECT trip_id, seq % 2000 = 100 AS s, seq AS i0, seq + 50 * (1 + trip_id % 3) AS i1 FROM trace WHERE seq % 1000 = 100),
f AS (SELECT t.trip_id, t.seq, speed, coalesce(max(CASE WHEN s THEN 1 ELSE 0 END) FILTER (i0 IS NOT NULL), 0) AS flag_stop, coalesce(max(CASE WHEN s THEN 0 ELSE 1 END) FILTER (i0 IS NOT NULL), 0) AS flag_wait FROM trace t LEFT JOIN i ON i.trip_id = t.trip_id AND t.seq BETWEEN i0 AND i1 GROUP BY ALL)
SELECT trip_id, seq, flag_stop, flag_wait, {r6('CASE WHEN flag_stop + flag_wait > 0 THEN 0e0 ELSE speed END')} AS speed FROM f"""


def revisited(spark: SparkSession, d: str) -> DataFrame:
    return J.revisits(view(spark, d), apart=1500)


REVISITED = f"""WITH p AS (SELECT trip_id, seq AS i, lat, lon FROM trace)
SELECT a.trip_id, coalesce(bool_or(b.i IS NOT NULL AND {metres('a.lat', 'a.lon', 'b.lat', 'b.lon')} < 30), false) AS revisits FROM p a LEFT JOIN p b ON a.trip_id = b.trip_id AND b.i >= a.i + 1500 AND abs(a.lat - b.lat) < 0.001 GROUP BY a.trip_id"""


def scheduled(spark: SparkSession, d: str) -> DataFrame:
    return L.schedule(view(spark, d, "delivery_plan")).select("plan_id", "stop_seq", "arrive_s", "wait_s", "depart_s")


SCHEDULED = """WITH RECURSIVE p AS MATERIALIZED (SELECT * FROM delivery_plan),
s AS (SELECT plan_id, stop_seq, CAST(1735689600 AS BIGINT) + travel_s AS a, greatest(0, coalesce(tw_start_s - 1735689600 - travel_s, 0)) AS w, CAST(1735689600 AS BIGINT) + travel_s + greatest(0, coalesce(tw_start_s - 1735689600 - travel_s, 0)) + service_s AS d FROM p WHERE stop_seq = 0
  UNION ALL SELECT p.plan_id, p.stop_seq, s.d + travel_s, greatest(0, coalesce(tw_start_s - s.d - travel_s, 0)), s.d + travel_s + greatest(0, coalesce(tw_start_s - s.d - travel_s, 0)) + service_s FROM s JOIN p ON p.plan_id = s.plan_id AND p.stop_seq = s.stop_seq + 1)
SELECT plan_id, stop_seq, a AS arrive_s, w AS wait_s, d AS depart_s FROM s"""


def intervals(spark: SparkSession, d: str) -> DataFrame:
    return L.wait_stop_intervals(L.schedule(view(spark, d, "delivery_plan")))


INTERVALS = SCHEDULED.replace("SELECT plan_id, stop_seq, a AS arrive_s, w AS wait_s, d AS depart_s FROM s", "SELECT plan_id, stop_seq, 'wait' AS kind, a AS start_s, a + w AS end_s FROM s WHERE w > 0 UNION ALL SELECT s.plan_id, s.stop_seq, 'stop', d - service_s, d FROM s JOIN p ON p.plan_id = s.plan_id AND p.stop_seq = s.stop_seq WHERE service_s > 0")


def legs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(L.plan_summary(L.straight_line_legs(L.build_legs(view(spark, d, "delivery_plan")))))


LEGS = f"""WITH l AS (SELECT plan_id, {metres('lat', 'lon', 'lead(lat) OVER w', 'lead(lon) OVER w')} AS m FROM delivery_plan WINDOW w AS (PARTITION BY plan_id ORDER BY stop_seq))
SELECT plan_id, count(*) AS n_legs, {r6('sum(m)')} AS distance_m, {r6('sum(greatest(m / 13.9e0, 1e0))')} AS duration_s FROM l WHERE m IS NOT NULL GROUP BY plan_id"""


def buffered(spark: SparkSession, d: str) -> DataFrame:
    df = shared(spark, d, "trip_id", "seq", "lat", "lon", "event", "osm_highway")
    ends = df.where("seq % 400 IN (0, 200)")
    nxt = lambda c: F.lead(c).over(W.partitionBy("trip_id").orderBy("seq"))
    number = F.col("trip_id").cast("long") * 100000 + F.col("seq")  # as an int it ends at trip 21474
    segments = ends.select(number.alias("segment_id"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), nxt("lat").alias("lat2"), nxt("lon").alias("lon2"), F.coalesce("osm_highway", F.lit("none")).alias("highway")).where("lat2 IS NOT NULL")
    marks = df.where("seq % 250 = 0").select(number.alias("event_order"), F.lit("near").alias("label"), F.col("lat") + 0.00001, "lon").toDF("event_order", "label", "lat", "lon")
    tagged = J.road_within_buffer(df.drop("osm_highway"), segments, 200.0, parts=parts(spark, f"{d}/lineitem.parquet"))
    return J.proximity_labels(tagged, marks).select("trip_id", "seq", "road_tag", "event")


BUFFERED = f"""WITH p AS MATERIALIZED (SELECT * FROM trace),
s AS MATERIALIZED (SELECT * FROM (SELECT trip_id * 100000 + seq AS segment_id, lat AS a, lon AS b, lead(lat) OVER w AS c, lead(lon) OVER w AS d, coalesce(osm_highway, 'none') AS highway FROM trace WHERE seq % 400 IN (0, 200) WINDOW w AS (PARTITION BY trip_id ORDER BY seq)) z WHERE c IS NOT NULL),
t AS (SELECT p.trip_id, p.seq, segment_id, highway, lat, lon, a, b, c, d, CASE WHEN c = a AND d = b THEN 0e0 ELSE least(greatest(((lat - a) * (c - a) + (lon - b) * (d - b)) / ((c - a) * (c - a) + (d - b) * (d - b)), 0e0), 1e0) END AS t
      FROM p JOIN s ON lat BETWEEN least(a, c) - 0.01 AND greatest(a, c) + 0.01 AND lon BETWEEN least(b, d) - 0.01 AND greatest(b, d) + 0.01),
m AS (SELECT trip_id, seq, highway, row_number() OVER (PARTITION BY trip_id, seq ORDER BY e, segment_id) AS r FROM (SELECT *, round(sqrt((lat - a - t * (c - a)) ** 2 + (lon - b - t * (d - b)) ** 2), 12) AS e FROM t) z WHERE e <= 200 / 111320e0),
k AS (SELECT p.trip_id, p.seq, bool_or(q.seq IS NOT NULL AND {metres('p.lat', 'p.lon', 'q.lat + 0.00001', 'q.lon')} < 3) AS near FROM p LEFT JOIN p q ON q.seq % 250 = 0 AND abs(p.lat - q.lat) < 0.001 AND abs(p.lon - q.lon) < 0.001 GROUP BY p.trip_id, p.seq)
SELECT p.trip_id, p.seq, coalesce(m.highway, 'inconnu') AS road_tag, CASE WHEN near THEN 'near' ELSE event END AS event FROM p LEFT JOIN m ON m.trip_id = p.trip_id AND m.seq = p.seq AND r = 1 JOIN k ON k.trip_id = p.trip_id AND k.seq = p.seq"""


QUERIES = {
    "j_buffered": buffered,
    "j_road_types": road_types, "j_asof": asof, "j_weather": weather, "j_nearest_road": nearest_road, "j_zones": zones, "j_elevation": elevation, "j_bilinear": bilinear, "j_anchors": anchors, "j_flagged": flagged, "j_revisited": revisited,
    "l_scheduled": scheduled, "l_intervals": intervals, "l_legs": legs,
}
ORACLES = {
    "j_buffered": with_views(BUFFERED, "trace"),
    "j_road_types": with_views(ROAD_TYPES, "trace"), "j_asof": with_views(ASOF, "trace"), "j_weather": with_views(WEATHER, "weather"), "j_nearest_road": with_views(NEAREST, "road_nodes"), "j_zones": with_views(ZONES, "zones"), "j_elevation": with_views(ELEVATION, "dem"), "j_bilinear": with_views(BILINEAR, "dem"),
    "j_anchors": with_views(ANCHORS, "trace"), "j_flagged": with_views(FLAGGED, "trace"), "j_revisited": with_views(REVISITED, "trace"),
    "l_scheduled": with_views(SCHEDULED, "delivery_plan"), "l_intervals": with_views(INTERVALS, "delivery_plan"), "l_legs": with_views(LEGS, "delivery_plan"),
}
