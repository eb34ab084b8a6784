"""Queries on sources and sinks, schemas, and single operators that no other query reaches. Round trips write to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmill.functions.zones import zones_at
from tripmill.operators import clean as C
from tripmill.operators import detect as D
from tripmill.operators import joins as J
from tripmill.operators import kinematics as K
from tripmill.operators import quality as Q
from tripmill.operators import report as A
from tripmill.operators import resample as S
from tripmill.plans.fixtures import view, with_views
from tripmill.plans.motion import rounded
from tripmill.plans.repair import BLANK
from tripmill.plans.sqltext import AFTER, STEP, UPTO, clip, frame, gradient, lag, lead, metres, r6
from tripmill.sources import io, schema

START = 1_767_225_600_000_000


def folder(spark: SparkSession) -> str:
    """A new path in the cluster's shared folder; a temporary one only on a local master that names none."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/trips-{uuid.uuid4().hex}"


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark)
    io.write_traces_padded(view(spark, d).withColumn("timestamp", F.timestamp_micros("ts_us")), path)
    back = io.read_traces(spark, path)
    return rounded(back.groupBy("ts_us").agg(F.count("*").alias("n"), F.sum(F.round(F.col("lat") * 1e9).cast("long")).alias("lat_e9"), F.sum(F.col("speed").cast("double")).alias("speed"), F.count("event").alias("n_events"), F.count("heading").alias("n_headings")))


CSV = f"SELECT ts_us, count(*) AS n, CAST(sum(CAST(round(lat * 1e9) AS BIGINT)) AS BIGINT) AS lat_e9, {r6('sum(CAST(CAST(speed AS FLOAT) AS DOUBLE))')} AS speed, count(event) AS n_events, CAST(0 AS BIGINT) AS n_headings FROM trace GROUP BY ts_us"


def export(spark: SparkSession, d: str) -> DataFrame:
    """Two runs, the later one written twice: its rows as they are read back, and the sizes that its manifest and JSON state."""
    path = folder(spark)
    df = view(spark, d).withColumns({"event": F.when(F.col("trip_id") % 2 == 0, F.col("event")), "flag_stop": (F.col("speed") == 0).cast("int"), "flag_wait": (F.col("speed") < 2).cast("int"), "road_type": F.col("osm_highway")})
    io.export_dataset(df.where("trip_id = 0"), path, "r1", START)
    for _ in range(2):
        io.export_dataset(df, path, "r2", START, artifacts=True)
    rows = io.latest_run(spark, path).select("trip_id", "seq", F.unix_micros("timestamp").alias("ts_us"), F.col("speed").cast("double").alias("speed"), "event", "road_type", "run_id")
    sizes = io.runs(spark, path).select("run_id", "n_points").join(spark.read.json(f"{path}_json").groupBy("run_id").agg(F.count("*").alias("n_json")), "run_id")
    return rounded(rows.join(sizes, "run_id"))


EXPORT = f"""WITH n AS (SELECT count(*) AS n FROM trace)
SELECT trip_id, seq, ts_us + {START - 1_735_689_600_000_000} AS ts_us, {r6('CAST(CAST(speed AS FLOAT) AS DOUBLE)')} AS speed, CASE WHEN trip_id % 2 = 0 THEN event WHEN speed = 0 THEN 'stop' WHEN speed < 2 THEN 'wait' END AS event, osm_highway AS road_type, 'r2' AS run_id, n AS n_points, n AS n_json FROM trace, n"""


def zones_read(spark: SparkSession, d: str) -> DataFrame:
    """Zones as GeoJSON files, one a zone type, read back: how many zones of each type the samples meet, and that ids are unique."""
    path, z = folder(spark), view(spark, d, "zones")
    corner = lambda a, b: F.array(F.col(b), F.col(a))
    ring = F.array(F.array(corner("lat_min", "lon_min"), corner("lat_min", "lon_max"), corner("lat_max", "lon_max"), corner("lat_max", "lon_min")))
    feature = F.struct(F.struct("zone_type").alias("properties"), F.struct(ring.alias("coordinates")).alias("geometry"))
    z.withColumn("t", F.col("zone_type")).groupBy("t").agg(F.collect_list(feature).alias("features")).repartition("t").write.partitionBy("t").json(path)
    back = io.read_zones(spark, f"{path}/*/*.json")
    met = zones_at(view(spark, d).select("trip_id", "seq", "lat", "lon"), back, ("trip_id", "seq"), 0.05)
    held = met.groupBy("zone_type").agg(F.count("*").alias("n_samples"), F.count_distinct("zone_id").alias("n_met"))
    return back.groupBy("zone_type").agg(F.count_distinct("zone_id").alias("n_zones")).join(held, "zone_type", "left").na.fill(0)


ZONES_READ = """WITH m AS (SELECT zone_type, count(*) AS n_samples, count(DISTINCT zone_id) AS n_met FROM trace t JOIN zones z ON t.lat >= lat_min AND t.lat < lat_max AND t.lon >= lon_min AND t.lon < lon_max GROUP BY zone_type)
SELECT zone_type, count(*) AS n_zones, coalesce(any_value(n_samples), 0) AS n_samples, coalesce(any_value(n_met), 0) AS n_met FROM zones LEFT JOIN m USING (zone_type) GROUP BY zone_type"""


def anomalies_written(spark: SparkSession, d: str) -> DataFrame:
    df, a, b = view(spark, d), folder(spark), folder(spark)
    io.write_json(df.select("trip_id", "seq", "ts_us", "lat", "lon"), a)
    io.write_anomalies(df, b)
    read = lambda c: F.coalesce(F.size(c), F.lit(0)).alias(f"n_{c}")
    found = spark.read.json(b, schema="trip_id int, gps_jumps array<int>, speed_anomalies array<int>").select("trip_id", read("gps_jumps"), read("speed_anomalies"), F.col("gps_jumps")[0].alias("first_jump"))
    return spark.read.json(a, schema="trip_id int, seq int").groupBy("trip_id").agg(F.count("*").alias("n")).join(found, "trip_id", "left").na.fill(0, ["n_gps_jumps", "n_speed_anomalies"])


ANOMALIES = f"""WITH s AS (SELECT trip_id, seq, {STEP} AS m, abs(speed - {lag('speed')}) * 3.6e0 AS v FROM trace)
SELECT trip_id, count(*) AS n, CAST(count(*) FILTER (m > 50) AS INT) AS n_gps_jumps, CAST(count(*) FILTER (v > 20) AS INT) AS n_speed_anomalies, min(seq - 1) FILTER (m > 50) AS first_jump FROM s GROUP BY trip_id"""


def weather_read(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark)
    view(spark, d, "weather").select(F.timestamp_micros("ts_us").alias("timestamp"), "lat", "lon", "temperature", "humidity", "wind_speed", "precipitation").write.csv(path, header=True)
    return rounded(io.read_weather(spark, path))


WEATHER_READ = f"SELECT ts_us, {', '.join(r6(c) + f' AS {c}' for c in ('lat', 'lon', 'temperature', 'humidity', 'wind_speed', 'precipitation'))} FROM weather"


def routes(spark: SparkSession, d: str) -> DataFrame:
    """Router answers made of the delivery plans: their points with times, and the roundabouts among the manoeuvres."""
    stop = F.sort_array(F.collect_list(F.struct("stop_seq", "lat", "lon", "travel_s")))
    p = view(spark, d, "delivery_plan").groupBy("plan_id").agg(stop.alias("s"))
    point = F.transform("s", lambda x: F.array(x.lon, x.lat))
    body = F.to_json(F.struct(F.array(F.struct(
        F.aggregate("s", F.lit(0.0), lambda a, x: a + x.travel_s).alias("duration"), F.struct(point.alias("coordinates")).alias("geometry"),
        F.array(F.struct(
            F.struct(F.when(F.col("plan_id") % 2 == 0, F.transform(F.slice("s", 2, 1_000_000), lambda x: x.travel_s.cast("double"))).otherwise(F.array(F.lit(1.0))).alias("duration")).alias("annotation"),
            F.transform("s", lambda x: F.struct(F.struct(F.when(x.stop_seq % 3 == 1, "roundabout").when(x.stop_seq % 3 == 2, "rotary").otherwise("turn").alias("type"), F.array(x.lon, x.lat).alias("location")).alias("maneuver"))).alias("steps"),
        )).alias("legs"),
    )).alias("routes")))
    r = p.select(F.col("plan_id").alias("route_id"), body.alias("body"))
    a = io.flatten_routes(r).select("route_id", "pt_idx", "lat", "lon", "t_rel_s", F.lit("point").alias("kind"))
    b = io.extract_roundabouts(r).select("route_id", F.lit(-1).alias("pt_idx"), "lat", "lon", F.lit(0.0).alias("t_rel_s"), F.col("type").alias("kind"))
    return rounded(a.unionByName(b))


ROUTES = f"""WITH p AS (SELECT *, sum(CASE WHEN stop_seq > 0 THEN travel_s ELSE 0 END) OVER (PARTITION BY plan_id ORDER BY stop_seq ROWS UNBOUNDED PRECEDING) AS t, sum(travel_s) OVER (PARTITION BY plan_id) AS d, count(*) OVER (PARTITION BY plan_id) AS n FROM delivery_plan)
SELECT plan_id AS route_id, stop_seq AS pt_idx, {r6('lat')} AS lat, {r6('lon')} AS lon, {r6('CASE WHEN plan_id % 2 = 0 OR n = 2 AND false THEN t WHEN n = 2 THEN stop_seq * 1e0 ELSE d * stop_seq / CAST(greatest(n - 1, 1) AS DOUBLE) END')} AS t_rel_s, 'point' AS kind FROM p
UNION ALL SELECT plan_id, -1, {r6('lat')}, {r6('lon')}, 0e0, CASE WHEN stop_seq % 3 = 1 THEN 'roundabout' ELSE 'rotary' END FROM p WHERE stop_seq % 3 > 0"""


def plan_read(spark: SparkSession, d: str) -> DataFrame:
    path = folder(spark)
    plan = view(spark, d, "delivery_plan")
    plan.join(plan.groupBy("plan_id").agg(F.count("*").alias("_n")).where("_n > 1"), "plan_id", "left_semi").write.parquet(path)
    legs = io.read_stop_plan(spark, path).select("plan_id", F.col("stop_seq").alias("leg_idx"), F.col("travel_s").alias("duration_s"))
    return S.leg_offsets(legs)


PLAN_READ = """SELECT plan_id, stop_seq AS leg_idx, travel_s AS duration_s, CAST(coalesce(sum(travel_s) OVER (PARTITION BY plan_id ORDER BY stop_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS t0_s
FROM (SELECT *, count(*) OVER (PARTITION BY plan_id) AS n FROM delivery_plan) z WHERE n > 1"""


def schemas(spark: SparkSession, d: str) -> DataFrame:
    """Rough rows through an enricher, the defaults, a schema with a fragment, and a fixed order of columns."""

    def raised(df: DataFrame, by: float = 0.0) -> DataFrame:
        return df.withColumn("altitude", F.col("seq") + by)

    raised.fragments = (schema.load_schema([{"name": "altitude_m", "dtype": "float64"}, {"name": "zone", "dtype": "category", "nullable": False}]),)
    df = C.altitude_alias(schema.apply(view(spark, d, "rough"), raised, {"by": 0.5}).drop("altitude_m"))
    df = C.fill_imu_defaults(df).withColumn("timestamp", F.timestamp_micros("ts_us"))
    whole = schema.merge_schema(schema.canonical(), *raised.fragments)
    df = schema.enforce_export_schema(schema.apply_schema(df, whole))
    names = ["trip_id", "seq", "timestamp", "speed", "acc_x", "gyro_z", "event", "altitude_m", "zone", "weather"]
    df = schema.enforce_schema_order(schema.require_columns(df, names[:-1]), names)
    return rounded(df.withColumns({"timestamp": F.unix_micros("timestamp"), **{c: F.col(c).cast("double") for c in ("acc_x", "gyro_z")}, "speed": F.when(F.abs("speed") < float("inf"), F.col("speed").cast("double"))}).withColumnRenamed("timestamp", "ts_us"))


def finite(c: str) -> str:
    return f"coalesce(CASE WHEN isfinite({c}) THEN {c} END, 0e0)"


def single(x: str) -> str:
    return r6(f"CAST(CAST({x} AS FLOAT) AS DOUBLE)")


SCHEMAS = f"""SELECT trip_id, seq, coalesce(ts_us, 0) AS ts_us, {single("CASE WHEN isfinite(speed) THEN speed END")} AS speed, {single(finite('acc_x'))} AS acc_x, {single(finite('gyro_z'))} AS gyro_z,
  coalesce(event, '') AS event, {r6('seq + 0.5e0')} AS altitude_m, '' AS zone, CAST(NULL AS VARCHAR) AS weather FROM rough"""


def labels(spark: SparkSession, d: str) -> DataFrame:
    """Numbered deliveries, thinned and followed-up labels, masks, units and swapped coordinates, side by side: one pass over the trace, each label
    taken aside before the next operator gets its own."""
    df = view(spark, d).withColumns({"delivery": F.col("seq") % 700 == 650, "flag_stop": (F.col("speed") == 0).cast("int"), "_own": F.col("event")})
    marked = F.when(F.col("seq") % 100 < 3, "freinage").when(F.col("seq") % 100 == 50, F.concat(F.lit("stop_"), F.col("seq"))).otherwise(F.col("_own"))
    df = C.number_deliveries(df).withColumns({"numbered": F.col("event"), "event": marked})
    df = C.thin_consecutive(df).withColumns({"thinned": F.col("event"), "event": marked})
    df = D.follow_up_event(df).withColumns({"followed": F.col("event"), "event": F.col("_own")})
    df = df.withColumns({"by_label": D.stop_wait_mask(df), "by_flag": D.stop_wait_mask(df.drop("event"))})
    df = df.withColumn("point", F.when(F.col("seq") % 2 == 0, F.array("lat", "lon")).otherwise(F.array(F.col("lon") + 100, F.col("lat")))).drop("lat", "lon")
    df = C.target_speed_diff(C.to_g(io.normalize_lonlat(df), "acc_y", milli=True).withColumn("target_speed", F.lit(9.5)))
    return rounded(df.select("trip_id", "seq", "numbered", "thinned", "followed", "by_label", "by_flag", "lat", "lon", "acc_y_mg", "speed_diff"))


MARKED = "CASE WHEN seq % 100 < 3 THEN 'freinage' WHEN seq % 100 = 50 THEN concat('stop_', seq) ELSE event END"
LABELS = f"""WITH m AS (SELECT *, {MARKED} AS m FROM trace), l AS (SELECT *, {lag('m')} AS m1, {lag('m', 10)} AS m10, sum(CASE WHEN seq % 700 = 650 THEN 1 ELSE 0 END) OVER {UPTO} AS nth FROM m)
SELECT trip_id, seq, CASE WHEN seq % 700 = 650 THEN printf('stop_%03d', CAST(nth AS INT)) ELSE event END AS numbered, CASE WHEN m = m1 AND m IN ('freinage', 'acceleration', 'trottoir', 'nid_de_poule', 'dos_dane') THEN NULL ELSE m END AS thinned,
  CASE WHEN regexp_matches(m10, '^(stop|wait)_[0-9]+') THEN CASE WHEN m IS NULL OR trim(m) = '' THEN 'ouverture' ELSE concat(m, '|ouverture') END ELSE m END AS followed,
  coalesce(upper(event) IN ('STOP', 'WAIT'), false) AS by_label, speed = 0 AS by_flag, {r6('lat')} AS lat, {r6('CASE WHEN seq % 2 = 0 THEN lon ELSE lon + 100 END')} AS lon, {r6('acc_y / 9.81e0 * 1000')} AS acc_y_mg, {r6('speed - 9.5e0')} AS speed_diff FROM l"""


def rough_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Rough rows sorted and numbered, times made to rise, positions filled, and an event taken back."""
    df = view(spark, d, "rough").withColumns({"lat": F.when(F.col("lat").between(-90, 90), F.col("lat")), "lon": F.when(~F.isnan("lon") & F.col("lon").between(-180, 180), F.col("lon")), "ts_us": F.floor(F.col("ts_us") / 300_000) * 300_000})
    filled = C.fill_coordinates(df).select("trip_id", "seq", "lat", "lon")
    rising = C.strictly_increasing_ts(df.where("ts_us IS NOT NULL").select("trip_id", "seq", "ts_us")).select("trip_id", "seq", F.col("ts_us").alias("rising_us"))
    whole = C.sort_and_dropna(df.select("trip_id", "seq", "ts_us", "acc_x", "gyro_z")).groupBy("trip_id").agg(F.count("*").alias("n_whole"), F.max("seq").alias("last_whole"))
    taken = C.remove_events(view(spark, d).withColumn("event_id", F.concat(F.lit("e"), F.col("seq") % 5)), ["e2", "e4"]).select("trip_id", "seq", F.col("event").alias("left_event"), "event_id")
    return rounded(filled.join(rising, ["trip_id", "seq"], "left").join(taken, ["trip_id", "seq"]).join(whole, "trip_id", "left"))


def _fill(c: str) -> str:
    return f"coalesce({c}, a_{c} + (seq - i_{c}) / CAST(j_{c} - i_{c} AS DOUBLE) * (b_{c} - a_{c}), b_{c}, a_{c})"


ROUGH_REPAIRED = f"""WITH r AS (SELECT trip_id, seq, ts_us // 300000 * 300000 AS ts_us, CASE WHEN isfinite(lat) AND lat BETWEEN -90 AND 90 THEN lat END AS lat, CASE WHEN isfinite(lon) AND lon BETWEEN -180 AND 180 THEN lon END AS lon, acc_x, gyro_z FROM rough),
f AS (SELECT *, {", ".join(f"last_value({c} IGNORE NULLS) OVER {UPTO} AS a_{c}, first_value({c} IGNORE NULLS) OVER {AFTER} AS b_{c}, last_value(CASE WHEN {c} IS NOT NULL THEN seq END IGNORE NULLS) OVER {UPTO} AS i_{c}, first_value(CASE WHEN {c} IS NOT NULL THEN seq END IGNORE NULLS) OVER {AFTER} AS j_{c}" for c in ("lat", "lon"))} FROM r),
n AS (SELECT trip_id, ts_us, row_number() OVER (PARTITION BY trip_id ORDER BY ts_us, seq) - 1 AS seq FROM r WHERE ts_us IS NOT NULL),
t AS (SELECT trip_id, seq, max(ts_us - 1000 * seq) OVER {UPTO} + 1000 * seq AS rising_us FROM n),
w AS (SELECT trip_id, count(*) AS n_whole, CAST(count(*) - 1 AS INT) AS last_whole FROM r WHERE ts_us IS NOT NULL AND isfinite(acc_x) AND gyro_z IS NOT NULL GROUP BY trip_id)
SELECT f.trip_id, f.seq, {r6(_fill('lat').replace('seq', 'f.seq'))} AS lat, {r6(_fill('lon').replace('seq', 'f.seq'))} AS lon, t.rising_us, CASE WHEN f.seq % 5 IN (2, 4) THEN NULL ELSE x.event END AS left_event, CASE WHEN f.seq % 5 IN (2, 4) THEN NULL ELSE concat('e', f.seq % 5) END AS event_id, n_whole, last_whole
FROM f JOIN (SELECT trip_id, seq, event FROM trace) x ON x.trip_id = f.trip_id AND x.seq = f.seq LEFT JOIN t ON t.trip_id = f.trip_id AND t.seq = f.seq LEFT JOIN w ON w.trip_id = f.trip_id"""


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.clean_trace(view(spark, d).select("trip_id", "seq", "ts_us", "lat", "lon", "speed", "acc_x", "acc_y", "acc_z", "event").withColumn("speed", F.col("speed") * 12)))


CLEANED = f"""WITH RECURSIVE t AS MATERIALIZED (SELECT *, least(speed * 12, 160e0) AS v0, avg(CASE WHEN event IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY trip_id) AS share FROM trace),
s AS MATERIALIZED (SELECT *, v0 - lag(v0) OVER (PARTITION BY trip_id ORDER BY seq) AS d FROM t),
e AS (SELECT trip_id, seq, v0 AS v FROM s WHERE seq = 0 UNION ALL SELECT s.trip_id, s.seq, CASE WHEN abs(s.d) > 30 THEN e.v + 30 * sign(s.d) ELSE s.v0 END FROM e JOIN s ON s.trip_id = e.trip_id AND s.seq = e.seq + 1)
SELECT s.trip_id, s.seq, ts_us, {r6('lat')} AS lat, {r6('lon')} AS lon, {r6('e.v')} AS speed, {", ".join(r6(clip(c, '-15e0', '15e0')) + f" AS {c}" for c in ("acc_x", "acc_y", "acc_z"))}, coalesce(event, CASE WHEN share > 0.3 THEN 'unknown' ELSE '' END) AS event
FROM s JOIN e ON e.trip_id = s.trip_id AND e.seq = s.seq"""


def node_tags(spark: SparkSession, d: str) -> DataFrame:
    nodes = view(spark, d, "road_nodes").select("node_id", "highway")
    edges = nodes.select(F.col("node_id").alias("src"), (F.col("node_id") + 50 * (1 + F.col("node_id") / 50 % 3)).cast("long").alias("dst"), F.col("node_id").alias("edge_order"), F.when((F.col("node_id") / 50) % 4 < 1, F.col("highway")).alias("highway"))
    return J.node_highway(nodes.select("node_id"), edges)


NODE_TAGS = """WITH e AS (SELECT node_id AS src, node_id + 50 * (1 + node_id // 50 % 3) AS dst, CASE WHEN node_id // 50 % 4 < 1 THEN highway END AS highway FROM road_nodes),
i AS (SELECT dst, arg_min(highway, src) AS h FROM e WHERE highway IS NOT NULL GROUP BY dst)
SELECT n.node_id, coalesce(o.highway, i.h, 'unknown') AS highway FROM road_nodes n LEFT JOIN e o ON o.src = n.node_id AND o.highway IS NOT NULL LEFT JOIN i ON i.dst = n.node_id"""


def elevations_compared(spark: SparkSession, d: str) -> DataFrame:
    """Nearest against bilinear elevation, the share of bad altitudes, and the end of the profile."""
    df, dem = view(spark, d), view(spark, d, "dem")
    a, b = J.elevation_join(df, dem), J.elevation_join(df, dem, mode="bilinear")
    bad = Q.elevation_quality(a.withColumn("altitude", F.when(F.col("seq") % 90 > 0, F.col("altitude")).otherwise(-1000.0)))
    profile = A.altitude_profile(a.withColumn("altitude_m", F.col("altitude"))).groupBy("trip_id").agg(F.max("distance_m").alias("profile_m"), F.max_by("altitude_m", "seq").alias("last_altitude_m"))
    flat = lambda x: x.select("trip_id", "seq", F.col("altitude").alias("altitude_m"), F.lit(0.0).alias("slope_percent"))
    return rounded(J.compare_elevation(flat(a), flat(b)).join(bad, "trip_id").join(profile, "trip_id"))


COMPARED = f"""WITH i AS (SELECT *, CAST(floor(lat * 1000) AS INT) AS i, CAST(floor(lon * 1000) AS INT) AS j FROM trace),
a AS (SELECT i.*, lat * 1000 - i AS a, lon * 1000 - j AS b, z0.altitude_m AS z00, z1.altitude_m AS z01, z2.altitude_m AS z10, z3.altitude_m AS z11, {STEP} AS m FROM i LEFT JOIN dem z0 ON z0.lat_i = i AND z0.lon_i = j
      LEFT JOIN dem z1 ON z1.lat_i = i AND z1.lon_i = j + 1 LEFT JOIN dem z2 ON z2.lat_i = i + 1 AND z2.lon_i = j LEFT JOIN dem z3 ON z3.lat_i = i + 1 AND z3.lon_i = j + 1),
z AS (SELECT *, z00 - coalesce((1 - a) * ((1 - b) * z00 + b * z01) + a * ((1 - b) * z10 + b * z11), z00) AS d FROM a)
SELECT trip_id, count(*) AS n, {r6('avg(d)')} AS mean_diff_m, {r6('max(abs(d))')} AS most_diff_m, 0e0 AS mean_slope_diff, {r6('avg(CASE WHEN seq % 90 = 0 THEN 1 ELSE 0 END)')} AS reject_rate, avg(CASE WHEN seq % 90 = 0 THEN 1 ELSE 0 END) <= 0.01 AS elevation_ok,
  {r6('sum(m)')} AS profile_m, {r6('arg_max(z00, seq)')} AS last_altitude_m FROM z GROUP BY trip_id"""


def metre_points(spark: SparkSession, d: str) -> DataFrame:
    dense = S.densify_1m(view(spark, d)).groupBy("trip_id").agg(F.count("*").alias("n_points"), F.avg("lat").alias("lat"))
    retimed = S.retimestamp_by_index(view(spark, d), 20.0).groupBy("trip_id").agg(F.max("ts_us").alias("last_us"))
    return rounded(dense.join(retimed, "trip_id").join(K.total_distance(view(spark, d)), "trip_id"))


METRES = f"""WITH s AS (SELECT trip_id, seq, ts_us, lat, {lead('lat')} AS lat2, {metres('lat', 'lon', lead('lat'), lead('lon'))} AS m FROM trace),
p AS (SELECT trip_id, lat, lat2, n, unnest(range(0, n + 1)) AS part FROM (SELECT *, greatest(1, CAST(floor(m) AS INT)) AS n FROM s WHERE lat2 IS NOT NULL) z),
q AS (SELECT trip_id, count(*) AS n_points, avg(lat + part / CAST(n AS DOUBLE) * (lat2 - lat)) AS lat FROM p GROUP BY trip_id)
SELECT q.trip_id, n_points, {r6('any_value(q.lat)')} AS lat, min(ts_us) + max(seq) * 50000 AS last_us, {r6('sum(coalesce(m, 0e0))')} AS distance_m FROM q JOIN s ON s.trip_id = q.trip_id GROUP BY q.trip_id, n_points"""


def limits(spark: SparkSession, d: str) -> DataFrame:
    df = view(spark, d).withColumn("speed", F.when(F.col("trip_id") % 5 == 1, 0.0).when((F.col("trip_id") % 5 == 2) & (F.col("seq") % 9 == 0), None).otherwise(F.col("speed"))).withColumn("acc_y", F.when(F.col("trip_id") % 5 == 3, 0.1).otherwise(F.col("acc_y")))
    fallback = Q.checklist(df.withColumn("speed_kmh", -F.col("seq").cast("double"))).select("trip_id", "speed_nonnegative")
    return rounded(Q.max_speed_ok(df, 45.0).join(Q.integrity_flags(df), "trip_id").join(fallback, "trip_id"))


LIMITS = f"""WITH v AS (SELECT *, CASE WHEN trip_id % 5 = 1 THEN 0e0 WHEN trip_id % 5 = 2 AND seq % 9 = 0 THEN NULL ELSE speed END AS v, CASE WHEN trip_id % 5 = 3 THEN 0.1e0 ELSE acc_y END AS ay FROM trace)
SELECT trip_id, {r6('max(v) * 3.6e0')} AS max_kmh, max(v) * 3.6e0 <= 45 AS max_speed_ok, max(abs(v)) = 0 AS all_zero, count(*) FILTER (v IS NULL) AS null_speeds, coalesce(stddev_samp(acc_x), 0) < 1e-3 AS acc_x_flat, coalesce(stddev_samp(ay), 0) < 1e-3 AS acc_y_flat,
  CASE WHEN max(abs(v)) > 0 THEN min(coalesce(v, 0)) >= -1e-6 ELSE max(seq) = 0 END AS speed_nonnegative FROM v GROUP BY trip_id"""


def totals(spark: SparkSession, d: str) -> DataFrame:
    """Label counts with their total, the fleet's top speed and distance, and the holds of all plans."""
    df = view(spark, d)
    a = A.event_counts(df, total=True).select(F.col("event").alias("name"), F.col("n").cast("double").alias("value"))
    m = A.max_speed_summary(df)
    b = m.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in m.columns))).alias("x")).select("x.*")
    holds = A.hold_summary(view(spark, d, "delivery_plan").select("plan_id", F.col("stop_seq").alias("leg_idx"), "stop_id", F.col("service_s").alias("hold_s")))
    c = holds.select(F.concat(F.lit("plan "), "plan_id").alias("name"), (F.col("total_s") + F.size("items") + F.col("n_holds") / 1000).alias("value"))
    return rounded(a.unionByName(b).unionByName(c))


TOTALS = f"""WITH s AS (SELECT *, {STEP} AS m FROM trace), l AS (SELECT event, count(*) AS n FROM trace WHERE NOT {BLANK} GROUP BY event)
SELECT event AS name, {r6('n')} AS value FROM l UNION ALL SELECT 'total', {r6('sum(n)')} FROM l UNION ALL SELECT 'max_speed', {r6('max(speed)')} FROM s UNION ALL SELECT 'distance_m', {r6('sum(m)')} FROM s
UNION ALL SELECT 'n_trips', {r6('count(DISTINCT trip_id)')} FROM s UNION ALL SELECT concat('plan ', plan_id), {r6('sum(service_s) + count(*) + count(*) / 1000e0')} FROM delivery_plan GROUP BY plan_id"""


QUERIES = {
    "s_csv": csv_round_trip, "s_export": export, "s_anomalies": anomalies_written, "s_weather": weather_read, "s_zones": zones_read, "s_routes": routes, "s_plan": plan_read, "p_schemas": schemas, "p_labels": labels, "c_rough": rough_repaired, "c_cleaned": cleaned,
    "j_nodes": node_tags, "j_compared": elevations_compared, "r_metres": metre_points, "q_limits": limits, "a_totals": totals,
}
ORACLES = {
    "s_csv": with_views(CSV, "trace"), "s_export": with_views(EXPORT, "trace"), "s_anomalies": with_views(ANOMALIES, "trace"), "s_weather": with_views(WEATHER_READ, "weather"), "s_zones": with_views(ZONES_READ, "zones"), "s_routes": with_views(ROUTES, "delivery_plan"), "s_plan": with_views(PLAN_READ, "delivery_plan"),
    "p_schemas": with_views(SCHEMAS, "rough"), "p_labels": with_views(LABELS, "trace"), "c_rough": with_views(ROUGH_REPAIRED, "rough"), "c_cleaned": with_views(CLEANED, "trace"), "j_nodes": with_views(NODE_TAGS, "road_nodes"), "j_compared": with_views(COMPARED, "dem"),
    "r_metres": with_views(METRES, "trace"), "q_limits": with_views(LIMITS, "trace"), "a_totals": with_views(TOTALS, "trace", "delivery_plan"),
}
