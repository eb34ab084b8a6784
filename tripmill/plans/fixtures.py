"""Trace and companion views as SQL over the driver tables; each text runs unchanged in Spark and DuckDB.

A trip holds the lines of 750 orders and a plan the orders of one customer, so trips and plans grow in number with the tables and not in
length. ``rough`` is the trace with values that the cleaning operators are for: missing, not finite, out of range, misspelt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmill.functions.windows import written

TRACE = """
WITH b AS (
  SELECT CAST(floor(l_orderkey / 750) AS INT) AS trip_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
         CAST(l_quantity AS INT) AS q, CAST(round(l_discount * 100) AS INT) AS d,
         CAST(round(l_tax * 100) AS INT) AS x
  FROM lineitem),
s AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY trip_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS INT) - 1 AS seq,
         CAST(count(*) OVER (PARTITION BY trip_id) AS INT) AS n FROM b),
c AS (
  SELECT *, seq % 2000 AS c,
    CASE WHEN seq < 20 OR seq >= n - 20 THEN 0
         WHEN trip_id % 2 = 0 AND seq % 2000 BETWEEN 200 AND 1449 THEN 0
         WHEN trip_id % 2 = 1 AND seq % 2000 BETWEEN 200 AND 519 THEN 0
         ELSE least(900 + 10 * (trip_id % 7) + q, 10 * (seq - 19), 10 * (n - 20 - seq)) END AS v_cms,
    (trip_id * 1700 + 9000 * CAST(floor(seq / 250) AS INT) + 4 * seq) % 36000 AS h_cdeg
  FROM s),
k AS (
  SELECT *, CAST(round(v_cms * 0.001 * cos(radians(h_cdeg / 100.0)) / 111320.0 * 1e9) AS BIGINT)
            + CASE WHEN trip_id % 4 < 3 AND seq % 1777 = 1776 THEN 9000000 WHEN trip_id % 4 < 3 AND seq % 1777 = 0 AND seq > 0 THEN -9000000 ELSE 0 END AS dlat,
            CAST(round(v_cms * 0.001 * sin(radians(h_cdeg / 100.0)) / 72800.0 * 1e9) AS BIGINT) AS dlon
  FROM c)
SELECT trip_id, seq,
  CAST(1735689600000000 + CAST(seq AS BIGINT) * 100000 AS BIGINT) AS ts_us,
  (49000000000 + CAST(sum(dlat) OVER (PARTITION BY trip_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT)) / 1e9 AS lat,
  (1000000000 + CAST(trip_id % 2000 AS BIGINT) * 50000000 + CAST(sum(dlon) OVER (PARTITION BY trip_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT)) / 1e9 AS lon,
  v_cms / 100.0e0 AS speed,
  CASE WHEN trip_id % 6 <> 0 AND seq BETWEEN 120 AND 129 THEN 1.5e0 WHEN trip_id % 6 <> 1 AND n - seq BETWEEN 131 AND 140 THEN -1.6e0
       WHEN trip_id % 3 <> 0 AND c BETWEEN 1500 AND 1509 THEN -3.5e0 WHEN trip_id % 3 <> 1 AND c BETWEEN 1550 AND 1559 THEN 3.2e0
       ELSE (q - 25) / 100.0e0 END AS acc_x,
  (d - 5) / 20.0e0 AS acc_y,
  CASE WHEN trip_id % 4 <> 0 AND c IN (1600, 1601) THEN 7.6e0 WHEN trip_id % 4 <> 0 AND c IN (1602, 1603) THEN -7.6e0 ELSE 0.05e0 * (x - 4) END AS acc_z,
  CASE WHEN trip_id % 4 <> 1 AND c IN (1601, 1651) THEN 4.0e0 ELSE (d - 5) / 100.0e0 END AS gyro_x,
  (x - 4) / 100.0e0 AS gyro_y,
  CASE WHEN trip_id % 4 <> 2 AND c = 1601 THEN 7.0e0 WHEN trip_id % 5 <> 0 AND c = 1700 THEN 60.0e0 ELSE (q - 25) / 500.0e0 END AS gyro_z,
  CASE WHEN c = 1500 THEN 'freinage' WHEN c = 1550 THEN 'acceleration' WHEN c = 1600 THEN 'dos_dane'
       WHEN v_cms = 0 AND trip_id % 2 = 0 AND c BETWEEN 200 AND 1449 THEN 'stop'
       WHEN v_cms = 0 AND trip_id % 2 = 1 AND c BETWEEN 200 AND 519 THEN 'wait'
       WHEN c = 150 THEN 'start_delivery' WHEN c = 1480 THEN 'end_delivery' END AS event,
  CASE (trip_id + CAST(floor(seq / 400) AS INT)) % 7 WHEN 0 THEN 'motorway' WHEN 1 THEN 'primary_link' WHEN 2 THEN 'secondary'
       WHEN 3 THEN 'tertiary' WHEN 4 THEN 'living_street' WHEN 5 THEN 'service' END AS osm_highway
FROM k
"""
ROAD_NODES = """
SELECT CAST(trip_id AS BIGINT) * 1000000 + seq AS node_id,
       lat + (seq / 50 % 7 - 3) * 1e-5 AS lat, lon + (seq / 50 % 5 - 2) * 1e-5 AS lon,
       coalesce(osm_highway, 'unknown') AS highway
FROM trace WHERE seq % 50 = 0
"""
WEATHER = """
SELECT ts_us + 7000000 AS ts_us, lat + 0.01 AS lat, lon - 0.01 AS lon,
       CAST(trip_id + seq % 11 AS DOUBLE) AS temperature, CAST(40 + seq % 50 AS DOUBLE) AS humidity,
       CAST(seq % 15 AS DOUBLE) AS wind_speed, CASE WHEN seq % 5 = 0 THEN 0.5e0 ELSE 0.0e0 END AS precipitation
FROM trace WHERE seq % 600 = 300
"""
DEM = """
SELECT DISTINCT CAST(floor(lat * 1000) AS INT) AS lat_i, CAST(floor(lon * 1000) AS INT) AS lon_i,
       CAST(50 + (CAST(floor(lat * 1000) AS INT) * 7 + CAST(floor(lon * 1000) AS INT) * 3) % 90 AS DOUBLE) AS altitude_m
FROM trace
"""
ZONES = """
SELECT trip_id AS zone_id, CASE trip_id % 3 WHEN 0 THEN 'urban' WHEN 1 THEN 'industrial' ELSE 'pedestrian' END AS zone_type,
       min(lat) AS lat_min, (min(lat) + max(lat)) / 2 AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max
FROM trace WHERE trip_id % 2 = 0 GROUP BY trip_id
"""
PLAN = """
SELECT plan_id, stop_seq, stop_id, 49.0e0 + (o_orderkey * 7919 % 100000) / 1e6 AS lat,
       1.0e0 + (o_orderkey * 104729 % 100000) / 1e6 AS lon,
       CASE WHEN stop_seq = 0 THEN 0 ELSE CAST(300 + o_orderkey % 900 AS INT) END AS travel_s,
       CASE WHEN stop_seq = 0 THEN 0 ELSE CAST(60 * (o_orderkey % 5) AS INT) END AS service_s,
       CASE WHEN stop_seq > 0 AND o_orderkey % 3 = 0
            THEN 1735689600 + 600 * CAST(stop_seq AS BIGINT) + o_orderkey % 3000 END AS tw_start_s
FROM (SELECT o_orderkey, CAST(o_custkey AS INT) AS plan_id, concat('S', CAST(o_orderkey AS STRING)) AS stop_id,
             CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) - 1 AS stop_seq
      FROM orders) o
"""
ROUGH = """
SELECT trip_id, seq, CASE WHEN seq % 97 = 5 THEN NULL ELSE ts_us END AS ts_us,
  CASE WHEN seq % 89 = 7 THEN NULL WHEN seq % 83 = 11 THEN 91.5e0 WHEN seq % 79 = 13 THEN CAST('Infinity' AS DOUBLE) ELSE lat END AS lat,
  CASE WHEN seq % 73 = 17 THEN -200e0 WHEN seq % 71 = 19 THEN CAST('NaN' AS DOUBLE) ELSE lon END AS lon,
  CASE WHEN seq % 67 = 23 THEN -4e0 WHEN seq % 61 = 29 THEN 300e0 WHEN seq % 59 = 31 THEN CAST('-Infinity' AS DOUBLE) ELSE speed END AS speed,
  CASE WHEN seq % 53 = 3 THEN 99e0 WHEN seq % 47 = 5 THEN NULL WHEN seq % 43 = 5 THEN CAST('NaN' AS DOUBLE) ELSE acc_x END AS acc_x,
  CASE WHEN seq % 41 = 7 THEN -99e0 ELSE acc_y END AS acc_y, CASE WHEN seq % 37 = 9 THEN -99e0 WHEN seq % 41 = 9 THEN 17.5e0 ELSE acc_z END AS acc_z, gyro_x, gyro_y, CASE WHEN seq % 31 = 8 THEN NULL ELSE gyro_z END AS gyro_z,
  CASE WHEN seq % 29 = 1 THEN '  ' WHEN seq % 23 = 2 THEN ' freinage ' WHEN seq % 19 = 3 THEN 'STOP' WHEN seq % 17 = 4 THEN 'freinage_final' ELSE event END AS event, osm_highway
FROM trace
"""
OVER_TRACE = {"road_nodes": ROAD_NODES, "weather": WEATHER, "dem": DEM, "zones": ZONES, "rough": ROUGH}


#: The trip of a line as the trace has it, so that rows shuffled by it need no other shuffle for windows over trips.
TRIP = "CAST(floor(l_orderkey / 750) AS INT)"


def parts(spark: SparkSession, path: str, each: int = 4_000_000) -> int:
    """One partition every ``each`` bytes of the files, and the session's number at least: so a task sorts some hundred trips, however many there are."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def view(spark: SparkSession, sf_dir: str, name: str = "trace", trace: DataFrame | None = None) -> DataFrame:
    """A view as a lazy DataFrame; its inputs are inlined as arguments, so no session state is left behind. trace: a ``shared`` one to read."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    if name == "delivery_plan":
        return spark.sql(PLAN.replace("FROM orders", "FROM {orders}"), orders=read("orders"))
    if trace is None:
        lines = read("lineitem").repartition(parts(spark, f"{sf_dir}/lineitem.parquet"), F.expr(TRIP))
        trace = spark.sql(TRACE.replace("FROM lineitem", "FROM {lineitem}"), lineitem=lines)
    return trace if name == "trace" else spark.sql(OVER_TRACE[name].replace("FROM trace", "FROM {trace}"), trace=trace)


def shared(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """These columns of the trace as a table of the shared folder: for queries that read it several times and would make it anew each time."""
    return written(view(spark, sf_dir).select(*columns))


def with_views(sql: str, *names: str) -> str:
    """The SQL of a query after the definitions of the views that it reads."""
    ctes = [f"trace AS MATERIALIZED ({TRACE})"] if names != ("delivery_plan",) else []
    ctes += [f"{n} AS ({PLAN if n == 'delivery_plan' else OVER_TRACE[n]})" for n in names if n != "trace"]
    own = sql.strip()
    head, rest = ("WITH RECURSIVE ", own[len("WITH RECURSIVE ") :]) if own.startswith("WITH RECURSIVE ") else ("WITH ", own[len("WITH ") :] if own.startswith("WITH ") else None)
    return head + ", ".join(ctes) + (", " + rest if rest is not None else " " + own)
