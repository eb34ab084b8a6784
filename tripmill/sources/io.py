"""Reading and writing traces, weather, zones, routes, plans and run directories, all as distributed reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmill.operators import detect
from tripmill.operators.quality import duplicate_keys
from tripmill.operators.resample import shift_start
from tripmill.sources.schema import EXPORT_COLUMNS, apply_schema, canonical, missing_columns, require_columns


def read_traces(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV (by its header's names) or Parquet traces; CSV columns are cast to the schema."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    df = spark.read.csv(path, header=True)
    known = {f.name: f.dataType.simpleString() for f in (schema or canonical()).fields}
    df = df.select(*(F.expr(f"try_cast(`{c}` AS {known.get(c, 'string')})").alias(c) for c in df.columns))
    return df.withColumn("ts_us", F.unix_micros("timestamp")) if "timestamp" in df.columns else df


def write_traces_csv(df: DataFrame, path: str, columns: tuple[str, ...] = EXPORT_COLUMNS) -> None:
    require_columns(df, list(columns)).select(*columns).write.csv(path, header=True)


def write_traces_padded(df: DataFrame, path: str, columns: tuple[str, ...] = EXPORT_COLUMNS) -> None:
    write_traces_csv(df.withColumns({c: F.lit(None).cast("string") for c in missing_columns(df, list(columns))}), path, columns)


def export_dataset(df: DataFrame, path: str, run_id: str, start_us: int | None = None, schema: T.StructType | None = None, artifacts: bool = False) -> dict:
    """Moves trips to a start time, makes labels of flags, applies the schema and writes a run's partition; a run that is written
    again replaces its own. With ``artifacts`` also CSV and JSON lines of the run, compressed, in folders beside (path_csv, path_json).

    The rows are computed once: their number is observed while they are written, and the artifacts are copies of the written partition. The
    manifest (path_meta) comes last and commits the run: without it a run doesn't count as written. Returns the manifest.
    """
    spark = df.sparkSession
    if start_us is not None:
        df = shift_start(df, start_us)
    df = event_from_flags(df).withColumn("timestamp", F.timestamp_micros("ts_us"))
    rows = apply_schema(df, schema or canonical())
    _remove(spark, f"{path}_meta/run_id={run_id}")
    seen = Observation()
    at = lambda kind: f"{path}{kind}/run_id={run_id}"
    rows.observe(seen, F.count(F.lit(1)).alias("n_points")).write.mode("overwrite").parquet(at(""))
    if artifacts:
        back = spark.read.schema(rows.schema).parquet(at(""))
        back.select(*(c for c, t in back.dtypes if not t.startswith(("array", "map", "struct")))).write.mode("overwrite").option("header", True).option("zlib.compress.level", "BEST_SPEED").csv(at("_csv"), compression="gzip")
        back.write.mode("overwrite").option("zlib.compress.level", "BEST_SPEED").json(at("_json"), compression="gzip")
    found = {"n_points": seen.get["n_points"], "columns": [*rows.columns, "run_id"], "version": "1.0"}
    spark.createDataFrame([(*found.values(),)], "n_points long, columns array<string>, version string").withColumn("finished", F.current_timestamp()).coalesce(1).write.json(at("_meta"))
    return {"run_id": run_id, **found}


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def event_from_flags(df: DataFrame) -> DataFrame:
    """For trips without any label: wait, then stop, from the flags; stop wins."""
    flags = [(c, label) for c, label in (("flag_stop", "stop"), ("flag_wait", "wait")) if c in df.columns]
    if not flags:
        return df
    labelled = F.max(F.col("event").isNotNull()).over(W.partitionBy("trip_id"))
    label = F.coalesce(*(F.when(F.col(c) > 0, label) for c, label in flags))
    return df.withColumn("_any", labelled).withColumn("event", F.when(F.col("_any"), F.col("event")).otherwise(label)).drop("_any")


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, if no key (time to 0.1 s, place to 6 decimals) repeats and every event_id stands on one row."""
    if duplicate_keys(df).limit(1).count():
        raise ValueError("rows share time and place")
    if "event_id" in df.columns and df.where("event_id IS NOT NULL").groupBy("event_id").count().where("count > 1").limit(1).count():
        raise ValueError("an event_id stands on several rows")
    df.write.json(path)


def manifest(df: DataFrame, run_id: str, version: str = "1.0") -> DataFrame:
    return df.agg(F.count("*").alias("n_points")).select(F.lit(run_id).alias("run_id"), "n_points", F.array(*(F.lit(c) for c in df.columns)).alias("columns"), F.lit(version).alias("version"))


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The manifests of all committed runs: run_id, n_points, columns, version, finished. No run's own files are opened."""
    return spark.read.schema("n_points long, columns array<string>, version string, finished timestamp, run_id string").json(f"{path}_meta")


def latest_run(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the run that was committed last (of one time the largest run_id), with run_id; unfinished runs don't count, and only the
    run's own partition is read."""
    last = runs(spark, path).orderBy(F.desc("finished"), F.desc("run_id")).first()
    if last is None:
        raise ValueError(f"no finished run in {path}")
    return spark.read.parquet(f"{path}/run_id={last['run_id']}").withColumn("run_id", F.lit(last["run_id"]))


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True, schema="timestamp timestamp, lat double, lon double, temperature double, humidity double, wind_speed double, precipitation double")
    return df.select(F.unix_micros("timestamp").alias("ts_us"), *df.columns[1:])


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON polygons of one file or a folder -> zone_id, zone_type, ring array<struct<lat, lon>> (outer rings; coordinates are lon, lat).
    zone_id rises in the order of the files' names and of the zones within a file, and no two zones share one."""
    schema = "features array<struct<properties: struct<zone_type: string>, geometry: struct<coordinates: array<array<array<double>>>>>>"
    files = spark.read.json(path, schema=schema, multiLine=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode("features").alias("nth", "f"))
    sizes = files.groupBy("file").agg(F.max("nth").alias("last"))
    before = F.coalesce(F.sum(F.col("last").cast("long") + 1).over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a file
    rows = files.join(sizes.select("file", before.alias("before")), "file")
    ring = F.transform(F.col("f.geometry.coordinates")[0], lambda p: F.struct(p[1].alias("lat"), p[0].alias("lon")))
    return rows.select((F.col("before") + F.col("nth")).alias("zone_id"), F.col("f.properties.zone_type").alias("zone_type"), ring.alias("ring"))


ROUTES = "struct<routes: array<struct<duration: double, geometry: struct<coordinates: array<array<double>>>, legs: array<struct<annotation: struct<duration: array<double>>, steps: array<struct<maneuver: struct<type: string, location: array<double>>>>>>>>>"


def flatten_routes(routes: DataFrame) -> DataFrame:
    """(route_id, body: JSON text) -> route_id, pt_idx, lat, lon, t_rel_s of the first route: segment durations summed where their
    number fits, else spread evenly."""
    r = routes.select("route_id", F.from_json("body", ROUTES).getField("routes")[0].alias("r"))
    segs = F.flatten(F.transform(F.coalesce("r.legs", F.array()), lambda leg: F.coalesce(leg.annotation.duration, F.array())))
    r = r.select("route_id", F.col("r.duration").alias("dur"), F.col("r.geometry.coordinates").alias("pts"), segs.alias("segs")).withColumn("before", F.concat(F.array(F.lit(0.0)), "segs"))
    rows = r.select("route_id", "dur", F.size("pts").alias("n"), (F.size("segs") == F.size("pts") - 1).alias("fits"), F.posexplode(F.arrays_zip("pts", "before")).alias("pt_idx", "p"))
    rows = rows.where("pt_idx < n")
    along = F.sum("p.before").over(W.partitionBy("route_id").orderBy("pt_idx").rowsBetween(W.unboundedPreceding, 0))
    at = F.when(F.col("fits"), along).otherwise(F.col("dur") * F.col("pt_idx") / F.greatest(F.col("n") - 1, F.lit(1)))
    return rows.select("route_id", "pt_idx", F.col("p.pts")[1].alias("lat"), F.col("p.pts")[0].alias("lon"), at.alias("t_rel_s"))


def extract_roundabouts(routes: DataFrame) -> DataFrame:
    """(route_id, body) -> route_id, type, lat, lon of every roundabout or rotary manoeuvre."""
    r = routes.select("route_id", F.explode(F.from_json("body", ROUTES).getField("routes")).alias("r"))
    m = r.select("route_id", F.explode("r.legs").alias("l")).select("route_id", F.explode("l.steps").alias("s")).select("route_id", "s.maneuver.*")
    return m.where(F.col("type").isin("roundabout", "rotary")).select("route_id", "type", F.col("location")[1].alias("lat"), F.col("location")[0].alias("lon"))


def normalize_lonlat(points: DataFrame, c: str = "point") -> DataFrame:
    """array [a, b] -> lat, lon: a is the latitude if |a| <= 90 and |b| <= 180, else the longitude."""
    a, b = F.col(c)[0], F.col(c)[1]
    first = (F.abs(a) <= 90) & (F.abs(b) <= 180)
    return points.withColumns({"lat": F.when(first, a).otherwise(b), "lon": F.when(first, b).otherwise(a)})


def read_stop_plan(spark: SparkSession, path: str) -> DataFrame:
    """Ordered stops (plan_id, stop_seq, ...); fails if any plan has fewer than two."""
    df = spark.read.parquet(path)
    short = df.groupBy("plan_id").count().where("count < 2").limit(1).collect()
    if short or df.isEmpty():
        raise ValueError("a plan needs two stops" + (f": {short[0]['plan_id']}" if short else ""))
    return df


def write_anomalies(df: DataFrame, path: str) -> None:
    """JSON lines, one a trip: the samples of GPS jumps and of speed anomalies."""
    jumps = detect.gps_jumps(df).groupBy("trip_id").agg(F.array_sort(F.collect_list("seq")).alias("gps_jumps"))
    speeds = detect.speed_anomalies(df).groupBy("trip_id").agg(F.array_sort(F.collect_list("seq")).alias("speed_anomalies"))
    jumps.join(speeds, "trip_id", "full").write.json(path)
