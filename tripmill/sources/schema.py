"""Dataset schemas: ordered columns with unit, allowed values and nullability, and their enforcement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The canonical columns with type, unit and nullability.
COLUMNS = (
    ("timestamp", "timestamp", "", False), ("lat", "double", "deg", False), ("lon", "double", "deg", False), ("speed", "float", "m/s", False),
    ("acc_x", "float", "m/s2", False), ("acc_y", "float", "m/s2", False), ("acc_z", "float", "m/s2", False), ("gyro_x", "float", "rad/s", False), ("gyro_y", "float", "rad/s", False), ("gyro_z", "float", "rad/s", False),
    ("event", "string", "", True), ("road_type", "string", "", True),
)
#: The columns of an exported trace, in order.
EXPORT_COLUMNS = ("timestamp", "lat", "lon", "speed", "acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z", "event", "road_type", "heading", "sinuosity", "curvature", "osm_highway", "altitude", "slope_percent")


def canonical() -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(t), null, {"unit": unit}) for n, t, unit, null in COLUMNS])


def load_schema(specs: list[dict]) -> T.StructType:
    """Ordered column specs (name, dtype, unit, nullable, values) as a schema; unknown dtypes are strings."""
    kinds = {"datetime": "timestamp", "float64": "double", "float32": "float", "int8": "tinyint", "int32": "int", "int64": "bigint", "bool": "boolean", "category": "string"}
    return T.StructType([T.StructField(s["name"], T._parse_datatype_string(kinds.get(s.get("dtype"), "string")), s.get("nullable", True), {k: s[k] for k in ("unit", "values") if k in s}) for s in specs])


def merge_schema(base: T.StructType, *fragments: T.StructType) -> T.StructType:
    """Appends the fields whose name is new."""
    fields = list(base.fields)
    for fragment in fragments:
        fields += [f for f in fragment.fields if f.name not in {g.name for g in fields}]
    return T.StructType(fields)


def apply(df: DataFrame, enricher, config: dict | None = None) -> DataFrame:
    """An enricher, a function (df, **config) -> df, over the frame. What it adds to the schema is its ``fragments`` (merge_schema); columns
    named there that it did not make are added as nulls."""
    out = df.transform(enricher, **(config or {}))
    fragments = getattr(enricher, "fragments", ())
    return out.withColumns({f.name: F.lit(None).cast(f.dataType) for fragment in fragments for f in fragment.fields if f.name not in out.columns})


def missing_columns(df: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if n not in df.columns]


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    if missing := missing_columns(df, names):
        raise ValueError(f"missing columns: {missing}")
    return df


def enforce_schema_order(df: DataFrame, names: list[str], drop_extras: bool = True, altitude_alias: bool = True) -> DataFrame:
    """The named columns first, missing ones null; extras dropped or last. Without names the frame is unchanged."""
    if not names:
        return df
    if altitude_alias and "altitude_m" in names and "altitude_m" not in df.columns and "altitude" in df.columns:
        df = df.withColumn("altitude_m", F.col("altitude"))
    extras = [] if drop_extras else [c for c in df.columns if c not in names]
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in names), *extras)


def apply_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Casts: bad or missing numbers 0, missing text of a required column '', bad times of a required column the epoch; extras last."""
    out = []
    for f in schema.fields:
        kind = f.dataType.simpleString()
        value = F.expr(f"try_cast(`{f.name}` AS {kind})") if f.name in df.columns else F.lit(None).cast(kind)
        if isinstance(f.dataType, T.NumericType):
            value = F.coalesce(value, F.lit(0).cast(kind))
        elif not f.nullable:
            value = F.coalesce(value, F.lit("").cast(kind) if kind == "string" else F.timestamp_micros(F.lit(0)) if kind == "timestamp" else F.lit(None).cast(kind))
        out.append(value.alias(f.name))
    return df.select(*out, *(c for c in df.columns if c not in schema.names))


def enforce_export_schema(df: DataFrame) -> DataFrame:
    """Casts the known columns and puts the canonical ones first."""
    known = {n: t for n, t, _, _ in COLUMNS if n in df.columns}
    df = df.withColumns({n: F.expr(f"try_cast(`{n}` AS {t})") for n, t in known.items()})
    return df.select(*known, *(c for c in df.columns if c not in known))
