"""Polygons as cells: which cells of a square grid lie inside, and which does a border cross.

Edges are cut at the bands of the grid (one row of cells each). A band's border cells are those that its edges touch; between two of
them all cells are alike, inside or outside, so one test decides a whole run. Runs are kept as pieces of 1, 8, 64, ... cells, so the rows
of a polygon grow with its border, not with its area, and a point is found by equality of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmill.functions import geo
from tripmill.functions.windows import written

LEVELS = 6  # 8 ** 5 cells of a thousandth of a degree go around the globe nearly once


def crosses(lat: Column, lon: Column, edges: Column) -> Column:
    """Ray casting over array<struct<a, b>> of edges between struct<lat, lon>."""
    hit = lambda e: ((e.a.lat > lat) != (e.b.lat > lat)) & (lon < (e.b.lon - e.a.lon) * (lat - e.a.lat) / (e.b.lat - e.a.lat) + e.a.lon)
    return F.size(F.filter(edges, hit)) % 2 == 1


def bands(zones: DataFrame, size: float) -> DataFrame:
    """(zone_id, zone_type, ring) -> one row a zone and band: zone_id, zone_type, cell_lat, edges (those that touch the band), border (its
    cells that an edge touches, in order). Rings may be open or closed; rings without a position are no zones."""
    ring = F.filter("ring", lambda p: p.lat.isNotNull() & p.lon.isNotNull())
    after = F.concat(F.slice("_ring", 2, F.greatest(F.size("_ring"), F.lit(1))), F.slice("_ring", 1, 1))
    edge = F.explode(F.zip_with("_ring", after, lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    edges = zones.withColumn("_ring", ring).where(F.size("_ring") > 0).select("zone_id", "zone_type", edge.alias("e"))
    low, high = F.least("e.a.lat", "e.b.lat"), F.greatest("e.a.lat", "e.b.lat")
    edges = edges.withColumn("cell_lat", F.explode(F.sequence(geo.cell(low, size), geo.cell(high, size))))
    at = lambda y: F.when(high > low, F.col("e.a.lon") + (y - F.col("e.a.lat")) / (F.col("e.b.lat") - F.col("e.a.lat")) * (F.col("e.b.lon") - F.col("e.a.lon")))
    ends = [F.coalesce(at(F.greatest(F.col("cell_lat") * size, low)), F.col("e.a.lon")), F.coalesce(at(F.least((F.col("cell_lat") + 1) * size, high)), F.col("e.b.lon"))]
    first, last = F.floor(F.least(*ends) / size - 1e-6).cast("long"), F.floor(F.greatest(*ends) / size + 1e-6).cast("long")
    rows = edges.withColumn("_cells", F.sequence(first, last))
    return rows.groupBy("zone_id", "zone_type", "cell_lat").agg(F.collect_list("e").alias("edges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_cells")))).alias("border"))


def inner_pieces(banded: DataFrame, size: float) -> DataFrame:
    """The runs of cells inside as pieces of 8 ** level cells: zone_id, zone_type, cell_lat, level, piece."""
    gaps = F.zip_with(F.slice("border", 1, F.greatest(F.size("border") - 1, F.lit(0))), F.slice("border", 2, F.size("border")), lambda a, b: F.struct((a + 1).alias("p"), (b - 1).alias("q")))
    rows = banded.withColumn("run", F.explode(F.filter(gaps, lambda g: g.p <= g.q)))
    rows = rows.where(crosses((F.col("cell_lat") + 0.5) * size, (F.col("run.p") + 0.5) * size, F.col("edges")))
    none, pieces = F.array().cast("array<struct<level: int, piece: bigint>>"), []
    for level in range(LEVELS):
        width = 8**level
        p, q = F.ceil(F.col("run.p") / width).cast("long"), (F.floor((F.col("run.q") + 1) / width) - 1).cast("long")
        up, down = F.ceil(F.col("run.p") / (width * 8)).cast("long") * 8, F.floor((F.col("run.q") + 1) / (width * 8)).cast("long") * 8 - 1
        piece = lambda a, b: F.when(a <= b, F.transform(F.sequence(a, b), lambda x: F.struct(F.lit(level).alias("level"), x.alias("piece")))).otherwise(none)  # noqa: B023, E731
        pieces.append(piece(p, q) if level == LEVELS - 1 else F.when(up <= down, F.concat(piece(p, up - 1), piece(down + 1, q))).otherwise(piece(p, q)))
    return rows.select("zone_id", "zone_type", "cell_lat", F.explode(F.concat(*pieces)).alias("x")).select("zone_id", "zone_type", "cell_lat", "x.*")


def zones_at(here: DataFrame, zones: DataFrame, keys: tuple[str, ...], size: float) -> DataFrame:
    """(keys, lat, lon) -> keys, zone_id, zone_type of every zone that holds the position. Cells that hold positions are looked up once; only
    positions in cells that a border crosses are tested themselves, against the edges of their band."""
    at = here.withColumns({"cell_lat": geo.cell(F.col("lat"), size), "cell_lon": geo.cell(F.col("lon"), size)})
    banded = bands(zones, size)
    levels = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), F.floor(F.col("cell_lon") / 8**n).cast("long").alias("piece")) for n in range(LEVELS))))
    cells = at.select("cell_lat", "cell_lon").distinct().withColumn("x", levels).select("cell_lat", "cell_lon", "x.*")
    inside = cells.join(inner_pieces(banded, size), ["cell_lat", "level", "piece"]).select("cell_lat", "cell_lon", "zone_id", "zone_type")
    sure = at.join(inside, ["cell_lat", "cell_lon"]).select(*keys, "zone_id", "zone_type")
    border = banded.select("zone_id", "zone_type", "cell_lat", F.explode("border").alias("cell_lon"))
    close = at.join(border, ["cell_lat", "cell_lon"]).join(banded.select("zone_id", "cell_lat", "edges"), ["zone_id", "cell_lat"])
    return sure.union(close.where(crosses(F.col("lat"), F.col("lon"), F.col("edges"))).select(*keys, "zone_id", "zone_type"))


def last_zone_at(here: DataFrame, zones: DataFrame, size: float, out: str) -> DataFrame:
    """here with the type of the last zone by zone_id that holds the position (null: none). Zones are looked up once for every cell that holds positions:
    its last zone all around, and only the later ones whose border crosses it; a position meets those beside it in its own row."""
    zones = zones.where("zone_id IS NOT NULL")
    at = here.withColumns({"cell_lat": geo.cell(F.col("lat"), size), "cell_lon": geo.cell(F.col("lon"), size)})
    banded = written(bands(zones, size))
    cells = written(at.select("cell_lat", "cell_lon").where("cell_lat IS NOT NULL AND cell_lon IS NOT NULL").distinct())
    level = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), F.floor(F.col("cell_lon") / 8**n).cast("long").alias("piece")) for n in range(LEVELS))))
    inside = cells.withColumn("x", level).select("cell_lat", "cell_lon", "x.*").join(inner_pieces(banded, size), ["cell_lat", "level", "piece"])
    inside = inside.groupBy("cell_lat", "cell_lon").agg(F.max("zone_id").alias("_sure"), F.max(F.struct("zone_id", "zone_type")).alias("_in"))
    close = cells.join(banded.select("cell_lat", F.explode("border").alias("cell_lon"), "zone_id", "zone_type", "edges"), ["cell_lat", "cell_lon"]).join(inside.drop("_in"), ["cell_lat", "cell_lon"], "left")
    close = close.where("_sure IS NULL OR zone_id > _sure").groupBy("cell_lat", "cell_lon").agg(F.collect_list(F.struct("zone_id", "zone_type", "edges")).alias("_close"))
    met = F.filter("_close", lambda z: crosses(F.col("lat"), F.col("lon"), z.edges))
    last = F.greatest(F.col("_in"), F.array_max(F.transform(met, lambda z: F.struct(z.zone_id.alias("zone_id"), z.zone_type.alias("zone_type")))))
    known = inside.drop("_sure").join(close, ["cell_lat", "cell_lon"], "full")
    return at.join(known, ["cell_lat", "cell_lon"], "left").withColumn(out, last.getField("zone_type")).select(*here.columns, out)
