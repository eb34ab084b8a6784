"""Cells on the globe for joins within a distance, and the search for a nearest point at any distance.

Within a distance (``home``, ``cover``): bands of latitude as high as the distance, each cut into cells as wide as the distance at its
narrowest edge, so cells hold about the same area from the equator to the poles and wrap around at 180 degrees. Points closer than the
distance have the one's home among the other's cover: nothing is missed, at any place.

Nearest at any distance (``nearest_points``): what is near is found in the cells around. Rows with nothing around go down a pyramid of
ever smaller cells that hold points, from the whole globe: a cell is left out when its nearest corner is further than some
point of another cell surely is. So a row meets a few cells a level however far it is from everything, and only then points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmill.functions import geo
from tripmill.functions.windows import written

#: Metres a degree of latitude on the sphere of ``geo.haversine``, rounded down, so that cells are never too small.
DEGREE_M = 111_194.9


def _band(lat: Column, metres: float) -> Column:
    return F.floor((lat + 90) / (metres / DEGREE_M)).cast("long")


def _cells_in(band: Column, metres: float) -> Column:
    """How many cells a band has: the distance fits into each at the band's edge that is nearer to a pole."""
    high = metres / DEGREE_M
    edge = F.least(F.lit(90.0), F.greatest(F.abs(band * high - 90), F.abs((band + 1) * high - 90)))
    return F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(edge)) / high)).cast("long")


def home(lat: Column, lon: Column, metres: float) -> dict[str, Column]:
    """The cell of a position: columns cell_lat, cell_lon."""
    band = _band(lat, metres)
    n = _cells_in(band, metres)
    return {"cell_lat": band, "cell_lon": F.pmod(F.floor((lon + 180) / 360 * n).cast("long"), n)}


def cover(df: DataFrame, metres: float, lat: str, lon: str) -> DataFrame:
    """Each row once for every cell that may hold a position closer than the distance: cell_lat, cell_lon."""
    r = metres / geo.EARTH_M
    # how far in longitude a circle of the radius reaches; around a pole, everywhere
    sine = F.sin(F.lit(r)) / F.cos(F.radians(lat))
    wide = F.when((F.abs(lat) + metres / DEGREE_M < 90) & (sine < 1), F.degrees(F.asin(sine)) * (1 + 1e-9) + 1e-9).otherwise(F.lit(180.0))

    def cells(band: Column) -> Column:
        n = _cells_in(band, metres)
        first, last = (F.floor((F.col(lon) + s * wide + 180) / 360 * n).cast("long") for s in (-1, 1))
        last = F.least(last, first + n - 1)  # once around at most
        return F.transform(F.sequence(first, last), lambda c: F.struct(band.alias("cell_lat"), F.pmod(c, n).alias("cell_lon")))

    around = F.array_distinct(F.flatten(F.array(*(cells(_band(F.col(lat), metres) + i) for i in (-1, 0, 1)))))
    return df.withColumn("_cell", F.explode(around)).select("*", "_cell.*").drop("_cell")


def neighbours(df: DataFrame, size: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Each row once for its square cell of ``size`` degrees and each of the eight around it: cell_lat, cell_lon."""
    around = F.array(*(F.struct((geo.cell(F.col(lat), size) + i).alias("cell_lat"), (geo.cell(F.col(lon), size) + j).alias("cell_lon")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    return df.withColumn("_cell", F.explode(around)).select("*", "_cell.*").drop("_cell")


def let(x: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(x), fn)[0]


def cuts(size: float) -> int:
    """How often cells of so many degrees are cut into 8 x 8 until they are smaller than some twenty metres."""
    n = 0
    while size / 8**n > 2e-4:
        n += 1
    return n


def leaf(size: float, lat: str = "lat", lon: str = "lon") -> dict[str, Column]:
    """The smallest cell of a position: columns i, j."""
    return {"i": geo.cell(F.col(lat), size / 8 ** cuts(size)), "j": geo.cell(F.col(lon), size / 8 ** cuts(size))}


def prune(items: Column, distance: Callable, size: float, reach: float | None = None, possible: Callable | None = None, sure: Callable | None = None) -> Column:
    """Of the items those that may be nearest to some position of the cell i, j of ``size`` degrees: no further from its centre than the nearest
    (of those that are ``sure`` to count) and the cell's width; with ``reach`` only those that may be within it."""
    lat, lon, radius = (F.col("i") + 0.5) * size, (F.col("j") + 0.5) * size, size * 0.70711 + 1e-11
    met = F.filter(items, possible) if possible else items
    each = F.transform(met, lambda p: F.struct(distance(p, lat, lon).alias("d"), p.alias("p")))
    least = lambda y: F.array_min(F.transform(y, lambda z: F.when(sure(z.p), z.d) if sure else z.d))
    most = lambda y: F.coalesce(least(y) + 2 * radius, F.lit(float("inf")))
    bound = (lambda y: F.least(most(y), F.lit(reach + radius))) if reach is not None else most
    kept = let(each, lambda y: let(F.struct(bound(y).alias("m"), y.alias("y")), lambda x: F.filter(x.y, lambda z: z.d <= x.m)))
    return F.transform(kept, lambda z: z.p)


def refine(leaves: DataFrame, coarse: DataFrame, distance: Callable, size: float, same: tuple[str, ...] = (), **kinds) -> DataFrame:
    """leaves (same, i, j of ``leaf``, more), coarse (same, i, j of cells of ``size`` degrees, items) -> the leaves with the items that may be nearest in them. Cells are cut
    step by step and only what is left of a cell's items goes to its parts, so a leaf meets the items of its surroundings, however many there are."""
    found, times = coarse, [c for c in ("t0", "t1") if c in leaves.columns]
    for k in range(cuts(size), -1, -1):
        up = {c: F.shiftright(c, 3 * k).alias(c) for c in "ij"}
        cells = leaves.groupBy(*same, *up.values()).agg(F.count("*").alias("_n"), *(F.min(t) if t == "t0" else F.max(t) for t in times)).drop("_n").toDF(*same, "i", "j", *times) if k else leaves
        if k < cuts(size):
            cells = cells.withColumns({f"_{c}": F.shiftright(c, 3) for c in "ij"})
            found = found.withColumnsRenamed({"i": "_i", "j": "_j"}).select(*same, "_i", "_j", "items")
            cells = cells.join(found, [*same, "_i", "_j"], "inner" if k else "left").drop("_i", "_j")
        else:
            cells = cells.join(found, [*same, "i", "j"], "inner" if k else "left")
        found = cells.withColumn("items", prune(F.col("items"), distance, size / 8 ** (cuts(size) - k), **kinds))
    return found


def closest(items: Column, distance: Callable, values: tuple[str, ...], possible: Callable | None = None) -> Column:
    """struct<d, values> of the item that is nearest to lat, lon, with d to 12 decimals; ties to the smaller values in their order."""
    lat, lon = F.col("lat"), F.col("lon")
    met = F.filter(items, possible) if possible else items
    least = lambda y: F.array_min(F.transform(y, lambda p: distance(p, lat, lon))) + 1e-11
    first = lambda x: F.filter(x.y, lambda p: distance(p, lat, lon) <= x.m)
    whole = lambda p: F.struct(F.round(distance(p, lat, lon), 12).alias("d"), *(p[v].alias(v) for v in values))
    return let(met, lambda y: let(F.struct(least(y).alias("m"), y.alias("y")), lambda x: F.array_min(F.transform(first(x), whole))))


def _distance(metric: str) -> Column:
    lat, lon, a, b = (F.col(c) for c in ("lat", "lon", "_lat", "_lon"))
    if metric == "degrees":
        return F.round(F.sqrt(F.pow(lat - a, 2) + F.pow(lon - b, 2)), 12)
    return F.round(geo.haversine(lat, lon, a, b), 6)


def _bounds(size: float, metric: str) -> tuple[Column, Column]:
    """The least and the largest distance that a point of the cell i, j can have from the row's position."""
    y0, x0 = F.col("i") * size, F.col("j") * size
    lat, lon = F.col("lat"), F.col("lon")
    y1, x1 = y0 + size, x0 + size
    near = lambda v, lo, hi: F.greatest(lo - v, F.lit(0.0), v - hi)
    far = lambda v, lo, hi: F.greatest(F.abs(v - lo), F.abs(v - hi))
    if metric == "degrees":
        return F.sqrt(F.pow(near(lat, y0, y1), 2) + F.pow(near(lon, x0, x1), 2)), F.sqrt(F.pow(far(lat, y0, y1), 2) + F.pow(far(lon, x0, x1), 2))
    # of the haversine each factor is bounded by itself, longitudes on the shorter way around
    y0, y1 = F.greatest(y0, F.lit(-90.0)), F.least(y1, F.lit(90.0))
    wrap = lambda v: F.least(v, F.abs(360 - v))
    dx0 = F.least(near(lon, x0, x1), near(lon - 360, x0, x1), near(lon + 360, x0, x1))
    dx1 = F.when(far(lon, x0, x1) - near(lon, x0, x1) >= 180, F.lit(180.0)).otherwise(F.when((far(lon, x0, x1) > 180) & (near(lon, x0, x1) < 180), F.lit(180.0)).otherwise(F.greatest(wrap(near(lon, x0, x1)), wrap(far(lon, x0, x1)))))
    wide = lambda fn: fn(F.cos(F.radians(y0)), F.cos(F.radians(y1)))
    most = F.when((y0 < 0) & (y1 > 0), F.lit(1.0)).otherwise(wide(F.greatest))
    square = lambda d: F.pow(F.sin(F.radians(d) / 2), 2)
    metres = lambda a: 2 * geo.EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))
    least = metres(square(near(lat, y0, y1)) + F.cos(F.radians(lat)) * F.greatest(F.lit(0.0), wide(F.least)) * square(dx0))
    return least, metres(square(F.least(far(lat, y0, y1), F.lit(180.0))) + F.cos(F.radians(lat)) * most * square(dx1))


def _pyramid(points: DataFrame, size: float, same: tuple[str, ...], time: str | None) -> list[tuple[float, DataFrame]]:
    """From large to small, of each cell that holds points: same, its parent, and its children i, j with the first and last time in them."""
    sizes = [size]
    while sizes[-1] < 360:
        sizes.append(sizes[-1] * 8)
    t = F.col(time) if time else F.lit(0)
    cells = points.groupBy(*same, geo.cell(F.col("_lat"), size).alias("i"), geo.cell(F.col("_lon"), size).alias("j")).agg(F.min(t).alias("t0"), F.max(t).alias("t1"))
    cells = written(cells)
    levels = []
    for at in sizes:
        parent = {"up_i": F.floor(F.col("i") / 8).cast("long"), "up_j": F.floor(F.col("j") / 8).cast("long")}
        levels.append((at, cells.withColumns(parent)))
        cells = written(cells.groupBy(*same, *(p.alias(c) for c, p in zip("ij", parent.values()))).agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")))
    return levels[::-1]


def descend(here: DataFrame, points: DataFrame, keys: tuple[str, ...], size: float, same: tuple[str, ...], metric: str, within: tuple[str, str, int] | None, until: str | None = None, extra: float = 0.0) -> DataFrame:
    """For each row of ``here`` the cells of ``size`` degrees that may hold its nearest point: here's columns, cell_lat, cell_lon.
    A row may stand for all positions closer than half of ``extra``, and for the times up to ``until``.

    within: (a time of here, one of points, the largest gap): a cell counts as surely holding a point if its first or last time is in
    reach, and is left out if none can be.
    """
    kept = [c for c in here.columns if c not in same]
    rows, slack = here, (1e-9 if metric == "degrees" else 1e-3) + extra
    for depth, (at, cells) in enumerate(_pyramid(points, size, same, within[1] if within else None)):
        if depth == 0 and same:  # the globe: a handful of cells
            met = rows.join(cells.drop("up_i", "up_j"), list(same))
        elif depth == 0:
            four = cells.drop("up_i", "up_j")
            kind = T.ArrayType(four.schema)
            whole = F.array(*(F.struct(*(F.lit(c[f.name]).cast(f.dataType).alias(f.name) for f in four.schema)) for c in four.collect())).cast(kind)
            met = rows.withColumn("_c", F.explode(whole)).select(*rows.columns, "_c.*")
        else:
            met = rows.withColumn("_up", F.explode("_cells")).select(*same, *kept, "_up.*").join(cells, [*same, "up_i", "up_j"])
        if within:
            t, _, gap = within
            t, last = F.col(t), F.col(until or t)
            met = met.where((F.col("t1") >= t - gap) & (F.col("t0") <= last + gap))
        least, most = _bounds(at, metric)
        both = lambda c: (F.abs(F.col(c) - t) <= gap) & (F.abs(F.col(c) - last) <= gap)  # noqa: B023, E731
        sure = both("t0") | both("t1") if within else F.lit(True)
        met = met.select(*same, *kept, "i", "j", least.alias("_least"), F.when(sure, most).alias("_most"))
        each = met.groupBy(*keys, *same).agg(
            *(F.first(c).alias(c) for c in kept if c not in keys), F.coalesce(F.min("_most"), F.lit(float("inf"))).alias("_most"), F.collect_list(F.struct("_least", F.col("i").alias("up_i"), F.col("j").alias("up_j"))).alias("_cells")
        )
        near = F.transform(F.filter("_cells", lambda c: c["_least"] <= F.col("_most") + slack), lambda c: F.struct(c["up_i"].alias("up_i"), c["up_j"].alias("up_j")))
        rows = written(each.select(*same, *kept, near.alias("_cells")))
    return rows.withColumn("_c", F.explode("_cells")).select(*same, *kept, F.col("_c.up_i").alias("cell_lat"), F.col("_c.up_j").alias("cell_lon"))


def attach_nearest(df: DataFrame, points: DataFrame, values: tuple[str, ...], size: float, same: tuple[str, ...] = (), within: tuple[str, str, int] | None = None) -> DataFrame:
    """df with n (d in degrees, then the values in the order that breaks ties) of the nearest of ``points`` (_lat, _lon, values, same) at any distance; null
    without a position or a point to meet. ``same`` must agree; within: (a time of df, one of points, the largest gap between them).

    The search is made for cells that hold rows, not for rows: points in the cells of ``size`` degrees around are thinned as these are cut (``refine``), and
    only small cells with nothing around go down the pyramid. Rows meet the few points that are left in their small cell, beside each other in one row.
    """
    points = points.where("_lat IS NOT NULL AND _lon IS NOT NULL")
    there = list(dict.fromkeys(("_lat", "_lon", *values, *(within[1:2] if within else ()))))
    if not within:  # of points in one place the first by values counts
        points = points.groupBy(*same, "_lat", "_lon").agg(F.min(F.struct(*there[2:])).alias("_v")).select(*same, "_lat", "_lon", "_v.*")
    at, t = df.withColumns(leaf(size)), within and F.col(within[0])
    rows = at.where("i IS NOT NULL AND j IS NOT NULL")
    rows = rows.groupBy(*same, "i", "j").agg(F.min(t).alias("t0"), F.max(t).alias("t1")) if within else rows.select(*same, "i", "j").distinct()
    leaves, small = written(rows), size / 8 ** cuts(size)

    def distance(p: Column, lat: Column, lon: Column) -> Column:
        return F.sqrt(F.pow(lat - p._lat, 2) + F.pow(lon - p._lon, 2))

    kinds, hits = {}, None
    if within:
        kinds = {"possible": lambda p: p[within[1]].between(F.col("t0") - within[2], F.col("t1") + within[2]), "sure": lambda p: p[within[1]].between(F.col("t1") - within[2], F.col("t0") + within[2])}
        hits = lambda p: p[within[1]].between(F.col(within[0]) - within[2], F.col(within[0]) + within[2])
    gathered = F.collect_list(F.struct(*there)).alias("items")
    coarse = neighbours(points, size, "_lat", "_lon").groupBy(*same, F.col("cell_lat").alias("i"), F.col("cell_lon").alias("j")).agg(gathered)
    near = refine(leaves, coarse, distance, size, same, **kinds)
    lat, lon = (F.col("i") + 0.5) * small, (F.col("j") + 0.5) * small
    reached = F.exists("items", lambda p: (distance(p, lat, lon) + small * 0.7072 <= size) & (kinds["sure"](p) if within else F.lit(True)))
    near = written(near.withColumn("_all", F.coalesce(reached, F.lit(False))))
    found, left = near.where("_all").drop("_all"), near.where("NOT _all").drop("_all", "items")
    if not left.isEmpty():
        aside = {c: f"_k{c}" for c in left.columns if c not in same}  # the pyramid has cells and times of its own
        cells = descend(left.withColumns({"lat": lat, "lon": lon}).withColumnsRenamed(aside), points, ("_ki", "_kj"), size, same, "degrees", within and ("_kt0", *within[1:]), within and "_kt1", small * 1.4143)
        cells = cells.join(points.withColumns({"cell_lat": geo.cell(F.col("_lat"), size), "cell_lon": geo.cell(F.col("_lon"), size)}), [*same, "cell_lat", "cell_lon"])
        far = cells.groupBy(*same, *aside.values()).agg(gathered).withColumnsRenamed({k: c for c, k in aside.items()})
        far = far.withColumn("items", prune(F.col("items"), distance, small, **kinds))
        found = found.unionByName(far)
    out = at.join(found.drop("t0", "t1"), [*same, "i", "j"], "left").withColumn("n", closest(F.col("items"), distance, values, hits))
    return out.select(*df.columns, "n")


def nearest_points(here: DataFrame, points: DataFrame, keys: tuple[str, ...], values: tuple[str, ...], size: float, same: tuple[str, ...] = (), within: tuple[str, str, int] | None = None, metric: str = "degrees") -> DataFrame:
    """For each row of ``here`` (keys, lat, lon, columns ``same``) the nearest of ``points`` (_lat, _lon, values, same), at any distance:
    keys, n (d, then the values in the order that breaks ties). ``same`` must agree; within: (a time of here, one of points, the
    largest gap between them). A row without a position, or with no point to meet, is left out.

    size: the cell of the first search in degrees. It finds what is nearer than its width (in metres: than its height); what is left goes down
    the pyramid. In degrees the search is that of ``attach_nearest``.
    """
    if metric == "degrees":
        return attach_nearest(here, points, values, size, same, within).where("n IS NOT NULL").select(*keys, "n")
    here, points = here.where("lat IS NOT NULL AND lon IS NOT NULL"), points.where("_lat IS NOT NULL AND _lon IS NOT NULL")
    reach = size * DEGREE_M * 0.999
    # the rows that look for a point are spread over the cells around, the points stay as they are
    near = cover(here, size * DEGREE_M, "lat", "lon").join(points.withColumns(home(F.col("_lat"), F.col("_lon"), size * DEGREE_M)), [*same, "cell_lat", "cell_lon"])

    def best(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where(F.abs(F.col(within[0]) - F.col(within[1])) <= within[2]) if within else pairs
        return pairs.withColumn("d", _distance(metric)).groupBy(*keys).agg(F.min(F.struct("d", *values)).alias("n"))

    found = written(best(near).where(F.col("n.d") <= reach))
    left = written(here.join(found.select(*keys), list(keys), "left_anti"))
    if left.isEmpty():
        return found
    cells = descend(left, points, keys, size, same, metric, within)
    there = points.withColumns({"cell_lat": geo.cell(F.col("_lat"), size), "cell_lon": geo.cell(F.col("_lon"), size)})
    return found.union(best(cells.join(there, [*same, "cell_lat", "cell_lon"])))
