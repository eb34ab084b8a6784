"""Pieces of SQL text for the oracles."""

from __future__ import annotations

W = "(PARTITION BY trip_id ORDER BY seq)"
UPTO = "(PARTITION BY trip_id ORDER BY seq ROWS UNBOUNDED PRECEDING)"
AFTER = "(PARTITION BY trip_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


#: What moves a tie of the sixth decimal up, in queries and SQL alike.
TIE = 3.7e-10


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE) + {TIE}, 6) + 0e0"


def metres(a: str, b: str, c: str, d: str) -> str:
    h = f"(sin(radians({c} - {a}) / 2) ** 2 + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) ** 2)"
    return f"(2 * 6371000e0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def bearing(a: str, b: str, c: str, d: str) -> str:
    y = f"sin(radians({d} - {b})) * cos(radians({c}))"
    x = f"sin(radians({c} - {a})) + 2 * sin(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) ** 2"
    return f"((degrees(atan2({y}, {x})) + 360e0) % 360e0)"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER {W}"


def lead(x: str, n: int = 1) -> str:
    return f"lead({x}, {n}) OVER {W}"


STEP = f"coalesce({metres(lag('lat'), lag('lon'), 'lat', 'lon')}, 0e0)"
HEADING = f"coalesce({bearing('lat', 'lon', lead('lat'), lead('lon'))}, {bearing(lag('lat'), lag('lon'), 'lat', 'lon')}, 0e0)"


def gradient(x: str, h: str = "1e0") -> str:
    return f"CASE WHEN {lag(x)} IS NULL THEN ({lead(x)} - {x}) / {h} WHEN {lead(x)} IS NULL THEN ({x} - {lag(x)}) / {h} ELSE ({lead(x)} - {lag(x)}) / (2 * {h}) END"


def gradient_at(x: str, t: str) -> str:
    a, b = f"({t} - {lag(t)})", f"({lead(t)} - {t})"
    return f"CASE WHEN {lag(t)} IS NULL THEN ({lead(x)} - {x}) / {b} WHEN {lead(t)} IS NULL THEN ({x} - {lag(x)}) / {a} ELSE ({a} * {a} * {lead(x)} + ({b} * {b} - {a} * {a}) * {x} - {b} * {b} * {lag(x)}) / ({a} * {b} * ({a} + {b})) END"


def clip(x: str, low: str, high: str) -> str:
    return f"CASE WHEN {x} < {low} THEN {low} WHEN {x} > {high} THEN {high} ELSE {x} END"


def frame(before: int, after: int) -> str:
    return f"(PARTITION BY trip_id ORDER BY seq ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"


def islands(flag: str, table: str = "trace") -> str:
    """A FROM item: the table with run_id, null outside of runs."""
    on = f"coalesce({flag}, false)"
    return f"(SELECT *, CASE WHEN o THEN sum(CASE WHEN o AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER {UPTO} END AS run_id FROM (SELECT *, lag(o) OVER {W} AS p FROM (SELECT *, {on} AS o FROM {table}) x1) x2)"


def road_type(c: str = "osm_highway") -> str:
    from tripmill.functions.labels import HIGHWAY_TO_ROAD_TYPE

    return f"CASE WHEN {c} IS NULL OR {c} = 'unknown' THEN 'unknown' " + " ".join(f"WHEN {c} = '{k}' THEN '{v}'" for k, v in HIGHWAY_TO_ROAD_TYPE.items()) + " ELSE 'other' END"
