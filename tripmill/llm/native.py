"""Spark SQL text for finding all matches of a pattern with their places, without Python workers."""

from __future__ import annotations

from collections.abc import Callable


def quoted(text: str) -> str:
    """A raw SQL string literal; double quotes in the text become ``\\x22``, which patterns read the same."""
    return 'r"' + text.replace('"', r"\x22") + '"'


def matches(text: str, pattern: str, size: str = "length({})", group: int | None = None) -> str:
    """SQL for array<struct<s, e, x, y>>: start and end of each leftmost non-overlapping match, itself and a group's text.

    ``size`` measures a piece of text (code points by default). What lies between matches is what split() gives, so places
    are running sums of sizes, folded in two levels (``folded``).
    """
    of = lambda x: size.format(x)
    found = f"regexp_extract_all({text}, {pattern}, 0)"
    parts = f"regexp_extract_all({text}, {pattern}, {group})" if group else found
    both = f"zip_with({found}, {parts}, (x, y) -> struct(x AS x, y AS y))"
    zipped = f"zip_with(split({text}, {pattern}, -1), {both}, (g, m) -> struct({of('g')} AS g, {of('m.x')} AS n, m.x AS x, m.y AS y))"
    return folded(zipped, "0", SPAN, lambda p: f"IF(z.n IS NULL, {p}, {p} + z.g + z.n)", "z.n IS NOT NULL", "struct(r.p + z.g AS s, r.p + z.g + z.n AS e, z.x AS x, z.y AS y)")


def folded(items: str, start: str, kind: str, state: Callable[[str], str], emits: str, item: str) -> str:
    """SQL for a fold over an array that also gives an array: the state runs from ``start``, r.p is the one before the item z.

    Spark copies the whole state at each step of a fold, so one that holds its results is quadratic. Here a first fold, of the state
    alone, gives the state at the head of each chunk of about the root of the length; then each chunk fills its own array. The power
    of the length is 1.5.
    """
    width = "CAST(ceil(sqrt(greatest(1, size(w)))) AS INT)"
    chunks = f"transform(array({items}), w -> transform(sequence(0, CAST(greatest(0, size(w) - 1) / {width} AS INT)), j -> slice(w, j * {width} + 1, {width})))[0]"
    heads = f"aggregate(k, struct({start} AS p, slice(array({start}), 1, 0) AS h), (q, c) -> struct(aggregate(c, q.p, (p, z) -> {state('p')}) AS p, array_append(q.h, q.p) AS h), q -> q.h)"
    filled = f"aggregate(c, struct(h AS p, CAST(array() AS array<{kind}>) AS a), (r, z) -> struct({state('r.p')} AS p, IF({emits}, array_append(r.a, {item}), r.a) AS a), r -> r.a)"
    return f"flatten(transform(array({chunks}), k -> zip_with(k, {heads}, (c, h) -> {filled}))[0])"


SPAN = "struct<s:int,e:int,x:string,y:string>"
NONE = f"CAST(array() AS array<{SPAN}>)"


def gated(gate: str, value: str, otherwise: str = NONE) -> str:
    return f"CASE WHEN {gate} THEN {value} ELSE {otherwise} END"
