"""Product codes of vectors in integers, nearest entries found behind LAESA pivots (Mico, Oncina and Vidal, 1994).

Every component x becomes floor(4096 * x); a vector is cut into ``parts`` equal consecutive parts. A part position's codebook starts
as that part of the ``entries`` smallest vec_ids. ``rounds`` times every part goes to the nearest entry of its codebook (squared
distance, ties to the lower index) and every entry in use becomes its parts' componentwise floored mean; then parts are assigned
once more.

* ``pivots`` fixed points a position, spread among the first entries, are chosen once, and the distances of all parts to them are kept
  beside the rows. Each round measures entries against the pivots only; the difference of the two distances is a lower bound of that
  between part and entry. Entries are tried in order of that bound with exact integers, until it exceeds the best found: the
  bounds leave room for rounding, so results are those of the full comparison.
* A round is one scan of the kept rows; a task sends one sum an entry and component. Codebooks, parts * entries points, are all that
  passes the driver.
* Errors are summed over labels with map-side partial sums; labels with a large share of the rows are given back by broadcast, of which
  there can't be many, the others by a join on the label.

Vectors that are null, empty or hold null or non-finite components are dropped, and so are those with another number of components
than most, or all if that can't be cut into equal parts. Components beyond 65 536 in size count as that, so that squares fit in 64 bits. With fewer rows than entries
codebooks are shorter. Rows that repeat a vec_id are coded each; the smaller vector comes first among them. A null vec_id comes after all others and
is returned as null. Labels may be of any type that casts to text; null ones count as equal. Other columns are ignored. Without rows the result is
empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_by_share, table

SCALE, MOST = 4096, 1 << 28


def integer_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label, x: the kept vectors of the most common length (the shorter of two as common)."""
    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is larger than infinity
    known = known.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    first = known.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    whole = lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x * SCALE))).cast("int")
    return known.where(F.size("embedding") == (first["n"] if first else 0)).select("vec_id", "label", F.transform("embedding", whole).alias("x"))


def spread(points: np.ndarray, n: int) -> np.ndarray:
    """The first point and then each time the one farthest from those chosen."""
    chosen = [0]
    while len(chosen) < min(n, len(points)):
        far = ((points[:, None] - points[chosen]) ** 2).sum(axis=2).min(axis=1)
        chosen.append(int(far.argmax()))
    return points[chosen]


def lengths(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of points (n x width) to pivots (p x width)."""
    return np.sqrt(((points[:, None] - pivots) ** 2).sum(axis=2).astype(np.float64))


def assign(points: np.ndarray, near: np.ndarray, entries: np.ndarray, from_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of each point, its exact squared distance, and how many exact distances that took.

    near: distances of the points to the pivots, at single precision at least; from_pivots: those of the entries.
    """
    bound = np.zeros((len(points), len(entries)))
    for p in range(near.shape[1]):
        slack = 1e-6 * (near[:, p, None] + from_pivots[:, p])
        np.maximum(bound, np.abs(near[:, p, None] - from_pivots[:, p]) - slack, out=bound)
    bound *= bound
    order = np.argsort(bound, axis=1, kind="stable")
    best, which = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), len(entries))
    left, tried = np.arange(len(points)), 0
    for k in range(len(entries)):
        entry = order[left, k]
        go = bound[left, entry] <= best[left]  # the bounds of all later entries are larger still
        left, entry = left[go], entry[go]
        if not len(left):
            break
        tried += len(left)
        exact = ((points[left] - entries[entry]) ** 2).sum(axis=1)
        better = (exact < best[left]) | ((exact == best[left]) & (entry < which[left]))
        best[left[better]], which[left[better]] = exact[better], entry[better]
    return which, best, tried


def matrices(batches: Iterator[pa.RecordBatch], width: int, pivots: int, step: int = 1 << 15) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with their points and pivot distances, as (rows, parts, width) and (rows, parts, pivots)."""
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            x, near = (batch.column(batch.schema.get_field_index(c)).flatten().to_numpy() for c in ("x", "near"))
            rows = batch.num_rows
            yield batch, x.astype(np.int64).reshape(rows, -1, width), near.astype(np.float64).reshape(rows, -1, pivots)


def measured(books: list[np.ndarray], fixed: list[np.ndarray]) -> Callable:
    """x -> x with the distances of its parts to the pivots."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = books[0].shape[1]
        for whole in batches:
            for at in range(0, whole.num_rows, 1 << 15):
                batch = whole.slice(at, 1 << 15)
                x = batch.column(2).flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, len(books), width)
                near = np.concatenate([lengths(x[:, j], fixed[j]) for j in range(len(books))], axis=1).astype(np.float32)
                column = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, column], names=["vec_id", "label", "x", "near"])

    return measure


def summer(books: list[np.ndarray], fixed: list[np.ndarray]) -> Callable:
    """One assignment of all rows: for each part and entry the number of its parts and their sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, (k, width) = len(books), books[0].shape
        from_pivots = [lengths(books[j], fixed[j]) for j in range(parts)]
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for _, x, near in matrices(batches, width, len(fixed[0])):
            for j in range(parts):
                which, _, _ = assign(x[:, j], near[:, j], books[j], from_pivots[j])
                count[j] += np.bincount(which, minlength=k)
                for i in range(width):  # sums of a slice are below 2**53, so exact
                    total[j, :, i] += np.bincount(which, x[:, j, i], minlength=k).astype(np.int64)
        part, entry, at = (a.ravel() for a in np.meshgrid(np.arange(parts), np.arange(k), np.arange(width), indexing="ij"))
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in (part, entry, at, np.repeat(count.ravel(), width), total.ravel())], names=["part", "entry", "at", "n", "total"])

    return add


def coder(books: list[np.ndarray], fixed: list[np.ndarray]) -> Callable:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = books[0].shape[1]
        from_pivots = [lengths(b, p) for b, p in zip(books, fixed)]
        for batch, x, near in matrices(batches, width, len(fixed[0])):
            both = [assign(x[:, j], near[:, j], books[j], from_pivots[j])[:2] for j in range(len(books))]
            digits = np.stack([which for which, _ in both], axis=1)
            codes = ["".join(f"{d:02x}" for d in row) for row in digits.tolist()]
            error = sum(best for _, best in both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return code


def compress(vectors: DataFrame, *, parts: int = 8, entries: int = 16, rounds: int = 6, pivots: int = 4) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every kept vector, and the codebooks, one array of entries a part. vectors: vec_id, embedding, label."""
    scratch = Scratch(vectors.sparkSession, "codes")
    rows = integer_rows(vectors)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
    if not first or len(first[0]["x"]) % parts:
        return rows.where("false").selectExpr("vec_id", "label", "'' AS code", "0L AS error"), []
    points = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, -1)
    books = [points[:, j].copy() for j in range(parts)]
    fixed = [spread(b, pivots) for b in books]
    rows = scratch.keep(rows.mapInArrow(measured(books, fixed), "vec_id long, label string, x array<int>, near array<float>"), "rows")
    for _ in range(rounds):
        sums = rows.mapInArrow(summer(books, fixed), "part long, entry long, at long, n long, total long").groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0")
        books = [b.copy() for b in books]
        for part, entry, at, n, total in sums.collect():  # one row a component of the codebooks
            books[part][entry, at] = total // n
    coded = scratch.keep(rows.mapInArrow(coder(books, fixed), "vec_id long, label string, code string, error long"), "codes")
    scratch.drop(rows)
    return coded, books


def label_errors(coded: DataFrame) -> DataFrame:
    """The rows with label_error: their errors summed over equal labels."""
    coded = coded.withColumn("__label", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")))
    sums = coded.groupBy("__label").agg(F.count("*").alias("n"), F.sum("error").alias("label_error"))
    return join_by_share(coded, sums, "__label", "n").drop("__label", "n")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    digest = sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    return label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    square = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - e[i]) * (x[i] - e[i])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, part, any_value(x) AS x, min({{'d': CAST({square} AS BIGINT), 'entry': entry}}) AS m FROM p JOIN c{r} USING (part) GROUP BY vec_id, part)")
        if r < rounds:
            steps.append(
                f"u{r} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM ("
                f"SELECT part, m.entry AS entry, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, m, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY ALL) GROUP BY ALL)"
            )
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(u.e, c.e) AS e FROM c{r} c LEFT JOIN u{r} u USING (part, entry))")
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
p AS MATERIALIZED (SELECT vec_id, part, x[part * (len(x) // {parts}) + 1 : (part + 1) * (len(x) // {parts})] AS x FROM v, (SELECT CAST(unnest(range({parts})) AS INT) AS part)),
o AS (SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INT) AS entry FROM v),
c0 AS MATERIALIZED (SELECT part, entry, x AS e FROM p JOIN o USING (vec_id) WHERE entry < {entries}),
{', '.join(steps)},
r AS (SELECT vec_id, string_agg(printf('%02x', m.entry), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY part, entry, i)) AS h FROM (SELECT part, entry, unnest(e) AS y, unnest(range(len(e))) AS i FROM c{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM r JOIN v USING (vec_id), h
"""


QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLES = {"op13_vector_codes": _sql()}
