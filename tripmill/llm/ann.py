"""Approximate nearest neighbours by an inverted multi-index (after Babenko and Lempitsky, 2012).

Vectors are scaled to length 1 and cut into two halves, each quantised by its own codebook; a cell is a pair of centroids. A query
visits cells in order of the summed distance of its halves to the two centroids, taken from a heap, until the cells
visited hold ``budget`` entries of other ids, and k at least; a query with fewer candidates visits all cells. Entries of visited
cells are reranked by their exact cosine in double precision.

* Codebooks are fitted on at most ``sample`` rows (the smallest by hash); every row is indexed.
* The budget is measured, not guessed: ``probes`` queries are compared with all rows, and the budget is the least that
  finds ``recall`` of their true neighbours. Vectors without structure need a large part of the index, others little.
* Entries of a first centroid are dealt into blocks of about ``block`` rows by hash, so a common vector fills no task. A block of
  entries is held once, and all queries that visit it stream past it, so neither memory nor the copies of the index grow with
  the number of queries. Each keeps its k best.

Vectors are scaled by the power of two that brings their largest component near 1, which changes no cosine: so neither very large nor very
small finite vectors drop out. Vectors that are null, zero, of another length than the most, or hold null or non-finite components take no
part. A query's own row is left out, and with it all rows of its vec_id; of queries that repeat a vec_id one is asked. Rows without
vec_id take no part. Vectors of one component have an empty second half.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, byte_column, small_slices, table

FOUND = "query_id long, vec_id long, score double"


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of ``dim`` doubles from a binary column."""
    return np.frombuffer(byte_column(column)[0].tobytes(), np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def packer(dim: int) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            most = np.abs(flat).max(axis=1)
            good = np.isfinite(most) & (most > 0)
            rows = np.ldexp(flat[good], -np.frexp(most[good])[1][:, None])
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), pa.array([r.tobytes() for r in rows], pa.binary())], names=["vec_id", "vec"])

    return pack


def codebook(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's iteration from evenly spread rows of a sample in hash order; an empty cluster keeps its centroid."""
    centroids = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(points, centroids)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centroids)
        np.add.at(total, near, points)
        centroids[count > 0] = total[count > 0] / count[count > 0, None]
    return centroids


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centroids.T + (centroids**2).sum(1), 0)


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return distances(points, centroids).argmin(axis=1)


def traverse(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of centroids in order of summed distance: a heap over the grid of the two sorted lists."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))


def top(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, entries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best entries of each query by exact cosine, ties to the smaller id; rows of a query's own id are left out."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    e_size, q_size = np.sqrt(np.einsum("ij,ij->i", entries, entries)), np.sqrt(np.einsum("ij,ij->i", queries, queries))
    step = max(1, 4_000_000 // max(1, len(ids)))
    for at in range(0, len(query_ids), step):
        about = (queries[at : at + step] / q_size[at : at + step, None]) @ (entries / e_size[:, None]).T
        for i, row in enumerate(about, at):
            row[ids == query_ids[i]] = -np.inf
            floor = np.partition(row, -k)[-k] - 1e-9 if len(row) > k else -2.0  # rounding of the product can't drop a tie
            near = np.flatnonzero((row >= floor) & (row > -np.inf))
            if len(near):
                exact = np.einsum("ij,j->i", entries[near], queries[i]) / (e_size[near] * q_size[i])
                best = np.lexsort((ids[near], -exact))[:k]
                out.append((np.full(len(best), query_ids[i]), ids[near[best]], exact[best]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (ids[:0], ids[:0], np.zeros(0))


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, *, k: int = 5, recall: float = 0.97, probes: int = 96, sample: int = 20_000, block: int = 20_000
) -> DataFrame:
    """(vec_id, embedding) twice -> query_id, rank (from 1), vec_id, score. Queries need not be among the vectors."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shape = lambda df: df.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)")
    dim = shape(vectors).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dim is None or dim["d"] < 1:
        return empty
    dim = dim["d"]
    half = max(1, dim // 2)
    packed = lambda df: shape(df).where(F.size("embedding") == dim).select(F.col("vec_id").cast("long"), "embedding").mapInArrow(packer(dim), "vec_id long, vec binary")
    entries = scratch.keep(packed(vectors), "vectors")
    asked = scratch.keep(packed(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec")), "queries")
    n, n_queries = entries.count(), asked.count()
    if not n or not n_queries:
        return empty

    centroids = min(1024, 2 * 2 ** int(np.ceil(np.log2(max(2.0, n**0.25)))), n)
    rows = entries.orderBy(F.xxhash64("vec_id", "vec")).limit(sample).collect()
    learn = unit(np.array([np.frombuffer(r["vec"], np.float64) for r in rows]))
    books = codebook(learn[:, :half], centroids), codebook(learn[:, half:], centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(matrix(batch.column(1), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest(x[:, :half], books[0]).astype(np.int32)), pa.array(nearest(x[:, half:], books[1]).astype(np.int32))], names=["vec_id", "vec", "c1", "c2"])

    index = scratch.keep(entries.mapInArrow(assign, "vec_id long, vec binary, c1 int, c2 int"), "index")
    sizes = np.zeros((centroids, centroids), np.int64)
    for r in index.groupBy("c1", "c2").count().collect():  # at most centroids squared rows, a parameter's bound
        sizes[r["c1"], r["c2"]] = r["count"]

    tried = asked.orderBy(F.xxhash64("query_id")).limit(probes).collect()
    t_ids, t_vec = np.array([r["query_id"] for r in tried]), np.array([np.frombuffer(r["vec"], np.float64) for r in tried])

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, v, s = top(t_ids, t_vec, batch.column(0).to_numpy(), matrix(batch.column(1), dim), k)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    truth = entries.mapInArrow(brute, FOUND).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    truth = truth.join(index.select("vec_id", "c1", "c2"), "vec_id").collect()  # probes x k rows
    t_unit = unit(t_vec)
    d1, d2 = distances(t_unit[:, :half], books[0]), distances(t_unit[:, half:], books[1])
    asked = asked.join(index.groupBy(F.col("vec_id").alias("query_id"), "c1", "c2").count().groupBy("query_id").agg(F.collect_list(F.struct("c1", "c2", "count")).alias("own")), "query_id", "left")
    asked = scratch.keep(asked, "asked")
    needed = []
    own_of = {r["query_id"]: {(o["c1"], o["c2"]): o["count"] for o in r["own"] or ()} for r in asked.where(F.col("query_id").isin(t_ids.tolist())).select("query_id", "own").collect()}
    for i, q in enumerate(t_ids.tolist()):
        want, held = {}, 0
        for r in truth:
            if r["query_id"] == q:
                want.setdefault((r["c1"], r["c2"]), []).append(r)
        for cell in traverse(d1[i], d2[i]):
            if not want:
                break
            needed += [held] * len(want.pop(cell, ()))
            held += int(sizes[cell]) - own_of[q].get(cell, 0)
    budget = max(k, int(np.quantile(needed, recall, method="higher")) + 1) if needed else n

    blocks = np.maximum(1, -(-sizes.sum(axis=1) // block))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each first centroid, block of its entries and query: the second centroids visited with it."""
        for batch in batches:
            x = unit(matrix(batch.column(1), dim))
            far1, far2 = distances(x[:, :half], books[0]), distances(x[:, half:], books[1])
            out: list[tuple] = []
            for q, vec, own, a, b in zip(*(batch.column(c).to_pylist() for c in range(3)), far1, far2):
                held, seen = 0, {}
                own = {(o["c1"], o["c2"]): o["count"] for o in own or ()}
                for c1, c2 in traverse(a, b):
                    if sizes[c1, c2]:
                        seen.setdefault(c1, []).append(c2)
                        held += int(sizes[c1, c2]) - own.get((c1, c2), 0)
                        if held >= budget:
                            break
                out += [(c1, s, 1, q, vec, c2) for c1, c2 in seen.items() for s in range(blocks[c1])]
                if len(out) > 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)

    names, types = ["c1", "block", "asks", "id", "vec", "cells"], [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32())]
    meeting = "c1 int, block int, asks int, id long, vec binary, cells array<int>"
    visits = asked.mapInArrow(visit, meeting)
    per = F.element_at(F.array(*(F.lit(int(b)) for b in blocks)), F.col("c1") + 1)
    held = index.select("c1", F.pmod(F.xxhash64("vec_id", "vec"), per).cast("int").alias("block"), F.lit(0).alias("asks"), F.col("vec_id").alias("id"), "vec", F.array("c2").alias("cells"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by block: its entries come first and are held, then its queries stream past them."""
        at, mine, entries_ = None, [], None
        for whole in batches:
            for batch in small_slices(whole, "vec"):
                c1, block_, asks = (batch.column(i).to_numpy() for i in range(3))
                edges = np.flatnonzero(np.r_[True, (c1[1:] != c1[:-1]) | (block_[1:] != block_[:-1]) | (asks[1:] != asks[:-1]), True])
                for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    part = batch.slice(i, j - i)
                    if (c1[i], block_[i]) != at:
                        at, mine, entries_ = (c1[i], block_[i]), [], None
                    if not asks[i]:
                        mine.append(part)
                        continue
                    if entries_ is None:
                        table_ = pa.Table.from_batches(mine, whole.schema).combine_chunks()
                        cell = table_.column("cells").combine_chunks().flatten().to_numpy() if len(mine) else np.zeros(0, np.int32)
                        order = np.argsort(cell, kind="stable")
                        vecs = matrix(table_.column("vec").combine_chunks(), dim) if len(mine) else np.zeros((0, dim))
                        entries_ = cell[order], table_.column("id").to_numpy()[order], vecs[order]
                    cell, ids, vecs = entries_
                    asks_, ask, cells = part.column("id").to_numpy(), matrix(part.column("vec"), dim), part.column("cells")
                    who, what = np.repeat(np.arange(len(part)), cells.value_lengths().to_numpy()), cells.flatten().to_numpy()
                    for c in np.unique(what):
                        a, b = np.searchsorted(cell, (c, c + 1))
                        if a < b:
                            some = who[what == c]
                            q, v, s = top(asks_[some], ask[some], ids[a:b], vecs[a:b], k)
                            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    met = held.union(visits).repartition("c1", "block").sortWithinPartitions("c1", "block", "asks")
    found = met.mapInArrow(answer, FOUND)
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 50 == 0))


QUERIES = {"op4_ann": op4_ann}
ORACLES: dict[str, str] = {}
