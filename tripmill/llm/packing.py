"""Best-fit packing of token sequences by linear grouping.

The whole plan depends only on how many pieces have each length, a table of at most ``capacity`` rows, so it is made on the driver
and costs the same for a thousand documents and for a trillion:

1. Lengths over ``capacity / 8`` are large. In order of length they are cut into groups of equal cardinality and rounded up
   to the longest of their group: the linear grouping scheme of Fernandez de la Vega and Lueker.
2. For the few rounded lengths, the best mixture of bin configurations is a linear program, solved by column generation
   (Gilmore and Gomory): a revised simplex on the groups, new configurations from a knapsack over the capacity.
3. Whole multiples of a configuration are filled with actual pieces, which are no longer than their group's length; the last
   place of a bin goes to the longest piece that fits, which makes good what the rounding has left over.
4. What is left, and all small pieces, go by best fit in order of decreasing length, many equal pieces to many equal bins at once.

Pieces then only need their rank among those of equal length: a two-level count, by hash buckets within a length, so that a length
that a third of all documents has is no large group. A document is its ids and an id 0; one longer than ``capacity`` is
cut into full pieces after a shorter first one. Null and empty texts are the id 0 alone. Repeated rows are packed each.
Rows with a null doc_id are packed too. Other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, byte_column, small_slices, table

CAPACITY = 2048
END = 0


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _ranks(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def tokenizer(path: str | None = None) -> Callable[[bytes], np.ndarray]:
    """UTF-8 text -> ids as little-endian unsigned 32-bit integers, by the tokenizer in the file ``path``.

    For the default file the same vocabulary as ranks is about three times as fast. Letters and signs of Latin texts are classed
    alike by both libraries; texts with other characters, or with a special token's string, go to the tokenizer itself.
    """
    import public_tokenizers

    file = path or public_tokenizers.path("byte_bpe_50k.json")
    fast = None if path else _ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

    def ids(text: bytes) -> np.ndarray:
        if fast is None or b"<|" in text or (text and np.frombuffer(text, np.uint8).max() > 0xC8):
            return np.array(_tokenizer(file).encode(text.decode(), add_special_tokens=False).ids, "<u4")
        return np.asarray(fast.encode_to_numpy(text.decode(), disallowed_special=()), "<u4")

    return ids


def cutter(capacity: int, path: str | None) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = tokenizer(path)
        for whole in batches:
            for batch in small_slices(whole, "text"):
                rows: list[tuple] = []
                buf, offs = byte_column(batch.column(1))
                data, offs = buf.tobytes(), offs.tolist()
                for doc, a, b in zip(batch.column(0).to_pylist(), offs[:-1], offs[1:]):
                    all_ids = ids(data[a:b]).tobytes() + END.to_bytes(4, "little")
                    n = len(all_ids) // 4
                    at, piece = 0, 0
                    to = n if n <= capacity else n % capacity or capacity
                    while at < n:
                        rows.append((doc, piece, at, to - at, zlib.crc32(all_ids[4 * at : 4 * to])))
                        at, to, piece = to, to + capacity, piece + 1
                doc, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(rest[0], pa.int32()), *(pa.array(x, pa.int64()) for x in rest[1:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """The linear program of bin configurations by column generation: (copies of each size, how many bins), for those used."""
    m = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1 / np.diag(columns))
    amount = inverse @ demand
    for _ in range(40 * m):
        price = inverse.sum(axis=0)  # duals: every bin costs 1
        value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(sizes.min()), capacity + 1):  # unbounded knapsack
            fit = sizes <= c
            gain = np.where(fit, value[c - np.where(fit, sizes, 0)] + price, -1.0)
            j = int(gain.argmax())
            if gain[j] > value[c - 1]:
                value[c], last[c] = gain[j], j
            else:
                value[c] = value[c - 1]
        if value[capacity] <= 1 + 1e-7:
            break
        new, c = np.zeros(m), capacity
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                new[last[c]] += 1
                c -= sizes[last[c]]
        step = inverse @ new
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[:, out] = new
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        amount = np.maximum(inverse @ demand, 0)
    return [(columns[:, j].astype(int), amount[j]) for j in range(m) if amount[j] >= 1]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = 32) -> np.ndarray:
    """How many pieces have each length -> rows (length, first rank, bins, copies a bin, first sequence, offset in it): pieces
    of that length with ranks from the first on go ``copies`` to a bin. Sequences are numbered from 0."""
    left = {s: n for s, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, list[tuple[int, int, int]]]] = []  # bins, [(length, first rank, copies)]
    open_: list[list] = [[] for _ in range(capacity + 1)]  # by free tokens

    def take(s: int, n: int) -> int:
        first = used[s]
        used[s] += n
        left[s] -= n
        return first

    large = sorted((s for s in left if capacity // 8 < s < capacity), reverse=True)
    total = sum(left[s] for s in large)
    k = min(groups, int(total**0.5))
    if k:
        each = -(-total // k)
        members: list[list[int]] = [[]]  # lengths of each group, longest first; a length at a border is in both
        room = each
        demand = [0]
        for s in large:
            n = left[s]
            while n:
                if not room:
                    members.append([])
                    demand.append(0)
                    room = each
                part = min(n, room)
                members[-1].append(s)
                demand[-1] += part
                n, room = n - part, room - part
        have = np.array([left.get(s, 0) if s in large else 0 for s in range(capacity + 1)])
        for config, amount in configurations(np.array([m[0] for m in members]), np.array(demand, float), capacity):
            slots = [j for j, copies in enumerate(config) for _ in range(copies)]
            bins = int(amount + 1e-9)
            while bins and slots:  # bins with the same lengths in all slots
                chosen: list[int] = []
                for j in slots[:-1]:
                    chosen.append(next((s for s in members[j] if have[s] > chosen.count(s)), 0))
                free = capacity - sum(chosen)
                fit = np.flatnonzero(have[: free + 1]) if all(chosen) else ()
                fit = [s for s in fit[::-1][: len(chosen) + 1] if have[s] > chosen.count(s)] if len(fit) else ()
                if not len(fit):
                    break  # a group has run out
                chosen.append(int(fit[0]))  # the longest that fits makes good what rounding up has left over
                part = min(bins, *(int(have[s]) // chosen.count(s) for s in chosen))
                content = [(s, take(s, part * chosen.count(s)), chosen.count(s)) for s in sorted(set(chosen))]
                for s, _, copies in content:
                    have[s] -= part * copies
                open_[capacity - sum(chosen)].append((part, content))
                bins -= part

    filled = np.array([bool(x) for x in open_])
    for s in sorted(left, reverse=True):
        while n := left[s]:
            fit = np.flatnonzero(filled[s:])
            if len(fit):
                free = s + int(fit[0])
                bins, content = open_[free].pop()
                filled[free] = bool(open_[free])
            else:
                free, bins, content = capacity, n, []
            copies = min(free // s, n)
            now = min(bins, n // copies)
            if now < bins and content:  # the rest of the run stays as it is
                open_[free].append((bins - now, [(a, first + now * c, c) for a, first, c in content]))
                filled[free] = True
            open_[free - copies * s].append((now, [*content, (s, take(s, now * copies), copies)]))
            filled[free - copies * s] = True
    runs = [run for x in open_ for run in x]
    rows, base = [], 0
    for bins, content in runs:
        at = 0
        for s, first, copies in content:
            rows.append((s, first, bins, copies, base, at))
            at += s * copies
        base += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def placer(rows: np.ndarray) -> Callable:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (rows[:, 0] << 48) + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            row = rows[np.searchsorted(key, (length << 48) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(row[:, 4] + nth // row[:, 3]), pa.array(row[:, 5] + nth % row[:, 3] * length)], names=[*names, "sequence_id", "offset"])

    return place


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack(docs: DataFrame, *, capacity: int = CAPACITY, tokenizer_file: str | None = None, bucket: int = 50_000, groups: int = 32) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. bucket: rows that are ranked in one window, about;
    a length has as many buckets as it needs."""
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cutter(capacity, tokenizer_file), PIECES)
    pieces = scratch.keep(pieces, "pieces")
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    rows = plan(lengths, capacity, groups)
    per = F.element_at(F.array(*(F.lit(-(-lengths.get(s, 1) // bucket)) for s in range(1, capacity + 1))), F.col("length").cast("int"))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), per).cast("int"))
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("length", "bucket", before.alias("before"))
    within = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = pieces.withColumn("nth", within).join(counts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("nth") - 1)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(placer(rows), PIECES + ", sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
