"""Removal of bytes in long strings that occur before, by a distributed difference-cover sort of depth ``length``.

A suffix array is wanted here only to its first ``length`` (100) bytes: two suffixes that agree so far are a repeat. So:

1. Cover. A set of positions is sampled such that two equal strings of ``length`` bytes hold a sampled position at the same
   distance from their starts: the property for which difference-cover algorithms sample suffixes. ``cover="minimal"`` takes the
   position of the least hashed ``tuple_``-gram of every string (2.6 % of all positions); ``cover="residues"`` takes the
   residues of a perfect difference set modulo 57 (14 %). Both give the same result; the first sorts a fifth of the rows.
2. Names. Sampled positions are sorted by the hash of their tuple (their name), then by that of their whole stretch, the
   bytes of all strings that they stand for, then by place. Names that occur once are done: none of their strings repeats.
3. Adjacent prefixes. Of neighbours with equal stretches all but the first repeat as a whole. Where stretches of a name differ,
   one of each goes on.
4. Merge. For these few (stretches around the edges of copies) the bytes are fetched, and all suffixes in them are grouped to
   depth ``length`` within their name; all but the first of each group repeat. Names with more than ``hot`` different stretches are
   dealt out by name and suffix instead, so that no task holds a common one.
5. The repeated stretches and suffixes of a document are united and cut out.

Names, stretches and suffixes are compared by 64-bit hashes within a name, that is by 128 bits. No recursion on names is needed:
a tuple, its distance in the string and the stretch already reach depth ``length``.

Null and empty texts have nothing removed. Rows without doc_id take no part and are returned whole. Rows that repeat a doc_id with the
same text count as one document; with another text they are ordered by a hash of the text. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, byte_column, runs, small_slices, table
from .textkernel import mix, prefix_hashes, span_hashes

LENGTH, TUPLE, MODULUS, SIZE = 100, 24, 57, 8
LOW = np.uint64(0xFFFFFFFF)


@lru_cache(maxsize=1)
def difference_set() -> tuple[int, ...]:
    """The first perfect difference set of SIZE residues modulo MODULUS in lexical order: every difference occurs once."""

    def grow(chosen: list[int], used: set[int]) -> list[int] | None:
        if len(chosen) == SIZE:
            return chosen
        for x in range(chosen[-1] + 1, MODULUS):
            new = {(x - c) % MODULUS for c in chosen} | {(c - x) % MODULUS for c in chosen}
            if len(new) == 2 * len(chosen) and not new & used and (found := grow([*chosen, x], used | new)):
                return found
        return None

    return tuple(grow([0], set()) or ())


def sampled(buf: np.ndarray, offs: np.ndarray, prefix: np.ndarray, length: int, cover: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(place, first start, last start) of each sampled position and the strings of ``length`` bytes that it stands for; tuple length."""
    sizes = np.diff(offs)
    none = np.zeros(0, np.int64)
    if cover == "residues":
        wide = length - MODULUS + 1
        at = np.arange(len(buf)) - np.repeat(offs[:-1], sizes)
        p = np.flatnonzero(np.isin(at % MODULUS, difference_set()))
        lo, hi = np.repeat(offs[:-1], sizes)[p], np.repeat(offs[1:], sizes)[p]
        first, last = np.maximum(lo, p - MODULUS + 1), np.minimum(p, hi - length)
        good = first <= last
        return p[good], first[good], last[good], wide
    reach = length - TUPLE + 1
    if len(buf) < length:
        return none, none, none, TUPLE
    starts = np.arange(len(buf) - TUPLE + 1)
    key = (span_hashes(prefix, starts, starts + TUPLE) & ~LOW) | starts.astype(np.uint64)
    width = 1
    while 2 * width <= reach:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < reach:
        key = np.minimum(key[: len(key) - (reach - width)], key[reach - width :])
    place = (key & LOW).astype(np.int64)  # of the string at each start, if it lies within a text
    doc_end = np.repeat(offs[1:], sizes)[: len(place)]
    valid = np.arange(len(place)) + length <= doc_end
    i = np.flatnonzero(valid)
    if not len(i):
        return none, none, none, TUPLE
    place = place[i]
    new = np.r_[True, (place[1:] != place[:-1]) | (i[1:] != i[:-1] + 1)]
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:], len(i)] - 1
    return place[begin], i[begin], i[end], TUPLE


def sampler(length: int, cover: str) -> Callable:
    """Texts -> rows name, stretch, okey, spot (start * 2**16 + number of strings * 2**8 + distance of the place), kind. Kind 3:
    its stretch occurs earlier in the same slice of documents."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_slices(whole, "text"):
                buf, offs = byte_column(batch.column(1))
                if not len(buf):
                    continue
                prefix = prefix_hashes(buf)
                place, first, last, wide = sampled(buf, offs, prefix, length, cover)
                if not len(place):
                    continue
                name = span_hashes(prefix, place, place + wide)
                shape = (place - first).astype(np.uint64) * np.uint64(1 << 20) + (last - first).astype(np.uint64)
                stretch = mix(span_hashes(prefix, first, last + length) + mix(shape + np.uint64(1)))
                doc = np.searchsorted(offs, first, side="right") - 1
                okey = batch.column(0).to_numpy(zero_copy_only=False)[doc]
                spot = ((first - offs[doc]) << 16) | ((last - first + 1) << 8) | (place - first)
                order = np.lexsort((spot, okey))  # a common passage is sent once a slice, not once a document
                kind = np.full(len(place), 3, np.int32)
                kind[order[np.unique(mix(stretch + mix(name))[order], return_index=True)[1]]] = 0
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(okey), pa.array(spot), pa.array(kind)], names=["name", "stretch", "okey", "spot", "kind"])

    return sample


def compare_adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by name, stretch, okey, spot -> kind 1: repeats a row before; kind 2: first of its stretch, of a name with
    several. Holds one row from batch to batch, however common a name is."""
    held: tuple | None = None  # first row of the last stretch: name, stretch, okey, spot, is it sent?
    for batch in batches:
        if not batch.num_rows:
            continue
        name, stretch, okey, spot = (batch.column(i).to_numpy() for i in range(4))
        n = len(name)
        same_name, same = np.zeros(n, bool), np.zeros(n, bool)
        same_name[1:] = name[1:] == name[:-1]
        same[1:] = same_name[1:] & (stretch[1:] == stretch[:-1])
        if held:
            same_name[0] = name[0] == held[0]
            same[0] = same_name[0] and stretch[0] == held[1]
        head = np.flatnonzero(~same)
        lead = np.r_[-1, head][np.searchsorted(head, np.arange(n), side="right")]  # the first row of each row's stretch; -1: held
        first_okey, first_spot = (np.where(lead < 0, held[k] if held else 0, x[lead]) for k, x in ((2, okey), (3, spot)))
        kind = np.where(same & ((okey != first_okey) | (spot != first_spot)), 1, 0).astype(np.int32)
        several = np.zeros(n, bool)
        several[head] = same_name[head]  # another stretch of the name comes before
        follows = np.r_[same_name[head[1:]], False] if len(head) else np.zeros(0, bool)
        kind[head[several[head] | follows]] = 2
        extra = None
        if len(head) and held and same_name[head[0]] and not held[4]:
            extra = held  # the held stretch turns out to have company
        if len(head):
            i = head[-1]
            held = (name[i], stretch[i], okey[i], spot[i], bool(kind[i] == 2))
        elif held:
            held = held[:4] + (held[4],)
        keep = np.flatnonzero(kind)
        columns = [x[keep] for x in (name, okey, spot)] + [kind[keep]]
        if extra:
            columns = [np.r_[np.array([v], c.dtype), c] for v, c in zip((extra[0], extra[2], extra[3], 2), columns)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["name", "okey", "spot", "kind"])


def fetch(length: int) -> Callable:
    """Texts with their stretches -> a row a stretch with its bytes."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_slices(whole, "text"):
                out: list[tuple] = []
                for okey, text, stretches in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                    for s in stretches:
                        start, n = s["spot"] >> 16, s["spot"] >> 8 & 0xFF
                        out.append((s["name"], okey, start, n, text[start : start + n - 1 + length]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["name", "okey", "start", "n", "bytes"])

    return get


def suffixes(part: pa.Table | pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of the stretches, to depth ``length``: row, start in the document, hash."""
    buf, offs = byte_column(part.column("bytes").combine_chunks() if isinstance(part, pa.Table) else part.column(part.schema.get_field_index("bytes")))
    n = part.column("n").to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = offs[row] + nth
    prefix = prefix_hashes(buf)
    return row, part.column("start").to_numpy()[row] + nth, span_hashes(prefix, at, at + length)


def merge(length: int) -> Callable:
    """Stretches sorted by name, okey, start -> intervals of the suffixes that occur before within their name."""
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, "name"):
            part = part.combine_chunks()
            row, start, suffix = suffixes(part, length)
            name, okey = part.column("name").to_numpy().view(np.uint64)[row], part.column("okey").to_numpy()[row]
            _, first, group = np.unique(mix(suffix + mix(name)), return_index=True, return_inverse=True)
            lead = first[group]
            repeat = (okey != okey[lead]) | (start != start[lead])
            at = np.flatnonzero(repeat)
            if len(at):
                new = np.r_[True, (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])]
                b = np.flatnonzero(new)
                e = np.r_[b[1:], len(at)] - 1
                yield pa.RecordBatch.from_arrays([pa.array(okey[at[b]]), pa.array(start[at[b]]), pa.array(start[at[e]] + length)], names=["okey", "s", "e"])

    return merged


def single_suffixes(length: int) -> Callable:
    """Stretches of hot names -> a row a suffix, in the form that ``compare_adjacent`` takes."""

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                row, start, suffix = suffixes(part, length)
                yield pa.RecordBatch.from_arrays([pa.array(part.column(0).to_numpy()[row]), pa.array(suffix.view(np.int64)), pa.array(part.column(1).to_numpy()[row]), pa.array(start << 16 | 1 << 8)], names=["name", "stretch", "okey", "spot"])

    return single


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for whole in batches:
        for batch in small_slices(whole, "text"):
            out: list[tuple] = []
            buf, offs = byte_column(batch.column(1))
            data, offs = buf.tobytes(), offs.tolist()
            for doc, a, b, found in zip(batch.column(0).to_pylist(), offs[:-1], offs[1:], batch.column(2).to_pylist()):
                removed, spans, end, digest = 0, 0, 0, hashlib.sha256()
                for s, e in sorted((x["s"], x["e"]) for x in found or ()):
                    if e <= end:
                        continue
                    if s > end or not spans:
                        spans += 1
                        digest.update(data[a + end : a + s])
                        end = s
                    removed += e - max(s, end)
                    end = e
                digest.update(data[a + end : b])
                out.append((doc, b - a, removed, spans, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=names)


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, cover: str = "minimal", hot: int = 20_000) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    if not (MODULUS <= length <= 255 + TUPLE):
        raise ValueError(f"length must be {MODULUS} to {255 + TUPLE}")  # a spot counts strings in eight bits
    scratch = Scratch(docs.sparkSession, "repeats")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    if repeated:
        keyed = docs.withColumn("h", F.xxhash64("text"))
        # numbers that rise with the order, not without gaps
        order = keyed.where("doc_id IS NOT NULL").select("doc_id", "h").distinct().sort("doc_id", "h").withColumn("okey", F.monotonically_increasing_id())
        order = scratch.keep(order, "order")
        rows = scratch.keep(keyed.join(order, ["doc_id", "h"], "left").select("okey", "doc_id", "text"), "keyed")
    else:
        rows = docs.select(F.col("doc_id").alias("okey"), "doc_id", "text")
    usable = rows.where("okey IS NOT NULL").select("okey", "text")

    sample = usable.mapInArrow(sampler(length, cover), "name long, stretch long, okey long, spot long, kind int")
    sample = scratch.keep(sample, "sample")
    inside = sample.where("kind = 3").select("okey", "spot")
    ordered = sample.where("kind = 0").select("name", "stretch", "okey", "spot").repartition("name").sortWithinPartitions("name", "stretch", "okey", "spot")
    compared = scratch.keep(ordered.mapInArrow(compare_adjacent, "name long, okey long, spot long, kind int"), "compared")
    whole = compared.where("kind = 1").select("okey", "spot").union(inside)
    start, n = F.shiftright("spot", 16), F.shiftright("spot", 8).bitwiseAND(F.lit(0xFF))
    found = whole.select("okey", start.alias("s"), (start + n - 1 + length).alias("e"))

    several = compared.where("kind = 2").select("name", "okey", "spot").distinct()
    wanted = several.groupBy("okey").agg(F.collect_list(F.struct("name", "spot")).alias("stretches"))
    texts = usable.dropDuplicates(["okey"]) if repeated else usable
    stretches = texts.join(wanted, "okey").select("okey", "text", "stretches").mapInArrow(fetch(length), "name long, okey long, start long, n int, bytes binary")
    fetched = stretches = scratch.keep(stretches, "stretches")
    common = several.groupBy("name").count().where(F.col("count") > hot).select("name", F.lit(True).alias("common"))
    stretches = stretches.join(common, "name", "left") if common.limit(1).count() else stretches.withColumn("common", F.lit(None).cast("boolean"))
    few = stretches.where("common IS NULL").select("name", "okey", "start", "n", "bytes").repartition("name").sortWithinPartitions("name", "okey", "start")
    found = found.union(few.mapInArrow(merge(length), "okey long, s long, e long"))
    many = stretches.where("common").select("name", "okey", "start", "n", "bytes").mapInArrow(single_suffixes(length), "name long, stretch long, okey long, spot long")
    many = many.repartition("name", "stretch").sortWithinPartitions("name", "stretch", "okey", "spot").mapInArrow(compare_adjacent, "name long, okey long, spot long, kind int").where("kind = 1")
    found = found.union(many.select("okey", start.alias("s"), (start + length).alias("e")))
    spans = found.groupBy("okey").agg(F.collect_list(F.struct("s", "e")).alias("found"))
    spans = scratch.keep(spans, "spans")
    scratch.drop(sample, compared, fetched)
    return rows.join(spans, "okey", "left").select("doc_id", "text", "found").mapInArrow(cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 200)) AS m FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 98)) AS i FROM d WHERE length(h) >= 200)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k
      FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i) AS p FROM r)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 99 AS b FROM g GROUP BY doc_id, k),
p AS (
  SELECT s.doc_id, a, b, substr(h, CAST(2 * coalesce(lag(b) OVER o, 0) + 1 AS BIGINT), CAST(2 * (a - 1 - coalesce(lag(b) OVER o, 0)) AS BIGINT)) AS before,
         CASE WHEN lead(a) OVER o IS NULL THEN substr(h, 2 * b + 1) ELSE '' END AS rest
  FROM s JOIN d ON s.doc_id = d.doc_id WINDOW o AS (PARTITION BY s.doc_id ORDER BY a)),
k AS (SELECT doc_id, sum(b - a + 1) AS n_removed, count(*) AS n_spans, string_agg(before || rest, '' ORDER BY a) AS kept FROM p GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
QUERIES = {"op7_substring_dedup": op7_substring_dedup}
ORACLES = {"op7_substring_dedup": SQL}
