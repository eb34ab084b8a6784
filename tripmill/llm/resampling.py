"""Target-distribution importance resampling over hashed n-grams, with the features of every distinct line counted once.

A document's features are all runs of 1 to ``most`` consecutive words of its ASCII-lower-cased text, joined by one space, each in the
bucket of its unsigned crc32. Newlines separate words, so they cut a text into lines (segment deduplication):

1. Lines of the corpus are grouped; the words of a distinct line are hashed once and kept as its list of buckets, beside the number of
   its occurrences. Bucket counts of the corpus are those lists, each weighted by its occurrences.
2. A run of words that spans lines belongs to no line: for ``most`` > 1 such runs are added for each text, from the words at its lines' edges.
3. A bucket's gain is floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))), where s of the S features of the corpus and t of
   the T features of the target fall into it. Gains are summed once for each distinct line and given back to the texts that hold it.
4. weight is the floored mean of gains over a document's features (0 if it has none), score the weight plus Gumbel noise from a hash of
   ``seed`` and doc_id, and of the documents with at least ``least`` words the ``percent`` hundredths with the highest scores are drawn.

Lines with more than a ``hot``-th of all occurrences are fewer than ``hot``: their sums are broadcast, all others are joined by their
key, so no line gathers more than that share of the rows in one task. What goes through the driver is ``buckets`` counts and one count
a sorted partition.

Null and empty texts have no features, weight 0 and are not drawn (unless ``least`` is 0). Rows that repeat a doc_id take part each on its own, equal ones
with neighbouring ranks; a null doc_id hashes as empty and comes last among equal scores. Without documents the result is empty; without a target
all its counts are 0. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, byte_column, join_by_share, list_slices, lower_ascii, small_slices, table
from .textkernel import word_spans

#: Bytes outside words: ASCII but digits and small letters. Every byte of other characters is in a word.
NO_WORD = np.zeros(256, bool)
NO_WORD[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def words_of(column: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """All words of lower-cased texts, and for each text (and one past the last) the index of its first word."""
    buf, offs = byte_column(column)
    starts, ends, first = word_spans(buf, offs, NO_WORD)
    data = buf.tobytes()
    return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())], first


def bucket_arrays(rows: list[np.ndarray]) -> pa.Array:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat.astype(np.int32)))


def within_lines(buckets: int, most: int) -> Callable:
    """line, n -> the number of words and the buckets of the runs of each line."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for whole in batches:
            for batch in small_slices(whole, "line"):
                words, first = words_of(batch.column(batch.schema.get_field_index("line")))
                if len(known) > 500_000:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = zlib.crc32(w) % buckets
                ones = np.fromiter((known[w] for w in words), np.int64, len(words))
                rows = []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    runs = [zlib.crc32(b" ".join(words[i : i + n])) % buckets for n in range(2, most + 1) for i in range(a, b - n + 1)]
                    rows.append(np.concatenate([ones[a:b], np.array(runs, np.int64)]) if runs else ones[a:b])
                at = batch.schema.get_field_index
                yield pa.RecordBatch.from_arrays([batch.column(at("line_key")), batch.column(at("n")), pa.array(np.diff(first)), bucket_arrays(rows)], names=["line_key", "n", "n_words", "buckets"])

    return count


def segmented(buckets: int, most: int) -> Callable:
    """row, doc_id, text -> the keys of the text's lines, and the buckets of the runs of words that lie in no single line."""

    def spanning(lines: list[bytes]) -> list[int]:
        out: list[int] = []
        tail: list[bytes] = []  # the last most - 1 words before a line
        for line in lines:
            words = words_of(pa.array([line], pa.binary()))[0]
            for i in range(len(tail)):
                for j in range(1, min(len(words), most - (len(tail) - i)) + 1):
                    out.append(zlib.crc32(b" ".join(tail[i:] + words[:j])) % buckets)
            tail = (tail + words)[-(most - 1) :]
        return out

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_slices(whole, "text"):
                at = batch.schema.get_field_index
                texts = [t.encode().split(b"\n") if t else [] for t in batch.column(at("text")).to_pylist()]
                keys = pa.array([[md5(line, usedforsecurity=False).digest() for line in lines if line] for lines in texts], pa.list_(pa.binary()))
                between = pa.array([spanning(lines) if most > 1 else [] for lines in texts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(at("row")), batch.column(at("doc_id")), keys, between], names=["row", "doc_id", "line_keys", "buckets"])

    return segment


def totals(lists: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in (n, buckets), every list n times. A task sends each of its buckets once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in list_slices(whole, "buckets"):
                n, column = batch.column(0).to_numpy(), batch.column(1)
                sizes, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy()
                for times in np.unique(n):  # integer sums: most lines occur once
                    own += times * np.bincount(flat[np.repeat(n == times, sizes)], minlength=buckets)
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(own[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in lists.select("n", "buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    buckets, in_target, in_corpus = len(corpus), float(target.sum()), float(corpus.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (in_corpus + buckets) / ((s + 1) * (in_target + buckets)))) for t, s in zip(target.astype(float).tolist(), corpus.astype(float).tolist())], np.int64)


def summed(lists: DataFrame, gain: np.ndarray, keep: tuple[str, ...], schema: str) -> DataFrame:
    """The columns of ``keep``, the number of features and the sum of their gains for every list of buckets."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in list_slices(whole, "buckets"):
                column = batch.column(batch.schema.get_field_index("buckets"))
                upto = np.r_[0, np.cumsum(gain[column.flatten().to_numpy()])]
                ends = np.r_[0, np.cumsum(column.value_lengths().to_numpy())]
                held = [batch.column(batch.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*held, pa.array(np.diff(ends)), pa.array(np.diff(upto[ends]))], names=[*keep, "n_features", "gain"])

    return lists.select(*keep, "buckets").mapInArrow(add, f"{schema}, n_features long, gain long")


def distinct_lines(texts: DataFrame, scratch: Scratch, name: str, buckets: int, most: int) -> DataFrame:
    """line_key, n (occurrences), n_words, buckets: one row a distinct line."""
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") > 0)
    grouped = lines.groupBy("line").agg(F.count("*").alias("n")).withColumn("line_key", F.unhex(F.md5("line")))
    return scratch.keep(grouped.mapInArrow(within_lines(buckets, most), "line_key binary, n long, n_words long, buckets array<int>"), name)


def weigh(docs: DataFrame, target: DataFrame, scratch: Scratch, *, most: int = 1, buckets: int = 10_000, hot: int = 20_000) -> DataFrame:
    """doc_id, row (a number of its own for each row), n_words, n_features, weight for every row of docs; target: text."""
    low = lower_ascii(F.col("text").cast("string")).alias("text")
    pieces = "row long, doc_id long, line_keys array<binary>, buckets array<int>"
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), low)
    aims = target.select(F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("doc_id"), low)
    lines = distinct_lines(texts, scratch, "lines", buckets, most)
    held = scratch.keep(texts.mapInArrow(segmented(buckets, most), pieces), "held")
    in_corpus, in_target = totals(lines, buckets), totals(distinct_lines(aims, scratch, "target", buckets, most), buckets)
    if most > 1:
        once = F.lit(1).cast("long").alias("n")
        in_corpus += totals(held.select(once, "buckets"), buckets)
        in_target += totals(aims.mapInArrow(segmented(buckets, most), pieces).select(once, "buckets"), buckets)
    gain = gains(in_target, in_corpus)
    sums = scratch.keep(summed(lines, gain, ("line_key", "n", "n_words"), "line_key binary, n long, n_words long"), "sums")
    places = held.select("row", "doc_id", F.explode("line_keys").alias("line_key"))
    parts = join_by_share(places, sums, "line_key", "n", hot).select("row", "doc_id", "n_words", "n_features", "gain")
    # each row once more, for its runs across lines and so that rows without any line are kept
    parts = parts.union(summed(held, gain, ("row", "doc_id"), "row long, doc_id long").selectExpr("row", "doc_id", "0L", "n_features", "gain"))
    rows = parts.groupBy("row", "doc_id").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")))
    weight = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    return rows.select("row", "doc_id", "n_words", "n_features", weight.alias("weight"))


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 10, least: int = 20, seed: str = "2024", **options) -> DataFrame:
    """doc_id, n_features, n_words, weight, score, rank (null if not drawn) for every row of docs."""
    scratch = Scratch(docs.sparkSession, "resample")
    rows = weigh(docs, target, scratch, **options)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = scratch.keep(rows.withColumn("score", F.col("weight") + noise), "scored")
    # sorted rows count themselves: a partition's number and a row's place in it
    sorted_ = scored.where(F.col("n_words") >= least).repartitionByRange(F.desc("score"), F.asc_nulls_last("doc_id"), "row").sortWithinPartitions(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    sorted_ = sorted_.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)).withColumn("nth", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    sorted_ = scratch.keep(sorted_.select("doc_id", "n_features", "n_words", "weight", "score", "part", "nth"), "sorted")
    before, offsets = 0, []
    for part, n in sorted(map(tuple, sorted_.groupBy("part").agg(F.count("*").alias("n")).collect())):  # one row a partition
        offsets.append((part, before))
        before += n
    drawn = percent * before // 100
    starts = docs.sparkSession.createDataFrame(offsets, "part long, before long")
    place = F.col("before") + F.col("nth") + 1
    ranked = sorted_.join(F.broadcast(starts), "part").withColumn("rank", F.when(place <= drawn, place))
    rest = scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "n_words", "weight", "score", "rank"]
    return ranked.select(columns).union(rest.select(columns))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH RECURSIVE low AS (
  SELECT 0 AS side, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 1, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT side, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
e AS (SELECT side, doc_id, unnest(w) AS w FROM w),
-- crc32: the table of bytes, then one step a byte of each distinct word
t AS (
  SELECT i, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) FROM t WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS table256 FROM t WHERE k = 8),
v AS (SELECT w, hex(w) AS h FROM (SELECT DISTINCT w FROM e)),
b AS (
  SELECT w, xor(list_reduce(list_transform(range(1, CAST(len(h) / 2 AS BIGINT) + 1), lambda i: CAST(CAST('0x' || substr(h, 2 * i - 1, 2) AS INT) AS BIGINT)),
                            lambda c, x: xor(c >> 8, table256[xor(c & 255, x) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM v, crc),
f AS (SELECT e.side, e.doc_id, b.bucket FROM e JOIN b USING (w)),
s AS (SELECT bucket, CAST(count(*) FILTER (side = 0) AS DOUBLE) AS s, CAST(count(*) FILTER (side = 1) AS DOUBLE) AS t FROM f GROUP BY bucket),
n AS (SELECT CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM s),
g AS (SELECT bucket, CAST(floor(1000 * ln((s.t + 1) * (n.s + 10000) / ((s.s + 1) * (n.t + 10000)))) AS BIGINT) AS gain FROM s, n),
d AS (SELECT doc_id, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM f JOIN g USING (bucket) WHERE side = 0 GROUP BY doc_id),
r AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h
  FROM w LEFT JOIN d USING (doc_id) WHERE side = 0),
c AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM r),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM c WHERE n_features >= 20)
SELECT c.doc_id, c.n_features, c.weight, c.score, CASE WHEN k.rank <= 10 * k.n // 100 THEN k.rank END AS rank FROM c LEFT JOIN k USING (doc_id)
"""
QUERIES = {"op11_resampling": op11_resampling}
ORACLES = {"op11_resampling": SQL}
