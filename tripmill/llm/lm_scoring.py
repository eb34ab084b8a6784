"""LM scoring by cross-entropy difference (after Moore and Lewis, 2010).

Two bigram models over one vocabulary: a target model on the documents labelled good and a background model on all documents. A
document's score is the mean over its words of the target's loss less the background's, in nats: the lower, the more it reads
like the target. The models are matched: the same words, order and smoothing, and background counts are scaled to the
target's size, so that smoothing weighs alike in both.

Every word and every pair of neighbouring words has a count of its own, under a 63-bit hash, whatever the size of the corpus.
Documents are dealt by hash into slices of about ``SLICE`` bytes. A slice sends its distinct words and pairs with their counts to
buckets, by the range of the hash; a bucket adds up and answers each slice with the sums of what it sent. A common word is one entry a
slice, so no bucket is larger than the others, and nothing is collected or broadcast. Empty messages are not sent, so there are
never more of them than distinct keys of slices, however many slices meet however many buckets. The totals of the corpus
(words of both models, distinct words) are aggregates of their own, three numbers.

P(w | v) = (c(v, w) + strength * P(w)) / (c(v) + strength), P(w) = (c(w) + 1) / (words + distinct words + 1); c(v) counts v as a
word, or texts for the start mark, which is one of the words here.

Words are ASCII-lower-cased runs outside 0x20 and 0x09-0x0D. Null and empty texts have no words, no losses, and the score 0.
Without any target document all scores are 0 too. Rows are returned one for one; those without doc_id count for the background
alone. Labels without a value are left out; of several for a doc_id the least counts. Other columns are ignored. Rows that repeat
a doc_id share a slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, byte_column, small_slices, table
from .textkernel import LOWER, pair_hashes, word_hashes

SLICE = 6 << 20
START = np.uint64(0x27D4EB2F165667C4)
ODD = np.uint64(1)
SENT = "bucket int, slice int, keys binary, t binary, b binary"
SUMS = "slice int, bucket int, t binary, b binary"
SCORED = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word: its key (even), that of the word before (a start mark at the head of a text) and that of the pair (odd);
    and the index of each text's first word."""
    buf, offs = byte_column(column)
    words, first = word_hashes(LOWER[buf], offs)
    words = words & ~ODD
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[first[:-1][np.diff(first) > 0]] = START
    return words, before, pair_hashes(before, words) | ODD, first


def pieces(docs: pa.Table) -> Iterator[pa.RecordBatch]:
    for whole in docs.combine_chunks().to_batches():
        yield from small_slices(whole, "text")


def slice_keys(docs: pa.Table, chosen: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct keys of a slice, and their counts in the target's and in all its documents."""
    every, target = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for batch in pieces(docs):
        word, _, pair, first = hashes(batch.column(batch.schema.get_field_index("text")))
        n = np.diff(first)
        hit = pc.is_in(batch.column(batch.schema.get_field_index("doc_id")), value_set=chosen).to_numpy(zero_copy_only=False)
        inside = np.repeat(hit, n)
        every += [word, pair, np.full(int((n > 0).sum()), START)]
        target += [word[inside], pair[inside], np.full(int((hit & (n > 0)).sum()), START)]
    every, target = np.concatenate(every), np.concatenate(target)  # frees the pieces
    every.sort()
    at = np.flatnonzero(np.r_[True, every[1:] != every[:-1]][: len(every)])
    keys, b = every[at], np.diff(at, append=len(every))
    del every, at
    return keys, np.bincount(np.searchsorted(keys, target), minlength=len(keys)), b


def cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n buckets begins in sorted keys, and the end."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers byte by byte, all the first ones first: what is equal or zero in many of them compresses well."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).reshape(-1).view("<u8")


def sender(n: int, *, counts: bool, asks: bool) -> Callable:
    """counts: the slice is part of the corpus. asks: it wants an answer."""
    schema = pa.schema([("bucket", pa.int32()), ("slice", pa.int32()), ("keys", pa.binary()), ("t", pa.binary()), ("b", pa.binary())])

    def send(key: tuple, docs: pa.Table, chosen: pa.Table) -> pa.Table:
        keys, t, b = slice_keys(docs, chosen.column("doc_id").combine_chunks())
        if not counts:
            t, b = np.zeros_like(t), np.zeros_like(b)
        at = cuts(keys, n)
        some = np.flatnonzero(np.diff(at)).tolist()
        columns = [pa.array([planes(x[at[i] : at[i + 1]]) for i in some], pa.binary()) for x in (keys, t, b)]  # one at a time, so that its pieces are freed
        return pa.table([pa.array(some, pa.int32()), pa.array([key[0].as_py() if asks else -1] * len(some), pa.int32()), *columns], schema=schema)

    return send


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    """All numbers of a column of planes, without copies of its bytes."""
    n = pc.sum(pc.binary_length(column)).as_py() or 0
    out, at = np.empty(n // 8, np.uint64), 0
    for x in column:
        some = unplanes(x.as_buffer())
        out[at : at + len(some)] = some
        at += len(some)
    return out


def add_up(sent: pa.Table) -> pa.Table:
    """Of one bucket: to each slice the sums of its keys over all slices."""
    n = pc.binary_length(sent.column("keys")).to_numpy() // 8
    keys, where = np.unique(numbers(sent.column("keys")), return_inverse=True)
    many, end, slices = len(keys), np.cumsum(n).tolist(), sent.column("slice").to_pylist()
    del keys
    asked = [(j - k, j) for s, j, k in zip(slices, end, n.tolist()) if s >= 0]
    sums = []
    for c in ("t", "b"):
        total = np.bincount(where, numbers(sent.column(c)), many).astype(np.int64)
        sums.append(pa.array([planes(total[where[i:j]]) for i, j in asked], pa.binary()))
    bucket = sent.column("bucket")[0].as_py()
    return pa.table([pa.array([s for s in slices if s >= 0], pa.int32()), pa.array([bucket] * len(asked), pa.int32()), *sums], names=["slice", "bucket", "t", "b"])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> doc_id, words; the first row of a slice of the batch also has the slice's distinct words that the task has not sent
    yet (as far as it remembers them, some millions)."""
    sent = np.zeros(0, np.uint64)
    for whole in batches:
        for batch in small_slices(whole, "text"):
            buf, offs = byte_column(batch.column(1))
            words, first = word_hashes(LOWER[buf], offs)
            new = np.unique(words & ~ODD)
            at = np.minimum(np.searchsorted(sent, new), max(0, len(sent) - 1))
            new = new[sent[at] != new] if len(sent) else new
            sent = np.sort(np.concatenate([sent, new])) if len(sent) < 4_000_000 else new
            fresh = [new.view(np.int64)] + [None] * (batch.num_rows - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first).astype(np.int64)), pa.array(fresh, pa.list_(pa.int64()))], names=["doc_id", "n", "fresh"])


def totals(models: "Models", scratch: Scratch) -> tuple[int, int, int]:
    """Words of the target and of all documents, and distinct words; the start mark of a text is a word."""
    rows = models.docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(counted, "doc_id long, n long, fresh array<long>")
    rows = scratch.keep(rows, "counted")
    words = lambda df: df.agg(F.sum(F.col("n") + (F.col("n") > 0).cast("long"))).first()[0] or 0
    every = words(rows)
    used = rows.select(F.explode("fresh").alias("word")).distinct().count() + int(every > 0)
    of_target = words(rows.join(models.target, "doc_id", "left_semi"))
    scratch.drop(rows)
    return of_target, every, used


def scorer(strength: float, words_t: int, words_b: int, used: int) -> Callable:
    scale = words_t / words_b if words_t and words_b else 1.0

    def score(docs: pa.Table, sums: pa.Table) -> pa.Table:
        sums = sums.sort_by("bucket")
        counts = [np.concatenate([np.zeros(0), *(unplanes(x) for x in sums.column(c).to_pylist())]) for c in ("t", "b")]
        counts[1] *= scale
        keys = slice_keys(docs, pa.array([], pa.int64()))[0]
        out = []
        for batch in pieces(docs):
            word, before, pair, first = hashes(batch.column(batch.schema.get_field_index("text")))
            n, means = np.diff(first), []
            word, before, pair = (np.searchsorted(keys, x) for x in (word, before, pair))
            for c, total in zip(counts, (words_t, words_t or words_b)):  # the background is scaled to the target
                loss = np.log(c[before] + strength) - np.log(c[pair] + strength * (c[word] + 1) / (total + used + 1))
                upto = np.r_[0.0, np.cumsum(loss)]
                means.append((upto[first[1:]] - upto[first[:-1]]) / np.maximum(n, 1))
            none = n == 0
            losses = [pa.array(m, pa.float64(), mask=none) for m in means]
            gap = np.where(none | (words_t == 0), 0.0, means[0] - means[1])
            out.append(pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(n.astype(np.int64)), *losses, pa.array(gap)], schema=schema))
        return pa.Table.from_batches(out, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("score", pa.float64())])
    return score


@dataclass
class Models:
    """The matched pair: the corpus, the ids of its target documents, and the smoothing. Counted when documents are scored."""

    docs: DataFrame
    target: DataFrame
    strength: float


def train(docs: DataFrame, target: DataFrame, *, strength: float = 16.0) -> Models:
    """target: one row for each doc_id of the target corpus."""
    return Models(docs, target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct(), strength)


def score_documents(docs: DataFrame, models: Models) -> DataFrame:
    """One row a document: doc_id, n_tokens, target_loss, background_loss (means over words), score."""
    size = models.docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if docs is not models.docs:
        size = max(size, docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n = max(1, -(-size // SLICE))
    buckets = 2 * n  # a bucket holds all that it got, its sums and its answers at once, so it gets half of what a slice sends

    def dealt(df: DataFrame, key) -> DataFrame:
        return df.withColumn("slice", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).repartition(n, "slice")

    def texts(df: DataFrame) -> DataFrame:
        return dealt(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), F.coalesce("doc_id", F.xxhash64("text")))

    def send(rows: DataFrame, **role) -> DataFrame:
        return rows.groupBy("slice").cogroup(dealt(models.target, F.col("doc_id")).groupBy("slice")).applyInArrow(sender(buckets, **role), SENT)

    sizes = totals(models, Scratch(docs.sparkSession, "lm"))
    rows = texts(docs)  # read twice, shuffled once
    if docs is models.docs:
        sent = send(rows, counts=True, asks=True)
    else:
        sent = send(rows, counts=False, asks=True).union(send(texts(models.docs), counts=True, asks=False))
    sums = sent.groupBy("bucket").applyInArrow(add_up, SUMS).repartition(n, "slice")
    return rows.groupBy("slice").cogroup(sums.groupBy("slice")).applyInArrow(scorer(models.strength, *sizes), SCORED)


def good_documents(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, good_documents(table(spark, sf_dir, "labels"))))


QUERIES = {"op10_lm_scoring": op10_lm_scoring}
ORACLES: dict[str, str] = {}
