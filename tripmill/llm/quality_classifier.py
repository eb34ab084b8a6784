"""Quality classifier: histogram gradient-boosted trees over statistics of whole documents.

Features come from the text alone (bytes, words, lines, repeats), never from doc_id, lang, source or labels. Trees are fitted
on the driver from at most ``sample`` labelled rows (the smallest by hash; a documented bound, the only sample here) and flattened
into arrays: every tree is a complete binary tree of ``depth`` levels, so a batch of documents walks all trees in numpy, one
level at a time. Scoring is one pass over the table without a shuffle.

Null and empty texts have the features 0 and a score like any other. Labels without a value are left out; of several for a
doc_id the least counts. Without any labelled rows all scores are 0.5. Rows are returned one for one, repeated rows and null doc_id
(not held out) too. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_column, small_slices, table
from .quality_rules import repeated_words
from .textkernel import word_hashes, word_spans

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "word_spread", "letters", "uppers", "digits", "high_bytes", "stops", "commas", "exclamations", "bars", "symbols", "others",
    "lines", "distinct_words", "top_word", "equal_neighbours", "distinct_pairs", "duplicate_lines", "repeated_windows", "capitals",
)
FOLDS, HELD_OUT = 5, 0


def _classes() -> np.ndarray:
    """For each byte value its class, as one row of a one-hot table."""
    groups = (range(97, 123), range(65, 91), range(48, 58), range(128, 256), b".", b",;:", b"!", b"|", b"#*$%&<>", [*range(0, 9), *range(14, 32), *b"\"'()-/=?@[\\]^_`{}~+\x7f"], b"\n", b" \t\r\x0b\x0c")
    out = np.zeros(256, np.int64)
    for k, codes in enumerate(groups):
        out[list(codes)] = k
    return out


BYTE_CLASS = _classes()


def features(column: pa.Array) -> np.ndarray:
    buf, offs = byte_column(column)
    texts = len(offs) - 1
    out = np.zeros((texts, len(FEATURES)))
    if not len(buf):
        return out
    starts, ends, _ = word_spans(buf, offs)
    words, first = word_hashes(buf, offs)
    size = (ends - starts).astype(float)
    doc = np.repeat(np.arange(texts), np.diff(offs))
    kinds = np.bincount(doc * 12 + BYTE_CLASS[buf], minlength=texts * 12).reshape(texts, 12).astype(float)
    n, w = np.diff(offs).astype(float), np.diff(first).astype(float)
    per_byte, per_word = np.maximum(n, 1), np.maximum(w, 1)
    owner = np.repeat(np.arange(texts), np.diff(first))
    total = np.bincount(owner, size, minlength=texts)
    mean = total / per_word
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(n), np.log1p(w), mean
    out[:, 3] = np.sqrt(np.maximum(np.bincount(owner, size**2, minlength=texts) / per_word - mean**2, 0))
    out[:, 4], out[:, 5], out[:, 6], out[:, 7] = kinds[:, 0] / per_byte, kinds[:, 1] / per_byte, kinds[:, 2] / per_byte, kinds[:, 3] / per_byte
    for k, j in zip(range(8, 15), range(4, 11)):
        out[:, k] = kinds[:, j] / per_word
    out[:, 20] = repeated_words(words, first) / per_word
    out[:, 21] = np.bincount(owner, (buf[starts] >= 65) & (buf[starts] <= 90), minlength=texts) / per_word
    data = buf.tobytes()
    for i, (a, b, lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), offs[:-1].tolist(), offs[1:].tolist())):
        if b > a:
            own = words[a:b]
            _, often = np.unique(own, return_counts=True)
            out[i, 15], out[i, 16] = len(often) / (b - a), often.max() / (b - a)
            if b - a > 1:
                out[i, 17] = (own[1:] == own[:-1]).mean()
                out[i, 18] = len(np.unique(own[1:] * np.uint64(31) + own[:-1])) / (b - a - 1)
        lines = data[lo:hi].split(b"\n")
        out[i, 19] = 1 - len(set(lines)) / len(lines)
    return out


@dataclass
class Forest:
    """Complete binary trees as arrays: inner nodes in level order, then leaf values. A row goes right if it exceeds the threshold."""

    feature: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2**depth
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            raw += leaf[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: float = 1.0) -> Forest:
    """Boosting on the logistic loss: gradients and curvatures summed in histograms of at most ``bins`` quantile bins a feature."""
    inner, leaves = 2**depth - 1, 2**depth
    if not len(y):
        return Forest(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), 0.0, depth)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    code = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)  # code > k means x > cuts[k]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    forest = Forest(np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, leaves)), float(np.log(share / (1 - share))), depth)
    raw = np.full(len(y), forest.base)
    columns = x.shape[1]
    slot = code + bins * np.arange(columns)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, at = 2**level, 2**level - 1
            cell = ((node - at)[:, None] * (columns * bins) + slot).ravel()
            sums = [np.bincount(cell, np.repeat(v, columns), minlength=width * columns * bins).reshape(width, columns, bins) for v in (g, h)]
            gl, hl = (np.cumsum(s, axis=2)[:, :, :-1] for s in sums)
            gt, ht = (s.sum(axis=2, keepdims=True) for s in sums)
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = 0
            flat = gain.reshape(width, -1)
            best = flat.argmax(axis=1)
            for k in range(width):
                f, c = divmod(int(best[k]), bins - 1)
                if flat[k, best[k]] > 1e-9 and c < len(cuts[f]):
                    forest.feature[t, at + k], forest.threshold[t, at + k] = f, cuts[f][c]
            node = 2 * node + 1 + (x[np.arange(len(y)), forest.feature[t][node]] > forest.threshold[t][node])
        leaf = node - inner
        forest.leaf[t] = -rate * np.bincount(leaf, g, minlength=leaves) / (np.bincount(leaf, h, minlength=leaves) + ridge)
        raw += forest.leaf[t][leaf]
    return forest


def fold(doc_id) -> "F.Column":
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(FOLDS - 1))


def measurer() -> Callable:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_slices(whole, "text"):
                x = features(batch.column(2))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    return measure


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 20_000, **options) -> Forest:
    """labels: doc_id, quality. Only rows outside the held-out fold are read; at most ``sample`` are used."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).where(fold(F.col("doc_id")) != HELD_OUT)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    # of rows that repeat a doc_id one is used, so the sample bounds what is collected
    got = rows.select("doc_id", "quality", "text").mapInArrow(measurer(), "doc_id long, quality int, x array<double>").groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("r")).select("r.*").collect()
    got.sort(key=lambda r: (r["quality"], r["x"]))
    return fit(np.array([r["x"] for r in got]).reshape(-1, len(FEATURES)), np.array([r["quality"] for r in got], float), **options)


def score_quality(docs: DataFrame, forest: Forest, keep: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """doc_id, the columns of ``keep``, and the score under ``name``."""
    names = [c for c in docs.columns if c in keep and c not in ("doc_id", "text")]
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *names)
    with_text = "text" in keep
    fields = [f for f in kept.schema.fields if f.name != "text" or with_text]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_slices(whole, "text"):
                columns = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text" or with_text]
                values = forest.score(features(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(values)], names=[*(f.name for f in fields), name])

    return kept.mapInArrow(score, T.StructType([*fields, T.StructField(name, T.DoubleType())]))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier does not reject, with their columns."""
    return score_quality(docs, train(docs, labels), keep=tuple(docs.columns), name="__score").where(F.col("__score") >= threshold).select(docs.columns)


QUERIES = {"op3_quality_classifier": op3_quality_classifier}
ORACLES: dict[str, str] = {}
