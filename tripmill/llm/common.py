"""Shared helpers: table access, scratch tables in the cluster's shared folder, Arrow batches as byte arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only on a local master that names none."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tripmill-")
        context.setCheckpointDir(f"file://{root}")
        root = context.getCheckpointDir() or root
    return root.rstrip("/")


class Scratch:
    """Intermediate tables as Parquet in the shared folder, so that a lost executor costs no recomputation.

    Tables live until ``drop`` or until the folder's owner clears it: the returned frames are lazy and still read them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *kept: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in kept:
            for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def join_by_share(rows: DataFrame, known: DataFrame, key: str | list[str], n: str, hot: int = 20_000) -> DataFrame:
    """Inner join of ``rows`` with ``known``, which holds every key once and in ``n`` how many of the rows have it.

    Fewer than ``hot`` keys can have more than a hot-th of all rows: those are broadcast. The others are joined by a shuffle in which no
    key gathers more than that share, however skewed the keys are.
    """
    whole = known.agg(F.sum(n)).first()[0] or 0
    often = F.col(n) * hot > whole
    keys = [key] if isinstance(key, str) else key
    return rows.join(F.broadcast(known.where(often)), key).unionByName(
        rows.join(F.broadcast(known.where(often).select(keys)), key, "left_anti").join(known.where(~often).hint("merge"), key)
    )


def lower_ascii(text):
    """A-Z to a-z, nothing else: Spark's lower() also folds letters outside ASCII."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary array; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def small_slices(batch: pa.RecordBatch, text: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most about ``limit`` bytes of text; a longer text is a slice of its own."""
    _, offs = byte_column(batch.column(batch.schema.get_field_index(text)))
    start, n = 0, batch.num_rows
    while start < n:
        end = max(start + 1, int(np.searchsorted(offs, offs[start] + limit, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def list_slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most about ``limit`` items in a list column; a longer list is a slice of its own."""
    upto = np.r_[0, np.cumsum(batch.column(batch.schema.get_field_index(column)).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
    start, n = 0, batch.num_rows
    while start < n:
        end = max(start + 1, int(np.searchsorted(upto, upto[start] + limit, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def runs(batches: Iterator[pa.RecordBatch], key: str, most: int | None = None, weigh: str | None = None, heavy: int = 4 << 20) -> Iterator[pa.Table]:
    """Whole runs of equal ``key`` from sorted batches, several to a table. Runs over ``most`` rows, or ``heavy`` items of the list column
    ``weigh``, come in pieces of that many (two rows at least), each starting with the last half of the piece before."""
    held: list[pa.RecordBatch] = []

    def weights(table: pa.Table | pa.RecordBatch) -> np.ndarray:
        column = table.column(table.schema.get_field_index(weigh)) if weigh else None
        return np.zeros(table.num_rows, np.int64) if column is None else pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)

    def full() -> bool:
        return sum(b.num_rows for b in held) >= 2 * most or (len(held) > 1 and sum(int(weights(b).sum()) for b in held) >= 2 * heavy)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        last = int(np.argmax(keys == keys[-1]))
        if last:  # the last run may go on
            whole = pa.Table.from_batches([*held[:-1], batch.slice(0, last)])
            held = [batch.slice(last)]
            yield whole
        elif most and full():
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(key).to_numpy()
            if keys[0] != keys[-1]:
                cut = int(np.flatnonzero(keys == keys[-1])[0])
                yield table.slice(0, cut)
                table = table.slice(cut)
            upto = np.cumsum(weights(table))
            at = 0
            while True:
                before = upto[at - 1] if at else 0
                to = max(at + 2, min(at + most, int(np.searchsorted(upto, before + heavy, side="right"))))
                if to + (to - at) // 2 >= table.num_rows:
                    break
                yield table.slice(at, to - at)
                at += max(1, (to - at) // 2)
            held = table.slice(at).to_batches()
    if held:
        yield pa.Table.from_batches(held)
