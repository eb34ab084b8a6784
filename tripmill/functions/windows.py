"""Window helpers on (trip_id, seq): all share one partitioning and order, so that chained operators shuffle and sort once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def trip() -> WindowSpec:
    return W.partitionBy("trip_id")


def ordered() -> WindowSpec:
    return trip().orderBy("seq")


def so_far() -> WindowSpec:
    return ordered().rowsBetween(W.unboundedPreceding, W.currentRow)


def from_end() -> WindowSpec:
    """From the last row of a trip back to the current one. A frame that ends at unbounded following says the same, but Spark
    computes it anew for every row, so its work grows with the square of a trip's length."""
    return trip().orderBy(F.desc("seq")).rowsBetween(W.unboundedPreceding, W.currentRow)


def centred(n: int) -> WindowSpec:
    """n rows around the current one; of an even n the spare row comes before."""
    return ordered().rowsBetween(-(n // 2), (n - 1) // 2)


def lag(c: str | Column, n: int = 1) -> Column:
    return F.lag(c, n).over(ordered())


def lead(c: str | Column, n: int = 1) -> Column:
    return F.lead(c, n).over(ordered())


def ffill(c: str | Column) -> Column:
    return F.last(c, ignorenulls=True).over(so_far())


def exact_sum(c: str | Column, over: WindowSpec) -> Column:
    """The sum of doubles as good as rounded once, so that it does not depend on the order of additions: multiples of 2 ** -20 add up without error
    (to 2 ** 33), and what they leave is too small for errors to matter."""
    x = c if isinstance(c, Column) else F.col(c)
    coarse = F.rint(x * 2.0**20) / 2.0**20
    return F.sum(coarse).over(over) + F.sum(x - coarse).over(over)


def bfill(c: str | Column) -> Column:
    return F.last(c, ignorenulls=True).over(from_end())


def gradient(c: str, at: str | None = None, spacing: float = 1.0) -> Column:
    """Central differences of second order inside a trip, one-sided at its ends; ``at`` holds uneven places."""
    x = F.col(c)
    if at is None:
        return F.when(lag(c).isNull(), (lead(c) - x) / spacing).when(lead(c).isNull(), (x - lag(c)) / spacing).otherwise((lead(c) - lag(c)) / (2 * spacing))
    before, after = F.col(at) - lag(at), lead(at) - F.col(at)
    inner = (before * before * lead(c) + (after * after - before * before) * x - after * after * lag(c)) / (before * after * (before + after))
    return F.when(lag(at).isNull(), (lead(c) - x) / after).when(lead(at).isNull(), (x - lag(c)) / before).otherwise(inner)


def unwrap(df: DataFrame, c: str, out: str, period: float = 6.283185307179586) -> DataFrame:
    """Angles without jumps of a whole period: each step is brought into half a period, then summed."""
    step = F.col(c) - lag(c)
    wrapped = F.pmod(step + period / 2, F.lit(period)) - period / 2
    wrapped = F.when((wrapped == -period / 2) & (step > 0), period / 2).otherwise(wrapped)
    fixed = F.when(F.abs(step) < period / 2, 0.0).otherwise(wrapped - step)
    return df.withColumn("_fix", F.coalesce(fixed, F.lit(0.0))).withColumn(out, F.col(c) + F.sum("_fix").over(so_far())).drop("_fix")


def islands(df: DataFrame, flag: Column, out: str = "run_id") -> DataFrame:
    """Numbers the runs of rows where ``flag`` holds, from 1 in each trip; null elsewhere."""
    df = df.withColumn("_on", F.coalesce(flag, F.lit(False)))
    df = df.withColumn("_new", (F.col("_on") & ~F.coalesce(lag("_on"), F.lit(False))).cast("int"))
    return df.withColumn(out, F.when(F.col("_on"), F.sum("_new").over(so_far()))).drop("_on", "_new")


def spans(df: DataFrame, flag: Column, *keys: str) -> DataFrame:
    """One row a run: trip_id, run_id, start_seq, end_seq (inclusive), n_rows."""
    runs = islands(df, flag).where("run_id IS NOT NULL")
    return runs.groupBy("trip_id", *keys, "run_id").agg(F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.count("*").alias("n_rows"))


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the folder that ``spark.checkpoint.dir`` names: computed once, without lineage, and its size is known to later joins.
    It stays until the folder's owner clears it. Only a local master that names no folder gets a temporary one of its own."""
    spark = df.sparkSession
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tripmill-')}")
        folder = context.getCheckpointDir()
    path = f"{folder.rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
