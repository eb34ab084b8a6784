"""Mixing sources to target weights by weighted fair queueing.

Each source sends its documents, shuffled by a hash and repeated up to ``most`` times, through a queue that serves all sources at
once: a document's virtual finish time is the source's words up to its end, over the source's target. All copies are range-sorted by that
time and served whole in its order until the whole budget is spent; the copy at the cut is taken in part. So all sources end
together, each within one document of its target.

The running total over the sorted copies has two levels: the sums of the sorted ranges are added up on the driver (one number a
range), and only the range that holds the cut is summed row by row. The cut is then one row, the last that is served, and every
document compares its copies with it; nothing is shuffled back.

Targets: the budget (all sizes) is shared by weight; no target exceeds ``most`` times its source's size, and what is over
goes to the other sources by weight, until no target is above.

The running total of a source is a two-level prefix sum too: sources are cut by hash into ``buckets`` ranges of the shuffled order,
so that a source with a third of all rows is no larger a group than any other. Null texts count 0 words and take 0. A null
source is a source of its own, the last. Repeated rows, and rows with a null or repeated doc_id, are separate documents; those without doc_id are
shuffled by their text. Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, table

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """(source, source_size) with one row a source -> source, source_size, target. Water filling in closed form: sources are
    capped in the order of cap over weight, and the level is where the caps before and the weights from here share the budget.

    The windows run over one row a source, already aggregated.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    caps = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("cap", most * F.col("source_size"))
    by_ratio = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(W.partitionBy())
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    levels = caps.withColumn("level", (total - before) / weights)
    open_ = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    level = F.first(open_, ignorenulls=True).over(by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    filled = levels.withColumn("fill", level)
    target = F.when(F.col("fill").isNull(), F.col("cap")).otherwise(F.least(F.col("cap").cast("double"), F.col("fill") * F.col("weight")))
    return filled.select("source", "source_size", target.cast("double").alias("target"), F.row_number().over(by_name).alias("place_of_source"))


def queued(docs: DataFrame, bounds: DataFrame, buckets: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document with its place in its source's queue: ``upto``, the source's words up to its end, once through the source."""
    within = W.partitionBy("source", "bucket").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = shuffled(docs, buckets, keep).withColumn("upto", F.sum("size").over(within))
    rows = rows.join(bounds, rows.source.eqNullSafe(bounds.s) & (rows.bucket == bounds.b))
    return rows.select("doc_id", "source", *keep, "size", "source_size", "target", "place_of_source", (F.col("before") + F.col("upto")).alias("upto"))


def shuffled(docs: DataFrame, buckets: int, keep: tuple[str, ...] = ()) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    place = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit(":"), "text"), F.lit(":")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), place.alias("place"), *keep)
    return rows.withColumn("bucket", F.pmod(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32), F.lit(buckets)).cast("int"))


def served(copy) -> "F.Column":
    """Words of the source up to the end of a document's copy (from 0)."""
    return copy * F.col("source_size") + F.col("upto")


def cut_of(queue: DataFrame, budget: int, most: int, scratch: Scratch) -> tuple | None:
    """(finish, place_of_source, served, words that still fit) of the copy at which the budget ends; None if it never does."""
    copies = queue.where("size > 0 AND target > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    copies = copies.select((served(F.col("copy")) / F.col("target")).alias("finish"), "place_of_source", served(F.col("copy")).alias("served"), "size")
    order = ["finish", "place_of_source", "served"]
    line = scratch.keep(copies.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "line")
    at = 0
    for r in sorted(line.groupBy("part").agg(F.sum("size").alias("words")).collect()):  # one row a sorted range
        if at + r["words"] > budget:
            total = F.sum("size").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) + at
            last = line.where(F.col("part") == r["part"]).withColumn("total", total).where(F.col("total") > budget).orderBy("total").first()
            return last["finish"], last["place_of_source"], last["served"], budget - (last["total"] - last["size"])
        at += r["words"]
    return None


def mix_sources(docs: DataFrame, *, most: int = 3, buckets: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, source, the columns of ``keep``, size, source_size, target, taken (words taken, repeats
    counted) and ``finish``, the virtual finish time of its first copy.

    buckets: into how many ranges a source's order is cut; by default one for 50 000 rows of the table, and 1024 at least. It changes no
    result. keep: any columns but those named here.
    """
    if clash := {"doc_id", "source", "size", "source_size", "target", "taken", "finish"} & set(keep):
        raise ValueError(f"columns of the result can't be kept: {sorted(clash)}")
    kept, docs, keep = keep, docs.withColumn("__kept", F.struct(*keep)) if keep else docs, ("__kept",) if keep else ()
    buckets = buckets or max(1024, docs.count() // 50_000)
    scratch = Scratch(docs.sparkSession, "mix")
    parts = scratch.keep(shuffled(docs, buckets).groupBy("source", "bucket").agg(F.sum("size").alias("part")), "parts")
    targets = source_targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")), most).withColumnRenamed("source", "t")
    order = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("part").over(order), F.lit(0))).withColumnsRenamed({"source": "s", "bucket": "b"})
    bounds = scratch.keep(parts.join(targets, parts.s.eqNullSafe(targets.t)).select("s", "b", "part", "before", "source_size", "target", "place_of_source"), "bounds")
    budget = bounds.agg(F.sum("part")).first()[0] or 0
    bounds = bounds.drop("part")
    queue = scratch.keep(queued(docs, bounds, buckets), "queue")
    cut = cut_of(queue, budget, most, scratch)
    if keep:
        scratch.drop(queue)
        queue = queued(docs, bounds, buckets, keep)

    def words(copy: int):
        time = served(F.lit(copy)) / F.col("target")
        if cut is None:
            return F.col("size")
        finish, source, words_served, rest = cut
        now = (time == finish) & (F.col("place_of_source") == source)
        before = (time < finish) | ((time == finish) & (F.col("place_of_source") < source)) | (now & (served(F.lit(copy)) < words_served))
        return F.when(before, F.col("size")).when(now & (served(F.lit(copy)) == words_served), F.lit(rest)).otherwise(0)

    taken = F.when((F.col("size") > 0) & (F.col("target") > 0), sum((words(k) for k in range(1, most)), words(0))).otherwise(0)
    finish = F.when(F.col("target") > 0, F.col("upto") / F.col("target"))
    return queue.select("doc_id", "source", *(F.col("__kept")[c].alias(c) for c in kept), "size", "source_size", "target", taken.cast("long").alias("taken"), finish.alias("finish"))


def service_order(mixed: DataFrame, most: int = 3) -> DataFrame:
    """The mix as a sequence: one row a copy that is taken at least in part, ``words`` of it, range-sorted by virtual finish time."""
    copy = mixed.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    words = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    finish = F.col("finish") + F.col("copy") * F.col("source_size") / F.col("target")
    return copy.withColumn("words", words).withColumn("finish", finish).orderBy("finish", "source", "doc_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "finish")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows of ``documents``: a document appears once for each time it is taken. The one copy at which the budget ends is
    kept whole if at least half of it fits. Documents without a word take no part in the mix, cost nothing and stay, once."""
    mixed = mix_sources(docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row")), keep=("row",))
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size")).cast("int")).otherwise(1)
    return mixed.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), ':' || coalesce(text, ''))) AS place FROM documents),
s AS (SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
t AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS p, CAST(least(3 * source_size, coalesce(first_value(CASE WHEN level * weight <= 3 * source_size THEN level END IGNORE NULLS)
           OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * weight, 3 * source_size)) AS DOUBLE) AS target FROM l),
c AS (
  SELECT d.i, doc_id, size, source_size, target, p, sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (
  SELECT i, p, size, CAST(k * source_size + upto AS BIGINT) AS served, CAST(k * source_size + upto AS BIGINT) / target AS finish
  FROM (SELECT *, unnest(range(0, 3)) AS k FROM c) WHERE size > 0),
o AS (SELECT i, size, sum(size) OVER (ORDER BY finish, p, served ROWS UNBOUNDED PRECEDING) - size AS before, (SELECT sum(size) FROM d) AS budget FROM x),
y AS (SELECT i, sum(greatest(0, least(size, budget - before))) AS taken FROM o GROUP BY i)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken,
       CASE WHEN target > 0 THEN CAST(upto AS BIGINT) / target END AS finish
FROM c LEFT JOIN y ON c.i = y.i
"""
QUERIES = {"op6_mixing": op6_mixing}
ORACLES = {"op6_mixing": SQL}
