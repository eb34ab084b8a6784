"""Exact quantiles of large groups by distributed selection.

``percentile`` keeps every distinct value of a group in one task. Here a quantile is found by counting: a pass over the rows counts
them in ``bins`` bins of each group's range of values, and the bins that hold a wanted rank become the ranges of the next pass. A
range is done when all its values are equal, and ranges with few values are read out. Each pass shuffles counts, never rows.

Bins are of equal width, but from the second pass on those of a range over many orders of magnitude are of equal ratio. So a pass either
cuts a range to a thousandth of its width, or to a factor of about two, and seven passes do for any values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripmill.functions.windows import written

INF = float("inf")


def _log(v: Column) -> Column:
    """A scale of orders of magnitude that rises with v, through 0."""
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.log(F.abs(v)) + 746))


def _matched(left: DataFrame, right: DataFrame, by: tuple[str, ...]) -> Column:
    return reduce(Column.__and__, (left[b].eqNullSafe(right[f"_{b}"]) for b in by), F.lit(True))


def _within(rows: DataFrame, ranges: DataFrame, by: tuple[str, ...], most_groups: int) -> DataFrame:
    """Each row that lies in a range of its group, with the range: ranges of one group have no value in common. They are broadcast if
    they are few; else there are many groups, none of them large."""
    ranges = ranges.distinct().withColumnsRenamed({b: f"_{b}" for b in by})
    few = ranges.limit(most_groups + 1).count() <= most_groups
    return rows.join(F.broadcast(ranges) if few else ranges, _matched(rows, ranges, by) & F.col("_v").between(F.col("lo"), F.col("hi"))).drop(*(f"_{b}" for b in by))


def quantiles(df: DataFrame, value: str, by: tuple[str, ...], shares: tuple[float, ...], *, bins: int = 4096, most: int = 10_000, most_groups: int = 2_000) -> DataFrame:
    """by, n (the values of the group), q: array of the quantiles in the order of ``shares``, each between the two values around
    share * (n - 1), in proportion. Values that are missing or not finite don't count; groups without any have no row.

    most: how many values a task reads out at the end, at the utmost. most_groups: up to how many ranges are broadcast.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.abs("_v") < INF)
    whole = written(rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).where("n > 0"))
    # the ranks wanted in each group, from 0, and the range of values that holds each: its least and largest value, and how many values are below and in it
    place = lambda p: F.lit(p) * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(place(p)), F.ceil(place(p))) for p in shares))))
    open_ = whole.select(*by, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("held"))
    found, rounds = [], 0
    while True:
        found.append(open_.where("lo = hi").select(*by, "rank", F.col("lo").alias("x")))
        open_ = written(open_.where("lo < hi"))
        wide = open_.where(F.col("held") > most)
        if wide.isEmpty():
            break
        inside = _within(rows, wide.select(*by, "lo", "hi", "below"), by, most_groups)
        v, lo, hi = F.col("_v"), F.col("lo"), F.col("hi")
        magnitudes = (F.greatest(F.abs(lo), F.abs(hi)) > 4096 * F.least(F.abs(lo), F.abs(hi))) | ((lo < 0) & (hi > 0)) if rounds else F.lit(False)
        share = F.when(magnitudes, (_log(v) - _log(lo)) / (_log(hi) - _log(lo))).otherwise((v / 2 - lo / 2) / (hi / 2 - lo / 2))
        rounds += 1
        counts = inside.groupBy(*by, F.col("lo").alias("from"), F.col("below").alias("under"), F.least(F.lit(bins - 1), F.floor(share * bins)).alias("bin"))
        counts = counts.agg(F.count("*").alias("c"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        before = F.sum("c").over(W.partitionBy(*by, "from").orderBy("bin").rowsBetween(W.unboundedPreceding, -1))
        counts = counts.withColumn("start", F.col("under") + F.coalesce(before, F.lit(0))).withColumnsRenamed({b: f"_{b}" for b in by})
        hit = wide.join(counts, _matched(wide, counts, by) & (wide.lo == counts["from"]) & (wide["rank"] >= counts.start) & (wide["rank"] < counts.start + counts.c))
        narrow = hit.select(*by, "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("start").alias("below"), F.col("c").alias("held"))
        open_ = written(narrow.union(open_.where(F.col("held") <= most).select(narrow.columns)))
    if not open_.isEmpty():
        values = _within(rows, open_.select(*by, "lo", "hi"), by, most_groups).groupBy(*by, F.col("lo").alias("from")).agg(F.array_sort(F.collect_list("_v")).alias("values")).withColumnsRenamed({b: f"_{b}" for b in by})
        last = open_.join(values, _matched(open_, values, by) & (open_.lo == values["from"]))
        found.append(last.select(*by, "rank", F.get("values", (F.col("rank") - F.col("below")).cast("int")).alias("x")))
    known = reduce(DataFrame.union, found).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at")).withColumnsRenamed({b: f"_{b}" for b in by})
    at = lambda r: F.element_at("at", r)
    q = [at(F.floor(place(p))) + (place(p) - F.floor(place(p))) * (at(F.ceil(place(p))) - at(F.floor(place(p)))) for p in shares]
    return whole.join(known, _matched(whole, known, by)).select(*by, "n", F.array(*q).alias("q"))
