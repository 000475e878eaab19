"""Sums over an order, without sorting a table in one task.

Approximate quantiles cut the values into parts of about equal size; the parts' totals are a handful of rows, and
only within a part are values put in order. Ranks, quantiles, areas under curves and cuts at a position are all built
on that, so none of them has a window over a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import half_even

#: Parts of an order, a power of two. At a billion distinct values a part has some millions of rows.
PARTS = 128


def _part(value: Column, cuts: Column, at: Column, step: int) -> Column:
    return at + F.when(value > F.element_at(cuts, at + step), F.lit(step)).otherwise(F.lit(0))


def cumulate(df: DataFrame, value: str, sums: dict[str, str], by: tuple[str, ...] = (), parts: int = PARTS) -> DataFrame:
    """df with, for each (name, column) of ``sums``, name = the column's total over the rows of the same ``by`` with a lesser value.

    df has one row for each (by, value), and value is numeric and not null. ``by`` has few distinct values, such as the columns of a table.
    """
    keys = [F.col(b) for b in by]
    cuts = df.groupBy(*keys).agg(F.percentile_approx(value, [k / parts for k in range(1, parts)], parts * 40).alias("_cuts"))
    placed = df.join(cuts, list(by)) if by else df.crossJoin(F.broadcast(cuts))  # without keys the cuts are one row
    placed, step = placed.withColumn("_part", F.lit(0)), parts // 2
    while step:
        placed = placed.withColumn("_part", _part(F.col(value), F.col("_cuts"), F.col("_part"), step))
        step //= 2
    placed = placed.drop("_cuts")
    first = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "_part").agg(*(F.sum(c).alias("_t_" + n) for n, c in sums.items()))
    totals = totals.select(*keys, "_part", *(F.coalesce(F.sum("_t_" + n).over(first), F.lit(0)).alias("_b_" + n) for n in sums))
    inside = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumns({"_i_" + n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    out = placed.join(totals, [*by, "_part"])
    return out.select(*df.columns, *((F.col("_b_" + n) + F.col("_i_" + n)).alias(n) for n in sums))


def average_rank(df: DataFrame, column: str, rank: str) -> DataFrame:
    """df with the rank of the column's value, from 1; equal values share the mean of their places. Nulls have none."""
    counts = cumulate(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n")), "_v", {"_before": "_n"})
    ranks = counts.select("_v", (F.col("_before") + (F.col("_n") + 1) / 2).alias(rank))
    return df.join(ranks, F.col(column) == F.col("_v"), "left").drop("_v")


def quantiles(counts: DataFrame, probabilities: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, and for each name its quantile, interpolated) of counts (by, value, n): one row for each distinct value."""
    keys = [F.col(b) for b in by]
    sized = cumulate(counts, "value", {"_before": "n"}, by)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_all"))
    sized = sized.join(totals, list(by)) if by else sized.crossJoin(F.broadcast(totals))  # one row

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("n")), F.col("value").cast("double")))

    place = {n: F.lit(p) * (F.col("_all") - 1) for n, p in probabilities.items()}
    found = sized.groupBy(*keys).agg(F.max("_all").alias("_all"), *(at(F.floor(x)).alias("_lo_" + n) for n, x in place.items()), *(at(F.ceil(x)).alias("_hi_" + n) for n, x in place.items()))
    return found.select(*keys, *((F.col("_lo_" + n) + (x - F.floor(x)) * (F.col("_hi_" + n) - F.col("_lo_" + n))).alias(n) for n, x in place.items()))


def numbered_keys(keys: DataFrame, order: Column, bucket: Column) -> DataFrame:
    """(key, place, n) for a table with a column ``key``: the place of each key in the order, from 1, and how many keys there are.

    ``bucket`` follows the order and has a few thousand values. A null bucket, and with it a null in the order, comes last.
    """
    rows = keys.select("key", order.alias("_h"), F.coalesce(bucket.cast("string"), F.lit("~")).alias("_b"))
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_c"))
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # over a few thousand counts
    starts = sizes.select("_b", F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_start"))
    total = sizes.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n"))
    inside = Window.partitionBy("_b").orderBy(F.col("_h").asc_nulls_last(), F.col("key").asc_nulls_first())
    placed = rows.withColumn("_i", F.row_number().over(inside)).join(starts, "_b")
    return placed.crossJoin(F.broadcast(total)).select("key", (F.col("_start") + F.col("_i")).alias("place"), "n")  # one row


def share_of(n: Column, share: float) -> Column:
    return half_even(F.lit(share) * n)
