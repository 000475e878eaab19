"""Metrics of predictions: errors, correlations, areas under curves, rankings within groups, permutation summaries.

Predictions are (y, p) and what tells them apart. Whatever needs an order is made of sums over an order (functions/ordered.py): no
window runs over a whole table and no two predictions are ever paired. Each function gives one row; a metric that is not defined is null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, named
from ..functions.ordered import PARTS, _part, average_rank, cumulate, quantiles

# Metrics of which less is better.
LOWER_IS_BETTER = ("mae", "rmse", "log_loss")
CLIP = 1e-7
#: A column whose values differ by no more than this is constant.
FLAT = 1e-12


def direction(metric: str) -> int:
    return -1 if metric in LOWER_IS_BETTER else 1


def finite_pairs(df: DataFrame, y: str, p: str) -> DataFrame:
    """(y, p): the rows in which both are finite numbers."""
    return df.select(finite(named(y)).alias("y"), finite(named(p)).alias("p")).where("y is not null and p is not null")


def _correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation; null if either side is flat. Both are scaled by their largest magnitude, so that squares neither overflow nor vanish."""
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """n, mae, rmse, pearson, spearman (of average ranks; both null for a constant side or fewer than two rows)."""
    pairs = finite_pairs(df, y, p)
    scale = pairs.agg(*(F.max(F.abs(c)).alias(f"_{c}") for c in ("y", "p")), *((F.max(c) - F.min(c)).alias(f"_r{c}") for c in ("y", "p")))
    ranked = average_rank(average_rank(pairs, "y", "_ry_"), "p", "_rp_").crossJoin(F.broadcast(scale))  # one row
    own = lambda c: F.try_divide(F.col(c), F.col(f"_{c}"))
    moving = (F.max("_ry") > FLAT) & (F.max("_rp") > FLAT)
    error = F.col("y") - F.col("p")
    return ranked.agg(F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.when(moving, _correlation(own("y"), own("p"))).alias("pearson"), F.when(moving, _correlation(F.col("_ry_"), F.col("_rp_"))).alias("spearman"))


# --- Kendall's tau ----------------------------------------------------------------------------------------------


def _agreement(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> int:
    """Weight of concordant pairs less that of discordant ones, by merging runs that are twice as long each time. x, y: whole numbers."""
    by = np.lexsort((y, x))
    x, y, w = x[by], np.unique(y[by], return_inverse=True)[1].astype(np.int64), w[by].astype(np.int64)
    n, span, total = len(x), int(y.max()) + 2 if len(y) else 1, 0
    place, size = np.arange(n), 1
    while size < n:
        block = place // (2 * size)
        left = place % (2 * size) < size
        lk, rk = block[left] * span + y[left], block[~left] * span + y[~left]
        order = np.argsort(lk, kind="stable")
        lk, sums = lk[order], np.concatenate(([0], np.cumsum(w[left][order])))
        start, end = np.searchsorted(lk, block[~left] * span), np.searchsorted(lk, (block[~left] + 1) * span)
        below = sums[np.searchsorted(lk, rk, "left")] - sums[start]
        above = sums[end] - sums[np.searchsorted(lk, rk, "right")]
        total += int((w[~left] * (below - above)).sum())
        size *= 2
    # Rows of one x stand in rising order of y and were all counted as concordant.
    edges = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))) if n else np.zeros(1, int)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a > 1:
            same = np.bincount(y[a:b], w[a:b]).astype(np.int64)
            total -= int((int(same.sum()) ** 2 - int((same**2).sum())) // 2)
    return total


def kendall_tau(df: DataFrame, y: str, p: str, parts: int = PARTS) -> DataFrame:
    """n and kendall_tau (tau-b); null for a constant side.

    Values are cut into parts on either side. Pairs of rows in different parts on both sides are counted from the sizes of the parts' cells alone; pairs with a part
    in common are counted by merging within that part. So a task holds one part, and no two rows are ever paired.
    """
    cells = finite_pairs(df, y, p).groupBy("y", "p").agg(F.count("*").alias("n"))
    cuts = cells.agg(*(F.percentile_approx(c, [k / parts for k in range(1, parts)], parts * 40).alias(f"_{c}") for c in ("y", "p")))
    cells = cells.crossJoin(F.broadcast(cuts))  # one row
    for c in ("y", "p"):
        cells, step = cells.withColumn(f"{c}_part", F.lit(0)), parts // 2
        while step:
            cells, step = cells.withColumn(f"{c}_part", _part(F.col(c), F.col(f"_{c}"), F.col(f"{c}_part"), step)), step // 2
    cells = cells.drop("_y", "_p")

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        y, p = (np.unique(rows[c], return_inverse=True)[1].astype(np.int64) for c in ("y", "p"))
        return pd.DataFrame({"s": [str(_agreement(y, p, rows["n"].to_numpy()))]})

    def across(rows: pd.DataFrame) -> pd.DataFrame:
        p = np.unique(rows["p"], return_inverse=True)[1].astype(np.int64)
        return pd.DataFrame({"s": [str(_agreement(rows["y_part"].to_numpy().astype(np.int64), p, rows["n"].to_numpy()))]})

    def crossing(sizes: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((parts, parts), object)
        for a, b, n in zip(sizes["y_part"], sizes["p_part"], sizes["n"], strict=True):
            grid[a, b] += int(n)
        beyond = np.cumsum(np.cumsum(grid[::-1, ::-1], 0), 1)[::-1, ::-1]
        less = np.cumsum(np.cumsum(grid[::-1], 0), 1)[::-1]
        total = 0
        for a in range(parts - 1):
            for b in range(parts):
                total += grid[a, b] * ((beyond[a + 1, b + 1] if b + 1 < parts else 0) - (less[a + 1, b - 1] if b else 0))
        return pd.DataFrame({"s": [str(total)]})

    def mixed(c: str) -> DataFrame:
        """Cells of the parts with several values: a value with a large share of the rows fills a part of its own, where all pairs tie."""
        several = cells.groupBy(f"{c}_part").agg(F.min(c).alias("lo"), F.max(c).alias("hi")).where("lo < hi").select(f"{c}_part")
        return cells.join(F.broadcast(several), f"{c}_part", "left_semi")  # one row a part

    sizes = cells.groupBy("y_part", "p_part").agg(F.sum("n").alias("n"))  # parts * parts rows at most
    s = mixed("y").groupBy("y_part").applyInPandas(within, "s string").unionByName(mixed("p").groupBy("p_part").applyInPandas(across, "s string"))
    s = s.unionByName(sizes.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(lambda g: crossing(g), "s string"))
    number = F.col("s").cast("decimal(38,0)")
    square = lambda c: F.sum(F.col(c).cast("decimal(38,0)") * (F.col(c) - 1))
    ties = [cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum("n").alias(f"all_{c}"), square("n").alias(f"tied_{c}")) for c in ("y", "p")]
    out = s.agg(F.sum(number).alias("s")).crossJoin(ties[0]).crossJoin(ties[1])  # one row each
    pairs = lambda c: F.col("all_y").cast("double") * (F.col("all_y") - 1) - F.col(f"tied_{c}").cast("double")
    return out.select(F.coalesce("all_y", F.lit(0)).alias("n"), F.try_divide(2 * F.col("s").cast("double"), F.sqrt(pairs("y")) * F.sqrt(pairs("p"))).alias("kendall_tau"))


# --- classes ----------------------------------------------------------------------------------------------------


def classification_metrics(df: DataFrame, y: str, p: str, threshold: float = 0.5) -> DataFrame:
    """n, balanced_accuracy (p >= threshold is a 1; the mean over the classes there are), roc_auc and average_precision (null with one class), log_loss (p kept from 0 and 1)."""
    pairs = finite_pairs(df, y, p)
    scores = pairs.groupBy((-F.col("p")).alias("score")).agg(F.sum("y").alias("hits"), F.count("*").alias("n"))
    curve = cumulate(scores, "score", {"hits_before": "hits", "before": "n"})
    totals = scores.agg(F.sum("hits").alias("pos"), F.sum("n").alias("n"))
    curve = curve.crossJoin(F.broadcast(totals.withColumnRenamed("n", "all")))  # one row
    neg = F.col("all") - F.col("pos")
    # Falling scores: each score's zeros meet the ones before them, and half of those they are tied with.
    zeros = F.col("n") - F.col("hits")
    area = curve.agg(
        F.try_divide(F.sum(zeros * (F.col("hits_before") + F.col("hits") / 2)), F.max(F.col("pos") * neg)).alias("roc_auc"),
        F.when(F.max(neg) > 0, F.try_divide(F.sum(F.col("hits") * (F.col("hits_before") + F.col("hits")) / (F.col("before") + F.col("n"))), F.max("pos"))).alias("average_precision"),
    )
    clipped = F.least(F.greatest(F.col("p"), F.lit(CLIP)), F.lit(1 - CLIP))
    recall = lambda c, hit: F.avg(F.when(F.col("y") == c, hit.cast("double")))
    ones, noughts = recall(1, F.col("p") >= threshold), recall(0, F.col("p") < threshold)
    plain = pairs.agg(
        F.count("*").alias("n"), (F.coalesce(ones + noughts, 2 * ones, 2 * noughts) / 2).alias("balanced_accuracy"), F.avg(-(F.col("y") * F.ln(clipped) + (1 - F.col("y")) * F.ln(1 - clipped))).alias("log_loss"))
    return plain.crossJoin(area).select("n", "balanced_accuracy", "roc_auc", "average_precision", "log_loss")  # one row each


# --- groups -----------------------------------------------------------------------------------------------------


def group_metrics(df: DataFrame, group: str, y: str, p: str, k: int) -> DataFrame:
    """(grp, n, spearman, ndcg) of each group with two rows or more. Relevance is y above the group's least; scores that tie share their mean gain; k is at most the group's size; without relevance there is no NDCG."""
    rows = df.select(named(group).alias("grp"), finite(named(y)).alias("y"), finite(named(p)).alias("p")).where("y is not null and p is not null")
    own = Window.partitionBy("grp")
    rank = lambda c: F.rank().over(own.orderBy(c)) + (F.count("*").over(Window.partitionBy("grp", c)) - 1) / 2
    placed = rows.select("*", (F.col("y") - F.min("y").over(own)).alias("gain"), rank("y").alias("ry"), rank("p").alias("rp"), F.row_number().over(own.orderBy(F.desc("p"))).alias("place"), F.row_number().over(own.orderBy(F.desc("y"))).alias("ideal"))
    placed = placed.withColumn("shared", F.avg("gain").over(Window.partitionBy("grp", "p")))
    top = lambda place, gain: F.sum(F.when(F.col(place) <= k, F.col(gain) / F.ln(F.col(place) + 1)))
    return placed.groupBy("grp").agg(F.count("*").alias("n"), _correlation(F.col("ry"), F.col("rp")).alias("spearman"), F.try_divide(top("place", "shared"), top("ideal", "gain")).alias("ndcg")).where("n >= 2")


def _median(df: DataFrame, column: str, name: str) -> DataFrame:
    return quantiles(df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count("*").alias("n")), {name: 0.5})


def group_ranking(df: DataFrame, group: str, y: str, p: str, k: int) -> DataFrame:
    """One row: the medians over groups of Spearman and NDCG, and how many groups have two rows or more."""
    per = group_metrics(df, group, y, p, k)
    return per.agg(F.count("*").alias("n_groups")).crossJoin(_median(per, "spearman", "median_spearman")).crossJoin(_median(per, "ndcg", "median_ndcg"))  # one row each


def permutation_summary(observed: DataFrame, null: DataFrame, lower: bool = False) -> DataFrame:
    """draws, median, q05, q95, p_value = (1 + draws at least as good) / (1 + draws). observed: one row, column o; null: column v. Draws without a finite value do not count; without any all is null."""
    values = null.select(finite(F.col("v")).alias("value")).where("value is not null")
    met = values.crossJoin(F.broadcast(observed.select(F.col("o").cast("double"))))  # one row
    good = F.col("value") <= F.col("o") if lower else F.col("value") >= F.col("o")
    n = met.agg(F.count("*").alias("draws"), F.count_if(good).alias("good"))
    counts = values.groupBy("value").agg(F.count("*").alias("n"))
    out = n.crossJoin(F.broadcast(quantiles(counts, {"median": 0.5, "q05": 0.05, "q95": 0.95})))  # one row each
    return out.select("draws", "median", "q05", "q95", F.when(F.col("draws") > 0, (1 + F.col("good")) / (1 + F.col("draws"))).alias("p_value"))
