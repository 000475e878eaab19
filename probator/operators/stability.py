"""How much results move: between models, representations and partitions, and in the choice of the best candidates.

Experiment records are (scenario, strategy, representation, seed, model, permuted, ..., and a column for each metric); predictions
are (run_id, representation, a group, a candidate, y_pred). Records are few; predictions may be many.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, named
from ..functions.ordered import quantiles

# The axes of the decomposition that no run assesses, statuses from worst to best.
NEVER_ASSESSED = ("training_initialization", "preprocessing")
STATUS_ORDER = ("NOT_ASSESSABLE", "CONTRADICTED", "INSUFFICIENT_EVIDENCE", "SUPPORTED_WITH_LIMITS", "SUPPORTED")


def _median(c: str | Column) -> Column:
    return F.percentile(c, 0.5)


def real_runs(records: DataFrame) -> DataFrame:
    """Runs on true labels of models that look at features."""
    return records.where((~F.col("permuted")) & (F.col("model") != "dummy"))


def experiment_summary(records: DataFrame, metric: str) -> DataFrame:
    """(scenario, representation, model, permuted, median, sd, runs, finite_runs): sd is 0 for one run."""
    x = named(metric)
    return records.groupBy("scenario", "representation", "model", "permuted").agg(
        _median(F.when(~F.isnan(x), x)).alias("median"), F.coalesce(F.stddev_samp(F.when(~F.isnan(x), x)), F.lit(0.0)).alias("sd"), F.count("*").alias("runs"), F.count(finite(x)).alias("finite_runs"))


def best_model(records: DataFrame, metric: str, lower: bool = False, keys: tuple[str, ...] = ("scenario",)) -> DataFrame:
    """(keys, model, median): the model with the best median, of equal ones the first by name."""
    per = records.groupBy(*keys, "model").agg(_median(finite(named(metric))).alias("median")).where("median is not null")
    good = F.col("median") if lower else -F.col("median")
    return per.groupBy(*keys).agg(F.min(F.struct(good.alias("o"), "model", "median")).alias("b")).select(*keys, "b.model", "b.median")


def partition_variation(records: DataFrame, metric: str, strata: tuple[str, ...] = ("scenario", "representation", "model")) -> DataFrame:
    """One row: distinct_partitions, median_sd, status. Runs on one partition count by their median; partitions are told apart by partition_fingerprint.

    Not assessable without records, with a record that has no fingerprint, or if nothing has two partitions.
    """
    per = records.groupBy(*strata, "partition_fingerprint").agg(_median(finite(named(metric))).alias("m"))
    sds = per.groupBy(*strata).agg(F.stddev_samp("m").alias("sd"))
    seen = records.agg(F.count("*").alias("n"), F.count("partition_fingerprint").alias("known"), F.count_distinct("partition_fingerprint").alias("distinct_partitions"))
    out = seen.crossJoin(sds.agg(_median("sd").alias("sd")))  # one row each
    recorded = (F.col("n") > 0) & (F.col("n") == F.col("known"))
    ok = recorded & F.col("sd").isNotNull()
    return out.select(F.when(recorded, F.col("distinct_partitions")).alias("distinct_partitions"), F.when(ok, F.col("sd")).alias("median_sd"), F.when(ok, "ASSESSED").otherwise("NOT_ASSESSABLE").alias("status"))


def decomposition(records: DataFrame, metric: str) -> DataFrame:
    """(axis, status, sd): how much the metric of real runs moves along six axes; two of them are never assessed, since nothing varies along them alone.

    Without any finite metric no axis is assessed.
    """
    real = real_runs(records)
    usable = real.withColumn("_m", finite(named(metric))).where("_m is not null")

    def moved(axis: str, within: tuple[str, ...], always: bool = False) -> DataFrame:
        sd = usable.groupBy(*within).agg(F.stddev_samp("_m").alias("sd")).agg(_median("sd").alias("sd"), F.count("*").alias("n"))
        return sd.select(F.lit(axis).alias("axis"), F.when(F.col("sd").isNotNull() | (F.lit(always) & (F.col("n") > 0)), "ASSESSED").otherwise("NOT_ASSESSABLE").alias("status"), "sd")

    split = partition_variation(real, metric).crossJoin(usable.agg(F.count("*").alias("n")))  # one row each
    split = split.select(F.lit("train_validation_split").alias("axis"), F.when(F.col("n") > 0, F.col("status")).otherwise("NOT_ASSESSABLE").alias("status"), F.when(F.col("n") > 0, F.col("median_sd")).alias("sd"))
    scenarios = usable.groupBy("scenario").agg(_median("_m").alias("m")).agg(F.stddev_samp("m").alias("sd"))
    scenarios = scenarios.select(F.lit("deployment_scenario").alias("axis"), F.when(F.col("sd").isNotNull(), "ASSESSED").otherwise("NOT_ASSESSABLE").alias("status"), "sd")
    never = records.sparkSession.createDataFrame([(a, "NOT_ASSESSABLE", None) for a in NEVER_ASSESSED], "axis string, status string, sd double")
    parts = [split, moved("model_family", ("scenario", "representation", "seed"), True), moved("molecular_representation", ("scenario", "seed", "model")), scenarios, never]
    return reduce(DataFrame.unionByName, parts)


def representation_range(records: DataFrame, metric: str) -> DataFrame:
    """(scenario, model, range): how far apart the medians of a model's representations are, of models that have a median in every representation of the scenario."""
    real = real_runs(records).withColumn("_m", finite(named(metric)))
    per = real.groupBy("scenario", "model", "representation").agg(_median("_m").alias("m")).where("m is not null")
    have = real.groupBy("scenario").agg(F.count_distinct("representation").alias("need"))
    return per.groupBy("scenario", "model").agg((F.max("m") - F.min("m")).alias("range"), F.count("*").alias("n")).join(have, "scenario").where("n = need").select("scenario", "model", "range")


def status_rank(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STATUS_ORDER)), status)


def representation_sensitivity(verdicts: DataFrame, records: DataFrame, metric: str) -> DataFrame:
    """(scenario, verdict_changes, median_range, matched_range, conservative_status): what depends on the representation. verdicts: scenario, representation, status, median.

    The conservative status is the worst of the representations'; the matched range is the largest among models that all of them have.
    """
    per = verdicts.groupBy("scenario").agg((F.count_distinct("status") > 1).alias("verdict_changes"), (F.max("median") - F.min("median")).alias("median_range"), F.min_by("status", status_rank(F.col("status"))).alias("conservative_status"))
    return per.join(representation_range(records, metric).groupBy("scenario").agg(F.max("range").alias("matched_range")), "scenario", "left").select("scenario", "verdict_changes", "median_range", "matched_range", "conservative_status")


# --- the choice of the best candidates ---------------------------------------------------------------------------


def top_k(predictions: DataFrame, k: int, lower: bool = False) -> DataFrame:
    """(run, grp, candidate): the k best of each run and group by score; of equal scores the lesser candidate. predictions: run, grp, candidate, score."""
    by = F.col("score").asc() if lower else F.col("score").desc()
    place = F.row_number().over(Window.partitionBy("run", "grp").orderBy(by, "candidate"))
    return predictions.withColumn("_place", place).where(F.col("_place") <= k).select("run", "grp", "candidate")


def selection_probability(chosen: DataFrame) -> DataFrame:
    """(grp, candidate, runs, probability): the share of the group's runs that choose the candidate, of all that any run chooses."""
    members = chosen.distinct()
    runs = members.groupBy("grp").agg(F.count_distinct("run").alias("runs"))
    return members.groupBy("grp", "candidate").agg(F.count("*").alias("_n")).join(runs, "grp").select("grp", "candidate", "runs", (F.col("_n") / F.col("runs")).alias("probability"))


def pairwise_jaccard(chosen: DataFrame) -> DataFrame:
    """(grp, run_a, run_b, jaccard) of the sets that two runs of a group choose; two empty sets are equal. Runs are few, members meet by candidate."""
    members = chosen.distinct()
    sizes = members.groupBy("grp", "run").agg(F.count("*").alias("n"))
    side = lambda r: sizes.select("grp", F.col("run").alias(f"run_{r}"), F.col("n").alias(f"n_{r}"))
    pairs = side("a").join(side("b"), "grp").where("run_a < run_b")
    both = members.select("grp", "candidate", F.col("run").alias("run_a")).join(members.select("grp", "candidate", F.col("run").alias("run_b")), ["grp", "candidate"]).where("run_a < run_b").groupBy("grp", "run_a", "run_b").agg(F.count("*").alias("both"))
    met = pairs.join(both, ["grp", "run_a", "run_b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    union = F.col("n_a") + F.col("n_b") - F.col("both")
    return met.select("grp", "run_a", "run_b", F.when(union == 0, 1.0).otherwise(F.try_divide(F.col("both"), union)).alias("jaccard"))


def ranking_stability(predictions: DataFrame, k: int, lower: bool = False) -> DataFrame:
    """One row: mean_jaccard, comparisons, unstable_fraction (of chosen candidates, those that only some runs choose)."""
    chosen = top_k(predictions, k, lower)
    pairs = pairwise_jaccard(chosen).agg(F.avg("jaccard").alias("mean_jaccard"), F.count("*").alias("comparisons"))
    unstable = selection_probability(chosen).agg(F.avg((F.col("probability") < 1).cast("double")).alias("unstable_fraction"))
    return pairs.crossJoin(unstable)  # one row each


def rank_spread(predictions: DataFrame, lower: bool = False) -> DataFrame:
    """One row: the median over candidates of the standard deviation of their average rank between runs, and how many have one."""
    by = F.col("score").asc() if lower else F.col("score").desc()
    rank = F.rank().over(Window.partitionBy("run", "grp").orderBy(by)) + (F.count("*").over(Window.partitionBy("run", "grp", "score")) - 1) / 2
    sds = predictions.withColumn("_r", rank).groupBy("grp", "candidate").agg(F.stddev_samp("_r").alias("sd")).where("sd is not null")
    counts = sds.groupBy(F.col("sd").alias("value")).agg(F.count("*").alias("n"))
    return quantiles(counts, {"median_rank_sd": 0.5}).crossJoin(sds.agg(F.count("*").alias("n")))  # one row each


def ranking_results(predictions: DataFrame, ks: list[int], lower: bool = False) -> DataFrame:
    """(representation, k, mean_jaccard, comparisons, unstable_fraction, status): for each representation, and for all together (null). predictions: also representation."""
    names = sorted(r.representation for r in predictions.select("representation").distinct().collect())  # a handful that the case declares
    out = []
    for name in [None, *names]:
        rows = predictions if name is None else predictions.where(F.col("representation") == name)
        for k in ks:
            out.append(ranking_stability(rows, k, lower).select(F.lit(name).cast("string").alias("representation"), F.lit(k).alias("k"), "mean_jaccard", "comparisons", "unstable_fraction", F.when(F.col("comparisons") > 0, "ASSESSED").otherwise("NOT_ASSESSABLE").alias("status")))
    return reduce(DataFrame.unionByName, out)


def as_rankings(predictions: DataFrame, group: str, candidate: str) -> DataFrame:
    """(run, grp, candidate, score, representation) of a prediction table."""
    return predictions.select(F.col("run_id").alias("run"), named(group).cast("string").alias("grp"), named(candidate).cast("string").alias("candidate"), F.col("y_pred").alias("score"), "representation")
