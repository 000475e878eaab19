"""Verdicts on what the evidence supports: a ladder over the facts of each scenario, then caps, then what overrides both.

Facts are one row for each scenario and representation; every rule is an expression over that row, so a verdict names the rule that set it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contract import DIAGNOSTIC, Section
from ..functions.columns import finite, named
from ..functions.ordered import quantiles
from .metrics import direction
from .stability import _median

# Verdicts.
SUPPORTED, LIMITED, INSUFFICIENT, CONTRADICTED, UNKNOWN = "SUPPORTED", "SUPPORTED_WITH_LIMITS", "INSUFFICIENT_EVIDENCE", "CONTRADICTED", "NOT_ASSESSABLE"
# How a control shuffled the labels.
ROW_METHOD, GROUP_METHOD = "row", "equal_size_group_blocks_within_group_shuffle"


def scenario_facts(records: DataFrame, case: Section) -> DataFrame:
    """(scenario, representation, model, median, sd, random_median, draws, null_median, null_q05, null_q95, p_value): the best controlled model of each scenario against its control.

    A model is controlled if there are runs of it on permuted labels; the best has the best median of those. Its null has one value for each draw, the median over seeds; without
    draws, each run is one. The random median is over all real runs of random scenarios of that representation. Where no controlled model has a finite median, only scenario and representation are set.
    """
    metric, d = case.evaluation.primary_metric, direction(case.evaluation.primary_metric)
    runs = records.where("model <> 'dummy'").withColumn("_m", finite(named(metric)))
    keys = ["scenario", "representation"]
    names = records.sparkSession.createDataFrame([(i, s.name) for i, s in enumerate(case.generalization_scenarios)], "position int, scenario string")
    wanted = names.crossJoin(records.select("representation").distinct())  # scenarios that the case names, by representations it names
    real, control = runs.where("not permuted"), runs.where("permuted")
    controlled = real.join(control.select(*keys, "model").distinct(), [*keys, "model"], "left_semi")
    per = controlled.groupBy(*keys, "model").agg(_median("_m").alias("median"), F.stddev_samp("_m").alias("sd")).where("median is not null")
    best = per.groupBy(*keys).agg(F.min(F.struct((-d * F.col("median")).alias("o"), "model", "median", "sd")).alias("b")).select(*keys, "b.model", "b.median", "b.sd")
    own = control.join(best.select(*keys, "model"), [*keys, "model"])
    drawn = own.withColumn("_any", F.max(F.col("permutation_draw").isNotNull()).over(Window.partitionBy(*keys)))  # nine draws by five seeds, not rows of data
    draws = drawn.where("_any and permutation_draw is not null").groupBy(*keys, "permutation_draw").agg(_median("_m").alias("v")).select(*keys, "v").unionByName(drawn.where("not _any").select(*keys, F.col("_m").alias("v"))).where("v is not null")
    better = F.col("v") >= F.col("median") if d > 0 else F.col("v") <= F.col("median")
    tested = draws.join(best.select(*keys, "median"), keys).groupBy(*keys).agg(F.count("*").alias("draws"), ((1 + F.count_if(better)) / (1 + F.count("*"))).alias("p_value"))
    null = quantiles(draws.groupBy(*keys, F.col("v").alias("value")).agg(F.count("*").alias("n")), {"null_median": 0.5, "null_q05": 0.05, "null_q95": 0.95}, tuple(keys))
    chance = real.where(F.col("strategy").isin(*DIAGNOSTIC)).groupBy("representation").agg(_median("_m").alias("random_median"))
    out = wanted.join(best, keys, "left").join(tested, keys, "left").join(null, keys, "left").join(chance, "representation", "left")
    return out.select("position", *keys, "model", "median", "sd", "random_median", F.coalesce("draws", F.lit(0)).alias("draws"), "null_median", "null_q05", "null_q95", "p_value")


def ladder(case: Section, is_random: Column) -> Column:
    """The status by the metric alone, over columns median, sd, random_median, null_median, p_value."""
    t, d = case.thresholds, direction(case.evaluation.primary_metric)
    low = d * F.col("median") < d * t.limited_metric
    separate = F.coalesce((d * (F.col("median") - F.col("null_median")) >= t.minimum_permutation_delta) & (F.col("p_value") <= t.maximum_permutation_p_value), F.lit(False))
    steady = F.coalesce(F.col("sd") <= t.maximum_dispersion, F.lit(True))
    refuted = ~is_random & F.coalesce(d * F.col("random_median") >= d * t.supported_metric, F.lit(False)) & low
    return F.when(F.col("median").isNull(), UNKNOWN).when(refuted, CONTRADICTED).when(~separate | low, INSUFFICIENT).when((d * F.col("median") >= d * t.supported_metric) & steady, SUPPORTED).otherwise(LIMITED)


def _flag(hit: Column) -> Column:
    return F.coalesce(hit, F.lit(False))


def capped(facts: DataFrame, case: Section) -> DataFrame:
    """facts with status, and the rules that lowered it (capped_by). Facts also have the columns of the overlap summary, targets and representations (identity conflicts), n_classes and least_class.

    In this order: repeated units in a random split (unless a fulfilled claim asks for the same units), conflicts or overlap, too few units of a class; then a claim that the partitions do not bear out.
    Scenarios without a finite metric keep their status, but for the claim.
    """
    scenarios = {s.name: s for s in case.generalization_scenarios}

    def of(test) -> Column:
        names = [n for n, s in scenarios.items() if test(s)]
        return F.col("scenario").isin(names) if names else F.lit(False)

    is_random = of(lambda s: s.strategy in DIAGNOSTIC)
    same_unit = of(lambda s: s.split_claim and s.split_claim.kind == "same_entity_across_context" and s.split_claim.entity_column == case.evaluation.bootstrap_unit)
    repeats = is_random & _flag(F.col("unit") > 0) & ~(same_unit & _flag(F.col("claim_compatible")))
    tainted = _flag((F.col("targets") > 0) | (F.col("representations") > 0) | (F.col("exact") > 0) | (F.col("pairs") > 0) | (F.col("boundary") > 0))
    floor = case.thresholds.minimum_test_class_count
    observed = F.when(F.col("n_classes") >= 2, F.col("least_class")).otherwise(0)
    few = F.lit(bool(floor) and case.task.kind == "binary_classification") & F.col("n_classes").isNotNull() & (observed < (floor or 0))
    unborne = of(lambda s: s.split_claim is not None) & ~_flag(F.col("claim_compatible"))
    out = facts.withColumn("metric_status", ladder(case, is_random))
    known = F.col("metric_status") != UNKNOWN
    first = F.when(repeats & (F.col("metric_status") == SUPPORTED), LIMITED).otherwise(F.col("metric_status"))
    second = F.when(known & tainted & (F.col("_1") == SUPPORTED), LIMITED).otherwise(F.col("_1"))
    third = F.when(few & ~F.col("_2").isin(UNKNOWN, CONTRADICTED), INSUFFICIENT).otherwise(F.col("_2"))
    out = out.withColumn("_1", first).withColumn("_2", second).withColumn("_3", third)
    rules = [F.when(known & repeats, "repeated_units"), F.when(known & tainted, "conflicts_or_overlap"), F.when(known & few, "class_floor"), F.when(unborne, "claim")]
    return out.withColumns({"status": F.when(unborne, UNKNOWN).otherwise(F.col("_3")), "capped_by": F.array_compact(F.array(*rules))}).drop("_1", "_2", "_3")


def top_k_status(jaccard: Column, stable: float, unstable: float) -> Column:
    """The status of choosing the best candidates by the overlap of the choices."""
    return F.when(jaccard.isNull(), UNKNOWN).when(jaccard < unstable, INSUFFICIENT).when(jaccard < stable, LIMITED).otherwise(SUPPORTED)


def selection_verdict(ranking: DataFrame, case: Section, tainted: bool) -> DataFrame:
    """(scenario, representation, median, status) of the choice of the fewest candidates that the decision asks for. ranking: representation, k, mean_jaccard. Conflicts and overlap of any scenario cap it."""
    k = min(case.decision.k)
    status = top_k_status(F.col("mean_jaccard"), case.thresholds.stable_top_k, case.thresholds.unstable_top_k)
    capped_status = F.when(F.lit(tainted) & (status == SUPPORTED), LIMITED).otherwise(status)
    return ranking.where(f"k = {k} and representation is not null").select(F.lit(f"top-{k} selection within {case.decision.group_entity}").alias("scenario"), "representation", F.lit(None).cast("double").alias("median"), capped_status.alias("status"))


def permutation_design(control: DataFrame) -> DataFrame:
    """One row: method (of the runs that were made: one, ``mixed``, or ``unrecorded`` if any run has none) and unit (the one unit of all runs by group, else null)."""
    n = control.agg(F.count("*").alias("n"), F.count("permutation_method").alias("named"), F.count_distinct("permutation_method").alias("methods"), F.min("permutation_method").alias("method"), F.count("permutation_unit").alias("with_unit"), F.count_distinct("permutation_unit").alias("units"), F.min("permutation_unit").alias("unit"))
    method = F.when((F.col("n") == 0) | (F.col("named") < F.col("n")), "unrecorded").when(F.col("methods") > 1, "mixed").otherwise(F.col("method"))
    one = (F.col("with_unit") == F.col("n")) & (F.col("units") == 1) & ~method.isin("unrecorded", ROW_METHOD)
    return n.select(method.alias("method"), F.when(one, F.col("unit")).alias("unit"))


def advice(status: Column, holdout: bool) -> Column:
    """The least costly next step; where a holdout was read, that it must not be read again."""
    step = (
        F.when(status == SUPPORTED, "Confirm once on data that nobody has looked at.").when(status == CONTRADICTED, "Reserve outcomes of unseen entities and validate once.")
        .when(status == INSUFFICIENT, "Find the split or target at which the baselines fail before adding data or models.").when(status == UNKNOWN, "Supply what the assessment lacks.").otherwise("Look at errors and at what varies between runs.")
    )
    return F.concat(step, F.lit(" Take a new confirmation set; this holdout is spent.")) if holdout else step


def shared_verdicts(replicates_status: str, gaps: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(claim, status) that hold for all representations: the measurement, and what undeclared metadata leaves open."""
    claims = {"batch_id": "batch confounding", "time_column": "temporal generalization"}
    rows = [("measurement reliability", LIMITED if replicates_status == "ASSESSED" else UNKNOWN)]
    return rows + [(claims.get(what, f"metadata: {what}"), UNKNOWN) for what, _ in gaps if what != "replicate identifiers"]


def verdict_matrix(scenarios: DataFrame, selection: DataFrame | None, shared: list[tuple[str, str]], case: Section) -> DataFrame:
    """(claim, representation, status, median, next_step): scenarios and selections for each representation, then the shared rows once (representation null)."""
    spark = scenarios.sparkSession
    columns = ["scenario", "representation", "median", "status"]
    rows = scenarios.select(*columns) if selection is None else scenarios.select(*columns).unionByName(selection.select(*columns))
    rows = rows.unionByName(spark.createDataFrame([(c, None, None, s) for c, s in shared], "scenario string, representation string, median double, status string")) if shared else rows
    return rows.select(F.col("scenario").alias("claim"), "representation", "status", "median", advice(F.col("status"), case.holdout.enabled).alias("next_step"))
