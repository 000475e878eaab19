"""Whether molecular graphs are declared, constructed and split well enough, and whether evidence calls for a graph model at all. No such model is fitted here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import CaseError, Section
from ..functions.columns import named
from . import audits
from .overlap import shared_keys, sides
from .verdicts import CONTRADICTED, INSUFFICIENT, LIMITED, SUPPORTED, UNKNOWN

# Statuses of the contract and of the assessment.
VALID, UNMET, UNDECLARED = "VALID_CONTRACT", "UNMET_REQUIREMENTS", "NOT_DECLARED"
DATA_LIMITED, LOW_PRIORITY, BOUNDED_PROBE, UNJUSTIFIED = "NOT_READY_DATA_LIMITED", "FEASIBLE_BUT_LOW_PRIORITY", "READY_FOR_BOUNDED_PROBE", "NOT_JUSTIFIED_BY_CURRENT_EVIDENCE"


def contract_audit(df: DataFrame, case: Section, identity_status: str, graph: Column | None, row: str) -> dict:
    """Whether the declared graph boundary holds. ``graph`` gives each structure's canonical form; without it nothing can be assessed.

    Valid: identity conflicts are absent or resolved, no unit has several graphs or targets, and both classes have as many units as declared. A structure
    without a canonical form is an error.
    """
    spec = case.graph_readiness
    if spec is None:
        return {"status": UNDECLARED}
    if graph is None:
        return {"status": UNKNOWN}
    target, unit = case.task.target_column, spec.independent_unit_column
    built = df.withColumn("_graph", graph)
    bad = built.agg(F.count_if(F.col("_graph").isNull())).first()[0]
    if bad:
        raise CaseError(f"graph_readiness: {bad} structures cannot be read")
    n = audits.graph_counts(built, unit, "_graph", target).first().asDict()
    classes = {r["class"]: r.n_units for r in audits.class_support(audits.first_rows(built.withColumn("_u", named(unit).cast("string")), "_u", row), target).collect()}
    floor = spec.minimum_independent_units_per_class
    enough = len(classes) == 2 and min(classes.values()) >= floor
    met = identity_status in ("NO_CONFLICTS", "RESOLVED") and not n["units_with_several_graphs"] and not n["units_with_several_targets"] and enough
    m = case.metadata
    has = lambda *cs: any(c and c in df.columns for c in cs)
    metadata = {"replicate": has(m.replicate_id, m.biological_replicate_id), "batch": has(m.batch_id), "time": has(m.time_column), "treatment": has(m.treatment_column)}
    return {"status": VALID if met else UNMET, **n, "class_counts": classes, "floor": floor, "unit": unit, "scenarios": spec.evaluation_scenarios, "identity_status": identity_status, "metadata": metadata}


def graph_overlap(df: DataFrame, split: DataFrame, row: str, graph: Column) -> DataFrame:
    """One row: n_train, n_test, shared, test_fraction of canonical graphs."""
    return shared_keys(sides(df.withColumn("_graph", graph), row, split), ["_graph"])


def overlap_status(overlaps: DataFrame, support: DataFrame, floor: int, unit: str) -> DataFrame:
    """One row over the selected partitions: n_partitions, worst (most graphs shared), enough (every partition has two classes with the floor's units), status.

    overlaps: scenario, seed, shared (null if not assessed). support: scenario, seed, class, n_units, count_unit. A partition without either, or counted in another unit, cannot be assessed.
    """
    counted = support.groupBy("scenario", "seed").agg(F.count("*").alias("classes"), F.min("n_units").alias("least"), F.min(F.col("count_unit") == unit).alias("right_unit"))
    met = overlaps.join(counted, ["scenario", "seed"], "left")
    gap = F.col("shared").isNull() | ~F.coalesce(F.col("right_unit"), F.lit(False))
    n = met.agg(F.count("*").alias("n_partitions"), F.max("shared").alias("worst"), F.min((F.col("classes") == 2) & (F.col("least") >= floor)).alias("enough"), F.max(gap).alias("gap"))
    return n.select("n_partitions", "worst", "enough", F.when((F.col("n_partitions") == 0) | F.col("gap"), UNKNOWN).otherwise("ASSESSED").alias("status"))


def development_summary(verdicts: DataFrame, sensitivity: DataFrame, curve: DataFrame, scenarios: list[str]) -> DataFrame:
    """One row about the selected scenarios: n_verdicts, all_limited (every status is supported, with or without limits), bounded_gap, changes (verdicts differ between representations), matched_range, curve_rows.

    The gap is bounded if some status is insufficient or limited and none is contradicted or unknown. verdicts: scenario, status; sensitivity: scenario, verdict_changes, matched_range; curve: scenario.
    """
    chosen = F.col("scenario").isin(scenarios)
    some = lambda *statuses: F.coalesce(F.max(F.col("status").isin(*statuses)), F.lit(False))
    a = verdicts.where(chosen).agg(F.count("*").alias("n_verdicts"), F.coalesce(F.min(F.col("status").isin(SUPPORTED, LIMITED)), F.lit(False)).alias("all_limited"), (some(INSUFFICIENT, LIMITED) & ~some(CONTRADICTED, UNKNOWN)).alias("bounded_gap"))
    b = sensitivity.where(chosen).agg(F.coalesce(F.max("verdict_changes"), F.lit(False)).alias("changes"), F.max("matched_range").alias("matched_range"))
    return a.crossJoin(b).crossJoin(curve.where(chosen).agg(F.count("*").alias("curve_rows")))  # one row each


def external_summary(verdicts: DataFrame, max_p: float) -> DataFrame:
    """One row: n_verdicts, null_failure (a status is insufficient, although both classes have the units asked for, since p exceeds ``max_p``). verdicts: status, p_value, n_classes, least_class, required."""
    adequate = F.col("required").isNotNull() & (F.col("n_classes") == 2) & (F.col("least_class") >= F.col("required"))
    failed = (F.col("status") == INSUFFICIENT) & adequate & (F.col("p_value") > max_p)
    return verdicts.agg(F.count("*").alias("n_verdicts"), F.coalesce(F.max(F.coalesce(failed, F.lit(False))), F.lit(False)).alias("null_failure"))


def assess(facts: DataFrame) -> DataFrame:
    """facts with status, the first rule that holds: contract, selected verdicts, overlap, support, external failure, sufficiency, gap.

    facts: contract_status, n_verdicts, overlap_status, worst, enough, null_failure, all_limited, changes, bounded_gap.
    """
    undeclared = F.coalesce(F.col("contract_status") == UNDECLARED, F.lit(True))
    status = (
        F.when(undeclared, UNKNOWN).when(F.col("contract_status") != VALID, DATA_LIMITED).when((F.col("n_verdicts") == 0) | (F.col("overlap_status") != "ASSESSED"), UNKNOWN).when(F.col("worst") > 0, DATA_LIMITED).when(~F.col("enough"), DATA_LIMITED)
        .when(F.coalesce(F.col("null_failure"), F.lit(False)), UNJUSTIFIED).when(F.col("all_limited"), LOW_PRIORITY).when(F.col("changes") & F.col("bounded_gap"), BOUNDED_PROBE).otherwise(UNJUSTIFIED)
    )
    return facts.withColumn("status", status)


#: What holds for any graph model that is tried after this: only development data, no choice by external outcomes, and a new confirmation set.
GOVERNANCE = {"development_only": True, "external_outcomes_choose_nothing": True, "new_confirmation_set": True, "not_causal": True}
PROVENANCE = ("case_spec_hash", "dataset_fingerprint", "git_commit", "git_diff_sha256", "git_worktree_dirty", "split_manifest_hashes")


def envelope(row: dict, case_id: str, provenance: dict, external: dict | None = None) -> dict:
    """The verdict as it is written: status, the facts it rests on, governance, and where the inputs came from."""
    subset = lambda p: {k: p.get(k) for k in PROVENANCE}
    return {"schema_version": 1, "case_id": case_id, "status": row["status"], "facts": {k: v for k, v in row.items() if k != "status"}, "governance": GOVERNANCE, "input_provenance": {"development": subset(provenance), "external": subset(external) if external is not None else None}}
