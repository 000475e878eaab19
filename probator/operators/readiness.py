"""The composed audit of a table under a case, the findings that follow from it, and whether models may be fitted.

The audit is a handful of jobs whose results are small; findings are rules over these results. A finding is (status, code, subject, evidence, next_evidence).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contract import CaseError, Section, case_fingerprint, unconfirmed_roles
from ..functions.columns import names_identifier
from ..roles import entity_ids, is_unit, metadata_gaps, modelled_columns, pair_is_unit, role_names
from ..sources.io import dataset_fingerprint
from . import audits, profile, splits

# Statuses of findings, and of the gate.
BLOCK, WARN, UNKNOWN, INFO = "ACTION_REQUIRED", "WARNING", "NOT_ASSESSABLE", "INFO"
READY, LIMITED, BLOCKED = "READY", "READY_WITH_LIMITS", "BLOCKED"


class Finding(NamedTuple):
    status: str
    code: str
    subject: str
    evidence: str
    next_evidence: str


#: Finding code (a fixed value) and what to do next.
NEXT = {
    "unconfirmed_roles": "Let a researcher confirm these roles.",
    "no_modeled_features": "Declare a predictor that is known when predictions are made.",
    "target_modeled_as_feature": "Take the target out of the features.",
    "post_outcome_modeled_as_feature": "Take these columns out of the features.",
    "declared_post_outcome_context": "Keep these columns as context.",
    "modeled_features_missing": "Mend the declaration or restore the columns.",
    "no_observed_modeled_features": "Restore a predictor with values.",
    "target_missing": "Declare which rows count.",
    "non_finite_target": "Trace the infinite values.",
    "invalid_binary_target_support": "Provide two classes.",
    "invalid_binary_target_encoding": "Code the classes as 0 and 1.",
    "non_numeric_target": "Code the target as numbers.",
    "invalid_continuous_target_support": "Provide two distinct finite values or more.",
    "missing_values": "Say why values are missing; impute within training folds.",
    "non_finite_modeled_features": "Trace the infinite values and declare how folds treat them.",
    "non_finite_context": "Look at how the source codes these columns.",
    "duplicate_rows": "Tell repeats of a measurement from errors of loading.",
    "uninformative_modeled_features": "Look at the coding before dropping columns.",
    "entity_identifier_missing": "Recover the ids or leave the rows out by a written rule.",
    "entity_not_assessable": "Supply the id.",
    "repeated_entity": "Split and resample by the entity, not by rows.",
    "identity_conflict": "Look at the ids and keep, exclude or aggregate them.",
    "pair_target_conflict": "Say what repeats of a pair mean, or aggregate them by a written rule.",
    "identifier_leakage": "Confirm that these values are known at prediction and do not code the outcome.",
    "measurement_reliability_not_assessable": "Declare what is measured and how often, and repeat some of it.",
    "missing_high_value_metadata": "Add the metadata; do not guess it from names.",
    "declared_target_support": "Judge the support by the decision and the independent unit.",
}


def _finding(status: str, code: str, subject: str, evidence: object) -> Finding:
    return Finding(status, code + (f":{subject}" if code in ("entity_identifier_missing", "entity_not_assessable", "repeated_entity", "identity_conflict") else ""), subject, str(evidence), NEXT[code])


def audit_table(df: DataFrame, case: Section, row: str | None = None) -> dict:
    """inventory, independence, leakage, measurement, coverage and metadata gaps of the table. ``row`` is a column that numbers the rows and is no part of the data."""
    data = df.drop(row) if row else df
    columns, target = data.columns, case.task.target_column
    table = profile.column_profile(data, roles=role_names(case, columns))
    facts = {r.column_name: r.asDict() for r in table.orderBy("position").collect()}  # one row a column
    n = audits.duplicate_rows(data).first()
    features = [c for c in modelled_columns(case, columns) if c in columns]
    ids = entity_ids(case, columns)
    suspects = {c for c in features if c in entity_ids(case) or names_identifier(c)}
    high = {r.column_name for r in profile.high_cardinality(table).where("is_high").collect()}
    binary = case.task.kind == "binary_classification"
    about_target = (audits.binary_encoding if binary else audits.target_summary)(data, target).first().asDict()
    if binary:
        about_target["class_counts"] = {r["class"]: r["n"] for r in audits.class_counts(data, target).collect()}  # a binary target's classes; more are a finding
    entities = {}
    for name, entity in case.entities.items():
        if entity.id_column not in columns:
            entities[name] = {"status": UNKNOWN, "reason": f"missing {entity.id_column}"}
            continue
        found = audits.entity_summary(data, [entity.id_column]).first().asDict()
        if found["status"] == UNKNOWN:
            found["reason"] = f"{entity.id_column} has no value"
        if is_unit(case, name):
            found["conflicting_targets"] = audits.conflicts(data, entity.id_column, target).first().n_conflicts
        if entity.representation_column in columns:
            found["conflicting_representations"] = audits.conflicts(data, entity.id_column, entity.representation_column).first().n_conflicts
        elif entity.representation_column:
            found["representation_status"] = UNKNOWN
        entities[name] = found
    usable = [c for name, e in case.entities.items() if (c := e.id_column) in columns and entities[name]["status"] != UNKNOWN][:2]
    pair = audits.pair_structure(data, *usable, target).first().asDict() if len(usable) == 2 else None
    pair = pair if pair and pair["n_pairs"] else None
    keys = audits.replicate_columns(case, columns) or (ids[:2] if len(ids) >= 2 and pair and pair["repeated_rows"] else [])
    measured = audits.replicates(data, keys, target, binary).first().asDict() if keys else {"status": UNKNOWN, "repeated_groups": 0}
    covered = audits.coverage_columns(case, columns)
    return {
        "inventory": {
            "rows": n.n_rows, "columns": len(columns), "physical_types": dict(data.dtypes), "missing": {c: f["n_missing"] for c, f in facts.items() if f["n_missing"]},
            "constant_columns": [c for c, f in facts.items() if f["is_constant"]], "near_constant_columns": [c for c, f in facts.items() if f["modal_near"]], "duplicate_rows": n.n_duplicates,
            "high_cardinality": [c for c in columns if c in high], "non_finite": {c: f["n_infinite"] for c, f in facts.items() if f["n_infinite"]}, "target": about_target,
            "dataset_fingerprint": dataset_fingerprint(data, case.data.fingerprint_columns), "case_fingerprint": case_fingerprint(case),
        },
        "independence": {"entities": entities, "pair_structure": pair, "pair_is_unit": pair_is_unit(case), "warnings": independence_warnings(entities, case)},
        "leakage": {
            "modelled": features, "absent": sorted(set(modelled_columns(case, columns)).difference(columns)), "suspicious": [r.feature for r in audits.identifier_leakage(data, features, suspects).where("suspicious").collect()],
            "post_outcome": case.features.post_outcome,
        },
        "measurement": measured | {"keys": keys},
        "coverage": {r.column_name: {"unique": r.n_unique, "missing": r.n_missing} for r in audits.coverage(data, covered).collect()} if covered else {},
        "metadata_gaps": metadata_gaps(case),
    }


def independence_warnings(entities: dict[str, dict], case: Section) -> list[str]:
    """What speaks against taking rows as independent: repeated ids, rows without one, ids with several targets or representations, no independent unit."""
    some = lambda field, least=1: any((e.get(field) or 0) >= least for e in entities.values())
    rules = [
        (some("most", 2), "rows repeat declared entities"), (some("n_missing"), "declared ids are missing in some rows"), (some("conflicting_targets"), "ids have several targets"),
        (some("conflicting_representations"), "ids have several representations"), (not case.evaluation.bootstrap_unit, "no independent unit is declared"),
    ]
    return [text for holds, text in rules if holds]


def declaration_findings(case: Section) -> list[Finding]:
    """Findings that need no data: unconfirmed roles, no feature left, the target or later columns among the features."""
    out = []
    roles = unconfirmed_roles(case)
    if roles:
        out.append(_finding(BLOCK, "unconfirmed_roles", "case", ", ".join(roles)))
    features = modelled_columns(case, [])
    if case.features.include and not features:
        out.append(_finding(BLOCK, "no_modeled_features", "features", "all included features are excluded"))
    if case.task.target_column in features:
        out.append(_finding(BLOCK, "target_modeled_as_feature", case.task.target_column, "the target is a feature"))
    if case.features.post_outcome:
        late = sorted(set(case.features.post_outcome).intersection(features))
        out.append(_finding(BLOCK if late else INFO, "post_outcome_modeled_as_feature" if late else "declared_post_outcome_context", "features", late or case.features.post_outcome))
    return out


def target_findings(audit: dict, case: Section) -> Iterator[Finding]:
    """Findings on the target; any of them blocks."""
    target, about = case.task.target_column, audit["inventory"]["target"]
    if audit["inventory"]["missing"].get(target):
        yield _finding(BLOCK, "target_missing", target, audit["inventory"]["missing"][target])
    if audit["inventory"]["non_finite"].get(target):
        yield _finding(BLOCK, "non_finite_target", target, audit["inventory"]["non_finite"][target])
    if case.task.kind == "binary_classification":
        if about["invalid_support"]:
            yield _finding(BLOCK, "invalid_binary_target_support", target, about["class_counts"])
        if about["invalid_encoding"]:
            yield _finding(BLOCK, "invalid_binary_target_encoding", target, about["class_counts"])
    elif not about["is_numeric"]:
        yield _finding(BLOCK, "non_numeric_target", target, audit["inventory"]["physical_types"][target])
    elif about["invalid_support"]:
        yield _finding(BLOCK, "invalid_continuous_target_support", target, about["n_distinct"])


def data_findings(audit: dict, case: Section, *, policies_pending: bool = True) -> Iterator[Finding]:
    """Findings on the data. While policies are pending, conflicts that a policy will exclude or aggregate are a warning; afterwards they block."""
    inventory, leakage, target = audit["inventory"], audit["leakage"], case.task.target_column
    modelled, missing = leakage["modelled"], inventory["missing"]
    if leakage["absent"]:
        yield _finding(BLOCK, "modeled_features_missing", "features", leakage["absent"])
    elif not modelled and not case.features.include:
        yield _finding(BLOCK, "no_modeled_features", "features", "no column is left for models")
    if modelled and all(missing.get(c) == inventory["rows"] and inventory["rows"] for c in modelled):
        yield _finding(BLOCK, "no_observed_modeled_features", "features", sorted(modelled))
    yield from target_findings(audit, case)
    if missing:
        yield _finding(WARN, "missing_values", "table", missing)
    infinite = {c: n for c, n in inventory["non_finite"].items() if c != target}
    for code, status, own in (("non_finite_modeled_features", BLOCK, {c: n for c, n in infinite.items() if c in modelled}), ("non_finite_context", WARN, {c: n for c, n in infinite.items() if c not in modelled})):
        if own:
            yield _finding(status, code, "table", own)
    if inventory["duplicate_rows"]:
        yield _finding(WARN, "duplicate_rows", "table", inventory["duplicate_rows"])
    dull = sorted({*inventory["constant_columns"], *inventory["near_constant_columns"]}.intersection(modelled))
    if dull:
        yield _finding(WARN, "uninformative_modeled_features", "features", dull)
    for name, entity in audit["independence"]["entities"].items():
        if entity.get("n_missing"):
            yield _finding(BLOCK, "entity_identifier_missing", name, entity["n_missing"])
        if entity["status"] == UNKNOWN:
            yield _finding(UNKNOWN, "entity_not_assessable", name, entity["reason"])
            continue
        if entity["repeated_rows"]:
            yield _finding(WARN, "repeated_entity", name, entity["repeated_rows"])
        clashes = [entity.get("conflicting_targets") or 0, entity.get("conflicting_representations") or 0]
        if any(clashes):
            policy = case.entities[name].identity_conflict_policy
            known = policy == "keep" or policies_pending and policy is not None
            yield _finding(WARN if known else BLOCK, "identity_conflict", name, f"targets {clashes[0]}, representations {clashes[1]}, policy {policy}")
    pair = audit["independence"]["pair_structure"]
    if pair and audit["independence"]["pair_is_unit"] and pair["conflicting_pairs"]:
        yield _finding(BLOCK, "pair_target_conflict", "pair", pair["conflicting_pairs"])
    if leakage["suspicious"]:
        yield _finding(WARN, "identifier_leakage", "features", leakage["suspicious"])
    if audit["measurement"]["status"] == UNKNOWN:
        yield _finding(UNKNOWN, "measurement_reliability_not_assessable", "measurement", audit["measurement"]["keys"])
    for what, why in audit["metadata_gaps"]:
        yield _finding(UNKNOWN, "missing_high_value_metadata", what, why)
    yield _finding(INFO, "declared_target_support", target, inventory["target"])


def findings(audit: dict, case: Section, *, policies_pending: bool = True) -> list[Finding]:
    return [*declaration_findings(case), *data_findings(audit, case, policies_pending=policies_pending)]


def readiness(found: list[Finding]) -> dict:
    """status, blocking and limiting codes, each once and in the order found. An unknown status is an error."""
    unknown = sorted({f.status for f in found} - {BLOCK, WARN, UNKNOWN, INFO})
    if unknown:
        raise ValueError(f"unknown finding statuses {unknown}")
    codes = lambda *statuses: list(dict.fromkeys(f.code for f in found if f.status in statuses))
    blocking, limiting = codes(BLOCK), codes(WARN, UNKNOWN)
    return {"status": BLOCKED if blocking else LIMITED if limiting else READY, "blocking": blocking, "limiting": limiting, "may_fit": not blocking}


def require_ready(found: list[Finding]) -> dict:
    """The readiness; if anything blocks, an error that names it."""
    gate = readiness(found)
    if not gate["may_fit"]:
        raise CaseError(f"BLOCKED by {', '.join(gate['blocking'])}")
    return gate


def finding_table(df: DataFrame, found: list[Finding]) -> DataFrame:
    """Findings as rows, in order."""
    return df.sparkSession.createDataFrame([(i, *f) for i, f in enumerate(found)], "position int, status string, code string, subject string, evidence string, next_evidence string")


def gate_table(table: DataFrame) -> DataFrame:
    """One row: n_findings, n_blocking, n_limiting, readiness, from findings as rows."""
    n = table.agg(F.count("*").alias("n_findings"), F.count_if(F.col("status") == BLOCK).alias("n_blocking"), F.count_if(F.col("status").isin(WARN, UNKNOWN)).alias("n_limiting"))
    return n.withColumn("readiness", F.when(F.col("n_blocking") > 0, BLOCKED).when(F.col("n_limiting") > 0, LIMITED).otherwise(READY))


def partition_findings(df: DataFrame, case: Section, row: str, split: DataFrame, scenario: str, seed: int) -> list[Finding]:
    """Findings on either side of a partition, their codes and subjects marked with side, scenario and seed. INFO is left out."""
    out = []
    for part, side in (("train", "training"), ("test", "evaluation")):
        rows = df.join(split.where(F.col("part") == part).select(F.col("row_id").alias("_rid")), F.col(row) == F.col("_rid"), "left_semi")
        scope = f"{side}_partition:{scenario}:seed_{seed}"
        out += [f._replace(code=f"{scope}:{f.code}", subject=f"{scope} {f.subject}") for f in findings(audit_table(rows, case, row), case, policies_pending=False) if f.status != INFO]
    return out


def development(df: DataFrame, case: Section) -> tuple[DataFrame, int]:
    """(the rows that may be looked at, how many were left out)."""
    scope = splits.development_scope(df, case)
    rows = df.where(scope)
    return rows, df.count() - rows.count()
