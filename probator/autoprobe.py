"""Bounded trials of single models on a frozen development case: each is kept or discarded by rules that are fixed beforehand."""

from __future__ import annotations

import math
from datetime import UTC, datetime
from statistics import median

from pyspark.sql import SparkSession

from .contract import CaseError, Field, Section, as_document, by_name, case_fingerprint, number, one_of, parse_case, scalar, section, text
from .evaluation import evaluate_case
from .operators.metrics import direction
from .operators.models import SMOKE, seeds
from .sources import sinks

CANDIDATE = section({
    "schema_version": Field(one_of(1), 1), "candidate_id": Field(text), "model": Field(one_of(*SMOKE)), "budget": Field(one_of("smoke", "standard"), "smoke"), "complexity": Field(by_name(scalar), dict), "minimum_delta": Field(number(0), 0.01),
    "maximum_runtime_seconds": Field(number(0), 300.0), "maximum_worst_scenario_regression": Field(number(0), 0.02), "maximum_stability_regression": Field(number(0), 0.05),
})


def parse_candidate(document: dict) -> Section:
    return CANDIDATE(document, "candidate")


def prepare(spark: SparkSession, case: Section, folder: str) -> dict:
    """Freezes the case and writes a first candidate, the linear model. A case with a holdout is refused."""
    if case.holdout.enabled:
        raise PermissionError("trials never see a holdout")
    linear = "logistic" if case.task.kind == "binary_classification" else "elastic_net"
    candidate = {"candidate_id": f"baseline-{linear}", "model": linear, "complexity": {"family": "linear"}}
    sinks.write_json(spark, f"{folder}/case.json", as_document(case))
    sinks.write_json(spark, f"{folder}/candidate.json", candidate)
    sinks.write_json(spark, f"{folder}/policy.json", {"case_fingerprint": case_fingerprint(case), "may_change": ["candidate.json"], "holdout_access": False})
    return candidate


def vector(report: dict, case: Section, candidate: Section) -> dict:
    """What a trial is judged by: the median and the worst of the scenarios' medians, the widest spread, the overlap of the best candidates, runtime, and broken guardrails."""
    d = direction(case.evaluation.primary_metric)
    own = [r for r in report["experiment_summary"] if r["model"] == candidate.model and not r["permuted"]]
    found = [r["median"] for r in own if r["median"] is not None and math.isfinite(r["median"])]
    runs = len(seeds(case, candidate.budget))
    whole = found and len(found) == len(own) and all(r["runs"] == r["finite_runs"] == runs for r in own) and {r["scenario"] for r in own} == {s.name for s in case.generalization_scenarios}
    guards = [] if whole else ["a scenario or seed has no finite primary metric"]
    if report["audits"]["leakage"]["suspicious"]:
        guards.append("features look like identifiers")
    overall = [r for r in report["ranking_stability"] if r["representation"] is None and case.decision.k and r["k"] == min(case.decision.k)] if isinstance(report["ranking_stability"], list) else []
    return {
        "candidate_id": candidate.candidate_id, "case_fingerprint": case_fingerprint(case), "budget": candidate.budget, "at": datetime.now(UTC).isoformat(), "primary_metric": case.evaluation.primary_metric, "median": median(found) if found else None,
        "worst": min(found, key=lambda m: d * m) if found else None, "spread": max((r["sd"] for r in own if r["sd"] is not None), default=None), "top_k": overall[0]["mean_jaccard"] if overall else None, "runtime_seconds": report["provenance"]["runtime_seconds"],
        "complexity": dict(candidate.complexity), "guardrails": guards, "holdout_accessed": bool(report["holdout_access"]),
    }


def decide(now: dict, kept: dict | None, candidate: Section) -> tuple[str, str]:
    """KEEP or DISCARD, and the first rule that says so: guardrails, runtime, being the first, the primary metric's gain, the worst scenario, the choice of the best."""
    d = direction(now["primary_metric"])

    def loss(field: str, sign: int) -> float:
        """By how much the field is worse than what was kept; nothing if either is unknown."""
        return sign * (kept[field] - now[field]) if now[field] is not None and kept[field] is not None else 0.0

    if now["guardrails"]:
        return "DISCARD", "guardrails"
    if now["runtime_seconds"] > candidate.maximum_runtime_seconds:
        return "DISCARD", "runtime"
    if kept is None:
        return "KEEP", "first"
    if now["median"] is None or kept["median"] is None or -loss("median", d) < candidate.minimum_delta:
        return "DISCARD", "gain"
    if loss("worst", d) > candidate.maximum_worst_scenario_regression:
        return "DISCARD", "worst scenario"
    if loss("top_k", 1) > candidate.maximum_stability_regression:
        return "DISCARD", "stability"
    return "KEEP", "all rules"


def trial(spark: SparkSession, folder: str) -> dict:
    """Evaluates the folder's candidate, decides on it and adds it to the history. The case must be the frozen one, and the history of one case and budget."""
    case = parse_case(sinks.read_json(spark, f"{folder}/case.json"))
    candidate = parse_candidate(sinks.read_json(spark, f"{folder}/candidate.json"))
    if case.holdout.enabled:
        raise PermissionError("trials never see a holdout")
    frozen = sinks.read_json(spark, f"{folder}/policy.json")["case_fingerprint"]
    past = sinks.read_events(spark, f"{folder}/history")
    if frozen != case_fingerprint(case) or any((e["case_fingerprint"], e["budget"]) != (frozen, candidate.budget) for e in past):
        raise CaseError("trials need the frozen case and one budget: prepare another folder")
    report = evaluate_case(spark, case, f"{folder}/results/{candidate.candidate_id}", budget=candidate.budget, models_allowed={candidate.model})
    now = vector(report, case, candidate)
    kept = next((e for e in reversed(past) if e["decision"] == "KEEP"), None)
    now["decision"], now["because"] = decide(now, kept, candidate)
    if not sinks.append_event(spark, f"{folder}/history", len(past) + 1, now):
        raise CaseError("another trial has written to this history meanwhile")
    sinks.write_json(spark, f"{folder}/results/{candidate.candidate_id}/evaluation-vector.json", now)
    return now
