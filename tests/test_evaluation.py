"""Cases from table to verdicts, through the command surface."""

import pytest
from pyspark.sql import functions as F

from probator import autoprobe, cli, evaluation
from probator.contract import CaseError, changed, parse_case, save_case
from probator.sources import sinks, synthetic


@pytest.fixture(scope="module")
def leaky(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("leaky"))
    path = f"{base}/leakage.parquet"
    sinks.write_table(synthetic.synthetic(spark, "leakage"), path)
    case = changed(synthetic.synthetic_case("leakage", path), evaluation={"seeds": [11], "primary_metric": "spearman", "bootstrap_unit": "entity_id", "permutation_draws": 2, "model_allowlist": ["extra_trees"]}, thresholds={"maximum_permutation_p_value": 0.34})
    return base, case


def test_leakage_is_found(spark, leaky):
    base, case = leaky
    result = evaluation.evaluate_case(spark, case, f"{base}/out")
    status = {v["claim"]: v["status"] for v in result["capability_matrix"]}
    assert status["cold_entity"] in ("CONTRADICTED", "INSUFFICIENT_EVIDENCE") and status["random_row"] == "SUPPORTED_WITH_LIMITS"
    assert result["audits"]["leakage"]["suspicious"] == ["entity_token"]
    own = {v["scenario"]: v for v in result["scenario_verdicts"]}
    assert own["random_row"]["capped_by"] == ["repeated_units"] and own["random_row"]["draws"] == 2 and own["random_row"]["p_value"] == pytest.approx(1 / 3)
    assert {r["scenario"] for r in result["experiment_summary"]} == {"random_row", "cold_entity"}
    assert spark.read.parquet(f"{base}/out/predictions.parquet").select("run_id").distinct().count() == 2
    assert sinks.read_json(spark, f"{base}/out/report.json")["provenance"]["seeds"] == [11]
    assert "cold_entity" in sinks.read_text(spark, f"{base}/out/report.md") and "<table>" in sinks.read_text(spark, f"{base}/out/report.html")
    assert "random_row[declared_features]=SUPPORTED_WITH_LIMITS" in evaluation.status_line(result)
    assert evaluation.assess_graphs(spark, f"{base}/out")["status"] == "NOT_ASSESSABLE"


def test_profile_and_commands(spark, leaky, tmp_path, capsys):
    base, case = leaky
    save_case(case, f"{base}/case.yaml")
    assert cli.main(["validate-case", f"{base}/case.yaml"])["status"] == "READY_FOR_AUDIT"
    result = evaluation.profile_case(spark, case, f"{base}/eda")
    assert result["readiness"]["status"] == "READY_WITH_LIMITS" and spark.read.parquet(f"{base}/eda/column_profile.parquet").count() == 5
    with pytest.raises(CaseError, match="holdout"):
        evaluation.profile_case(spark, changed(case, holdout={"enabled": True}), f"{base}/no")
    made = cli.init_case(spark, f"{base}/leakage.parquet", f"{base}/new.yaml")
    assert made["guesses"] and cli.main(["validate-case", f"{base}/new.yaml"])["status"] == "NOT_ASSESSABLE"
    assert len(cli.discover(spark, f"{base}/leakage.parquet", f"{base}/found")["cards"]) > 2


def test_trials_are_frozen(spark, leaky):
    base, case = leaky
    with pytest.raises(PermissionError):
        autoprobe.prepare(spark, changed(case, holdout={"enabled": True}), f"{base}/t0")
    autoprobe.prepare(spark, case, f"{base}/t")
    sinks.write_json(spark, f"{base}/t/policy.json", {"case_fingerprint": "other"})
    with pytest.raises(CaseError, match="frozen"):
        autoprobe.trial(spark, f"{base}/t")


def test_blocked_before_any_fit(spark, leaky):
    base, case = leaky
    with pytest.raises(CaseError, match="BLOCKED by unconfirmed_roles"):
        evaluation.evaluate_case(spark, changed(case, role_confirmation={}), f"{base}/blocked")
    with pytest.raises(CaseError, match="supplied splits"):
        evaluation.evaluate_case(spark, changed(case, holdout={"enabled": True}), f"{base}/blocked")


def test_graphs_from_run_to_decision(spark, tmp_path):
    """Structures are text whose canonical form is upper case without blanks; the group split keeps them apart."""
    base = str(tmp_path)
    rows = [(f"m{i}", ("c" if i % 2 else "n") * (i + 1) + " " * (i % 3), float(i % 7), i % 2) for i in range(24)]
    sinks.write_table(spark.createDataFrame(rows, "mol_id string, shape string, x double, y int"), f"{base}/mols.parquet")
    case = parse_case({
        "case_id": "mols", "data": {"path": f"{base}/mols.parquet"}, "task": {"kind": "binary_classification", "prediction_unit": "mol", "target_column": "y"}, "entities": {"mol": {"id_column": "mol_id", "representation_column": "shape", "identity_conflict_policy": "exclude"}},
        "features": {"include": ["shape", "x"], "smiles_column": "shape"}, "evaluation": {"seeds": [3], "primary_metric": "balanced_accuracy", "bootstrap_unit": "mol_id", "permutation_draws": 1, "model_allowlist": ["logistic"]},
        "generalization_scenarios": [{"name": "unseen", "strategy": "group", "group_column": "mol_id"}], "thresholds": {"maximum_permutation_p_value": 1.0}, "role_confirmation": dict.fromkeys(("entities", "features", "prediction_unit", "target"), True),
        "graph_readiness": {"structure_column": "shape", "independent_unit_column": "mol_id", "node_features": ["degree"], "edge_features": ["stereo"], "evaluation_scenarios": ["unseen"], "minimum_independent_units_per_class": 1},
    })
    result = evaluation.evaluate_case(spark, case, f"{base}/out", structures={"canonical": lambda c: F.upper(F.trim(c))})
    contract = result["audits"]["graph_contract"]
    assert (contract["status"], contract["n_graphs"], contract["shared_graphs"]) == ("VALID_CONTRACT", 24, 0)
    got = evaluation.assess_graphs(spark, f"{base}/out")
    assert got["facts"]["overlap_status"] == "ASSESSED" and got["facts"]["worst"] == 0 and got["facts"]["enough"]
    assert got["status"] in ("FEASIBLE_BUT_LOW_PRIORITY", "NOT_JUSTIFIED_BY_CURRENT_EVIDENCE") and got["input_provenance"]["development"]["dataset_fingerprint"]
