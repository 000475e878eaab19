"""Case documents: what is accepted, what is refused, and what is derived from names alone."""

import json

import pytest

from probator import roles
from probator.contract import CaseError, as_document, case_fingerprint, changed, load_case, parse_case, save_case, unconfirmed_roles
from probator.functions.columns import markdown_cell, name_words, names_identifier

PLAIN = {"case_id": "c", "data": {"path": "t.parquet"}, "task": {"kind": "regression", "prediction_unit": "well", "target_column": "y"}, "generalization_scenarios": [{"name": "r", "strategy": "random"}]}
GRAPH = {
    "structure_column": "shape", "independent_unit_column": "mol_id", "node_features": ["degree"], "edge_features": ["stereo"], "evaluation_scenarios": ["g"], "minimum_independent_units_per_class": 2,
}
MOLECULES = {
    **PLAIN, "task": {"kind": "binary_classification", "prediction_unit": "mol", "target_column": "y"}, "entities": {"mol": {"id_column": "mol_id", "representation_column": "shape", "identity_conflict_policy": "exclude"}},
    "features": {"include": ["shape"], "smiles_column": "shape"}, "evaluation": {"bootstrap_unit": "mol_id"}, "generalization_scenarios": [{"name": "g", "strategy": "group", "group_column": "mol_id"}], "graph_readiness": GRAPH,
}


def test_defaults():
    case = parse_case(PLAIN)
    assert (case.evaluation.primary_metric, case.decision.k, case.thresholds.maximum_permutation_p_value, case.holdout.enabled) == ("spearman", [5, 10], 0.1, False)
    assert parse_case(as_document(case)) == case


@pytest.mark.parametrize(("change", "words"), [
    ({"extra": 1}, "unknown fields"), ({"data": {}}, "data.path is missing"), ({"schema_version": 2}, "schema_version"), ({"task": {**PLAIN["task"], "kind": "clustering"}}, "task.kind"),
    ({"generalization_scenarios": []}, "present and unique"), ({"generalization_scenarios": [{"name": "a", "strategy": "random"}, {"name": "a", "strategy": "time"}]}, "present and unique"),
    ({"generalization_scenarios": [{"name": "a", "strategy": "group"}]}, "group_column"), ({"generalization_scenarios": [{"name": "a", "strategy": "double_cold", "left_column": "l"}]}, "right_column"), ({"generalization_scenarios": [{"name": "a", "strategy": "supplied"}]}, "split_column"),
    ({"evaluation": {"seeds": []}}, "seeds"), ({"evaluation": {"seeds": [3, 3]}}, "unique"), ({"evaluation": {"permutation_draws": 0}}, "permutation_draws"), ({"evaluation": {"classification_threshold": 1.5}}, "classification_threshold"),
    ({"thresholds": {"maximum_permutation_p_value": 0}}, "maximum_permutation_p_value"), ({"thresholds": {"minimum_test_class_count": 3}}, "binary_classification"), ({"holdout": {"enabled": "yes"}}, "true or false"),
    ({"features": {"molecular_representations": ["morgan"]}}, "smiles_column"), ({"features": {"include": ["a"], "smiles_column": "s"}}, "among include"), ({"features": {"exclude": ["s"], "smiles_column": "s"}}, "among exclude"),
    ({"generalization_scenarios": [{"name": "a", "strategy": "random", "split_claim": {"kind": "same_entity_across_context", "entity_column": "e"}}]}, "context_column"),
    ({"generalization_scenarios": [{"name": "a", "strategy": "random", "split_claim": {"kind": "unseen_entity", "entity_column": "e", "context_column": "e"}}]}, "differ"),
])
def test_refused(change, words):
    with pytest.raises(CaseError, match=words):
        parse_case({**PLAIN, **change})


@pytest.mark.parametrize(("change", "words"), [
    ({"task": {**MOLECULES["task"], "kind": "regression"}}, "binary_classification"), ({"features": {}}, "smiles_column"), ({"entities": {}}, "id_column of an entity"), ({"evaluation": {"bootstrap_unit": "other"}}, "bootstrap_unit"),
    ({"generalization_scenarios": [{"name": "g", "strategy": "random"}]}, "diagnostics"), ({"graph_readiness": {**GRAPH, "evaluation_scenarios": ["z"]}}, "unknown scenarios"), ({"graph_readiness": {**GRAPH, "node_features": []}}, "present"),
    ({"entities": {"mol": {"id_column": "mol_id", "representation_column": "shape"}}}, "identity_conflict_policy"),
])
def test_refused_graphs(change, words):
    assert parse_case(MOLECULES).graph_readiness.scope == "2d"
    with pytest.raises(CaseError, match=words):
        parse_case({**MOLECULES, **change})


def test_fingerprints_ignore_absent_additions():
    case = parse_case(PLAIN)
    document = as_document(case)
    assert document["generalization_scenarios"][0]["split_claim"] is None
    assert case_fingerprint(case) == case_fingerprint(parse_case(json.loads(json.dumps(document)))) != case_fingerprint(changed(case, case_id="d"))
    claimed = changed(case, generalization_scenarios=[{"name": "r", "strategy": "random", "split_claim": {"kind": "unseen_entity", "entity_column": "e"}}])
    assert case_fingerprint(claimed) != case_fingerprint(case)


@pytest.mark.parametrize("suffix", ["yaml", "json"])
def test_files_and_relative_paths(tmp_path, suffix):
    path = str(tmp_path / "sub" / f"case.{suffix}")
    save_case(parse_case(PLAIN), path, "../data/t.parquet")
    assert load_case(path).data.path == str(tmp_path / "data" / "t.parquet")
    save_case(parse_case(PLAIN), path, "s3://bucket/t.parquet")
    assert load_case(path).data.path == "s3://bucket/t.parquet"


def test_roles_and_gaps():
    case = parse_case({**PLAIN, "entities": {"well": {"id_column": "well_id"}, "drug": {"id_column": "drug_id", "representation_column": "formula"}}, "decision": {"kind": "top_k_per_group", "group_entity": "drug"}, "role_confirmation": {"target": True, "batch": True}})
    assert unconfirmed_roles(case) == ["entities", "features", "prediction_unit"]
    assert roles.modelled_columns(case, ["well_id", "drug_id", "formula", "dose", "y"]) == ["formula", "dose"]
    assert (roles.ranking_group(case), roles.ranking_candidate(case, ["well_id"]), roles.ranking_candidate(case, ["sample_id"])) == ("drug_id", "well_id", "sample_id")
    assert roles.is_unit(case, "well") and not roles.is_unit(case, "drug") and not roles.pair_is_unit(case)
    assert roles.pair_is_unit(changed(case, task={**PLAIN["task"], "prediction_unit": "Well drug pair"}))
    with pytest.raises(CaseError, match="formula"):
        roles.require_columns(case, ["well_id", "drug_id", "y"])
    timed = changed(case, generalization_scenarios=[{"name": "t", "strategy": "time", "group_column": "d"}])
    assert [g for g, _ in roles.metadata_gaps(timed)] == ["batch_id", "replicate identifiers", "time_column"]


def test_words_of_names():
    assert name_words("HTTPServerId2_x") == ["http", "server", "id2", "x"]
    assert [n for n in ("Fluidity", "userID", "ID", "tokenCount", "bid", "grid-id", "identifiers", "IDTag") if names_identifier(n)] == ["userID", "ID", "tokenCount", "grid-id", "IDTag"]
    assert markdown_cell("a|b\nc") == "a\\|b c"


def test_exported_names_exist():
    import probator

    assert all(callable(getattr(probator, n)) for n in probator.__all__)
    with pytest.raises(AttributeError):
        probator.nothing  # noqa: B018


def test_the_only_scenario_is_chosen():
    from probator.operators.overlap import chosen_scenario

    case = parse_case(PLAIN)
    two = changed(case, generalization_scenarios=[{"name": n, "strategy": "random"} for n in "ab"])
    assert chosen_scenario(case).name == "r" and chosen_scenario(two) is None and chosen_scenario(two, two.generalization_scenarios[1]).name == "b"
