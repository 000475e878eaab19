"""The case: what a table is, what is to be predicted from it, and how far that should carry.

A case is a nested document. ``SHAPE`` lists its sections and their fields; whatever is not listed is an error. ``RULES`` holds what
fields must have in common. A case is read-only: change the document and read it again.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

# Names of strategies, policies, kinds and features that case documents use.
ADAPTERS = ("tabular", "davis", "bbb_martins", "b3db_external", "petbd_external", "parkinsons_telemonitoring")
KINDS = ("regression", "binary_classification", "ranking")
POLICIES = ("keep", "exclude", "aggregate")
STRATEGIES = ("random", "group", "random_pair", "cold_left", "cold_right", "double_cold", "time", "supplied", "scaffold")
CLAIMS = ("unseen_entity", "same_entity_across_context")
REPRESENTATIONS = ("character_hash", "morgan")
NODE_FEATURES = ("atomic_number", "degree", "formal_charge", "chirality", "aromaticity", "hybridization")
EDGE_FEATURES = ("bond_type", "conjugation", "ring_membership", "stereo")
DIAGNOSTIC = ("random", "random_pair")
REQUIRED_ROLES = ("entities", "features", "prediction_unit", "target")


class CaseError(ValueError):
    """A case document that does not hold together."""


class Section(Mapping):
    """A validated part of a case: its fields are attributes and keys."""

    def __init__(self, fields: dict[str, Any]):
        self.__dict__.update(fields)

    def __getitem__(self, name: str) -> Any:
        return self.__dict__[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.__dict__)

    def __len__(self) -> int:
        return len(self.__dict__)

    def __repr__(self) -> str:
        return f"Section({self.__dict__})"


@dataclass(frozen=True)
class Field:
    """How a value is read: ``read(value, where)`` returns it or raises CaseError. A field without a default must be given."""

    read: Callable[[Any, str], Any]
    default: Any = ...

    def value(self, raw: Mapping, name: str, where: str) -> Any:
        path = f"{where}.{name}" if where else name
        if name in raw:
            return self.read(raw[name], path)
        if self.default is ...:
            raise CaseError(f"{path} is missing")
        return self.read(self.default() if callable(self.default) else self.default, path)


def _fail(where: str, what: str) -> None:
    raise CaseError(f"{where}: {what}")


def text(value: Any, where: str) -> str:
    return value if isinstance(value, str) else _fail(where, "must be text")


def name(value: Any, where: str) -> str:
    return text(value, where) or _fail(where, "must not be empty")


def flag(value: Any, where: str) -> bool:
    return value if isinstance(value, bool) else _fail(where, "must be true or false")


def scalar(value: Any, where: str) -> Any:
    return value if isinstance(value, (str, int, float)) else _fail(where, "must be text or a number")


def number(low: float = -math.inf, high: float = math.inf, *, open_low: bool = False):
    def read(value, where):
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
            _fail(where, "must be a number")
        if value < low or value > high or (open_low and value == low):
            _fail(where, f"must lie in {'(' if open_low else '['}{low}, {high}]")
        return float(value)

    return read


def whole(low: int | None = None, high: int | None = None):
    def read(value, where):
        if isinstance(value, bool) or not isinstance(value, int):
            _fail(where, "must be a whole number")
        if low is not None and value < low or high is not None and value > high:
            _fail(where, f"must be at least {low}" if high is None else f"must lie in [{low}, {high}]")
        return value

    return read


def one_of(*allowed: Any):
    return lambda value, where: value if value in allowed and type(value) in map(type, allowed) else _fail(where, f"must be one of {', '.join(map(str, allowed))}")


def maybe(read):
    return lambda value, where: None if value is None else read(value, where)


def several(read, *, distinct: bool = False, some: bool = False):
    def all_of(value, where):
        if not isinstance(value, (list, tuple)):
            _fail(where, "must be a list")
        out = [read(v, f"{where}[{i}]") for i, v in enumerate(value)]
        if some and not out:
            _fail(where, "must be present and unique")
        if distinct and len(set(out)) < len(out):
            _fail(where, "must be unique")
        return out

    return all_of


def by_name(read):
    return lambda value, where: {text(k, where): read(v, f"{where}.{k}") for k, v in value.items()} if isinstance(value, Mapping) else _fail(where, "must be a mapping")


def section(shape: dict[str, Field], *rules: tuple[Callable[[Section], Any], str]):
    """rules: (what must not hold of the section, what is then said)."""

    def read(value, where):
        if not isinstance(value, Mapping):
            _fail(where or "case", "must be a mapping")
        unknown = sorted(set(value) - set(shape), key=str)
        if unknown:
            _fail(where or "case", f"unknown fields {unknown}")
        out = Section({n: f.value(value, n, where) for n, f in shape.items()})
        for broken, message in rules:
            if broken(out):
                _fail(where or "case", message)
        return out

    return read


_NAMES = Field(several(text), list)
_OPTIONAL = Field(maybe(text), None)

CLAIM = section(
    {"kind": Field(one_of(*CLAIMS)), "entity_column": Field(name), "context_column": Field(maybe(name), None)},
    (lambda s: s.kind == "same_entity_across_context" and not s.context_column, "same_entity_across_context requires context_column"),
    (lambda s: s.context_column == s.entity_column, "context_column must differ from entity_column"),
)


def _needs(column: str, *strategies: str):
    return (lambda s: s.strategy in strategies and not s[column], f"{' and '.join(strategies)} requires {column}")


SCENARIO = section(
    {"name": Field(text), "strategy": Field(one_of(*STRATEGIES)), "group_column": _OPTIONAL, "left_column": _OPTIONAL, "right_column": _OPTIONAL, "split_column": _OPTIONAL, "split_claim": Field(maybe(CLAIM), None)},
    _needs("group_column", "group"), _needs("left_column", "cold_left", "double_cold"), _needs("right_column", "cold_right", "double_cold"), _needs("split_column", "supplied"),
)

GRAPH = section({
    "construction": Field(one_of("rdkit_smiles_2d"), "rdkit_smiles_2d"), "structure_column": Field(text), "graph_identity": Field(one_of("canonical_isomeric_smiles"), "canonical_isomeric_smiles"), "independent_unit_column": Field(text),
    "scope": Field(one_of("2d"), "2d"), "node_features": Field(several(one_of(*NODE_FEATURES), distinct=True, some=True)), "edge_features": Field(several(one_of(*EDGE_FEATURES), distinct=True, some=True)),
    "invalid_structure_policy": Field(one_of("error"), "error"), "evaluation_scenarios": Field(several(text, distinct=True, some=True)), "minimum_independent_units_per_class": Field(whole(1)),
})

FEATURES = section(
    {"include": _NAMES, "exclude": _NAMES, "post_outcome": _NAMES, "smiles_column": _OPTIONAL, "molecular_representations": Field(several(one_of(*REPRESENTATIONS), distinct=True), list)},
    (lambda s: s.molecular_representations and not s.smiles_column, "molecular_representations requires smiles_column"),
    (lambda s: s.smiles_column and s.include and s.smiles_column not in s.include, "smiles_column must be among include"),
    (lambda s: s.smiles_column in s.exclude, "smiles_column must not be among exclude"),
)

SHAPE = {
    "schema_version": Field(one_of(1), 1),
    "case_id": Field(text),
    "data": Field(section({"adapter": Field(one_of(*ADAPTERS), "tabular"), "path": Field(text), "fingerprint_columns": _NAMES})),
    "task": Field(section({"kind": Field(one_of(*KINDS)), "prediction_unit": Field(text), "target_column": Field(text), "higher_is_better": Field(flag, True)})),
    "entities": Field(by_name(section({"id_column": Field(text), "representation_column": _OPTIONAL, "identity_conflict_policy": Field(maybe(one_of(*POLICIES)), None)})), dict),
    "features": Field(FEATURES, dict),
    "metadata": Field(section({**dict.fromkeys(("replicate_id", "biological_replicate_id", "batch_id", "plate_id", "time_column", "treatment_column"), _OPTIONAL), "control_value": Field(maybe(scalar), None)}), dict),
    "decision": Field(section({"kind": Field(one_of("top_k_per_group", "threshold", "none"), "none"), "group_entity": _OPTIONAL, "k": Field(several(whole()), lambda: [5, 10])}), dict),
    "generalization_scenarios": Field(several(SCENARIO)),
    "evaluation": Field(section({
        "seeds": Field(several(whole(), distinct=True, some=True), lambda: [11, 23, 47, 83, 131]), "primary_metric": Field(text, "spearman"), "secondary_metrics": Field(several(text), lambda: ["mae", "rmse"]), "bootstrap_unit": _OPTIONAL,
        "classification_threshold": Field(number(0, 1), 0.5), "permutation_draws": Field(whole(1, 100), 9), "model_allowlist": Field(several(text, distinct=True), list),
    }), dict),
    "holdout": Field(section({"enabled": Field(flag, False), "maximum_accesses": Field(whole(1), 1)}), dict),
    "thresholds": Field(section({
        "supported_metric": Field(number(), 0.5), "limited_metric": Field(number(), 0.2), "stable_top_k": Field(number(), 0.65), "unstable_top_k": Field(number(), 0.5), "maximum_dispersion": Field(number(), 0.15),
        "minimum_permutation_delta": Field(number(), 0.05), "maximum_permutation_p_value": Field(number(0, 1, open_low=True), 0.1), "minimum_test_class_count": Field(maybe(whole(1)), None),
    }), dict),
    "graph_readiness": Field(maybe(GRAPH), None),
    "role_confirmation": Field(by_name(flag), dict),
}


def _unit(case: Section) -> Section | None:
    """The entity whose ids are the graph's independent units."""
    return next((e for e in case.entities.values() if e.id_column == case.graph_readiness.independent_unit_column), None)


def _strategy(case: Section, scenario: str) -> str | None:
    return next((s.strategy for s in case.generalization_scenarios if s.name == scenario), None)


def _graph(broken):
    return lambda c: c.graph_readiness is not None and broken(c, c.graph_readiness)


RULES = (
    (lambda c: not c.generalization_scenarios or len({s.name for s in c.generalization_scenarios}) < len(c.generalization_scenarios), "generalization_scenarios: names must be present and unique"),
    (lambda c: c.thresholds.minimum_test_class_count and c.task.kind != "binary_classification", "thresholds.minimum_test_class_count requires binary_classification"),
    (lambda c: c.thresholds.minimum_test_class_count and not c.evaluation.bootstrap_unit, "thresholds.minimum_test_class_count requires evaluation.bootstrap_unit"),
    (_graph(lambda c, g: c.task.kind != "binary_classification"), "graph_readiness requires binary_classification"),
    (_graph(lambda c, g: g.structure_column != c.features.smiles_column), "graph_readiness.structure_column must be features.smiles_column"),
    (_graph(lambda c, g: _unit(c) is None), "graph_readiness.independent_unit_column must be the id_column of an entity"),
    (_graph(lambda c, g: _unit(c).representation_column != g.structure_column), "graph_readiness.structure_column must be that entity's representation_column"),
    (_graph(lambda c, g: _unit(c).identity_conflict_policy is None), "graph_readiness requires an identity_conflict_policy"),
    (_graph(lambda c, g: c.evaluation.bootstrap_unit != g.independent_unit_column), "graph_readiness.independent_unit_column must be evaluation.bootstrap_unit"),
    (_graph(lambda c, g: any(_strategy(c, s) is None for s in g.evaluation_scenarios)), "graph_readiness.evaluation_scenarios names unknown scenarios"),
    (_graph(lambda c, g: any(_strategy(c, s) in DIAGNOSTIC for s in g.evaluation_scenarios)), "graph_readiness.evaluation_scenarios must not be random diagnostics"),
)

_CASE = section(SHAPE, *RULES)


def parse_case(document: Mapping) -> Section:
    """The case in a document, or CaseError."""
    return _CASE(document, "")


def as_document(case: Any) -> Any:
    """Sections as mappings, for JSON and YAML."""
    if isinstance(case, Mapping):
        return {k: as_document(v) for k, v in case.items()}
    return [as_document(v) for v in case] if isinstance(case, list) else case


def changed(case: Section, **sections: Any) -> Section:
    """The case with some of its top fields replaced, read again."""
    return parse_case(as_document(case) | {k: as_document(v) for k, v in sections.items()})


def case_fingerprint(case: Section) -> str:
    """SHA-256 of the case. An optional part that later versions added does not count while it is absent, so that older fingerprints hold."""
    document = as_document(case)
    document["generalization_scenarios"] = [{k: v for k, v in s.items() if k != "split_claim" or v is not None} for s in document["generalization_scenarios"]]
    if document["graph_readiness"] is None:
        del document["graph_readiness"]
    return hashlib.sha256(json.dumps(document, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def unconfirmed_roles(case: Section) -> list[str]:
    """Required roles, and those the case mentions, that nobody confirmed."""
    return sorted(r for r in {*REQUIRED_ROLES, *case.role_confirmation} if not case.role_confirmation.get(r))


def _yaml():
    try:
        import yaml
    except ImportError:  # JSON is a subset of YAML: documents are then written and read as such
        return None
    return yaml


def read_document(path: str) -> Any:
    with open(path, encoding="utf-8") as file:
        content = file.read()
    yaml = _yaml()
    return json.loads(content) if yaml is None or path.endswith(".json") else yaml.safe_load(content)


def write_document(document: Any, path: str) -> None:
    yaml = _yaml()
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as file:
        file.write(json.dumps(document, indent=2) if yaml is None or path.endswith(".json") else yaml.safe_dump(document, sort_keys=False))


def load_case(path: str) -> Section:
    """The case of a file. A relative data path starts from the file's folder; one with a scheme (``s3://`` and the like) is taken as it is."""
    case = parse_case(read_document(path))
    if "://" in case.data.path or os.path.isabs(case.data.path):
        return case
    return changed(case, data={**case.data, "path": os.path.normpath(os.path.join(os.path.dirname(os.path.abspath(path)), case.data.path))})


def save_case(case: Section, path: str, data_path: str | None = None) -> None:
    document = as_document(case)
    if data_path is not None:
        document["data"]["path"] = data_path
    write_document(document, path)
