"""What the columns of a case are for. Decided on names alone; no data is read."""

from __future__ import annotations

from .contract import CaseError, Section

METADATA = ("replicate_id", "biological_replicate_id", "batch_id", "plate_id", "time_column", "treatment_column")
SPLIT_COLUMNS = ("group_column", "left_column", "right_column", "split_column")
UNASSIGNED = "context/unassigned"


def entity_ids(case: Section, columns=None) -> list[str]:
    """Id columns in the order of the entities, those among ``columns`` only if it is given."""
    return [e.id_column for e in case.entities.values() if columns is None or e.id_column in columns]


def ranking_group(case: Section) -> str | None:
    """The column within which candidates are ranked: the id of the entity that the decision names, or that name itself."""
    group = case.decision.group_entity
    return case.entities[group].id_column if group in case.entities else group or None


def ranking_candidate(case: Section, columns: list[str]) -> str | None:
    """The column that tells candidates apart: another entity's id, or candidate_id, sample_id, and at last the row's number."""
    group = ranking_group(case)
    if group is None or case.decision.kind != "top_k_per_group":
        return None
    known = [*(c for c in entity_ids(case) if c != group), "candidate_id", "sample_id"]
    return next((c for c in known if c in columns), "_row_id")


def curve_group(scenario: Section) -> str | None:
    """The column whose groups a learning curve adds, if the scenario holds groups out."""
    column = {"group": "group_column", "cold_left": "left_column", "cold_right": "right_column", "double_cold": "left_column"}.get(scenario.strategy)
    return scenario[column] if column else None


def uses(case: Section) -> list[tuple[str, str]]:
    """(column, role) for every mention of a column in the case that gives it a role, in a fixed order."""
    out = [(case.task.target_column, "target")]
    out += [(c, "feature") for c in case.features.include] + [(c, "post_outcome") for c in case.features.post_outcome]
    for name, entity in case.entities.items():
        out += [(entity.id_column, f"entity:{name}"), (entity.representation_column, f"representation:{name}")]
    out += [(case.metadata[m], f"metadata:{m}") for m in METADATA]
    out += [(s.split_column, f"split:{s.name}") for s in case.generalization_scenarios]
    out.append((case.evaluation.bootstrap_unit, "bootstrap_unit"))
    return [(c, r) for c, r in out if c]


def role_names(case: Section, columns: list[str]) -> dict[str, str]:
    """The roles of each column, joined by commas."""
    found: dict[str, list[str]] = {c: [] for c in columns}
    for column, role in uses(case):
        if column in found:
            found[column].append(role)
    return {c: ", ".join(r) or UNASSIGNED for c, r in found.items()}


def declared_columns(case: Section) -> set[str]:
    """Columns that must exist."""
    scenarios = (s[c] for s in case.generalization_scenarios for c in SPLIT_COLUMNS)
    return {c for c, _ in uses(case)} | set(case.data.fingerprint_columns) | {c for c in scenarios if c}


def require_columns(case: Section, columns: list[str]) -> None:
    absent = sorted(declared_columns(case).difference(columns))
    if absent:
        raise CaseError(f"missing declared columns: {absent}")


def modelled_columns(case: Section, columns: list[str]) -> list[str]:
    """The columns that models see: those included and not excluded; if none is included, all that have no other part in the case.

    An entity's representation column has no other part: it is encoded, not left out.
    """
    if case.features.include:
        return [c for c in case.features.include if c not in case.features.exclude]
    apart = {c for c, r in uses(case) if not r.startswith("representation:")}
    apart |= {*case.features.exclude, ranking_group(case)}
    apart |= {s[c] for s in case.generalization_scenarios for c in SPLIT_COLUMNS}
    return [c for c in columns if c not in apart]


def unit_text(case: Section) -> str:
    return case.task.prediction_unit.lower().replace("-", "_").replace(" ", "_")


def is_unit(case: Section, name: str) -> bool:
    """Whether the prediction unit is this entity."""
    return unit_text(case) in (name.lower(), case.entities[name].id_column.lower().removesuffix("_id"))


def pair_is_unit(case: Section) -> bool:
    """Whether the prediction unit is the pair of the case's two entities."""
    return len(case.entities) == 2 and (unit_text(case) == "pair" or unit_text(case).endswith("_pair"))


def metadata_gaps(case: Section) -> list[tuple[str, str]]:
    """(what is missing, what cannot be said without it) of metadata that the case does not declare."""
    m = case.metadata
    gaps = [
        (not m.batch_id, "batch_id", "whether batches stand behind the outcome cannot be told"),
        (not m.replicate_id and not m.biological_replicate_id, "replicate identifiers", "how well the measurement repeats can be told in part only"),
        (not m.time_column and any(s.strategy == "time" for s in case.generalization_scenarios), "time_column", "whether results carry to later times cannot be told"),
    ]
    return [(what, why) for gap, what, why in gaps if gap]
