"""The names that a caller needs, loaded when they are first used."""

from __future__ import annotations

import importlib

_WHERE = {
    "contract": ("CaseError", "case_fingerprint", "changed", "load_case", "parse_case", "save_case", "unconfirmed_roles"),
    "evaluation": ("assess_graphs", "evaluate_case", "profile_case", "status_line"),
    "operators.audits": ("apply_policies",),
    "operators.readiness": ("audit_table", "declaration_findings", "findings", "readiness", "require_ready"),
    "operators.overlap": ("overlap_audit", "split_claim"),
    "operators.splits": ("create_split",),
    "operators.graphs": ("contract_audit",),
    "sources.io": ("dataset_fingerprint", "read_table"),
    "discovery": ("claim_cards", "guesses", "provisional_case"),
    "autoprobe": ("prepare", "trial"),
}
_MODULE = {name: module for module, names in _WHERE.items() for name in names}
__all__ = sorted(_MODULE)


def __getattr__(name: str):
    if name not in _MODULE:
        raise AttributeError(name)
    return getattr(importlib.import_module(f"{__name__}.{_MODULE[name]}"), name)
