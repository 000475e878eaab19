"""Small tables with a known answer, the same for the same seed, made by Spark's own random columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import REQUIRED_ROLES, Section, parse_case

# Kinds, and (groups, rows of a group) of each.
SHAPES = {"stable": (24, 20), "leakage": (72, 7), "no_signal": (30, 12), "ranking_instability": (30, 24)}


def _normal(seed: int, name: str, key: Column) -> Column:
    """A standard normal number that depends on seed, name and key alone (Box and Muller on two hashes), so that it is the same however rows are dealt."""
    uniform = lambda k: (F.pmod(F.xxhash64(F.lit(f"{seed}/{name}/{k}"), key), F.lit((1 << 31) - 1)) + 1) / float(1 << 31)
    return F.sqrt(-2 * F.ln(uniform(0))) * F.cos(2 * 3.141592653589793 * uniform(1))


def _label(prefix: str, width: int, n: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))


def synthetic(spark: SparkSession, kind: str, seed: int = 2026) -> DataFrame:
    """stable: y follows x1 and x2. leakage: y follows the entity alone. no_signal: nothing follows anything. ranking_instability: y follows x weakly."""
    groups, size = SHAPES[kind]
    row, group = F.col("id"), (F.col("id") / size).cast("long")
    x = lambda name, key=row: _normal(seed, f"{kind}.{name}", key)
    columns = {"sample_id": _label("S", 4, row)}
    if kind == "leakage":
        columns |= {"entity_id": _label("E", 3, group), "entity_token": _label("E", 3, group), "uninformative": x("noise"), "y": x("latent", group) + 0.03 * x("error")}
    elif kind == "no_signal":
        columns |= {"group_id": _label("G", 2, group), "x1": x("x1"), "x2": x("x2"), "y": x("y")}
    else:
        columns |= {"target_id": _label("T", 2, group), "candidate_id": _label("C", 4, row)}
        columns |= {"x1": x("x1"), "x2": x("x2"), "y": 2.2 * x("x1") - 1.4 * x("x2") + 0.25 * x("error")} if kind == "stable" else {"x": x("x"), "nuisance": x("nuisance"), "y": 0.55 * x("x") + x("error")}
    return spark.range(groups * size).select(*(c.alias(n) for n, c in columns.items()))


def synthetic_case(kind: str, path: str) -> Section:
    """The case of a synthetic table: a random scenario, and one that holds its groups out."""
    group, name, features = {"stable": ("target_id", "target", ["x1", "x2"]), "leakage": ("entity_id", "entity", ["entity_token", "uninformative"]), "no_signal": ("group_id", "group", ["x1", "x2"]), "ranking_instability": ("target_id", "target", ["x", "nuisance"])}[kind]
    ranked = kind in ("stable", "ranking_instability")
    unit = "candidate-target pair" if ranked else "measurement" if kind == "leakage" else "sample"
    return parse_case({
        "case_id": f"synthetic-{kind.replace('_', '-')}", "data": {"path": path}, "task": {"kind": "regression", "prediction_unit": unit, "target_column": "y"}, "entities": {name: {"id_column": group}}, "features": {"include": features},
        "decision": {"kind": "top_k_per_group", "group_entity": name, "k": [5, 10]} if ranked else {},
        "generalization_scenarios": [{"name": "random_pair", "strategy": "random_pair"} if ranked else {"name": "random_row", "strategy": "random"}, {"name": f"cold_{name}", "strategy": "group", "group_column": group}],
        "evaluation": {"seeds": [11, 23, 47], "primary_metric": "spearman", "bootstrap_unit": group}, "thresholds": {"stable_top_k": 0.85, "unstable_top_k": 0.75} if kind == "ranking_instability" else {},
        "role_confirmation": dict.fromkeys(REQUIRED_ROLES, True),
    })
