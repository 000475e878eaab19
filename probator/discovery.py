"""What a table might be used for: guesses at the parts of its columns, templates of questions, and a provisional case.

Nothing here is confirmed; every guess says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contract import REQUIRED_ROLES, Section, parse_case
from .functions.columns import is_numeric, named

#: A column of text is a candidate target with so many distinct values.
FEWEST, MOST = 2, 20
#: Targets of a kind for which a question is asked.
QUESTIONS = 5


def column_evidence(df: DataFrame) -> list[dict]:
    """For each column: name, numeric, two_valued, few_valued, all_distinct, named_id. One aggregation counts everything."""
    counts = df.agg(F.count(F.lit(1)), *(F.count_distinct(named(c)) for c in df.columns)).first()
    rows = counts[0]
    return [
        {"column": c, "numeric": (n := is_numeric(df, c) and dict(df.dtypes)[c] != "boolean"), "two_valued": n and k == 2, "few_valued": not n and FEWEST <= k <= MOST, "all_distinct": not n and k == rows, "named_id": "id" in c.lower()}
        for c, k in zip(df.columns, counts[1:], strict=True)
    ]


def guesses(evidence: list[dict]) -> list[dict]:
    """(column, part, why, confirmed) of every part that the evidence allows: numeric_target, categorical_target, identifier.

    Two-valued numbers are categories. Columns of text come before them.
    """
    rules = [
        ("numeric_target", "it is numeric", lambda e: e["numeric"] and not e["two_valued"]),
        ("categorical_target", f"text with {FEWEST} to {MOST} values", lambda e: e["few_valued"]),
        ("categorical_target", "numeric with two values", lambda e: e["two_valued"]),
        ("identifier", "its name or that all values differ", lambda e: e["named_id"] or e["all_distinct"]),
    ]
    return [{"column": e["column"], "part": part, "why": why, "confirmed": False} for part, why, test in rules for e in evidence if test(e)]


def guess_table(df: DataFrame) -> DataFrame:
    """The guesses as rows."""
    rows = [(g["column"], g["part"], g["why"], g["confirmed"]) for g in guesses(column_evidence(df))]
    return df.sparkSession.createDataFrame(rows, "column_name string, part string, why string, confirmed boolean")


#: Family (a fixed value): question, unit, independent unit, split, metric, and what must be known first.
TEMPLATES = {
    "supervised_regression": ("Can columns that are known beforehand predict {target}?", "sample", "sample or entity id", "groups or time, once the use is declared", "mae, rmse; rank metrics for a ranking decision", "target; timing of features; independent unit; population"),
    "supervised_classification": ("Can columns that are known beforehand tell the classes of {target}?", "sample", "sample or entity id", "groups, once repeated entities are confirmed", "balanced accuracy, average precision", "meaning and definition of the classes; timing of features; independent unit"),
    "pairwise_prediction": ("Can the two sides of a pair predict {target}?", "pair of {first} and {second}", "both entities", "random pairs, cold left, cold right, double cold", "regression and rankings within groups", "roles of both entities; representations; meaning of a pair; axis of use"),
    "ranking_within_groups": ("Can candidates be ranked by {target} within a group?", "candidate in a group", "group", "whole groups", "overlap of the best, how often each is chosen, spread of ranks", "group; candidate; k; direction"),
    "treatment_control_association": ("Does an outcome go with treatment against control?", "biological replicate", "biological replicate", "groups within batches", "effect with an interval over independent units", "outcome; treatment; control; batch; replicate; how treatment was assigned"),
    "dose_or_time_response": ("Does an outcome go with dose or time?", "replicate at a dose or time", "biological replicate", "replicates or batches left out, later times", "trend with uncertainty over independent units", "outcome; units of dose; origin of time; replicates; batch; controls"),
    "longitudinal_prediction": ("Can earlier measurements predict a later outcome?", "entity at a time", "{first}", "later times, grouped by entity", "the task's metric at a horizon declared before", "entity; time; horizon; when features are known"),
    "batch_confounding_audit": ("Do batches go with labels, treatments or features?", "sample or entity", "biological sample", "batches left out", "how well batches predict labels; coverage", "batch; biological replicate"),
    "unsupervised_structure_exploration": ("Which structure comes back under resampling?", "sample", "sample or entity id", "resampling; no split for prediction", "stability of clusters or embeddings", "meaning of features; batch; replicate"),
}


def _card(family: str, target: str | None, ids: list[str]) -> dict:
    names = {"target": target, "first": ids[0] if ids else "an entity", "second": ids[1] if len(ids) > 1 else "another"}
    question, unit, independent, split, metric, needs = (t.format(**names) for t in TEMPLATES[family])
    return {"family": family, "question": question, "target": target, "unit": unit, "independent_unit": independent, "split": split, "metric": metric, "must_be_known": needs.split("; "), "status": "NOT_ASSESSABLE", "confirmed": False}


def claim_cards(columns: list[str], found: list[dict]) -> list[dict]:
    """Templates of questions that the guesses allow: at most five targets of a kind; pairs and rankings with two ids and a numeric target; and what the columns' names suggest."""
    part = lambda p: [g["column"] for g in found if g["part"] == p]
    targets, classes, ids = part("numeric_target"), part("categorical_target"), part("identifier")
    has = lambda *words: any(w in c.lower() for c in columns for w in words)
    asked = [("supervised_regression", t) for t in targets[:QUESTIONS]] + [("supervised_classification", t) for t in classes[:QUESTIONS]]
    if len(ids) >= 2 and targets:
        asked += [("pairwise_prediction", targets[0]), ("ranking_within_groups", targets[0])]
    suggested = [("treatment_control_association", has("treatment") and has("control")), ("dose_or_time_response", has("dose", "time", "date")), ("longitudinal_prediction", has("time", "date") and bool(ids)), ("batch_confounding_audit", True), ("unsupervised_structure_exploration", True)]
    return [_card(f, t, ids) for f, t in asked] + [_card(f, None, ids) for f, holds in suggested if holds]


def card_table(df: DataFrame) -> DataFrame:
    """The cards as rows, in order."""
    cards = claim_cards(df.columns, guesses(column_evidence(df)))
    return df.sparkSession.createDataFrame([(i, c["family"], c["target"], c["unit"], c["status"]) for i, c in enumerate(cards)], "position int, family string, target string, unit string, status string")


def provisional_case(df: DataFrame, case_id: str, path: str) -> Section:
    """A case from types alone: the last numeric column is the target (the last other column if there is none), the first column named like an id is the entity, nothing is confirmed."""
    numbers = [c for c in df.columns if is_numeric(df, c)]
    if not df.columns:
        raise ValueError("the table has no columns")
    target = (numbers or df.columns)[-1]
    ids = [c for c in df.columns if "id" in c.lower()]
    return parse_case({
        "case_id": case_id, "data": {"path": path}, "task": {"kind": "regression" if numbers else "binary_classification", "prediction_unit": "UNCONFIRMED", "target_column": target},
        "entities": {"sample": {"id_column": ids[0]}} if ids else {}, "features": {"include": [c for c in df.columns if c != target and c not in ids]},
        "generalization_scenarios": [{"name": "random_diagnostic", "strategy": "random"}], "role_confirmation": dict.fromkeys(REQUIRED_ROLES, False),
    })
