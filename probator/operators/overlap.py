"""What train and test of a partition share, and whether that fits what the case claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import Section
from ..functions.columns import missing, named
from ..roles import entity_ids
from . import splits

# The statuses of a claim.
COMPATIBLE, INCOMPATIBLE, UNKNOWN = "COMPATIBLE", "INCOMPATIBLE", "NOT_ASSESSABLE"


def sides(df: DataFrame, row: str, split: DataFrame) -> DataFrame:
    """The rows of both sides, with their part."""
    return df.join(split.where("part <> 'excluded'").select(F.col("row_id").alias("_split_row"), F.col("part").alias("_part")), named(row) == F.col("_split_row")).drop("_split_row")


def shared_keys(parted: DataFrame, columns: list[str], *, complete: bool = True) -> DataFrame:
    """One row: n_train, n_test (distinct keys), shared, test_fraction. A key is one value or several; with ``complete`` rows that miss one of them are left out, else nulls are equal.

    One grouping by key tells both sides; hot keys are two rows after pre-aggregation.
    """
    rows = parted.where(~reduce(lambda a, b: a | b, (missing(parted, c) for c in columns))) if complete else parted
    keys = rows.groupBy(*(named(c) for c in columns)).agg(F.max(F.col("_part") == "train").alias("a"), F.max(F.col("_part") == "test").alias("b"))
    n = keys.agg(F.count_if("a").alias("n_train"), F.count_if("b").alias("n_test"), F.count_if(F.col("a") & F.col("b")).alias("shared"))
    return n.select("n_train", "n_test", "shared", (F.col("shared") / F.greatest("n_test", F.lit(1))).alias("test_fraction"))


def overlap_audit(df: DataFrame, case: Section, row: str, split: DataFrame) -> DataFrame:
    """(kind, subject, n_train, n_test, shared, test_fraction): entities, the pair of the first two, and whole records (over the fingerprint columns, or all columns but the row's number)."""
    parted = sides(df, row, split)
    own = [c for c in df.columns if c != row]
    kinds = [("entity", name, [e.id_column]) for name, e in case.entities.items() if e.id_column in df.columns]
    pair = splits.pair_columns(case, df.columns)
    kinds += [("pair", ",".join(pair), pair)] if pair else []
    kinds.append(("record", "", [c for c in case.data.fingerprint_columns or own]))
    return reduce(DataFrame.unionByName, (shared_keys(parted, c, complete=k != "record").select(F.lit(k).alias("kind"), F.lit(s).alias("subject"), "n_train", "n_test", "shared", "test_fraction") for k, s, c in kinds))


def near_duplicates() -> dict[str, str]:
    """Similar records of both sides are not looked for: nobody said what similar means."""
    return {"status": UNKNOWN, "reason": "no similarity function is configured"}


def claim_facts(df: DataFrame, row: str, split: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_train, n_test, shared, missing_rows) of the claim's columns."""
    parted = sides(df, row, split)
    out = []
    for c in columns:
        absent = parted.agg(F.count_if(missing(parted, c)).alias("missing_rows"))
        out.append(shared_keys(parted, [c]).crossJoin(absent).select(F.lit(c).alias("column_name"), "n_train", "n_test", "shared", "missing_rows"))  # one row each
    return reduce(DataFrame.unionByName, out)


def claim_status(kind: str, entity: str, context: str | None) -> Column:
    """The claim's status over a grouping of its facts.

    unseen_entity: no id on both sides. same_entity_across_context: every test id is in train, and no context on both sides. Unknown if an id or a
    context is missing anywhere, or a side is empty.
    """
    of = lambda c, v: F.max(F.when(F.col("column_name") == c, F.col(v)))
    gaps = (F.sum("missing_rows") > 0) | (F.min(F.least("n_train", "n_test")) == 0)
    fits = of(entity, "shared") == 0 if kind == "unseen_entity" else (of(entity, "shared") == of(entity, "n_test")) & (of(context, "shared") == 0)
    return F.when(gaps, UNKNOWN).when(fits, COMPATIBLE).otherwise(INCOMPATIBLE)


def split_claim(df: DataFrame, row: str, split: DataFrame, claim: Section | None) -> DataFrame:
    """One row: status. No claim, or a column that the table has not, cannot be assessed."""
    columns = [c for c in (claim.entity_column, claim.context_column) if c] if claim else []
    if not columns or any(c not in df.columns for c in columns):
        return df.sparkSession.createDataFrame([(UNKNOWN,)], "status string")
    return claim_facts(df, row, split, columns).agg(claim_status(claim.kind, claim.entity_column, claim.context_column).alias("status"))


def chosen_scenario(case: Section, scenario: Section | None = None) -> Section | None:
    """The scenario that a claim is taken from: the one that is given, or the only one there is."""
    return scenario or (case.generalization_scenarios[0] if len(case.generalization_scenarios) == 1 else None)


def boundary_entities(case: Section, scenario: Section) -> list[str]:
    """Entities that the strategy holds out."""
    s = scenario
    held = {s.group_column if s.strategy in ("group", "scaffold", "supplied") else None, s.left_column if s.strategy in ("cold_left", "double_cold") else None, s.right_column if s.strategy in ("cold_right", "double_cold") else None} - {None}
    return [n for n, e in case.entities.items() if e.id_column in held or s.strategy == "scaffold" and e.representation_column in held]


def overlap_summary(audits: DataFrame, case: Section) -> DataFrame:
    """A row for each scenario: the most that any of its partitions shares.

    audits: scenario, seed, kind, subject, shared, test_fraction, claim_status. Out: exact, pairs, expected_pairs (pairs that a fulfilled claim of the same entities
    calls for), boundary and boundary_fraction (held-out entities), unit and unit_fraction (the independent unit), claim_compatible.
    """
    parts = []
    for s in case.generalization_scenarios:
        claim = s.split_claim
        pair = entity_ids(case)[:2]
        expects = F.lit(bool(claim and claim.kind == "same_entity_across_context" and claim.entity_column in pair)) & (F.col("claim_status") == COMPATIBLE)
        units = [n for n, e in case.entities.items() if e.id_column == case.evaluation.bootstrap_unit]

        def most(hit: Column, value: str = "shared"):
            return F.coalesce(F.max(F.when(hit, F.col(value))), F.lit(0))

        entity = lambda names: (F.col("kind") == "entity") & F.col("subject").isin(names or [""])
        held, pairs = entity(boundary_entities(case, s)), F.col("kind") == "pair"
        parts.append(audits.where(F.col("scenario") == s.name).agg(
            F.lit(s.name).alias("scenario"), most(F.col("kind") == "record").alias("exact"), most(pairs & ~F.coalesce(expects, F.lit(False))).alias("pairs"), most(pairs & expects).alias("expected_pairs"),
            most(held).alias("boundary"), most(held, "test_fraction").alias("boundary_fraction"), most(entity(units)).alias("unit"), most(entity(units), "test_fraction").alias("unit_fraction"),
            F.coalesce(F.min(F.when(F.col("kind") != "graph", F.coalesce(F.col("claim_status") == COMPATIBLE, F.lit(False)))), F.lit(False)).alias("claim_compatible"),
        ))
    return reduce(DataFrame.unionByName, parts)


def class_floor(counts: DataFrame) -> DataFrame:
    """A row for each scenario: n_classes and least_class, the least units of a class in any of its partitions, 0 for a class that one of them lacks. counts: scenario, seed, class, n_units."""
    seeds = counts.select("scenario", "seed").distinct()
    classes = counts.select("scenario", "class").distinct()
    dense = seeds.join(classes, "scenario").join(counts, ["scenario", "seed", "class"], "left").withColumn("n_units", F.coalesce("n_units", F.lit(0)))
    per = dense.groupBy("scenario", "class").agg(F.min("n_units").alias("n"))
    return per.groupBy("scenario").agg(F.count("*").alias("n_classes"), F.min("n").alias("least_class"))


def identity_conflict_summary(entities: list[dict], pair_conflicts: int | None) -> dict[str, int]:
    """Conflicting targets and representations to be held against every verdict. Where there is a pair structure its conflicts stand for those of entities."""
    targets = pair_conflicts if pair_conflicts is not None else sum(e.get("conflicting_targets") or 0 for e in entities)
    return {"targets": targets, "representations": sum(e.get("conflicting_representations") or 0 for e in entities)}
