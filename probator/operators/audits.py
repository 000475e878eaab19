"""Facts about a table: repeats, entities, pairs, labels, replicates, coverage, identity conflicts.

Every function returns a DataFrame and reads the table once for each grouping it needs; groupings are pre-aggregated before they are
shuffled. Nothing is collected but where a policy has to refuse.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contract import CaseError, Section
from ..functions.columns import finite, is_numeric, missing, named, numeric, present
from ..functions.ordered import quantiles
from ..roles import entity_ids, is_unit, metadata_gaps, modelled_columns

CONTINUOUS = {"q05": 0.05, "median": 0.5, "q95": 0.95}


def _has(df: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (~missing(df, c) for c in columns))


def _spread(sizes: DataFrame, column: str, name: str = "") -> DataFrame:
    """One row: least, median and most of a column of whole numbers, from how often each number occurs."""
    n = sizes.groupBy(F.col(column).cast("double").alias("value")).agg(F.count("*").alias("n"))
    ends = n.agg(F.min("value").cast("long").alias(name + "least"), F.max("value").cast("long").alias(name + "most"))
    return ends.crossJoin(F.broadcast(quantiles(n, {name + "median": 0.5})))  # one row each


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(n_rows, n_duplicates): rows after the first of their values. Nulls are equal."""
    kinds = df.groupBy(*(named(c) for c in columns or df.columns)).agg(F.count("*").alias("_n"))
    return kinds.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"))


def group_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: n_groups, repeated_rows (of groups with several), least, median, most rows of a group. A null key is a key."""
    sizes = df.groupBy(*(named(k) for k in keys)).agg(F.count("*").alias("_n"))
    return _groups(sizes)


def _groups(sizes: DataFrame) -> DataFrame:
    totals = sizes.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("repeated_rows"))
    return totals.crossJoin(_spread(sizes, "_n"))  # one row each


def entity_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each id column: n_ids, n_missing, least, median, most rows of an id, repeated_rows, status (NOT_ASSESSABLE without any id)."""
    parts = []
    for c in columns:
        sizes = df.groupBy(present(df, c).alias("_id")).agg(F.count("*").alias("_n"))
        absent = sizes.where("_id is null").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_missing"))
        one = _groups(sizes.where("_id is not null")).crossJoin(absent)  # one row each
        parts.append(one.select(F.lit(c).alias("entity"), F.col("n_groups").alias("n_ids"), "n_missing", "least", "median", "most", "repeated_rows", F.when(F.col("n_groups") == 0, "NOT_ASSESSABLE").otherwise("ASSESSED").alias("status")))
    return reduce(DataFrame.unionByName, parts)


def conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: n_ids, n_conflicts (ids with several present values), affected_rows (of these ids)."""
    kinds = _kinds(df, key, value)
    return kinds.agg(F.count("*").alias("n_ids"), F.count_if(F.col("_kinds") > 1).alias("n_conflicts"), F.coalesce(F.sum(F.when(F.col("_kinds") > 1, F.col("_n"))), F.lit(0)).alias("affected_rows"))


def _kinds(df: DataFrame, key: str, value: str) -> DataFrame:
    """(_id, _kinds, _n): present values and rows of each id. Two levels, so that an id with a third of all rows is a few rows before it is shuffled."""
    cells = df.where(~missing(df, key)).groupBy(named(key).alias("_id"), present(df, value).alias("_v")).agg(F.count("*").alias("_n"))
    return cells.groupBy("_id").agg(F.count("_v").alias("_kinds"), F.sum("_n").alias("_n"))


def pair_structure(df: DataFrame, left: str, right: str, target: str) -> DataFrame:
    """One row about pairs of two ids, of the rows that have both.

    n_pairs, repeated_rows, conflicting_pairs (several present labels), density (of all possible pairs), and for either side the least, median and most partners of an id.
    """
    cells = df.where(_has(df, [left, right])).groupBy(named(left).alias("_l"), named(right).alias("_r"), present(df, target).alias("_v")).agg(F.count("*").alias("_n"))
    pairs = cells.groupBy("_l", "_r").agg(F.count("_v").alias("_kinds"), F.sum("_n").alias("_n"))
    out = pairs.agg(F.count("*").alias("n_pairs"), F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("repeated_rows"), F.count_if(F.col("_kinds") > 1).alias("conflicting_pairs"))
    for side, c in (("left", "_l"), ("right", "_r")):
        degrees = pairs.groupBy(c).agg(F.count("*").alias("_d"))
        ends = degrees.agg(F.count("*").alias(f"_n_{side}")).crossJoin(_spread(degrees, "_d", f"{side}_"))  # one row each
        out = out.crossJoin(ends)
    density = F.try_divide(F.col("n_pairs"), F.col("_n_left").cast("double") * F.col("_n_right"))
    return out.select("n_pairs", "repeated_rows", "conflicting_pairs", density.alias("density"), *(f"{s}_{x}" for s in ("left", "right") for x in ("least", "median", "most"))).withColumnsRenamed({f"{s}_{a}": f"{s}_{b}" for s in ("left", "right") for a, b in (("least", "min"), ("most", "max"))})


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """(class, n) of the present values of the target. Ordered by falling count, equal ones by class."""
    return df.where(~missing(df, target)).groupBy(named(target).cast("string").alias("class")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class")


def class_support(df: DataFrame, target: str, unit: str | None = None) -> DataFrame:
    """(class, n_units): distinct units, or rows if no unit is declared, with each present class; ordered by class. A unit may support several classes; rows without a unit are one."""
    rows = df.where(~missing(df, target))
    if unit:
        rows = rows.select(named(unit).alias("_unit"), named(target).alias("_class")).distinct().select("_class")
    else:
        rows = rows.select(named(target).alias("_class"))
    return rows.groupBy(F.col("_class").cast("string").alias("class")).agg(F.count("*").alias("n_units")).orderBy("class")


def binary_encoding(df: DataFrame, target: str) -> DataFrame:
    """One row: n_missing, n_classes, invalid_support (not two classes), invalid_encoding (not numeric, or another number than 0 and 1)."""
    value = present(df, target)
    odd = F.count_if(~value.isin(0, 1)) > 0 if is_numeric(df, target) and dict(df.dtypes)[target] != "boolean" else F.lit(dict(df.dtypes)[target] != "boolean")
    kinds = df.agg(F.count_if(value.isNull()).alias("n_missing"), F.count_distinct(value).alias("n_classes"), odd.alias("invalid_encoding"))
    return kinds.select("n_missing", "n_classes", (F.col("n_classes") != 2).alias("invalid_support"), "invalid_encoding")


def target_summary(df: DataFrame, target: str) -> DataFrame:
    """One row about the finite values of a continuous target: n, mean, sd, least, q05, median, q95, most, n_distinct, and is_numeric, n_missing, n_infinite, invalid_support (fewer than two values)."""
    x = numeric(df, target) if is_numeric(df, target) else F.lit(None).cast("double")
    counts = df.select(x.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    infinite = F.count_if(F.abs(named(target).cast("double")) == float("inf")) if is_numeric(df, target) else F.lit(0).cast("long")
    facts = df.select("*", x.alias("_x")).agg(F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("sd"), F.min("_x").alias("least"), F.max("_x").alias("most"), F.count_if(missing(df, target)).alias("n_missing"), infinite.alias("n_infinite"))
    distinct = counts.agg(F.count("*").alias("n_distinct"))
    out = facts.crossJoin(distinct).crossJoin(F.broadcast(quantiles(counts, CONTINUOUS)))  # one row each
    return out.select("n", "mean", "sd", "least", "q05", "median", "q95", "most", "n_distinct", F.lit(is_numeric(df, target)).alias("is_numeric"), "n_missing", "n_infinite", (F.col("n_distinct") < 2).alias("invalid_support"))


def replicate_columns(case: Section, columns: list[str]) -> list[str]:
    return [c for c in (case.metadata.replicate_id, case.metadata.biological_replicate_id) if c and c in columns]


def replicates(df: DataFrame, keys: list[str], target: str, binary: bool = False) -> DataFrame:
    """One row about groups of rows that measure one thing again.

    n_groups, repeated_groups, missing_rows (without all keys), median_sd (within groups of several rows), sd_of_means (between groups), conflicting_rate (of
    repeated groups, those with several present values), status. Spreads are null for text. Not assessable without repeats; with a
    binary target, since repeated labels say nothing of how well a quantity is measured.
    """
    x = numeric(df, target) if is_numeric(df, target) else F.lit(None).cast("double")
    rows = df.select(*(present(df, k).alias(f"_k{i}") for i, k in enumerate(keys)), present(df, target).alias("_v"), x.alias("_x"))
    known = reduce(lambda a, b: a & b, (F.col(f"_k{i}").isNotNull() for i in range(len(keys))))
    cells = rows.where(known).groupBy(*(f"_k{i}" for i in range(len(keys)))).agg(F.count("*").alias("_n"), F.count_distinct("_v").alias("_kinds"), F.stddev_samp("_x").alias("_sd"), F.avg("_x").alias("_mean"))
    facts = cells.agg(
        F.count("*").alias("n_groups"), F.count_if(F.col("_n") > 1).alias("repeated_groups"), F.stddev_samp("_mean").alias("sd_of_means"),
        F.avg(F.when(F.col("_n") > 1, (F.col("_kinds") > 1).cast("double"))).alias("conflicting_rate"),
    )
    within = cells.where("_sd is not null").groupBy(F.col("_sd").alias("value")).agg(F.count("*").alias("n"))
    out = facts.crossJoin(F.broadcast(quantiles(within, {"median_sd": 0.5}))).crossJoin(rows.agg(F.count_if(~known).alias("missing_rows")))  # one row each
    assessed = F.lit(not binary) & (F.col("repeated_groups") > 0)
    spread = lambda c: F.when(assessed, F.col(c)).alias(c)
    return out.select("n_groups", "repeated_groups", "missing_rows", spread("median_sd"), spread("sd_of_means"), "conflicting_rate", F.when(assessed, "ASSESSED").otherwise("NOT_ASSESSABLE").alias("status"))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_unique, n_missing) of each column, by name."""
    names = sorted(set(columns))
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), present(df, c).cast("string").alias("v")) for c in names))).alias("cell")
    kinds = df.select(cells).groupBy("cell.column_name", "cell.v").agg(F.count("*").alias("n"))
    found = kinds.groupBy("column_name").agg(F.count("v").alias("n_unique"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"))
    listed = df.sparkSession.createDataFrame([(c,) for c in names], "column_name string")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return listed.join(found, "column_name", "left").select("column_name", zero("n_unique"), zero("n_missing")).orderBy("column_name")


def coverage_columns(case: Section, columns: list[str]) -> list[str]:
    m = case.metadata
    return sorted({c for c in (*entity_ids(case), m.batch_id, m.plate_id, m.time_column, m.treatment_column) if c and c in columns})


def identifier_leakage(df: DataFrame, features: list[str], suspects: set[str], share: float = 0.05) -> DataFrame:
    """(feature, n_unique, suspicious) of the features that are suspects (ids, or named like one): whether distinct values are more than a share of the rows."""
    listed = [f for f in features if f in suspects]
    if not listed:
        return df.sparkSession.createDataFrame([], "feature string, n_unique long, suspicious boolean")
    rows = df.agg(F.count("*").alias("_rows"))
    return coverage(df, listed).crossJoin(rows).select(F.col("column_name").alias("feature"), "n_unique", (F.col("n_unique") > share * F.col("_rows")).alias("suspicious"))  # one row


def missing_metadata(df: DataFrame, case: Section) -> DataFrame:
    """(missing, reason) of the metadata that the case does not declare."""
    return df.sparkSession.createDataFrame(metadata_gaps(case), "missing string, reason string")


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in the order; rows with no key go."""
    rows = df.where(~missing(df, key))
    best = rows.groupBy(named(key).alias("_id")).agg(F.min_by(F.struct(*(named(c) for c in df.columns)), named(order)).alias("_row"))
    return best.select("_row.*")


def distinct_text(column: str) -> Column:
    """The distinct present values as trimmed text, in order, joined by |. Whole numbers have no point."""
    c = named(column)
    text = F.trim(F.coalesce(F.when(c.try_cast("double") == F.floor(c.try_cast("double")), c.try_cast("double").cast("decimal(38,0)").cast("string")), c.cast("string")))
    return F.array_join(F.array_sort(F.collect_set(F.when(F.length(text) > 0, text))), "|")


def measurements_by_key(df: DataFrame, key: str, order: list[str], value: str, first: list[str], listed: list[str], cut: float) -> DataFrame:
    """A row for each key: the first value in the order of ``first``, mean, least and most of ``value``, how many, the distinct texts of ``listed``, and whether the mean reaches the cut."""
    place = F.struct(*(named(c) for c in order))
    out = df.groupBy(named(key).alias("key")).agg(
        *(F.min_by(named(c), place).alias(c) for c in first), F.avg(named(value)).alias("mean"), F.min(named(value)).alias("least"), F.max(named(value)).alias("most"), F.count("*").alias("n"), *(distinct_text(c).alias(f"all_{c}") for c in listed))
    return out.withColumn("label", (F.col("mean") >= cut).cast("int"))


# --- identity conflicts -----------------------------------------------------------------------------------------


def conflicting_ids(df: DataFrame, case: Section, name: str) -> DataFrame:
    """(_id, of_target, of_representation) of an entity's conflicting ids: several targets (only if the entity is the prediction unit), or several representations."""
    entity = case.entities[name]
    value = {"of_target": case.task.target_column if is_unit(case, name) else None, "of_representation": entity.representation_column}
    value = {k: v for k, v in value.items() if v in df.columns}
    if not value:
        return df.select(named(entity.id_column).alias("_id"), F.lit(False).alias("of_target"), F.lit(False).alias("of_representation")).limit(0)
    parts = [_kinds(df, entity.id_column, v).where("_kinds > 1").select("_id", *(F.lit(k == kind).alias(k) for k in ("of_target", "of_representation"))) for kind, v in value.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("_id").agg(F.max("of_target").alias("of_target"), F.max("of_representation").alias("of_representation"))


def excluded(df: DataFrame, key: str, ids: DataFrame, within: Column) -> DataFrame:
    """The rows without those that lie within the scope and have one of the ids."""
    hit = ids.select("_id", F.lit(True).alias("_hit"))
    return df.withColumn("_in", within).join(hit, named(key) == F.col("_id"), "left").where(~(F.coalesce("_hit", F.lit(False)) & F.col("_in"))).select(*(named(c) for c in df.columns))


def aggregated(df: DataFrame, key: str, target: str, ids: DataFrame, within: Column, order: str, binary: bool) -> DataFrame:
    """One row for each of the ids, of its rows within the scope: the first, with the mean target, or with the commonest of a binary one. Other rows stay as they are.

    Two equally common classes end the query.
    """
    marked = df.withColumn("_in", within).join(ids.select("_id", F.lit(True).alias("_hit")), named(key) == F.col("_id"), "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)) & F.col("_in")).drop("_in", "_id")
    rows = marked.where("_hit")
    first = first_rows(rows, key, order)
    if binary:
        votes = rows.where(~missing(df, target)).groupBy(named(key).alias("_id"), named(target).alias("_v")).agg(F.count("*").alias("_n"))
        best = votes.groupBy("_id").agg(F.max_by("_v", "_n").alias("_t"), F.sort_array(F.collect_list("_n"), False).alias("_ns"))
        best = best.select("_id", F.when((F.size("_ns") > 1) & (F.try_element_at("_ns", F.lit(1)) == F.try_element_at("_ns", F.lit(2))), F.raise_error(F.concat(F.lit("tied labels of "), F.col("_id").cast("string")))).otherwise(F.col("_t")).alias("_t"))
    else:
        best = rows.groupBy(named(key).alias("_id")).agg(F.avg(finite(named(target))).alias("_t"))
    kind = df.schema[target].dataType if binary else "double"
    changed = first.join(best, named(key) == F.col("_id"))
    pick = lambda t: [(t if c == target else named(c)).cast(kind if c == target else df.schema[c].dataType).alias(c) for c in df.columns]
    return marked.where(~F.col("_hit")).select(*pick(named(target))).unionByName(changed.select(*pick(F.col("_t"))))


def apply_policies(df: DataFrame, case: Section, row: str, scope: Column | None = None) -> tuple[DataFrame, dict]:
    """(the table after each entity's identity-conflict policy, what was found and done).

    Conflicts are looked for in the table as it came, within the scope; policies then act one after the other. An entity with conflicts and no
    policy is an error, and so is an aggregation of several representations or of features that vary. ``row`` orders the rows.
    """
    within = F.lit(True) if scope is None else scope
    source = df.where(within)
    out, results, kept, acted = df, {}, False, False
    binary = case.task.kind == "binary_classification"
    for name, entity in case.entities.items():
        if entity.id_column not in df.columns:
            continue
        ids = conflicting_ids(source, case, name)
        found = ids.agg(F.count_if("of_target").alias("t"), F.count_if("of_representation").alias("r"), F.count("*").alias("n")).first()
        policy = entity.identity_conflict_policy
        results[name] = {"policy": policy, "conflicting_targets": found.t, "conflicting_representations": found.r, "affected": found.n}
        if not found.n:
            continue
        if policy is None:
            raise CaseError(f"entity {name!r} has {found.t} ids with several targets and {found.r} with several representations: declare identity_conflict_policy")
        if policy == "keep":
            kept = True
            continue
        before = out.count()
        if policy == "exclude":
            out = excluded(out, entity.id_column, ids, within)
            results[name]["excluded_rows"] = before - out.count()
        else:
            if found.r:
                raise CaseError(f"entity {name!r} cannot aggregate ids with several values of {entity.representation_column!r}")
            _require_constant(out, case, entity.id_column, ids)
            out = aggregated(out, entity.id_column, case.task.target_column, ids, within, row, binary)
            results[name]["aggregated_rows"] = before - out.count()
        acted = True
    left = out.count()
    if not left:
        raise CaseError("the identity-conflict policies leave no row")
    status = "ACKNOWLEDGED" if kept else "RESOLVED" if acted else "NO_CONFLICTS"
    return out, {"status": status, "source_rows": df.count(), "scope_rows": source.count(), "model_rows": left, "entities": results}


def _require_constant(df: DataFrame, case: Section, key: str, ids: DataFrame) -> None:
    if not case.features.include:
        raise CaseError("aggregate requires features.include")
    features = [c for c in modelled_columns(case, df.columns) if c in df.columns and c not in (case.task.target_column, key)]
    if not features:
        return
    rows = df.join(ids.select("_id"), named(key) == F.col("_id"), "left_semi")
    per = rows.groupBy(named(key)).agg(*(F.size(F.collect_set(F.struct(named(c)))).alias(f"_{i}") for i, c in enumerate(features)))
    varies = per.agg(*(F.max(F.col(f"_{i}") > 1).alias(f"_{i}") for i in range(len(features)))).first()
    wrong = [c for c, v in zip(features, varies, strict=True) if v]
    if wrong:
        raise CaseError(f"cannot aggregate {key!r}: features {wrong} vary within an id")


# --- molecular graphs --------------------------------------------------------------------------------------------


def graph_counts(df: DataFrame, unit: str, graph: str, target: str) -> DataFrame:
    """One row about canonical graphs (text) and independent units: n_rows, n_units, n_graphs, units_with_several_graphs, units_with_several_targets, shared_graphs (of several units)."""
    cells = df.groupBy(named(unit).cast("string").alias("u"), named(graph).alias("g"), present(df, target).alias("t")).agg(F.count("*").alias("n"))
    units = cells.groupBy("u").agg(F.count_distinct("g").alias("g"), F.count_distinct("t").alias("t"))
    graphs = cells.groupBy("g").agg(F.count_distinct("u").alias("u"))
    a = units.agg(F.count("*").alias("n_units"), F.count_if(F.col("g") > 1).alias("units_with_several_graphs"), F.count_if(F.col("t") > 1).alias("units_with_several_targets"))
    b = graphs.where("g is not null").agg(F.count("*").alias("n_graphs"), F.count_if(F.col("u") > 1).alias("shared_graphs"))
    return cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows")).crossJoin(a).crossJoin(b)  # one row each
