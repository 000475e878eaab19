"""The operators as queries over the given tables. Each has a SQL twin in ``oracle.py``, written apart from it."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import discovery, roles
from ..contract import changed, parse_case, unconfirmed_roles
from ..functions import columns as x
from ..functions.ordered import average_rank
from ..operators import audits, graphs, metrics, models, overlap, profile, readiness, splits, stability, verdicts
from ..sources import adapters, io, sinks
from .oracle import ORACLE_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """df with doubles cut to so many digits: sums of floats depend on the order of rows in their last ones."""
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """orders, with a 0/1 label, a supplied split, a unit that is missing for some customers, and a time that some rows lack."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").withColumns({
        "label": (F.col("o_totalprice") > 150000).cast("int"), "split": F.when(key % 10 < 7, "Train").when(key % 10 < 9, "holdout").otherwise("other"), "fold": F.when(key % 10 < 6, "train").otherwise("TEST"),
        "unit": F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey")), "seen_at": F.when(key % 9 != 0, F.col("o_orderdate")),
    })


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with a text that tells its rows apart; order and line number do not."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return table(spark, sf, "lineitem").withColumn("row_id", F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int"), cents))


def messy(spark: SparkSession, sf: str) -> DataFrame:
    """Columns with every kind of value that a profile must tell apart, one with a space in its name and one called key."""
    key = F.col("o_orderkey")
    price = F.when(key % 11 == 0, F.lit(float("inf"))).when(key % 13 == 0, F.lit(float("nan"))).when(key % 17 != 0, F.col("o_totalprice"))
    return table(spark, sf, "orders").select(
        key.alias("key"), F.when(key % 7 != 0, F.col("o_custkey")).alias("cust"), price.alias("price"), F.lit(1).alias("same"), F.when(key % 200 == 0, "b").otherwise("a").alias("mostly"), F.col("o_orderstatus").alias("a b"),
        F.lit(None).cast("double").alias("nothing"), F.when(key % 100 == 0, F.lit("x")).alias("sparse"), F.concat(F.lit("c"), F.col("o_custkey")).alias("name"))


MESSY = ["cust", "price", "same", "mostly", "a b", "nothing", "sparse", "name"]

CASE = parse_case({
    "case_id": "orders", "data": {"path": "orders.parquet", "fingerprint_columns": ["o_totalprice", "o_orderstatus"]}, "task": {"kind": "regression", "prediction_unit": "customer", "target_column": "o_totalprice"},
    "entities": {"customer": {"id_column": "o_custkey", "representation_column": "o_orderstatus", "identity_conflict_policy": "keep"}, "priority": {"id_column": "o_orderpriority"}},
    "features": {"include": ["label", "o_orderstatus", "o_orderkey"], "post_outcome": ["split"]}, "metadata": {"batch_id": "fold", "time_column": "seen_at"}, "decision": {"kind": "top_k_per_group", "group_entity": "priority", "k": [5, 3]},
    "generalization_scenarios": [
        {"name": "rows", "strategy": "random"}, {"name": "customers", "strategy": "group", "group_column": "o_custkey", "split_claim": {"kind": "unseen_entity", "entity_column": "o_custkey"}},
        {"name": "later", "strategy": "time", "group_column": "seen_at"}, {"name": "given", "strategy": "supplied", "split_column": "split"},
    ],
    "evaluation": {"seeds": [11, 23], "primary_metric": "spearman", "bootstrap_unit": "o_custkey", "permutation_draws": 3}, "role_confirmation": {"target": True, "prediction_unit": True, "features": False, "batch": False},
})


def listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- sources and columns -----------------------------------------------------------------------------------------


@query
def s01_s02_s03_read_table(spark, sf):
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = os.path.join(base, f"formats-{uuid.uuid4().hex}")
    source = table(spark, sf, "nation")
    source.write.option("header", True).csv(f"{folder}/n.csv")
    source.write.option("header", True).option("sep", "\t").csv(f"{folder}/n.tsv")
    source.write.parquet(f"{folder}/n.pq")
    parts = [io.read_table(spark, f"{folder}/n.{s}", None if s == "pq" else source.schema).withColumn("suffix", F.lit(s)) for s in ("csv", "tsv", "pq")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def s14_s15_s20_prediction_sink(spark, sf):
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = os.path.join(base, f"predictions-{uuid.uuid4().hex}")
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.concat(F.lit("run"), (F.col("o_orderkey") % 4).cast("string")).alias("run_id"))
    sinks.write_predictions(rows, path)
    return sinks.read_predictions(spark, path, ["run1", "run3"]).groupBy("run_id").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query
def s18_o03_preview(spark, sf):
    return rounded(profile.preview(profile.column_profile(messy(spark, sf), MESSY, {"price": "target"}), 4), missing_fraction=6, median=6)


@query
def s19_figures(spark, sf):
    return rounded(sinks.histogram(orders(spark, sf), "o_totalprice", 20), low=4, high=4)


@query
def s19_entity_figure(spark, sf):
    return sinks.repetition(orders(spark, sf), "unit")


@query
def f20_f18_json_safe(spark, sf):
    df = io.without_infinite(messy(spark, sf)).select("key", "price", F.struct("key", "same").alias("nested"))
    return rounded(io.encoded(df), price=4)


@query
def a01_missing_counts(spark, sf):
    return profile.missing_counts(profile.column_profile(messy(spark, sf), MESSY))


@query
def a02_a03_constant_columns(spark, sf):
    return profile.constant_columns(profile.column_profile(messy(spark, sf), MESSY))


@query
def a05_invalid_values(spark, sf):
    return profile.invalid_values(profile.column_profile(messy(spark, sf), MESSY))


@query
def a06_high_cardinality(spark, sf):
    return profile.high_cardinality(profile.column_profile(messy(spark, sf), MESSY))


@query
def a16_a04_column_profile(spark, sf):
    df = profile.column_profile(messy(spark, sf), MESSY).drop("roles", "physical_type")
    return rounded(df, missing_fraction=6, minimum=4, q05=4, median=4, q95=4, maximum=4, mean=4, sd=3)


@query
def o02_most_missing(spark, sf):
    return rounded(profile.most_missing(profile.column_profile(messy(spark, sf), MESSY), 3), missing_fraction=6)


@query
def p01_p12_roles(spark, sf):
    df = orders(spark, sf)
    names, modelled = roles.role_names(CASE, df.columns), roles.modelled_columns(CASE, df.columns)
    open_case = changed(CASE, features={"exclude": ["fold"]})
    return listed(spark, [(c, names[c], c in modelled, c in roles.modelled_columns(open_case, df.columns)) for c in df.columns], "column_name string, roles string, modelled boolean, modelled_by_default boolean")


@query
def s22_m19_m20_declarations(spark, sf):
    df = orders(spark, sf)
    rows = [("unconfirmed", r) for r in unconfirmed_roles(CASE)] + [("ranking_group", roles.ranking_group(CASE)), ("ranking_candidate", roles.ranking_candidate(CASE, df.columns))]
    rows += [("curve_group:" + s.name, roles.curve_group(s)) for s in CASE.generalization_scenarios] + [("declared", c) for c in sorted(roles.declared_columns(CASE))]
    return listed(spark, rows, "fact string, value string")


@query
def a29_missing_metadata(spark, sf):
    return audits.missing_metadata(orders(spark, sf), CASE).select("missing")


# --- audits ------------------------------------------------------------------------------------------------------


@query
def a07_duplicate_rows(spark, sf):
    return audits.duplicate_rows(orders(spark, sf), ["o_custkey", "o_orderstatus", "o_orderpriority"])


@query
def a08_a09_entity_summary(spark, sf):
    return audits.entity_summary(messy(spark, sf), ["cust", "a b", "nothing"])


@query
def a10_label_conflicts(spark, sf):
    return audits.conflicts(orders(spark, sf), "unit", "o_orderstatus")


@query
def a11_representation_conflicts(spark, sf):
    return audits.conflicts(lines(spark, sf), "l_partkey", "l_suppkey")


@query
def a12_pair_structure(spark, sf):
    return rounded(audits.pair_structure(lines(spark, sf), "l_partkey", "l_suppkey", "l_quantity"), density=9)


@query
def a13_o01_class_counts(spark, sf):
    return audits.class_counts(orders(spark, sf), "o_orderstatus")


@query
def a14_d11_binary_encoding(spark, sf):
    df = orders(spark, sf).withColumn("coded", F.when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.col("label") + 1))
    return audits.binary_encoding(df, "label").withColumn("target", F.lit("label")).unionByName(audits.binary_encoding(df, "coded").withColumn("target", F.lit("coded"))).unionByName(audits.binary_encoding(df, "o_orderstatus").withColumn("target", F.lit("text")))


@query
def a15_target_summary(spark, sf):
    return rounded(audits.target_summary(messy(spark, sf), "price"), mean=4, sd=3, least=4, q05=4, median=4, q95=4, most=4)


@query
def a17_replicates(spark, sf):
    return rounded(audits.replicates(lines(spark, sf), ["l_partkey", "l_suppkey"], "l_extendedprice"), median_sd=4, sd_of_means=4, conflicting_rate=6)


@query
def a17_label_repeats(spark, sf):
    return rounded(audits.replicates(orders(spark, sf), ["unit"], "label", binary=True), median_sd=4, sd_of_means=4, conflicting_rate=6)


@query
def a18_coverage(spark, sf):
    return audits.coverage(orders(spark, sf), audits.coverage_columns(CASE, orders(spark, sf).columns))


@query
def a19_class_support(spark, sf):
    df = orders(spark, sf)
    return audits.class_support(df, "o_orderstatus", "unit").withColumn("by_unit", F.lit(True)).unionByName(audits.class_support(df, "o_orderstatus").withColumn("by_unit", F.lit(False)))


@query
def a25_o05_f10_measurements(spark, sf):
    df = lines(spark, sf).withColumn("ratio", x.positive_log_ratio(F.col("l_extendedprice"), F.when(F.col("l_orderkey") % 6 == 0, F.lit("n/a")).otherwise(F.col("l_quantity").cast("string")))).where("ratio is not null")
    return rounded(audits.measurements_by_key(df, "l_suppkey", ["l_returnflag", "row_id"], "ratio", ["row_id"], ["l_returnflag", "l_quantity"], 3.0), mean=6, least=6, most=6)


@query
def a26_group_sizes(spark, sf):
    return audits.group_sizes(table(spark, sf, "events"), ["user_id", "event_type"])


@query
def a27_d04_policy_exclude(spark, sf):
    df = orders(spark, sf)
    scope = F.lower("split") == "train"
    case = changed(CASE, task={**CASE.task, "target_column": "label"}, entities={"customer": {"id_column": "o_custkey", "identity_conflict_policy": "exclude"}})
    return audits.excluded(df, "o_custkey", audits.conflicting_ids(df.where(scope), case, "customer"), scope).select("o_orderkey", "o_custkey", "label")


@query
def a27_d04_policy_aggregate(spark, sf):
    df = orders(spark, sf)
    ids = audits.conflicting_ids(df, changed(CASE, entities={"customer": {"id_column": "o_custkey"}}), "customer")
    return rounded(audits.aggregated(df, "o_custkey", "o_totalprice", ids, F.lit(True), "o_orderkey", False).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), o_totalprice=6)


@query
def a27_majority_label(spark, sf):
    df = orders(spark, sf).withColumn("vote", (F.col("o_orderkey") % 7 < 4).cast("int"))
    counts = df.groupBy("o_custkey").agg(F.sum("vote").alias("a"), F.count("*").alias("n")).where("2 * a <> n and a > 0 and a < n")
    return audits.aggregated(df, "o_custkey", "vote", counts.select(F.col("o_custkey").alias("_id")), F.lit(True), "o_orderkey", True).select("o_orderkey", "o_custkey", "vote")


@query
def a28_graph_counts(spark, sf):
    return audits.graph_counts(lines(spark, sf), "l_suppkey", "l_returnflag", "l_linestatus")


@query
def c12_conflict_summary(spark, sf):
    df = orders(spark, sf)
    found = audits.conflicting_ids(df, CASE, "customer").agg(F.count_if("of_target").alias("t"), F.count_if("of_representation").alias("r"))
    return found.select(F.col("t").alias("targets"), F.col("r").alias("representations"))


@query
def d02_f04_identifier_leakage(spark, sf):
    df = table(spark, sf, "orders").withColumnsRenamed({"o_orderkey": "orderID", "o_custkey": "accessToken", "o_totalprice": "Solidity", "o_orderstatus": "status_id", "o_orderpriority": "prioid"})
    return audits.identifier_leakage(df, df.columns, {c for c in df.columns if x.names_identifier(c)})


@query
def w06_w07_first_rows(spark, sf):
    return audits.first_rows(orders(spark, sf), "unit", "o_orderkey").select("unit", "o_orderkey", "o_orderstatus")


@query
def d01_d03_audit(spark, sf):
    df = orders(spark, sf)
    found = readiness.audit_table(df, CASE)
    rows = [("rows", found["inventory"]["rows"]), ("columns", found["inventory"]["columns"]), ("duplicates", found["inventory"]["duplicate_rows"]), *(("missing:" + c, n) for c, n in found["inventory"]["missing"].items())]
    rows += [(f"{k}:{name}", e[k]) for name, e in found["independence"]["entities"].items() for k in ("n_ids", "n_missing", "most", "conflicting_targets", "conflicting_representations") if k in e]
    rows += [("pairs", found["independence"]["pair_structure"]["n_pairs"]), ("warnings", len(found["independence"]["warnings"])), ("suspicious", len(found["leakage"]["suspicious"])), ("gaps", len(found["metadata_gaps"]))]
    return listed(spark, rows, "fact string, value long")


@query
def d09_d10_findings(spark, sf):
    found = readiness.findings(readiness.audit_table(orders(spark, sf), CASE), CASE)
    return readiness.finding_table(table(spark, sf, "nation"), found).select("position", "status", "code")


@query
def d12_o07_readiness(spark, sf):
    base = orders(spark, sf).withColumn("blank", F.lit(None).cast("double"))
    out = []
    for name, features in (("declared", ["label"]), ("none_observed", ["blank"])):
        case = changed(CASE, features={"include": features}, role_confirmation=dict.fromkeys(("entities", "features", "prediction_unit", "target"), True))
        found = readiness.finding_table(base, readiness.findings(readiness.audit_table(base, case), case))
        out.append(readiness.gate_table(found).withColumn("name", F.lit(name)))
    return out[0].unionByName(out[1])


@query
def d18_d19_guesses(spark, sf):
    return discovery.guess_table(table(spark, sf, "orders")).select("column_name", "part", "confirmed")


@query
def d19_o06_cards(spark, sf):
    return discovery.card_table(table(spark, sf, "orders")).select("position", "family", "target")


@query
def d20_provisional_case(spark, sf):
    case = discovery.provisional_case(table(spark, sf, "orders"), "orders", "orders.parquet")
    return listed(spark, [(case.task.target_column, case.task.kind, ",".join(case.features.include), len(case.entities), len(unconfirmed_roles(case)))], "target string, kind string, features string, n_entities int, n_unconfirmed int")


# --- partitions ----------------------------------------------------------------------------------------------------


@query
def x01_random_split(spark, sf):
    return splits.random_rows(orders(spark, sf), "o_orderkey", 11)


@query
def x02_group_split(spark, sf):
    return splits.whole_groups(orders(spark, sf), "o_orderkey", "unit", 11)


@query
def x03_cold_left(spark, sf):
    return splits.whole_groups(lines(spark, sf), "row_id", "l_partkey", 23)


@query
def x04_cold_right(spark, sf):
    return splits.whole_groups(lines(spark, sf), "row_id", "l_suppkey", 23)


@query
def x05_double_cold(spark, sf):
    return splits.double_cold(lines(spark, sf).withColumn("part", F.when(F.col("l_partkey") % 20 != 0, F.col("l_partkey"))), "row_id", "part", "l_suppkey", 11)


@query
def x06_w05_f06_time_split(spark, sf):
    return splits.by_time(orders(spark, sf), "o_orderkey", "seen_at")


@query
def x07_supplied_split(spark, sf):
    return splits.supplied(orders(spark, sf), "o_orderkey", "split")


@query
def x08_derived_groups(spark, sf):
    return splits.create_split(orders(spark, sf), changed(CASE, generalization_scenarios=[{"name": "s", "strategy": "scaffold", "group_column": "o_orderpriority"}]).generalization_scenarios[0], 7, "o_orderkey", scaffold=F.substring("o_orderpriority", 1, 1))


@query
def x09_f14_fingerprints(spark, sf):
    """Partitions with the same members have the same membership digest, whatever their seed; manifests differ."""
    df = orders(spark, sf)
    marks = [splits.fingerprints(s, "s", "k", seed).withColumn("name", F.lit(n)) for n, s, seed in (("a", splits.supplied(df, "o_orderkey", "split"), 1), ("b", splits.supplied(df.repartition(3), "o_orderkey", "split"), 2), ("c", splits.random_rows(df, "o_orderkey", 11), 1))]
    all_marks = marks[0].unionByName(marks[1]).unionByName(marks[2])
    return all_marks.agg(F.count_distinct("membership").alias("memberships"), F.count_distinct("manifest").alias("manifests"), F.min(F.length("membership")).alias("digits"))


@query
def x10_nested_subsets(spark, sf):
    return splits.subset_sizes(splits.nested_subsets(orders(spark, sf), "o_orderkey", "unit", 11))


@query
def x12_permute_within_groups(spark, sf):
    return splits.permute_within(orders(spark, sf), "o_orderkey", "unit", "o_totalprice", 11)


@query
def x12_permute_rows(spark, sf):
    return splits.permute_within(orders(spark, sf), "o_orderkey", None, "o_totalprice", 11)


@query
def p03_development_rows(spark, sf):
    return splits.development_rows(orders(spark, sf), "o_orderkey", ["split", "fold"])


@query
def p08_modelling_rows(spark, sf):
    df = orders(spark, sf)
    used = splits.modelling_rows([splits.supplied(df, "o_orderkey", "split"), splits.supplied(df.withColumn("s", F.when(F.col("o_orderkey") % 20 == 0, "test")), "o_orderkey", "s")])
    return used.agg(F.count("*").alias("n_used")).crossJoin(df.agg(F.count("*").alias("n"))).select("n_used", (F.col("n") - F.col("n_used")).alias("n_dropped"))


# --- overlap and claims ------------------------------------------------------------------------------------------


@query
def d05_u01_u02_u03_overlap(spark, sf):
    df = orders(spark, sf)
    return rounded(overlap.overlap_audit(df, CASE, "o_orderkey", splits.random_rows(df, "o_orderkey", 11)), test_fraction=6)


@query
def u02_j06_pair_overlap(spark, sf):
    df = lines(spark, sf)
    return rounded(overlap.shared_keys(overlap.sides(df, "row_id", splits.random_rows(df, "row_id", 11)), ["l_partkey", "l_suppkey"]), test_fraction=6)


@query
def u04_c13_graph_overlap(spark, sf):
    df = orders(spark, sf)
    return rounded(graphs.graph_overlap(df, splits.whole_groups(df, "o_orderkey", "o_custkey", 11), "o_orderkey", F.concat("o_orderstatus", (F.col("o_custkey") % 400).cast("string"))), test_fraction=6)


def _claim(df: DataFrame, split: DataFrame, kind: str, entity: str, context: str | None = None) -> DataFrame:
    scenario = {"name": "s", "strategy": "random", "split_claim": {"kind": kind, "entity_column": entity, "context_column": context}}
    return overlap.split_claim(df, "o_orderkey", split, changed(CASE, generalization_scenarios=[scenario]).generalization_scenarios[0].split_claim)


@query
def d07_u05_claims(spark, sf):
    df = orders(spark, sf).withColumn("half", F.col("o_orderkey") % 2).withColumn("cell", F.col("o_custkey") % 5)
    grouped, halves = splits.whole_groups(df, "o_orderkey", "o_custkey", 11), splits.supplied(df.withColumn("h", F.when(F.col("half") == 0, "train").otherwise("test")), "o_orderkey", "h")
    tried = [
        ("unseen_grouped", _claim(df, grouped, "unseen_entity", "o_custkey")), ("unseen_halves", _claim(df, halves, "unseen_entity", "cell")), ("same_halves", _claim(df, halves, "same_entity_across_context", "cell", "half")),
        ("same_grouped", _claim(df, grouped, "same_entity_across_context", "o_custkey", "o_orderstatus")), ("missing_ids", _claim(df, halves, "unseen_entity", "unit")), ("no_claim", overlap.split_claim(df, "o_orderkey", halves, None)),
    ]
    out = [s.withColumn("name", F.lit(n)) for n, s in tried]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


@query
def a30_overlap_summary(spark, sf):
    df = orders(spark, sf)
    parts = []
    for s in CASE.generalization_scenarios[:2]:
        for seed in (11, 23):
            split = splits.create_split(df, s, seed, "o_orderkey")
            parts.append(overlap.overlap_audit(df, CASE, "o_orderkey", split).crossJoin(overlap.split_claim(df, "o_orderkey", split, s.split_claim).withColumnRenamed("status", "claim_status")).withColumns({"scenario": F.lit(s.name), "seed": F.lit(seed)}))
    for more in parts[1:]:
        parts[0] = parts[0].unionByName(more)
    case = changed(CASE, generalization_scenarios=[s for s in CASE.generalization_scenarios[:2]])
    return rounded(overlap.overlap_summary(parts[0], case), boundary_fraction=6, unit_fraction=6)


@query
def a30_class_floor(spark, sf):
    df = orders(spark, sf)
    kind = F.when((F.col("o_orderkey") % 3 == 0) & (F.col("o_orderstatus") == "P"), "O").otherwise(F.col("o_orderstatus"))
    counts = df.groupBy(F.col("o_orderpriority").alias("scenario"), (F.col("o_orderkey") % 3).alias("seed"), kind.alias("class")).agg(F.count_distinct("o_custkey").alias("n_units"))
    return overlap.class_floor(counts)


# --- features and scalar functions ----------------------------------------------------------------------------------


@query
def f02_composition(spark, sf):
    shares = x.letter_shares(F.col("p_name"))
    return rounded(table(spark, sf, "part").select("p_partkey", *(c.alias(f"share_{a.lower()}") for a, c in shares.items())), **{f"share_{a.lower()}": 6 for a in shares})


@query
def f03_gram_hash(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.posexplode(x.gram_vector(F.col("p_type"))).alias("bucket", "weight"))
    return rounded(df.where("weight > 0"), weight=6)


@query
def f22_feature_frames(spark, sf):
    """Names of the feature columns of an entity with a text representation and one with a sequence."""
    df = table(spark, sf, "part")
    case = changed(CASE, task={"kind": "regression", "prediction_unit": "part", "target_column": "p_retailprice"}, entities={"a": {"id_column": "p_partkey", "representation_column": "p_type"}, "b": {"id_column": "p_brand", "representation_column": "p_name_seq"}}, features={"include": ["p_type", "p_name_seq", "p_size"]}, generalization_scenarios=[{"name": "r", "strategy": "random"}])
    frame = models.feature_frames(df.withColumn("p_name_seq", F.col("p_name")), case)["declared_features"]
    names = models.feature_names(frame, df.withColumn("p_name_seq", F.col("p_name")), case)
    kinds = [("char", sum("_char_" in n for n in names)), ("letters", sum("_aa_" in n for n in names)), ("plain", sum("_char_" not in n and "_aa_" not in n for n in names))]
    return listed(spark, kinds, "kind string, n int")


@query
def f06_f07_p11_try_cast(spark, sf):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    df = table(spark, sf, "orders").withColumn("text", text).withColumn("stamp", F.when(F.col("o_orderkey") % 4 == 0, F.lit("never")).otherwise(F.col("o_orderdate").cast("string")))
    return df.select("o_orderkey", F.round(x.numeric(df, "text"), 4).alias("number"), x.timestamp(F.col("stamp")).cast("date").alias("day"))


@query
def f08_f09_f13_mapping(spark, sf):
    df = table(spark, sf, "orders")
    return df.select(x.joined_id("order", F.col("o_orderkey")).alias("sample_id"), x.mapped(df, "o_orderstatus", {"F": 0, "O": 1, "P": 2}).alias("code"), F.round(x.required_number(df, "o_totalprice"), 4).alias("price"))


@query
def f12_half_even(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", x.half_even(F.col("n_nationkey") * 0.5).alias("half"))


@query
def w01_average_rank(spark, sf):
    return average_rank(orders(spark, sf).select("o_orderkey", (F.col("o_custkey") % 997).alias("v")), "v", "rank")


# --- adapters -------------------------------------------------------------------------------------------------------


def _key(c: Column) -> Column:
    return F.upper(F.trim(c.cast("string")))


@query
def s07_davis(spark, sf):
    raw = lines(spark, sf).select(F.col("l_partkey").alias("Drug_ID"), F.col("l_returnflag").alias("Drug"), F.col("l_suppkey").alias("Target_ID"), F.col("l_linestatus").alias("Target"), F.col("l_extendedprice").alias("Y"), F.col("row_id").alias("unused"))
    df, facts = adapters.davis(raw)
    n = df.agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("ids"), F.round(F.sum("affinity"), 2).alias("total"), F.sum(F.substring_index("sample_id", "-", -1).cast("long")).alias("numbers"))
    return n.withColumns({"compounds": F.lit(facts["compound_count"]).cast("long"), "targets": F.lit(facts["target_count"]).cast("long")})


@query
def s08_barrier(spark, sf):
    raw = orders(spark, sf).select(F.col("o_orderkey").alias("Drug_ID"), F.col("o_orderpriority").alias("Drug"), F.col("label").cast("string").alias("Y"))
    return adapters.barrier(raw)[0].groupBy("bbb_label").agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("ids"))


@query
def s09_j02_u06_barrier_external(spark, sf):
    inside = orders(spark, sf).select(x.joined_id("m", F.col("o_orderkey")).alias("sample_id"), F.col("o_orderkey").alias("compound_id"), F.concat(F.lit(" c"), F.col("o_orderkey") / 3).alias("smiles"), F.col("label").alias("bbb_label"))
    outside = table(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey") / 5).alias("SMILES"), F.col("c_custkey").alias("CID"), F.when(F.col("c_acctbal") > 0, "BBB+").otherwise("BBB-").alias("BBB+/BBB-"), F.col("c_mktsegment").alias("reference"), F.col("c_nationkey").alias("group"))
    df, _ = adapters.barrier_external(inside, outside, _key)
    return df.groupBy("validation_split", "bbb_label").agg(F.count("*").alias("n"), F.count_distinct("compound_id").alias("compounds"), F.count("curation_group").alias("grouped"))


@query
def s10_j03_tracer_external(spark, sf):
    protected = table(spark, sf, "part").select(x.joined_id("d", F.col("p_partkey")).alias("sample_id"), F.concat(F.lit("P"), F.col("p_partkey") * 4).alias("compound_id"), F.col("p_name").alias("smiles"), F.lit(1).alias("bbb_label"), F.when(F.col("p_partkey") % 8 == 0, "train").otherwise("holdout").alias("validation_split"))
    raw = lines(spark, sf).select(
        F.col("l_orderkey").alias("compound index"), F.concat(F.lit("p"), F.col("l_partkey")).alias("SMILES"), F.col("l_suppkey").alias("PMID"), F.col("l_returnflag").alias("animal type"), F.col("l_linestatus").alias("gender"), F.col("l_tax").alias("animal weight (g)"), F.col("l_discount").alias("injection dosage (μCi)"),
        F.when(F.col("l_orderkey") % 9 == 0, F.lit("-")).otherwise(F.col("l_quantity").cast("string")).alias("brain at60min"), F.col("l_extendedprice").alias("blood at60min"), F.col("l_linenumber").alias("ref No"), F.col("l_returnflag").alias("DOI"))
    df, _ = adapters.tracer_external(protected, raw, _key)
    return rounded(df.select("sample_id", "compound_id", "bbb_label", "validation_split", "log10_bb", "measurement_count", "source_animal_type"), log10_bb=6)


@query
def s11_a26_voice(spark, sf):
    source = lines(spark, sf)
    numbers = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    names = list(adapters.VOICE)
    raw = source.select(F.col("l_suppkey").cast("double").alias("subject#"), *(F.col(numbers[i % 4]).alias(c) for i, c in enumerate(names[1:])))
    df, facts = adapters.voice(raw)
    n = df.agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("ids"), F.round(F.sum("age"), 2).alias("age"))
    return n.withColumns({"participants": F.lit(facts["participant_count"]).cast("long"), "times": F.lit(facts["participant_times"]).cast("long"), "repeated": F.lit(facts["records_in_repeated_groups"]).cast("long")})


# --- baselines, metrics, rankings ---------------------------------------------------------------------------------------


def _means(spark, sf):
    df = lines(spark, sf)
    return models.entity_means(df, "row_id", splits.random_rows(df, "row_id", 11), "l_extendedprice", "l_partkey", "l_suppkey")


@query
def j01_m06_entity_means(spark, sf):
    return rounded(_means(spark, sf), global_mean=6, left_mean=6, right_mean=6, additive=6)


@query
def m07_m08_m09_regression_metrics(spark, sf):
    return rounded(metrics.regression_metrics(_means(spark, sf), "y_true", "additive"), mae=4, rmse=4, pearson=5, spearman=5)


@query
def m08_flat_side(spark, sf):
    return rounded(metrics.regression_metrics(orders(spark, sf).withColumn("one", F.lit(1.0)), "o_totalprice", "one"), mae=2, rmse=2)


@query
def m10_kendall(spark, sf):
    df = orders(spark, sf).select("o_totalprice", (F.col("o_custkey") % 50 + F.floor(F.col("o_totalprice") / 20000)).alias("p"))
    return rounded(metrics.kendall_tau(df, "o_totalprice", "p"), kendall_tau=6)


@query
def m11_m14_p09_classification_metrics(spark, sf):
    df = messy(spark, sf).select(F.when(~F.isnan("price"), (F.col("price") > 150000).cast("int")).alias("y"), F.when(F.col("key") % 19 == 0, F.lit(float("nan"))).otherwise((F.col("key") % 97) / 97.0).alias("p"))
    return rounded(metrics.classification_metrics(df, "y", "p", 0.5), balanced_accuracy=6, roc_auc=6, average_precision=6, log_loss=6)


@query
def m12_m13_one_class(spark, sf):
    return rounded(metrics.classification_metrics(orders(spark, sf).select(F.lit(1).alias("y"), ((F.col("o_custkey") % 97) / 97.0).alias("p")), "y", "p"), balanced_accuracy=6, log_loss=6)


@query
def m15_w04_group_ranking(spark, sf):
    df = orders(spark, sf).select((F.col("o_custkey") % 50).alias("grp"), "o_totalprice", (F.col("o_custkey") % 7).alias("p"))
    return rounded(metrics.group_ranking(df, "grp", "o_totalprice", "p", 10), median_spearman=5, median_ndcg=5)


@query
def m16_permutation_summary(spark, sf):
    df = orders(spark, sf)
    drawn = df.groupBy((F.col("o_custkey") % 99).alias("g")).agg(F.avg("o_totalprice").alias("v")).select(F.when(F.col("g") != 5, F.col("v")).otherwise(F.lit(float("nan"))).alias("v"))
    return rounded(metrics.permutation_summary(df.agg(F.avg("o_totalprice").alias("o")), drawn), median=4, q05=4, q95=4, p_value=6)


@query
def m17_m18_directions(spark, sf):
    names = ["mae", "rmse", "log_loss", "spearman", "roc_auc"]
    return listed(spark, [(n, metrics.direction(n), models.ranking_sign(changed(CASE, task={**CASE.task, "higher_is_better": n != "mae"}))) for n in names], "metric string, direction int, ranking_sign int")


@query
def m04_m05_suites(spark, sf):
    wanted = [("binary_classification", "smoke", None), ("regression", "standard", None), ("regression", "standard", {"dummy", "nearest_neighbour", "logistic"})]
    rows = [(i, n) for i, (k, b, a) in enumerate(wanted) for n in models.suite(k, b, a)]
    return listed(spark, rows + [(9, str(s)) for s in models.seeds(changed(CASE, evaluation={"seeds": [5, 3, 9]}), "smoke")], "suite int, name string")


def _features(spark, sf) -> tuple[DataFrame, DataFrame, list[str]]:
    df = orders(spark, sf).withColumn("gap", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey").cast("double"))).withColumn("kind", F.when(F.col("o_orderkey") % 8 != 0, F.col("o_orderstatus")))
    return df.where("split = 'Train'"), df.where("split = 'holdout'"), ["gap", "kind"]


@query
def m01_preparation(spark, sf):
    from pyspark.ml.functions import vector_to_array

    train, test, features = _features(spark, sf)
    ready = models.Preparation(train, features).apply(test).select("o_orderkey", vector_to_array("features").alias("v"))
    return ready.select("o_orderkey", *(F.get("v", i).alias(n) for i, n in enumerate(("gap", "first", "second", "third"))))


@query
def m02_m03_dummy(spark, sf):
    train, test, features = _features(spark, sf)
    return rounded(models.Fitted("dummy", "regression", 1, "smoke", train, features, "o_totalprice").predict(test).select("o_orderkey", "y_pred"), y_pred=4)


@query
def m03_elastic_net(spark, sf):
    """What a linear model learns from a linear target: y = 3 a - 2 b + 5, with noise that the features do not explain left out."""
    df = orders(spark, sf).select("o_orderkey", "split", (F.col("o_custkey") % 31).cast("double").alias("a"), (F.col("o_orderkey") % 17).cast("double").alias("b")).withColumn("y", 3 * F.col("a") - 2 * F.col("b") + 5)
    fitted = models.Fitted("elastic_net", "regression", 1, "smoke", df.where("split = 'Train'"), ["a", "b"], "y")
    test = fitted.predict(df.where("split = 'holdout'"))
    return test.agg(F.count("*").alias("n"), (F.max(F.abs(F.col("y") - F.col("y_pred"))) < 1.0).alias("close"))


@query
def m21_m22_predictions(spark, sf):
    df = orders(spark, sf).select("o_orderkey", "o_custkey", "o_totalprice")
    predicted = df.withColumn("y_pred", F.col("o_custkey") * 1.0)
    split = splits.supplied(orders(spark, sf), "o_orderkey", "split")
    out = models.prediction_rows(predicted.join(split.where("part <> 'excluded'").select(F.col("row_id").alias("o_orderkey")), "o_orderkey"), "o_orderkey", "o_totalprice", split, run_id="r", scenario="given", model="dummy", representation="declared_features")
    return rounded(out.select("_row_id", "y_true", "y_pred", "is_test", "run_id", "scenario", "model", "representation"), y_true=4)


# --- experiments ----------------------------------------------------------------------------------------------------


def rankings(spark, sf) -> DataFrame:
    df = table(spark, sf, "orders")
    return df.groupBy((F.col("o_orderkey") % 3).alias("run"), F.col("o_orderpriority").alias("grp"), (F.col("o_custkey") % 40).alias("candidate")).agg(F.max("o_totalprice").alias("score"))


def records(spark, sf) -> DataFrame:
    """Experiment records made of orders: four seeds, three models and a dummy, two of every seven permuted."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    df = table(spark, sf, "orders")
    metric = F.col("o_totalprice") / 400000
    return df.select(
        F.when(F.col("o_orderpriority").startswith("1"), "rows").otherwise("customers").alias("scenario"), F.when(F.col("o_orderpriority").startswith("1"), "random").otherwise("group").alias("strategy"), F.when(F.col("o_orderstatus") == "F", "x").otherwise("y").alias("representation"),
        (key % 4).cast("int").alias("seed"), F.when(cust % 4 == 0, "dummy").otherwise(F.concat(F.lit("m"), (cust % 3).cast("string"))).alias("model"), (key % 7 < 2).alias("permuted"), (key % 5).cast("int").alias("permutation_draw"),
        F.concat(F.lit("p"), (key % 2).cast("string")).alias("partition_fingerprint"), F.when(key % 7 < 2, metric * 0.4).otherwise(F.when(key % 11 != 0, metric)).alias("spearman"))


@query
def a20_experiment_summary(spark, sf):
    return rounded(stability.experiment_summary(records(spark, sf), "spearman"), median=6, sd=6)


@query
def a21_p10_best_model(spark, sf):
    return rounded(stability.best_model(stability.real_runs(records(spark, sf)), "spearman"), median=6)


@query
def a22_t02_partition_variation(spark, sf):
    return rounded(stability.partition_variation(stability.real_runs(records(spark, sf)), "spearman"), median_sd=6)


@query
def t02_unrecorded_partitions(spark, sf):
    return stability.partition_variation(records(spark, sf).withColumn("partition_fingerprint", F.when(F.col("seed") != 1, F.col("partition_fingerprint"))), "spearman")


@query
def a23_t03_decomposition(spark, sf):
    return rounded(stability.decomposition(records(spark, sf), "spearman"), sd=6)


@query
def a24_representation_range(spark, sf):
    return rounded(stability.representation_range(records(spark, sf), "spearman"), range=6)


@query
def t04_representation_sensitivity(spark, sf):
    marks = listed(spark, [("rows", "x", "SUPPORTED", 0.7), ("rows", "y", "CONTRADICTED", 0.4), ("customers", "x", "SUPPORTED_WITH_LIMITS", 0.5), ("customers", "y", "SUPPORTED_WITH_LIMITS", None)], "scenario string, representation string, status string, median double")
    return rounded(stability.representation_sensitivity(marks, records(spark, sf), "spearman"), median_range=6, matched_range=6)


@query
def w02_rank_spread(spark, sf):
    return rounded(stability.rank_spread(rankings(spark, sf)), median_rank_sd=6)


@query
def w03_o04_top_k(spark, sf):
    return stability.top_k(rankings(spark, sf), 5)


@query
def t01_u10_selection_probability(spark, sf):
    return rounded(stability.selection_probability(stability.top_k(rankings(spark, sf), 5)), probability=6)


@query
def u08_j07_pairwise_jaccard(spark, sf):
    return rounded(stability.pairwise_jaccard(stability.top_k(rankings(spark, sf), 5, lower=True)), jaccard=6)


@query
def t05_u07_ranking_results(spark, sf):
    df = rankings(spark, sf).withColumn("representation", F.when(F.col("candidate") % 2 == 0, "x").otherwise("y"))
    return rounded(stability.ranking_results(df, [3, 5]), mean_jaccard=6, unstable_fraction=6)


# --- verdicts ---------------------------------------------------------------------------------------------------------


VERDICT_CASE = changed(CASE, generalization_scenarios=[s for s in CASE.generalization_scenarios[:2]], thresholds={"supported_metric": 0.45, "limited_metric": 0.3, "maximum_permutation_p_value": 0.2})


@query
def c01_scenario_facts(spark, sf):
    return rounded(verdicts.scenario_facts(records(spark, sf), VERDICT_CASE), median=6, sd=6, random_median=6, null_median=6, null_q05=6, null_q95=6, p_value=6)


def _verdict_facts(spark) -> DataFrame:
    """Facts on either side of every rule: (name, scenario, median, sd, random median, null median, p, exact, pairs, boundary, unit, claim, targets, representations, classes, least class)."""
    clean = (0, 0, 0, 0, True, 0, 0, 2, 50)
    ladder = [("at_supported", 0.5, 0.1), ("below_supported", 0.49, 0.1), ("at_limited", 0.2, 0.1), ("below_limited", 0.19, 0.1), ("unsteady", 0.6, 0.2), ("one_run", 0.6, None), ("no_metric", None, None)]
    rows = [(n, "customers", m, s, 0.4, 0.05, 0.1, *clean) for n, m, s in ladder]
    rows += [("refuted", "customers", 0.1, 0.1, 0.5, 0.0, 0.1, *clean), ("not_refuted_at_random", "rows", 0.1, 0.1, 0.5, 0.0, 0.1, *clean), ("weak_delta", "customers", 0.6, 0.1, 0.4, 0.56, 0.1, *clean), ("weak_p", "customers", 0.6, 0.1, 0.4, 0.05, 0.11, *clean), ("no_null", "customers", 0.6, 0.1, 0.4, None, None, *clean)]
    caps = {"exact": (3, 0, 0, 0, True, 0, 0, 2, 50), "pairs": (0, 1, 0, 0, True, 0, 0, 2, 50), "boundary": (0, 0, 2, 0, True, 0, 0, 2, 50), "targets": (0, 0, 0, 0, True, 1, 0, 2, 50), "representations": (0, 0, 0, 0, True, 0, 1, 2, 50), "unclaimed": (0, 0, 0, 0, False, 0, 0, 2, 50), "few": (0, 0, 0, 0, True, 0, 0, 2, 9), "one_class": (0, 0, 0, 0, True, 0, 0, 1, 90)}
    rows += [(n, "customers", 0.9, 0.1, 0.4, 0.05, 0.1, *c) for n, c in caps.items()]
    rows += [("repeats", "rows", 0.9, 0.1, 0.9, 0.05, 0.1, 0, 0, 0, 7, True, 0, 0, 2, 50), ("few_refuted", "customers", 0.1, 0.1, 0.5, 0.0, 0.1, 0, 0, 0, 0, True, 0, 0, 2, 1)]
    return listed(spark, rows, "name string, scenario string, median double, sd double, random_median double, null_median double, p_value double, exact long, pairs long, boundary long, unit long, claim_compatible boolean, targets int, representations int, n_classes long, least_class long")


CAPPED_CASE = changed(CASE, task={"kind": "binary_classification", "prediction_unit": "customer", "target_column": "label"}, generalization_scenarios=[s for s in CASE.generalization_scenarios[:2]], thresholds={"minimum_test_class_count": 10})


@query
def c01_c02_c03_c04_c06_verdicts(spark, sf):
    return verdicts.capped(_verdict_facts(spark), CAPPED_CASE).select("name", "metric_status", "status", F.array_join("capped_by", ",").alias("capped_by"))


@query
def c05_top_k_verdict(spark, sf):
    marks = listed(spark, [(None,), (0.49,), (0.5,), (0.64,), (0.65,)], "mean_jaccard double")
    return marks.select("mean_jaccard", verdicts.top_k_status(F.col("mean_jaccard"), 0.65, 0.5).alias("status"))


@query
def c07_c08_c10_verdict_matrix(spark, sf):
    scenarios = listed(spark, [("rows", "x", 0.5, "SUPPORTED"), ("rows", "y", 0.4, "CONTRADICTED")], "scenario string, representation string, median double, status string")
    ranking = listed(spark, [("x", 3, 0.9), ("y", 3, 0.55), (None, 3, 0.7), ("x", 5, 0.1)], "representation string, k int, mean_jaccard double")
    case = changed(CASE, holdout={"enabled": True})
    chosen = verdicts.selection_verdict(ranking, case, tainted=True)
    gaps = [("batch_id", ""), ("replicate identifiers", ""), ("time_column", "")]
    out = verdicts.verdict_matrix(scenarios, chosen, verdicts.shared_verdicts("ASSESSED", gaps), case)
    return out.select("claim", "representation", "status", "median", F.endswith("next_step", F.lit("this holdout is spent.")).alias("warned"))


@query
def c09_permutation_design(spark, sf):
    control = listed(spark, [("a", "row", None), ("b", "equal_size_group_blocks_within_group_shuffle", "u"), ("c", "row", None), ("c", "equal_size_group_blocks_within_group_shuffle", "u"), ("d", None, "u"), ("e", "equal_size_group_blocks_within_group_shuffle", None)], "name string, permutation_method string, permutation_unit string")
    out = [verdicts.permutation_design(control.where(F.col("name") == n)).withColumn("name", F.lit(n)) for n in "abcdef"]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


@query
def c11_graph_readiness(spark, sf):
    base = ("VALID_CONTRACT", 2, "ASSESSED", 0, True, False, False, True, True)
    tries = {"ready": {}, "undeclared": {0: "NOT_DECLARED"}, "unmet": {0: "UNMET_REQUIREMENTS"}, "no_verdict": {1: 0}, "no_overlap": {2: "NOT_ASSESSABLE"}, "crossing": {3: 1}, "support": {4: False}, "external": {5: True}, "enough": {6: True}, "no_change": {7: False}, "no_gap": {8: False}}
    rows = [(n, *(c.get(i, v) for i, v in enumerate(base))) for n, c in tries.items()]
    facts = listed(spark, rows, "name string, contract_status string, n_verdicts int, overlap_status string, worst int, enough boolean, null_failure boolean, all_limited boolean, changes boolean, bounded_gap boolean")
    return graphs.assess(facts).select("name", "status")


@query
def c13_overlap_status(spark, sf):
    shared = listed(spark, [("s", 1, 0), ("s", 2, 3)], "scenario string, seed int, shared long")
    support = listed(spark, [("s", 1, "0", 12, "u"), ("s", 1, "1", 30, "u"), ("s", 2, "0", 10, "u"), ("s", 2, "1", 11, "u")], "scenario string, seed int, class string, n_units long, count_unit string")
    out = [graphs.overlap_status(shared, support, f, u).withColumn("name", F.lit(n)) for n, f, u in (("ok", 10, "u"), ("floor", 11, "u"), ("unit", 10, "v"))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query
def c14_c15_summaries(spark, sf):
    marks = listed(spark, [("a", "SUPPORTED"), ("a", "SUPPORTED_WITH_LIMITS"), ("b", "INSUFFICIENT_EVIDENCE"), ("c", "CONTRADICTED")], "scenario string, status string")
    moved = listed(spark, [("a", False, 0.1), ("b", True, 0.3)], "scenario string, verdict_changes boolean, matched_range double")
    curve = listed(spark, [("a",), ("a",), ("z",)], "scenario string")
    out = [graphs.development_summary(marks, moved, curve, c).withColumn("name", F.lit("".join(c))) for c in (["a"], ["a", "b"], ["b", "c"])]
    failed = listed(spark, [("INSUFFICIENT_EVIDENCE", 0.3, 2, 20, 10), ("INSUFFICIENT_EVIDENCE", 0.05, 2, 20, 10), ("INSUFFICIENT_EVIDENCE", 0.3, 2, 5, 10), ("SUPPORTED", 0.3, 2, 20, 10)], "status string, p_value double, n_classes long, least_class long, required long")
    outside = graphs.external_summary(failed, 0.1).select("null_failure")
    return out[0].unionByName(out[1]).unionByName(out[2]).crossJoin(outside)  # one row


@query
def b03_decisions(spark, sf):
    from ..autoprobe import decide, parse_candidate

    candidate = parse_candidate({"candidate_id": "c", "model": "dummy"})
    now = {"guardrails": [], "runtime_seconds": 1.0, "primary_metric": "spearman", "median": 0.5, "worst": 0.4, "top_k": 0.6}
    kept = {"median": 0.45, "worst": 0.41, "top_k": 0.62}
    tries = {"better": ({}, kept), "first": ({}, None), "guarded": ({"guardrails": ["x"]}, kept), "slow": ({"runtime_seconds": 301.0}, None), "same": ({"median": 0.455}, kept), "worse_scenario": ({"worst": 0.38}, kept), "unstable": ({"top_k": 0.5}, kept), "lower": ({"primary_metric": "mae", "median": 0.4, "worst": 0.42}, kept), "unknown": ({"median": None}, kept)}
    return listed(spark, [(n, *decide(now | c, k, candidate)) for n, (c, k) in tries.items()], "name string, decision string, because string")


FLAGSHIP = "d01_d03_audit"


assert set(ORACLE_SQL) <= set(QUERIES), set(ORACLE_SQL) - set(QUERIES)
