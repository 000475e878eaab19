"""Small frames with answers worked out by hand, for what a whole-table query does not reach."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from probator import autoprobe, discovery, ledger
from probator.contract import CaseError, changed, parse_case
from probator.functions.ordered import average_rank, cumulate, quantiles
from probator.operators import audits, graphs, metrics, models, overlap, profile, readiness, splits, stability, verdicts
from probator.sources import adapters, io, sinks, synthetic

CASE = parse_case({
    "case_id": "c", "data": {"path": "t.parquet"}, "task": {"kind": "regression", "prediction_unit": "mouse", "target_column": "y"}, "entities": {"mouse": {"id_column": "mouse_id", "representation_column": "strain"}}, "features": {"include": ["x"]},
    "generalization_scenarios": [{"name": "r", "strategy": "random"}],
})


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- orders -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("parts", [2, 8, 128])
def test_sums_over_an_order(spark, parts):
    rng = np.random.default_rng(4)
    values = sorted({float(v) for v in rng.normal(size=300)} | {1e300, -1e300})
    df = spark.createDataFrame([(v, i % 7) for i, v in enumerate(values)], "v double, n long").repartition(5)
    got = {r.v: r.before for r in cumulate(df, "v", {"before": "n"}, parts=parts).collect()}
    want = dict(zip(values, itertools.accumulate([0, *(i % 7 for i in range(len(values) - 1))]), strict=True))
    assert got == want


def test_ranks_and_quantiles_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 1.0), (3, 5.0), (4, None), (5, 9.0)], "i int, v double")
    assert {r.i: r.r for r in average_rank(df, "v", "r").collect()} == {1: 2.5, 2: 1.0, 3: 2.5, 4: None, 5: 4.0}
    counts = spark.createDataFrame([("a", 1.0, 2), ("a", 4.0, 1), ("b", 7.0, 1)], "k string, value double, n long")
    assert rows(quantiles(counts, {"q": 0.5, "z": 0.75}, ("k",))) == [("a", 1.0, 2.5), ("b", 7.0, 7.0)]


@pytest.mark.parametrize("parts", [2, 4, 128])
def test_kendall_against_all_pairs(spark, parts):
    rng = np.random.default_rng(8)
    y, p = rng.integers(0, 30, 120) * 1.5, rng.integers(0, 9, 120) * 1.0
    s = sum(np.sign(a - b) * np.sign(c - d) for (a, c), (b, d) in itertools.combinations(zip(y, p, strict=True), 2))
    ny, np_ = (sum(a != b for a, b in itertools.combinations(v, 2)) for v in (y, p))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p, strict=True)] + [(None, 1.0), (float("nan"), 2.0)], "y double, p double")
    got = metrics.kendall_tau(df, "y", "p", parts).first()
    assert (got.n, got.kendall_tau) == (120, pytest.approx(s / np.sqrt(float(ny) * np_)))
    assert metrics.kendall_tau(df.select(F.lit(1.0).alias("y"), "p"), "y", "p", parts).first().kendall_tau is None


def test_group_metrics_share_tied_gains(spark):
    df = spark.createDataFrame([("g", 0.0, 0.0), ("g", 1.0, 1.0), ("g", 2.0, 0.0), ("lone", 1.0, 1.0), ("flat", 3.0, 1.0), ("flat", 3.0, 2.0)], "g string, y double, p double")
    got = {r.grp: r for r in metrics.group_metrics(df, "g", "y", "p", 10).collect()}
    # Places 2 and 3 are tied with gains 0 and 2: each has 1. The best order has gains 2, 1, 0.
    best, have = 2 / np.log(2) + 1 / np.log(3), 1 / np.log(2) + 1 / np.log(3) + 1 / np.log(4)
    assert set(got) == {"g", "flat"} and got["g"].ndcg == pytest.approx(have / best) and got["flat"].ndcg is None and got["flat"].spearman is None


def test_permutation_tails(spark):
    seen = spark.createDataFrame([(2.0,)], "o double")
    null = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),), (float("inf"),)], "v double")
    assert metrics.permutation_summary(seen, null, lower=True).first().asDict() == {"draws": 3, "median": 2.0, "q05": pytest.approx(1.1), "q95": pytest.approx(2.9), "p_value": 0.75}
    assert metrics.permutation_summary(seen, null.limit(0)).first().p_value is None


def test_metrics_without_a_finite_pair(spark):
    df = spark.createDataFrame([(None, 1.0)], "y double, p double")
    assert metrics.regression_metrics(df, "y", "p").first().asDict() == {"n": 0, "mae": None, "rmse": None, "pearson": None, "spearman": None}
    assert metrics.classification_metrics(df, "y", "p").first().n == 0


# --- audits -------------------------------------------------------------------------------------------------------


def test_profile_of_nothing_and_of_odd_names(spark):
    df = spark.createDataFrame([], "`a b` double, key string")
    assert [(r.column_name, r.n_rows, r.is_constant, r.top_value) for r in profile.column_profile(df).orderBy("position").collect()] == [("a b", 0, True, None), ("key", 0, True, None)]
    df = spark.createDataFrame([(True, "x"), (True, None), (False, "x")], "`n.o` boolean, key string")
    got = {r.column_name: r for r in profile.column_profile(df).collect()}
    assert (got["n.o"].mean, got["key"].top_value, got["key"].top_count, got["key"].n_missing) == (pytest.approx(2 / 3), "x", 2, 1)


def test_policies(spark):
    df = spark.createDataFrame([(0, "m", "s", 1.0, 5.0), (1, "m", "s", 3.0, 5.0), (2, "n", "s", 4.0, 6.0), (3, None, "t", 9.0, 7.0)], "row int, mouse_id string, strain string, y double, x double")
    with pytest.raises(CaseError, match="identity_conflict_policy"):
        audits.apply_policies(df, CASE, "row")

    def under(policy, table=df, scope=None):
        return audits.apply_policies(table, changed(CASE, entities={"mouse": {**CASE.entities["mouse"], "identity_conflict_policy": policy}}), "row", scope)

    kept, facts = under("keep")
    assert kept.count() == 4 and facts["status"] == "ACKNOWLEDGED"
    out, facts = under("exclude")
    assert [r.row for r in out.orderBy("row").collect()] == [2, 3] and (facts["status"], facts["entities"]["mouse"]["excluded_rows"]) == ("RESOLVED", 2)
    out, facts = under("aggregate")
    assert rows(out.select("row", "mouse_id", "y")) == [(0, "m", 2.0), (2, "n", 4.0), (3, None, 9.0)] and facts["entities"]["mouse"]["aggregated_rows"] == 1
    with pytest.raises(CaseError, match="vary"):
        under("aggregate", df.withColumn("x", F.col("row") * 1.0))
    with pytest.raises(CaseError, match="several values of 'strain'"):
        under("aggregate", df.withColumn("strain", F.col("row").cast("string")))
    with pytest.raises(CaseError, match="no row"):
        under("exclude", df.where("mouse_id = 'm'"))
    # Outside its scope a conflict is neither seen nor acted on.
    assert under("exclude", df, F.col("row") != 1)[1]["status"] == "NO_CONFLICTS"


def test_tied_labels_are_refused(spark):
    df = spark.createDataFrame([(0, "a", 0), (1, "a", 1), (2, "b", 1), (3, "b", 1), (4, "b", 0)], "row int, id string, y int")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "_id string")
    assert rows(audits.aggregated(df, "id", "y", ids("b"), F.lit(True), "row", True)) == [(0, "a", 0), (1, "a", 1), (2, "b", 1)]
    with pytest.raises(Exception, match="tied labels of a"):
        audits.aggregated(df, "id", "y", ids("a"), F.lit(True), "row", True).collect()


def test_audit_and_findings_of_a_troubled_table(spark):
    df = spark.createDataFrame([(0, "m", "s", 1.0, None), (1, "m", "t", float("inf"), None), (2, None, "s", None, None)], "row int, mouse_id string, strain string, y double, x double")
    audit = readiness.audit_table(df, CASE, "row")
    found = {f.code: f.status for f in readiness.findings(audit, CASE)}
    assert found == {
        "unconfirmed_roles": "ACTION_REQUIRED", "no_observed_modeled_features": "ACTION_REQUIRED", "target_missing": "ACTION_REQUIRED", "non_finite_target": "ACTION_REQUIRED", "invalid_continuous_target_support": "ACTION_REQUIRED", "missing_values": "WARNING",
        "uninformative_modeled_features": "WARNING", "entity_identifier_missing:mouse": "ACTION_REQUIRED", "repeated_entity:mouse": "WARNING", "identity_conflict:mouse": "ACTION_REQUIRED", "measurement_reliability_not_assessable": "NOT_ASSESSABLE",
        "missing_high_value_metadata": "NOT_ASSESSABLE", "declared_target_support": "INFO",
    }
    with pytest.raises(CaseError, match="BLOCKED by unconfirmed_roles"):
        readiness.require_ready(readiness.findings(audit, CASE))
    pending = changed(CASE, entities={"mouse": {**CASE.entities["mouse"], "identity_conflict_policy": "exclude"}})
    status = lambda late: next(f.status for f in readiness.findings(audit, pending, policies_pending=late) if f.code == "identity_conflict:mouse")
    assert (status(True), status(False)) == ("WARNING", "ACTION_REQUIRED")


@pytest.mark.parametrize(("statuses", "gate"), [([], "READY"), (["INFO"], "READY"), (["WARNING"], "READY_WITH_LIMITS"), (["NOT_ASSESSABLE", "INFO"], "READY_WITH_LIMITS"), (["WARNING", "ACTION_REQUIRED"], "BLOCKED")])
def test_gate(statuses, gate):
    found = [readiness.Finding(s, f"c{i}", "", "", "") for i, s in enumerate(statuses)]
    assert readiness.readiness([*found, *found])["status"] == gate
    assert len(readiness.readiness([*found, *found])["limiting"]) == sum(s in ("WARNING", "NOT_ASSESSABLE") for s in statuses)
    with pytest.raises(ValueError, match="unknown finding"):
        readiness.readiness([readiness.Finding("ODD", "c", "", "", "")])


# --- partitions -----------------------------------------------------------------------------------------------------


def test_splits_keep_every_row(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else f"g{i % 4}", None if i % 4 == 0 else f"2024-01-{i + 1:02d}") for i in range(12)], "row int, `key` string, `at time` string")
    for split in (splits.random_rows(df, "row", 3), splits.whole_groups(df, "row", "key", 3), splits.by_time(df, "row", "at time"), splits.double_cold(df, "row", "key", "key", 3)):
        assert sorted(r.row_id for r in split.collect()) == list(range(12))
    timed = {r.row_id: r.part for r in splits.by_time(df, "row", "at time").collect()}
    assert [i for i, p in timed.items() if p == "test"] and all(timed[i] == "test" for i in (0, 4, 8)) and sum(p == "train" for p in timed.values()) == 9
    grouped = df.join(splits.whole_groups(df, "row", "key", 3).withColumnRenamed("row_id", "row"), "row")
    assert all(r.n == 1 for r in grouped.groupBy("key").agg(F.count_distinct("part").alias("n")).collect())


def test_permutation_with_missing_groups(spark):
    df = spark.createDataFrame([(i, None if i < 4 else f"g{i // 4}", float(i)) for i in range(14)], "row int, g string, v double")
    got = {r.row_id: r.permuted for r in splits.permute_within(df, "row", "g", "v", 5).collect()}
    assert sorted(got.values()) == [float(i) for i in range(14)]
    block = lambda i: -1 if i < 4 else i // 4
    for g in (-1, 1, 2):  # three groups of four rows hand on whole blocks, the last one shuffles inside
        assert len({block(int(got[i])) for i in range(14) if block(i) == g}) == 1
    assert {block(int(got[i])) for i in (12, 13)} == {3}
    assert sorted(r.permuted for r in splits.permute_within(df, "row", None, "v", 5).collect()) == [float(i) for i in range(14)]


def test_scopes_and_errors(spark):
    df = spark.createDataFrame([(0, "Train", "hold"), (1, "TEST", "train"), (2, None, "x")], "row int, a string, b string")
    both = changed(CASE, generalization_scenarios=[{"name": "a", "strategy": "supplied", "split_column": "a"}, {"name": "b", "strategy": "supplied", "split_column": "b"}])
    assert rows(df.where(splits.development_scope(df, both)).select("row")) == [(0,), (1,)]
    with pytest.raises(CaseError, match="consistent"):
        splits.development_scope(df, both, consistent=True)
    with pytest.raises(CaseError, match="no development row"):
        splits.development_scope(df.where("row = 2"), both)
    with pytest.raises(CaseError, match="missing supplied"):
        splits.development_scope(df.drop("b"), both)
    with pytest.raises(CaseError, match="leaves 0 train"):
        splits.require_both_sides(splits.supplied(df.where("row = 1"), "row", "a"), both.generalization_scenarios[0])
    with pytest.raises(CaseError, match="column that group needs"):
        splits.create_split(df, changed(CASE, generalization_scenarios=[{"name": "g", "strategy": "group", "group_column": "zz"}]).generalization_scenarios[0], 1, "row")
    grouped = changed(CASE, generalization_scenarios=[{"name": "g", "strategy": "group", "group_column": "mouse_id"}])
    splits.require_isolation(grouped, grouped.generalization_scenarios[0], {"mouse": 0}, None)
    with pytest.raises(CaseError, match="2 mouse identifiers cross"):
        splits.require_isolation(grouped, grouped.generalization_scenarios[0], {"mouse": 2}, None)
    locked = changed(CASE, generalization_scenarios=[{"name": "s", "strategy": "supplied", "split_column": "a"}], holdout={"enabled": True})
    with pytest.raises(CaseError, match="cross"):
        splits.require_isolation(locked, locked.generalization_scenarios[0], {"mouse": 1}, None)


def test_same_entities_across_contexts(spark):
    def status(train, test, kind="same_entity_across_context"):
        df = spark.createDataFrame([(i, e, c, p) for i, (e, c, p) in enumerate([(*x, "train") for x in train] + [(*x, "test") for x in test])], "row int, e string, c string, p string")
        s = changed(CASE, generalization_scenarios=[{"name": "s", "strategy": "random", "split_claim": {"kind": kind, "entity_column": "e", "context_column": "c"}}]).generalization_scenarios[0]
        return overlap.split_claim(df, "row", splits.supplied(df, "row", "p"), s.split_claim).first().status

    assert status([("u", "1"), ("v", "1")], [("u", "2")]) == "COMPATIBLE"
    assert status([("u", "1"), ("v", "1")], [("u", "2"), ("w", "2")]) == "INCOMPATIBLE"
    assert status([("u", "1")], [("u", "1")]) == "INCOMPATIBLE"
    assert status([("u", "1")], [("u", None)]) == "NOT_ASSESSABLE" == status([("u", "1")], [])
    assert status([("u", "1")], [("v", "1")], "unseen_entity") == "COMPATIBLE" and status([("u", "1")], [("v", None)], "unseen_entity") == "NOT_ASSESSABLE"


def test_empty_choices_are_equal(spark):
    assert overlap.near_duplicates()["status"] == "NOT_ASSESSABLE"
    chosen = spark.createDataFrame([(1, "g", "a"), (2, "g", "a"), (3, "g", "b")], "run int, grp string, candidate string")
    assert rows(stability.pairwise_jaccard(chosen).select("run_a", "run_b", "jaccard")) == [(1, 2, 1.0), (1, 3, 0.0), (2, 3, 0.0)]


# --- verdicts on errors, where less is better ------------------------------------------------------------------------


def test_ladder_for_errors(spark):
    case = changed(CASE, evaluation={"primary_metric": "rmse"}, thresholds={"supported_metric": 2.0, "limited_metric": 4.0})
    facts = [("good", 2.0, 9.0, 0.1), ("fair", 4.0, 9.0, 0.1), ("poor", 4.1, 9.0, 0.1), ("no_gain", 1.0, 1.0, 0.1)]
    df = spark.createDataFrame([(n, m, None, None, v, p) for n, m, v, p in facts], "name string, median double, sd double, random_median double, null_median double, p_value double")
    got = {r.name: r.s for r in df.select("name", verdicts.ladder(case, F.lit(True)).alias("s")).collect()}
    assert got == {"good": "SUPPORTED", "fair": "SUPPORTED_WITH_LIMITS", "poor": "INSUFFICIENT_EVIDENCE", "no_gain": "INSUFFICIENT_EVIDENCE"}


# --- sources, sinks, discovery, ledger --------------------------------------------------------------------------------


def test_reading_and_digests(spark, tmp_path):
    (tmp_path / "t.TSV").write_text("a\tb\n1\tx\n")
    assert io.read_table(spark, str(tmp_path / "t.TSV")).first().asDict() == {"a": 1, "b": "x"}
    with pytest.raises(ValueError, match="unsupported suffix"):
        io.read_table(spark, "t.feather")
    df = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "a int, b string")
    assert io.dataset_fingerprint(df) == io.dataset_fingerprint(df.orderBy("b")) != io.dataset_fingerprint(df.limit(2))
    assert sorted(r._row_id for r in io.with_row_number(df).collect()) == [0, 1, 2]
    assert rows(io.with_row_number(df)) == rows(io.with_row_number(df.repartition(3)))
    assert json.loads(io.to_text({"b": float("inf"), "a": [1.5, float("nan")], "c": 1e400})) == {"a": [1.5, None], "b": None, "c": None}
    (tmp_path / "f").write_bytes(b"abc")
    io.require_checksum(str(tmp_path / "f"), io.file_checksum(str(tmp_path / "f")), "f")
    with pytest.raises(ValueError, match="checksum of f"):
        io.require_checksum(str(tmp_path / "f"), "0", "f")


def test_history_of_a_holdout(spark, tmp_path):
    ask = lambda reason="": ledger.request_access(spark, str(tmp_path / "h"), "sum", 2, actor="someone", purpose="p", case_fingerprint="c", reason=reason)
    assert [ask()["number"], ask()["number"]] == [1, 2]
    with pytest.raises(PermissionError, match="access 3"):
        ask()
    assert len(ledger.history(spark, str(tmp_path / "h"), "sum")) == 2 and not ledger.history(spark, str(tmp_path / "h"), "other")
    third = ask("a second assay")
    assert (third["number"], third["beyond_limit"], third["reason"]) == (3, True, "a second assay")
    assert not sinks.append_event(spark, str(tmp_path / "h" / "sum"), 3, {})


def test_guesses_and_cards(spark):
    df = spark.createDataFrame([("p", "u1", "lo", 0, 1.5, 3), ("p", "u2", "hi", 1, 2.5, 4), ("q", "u3", "lo", 1, 2.5, 5)], "site string, unit string, `dose level` string, flag int, mass double, grid_id int")
    part = {}
    for g in discovery.guesses(discovery.column_evidence(df)):
        assert g["confirmed"] is False
        part.setdefault(g["part"], []).append(g["column"])
    assert part == {"numeric_target": ["grid_id"], "categorical_target": ["site", "unit", "dose level", "flag", "mass"], "identifier": ["unit", "grid_id"]}
    families = [c["family"] for c in discovery.claim_cards(df.columns, discovery.guesses(discovery.column_evidence(df)))]
    assert families.count("supervised_classification") == 5 and "pairwise_prediction" in families and "dose_or_time_response" in families and "longitudinal_prediction" not in families
    case = discovery.provisional_case(df, "c", "t.csv")
    assert (case.task.target_column, case.entities["sample"].id_column, case.features.include) == ("grid_id", "grid_id", ["site", "unit", "dose level", "flag", "mass"])


def test_adapters_refuse_what_is_wrong(spark):
    with pytest.raises(CaseError, match="missing"):
        adapters.davis(spark.createDataFrame([(1,)], "Drug_ID int"))
    with pytest.raises(CaseError, match="both classes"):
        adapters.barrier(spark.createDataFrame([(1, "C", 1)], "Drug_ID int, Drug string, Y int"))
    with pytest.raises(CaseError, match="labels other"):
        adapters.barrier(spark.createDataFrame([(1, "C", 2)], "Drug_ID int, Drug string, Y int"))
    raw = spark.createDataFrame([tuple(range(len(adapters.VOICE)))], ", ".join(f"`{c}` double" for c in adapters.VOICE).replace("double", "int"))
    assert adapters.voice(raw)[1]["participant_count"] == 1
    with pytest.raises(CaseError, match="missing values"):
        adapters.voice(raw.withColumn("PPE", F.lit(None).cast("double")))
    with pytest.raises(CaseError, match="1 rows, expected 2"):
        adapters.solubility(spark.createDataFrame([("CC",)], "s string"), "s", F.trim, rows=2)


def test_adapter_cache_checks_its_table(spark, tmp_path):
    build = lambda: (spark.createDataFrame([(1,)], "a int"), {"adapter": "x"})
    df, facts = adapters.cached(spark, str(tmp_path / "c"), build)
    assert adapters.cached(spark, str(tmp_path / "c"), lambda: 1 / 0)[1] == facts and df.count() == 1
    sinks.write_table(spark.createDataFrame([(2,)], "a int"), str(tmp_path / "c" / "table.parquet"))
    with pytest.raises(ValueError, match="not the one"):
        adapters.cached(spark, str(tmp_path / "c"), build)


# --- synthetic cases ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", sorted(synthetic.SHAPES))
def test_synthetic_tables(spark, kind):
    df = synthetic.synthetic(spark, kind)
    groups, size = synthetic.SHAPES[kind]
    group = next(iter(synthetic.synthetic_case(kind, "p").entities.values())).id_column
    assert (df.count(), df.select(group).distinct().count()) == (groups * size, groups)
    assert rows(df) == rows(synthetic.synthetic(spark, kind).repartition(3)) != rows(synthetic.synthetic(spark, kind, 7))
    corr = lambda a, b: df.agg(F.corr(a, b)).first()[0]
    if kind == "stable":
        assert corr("x1", "y") > 0.7 and corr("x2", "y") < -0.3
    if kind == "no_signal":
        assert abs(corr("x1", "y")) < 0.2
    if kind == "leakage":
        assert df.groupBy("entity_id").agg(F.stddev("y").alias("s")).agg(F.max("s")).first()[0] < 0.1


def test_models_learn(spark):
    df = synthetic.synthetic(spark, "stable").withColumn("row", F.monotonically_increasing_id())
    train, test = df.where("sample_id < 'S0360'"), df.where("sample_id >= 'S0360'")
    rho = {}
    for name in ("dummy", "elastic_net", "nearest_neighbour"):
        fitted = models.Fitted(name, "regression", 1, "standard", train, ["x1", "x2", "target_id"], "y")
        rho[name] = metrics.regression_metrics(fitted.predict(test).withColumnRenamed("y", "y_true"), "y_true", "y_pred").first().pearson
    assert rho["dummy"] is None and rho["elastic_net"] > 0.95 and rho["nearest_neighbour"] > 0.8
    flags = df.withColumn("y", (F.col("y") > 0).cast("int"))
    fitted = models.Fitted("logistic", "binary_classification", 1, "smoke", flags, ["x1", "x2"], "y")
    assert metrics.classification_metrics(fitted.predict(flags), "y", "y_pred").first().roc_auc > 0.95
    with pytest.raises(CaseError, match="no model"):
        models.suite("regression", "smoke", {"logistic"})


def test_graph_contract(spark):
    case = parse_case({
        "case_id": "c", "data": {"path": "t"}, "task": {"kind": "binary_classification", "prediction_unit": "mol", "target_column": "y"}, "entities": {"mol": {"id_column": "mol_id", "representation_column": "shape", "identity_conflict_policy": "exclude"}},
        "features": {"include": ["shape"], "smiles_column": "shape"}, "evaluation": {"bootstrap_unit": "mol_id"}, "generalization_scenarios": [{"name": "g", "strategy": "group", "group_column": "mol_id"}],
        "graph_readiness": {"structure_column": "shape", "independent_unit_column": "mol_id", "node_features": ["degree"], "edge_features": ["stereo"], "evaluation_scenarios": ["g"], "minimum_independent_units_per_class": 1},
    })
    df = spark.createDataFrame([(0, "a", "c1", 0), (1, "b", "C1 ", 1), (2, "b", "c1", 1)], "row int, mol_id string, shape string, y int")
    canonical = F.nullif(F.upper(F.trim("shape")), F.lit("BAD"))
    got = graphs.contract_audit(df, case, "RESOLVED", canonical, "row")
    assert (got["status"], got["shared_graphs"], got["class_counts"]) == ("VALID_CONTRACT", 1, {"0": 1, "1": 1})
    assert graphs.contract_audit(df, case, "ACKNOWLEDGED", canonical, "row")["status"] == "UNMET_REQUIREMENTS"
    assert graphs.contract_audit(df, case, "RESOLVED", None, "row")["status"] == "NOT_ASSESSABLE"
    with pytest.raises(CaseError, match="1 structures"):
        graphs.contract_audit(df.withColumn("shape", F.when(F.col("row") == 0, "bad").otherwise(F.col("shape"))), case, "RESOLVED", canonical, "row")


def test_candidates():
    assert autoprobe.parse_candidate({"candidate_id": "c", "model": "dummy"}).minimum_delta == 0.01
    for wrong in ({"model": "other"}, {"model": "dummy", "minimum_delta": -1}, {"model": "dummy", "maximum_runtime_seconds": float("nan")}, {"model": "dummy", "more": 1}):
        with pytest.raises(CaseError):
            autoprobe.parse_candidate({"candidate_id": "c", **wrong})
