"""A case from table to verdicts: gate, partitions, overlap, baselines with their controls, stability, capability.

The gate comes first and is passed again for every partition, so no model is fitted on data that a finding blocks. Tables that several steps read are
written to the output once; everything after the fits runs over records and predictions.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ledger
from .contract import CaseError, Section, as_document, case_fingerprint
from .functions.columns import named
from .operators import audits, graphs, metrics, models, overlap, readiness, splits, stability, verdicts
from .operators.profile import column_profile, most_missing, preview
from .provenance import provenance
from .roles import curve_group, entity_ids, metadata_gaps, ranking_candidate, ranking_group, require_columns, role_names
from .sources import sinks
from .sources.io import dataset_fingerprint, read_table, with_row_number

ROW = "_row_id"
CURVE = "scenario string, representation string, model string, independent_group string, group_count long, train_rows long, primary_metric double"


def metric_names(case: Section) -> list[str]:
    """The metrics that a run records: those of the task, and rankings within groups."""
    own = ["balanced_accuracy", "roc_auc", "average_precision", "log_loss"] if case.task.kind == "binary_classification" else ["mae", "rmse", "pearson", "spearman", "kendall_tau"]
    return list(dict.fromkeys([*own, "median_spearman", "median_ndcg", case.evaluation.primary_metric]))


def measure(predicted: DataFrame, case: Section) -> dict:
    """The metrics of a table with y_true and y_pred; without a finite pair, none."""
    if case.task.kind == "binary_classification":
        return metrics.classification_metrics(predicted, "y_true", "y_pred", case.evaluation.classification_threshold).first().asDict()
    found = metrics.regression_metrics(predicted, "y_true", "y_pred").first().asDict()
    return found | {"kendall_tau": metrics.kendall_tau(predicted, "y_true", "y_pred").first().kendall_tau if found["n"] else None}


def load(spark: SparkSession, case: Section) -> DataFrame:
    """The case's table with a number for each row; missing declared columns are an error."""
    df = read_table(spark, case.data.path)
    require_columns(case, df.columns)
    return with_row_number(df, ROW)


def profile_case(spark: SparkSession, case: Section, output: str) -> dict:
    """``eda``: the audit, findings and column profile of the development rows. No model is fitted; a case with a holdout is refused before anything is read."""
    if case.holdout.enabled:
        raise CaseError("a case with a holdout is not profiled: make one without its rows")
    df = load(spark, case)
    rows, left_out = readiness.development(df, case)
    audit = readiness.audit_table(rows, case, ROW)
    found = readiness.findings(audit, case)
    gate = readiness.readiness(found)
    data = rows.drop(ROW)
    sinks.write_table(column_profile(data, roles=role_names(case, data.columns)), f"{output}/column_profile.parquet")
    profile = spark.read.parquet(f"{output}/column_profile.parquet")
    for name, figure in [("missingness", most_missing(profile)), ("target_distribution", sinks.histogram(data, case.task.target_column)), *((f"repetition_{c}", sinks.repetition(data, c)) for c in entity_ids(case, data.columns))]:
        sinks.write_table(figure, f"{output}/figures/{name}.parquet")
    scope = {"rows_loaded": df.count(), "rows_profiled": rows.count(), "rows_excluded": left_out, "model_trained": False, "holdout_accessed": False}
    result = {"schema_version": 1, "mode": "profile", "case": as_document(case), "scope": scope, "source": sinks.read_json(spark, f"{case.data.path.rpartition('/')[0]}/source.json") or {}, "audits": audit, "findings": [f._asdict() for f in found], "readiness": gate}
    columns = ["column_name", "roles", "physical_type", "n_missing", "missing_fraction", "n_unique", "median", "top_count"]
    sections = [("Scope", ["fact", "value"], [*scope.items(), ("readiness", gate["status"])]), ("Findings", list(readiness.Finding._fields), [list(f) for f in found]), ("Columns", columns, [list(r) for r in preview(profile).collect()])]
    sinks.write_report(spark, output, "eda", f"Profile of {case.case_id}", sections, result)
    return result


class Run:
    """One run of a case. Steps are methods in the order in which ``evaluate_case`` calls them."""

    def __init__(self, spark: SparkSession, case: Section, output: str, budget: str, allowed: set[str] | None, structures: dict[str, Callable[[Column], Column]]):
        self.spark, self.case, self.output, self.budget, self.structures = spark, case, output, budget, structures
        self.allowed = models.allowlist(case, allowed)
        self.seeds = models.seeds(case, budget)
        self.found = readiness.declaration_findings(case)
        self.partitions: dict[tuple[str, int], DataFrame] = {}
        self.hashes: dict[str, str] = {}
        self.members: dict[tuple[str, int], str] = {}
        self.sizes: dict[tuple[str, int], dict] = {}
        self.records: list[tuple] = []
        self.curve: list[tuple] = []

    def derived(self, kind: str, column: str | None) -> Column | None:
        """What a structure column becomes, if the caller has given a function for it: its canonical form, its scaffold or its bits."""
        return self.structures[kind](named(column)) if column and kind in self.structures else None

    def table(self) -> None:
        """The rows after identity-conflict policies, which act on development rows alone; then the gate for these."""
        case, df = self.case, load(self.spark, self.case)
        acts = any(e.identity_conflict_policy in ("exclude", "aggregate") for e in case.entities.values())
        scope = splits.development_scope(df, case, consistent=acts)
        resolved, self.identity = audits.apply_policies(df, case, ROW, scope)
        sinks.write_table(resolved, f"{self.output}/rows.parquet")
        self.df = self.spark.read.parquet(f"{self.output}/rows.parquet")
        rows, _ = readiness.development(self.df, case)
        self.found = readiness.findings(readiness.audit_table(rows, case, ROW), case, policies_pending=False)
        readiness.require_ready(self.found)

    def split(self) -> None:
        """Partitions of every scenario and seed with their digests, and the gate for both sides of each."""
        for s in self.case.generalization_scenarios:
            for seed in self.seeds:
                path = f"{self.output}/split_manifests/{s.name}__seed-{seed}.parquet"
                sinks.write_table(splits.create_split(self.df, s, seed, ROW, scaffold=self.derived("scaffold", s.group_column)), path)
                part = self.spark.read.parquet(path)
                self.sizes[s.name, seed] = splits.require_both_sides(part, s)
                marks = splits.fingerprints(part, s.name, s.strategy, seed).first()
                self.partitions[s.name, seed], self.hashes[f"{s.name}:{seed}"], self.members[s.name, seed] = part, marks.manifest, marks.membership
                self.found += readiness.partition_findings(self.df, self.case, ROW, part, s.name, seed)
        self.gate = readiness.require_ready(self.found)

    def overlaps(self) -> None:
        """What every partition shares, its claim, and the units of each class on its test side. Protected ids that cross are an error."""
        case, parts, support = self.case, [], []
        binary = case.task.kind == "binary_classification"
        graph = self.derived("canonical", case.graph_readiness.structure_column) if case.graph_readiness else None
        for s in case.generalization_scenarios:
            for seed in self.seeds:
                part = self.partitions[s.name, seed]
                claim = overlap.split_claim(self.df, ROW, part, s.split_claim)
                audit = overlap.overlap_audit(self.df, case, ROW, part).crossJoin(claim.withColumnRenamed("status", "claim_status"))  # one row
                parts.append(audit.select(F.lit(s.name).alias("scenario"), F.lit(seed).alias("seed"), "kind", "subject", "shared", "test_fraction", "claim_status"))
                if graph is not None:
                    shared = graphs.graph_overlap(self.df, part, ROW, graph)
                    parts.append(shared.select(F.lit(s.name).alias("scenario"), F.lit(seed).alias("seed"), F.lit("graph").alias("kind"), F.lit("").alias("subject"), "shared", "test_fraction", F.lit(None).cast("string").alias("claim_status")))
                if binary:
                    test = self.df.join(part.where("part = 'test'").select(F.col("row_id").alias(ROW)), ROW, "left_semi")
                    unit = case.evaluation.bootstrap_unit
                    support.append(audits.class_support(test, case.task.target_column, unit).select(F.lit(s.name).alias("scenario"), F.lit(seed).alias("seed"), "class", "n_units", F.lit(unit or "rows").alias("count_unit")))
        sinks.write_table(reduce(DataFrame.unionByName, parts), f"{self.output}/overlap.parquet")
        self.shared = self.spark.read.parquet(f"{self.output}/overlap.parquet")
        rows = self.shared.collect()  # a few rows for each partition
        for s in case.generalization_scenarios:
            own = [r for r in rows if r.scenario == s.name]
            worst = lambda kind: {r.subject: max(x.shared for x in own if (x.kind, x.subject) == (r.kind, r.subject)) for r in own if r.kind == kind}  # noqa: B023, E731
            splits.require_isolation(case, s, worst("entity"), max(worst("pair").values(), default=None))
        schema = "scenario string, seed int, class string, n_units long, count_unit string"
        sinks.write_table(reduce(DataFrame.unionByName, support) if support else self.spark.createDataFrame([], schema), f"{self.output}/class_support.parquet")
        self.support = self.spark.read.parquet(f"{self.output}/class_support.parquet")

    def audit(self) -> None:
        """The audit of the rows that partitions use."""
        used = splits.modelling_rows(list(self.partitions.values())).select(F.col("row_id").alias(ROW))
        rows = self.df.join(used, ROW, "left_semi")
        self.audits = readiness.audit_table(rows, self.case, ROW)
        self.audits["inventory"] |= {"rows_after_policies": self.identity["model_rows"], "rows_in_no_partition": self.identity["model_rows"] - self.audits["inventory"]["rows"]}
        self.audits["identity_consistency"] = self.identity
        if self.case.graph_readiness is not None:
            self.audits["graph_contract"] = graphs.contract_audit(rows, self.case, self.identity["status"], self.derived("canonical", self.case.graph_readiness.structure_column), ROW)

    def fit(self) -> None:
        """Every model on every partition and representation, its permuted controls, learning curves, and the means of entities."""
        case, target = self.case, self.case.task.target_column
        frames = models.feature_frames(self.df, case, fingerprint=self.derived("fingerprint", case.features.smiles_column))
        self.representations = list(frames)
        predictions = []
        group = ranking_group(case)
        sign = models.ranking_sign(case)
        for s in case.generalization_scenarios:
            for seed in self.seeds:
                part = self.partitions[s.name, seed]
                sizes, member = self.sizes[s.name, seed], self.members[s.name, seed]
                for representation, frame in frames.items():
                    features = models.feature_names(frame, self.df, case)
                    rows = frame.join(part.where("part <> 'excluded'").select(F.col("row_id").alias(ROW), F.col("part").alias("_part")), ROW)
                    train, test = rows.where("_part = 'train'").drop("_part"), rows.where("_part = 'test'").drop("_part")
                    for name in models.suite(case.task.kind, self.budget, self.allowed):
                        began = time.perf_counter()
                        fitted = models.Fitted(name, case.task.kind, seed, self.budget, train, features, target)
                        run_id = f"{s.name}__{representation}__{name}__seed-{seed}"
                        out = models.prediction_rows(fitted.predict(rows.drop("_part")), ROW, target, part, run_id=run_id, scenario=s.name, model=name, representation=representation)
                        own = [c for c in dict.fromkeys((*entity_ids(case, out.columns), group, ranking_candidate(case, out.columns))) if c and c in out.columns]
                        out = out.select(*(named(c).cast("string").alias(c) for c in own if c != ROW), ROW, "y_true", "y_pred", "is_test", "run_id", "scenario", "model", "representation")
                        path = f"{self.output}/work/{run_id}.parquet"
                        sinks.write_table(out, path)
                        out = self.spark.read.parquet(path)
                        predictions.append(out)
                        tested = out.where("is_test")
                        values = measure(tested, case)
                        if group and group in out.columns:
                            signed = tested.withColumns({"y_true": sign * F.col("y_true"), "y_pred": sign * F.col("y_pred")})
                            values |= metrics.group_ranking(signed, group, "y_true", "y_pred", min(case.decision.k)).first().asDict()
                        self.records.append(models.record(s, seed, name, representation, sizes, member, values, fitted.configuration, time.perf_counter() - began))
                        if name != "dummy":
                            self.controls(s, seed, name, representation, features, train, test, sizes, member)
                    if seed == self.seeds[0]:
                        self.learning_curve(s, seed, representation, features, train, test)
                ids = entity_ids(case, self.df.columns)
                if case.task.kind != "binary_classification" and len(ids) >= 2:
                    means = models.entity_means(self.df, ROW, part, target, *ids[:2])
                    for name, column in (("global_mean", "global_mean"), ("seen_left_mean", "left_mean"), ("seen_right_mean", "right_mean"), ("additive_entity_mean", "additive")):
                        self.records.append(models.record(s, seed, name, "not_applicable", sizes, member, measure(means.select("y_true", F.col(column).alias("y_pred")), case), {"type": name}, 0.0))
        self.predictions = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), predictions)
        sinks.write_predictions(self.predictions, f"{self.output}/predictions.parquet")
        self.predictions = sinks.read_predictions(self.spark, f"{self.output}/predictions.parquet")
        self.experiments = models.records_frame(self.spark, self.records, metric_names(case))
        sinks.write_table(self.experiments, f"{self.output}/experiments.parquet")
        sinks.write_table(self.spark.createDataFrame(self.curve, CURVE), f"{self.output}/learning_curve.parquet")

    def controls(self, s, seed, name, representation, features, train, test, sizes, member) -> None:
        """The model again on permuted training labels, once for each draw."""
        case, target, unit = self.case, self.case.task.target_column, self.case.evaluation.bootstrap_unit
        for draw in range(case.evaluation.permutation_draws):
            began = time.perf_counter()
            labels = splits.permute_within(train.join(self.df.select(ROW, named(unit).alias("_unit")), ROW) if unit else train, ROW, "_unit" if unit else None, target, seed + 10_000 + 1_000 * draw)
            shuffled = train.drop(target).join(labels.select(F.col("row_id").alias(ROW), F.col("permuted").alias(target)), ROW)
            fitted = models.Fitted(name, case.task.kind, seed, self.budget, shuffled, features, target)
            values = measure(fitted.predict(test).select(named(target).alias("y_true"), "y_pred"), case)
            method = verdicts.GROUP_METHOD if unit else verdicts.ROW_METHOD
            self.records.append(models.record(s, seed, name, representation, sizes, member, values, fitted.configuration, time.perf_counter() - began, draw, method, unit))

    def learning_curve(self, s, seed, representation, features, train, test) -> None:
        """A linear model (or the first that is allowed) on nested subsets of the training groups; a subset that a finding blocks is left out."""
        case, group = self.case, curve_group(s)
        if not group or group not in self.df.columns:
            return
        names = models.suite(case.task.kind, self.budget, self.allowed)
        linear = [n for n in ("logistic", "elastic_net") if n in names] or [n for n in names if n != "dummy"]
        if not linear:
            return
        grouped = train.join(self.df.select(ROW, named(group).alias("_group")), ROW)
        subsets = splits.nested_subsets(grouped, ROW, "_group", seed)
        n = {r.fraction: r for r in splits.subset_sizes(subsets).collect()}  # three rows
        for fraction in sorted(n):
            ids = subsets.where(F.col("least") <= fraction).select(F.col("row_id").alias(ROW))
            audit = readiness.audit_table(self.df.join(ids, ROW, "left_semi"), case, ROW)
            if not readiness.readiness(readiness.findings(audit, case, policies_pending=False))["may_fit"]:
                continue
            fitted = models.Fitted(linear[0], case.task.kind, seed, self.budget, train.join(ids, ROW, "left_semi"), features, case.task.target_column)
            value = measure(fitted.predict(test).select(named(case.task.target_column).alias("y_true"), "y_pred"), case).get(case.evaluation.primary_metric)
            self.curve.append((s.name, representation, linear[0], group, n[fraction].n_groups, n[fraction].n_rows, value))

    def judge(self) -> None:
        """Rankings, stability, verdicts and what depends on the representation."""
        case, metric = self.case, self.case.evaluation.primary_metric
        group, candidate = ranking_group(case), ranking_candidate(case, self.predictions.columns)
        self.ranking = None
        if group and candidate and group in self.predictions.columns:
            held = self.predictions.where("model <> 'dummy'")
            rankings = stability.as_rankings(held, group, candidate)
            sinks.write_table(stability.ranking_results(rankings, case.decision.k, lower=not case.task.higher_is_better), f"{self.output}/ranking_stability.parquet")
            self.ranking = self.spark.read.parquet(f"{self.output}/ranking_stability.parquet")
            chosen = stability.top_k(rankings, min(case.decision.k), lower=not case.task.higher_is_better)
            sinks.write_table(stability.selection_probability(chosen), f"{self.output}/selection_probability.parquet")
        kept = self.experiments.where(F.col("representation") != "not_applicable")
        pair = self.audits["independence"]["pair_structure"]
        clashes = overlap.identity_conflict_summary(list(self.audits["independence"]["entities"].values()), pair["conflicting_pairs"] if pair else None)
        facts = verdicts.scenario_facts(kept, case).join(overlap.overlap_summary(self.shared, case), "scenario", "left").join(overlap.class_floor(self.support), "scenario", "left")
        facts = facts.withColumns({k: F.lit(v) for k, v in clashes.items()})
        sinks.write_table(verdicts.capped(facts, case), f"{self.output}/scenario_verdicts.parquet")
        self.scenarios = self.spark.read.parquet(f"{self.output}/scenario_verdicts.parquet")
        selection = None
        if case.decision.kind == "top_k_per_group" and self.ranking is not None:
            worst = self.scenarios.agg(F.max(F.greatest("exact", "pairs", "boundary")).alias("w")).first().w or 0
            selection = verdicts.selection_verdict(self.ranking, case, bool(any(clashes.values()) or worst))
        shared = verdicts.shared_verdicts(self.audits["measurement"]["status"], metadata_gaps(case))
        sinks.write_table(verdicts.verdict_matrix(self.scenarios.orderBy("position"), selection, shared, case), f"{self.output}/capability_matrix.parquet")
        self.capability = self.spark.read.parquet(f"{self.output}/capability_matrix.parquet")
        represented = self.capability.where("representation is not null").select(F.col("claim").alias("scenario"), "representation", "status", "median")
        sinks.write_table(stability.representation_sensitivity(represented, kept, metric), f"{self.output}/representation_sensitivity.parquet")
        self.sensitivity = self.spark.read.parquet(f"{self.output}/representation_sensitivity.parquet")
        self.axes = stability.decomposition(kept, metric)
        self.summary = stability.experiment_summary(kept, metric)


def evaluate_case(spark: SparkSession, case: Section, output: str, *, budget: str = "smoke", models_allowed: set[str] | None = None, holdout_reason: str = "", ledger_folder: str | None = None, structures: dict[str, Callable[[Column], Column]] | None = None) -> dict:
    """``run``: the whole evaluation, its tables and its report below ``output``. Blocking findings, protected ids that cross and a spent holdout are errors.

    structures: functions from a structure column to its ``canonical`` form, its ``scaffold`` or its ``fingerprint`` (an array of bits); what needs one that is not there cannot be assessed, or is an error.
    """
    readiness.require_ready(readiness.declaration_findings(case))
    began = time.perf_counter()
    access = []
    if case.holdout.enabled:
        if any(s.strategy != "supplied" for s in case.generalization_scenarios):
            raise CaseError("a holdout needs supplied splits")
        folder = ledger_folder or f"{case.data.path.rpartition('/')[0]}/holdout_access"
        checksum = dataset_fingerprint(read_table(spark, case.data.path))
        ledger.request_access(spark, folder, checksum, case.holdout.maximum_accesses, actor="probator", purpose=f"confirmation of {case.case_id}", case_fingerprint=case_fingerprint(case), reason=holdout_reason)
        access = ledger.history(spark, folder, checksum)
    run = Run(spark, case, output, budget, models_allowed, structures or {})
    for step in (run.table, run.split, run.overlaps, run.audit, run.fit, run.judge):
        step()
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]  # noqa: E731 (summaries of a few rows each)
    made = provenance(spark, case, dataset_fingerprint=run.audits["inventory"]["dataset_fingerprint"], split_hashes=run.hashes, runtime_seconds=time.perf_counter() - began)
    result = {
        "schema_version": 1, "case": as_document(case), "readiness": run.gate, "findings": [f._asdict() for f in run.found], "audits": run.audits, "split_overlap": rows(run.shared), "experiment_summary": rows(run.summary), "learning_curve": run.curve,
        "stability_decomposition": rows(run.axes), "ranking_stability": rows(run.ranking) if run.ranking is not None else "NOT_ASSESSABLE", "representation_sensitivity": rows(run.sensitivity), "capability_matrix": rows(run.capability), "scenario_verdicts": rows(run.scenarios),
        "holdout_access": access, "provenance": made,
    }
    sections = [("Verdicts", run.capability.columns, [list(r) for r in run.capability.collect()]), ("Findings", list(readiness.Finding._fields), [list(f) for f in run.found]), ("Experiments", run.summary.columns, [list(r) for r in run.summary.collect()]), ("Stability", run.axes.columns, [list(r) for r in run.axes.collect()])]
    sinks.write_report(spark, output, "report", f"Evidence for {case.case_id}", sections, result)
    sinks.write_json(spark, f"{output}/provenance.json", made)
    return result


def status_line(result: dict) -> str:
    """claim[representation]=status of every verdict."""
    return ", ".join(f"{v['claim']}{'[' + v['representation'] + ']' if v['representation'] else ''}={v['status']}" for v in result["capability_matrix"])


def assess_graphs(spark: SparkSession, development: str, external: str | None = None) -> dict:
    """``assess-graph-readiness``: the decision from the reports that runs have left in their folders."""
    report = sinks.read_json(spark, f"{development}/report.json")
    if report is None:
        raise CaseError(f"no report in {development}")
    contract = report["audits"].get("graph_contract") or {"status": graphs.UNDECLARED}
    chosen = contract.get("scenarios", [])
    verdict = spark.read.parquet(f"{development}/capability_matrix.parquet").withColumnRenamed("claim", "scenario")
    shared = spark.read.parquet(f"{development}/overlap.parquet").where(F.col("kind") == "graph").where(F.col("scenario").isin(chosen))
    support = spark.read.parquet(f"{development}/class_support.parquet").where(F.col("scenario").isin(chosen))
    crossing = graphs.overlap_status(shared.select("scenario", "seed", "shared"), support, contract.get("floor", 1), contract.get("unit", ""))
    summary = graphs.development_summary(verdict, spark.read.parquet(f"{development}/representation_sensitivity.parquet"), spark.read.parquet(f"{development}/learning_curve.parquet"), chosen)
    facts = summary.crossJoin(crossing.withColumnRenamed("status", "overlap_status")).withColumn("contract_status", F.lit(contract["status"]))  # one row each
    outside, other = None, None
    if external is not None:
        other = sinks.read_json(spark, f"{external}/report.json")
        if other is None:
            raise CaseError(f"no report in {external}")
        rows = spark.read.parquet(f"{external}/scenario_verdicts.parquet").withColumn("required", F.lit(other["case"]["thresholds"]["minimum_test_class_count"]).cast("long"))
        outside = graphs.external_summary(rows, other["case"]["thresholds"]["maximum_permutation_p_value"])
    facts = facts.crossJoin(outside.select("null_failure")) if outside is not None else facts.withColumn("null_failure", F.lit(False))
    result = graphs.envelope(graphs.assess(facts).first().asDict(), report["case"]["case_id"], report["provenance"], other["provenance"] if other else None)
    sinks.write_json(spark, f"{development}/graph_readiness.json", result)
    return result
