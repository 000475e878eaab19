"""Baselines: means of entities, and a small fixed set of models fitted by Spark's own library.

Features are numbers by the time a model sees them: numeric columns with the training median in place of what is missing, other columns one-hot over the
training fold's commonest categories. Everything is learned from the training fold alone.
"""

from __future__ import annotations

import json

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contract import CaseError, Section
from ..functions.columns import BUCKETS, finite, gram_vector, is_numeric, letter_shares, named
from ..functions.ordered import quantiles
from ..roles import modelled_columns

#: Categories of a column that are told apart; the rest is one more.
CATEGORIES = 200
NEIGHBOURS = 7
# Names of models, those of a smoke run, and the seeds it takes.
SMOKE = ("dummy", "elastic_net", "logistic", "extra_trees")
SMOKE_SEEDS = 2
SCALED = ("elastic_net", "logistic", "nearest_neighbour")
#: Rows of test times rows of train that nearest neighbours may compare.
MOST_COMPARISONS = 50_000_000


# --- means of entities --------------------------------------------------------------------------------------------


def entity_means(df: DataFrame, row: str, split: DataFrame, target: str, left: str, right: str) -> DataFrame:
    """(row_id, y_true, global_mean, left_mean, right_mean, additive) of the test rows; an id that training has not seen has no mean, so neither has the sum."""
    parted = df.join(split.select(F.col("row_id").alias("_rid"), F.col("part").alias("_part")), named(row) == F.col("_rid")).select(F.col("_rid").alias("row_id"), F.col("_part").alias("part"), finite(named(target)).alias("_y"), named(left).alias("_l"), named(right).alias("_r"))
    train, test = parted.where("part = 'train'"), parted.where("part = 'test'")
    # Sums of whole ten-thousandths: the order of rows does not show.
    mean = F.sum(F.col("_y").cast("decimal(18,4)")).cast("double") / F.count("_y")
    whole = train.agg(mean.alias("global_mean"))
    per = lambda c, name: train.where(F.col(c).isNotNull()).groupBy(c).agg(mean.alias(name))
    out = test.crossJoin(F.broadcast(whole)).join(per("_l", "left_mean"), "_l", "left").join(per("_r", "right_mean"), "_r", "left")  # one row
    return out.select("row_id", F.col("_y").alias("y_true"), "global_mean", "left_mean", "right_mean", (F.col("left_mean") + F.col("right_mean") - F.col("global_mean")).alias("additive"))


# --- features -----------------------------------------------------------------------------------------------------


def feature_frames(df: DataFrame, case: Section, *, fingerprint: Column | None = None) -> dict[str, DataFrame]:
    """Representation: the table with its feature columns in place of those they are made of. ``declared_features`` alone unless the case names representations.

    An entity's representation column becomes bits (``fingerprint``, an array, for the structure column under ``morgan``), letter shares if its name speaks of a sequence, a protein or a target, and else hashed character grams.
    """
    wanted = modelled_columns(case, df.columns)
    absent = sorted(set(wanted).difference(df.columns))
    if absent:
        raise CaseError(f"missing feature columns: {absent}")
    encode = sorted({e.representation_column for e in case.entities.values()}.intersection(wanted))
    out = {}
    for name in case.features.molecular_representations or ["declared_features"]:
        columns = {c: named(c) for c in wanted if c not in encode}
        for c in encode:
            if name == "morgan" and c == case.features.smiles_column:
                if fingerprint is None:
                    raise CaseError("morgan needs a function from structures to bits")
                bits = 1024
                columns |= {f"{c}_morgan_{i}": F.get(fingerprint, i).cast("double") for i in range(bits)}
            elif any(w in c.lower() for w in ("seq", "protein", "target")):
                columns |= {f"{c}_aa_{a}": x for a, x in letter_shares(named(c)).items()}
            else:
                vector = gram_vector(named(c))
                columns |= {f"{c}_char_{i}": F.get(vector, i) for i in range(BUCKETS)}
        own = [c for c in df.columns if c not in wanted]
        out[name] = df.select(*(named(c) for c in own), *(x.alias(n) for n, x in columns.items()))
    return out


def feature_names(frame: DataFrame, df: DataFrame, case: Section) -> list[str]:
    """The feature columns of a frame that ``feature_frames`` made."""
    wanted = set(modelled_columns(case, df.columns))
    return [c for c in frame.columns if c in wanted or c not in df.columns]


class Preparation:
    """What a training fold says about the features: medians, and the commonest categories."""

    def __init__(self, train: DataFrame, features: list[str]):
        self.numbers = [c for c in features if is_numeric(train, c)]
        self.others = [c for c in features if c not in self.numbers]
        self.medians, self.kinds = {}, {}
        if self.numbers:
            cells = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), finite(named(c)).alias("value")) for i, c in enumerate(self.numbers)))).alias("cell")
            counts = train.select(cells).where("cell.value is not null").groupBy("cell.i", "cell.value").agg(F.count("*").alias("n"))
            found = {r.i: r.m for r in quantiles(counts, {"m": 0.5}, ("i",)).collect()}  # one row a feature
            self.medians = {c: found[i] for i, c in enumerate(self.numbers) if i in found}  # a feature without any value is dropped
        if self.others:
            cells = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), named(c).cast("string").alias("v")) for i, c in enumerate(self.others)))).alias("cell")
            counts = train.select(cells).where("cell.v is not null").groupBy("cell.i", "cell.v").agg(F.count("*").alias("n"))
            top = counts.withColumn("_k", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("n"), "v"))).where(F.col("_k") <= CATEGORIES)
            for r in top.orderBy("i", "_k").collect():  # at most CATEGORIES a feature
                self.kinds.setdefault(self.others[r.i], []).append(r.v)

    def apply(self, df: DataFrame) -> DataFrame:
        """df with a vector ``features``. A missing category counts as the commonest, one that training has not seen as none."""
        columns = [F.coalesce(finite(named(c)), F.lit(m)) for c, m in self.medians.items()]
        for c, kinds in self.kinds.items():
            value = F.coalesce(named(c).cast("string"), F.lit(kinds[0]))
            columns += [(value == k).cast("double") for k in kinds]
        if not columns:
            raise CaseError("no feature has a value in the training fold")
        named_columns = {f"_f{i}": x for i, x in enumerate(columns)}
        return VectorAssembler(inputCols=list(named_columns), outputCol="features").transform(df.withColumns(named_columns)).drop(*named_columns)


# --- models -------------------------------------------------------------------------------------------------------


class _Constant:
    """Predicts the training mean, which for classes is the share of ones."""

    def __init__(self, value: float):
        self.value = value

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.lit(float(self.value)))


class _Neighbours:
    """The mean label of the nearest training rows: weighted by closeness for numbers, plain for classes. Every test row is held against every training row, so both must be small."""

    def __init__(self, train: DataFrame, binary: bool):
        self.train, self.binary, self.rows = train.select(vector_to_array("features").alias("_tx"), F.col("label").alias("_ty")), binary, train.count()

    def transform(self, df: DataFrame) -> DataFrame:
        n = df.count()
        if n * self.rows > MOST_COMPARISONS:
            raise CaseError(f"nearest_neighbour would compare {n} with {self.rows} rows: leave it out of the models")
        asked = df.withColumn("_x", vector_to_array("features")).withColumn("_id", F.monotonically_increasing_id()).persist()
        far = F.aggregate(F.zip_with("_x", "_tx", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        met = asked.select("_id", "_x").crossJoin(self.train).select("_id", F.sqrt(far).alias("_d"), "_ty")  # bounded by MOST_COMPARISONS
        near = met.groupBy("_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("_d", "_ty"))), 1, NEIGHBOURS).alias("_n")).select("_id", F.explode("_n").alias("n"))
        weight = F.lit(1.0) if self.binary else F.when(F.min("n._d").over(Window.partitionBy("_id")) == 0, (F.col("n._d") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("n._d")))
        got = near.withColumn("_w", weight).groupBy("_id").agg((F.sum(F.col("_w") * F.col("n._ty")) / F.sum("_w")).alias("prediction"))
        return asked.join(got, "_id").drop("_id", "_x")


def suite(kind: str, budget: str, allowed: set[str] | None = None) -> list[str]:
    """Names of the models for a task. ``extra_trees`` is a random forest here: Spark has no extremely randomised trees. No model left is an error."""
    names = ["dummy", "logistic" if kind == "binary_classification" else "elastic_net", "extra_trees", "hist_gradient_boosting", "nearest_neighbour"]
    chosen = [n for n in names if (budget != "smoke" or n in SMOKE) and (allowed is None or n in allowed)]
    if not chosen:
        raise CaseError("no model is left for this task and budget")
    return chosen


def allowlist(case: Section, asked: set[str] | None = None) -> set[str] | None:
    """The models that both the case and the caller allow; None if neither limits them."""
    declared = set(case.evaluation.model_allowlist) or None
    return declared if asked is None else asked if declared is None else asked & declared


def seeds(case: Section, budget: str) -> list[int]:
    return case.evaluation.seeds[:SMOKE_SEEDS] if budget == "smoke" else case.evaluation.seeds


def estimator(name: str, kind: str, seed: int, budget: str):
    binary = kind == "binary_classification"
    trees = {"featuresCol": "features", "labelCol": "label", "seed": seed}
    if name == "extra_trees":
        forest = {**trees, "numTrees": 80 if binary or budget == "smoke" else 200, "minInstancesPerNode": 3, "maxDepth": 10}
        return RandomForestClassifier(**forest) if binary else RandomForestRegressor(**forest)
    if name == "hist_gradient_boosting":
        return (GBTClassifier if binary else GBTRegressor)(**trees, maxIter=80)
    if name == "logistic":
        return LogisticRegression(regParam=1e-3, maxIter=1000, standardization=False)
    return LinearRegression(regParam=0.01, elasticNetParam=0.1, maxIter=1000, standardization=False)


class Fitted:
    """A model on a training fold: its preparation, its scaling and itself."""

    def __init__(self, name: str, kind: str, seed: int, budget: str, train: DataFrame, features: list[str], target: str):
        self.name, self.binary = name, kind == "binary_classification"
        rows = train.where(finite(named(target)).isNotNull()).withColumn("label", named(target).cast("double"))
        self.preparation, self.scaler = Preparation(rows, features), None
        self.configuration = {"model": name, "seed": seed, "budget": budget}
        if name == "dummy":
            self.model = _Constant(rows.agg(F.avg("label")).first()[0])
            return
        ready = self.preparation.apply(rows).select("label", "features")
        if name in SCALED:
            self.scaler = StandardScaler(inputCol="features", outputCol="_scaled", withMean=True).fit(ready)
            ready = self._scale(ready)
        if name == "nearest_neighbour":
            self.model = _Neighbours(ready, self.binary)
            return
        made = estimator(name, kind, seed, budget)
        self.configuration |= {p.name: str(v) for p, v in made.extractParamMap().items() if isinstance(v, (int, float, str, bool))}
        self.model: Model = made.fit(ready)

    def _scale(self, df: DataFrame) -> DataFrame:
        return self.scaler.transform(df).drop("features").withColumnRenamed("_scaled", "features")

    def predict(self, df: DataFrame) -> DataFrame:
        """df with y_pred: the predicted number, or the probability of a one."""
        if self.name == "dummy":
            return self.model.transform(df).withColumnRenamed("prediction", "y_pred")
        ready = self.preparation.apply(df)
        out = self.model.transform(self._scale(ready) if self.scaler else ready)
        probable = self.binary and self.name != "nearest_neighbour"
        y = F.get(vector_to_array("probability"), 1) if probable else F.col("prediction")
        return out.withColumn("y_pred", y).select(*(named(c) for c in df.columns), "y_pred")


# --- records and predictions ----------------------------------------------------------------------------------------

RECORD = "scenario string, strategy string, representation string, seed int, model string, permuted boolean, runtime_seconds double, train_rows long, test_rows long, model_configuration string, permutation_draw int, permutation_method string, permutation_unit string, partition_fingerprint string, metrics map<string,double>"


def record(scenario: Section, seed: int, model: str, representation: str, sizes: dict, membership: str, metrics: dict, configuration: dict, runtime: float, draw: int | None = None, method: str | None = None, unit: str | None = None) -> tuple:
    """An experiment record, in the order of RECORD. A draw makes it one of permuted labels."""
    return (scenario.name, scenario.strategy, representation, seed, model, draw is not None, runtime, sizes["train"], sizes["test"], json.dumps(configuration, sort_keys=True), draw, method, unit, membership, {k: float(v) for k, v in metrics.items() if v is not None})


def records_frame(spark, rows: list[tuple], metrics: list[str]) -> DataFrame:
    """Records as a table, a column for each metric."""
    df = spark.createDataFrame(rows, RECORD)
    return df.select("*", *(F.col("metrics")[m].alias(m) for m in metrics)).drop("metrics")


def prediction_rows(predicted: DataFrame, row: str, target: str, split: DataFrame, *, run_id: str, scenario: str, model: str, representation: str) -> DataFrame:
    """The predicted rows with _row_id, y_true, y_pred, is_test and what the run was."""
    marked = predicted.join(split.select(F.col("row_id").alias("_rid"), F.col("part").alias("_part")), named(row) == F.col("_rid"))
    tags = {"run_id": run_id, "scenario": scenario, "model": model, "representation": representation}
    return marked.select(*(named(c) for c in predicted.columns if c not in (row, "y_pred", *tags)), named(row).alias("_row_id"), named(target).cast("double").alias("y_true"), "y_pred", (F.col("_part") == "test").alias("is_test"), *(F.lit(v).alias(k) for k, v in tags.items()))


def ranking_sign(case: Section) -> int:
    """What rankings multiply targets and predictions by, so that more is better."""
    return 1 if case.task.higher_is_better else -1


