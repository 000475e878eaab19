"""Public benchmark tables in the form that cases expect.

An adapter takes the raw table as a DataFrame, checks and reshapes it declaratively, and returns the table and the facts to be kept beside
it. Nothing is fetched from here: the caller hands over the raw table, and the checksum that its file must have.
What structures become (keys, canonical forms, scaffolds) is up to functions that the caller supplies, or to RDKit where it is installed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import CaseError
from ..functions.columns import finite, joined_id, mapped, named, positive_log_ratio, required_number
from ..operators.audits import group_sizes, measurements_by_key
from . import sinks
from .io import dataset_fingerprint, with_row_number

# Column names of the public tables, and what they are called here.
DAVIS = {"Drug_ID": "compound_id", "Drug": "smiles", "Target_ID": "target_id", "Target": "sequence", "Y": "affinity"}
BARRIER = {"Drug_ID": "compound_id", "Drug": "smiles", "Y": "bbb_label"}
EXTERNAL_LABELS = {"BBB+": 1, "BBB-": 0}
EXTERNAL_COLUMNS = ("SMILES", "CID", "BBB+/BBB-", "reference", "group")
TRACER_TEXT = {"compound index": "source_compound_id", "ref No": "source_reference", "PMID": "source_pmid", "DOI": "source_doi", "animal type": "source_animal_type", "gender": "source_gender", "animal weight (g)": "source_animal_weight_g", "injection dosage (μCi)": "source_injection_dosage_uci"}
TRACER_NUMBERS = ("brain at60min", "blood at60min")
#: Mean log10 ratio from which a tracer counts as entering the brain.
TRACER_CUT = -1.0
VOICE = {
    "subject#": "subject_id", "age": "age", "sex": "sex", "test_time": "test_time_days", "motor_UPDRS": "motor_updrs", "total_UPDRS": "total_updrs", "Jitter(%)": "jitter_percent", "Jitter(Abs)": "jitter_abs", "Jitter:RAP": "jitter_rap", "Jitter:PPQ5": "jitter_ppq5", "Jitter:DDP": "jitter_ddp",
    "Shimmer": "shimmer", "Shimmer(dB)": "shimmer_db", "Shimmer:APQ3": "shimmer_apq3", "Shimmer:APQ5": "shimmer_apq5", "Shimmer:APQ11": "shimmer_apq11", "Shimmer:DDA": "shimmer_dda", "NHR": "nhr", "HNR": "hnr", "RPDE": "rpde", "DFA": "dfa", "PPE": "ppe",
}
SOLUBILITY_ROWS = 1128

Key = Callable[[Column], Column]


def require(df: DataFrame, columns, what: str) -> None:
    absent = sorted(set(columns).difference(df.columns))
    if absent:
        raise CaseError(f"{what}: unexpected schema, missing {absent}")


def _renamed(raw: DataFrame, names: dict[str, str], what: str, prefix: str) -> DataFrame:
    """The renamed columns, after sample_id: the prefix and the row's number."""
    ready = raw.withColumnsRenamed(names)
    require(ready, names.values(), what)
    rows = with_row_number(ready.select(*(named(c) for c in names.values())), "_i")
    return rows.select(joined_id(prefix, F.col("_i")).alias("sample_id"), *(named(c) for c in names.values()))


def _require_none(df: DataFrame, broken: dict[str, Column], what: str) -> None:
    """An error that names the rules which some row breaks: one pass for all of them."""
    hits = df.agg(*(F.count_if(c).alias(str(i)) for i, c in enumerate(broken.values()))).first()
    wrong = [f"{rule} ({n} rows)" for rule, n in zip(broken, hits, strict=True) if n]
    if wrong:
        raise CaseError(f"{what}: {', '.join(wrong)}")


def class_counts(df: DataFrame, label: str) -> dict[str, int]:
    return {str(r[0]): r[1] for r in df.groupBy(named(label)).agg(F.count("*")).orderBy(named(label)).collect()}


def structure_key(kind: str = "inchikey") -> Key:
    """The function from structures to identity keys that RDKit gives; an error if it is not installed."""
    try:
        from rdkit import Chem
        from rdkit.Chem.Scaffolds import MurckoScaffold
    except ImportError as error:
        raise RuntimeError("structures need RDKit, or a function of your own") from error
    import pandas as pd

    def one(text):
        molecule = Chem.MolFromSmiles(str(text))
        if kind == "scaffold":
            return MurckoScaffold.MurckoScaffoldSmiles(mol=molecule) if molecule else "INVALID"
        if molecule is None or not molecule.GetNumAtoms():
            return None
        return Chem.MolToInchiKey(molecule) if kind == "inchikey" else Chem.MolToSmiles(molecule, canonical=True, isomericSmiles=True)

    @F.pandas_udf("string")
    def keys(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return keys


def keyed(df: DataFrame, structure: str, key: Key, name: str = "compound_id") -> DataFrame:
    """df with the identity key of its structures; one that has none is an error."""
    out = df.withColumn(name, key(named(structure)))
    _require_none(out, {f"no key for {structure}": F.coalesce(named(name), F.lit("")) == ""}, "identity")
    return out


# --- the tables --------------------------------------------------------------------------------------------------


def davis(raw: DataFrame) -> tuple[DataFrame, dict]:
    """Compound and target pairs with their affinity as it came."""
    df = _renamed(raw, DAVIS, "davis", "davis")
    n = df.agg(F.count("*"), F.count_distinct("compound_id"), F.count_distinct("target_id")).first()
    return df, {"adapter": "davis", "row_count": n[0], "compound_count": n[1], "target_count": n[2], "target_transformation": "none"}


def barrier(raw: DataFrame) -> tuple[DataFrame, dict]:
    """Compounds with a 0/1 label; both classes must occur, and no other value."""
    df = _renamed(raw, BARRIER, "bbb_martins", "bbb-martins")
    df = df.withColumn("bbb_label", required_number(df, "bbb_label").cast("int"))
    _require_none(df, {"labels other than 0 and 1": ~F.coalesce(F.col("bbb_label").isin(0, 1), F.lit(False))}, "bbb_martins")
    counts = class_counts(df, "bbb_label")
    if len(counts) < 2:
        raise CaseError(f"bbb_martins: both classes must occur, found {counts}")
    return df, {"adapter": "bbb_martins", "row_count": sum(counts.values()), "class_counts": counts}


def without_identities(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """The rows whose key the other table has not."""
    return df.join(others.select(named(key)).distinct(), key, "left_anti")


def barrier_external(development: DataFrame, external: DataFrame, key: Key) -> tuple[DataFrame, dict]:
    """Development rows for training and an external table as holdout; a development compound that the external table has too leaves. ``key`` tells compounds by structure."""
    require(external, EXTERNAL_COLUMNS, "b3db_external")
    outside = keyed(external.withColumn("bbb_label", mapped(external, "BBB+/BBB-", EXTERNAL_LABELS)), "SMILES", key)
    inside = keyed(development.withColumnRenamed("compound_id", "source_compound_id"), "smiles", key)
    kept = without_identities(inside, outside, "compound_id")
    text = lambda c: named(c).cast("string")
    train = kept.select(
        joined_id("development", F.col("sample_id")).alias("sample_id"), "compound_id", text("source_compound_id").alias("source_compound_id"), text("smiles").alias("smiles"), F.col("bbb_label").cast("int").alias("bbb_label"),
        F.lit("train").alias("validation_split"), F.lit("development").alias("source_dataset"))
    held = outside.select(
        joined_id("b3db-external", named("CID")).alias("sample_id"), "compound_id", text("CID").alias("source_compound_id"), text("SMILES").alias("smiles"), "bbb_label", F.lit("holdout").alias("validation_split"), F.lit("external").alias("source_dataset"),
        text("reference").alias("source_reference"), text("group").alias("curation_group"))
    overlap = inside.agg(F.count("*")).first()[0] - kept.agg(F.count("*")).first()[0]
    shared = inside.select("compound_id").intersect(outside.select("compound_id")).count()
    out = train.unionByName(held, allowMissingColumns=True)
    return out, {"adapter": "b3db_external", "development_rows_excluded": overlap, "development_compounds_excluded": shared, "external_rows": held.count(), "external_class_counts": class_counts(held, "bbb_label")}


def tracer_external(protected: DataFrame, external: DataFrame, key: Key) -> tuple[DataFrame, dict]:
    """Development rows and, as holdout, one row for each tracer with positive brain and blood measurements: the mean log10 ratio and what its sources say. Compounds that the protected table has leave."""
    require(external, ("SMILES", *TRACER_TEXT, *TRACER_NUMBERS), "petbd_external")
    require(protected, ("compound_id", "smiles", "bbb_label", "validation_split"), "protected table")
    ratio = positive_log_ratio(*(named(c) for c in TRACER_NUMBERS))
    measured = external.withColumn("log10_bb", ratio).where(F.col("log10_bb").isNotNull() & named("SMILES").isNotNull())
    if measured.isEmpty():
        raise CaseError("petbd_external: no row has positive brain and blood values")
    _require_none(measured, {"no reference number": named("ref No").isNull()}, "petbd_external")
    measured = keyed(measured, "SMILES", key)
    per = measurements_by_key(measured, "compound_id", ["SMILES", "compound index"], "log10_bb", ["SMILES"], list(TRACER_TEXT), TRACER_CUT)
    held = per.select(
        F.col("key").alias("compound_id"), named("SMILES").alias("smiles"), F.col("mean").alias("log10_bb"), F.col("least").alias("log10_bb_min"), F.col("most").alias("log10_bb_max"), F.col("n").alias("measurement_count"),
        *(named(f"all_{c}").alias(n) for c, n in TRACER_TEXT.items()), F.col("label").alias("bbb_label"))
    fresh = without_identities(held, protected, "compound_id").withColumns({"sample_id": joined_id("petbd", F.col("compound_id")), "validation_split": F.lit("holdout"), "source_dataset": F.lit("tracer")})
    out = protected.where("validation_split = 'train'").unionByName(fresh, allowMissingColumns=True)
    counts = external.agg(F.count("*").alias("raw_rows"), F.count_if(ratio.isNotNull() & named("SMILES").isNotNull()).alias("ratio_rows"), F.count_if(ratio.isNull()).alias("rows_without_ratio")).first().asDict()
    return out, {"adapter": "petbd_external", **counts, "compounds_before_exclusion": held.count(), "external_rows": fresh.count(), "external_class_counts": class_counts(fresh, "bbb_label")}


def voice(raw: DataFrame) -> tuple[DataFrame, dict]:
    """Voice measurements of participants over time. Every field must have a finite value; participants are whole numbers and become text."""
    df = _renamed(raw, VOICE, "parkinsons_telemonitoring", "parkinsons")
    numbers = [c for c in VOICE.values() if c != "subject_id"]
    _require_none(df, {"missing values": reduce(lambda a, b: a | b, (named(c).isNull() for c in VOICE.values())), "values that are not finite numbers": reduce(lambda a, b: a | b, (finite(named(c).try_cast("double")).isNull() & named(c).isNotNull() for c in numbers)),
                       "participants that are not whole numbers": F.coalesce(F.col("subject_id").try_cast("double") != F.floor(F.col("subject_id").try_cast("double")), F.col("subject_id").isNotNull() & F.col("subject_id").try_cast("double").isNull())}, "parkinsons_telemonitoring")
    df = df.select("sample_id", F.col("subject_id").cast("double").cast("long").cast("string").alias("subject_id"), *(named(c).cast("double").alias(c) for c in numbers))
    per, repeat = group_sizes(df, ["subject_id"]).first(), group_sizes(df, ["subject_id", "test_time_days"]).first()
    return df, {"adapter": "parkinsons_telemonitoring", "row_count": df.count(), "participant_count": per.n_groups, "records_per_participant": {"min": per.least, "median": per.median, "max": per.most}, "participant_times": repeat.n_groups, "records_in_repeated_groups": repeat.repeated_rows}


def solubility(raw: DataFrame, structure: str, canonical: Key, rows: int = SOLUBILITY_ROWS) -> tuple[DataFrame, dict]:
    """The table with canonical structures; it must have the published number of rows, each with a structure that can be read."""
    n = raw.count()
    if n != rows:
        raise CaseError(f"solubility: {n} rows, expected {rows}")
    return keyed(raw, structure, canonical, "canonical_smiles"), {"adapter": "solubility", "row_count": n}


# --- kept beside their facts --------------------------------------------------------------------------------------


def cached(spark: SparkSession, folder: str, build: Callable[[], tuple[DataFrame, dict]], *, verify: bool = True) -> tuple[DataFrame, dict]:
    """The table and facts of a folder, made if it has none. The facts hold the table's digest, which is checked when the table is taken from the folder."""
    facts = sinks.read_json(spark, f"{folder}/source.json")
    if facts is not None:
        df = spark.read.parquet(f"{folder}/table.parquet")
        if verify and dataset_fingerprint(df) != facts.get("sha256"):
            raise ValueError(f"the table in {folder} is not the one that its facts describe")
        return df, facts
    built, facts = build()
    sinks.write_table(built, f"{folder}/table.parquet")
    df = spark.read.parquet(f"{folder}/table.parquet")
    facts = facts | {"sha256": dataset_fingerprint(df)}
    sinks.write_json(spark, f"{folder}/source.json", facts)
    return df, facts
