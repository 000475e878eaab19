"""A corpus pipeline: quality rules, near duplicates, decontamination, personal data, mixing.

Every stage reads the documents that the one before has kept, takes its decisions on all of them and returns the
columns of documents; the last one adds the source's target and the number of each copy.  Other columns are left out.
Rows with one id are separate documents, and so are rows with none; an empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probator.llm import common as C
from probator.llm import decontaminate, mixing, ngram_join, pii, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that fail; a text that has none stays as it is. A null or empty text has too few words to be kept."""
    step = quality.rate_documents(docs.select(F.struct(*COLUMNS).alias("d"), F.col("text")), id_col="d").where("kept")
    text = F.when(F.col("n_bad_lines") == 0, F.col("d.text")).otherwise(quality.without_failing_lines(F.col("d.text")))
    return step.select("d.*", text.alias("_text")).withColumns({"text": F.col("_text"), "n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType)}).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the one with the least id, null before all, and of equal ids the first in the table. Null and empty texts are similar to nothing and stay."""
    groups = ngram_join.similar_documents(docs).where("is_first").select("_row")
    return C.numbered(docs, *COLUMNS).join(groups, "_row", "left_semi").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Null and empty texts have none; an empty benchmark takes no document away."""
    found = C.written(decontaminate.find_contamination(docs, C.table(spark, sf_dir, "benchmark")).where("n_hit > 0").select("_row"), "contaminated")
    return C.numbered(docs, *COLUMNS).join(found, "_row", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the kind's name in brackets. A null text stays null, and its n_chars too."""
    return pii.masked_documents(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with the number of the copy and its source's target in words. A null source is a source; a text without words is taken once unless its source's target is 0."""
    rates = mixing.mix_sources(docs).where("copies > 0").select("_row", "target", "copies")
    taken = C.numbered(docs, *COLUMNS).join(rates, "_row")
    return taken.select(*COLUMNS, "target", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))


STAGES = [("quality_rules", quality_rules), ("ngram_jaccard_join", near_duplicates), ("decontamination", decontaminated), ("pii", personal_data), ("mix_sources", mixed)]

#: The field that finds personal data and the Newton iterations are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, in order: each but the last is written and read again before the next."""
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
