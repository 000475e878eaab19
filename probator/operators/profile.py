"""Columns: counts, distinct values, moments, quantiles and modal values, all from one pass over the table.

The pass counts the rows of each (column, value). That table is as large as the distinct values, not as the rows, and everything that has
to do with values comes from it: what is distinct, constant, modal, and exact quantiles by sums over the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite, is_infinite, is_numeric, missing, named
from ..functions.ordered import quantiles

NEAR = 0.98
PROFILE = {"q05": 0.05, "median": 0.5, "q95": 0.95}


def _number(df: DataFrame, column: str) -> Column:
    return named(column).cast("double") if is_numeric(df, column) else F.lit(None).cast("double")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(position, text, number, n): how many rows have each value of each column. A missing value has neither text nor number; text alone if it is not numeric."""
    cells = [F.struct(F.lit(i).alias("position"), F.when(~missing(df, c), named(c).cast("string")).alias("text"), F.when(~missing(df, c), _number(df, c)).alias("number")) for i, c in enumerate(columns)]
    one = df.select(F.explode(F.array(*cells)).alias("cell")) if cells else df.select(F.lit(None).cast("struct<position: int, text: string, number: double>").alias("cell")).limit(0)
    return one.select("cell.*").groupBy("position", "text", "number").agg(F.count("*").alias("n"))


def column_table(df: DataFrame, columns: list[str], extra: dict[str, list] | None = None) -> DataFrame:
    """(position, column_name, physical_type, and the lists of ``extra``): what is known before any row is read."""
    types = dict(df.dtypes)
    lists = [range(len(columns)), columns, [types[c] for c in columns], [is_numeric(df, c) for c in columns], *(extra or {}).values()]
    return df.sparkSession.createDataFrame(list(zip(*lists, strict=True)), ", ".join(["position int, column_name string, physical_type string, is_numeric boolean", *(f"{k} string" for k in extra or {})]))


def column_profile(df: DataFrame, columns: list[str] | None = None, roles: dict[str, str] | None = None, near: float = NEAR) -> DataFrame:
    """A row for each column, in their order.

    position, column_name, roles, physical_type, n_rows, n_present, n_missing, missing_fraction, n_unique, is_constant (one value at most,
    missing counted as one), is_near_constant (the modal present value has ``near`` of all rows), modal_near (modal share, missing counted as a value, reaches
    ``near`` and the column is not constant), n_infinite, minimum, q05, median, q95, maximum, mean, sd (of finite numbers, null for other types),
    top_value and top_count (of equal ones the least text). A table without rows has a row for each column all the same.
    """
    columns = columns or df.columns
    counts = value_counts(df, columns)
    there = F.col("text").isNotNull()
    number = finite(F.col("number"))
    n = F.col("n")
    weight = F.sum(F.when(number.isNotNull(), n))
    mean = F.try_divide(F.sum(number * n), weight)
    facts = counts.groupBy("position").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(there, n)), F.lit(0)).alias("n_present"), F.count_if(there).alias("n_unique"), F.count("*").alias("_kinds"),
        F.max(F.when(there, n)).alias("top_count"), F.max("n").alias("_most"), F.max_by(F.col("text"), F.when(there, n)).alias("_any"),
        F.coalesce(F.sum(F.when(is_infinite(F.col("number")), n)), F.lit(0)).alias("n_infinite"), F.min(number).alias("minimum"), F.max(number).alias("maximum"), mean.alias("mean"), weight.alias("_w"),
    )
    # The least of the modal texts, and squares around the mean, need the facts first; both read the counts, not the table.
    again = counts.join(facts.select("position", "top_count", F.col("mean").alias("_m")), "position").groupBy("position").agg(
        F.min(F.when(there & (n == F.col("top_count")), F.col("text"))).alias("top_value"), F.sum((number - F.col("_m")) * (number - F.col("_m")) * n).alias("_squares"))
    found = quantiles(counts.where(number.isNotNull()).select("position", number.alias("value"), "n"), PROFILE, ("position",))
    listed = column_table(df, columns, {"roles": [(roles or {}).get(c, "") for c in columns]})
    out = listed.join(facts, "position", "left").join(again, "position", "left").join(found, "position", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = zero("n_rows")
    return out.select(
        "position", "column_name", "roles", "physical_type", rows.alias("n_rows"), zero("n_present").alias("n_present"), (rows - zero("n_present")).alias("n_missing"), F.try_divide(rows - zero("n_present"), rows).alias("missing_fraction"),
        zero("n_unique").alias("n_unique"), (zero("_kinds") <= 1).alias("is_constant"), F.coalesce(F.col("top_count") >= near * rows, F.lit(False)).alias("is_near_constant"),
        ((zero("_kinds") > 1) & (F.col("_most") >= near * rows)).alias("modal_near"), zero("n_infinite").alias("n_infinite"), "minimum", "q05", "median", "q95", "maximum", "mean",
        F.when(F.col("_w") > 1, F.sqrt(F.col("_squares") / (F.col("_w") - 1))).alias("sd"), "top_value", zero("top_count").alias("top_count"), "is_numeric",
    )


def missing_counts(profile: DataFrame) -> DataFrame:
    """(column_name, n_missing) of the columns that miss any."""
    return profile.where("n_missing > 0").select("column_name", "n_missing")


def invalid_values(profile: DataFrame) -> DataFrame:
    """(column_name, n_infinite) of the columns with infinite values."""
    return profile.where("n_infinite > 0").select("column_name", "n_infinite")


def constant_columns(profile: DataFrame) -> DataFrame:
    """(column_name, kind): constant columns, and near-constant ones by their modal value, missing counted as a value."""
    return profile.where("is_constant or modal_near").select("column_name", F.when(F.col("is_constant"), "constant").otherwise("near_constant").alias("kind"))


def high_cardinality(profile: DataFrame) -> DataFrame:
    """(column_name, n_unique, is_high) of the columns that are not numeric: more distinct values than min(100, max(20, rows div 2))."""
    most = F.least(F.lit(100), F.greatest(F.lit(20), F.floor(F.col("n_rows") / 2)))
    return profile.where("not is_numeric").select("column_name", "n_unique", (F.col("n_unique") > most).alias("is_high"))


def most_missing(profile: DataFrame, n: int = 30) -> DataFrame:
    """The ``n`` columns with the largest share of missing values, of those that miss any. Equal shares in the table's order."""
    return profile.where("n_missing > 0").orderBy(F.desc("missing_fraction"), "position").limit(n).select("column_name", "n_missing", "missing_fraction")


def preview(profile: DataFrame, n: int = 50) -> DataFrame:
    """The profile of the first ``n`` columns."""
    return profile.orderBy("position").limit(n).select("column_name", "roles", "physical_type", "n_missing", "missing_fraction", "n_unique", "median", "top_count")
