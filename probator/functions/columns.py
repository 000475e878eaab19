"""Column expressions that several operators share. Names are always quoted: a column may be called ``a b``, ``key`` or ``x.y``."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, NumericType

#: The letters of the twenty standard amino acids.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
#: Words that mark a column's name as that of an identifier.
IDENTIFIER_WORDS = ("id", "identifier", "token")
GRAM, BUCKETS = 3, 32


def named(column: str) -> Column:
    """The column of this name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def pick(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(named(c) for c in columns))


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (NumericType, BooleanType))


def missing(df: DataFrame, column: str) -> Column:
    """Null, or not a number."""
    c = named(column)
    return c.isNull() | F.isnan(c) if isinstance(df.schema[column].dataType, (DoubleType, FloatType)) else c.isNull()


def present(df: DataFrame, column: str) -> Column:
    """The value, or null where it is missing."""
    return F.when(~missing(df, column), named(column))


def is_infinite(x: Column) -> Column:
    return F.abs(x.cast("double")) == float("inf")


def finite(x: Column) -> Column:
    """x as a double, or null if it is missing, no number or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & ~is_infinite(x), x)


def numeric(df: DataFrame, column: str) -> Column:
    """A numeric column as finite doubles, null in their place; text is read as numbers where it is one."""
    return finite(named(column) if is_numeric(df, column) else named(column).try_cast("double"))


def required_number(df: DataFrame, column: str) -> Column:
    """The column as a double; a present value that is no number ends the query."""
    value = named(column).try_cast("double")
    return F.when(value.isNull() & named(column).isNotNull(), F.raise_error(F.concat(F.lit(f"{column} is not a number: "), named(column).cast("string")))).otherwise(value).cast("double")


def mapped(df: DataFrame, column: str, values: dict[str, int]) -> Column:
    """The number that ``values`` has for the text; a text that it has not, or none, ends the query."""
    pairs = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, F.coalesce(named(column).cast("string"), F.lit(""))), F.raise_error(F.concat(F.lit(f"unexpected {column}: "), F.coalesce(named(column).cast("string"), F.lit("null")))).cast("int"))


def positive_log_ratio(above: Column, below: Column) -> Column:
    """log10(above / below) where both read as positive numbers, else null."""
    a, b = above.try_cast("double"), below.try_cast("double")
    return F.when((a > 0) & (b > 0), F.log10(a / F.when(b > 0, b)))


def timestamp(x: Column) -> Column:
    """Text, dates and times as a timestamp; null where they are none."""
    return x.try_cast("timestamp")


def half_even(x: Column) -> Column:
    """The nearest whole number, the even one of two that are as near."""
    return F.bround(x, 0).cast("long")


def draw(seed: int, key: Column) -> Column:
    """What keys are shuffled by: the MD5 of seed and key as text, null as an empty text."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def joined_id(prefix: str, x: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), x.cast("string"))


def letter_shares(text: Column) -> dict[str, Column]:
    """The share of each amino acid's letter in the text, in either case; 0 for an empty text or none."""
    upper = F.upper(F.coalesce(text.cast("string"), F.lit("")))
    size = F.greatest(F.length(upper), F.lit(1))
    return {a: (F.length(upper) - F.length(F.replace(upper, F.lit(a), F.lit("")))) / size for a in AMINO_ACIDS}


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, which is made once a row, wherever and however often f has it."""
    return F.get(F.transform(F.array(value), f), 0)


def gram_vector(text: Column, gram: int = GRAM, buckets: int = BUCKETS) -> Column:
    """Counts of the text's character grams by hash bucket, scaled to length 1, as an array.

    A text shorter than a gram is one gram; null is the empty text, whose one gram is empty. The bucket is CRC-32 modulo ``buckets``, a JVM
    expression, so that no row goes to a Python hash. Grams, counts and their norm are bound: named inside a lambda, they would be made again for each
    bucket, and buckets squared. Characters are split off once, as finding the i-th one of a text takes i steps.
    """

    def grams(letters: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(letters) - gram + 1))
        return F.transform(places, lambda i: F.crc32(F.array_join(F.slice(letters, i, F.lit(gram)), "").cast("binary")) % buckets)

    def counts(found: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.size(F.filter(found, lambda g: g == b)).cast("double"))

    def scaled(numbers: Column) -> Column:
        norm = F.sqrt(F.aggregate(numbers, F.lit(0.0), lambda s, x: s + x * x))
        return bound(norm, lambda n: F.transform(numbers, lambda x: x / n))

    letters = F.split(F.coalesce(text.cast("string"), F.lit("")), "")
    return bound(bound(bound(letters, grams), counts), scaled)


def name_words(name: str) -> list[str]:
    """The words of a column's name, in lower case. One ends at a character that is no letter or digit, before a capital that follows a small
    letter or a digit, and before the last of several capitals if a small letter follows it."""
    return [w.lower() for w in re.split(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", name) if w]


def names_identifier(name: str) -> bool:
    return not set(IDENTIFIER_WORDS).isdisjoint(name_words(name))


def markdown_cell(value) -> str:
    return " ".join(str(value).replace("|", "\\|").splitlines())
