"""Tables in, digests of what was read, and results out."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, MapType, StructType

from ..functions.columns import named
from ..functions.ordered import cumulate, numbered_keys

#: Suffix: reader and its options.
SUFFIXES = {"csv": ("csv", {"sep": ","}), "tsv": ("csv", {"sep": "\t"}), "txt": ("csv", {"sep": "\t"}), "parquet": ("parquet", {}), "pq": ("parquet", {})}
#: Bytes of a file that are hashed together.
CHUNK = 1 << 20


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """The table of a file or folder, by its suffix: .csv, .tsv and .txt (tabs), .parquet and .pq; any other is an error. NaN becomes null.

    Text formats are read twice if no schema is given, once for the types: give one for large files.
    """
    kind = SUFFIXES.get(path.rstrip("/").rsplit(".", 1)[-1].lower())
    if kind is None:
        raise ValueError(f"unsupported suffix: {path}")
    reader = spark.read.format(kind[0]).options(**kind[1])
    if kind[0] == "csv":
        reader = reader.option("header", True)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    elif schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    floats = {f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.select(*(F.when(~F.isnan(named(c)), named(c)).alias(c) if c in floats else named(c) for c in df.columns))


def with_row_number(df: DataFrame, name: str = "_row_id") -> DataFrame:
    """df with a number for each row, from 0, the same whenever the same table is read: rows are put in the order of all their values, by hash buckets.

    A table of files has no order of its own that survives a different split; equal rows are interchangeable. No task sorts the whole table.
    """
    row = F.to_json(F.struct(*(named(c) for c in df.columns)), {"ignoreNullFields": "false"})
    hashed = df.withColumn("_h", F.md5(row.cast("binary"))).withColumn("_i", F.monotonically_increasing_id())
    kinds = hashed.groupBy("_h").agg(F.count("*").alias("_n"))
    places = numbered_keys(kinds.select(F.col("_h").alias("key")), F.col("key"), F.substring("key", 1, 3))
    # Equal rows follow each other: their first number is the sum of the counts before.
    starts = cumulate(places.join(kinds, F.col("key") == F.col("_h")).select("key", F.col("place").cast("double").alias("place"), "_n"), "place", {"_start": "_n"})
    ranked = hashed.withColumn("_k", F.row_number().over(Window.partitionBy("_h").orderBy("_i")) - 1)
    return ranked.join(starts.select(F.col("key").alias("_h"), "_start"), "_h").select(*(named(c) for c in df.columns), (F.col("_start") + F.col("_k")).cast("long").alias(name))


# --- digests ----------------------------------------------------------------------------------------------------


def fingerprint(value) -> str:
    """SHA-256 of a value's JSON."""
    return hashlib.sha256(to_text(value).encode()).hexdigest()


def dataset_fingerprint(df: DataFrame, columns: list[str] | None = None) -> str:
    """A digest of schema and rows (over the columns, or all) that does not depend on their order."""
    picked = df.select(*(named(c) for c in columns or df.columns))
    row = F.xxhash64(F.to_json(F.struct(*(named(c) for c in picked.columns)), {"ignoreNullFields": "false"}))
    n, total, parity = picked.agg(F.count("*"), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).first()
    return fingerprint([picked.schema.jsonValue(), n, str(total), parity])


def file_checksum(path: str) -> str:
    """SHA-256 of a file's bytes."""
    digest = hashlib.sha256()
    with open(path, "rb") as file:
        for chunk in iter(lambda: file.read(CHUNK), b""):
            digest.update(chunk)
    return digest.hexdigest()


def require_checksum(path: str, expected: str, what: str) -> None:
    if file_checksum(path) != expected:
        raise ValueError(f"checksum of {what} differs: {path}")


# --- values that JSON can hold ----------------------------------------------------------------------------------


class _Plain(json.JSONEncoder):
    def default(self, o):
        return str(o) if not hasattr(o, "asDict") else o.asDict(recursive=True)


def to_text(value, indent: int | None = None) -> str:
    """JSON with sorted keys. Numbers that JSON has no word for are null; rows are objects; whatever else is text."""
    loose = json.dumps(value, cls=_Plain)
    strict = json.loads(loose, parse_constant=lambda _: None, parse_float=lambda x: float(x) if math.isfinite(float(x)) else None)
    return json.dumps(strict, sort_keys=True, indent=indent, allow_nan=False)


def without_infinite(df: DataFrame) -> DataFrame:
    """df with null for NaN and infinities in its float columns."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.select(*(F.when(~F.isnan(named(c)) & (F.abs(named(c)) != float("inf")), named(c)).alias(c) if c in floats else named(c) for c in df.columns))


def encoded(df: DataFrame) -> DataFrame:
    """df with its nested columns as JSON text, for sinks that are flat."""

    def flat(c: str) -> Column:
        return F.to_json(named(c)).alias(c) if isinstance(df.schema[c].dataType, (StructType, ArrayType, MapType)) else named(c)

    return df.select(*(flat(c) for c in df.columns))
