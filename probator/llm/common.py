"""Byte-level helpers that the corpus operators share.

Texts arrive as Arrow string arrays.  The helpers look at the UTF-8 bytes through
numpy without making a Python string for each row, and work on slices of about
``SLICE`` bytes, so that the arrays stay small however long a batch is.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are looked at together.
SLICE = 1 << 19
#: Rows in an Arrow batch; texts are long, so the default of 10,000 is too many.
BATCH_ROWS = 2000
#: Bytes of an Arrow batch, whatever its rows.
BATCH_BYTES = 4 << 20

#: [\x20\x09-\x0D] as a regular expression for Spark and for DuckDB.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: Bytes that end a word: white space, or whatever is no ASCII letter, digit or non-ASCII byte.
SPACE_BREAKS, PLAIN_BREAKS = _SPACE, _PLAIN

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE + 4096), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """h with h[0] = 0, so that ``span_hash(h, a, b)`` is the hash of values[a:b]. values: 64-bit integers."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(_BASE, len(values)), out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span [start, end) of the sequence that ``prefix_hash`` has read."""
    inverse = powers(_INVERSE, len(h))
    return mix((h[end] - h[start]) * inverse[start] + (end - start).astype(np.uint64))


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _TABLE[buf]


def lowered(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE):
    """(first row, bytes, offsets) of consecutive rows with about ``limit`` bytes; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, whole[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_spans(buf: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE_BREAKS):
    """(start, end, first): byte spans of the words, and for each text the index of its first word (and the total)."""
    inside = ~breaks[buf]
    before = np.zeros(len(buf), bool)
    before[1:] = inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(buf)]
    before[edges] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(buf), bool)
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(_TABLE[buf]), start, end)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The index of the leftmost least value in each full window of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, have = np.arange(len(values)), 1
    best = values
    while have < width:
        step = min(have, width - have)
        m = len(best) - step
        right = best[step:] < best[:m]
        at = np.where(right, at[step:], at[:m])
        best = np.where(right, best[step:], best[:m])
        have += step
    return at


def batched(docs: DataFrame) -> DataFrame:
    """docs, after the session was told to send small Arrow batches to Python and to drop shuffle files when a query ends."""
    conf = docs.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return docs


#: Bits of a row's number that count rows within its file; those above count files.
FILE_ROWS = 40


def stored_files(docs: DataFrame) -> list[str] | None:
    """The Parquet files that docs reads, by name, if each of its rows is one row of theirs; otherwise None."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return None
    if plan.relation().fileFormat().getClass().getSimpleName() != "ParquetFileFormat":
        return None
    files = sorted(plan.relation().location().inputFiles())
    return files if len(set(files)) == len(files) else None  # a file that is read twice


def numbered(docs: DataFrame, *columns: str, **renamed: str) -> DataFrame:
    """The named columns and ``_row``, a number of the row. Rows with the same id, or none, stay apart.

    The number is made of the row's file and its place there, so that it is the same in every query, however Spark splits the
    files. Whatever is not just a read of Parquet files is written first, with its numbers.
    """
    picked = [F.col(c) for c in columns] + [F.col(v).alias(k) for k, v in renamed.items()]
    files = stored_files(docs)
    if files is None:
        return written(docs.select(*picked, F.monotonically_increasing_id().alias("_row")), "numbered")
    # An empty authority is written as :/// or as :/.
    order = docs.sparkSession.createDataFrame(pa.table({"_file": pa.array([f.replace(":///", ":/") for f in files], pa.string()), "_place": pa.array(range(len(files)), pa.int64())}))
    at = docs.metadataColumn("_metadata")
    rows = docs.select(*picked, F.replace(at["file_path"], F.lit(":///"), F.lit(":/")).alias("_path"), at["row_index"].alias("_index")).join(F.broadcast(order), F.col("_path") == F.col("_file"), "left")  # one row a file
    place = F.coalesce("_place", F.raise_error(F.concat(F.lit("not a listed file: "), "_path")).cast("long"))
    return rows.select(*columns, *renamed, (F.shiftleft(place, FILE_ROWS) + F.col("_index")).alias("_row"))


def shared_dir(spark: SparkSession, name: str = "work") -> str:
    """A new folder below spark.checkpoint.dir (in tests, where none is set, below the warehouse)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lineage ends here and no later step repeats the work."""
    return passing(df, name)[0]


def passing(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """The same, and a function that deletes the table. Call it when whatever was made from the table has been written."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    df.write.parquet(path)

    def drop() -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)

    return spark.read.schema(df.schema).parquet(path), drop


#: Rows of a key from which its facts are met in parts, and the parts.
CROWD, PARTS = 1024, 16


def met_in_parts(rows: DataFrame, facts: DataFrame, on: list[str], size: str, *spread: str) -> DataFrame:
    """rows joined with the facts of their key (one row a key; ``size``, which is dropped, is how many rows it has). Rows of a crowded key meet a copy of its facts for each
    part into which the columns ``spread`` deal them, so that no task gets them all. There are few crowded keys, since each has many rows; they are written first, so that
    the planner knows their size, and while that is small no row is shuffled for them."""
    crowds = written(facts.where(F.col(size) > CROWD).drop(size), "crowds")
    parts = crowds.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*spread), F.lit(PARTS)).cast("int")).join(parts, [*on, "_part"]).drop("_part")
    rest = rows.join(crowds.select(*on), on, "left_anti").join(facts.where(F.col(size) <= CROWD).drop(size), on)
    return dealt.unionByName(rest)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    """How many words [^\\x20\\x09-\\x0D]+ the text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS + "+")), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_path(path: str) -> str | None:
    """The path in the file system of this machine, or None if it lies in another store."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else os.path.abspath(path)
