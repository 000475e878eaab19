"""Token counts from flat token files, by a scan for separators.

A token file is nothing but token ids, two or four bytes each, with an end-of-document id after each
document and no index.  The files are cut in blocks of equal length.  Each task looks at its blocks with one
vectorised comparison, and reports for each block the tokens before its first separator, after its last
one, and between.  A prefix scan over the blocks of a file (a window over one small row per block)
gives every block the number of the document it starts in and the tokens that document already has.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

BLOCK_BYTES = 8 << 20
#: Tokens that a task gathers before it writes a file.
FILE_TOKENS = 16 << 20
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The first id that the vocabulary leaves free.
END_ID = 50256
#: Fixed value: the pattern that splits a text before byte pairs are merged (public, of the vocabulary's tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoders: dict = {}


def encoder(vocabulary: str):
    """The tokenizer of a rank file; it is loaded once in each worker."""
    if vocabulary not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(vocabulary, "rb") if line.strip())}
        _encoders[vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def _store(path: str):
    """(file system, path in it): local paths need no library, others go through pyarrow."""
    local = C.local_path(path)
    return (pafs.LocalFileSystem(), local) if local else pafs.FileSystem.from_uri(path)


def write_token_files(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID, dtype: str = "uint16") -> DataFrame:
    """Writes the texts as flat token files below ``folder`` and returns (path, ordinal, id): which document is the n-th of which file.

    A task that runs again writes under another name and then renames, so a file is always whole.
    A null text is an empty document.
    """

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        code = encoder(vocabulary)
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        parts, ids, size, number = [], [], 0, 0
        end = np.array([end_id], dtype)

        def flush():
            name = f"tokens-{task.partitionId():06d}-{number:05d}.bin"
            attempt = f"{root}/.{name}.{task.taskAttemptId()}"
            with store.open_output_stream(attempt) as out:
                for x in parts:
                    out.write(x.tobytes())
            store.move(attempt, f"{root}/{name}")
            path = f"{folder}/{name}"
            return pa.RecordBatch.from_arrays([pa.array([path] * len(ids)), pa.array(range(len(ids)), pa.int64()), pa.array(ids, kind)], ["path", "ordinal", id_col])

        for batch in batches:
            kind = batch.column(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = code.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.uint32)
                if len(tokens) and int(tokens.max()) > np.iinfo(dtype).max or (tokens == end_id).any():
                    raise ValueError(f"a token id of this vocabulary does not fit {dtype}, or is the separator {end_id}")
                parts += [tokens.astype(dtype), end]
                ids.append(i)
                size += len(tokens) + 1
                if size >= FILE_TOKENS:
                    yield flush()
                    parts, ids, size, number = [], [], 0, number + 1
        if ids:
            yield flush()

    kind_of_id = docs.schema[id_col].dataType.simpleString()
    made = C.batched(docs).select(id_col, text_col).mapInArrow(write, f"path string, ordinal long, `{id_col}` {kind_of_id}")
    return C.written(made, "token-ids")


def scan_separators(spark: SparkSession, paths: DataFrame, *, end_id: int = END_ID, dtype: str = "uint16", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, ordinal, n_tokens) of every document in the flat files named by the column ``path``: tokens without the separator.

    Tokens after the last separator of a file are a last document without an end. An empty file has no documents.
    """
    width = np.dtype(dtype).itemsize
    block = max(1, block_bytes // width)

    def sizes(batches):
        for batch in batches:
            paths = batch.column(0).to_pylist()
            n = [(lambda s: s[0].get_file_info(s[1]).size)(_store(p)) for p in paths]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["path", "bytes"])

    def scan(batches):
        for batch in batches:
            for path, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = _store(path)
                with store.open_input_file(name) as f:
                    tokens = np.frombuffer(f.read_at(block * width, k * block * width)[: block * width], dtype)
                ends = np.flatnonzero(tokens == end_id)
                inner = np.diff(ends) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([k], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([ends[0] if len(ends) else len(tokens)], pa.int64()), pa.array([len(tokens) - 1 - ends[-1] if len(ends) else len(tokens)], pa.int64()), pa.array([inner.tolist()], pa.list_(pa.int64()))],
                    ["path", "block", "ends", "head", "tail", "inner"],
                )

    files = paths.select("path").distinct().mapInArrow(sizes, "path string, bytes long").where("bytes > 0")
    blocks = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(bytes - 1) div {block * width}"))).alias("block"))
    found = C.written(blocks.repartition(C.partitions(spark), "path", "block").mapInArrow(scan, "path string, block long, ends long, head long, tail long, inner array<long>"), "token-blocks")
    # The scan: documents before each block, and the tokens that its first document already has: all tails since the last block with a separator.
    order = W.partitionBy("path").orderBy("block")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    heads = found.select("path", "block", "ends", "head", "tail", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("first"), F.sum("tail").over(before).alias("_run"), F.lead("block").over(order).isNull().alias("last"))
    heads = heads.withColumn("_anchor", F.last(F.when(F.col("ends") > 0, F.coalesce("_run", F.lit(0))), True).over(before)).withColumn("carry", F.coalesce("_run", F.lit(0)) - F.coalesce("_anchor", F.lit(0)))
    closed = heads.where("ends > 0").select("path", F.col("first").alias("ordinal"), (F.col("carry") + F.col("head")).alias("n_tokens"))
    opened = heads.where("last").select("path", (F.col("first") + F.col("ends")).alias("ordinal"), F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail")).alias("n_tokens")).where("n_tokens > 0")
    firsts = heads.select("path", "block", "first")
    inner = found.where("ends > 1").select("path", "block", "inner").join(firsts, ["path", "block"]).select("path", "first", F.posexplode("inner").alias("k", "n_tokens")).select("path", (F.col("first") + F.col("k") + 1).alias("ordinal"), "n_tokens")
    return closed.unionByName(inner).unionByName(opened)


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID, dtype: str = "uint16", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_tokens) of each document, through token files in the shared folder and the separator scan over them."""
    spark = docs.sparkSession
    ids = write_token_files(docs, C.shared_dir(spark, "tokens"), id_col=id_col, text_col=text_col, vocabulary=vocabulary, end_id=end_id, dtype=dtype)
    found = scan_separators(spark, ids, end_id=end_id, dtype=dtype, block_bytes=block_bytes)
    return ids.join(found, ["path", "ordinal"]).select(id_col, "n_tokens")
