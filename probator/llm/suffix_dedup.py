"""Removal of repeated substrings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Segments that share an anchor (see ``anchors``) are joined into one sequence with a separator of its own after each.
Its suffixes are sorted by their first bytes, and the transform's intervals are extended backward, breadth
first: the intervals of strings of length l yield exactly the places where neighbouring suffixes have l bytes in
common, so common prefixes come in increasing order.  The expansion stops at the minimum
length: whatever place has no value by then has a common prefix at least that long, and both suffixes start a repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from . import common as C

#: Bytes of a string that counts as repeated, and of the grams that anchor it.
LENGTH = 200
GRAM = 32
#: Bytes that the first sort looks at (9 bits each in 63).
FIRST = 7


def bounded_suffix_array(text: np.ndarray, cuts: np.ndarray, length: int):
    """(suffixes, place of the first suffix with the same FIRST bytes) sorted by at least ``length`` bytes. text: byte + 1, separators 0 at ``cuts``; a separator equals nothing."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(FIRST, np.int64)))
    key = np.zeros(n, np.int64)
    until = cuts[np.searchsorted(cuts, np.arange(n))] - np.arange(n)  # bytes before the next separator
    for i in range(FIRST):
        key = (key << 9) | np.where(until > i, padded[i : i + n], 0)
    order = np.argsort(key)
    sorted_key = key[order]
    alone = until[order] < FIRST
    new = np.ones(n, bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | alone[1:] | alone[:-1]
    first = np.flatnonzero(new)
    head = np.repeat(first, np.diff(np.append(first, n)))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = head, 0
    shallow = head.copy()
    h = FIRST
    while h < length:
        size = np.diff(np.append(first, n))
        slots = np.flatnonzero(np.repeat(size > 1, size))
        if not len(slots):
            break
        at = order[slots]
        k = rank[at] * (n + 1) + rank[np.minimum(at + h, n)]
        by = np.argsort(k)
        at, k = at[by], k[by]
        order[slots] = at
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
        first = np.flatnonzero(rank[order] == np.arange(n))
        h *= 2
    return order, shallow


def deep_places(text: np.ndarray, order: np.ndarray, shallow: np.ndarray, length: int) -> np.ndarray:
    """The places i of the suffix order whose suffix has ``length`` bytes or more in common with the one before.

    Interval expansion over the transform: level l holds the intervals [low, high) of strings of l bytes whose end
    is a place with a common prefix of l - 1 bytes; extending each by every byte before it gives the places
    with l. It starts from the intervals of FIRST bytes, which the first sort has given.
    """
    n = len(text)
    before = text[order - 1]  # the transform; suffix 0 is preceded by the last separator
    by = np.argsort(before.astype(np.uint16), kind="stable")  # 16 bits: a radix sort
    step = np.empty(n, np.int64)
    step[by] = np.arange(n)  # where the suffix one byte longer stands
    known = np.zeros(n + 1, bool)
    known[n] = True
    starts = np.flatnonzero(shallow == np.arange(n))
    known[starts] = True
    low, high = starts, np.append(starts[1:], n)
    for _ in range(FIRST, length):
        size = high - low
        total = int(size.sum())
        if not total:
            break
        query = np.repeat(np.arange(len(low)), size)
        at = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + low[query]
        real = before[at] > 0  # nothing extends over a separator
        to, query = step[at[real]], query[real]
        if not len(to):
            break
        o = np.argsort(to)
        to, query = to[o], query[o]
        new = np.ones(len(to), bool)
        new[1:] = (to[1:] != to[:-1] + 1) | (query[1:] != query[:-1]) | (text[order[to[1:]]] != text[order[to[:-1]]])
        first = np.flatnonzero(new)
        low, high = to[first], np.append(to[first[1:] - 1], to[-1]) + 1
        fresh = ~known[high]
        low, high = low[fresh], high[fresh]
        known[high] = True
    return np.flatnonzero(~known[:n])


def repeated_windows(segments: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each segment a mask of its places: whether the ``length`` bytes from there start anywhere else in these segments."""
    sizes = np.array([len(s) for s in segments])
    cuts = np.cumsum(sizes + 1) - 1
    text = np.zeros(int(cuts[-1]) + 1, np.int64)
    keep = np.ones(len(text), bool)
    keep[cuts] = False
    text[keep] = np.concatenate(segments).astype(np.int64) + 1
    order, shallow = bounded_suffix_array(text, cuts, length)
    deep = deep_places(text, order, shallow, length)
    hit = np.zeros(len(text), bool)
    hit[order[deep]] = True
    hit[order[deep - 1]] = True
    begins = cuts - sizes
    return [hit[b : b + max(0, s - length + 1)] for b, s in zip(begins, sizes, strict=True)]


def byte_symbols(buf: np.ndarray, offsets: np.ndarray):
    return buf, offsets


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep_bytes: bool = False) -> DataFrame:
    """A row for each document: id, n_bytes, n_removed, n_spans, kept_sha256 (and with ``keep_bytes`` kept, the remaining bytes).

    Each byte inside a string of ``length`` bytes that also starts anywhere else, in this document or another, goes.
    Strings are judged on the input. A null or empty text, and one shorter than ``length``, keeps all it has.
    Documents with the same id are separate: exact copies remove each other.
    """
    rows = C.numbered(C.batched(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")), "_id", "text")

    def compare(data, _anchors, _copies):
        return repeated_windows(data, length)

    spans = anchors.repeats(rows, raw_symbols(length), compare, k=gram, width=length, first_stays=False, symbol_bytes=1, name="suffix")
    found = rows.join(spans, "_row", "left").select("_id", "text", "spans")

    def finish(batches):
        for batch in batches:
            out = []
            for at, buf, offsets in C.text_slices(batch.column(1)):
                for r in range(len(offsets) - 1):
                    own = buf[offsets[r] : offsets[r + 1]]
                    s = batch.column(2)[at + r].as_py()
                    if s:
                        gone = anchors.covered(len(own), s, length)
                        runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                        own = own[~gone]
                        out.append((len(gone), int(gone.sum()), runs, own.tobytes()))
                    else:
                        out.append((len(own), 0, 0, own.tobytes()))
            columns = [pa.array([o[i] for o in out], pa.int64()) for i in range(3)] + [pa.array([hashlib.sha256(o[3]).hexdigest() for o in out], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *([pa.array([o[3] for o in out], pa.binary())] if keep_bytes else [])], ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_bytes else [])])

    return found.mapInArrow(finish, f"_id {rows.schema['_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes).withColumnRenamed("_id", id_col)


def raw_symbols(length: int):
    return byte_symbols
