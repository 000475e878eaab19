"""Repeats of long windows, routed by anchors.

A window is ``width`` consecutive symbols (bytes or words) of one text.  Its anchor is the leftmost least hash of
the ``k``-grams inside, so equal windows have equal anchors at equal distance.  Consecutive windows with one
anchor make a segment: a text has one for every few dozen symbols.  Only segments travel:

* an anchor that occurs once in the corpus has no repeated window and is dropped after a count;
* segments that occur whole in several places need no look at their symbols;
* distinct segments that share an anchor are compared by the method of the operator (``compare``), each once,
  however many copies it has, in batches of whole anchor groups;
* an anchor with more than HOT distinct segments gets a second anchor for each of its windows: the least of the window's other
  ``k``-grams under another hash, which cuts the segments anew.  Equal windows still have equal anchors.  Groups that are
  still too large get a third one, and so on; each level leaves a gram out of account, and a window with none left is its own
  anchor, so this ends, and every window is compared by the same method in a group of a bounded size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Distinct segments of an anchor that one task compares, and symbols that it takes together.
HOT = 4000
BATCH_SYMBOLS = 1 << 19
NONE = np.uint64(2**64 - 1)


def segments(values: np.ndarray, bounds: np.ndarray, k: int, width: int):
    """(text, start in it, windows, anchor, hash) of every segment. values: a 64-bit integer for each symbol; bounds: where texts begin, and the end."""
    n = len(values) - width + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    h = C.prefix_hash(values)
    at = np.arange(len(values) - k + 1)
    grams = C.span_hash(h, at, at + k)
    anchor = C.sliding_min(grams, width - k + 1)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
    valid = bounds[owner + 1] >= np.arange(n) + width
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | new[1:]
    start, end = np.flatnonzero(new), np.flatnonzero(last) + 1
    whole = C.mix(C.span_hash(h, start, end - 1 + width) + (anchor[start] - start).astype(np.uint64))
    return owner[start], start - bounds[owner[start]], end - start, grams[anchor[start]], whole


def finer(values: np.ndarray, n: int, k: int, width: int, used: np.ndarray, parent: int):
    """(start, windows, anchor, hash) of the pieces into which the n windows of a segment fall by an anchor that is none of ``used``; and the gram that each took."""
    h = C.prefix_hash(values)
    at = np.arange(len(values) - k + 1)
    grams = C.span_hash(h, at, at + k)
    order = C.mix(grams + np.uint64(len(used)))
    order[np.isin(grams, used)] = NONE
    best = C.sliding_min(order, width - k + 1)[:n]
    bare = order[best] == NONE
    new = bare | np.concatenate(([True], (best[1:] != best[:-1]) | bare[:-1]))
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    whole = C.span_hash(h, start, start + size - 1 + width)
    gram = np.where(bare[start], whole, grams[best[start]])
    place = np.where(bare[start], 0, best[start] - start)
    return start, size, C.mix(gram ^ np.uint64(parent & (2**64 - 1))), C.mix(whole + place.astype(np.uint64)), gram


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def cut(rows: DataFrame, symbols: Callable, k: int, width: int) -> DataFrame:
    """(_id, _row, start, n, anchor, segment) for the segments of each text. symbols(buf, offsets) gives (values, bounds)."""

    def work(batches):
        for batch in batches:
            for at, buf, offsets in C.text_slices(batch.column(2)):
                owner, start, n, anchor, whole = segments(*symbols(buf, offsets), k, width)
                take = pa.array(owner + at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), _long(anchor), _long(whole)], ["_id", "_row", "start", "n", "anchor", "segment"])

    return rows.select("_id", "_row", "text").mapInArrow(work, f"_id {rows.schema['_id'].dataType.simpleString()}, _row long, start int, n int, anchor long, segment long")


def repeats(rows: DataFrame, symbols: Callable, compare: Callable, *, k: int, width: int, first_stays: bool, symbol_bytes: int, name: str) -> DataFrame:
    """(_row, spans): for each text with any, array of (start, n, mask): windows that are repeats; a null mask means all n of them.

    first_stays: a window is a repeat if it also starts earlier (by id, row, place); otherwise if it starts anywhere else.
    compare(list of symbol arrays in order of their first place) gives for each segment a mask of its windows, or None.
    """
    cuts = C.written(cut(rows, symbols, k, width), f"{name}-cuts")
    counts = C.written(cuts.groupBy("anchor").agg(F.count("*").alias("_n")).where("_n > 1"), f"{name}-anchors")
    found = C.written(C.met_in_parts(cuts, counts, ["anchor"], "_n", "_row", "start"), f"{name}-shared")
    place = F.struct("_id", "_row", "start")
    kinds = C.written(found.groupBy("anchor", "segment").agg(F.count("*").alias("copies"), F.min(place).alias("first"), F.first("n").alias("n")), f"{name}-kinds")
    several = kinds.groupBy("anchor").agg(F.count("*").alias("_kinds")).where("_kinds > 1")
    whole = C.met_in_parts(found, kinds.where("copies > 1").select("anchor", "segment", "copies", "first"), ["anchor", "segment"], "copies", "_row", "start")
    if first_stays:
        whole = whole.where(~place.eqNullSafe(F.col("first")))
    whole = whole.select("_row", "start", "n", F.lit(None).cast("binary").alias("mask"))
    ship = kinds.join(several, "anchor")
    ship = ship.select("anchor", "copies", F.col("first._id").alias("_id"), F.col("first._row").alias("_row"), F.col("first.start").alias("start"), "n", (F.col("_kinds") > HOT).alias("hot"))
    wanted = ship.groupBy("_row").agg(F.collect_list(F.struct("anchor", "copies", "_id", "start", "n", "hot")).alias("wanted"))

    def fetch(batches):
        for batch in batches:
            for at, buf, offsets in C.text_slices(batch.column(1)):
                values, bounds = symbols(buf, offsets)
                for r in range(len(offsets) - 1):
                    row = batch.column(0)[at + r].as_py()
                    own = batch.column(2)[at + r].as_py()
                    data = [values[bounds[r] + w["start"] : bounds[r] + w["start"] + w["n"] + width - 1].tobytes() for w in own]
                    yield pa.RecordBatch.from_arrays([*(pa.array([w[c] for w in own], t) for c, t in (("anchor", pa.int64()), ("copies", pa.int64()), ("_id", id_kind(batch)), ("start", pa.int32()), ("n", pa.int32()), ("hot", pa.bool_()))), pa.array([row] * len(own), pa.int64()), pa.array(data, pa.binary())], ["anchor", "copies", "_id", "start", "n", "hot", "_row", "data"])

    id_kind = lambda batch: batch.column(2).type.value_type.field("_id").type
    id_type = rows.schema["_id"].dataType.simpleString()
    shipped = C.written(rows.select("_row", "text").join(wanted, "_row").mapInArrow(fetch, f"anchor long, copies long, _id {id_type}, start int, n int, hot boolean, _row long, data binary"), f"{name}-ship")
    kind = np.uint8 if symbol_bytes == 1 else np.uint64

    def look(batches):
        """Anchors come in order; a batch is closed where an anchor ends."""
        held: list = []
        size = 0

        def flush():
            out = []
            for r, mask in zip(held, compare([r[5] for r in held], [r[0] for r in held], [r[1] for r in held]), strict=True):
                if mask is not None and mask.any() and (first_stays or r[1] == 1):
                    out.append((r[2], r[3], r[4], np.packbits(mask).tobytes()))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["_row", "start", "n", "mask"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for i, (anchor, copies, row, start, n) in enumerate(zip(*columns, strict=True)):
                data = np.frombuffer(batch.column(5)[i].as_buffer(), kind)
                if size > BATCH_SYMBOLS and anchor != held[-1][0]:
                    yield flush()
                    size = 0
                held.append((anchor, copies, row, start, n, data))
                size += len(data)
        if held:
            yield flush()

    columns = ["anchor", "copies", "_id", "_row", "start", "n", "data"]
    close = shipped.where("not hot").select(*columns)
    hot = shipped.where("hot").select(*columns, F.array("anchor").alias("used"))

    def cut_again(batches):
        for batch in batches:
            anchor, copies, row, first = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for i, n in enumerate(batch.column(5).to_pylist()):
                data = np.frombuffer(batch.column(6)[i].as_buffer(), kind)
                used = np.array(batch.column(7)[i].as_py(), np.int64).view(np.uint64)
                start, size, finer_anchor, segment, gram = finer(C.byte_values(data) if symbol_bytes == 1 else data, n, k, width, used, anchor[i])
                m = len(start)
                pieces = pa.array([data[a : a + c + width - 1].tobytes() for a, c in zip(start, size, strict=True)], pa.binary())
                chain = pa.array([[*used.view(np.int64).tolist(), g] for g in gram.view(np.int64).tolist()], pa.list_(pa.int64()))
                same = lambda x, t, m=m: pa.array([x] * m, t)
                yield pa.RecordBatch.from_arrays([_long(finer_anchor), _long(segment), same(copies[i], pa.int64()), pa.array([batch.column(2)[i].as_py()] * m, batch.column(2).type), same(row[i], pa.int64()), pa.array((start + first[i]).astype(np.int32)), pa.array(size.astype(np.int32)), pieces, chain], ["anchor", "segment", "copies", "_id", "_row", "start", "n", "data", "used"])

    for _ in range(width - k + 2):  # a window has no more grams
        if hot.isEmpty():
            break
        schema = f"anchor long, segment long, copies long, _id {id_type}, _row long, start int, n int, data binary, used array<long>"
        pieces = C.written(hot.repartition(C.partitions(rows.sparkSession)).mapInArrow(cut_again, schema), f"{name}-pieces")
        # Pieces that are equal now: again all but the first, or all of them, need no look.
        seen = C.written(pieces.groupBy("anchor", "segment").agg(F.count("*").alias("_pieces"), F.sum("copies").alias("copies"), F.min(place).alias("first")), f"{name}-piece-kinds")
        again = C.met_in_parts(pieces.drop("copies"), seen.where("copies > 1").select("anchor", "segment", "_pieces", "first"), ["anchor", "segment"], "_pieces", "_row", "start")
        if first_stays:
            again = again.where(~place.eqNullSafe(F.col("first")))
        whole = whole.unionByName(again.select("_row", "start", "n", F.lit(None).cast("binary").alias("mask")))
        crowd = seen.groupBy("anchor").agg(F.count("*").alias("_kinds")).where("_kinds > 1")
        firsts = seen.join(crowd, "anchor").select("anchor", "segment", "copies", "first", "_kinds")
        ones = C.written(pieces.drop("copies").join(firsts, ["anchor", "segment"]).where(place.eqNullSafe(F.col("first"))), f"{name}-again")
        close = close.unionByName(ones.where(F.col("_kinds") <= HOT).select(*columns))
        hot = ones.where(F.col("_kinds") > F.greatest(F.lit(HOT), F.lit(1))).select(*columns, "used")

    near = close.repartition(C.partitions(rows.sparkSession), "anchor").sortWithinPartitions("anchor", "_id", "_row", "start")
    partial = near.select("anchor", "copies", "_row", "start", "n", "data").mapInArrow(look, "_row long, start int, n int, mask binary")
    return whole.unionByName(partial).groupBy("_row").agg(F.collect_list(F.struct("start", "n", "mask")).alias("spans"))


def covered(size: int, spans, width: int) -> np.ndarray:
    """Which of ``size`` symbols lie in one of the windows that ``spans`` names."""
    edge = np.zeros(size + 1, np.int32)
    for s in spans:
        start, n, mask = s["start"], s["n"], s["mask"]
        if mask is None:
            edge[start] += 1
            edge[start + n - 1 + width] -= 1
        else:
            at = np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), count=n)) + start
            np.add.at(edge, at, 1)
            np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:-1]) > 0
