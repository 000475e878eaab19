"""Language-model scoring by context-tree weighting.

Every byte is eight binary decisions, each made in the context of the bytes before it, 0 to DEPTH of them.  A node of the
context tree has counts of zeros and ones from the training texts; its Krichevsky-Trofimov estimate is mixed with
what the deeper nodes say, by the weight that the training texts gave it.  All of that depends on the training
counts alone, so the model is built from one count for each distinct (DEPTH + 1)-gram of bytes:

1. Blocks of documents count their byte grams and words (one row for each block and distinct gram or word).
2. Counts add up over blocks; context trees below each pair of last bytes are weighted apart from each other,
   what is above them is at most 256 x 255 nodes.
3. Every gram gets its probability; each block gets back the grams it holds, and the
   words of which there are more elsewhere, and scores its texts.

Nothing is broadcast but the top of the tree (65,280 nodes at most); the rest moves by shuffles of
pre-aggregated rows, in proportion to the number of blocks and their vocabularies.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes of context. A gram has one byte more and must fit in 64 bits.
DEPTH = 4
#: Rows of a file, as a power of two, that make a block. Texts beyond 2 ** LONG_BITS bytes have blocks of their own, of half the rows for each doubling,
#: so that a block has at most 2 ** (BLOCK_BITS + LONG_BITS + 1) bytes, or one text.
BLOCK_BITS, LONG_BITS = 12, 16
#: Parts of a block's counts after which they are added up.
PARTS = 32
GRAM, WORD = 0, 1
HALF = math.log(0.5)


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for positive x: Stirling's series after the recurrence has moved x above 8."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    x = x.copy()
    for _ in range(8):
        low = x < 8
        if not low.any():
            break
        shift[low] += np.log(x[low])
        x[low] += 1
    y = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x - shift


def kt_log(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with a zeros and b ones."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - lgamma(a + b + 1) - math.log(math.pi)


def grams(buf: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """One gram for each byte, and for an end (byte 0) after each text: the byte below, then its context, latest byte first. Before a text there are zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    starts = offsets[:-1] + np.arange(n) * (depth + 1) + depth  # of each text, with zeros before it and one end after it
    out = np.zeros(len(buf) + n * (depth + 1), np.uint64)
    places = np.arange(len(buf)) + np.repeat(starts - offsets[:-1], size)
    out[places] = buf
    code = out.copy()
    for d in range(1, depth + 1):
        code[d:] |= out[:-d] << np.uint64(8 * d)
    keep = np.ones(len(out), bool)
    for d in range(1, depth + 1):
        keep[starts - d] = False
    return code[keep]


class Tree:
    """The nodes of the context tree for a set of grams that holds all grams of each of its contexts of ``top`` bytes or none."""

    def __init__(self, gram: np.ndarray, count: np.ndarray, depth: int, top: int):
        self.depth, self.top = depth, top
        self.levels: dict[int, tuple] = {}
        below = None
        for d in range(depth, top - 1, -1):
            keys, ones = self.bits(gram, d)
            node, back = np.unique(keys, return_inverse=True)
            back = back.reshape(-1)
            weight = np.repeat(count.astype(float), 8)
            b = np.bincount(back, weight * ones, len(node))
            a = np.bincount(back, weight, len(node)) - b
            here = kt_log(a, b)
            total = here
            mixed = np.ones(len(node))
            if below is not None:
                children = np.bincount(np.searchsorted(node, below[0] & np.uint64((1 << (8 * d + 8)) - 1)), below[1], len(node))
                total = np.logaddexp(HALF + here, HALF + children)
                mixed = np.exp(HALF + here - total)
            self.levels[d] = (node, mixed, (b + 0.5) / (a + b + 1), a, b, total)
            below = (node, total)

    @staticmethod
    def bits(gram: np.ndarray, d: int):
        """(node, bit) for each of the eight decisions of each gram at depth d: a node is its context, then a one and the bits before."""
        byte = (gram & np.uint64(255))[:, None]
        context = (gram >> np.uint64(8))[:, None] & np.uint64((1 << (8 * d)) - 1)
        k = np.arange(8, dtype=np.uint64)[None, :]
        node = (context << np.uint64(8)) | (np.uint64(1) << k) | (byte >> (np.uint64(8) - k))
        return node.reshape(-1), ((byte >> (np.uint64(7) - k)) & np.uint64(1)).astype(float).reshape(-1)

    def predict(self, gram: np.ndarray, p: np.ndarray | None = None) -> np.ndarray:
        """The probability of each decision's bit, mixed from the deepest level up to ``top``. p: what deeper nodes say."""
        for d in range(self.depth, self.top - 1, -1):
            node, mixed, one = self.levels[d][:3]
            keys, ones = self.bits(gram, d)
            at = np.searchsorted(node, keys)
            here = np.where(ones > 0, one[at], 1 - one[at])
            p = here if p is None else mixed[at] * here + (1 - mixed[at]) * p
        return p


def _upper(rows) -> dict[int, tuple]:
    """Levels 1 and 0 from (node at depth 1, a, b, total): at most 65,280 of them."""
    node = np.array([r[0] for r in rows], np.uint64)
    by = np.argsort(node)
    node, a, b, children = node[by], *(np.array([r[k] for r in rows], float)[by] for k in (1, 2, 3))
    out = {}
    for d in (1, 0):
        here = kt_log(a, b)
        total = np.logaddexp(HALF + here, HALF + children)
        out[d] = (node, np.exp(HALF + here - total), (b + 0.5) / (a + b + 1))
        if d:
            top, back = np.unique(node & np.uint64(255), return_inverse=True)
            back = back.reshape(-1)
            node, a, b, children = top, np.bincount(back, a), np.bincount(back, b), np.bincount(back, total)
    return out


def _blocks(rows: DataFrame) -> DataFrame:
    """rows with chunk (2 ** BLOCK_BITS consecutive rows of a file) and block (the chunk's texts of about one size)."""
    doublings = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.octet_length("text"), F.lit(1)))).cast("int") - LONG_BITS)
    doublings = F.least(F.coalesce(doublings, F.lit(0)), F.lit(BLOCK_BITS))
    rows = rows.withColumn("chunk", F.shiftright("_row", BLOCK_BITS)).withColumn("_d", doublings)
    return rows.withColumn("block", F.xxhash64("chunk", "_d", F.expr(f"shiftright(_row & {(1 << BLOCK_BITS) - 1}, {BLOCK_BITS} - _d)"))).drop("_d")


def _block_counts(docs: DataFrame, depth: int) -> DataFrame:
    """(block, kind, key, n): the grams and words of each block and how often its training texts have them."""

    def added(parts):
        keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(back.reshape(-1), np.concatenate([c for _, c in parts]), len(keys))

    def count(batches):
        now, kept = None, {}

        def flush():
            for (block, kind), parts in kept.items():
                keys, n = added(parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block)), pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["block", "kind", "key", "n"])
            kept.clear()

        def add(block, kind, values, learn):
            parts = kept.setdefault((block, kind), [])
            keys, back = np.unique(values, return_inverse=True)
            parts.append((keys, np.bincount(back.reshape(-1), learn, len(keys))))
            if len(parts) > PARTS:
                parts[:] = [added(parts)]

        for batch in batches:
            chunks, blocks, learns = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            cuts = [0, *(np.flatnonzero(np.diff(chunks)) + 1), len(chunks)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                if now is not None and chunks[lo] != now:
                    yield from flush()
                now = chunks[lo]
                for block in np.unique(blocks[lo:hi]):
                    own = lo + np.flatnonzero(blocks[lo:hi] == block)
                    for at, buf, offsets in C.text_slices(batch.column(2).take(pa.array(own))):
                        buf = C.lowered(buf)
                        learn = learns[own[at : at + len(offsets) - 1]].astype(float)
                        add(int(block), GRAM, grams(buf, offsets, depth), np.repeat(learn, np.diff(offsets) + 1))
                        start, end, first = C.word_spans(buf, offsets)
                        add(int(block), WORD, C.word_hashes(buf, start, end), np.repeat(learn, np.diff(first)))
        if now is not None:
            yield from flush()

    return docs.select("chunk", "block", "text", "learn").mapInArrow(count, "block long, kind tinyint, key long, n long")


def _gram_scores(counts: DataFrame, depth: int) -> DataFrame:
    """(key, value): the log10 probability of every gram's byte in its context."""
    spark = counts.sparkSession
    dealt = counts.repartition(C.partitions(spark), F.expr("shiftright(key, 8) & 65535"))

    def table(batches):
        parts = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return None, None
        return np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])

    def tops(batches):
        gram, n = table(batches)
        if gram is None or not len(gram):
            return
        node, _, _, a, b, total = Tree(gram, n, depth, 2).levels[2]
        up, back = np.unique(node & np.uint64(0xFFFF), return_inverse=True)
        back = back.reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(up.view(np.int64)), *(pa.array(np.bincount(back, x)) for x in (a, b, total))], ["node", "a", "b", "total"])

    top = dealt.mapInArrow(tops, "node long, a double, b double, total double").groupBy("node").agg(F.sum("a"), F.sum("b"), F.sum("total"))
    shared = spark.sparkContext.broadcast(_upper([tuple(r) for r in top.collect()]))

    def score(batches):
        gram, n = table(batches)
        if gram is None or not len(gram):
            return
        tree = Tree(gram, n, depth, 2)
        for lo in range(0, len(gram), 1 << 16):
            own = gram[lo : lo + (1 << 16)]
            p = tree.predict(own)
            for d in (1, 0):
                node, mixed, one = shared.value[d]
                keys, ones = Tree.bits(own, d)
                at = np.searchsorted(node, keys)
                here = np.where(ones > 0, one[at], 1 - one[at])
                p = mixed[at] * here + (1 - mixed[at]) * p
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.log10(p).reshape(-1, 8).sum(1))], ["key", "value"])

    return dealt.mapInArrow(score, "key long, value double")


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out=None, depth: int = DEPTH) -> DataFrame:
    """A row for each document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Texts with ``held_out`` (a column; default crc32(id as text) mod 7 is 2) are scored but not learned from. A-Z count as a-z.
    The text ends with an end mark, which the model codes as a byte and the base score as a token. A null or
    empty text is its end alone. A null id, or a null in ``held_out``, counts as learned from. Repeated ids are scored one by one.
    ``score`` does not depend on how rows are dealt, but for the last digits of sums of floats.
    """
    if not 2 <= depth <= 7:
        raise ValueError("depth must be 2 to 7 bytes")
    spark = docs.sparkSession
    if held_out is None:
        held_out = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(7)) == 2
    held_out = F.coalesce(held_out, F.lit(False))
    rows = C.numbered(C.batched(docs).select(F.col(id_col).alias("_id"), (~held_out).alias("learn"), F.col(text_col).alias("text")), "_id", "learn", "text")
    rows = _blocks(rows)
    counts = C.written(_block_counts(rows, depth), "ctw-counts")
    sums = C.written(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "ctw-sums")
    words = sums.where(F.col("kind") == WORD)
    # The end mark is a token of each training text.
    ends = rows.agg(F.count_if("learn")).first()[0]
    known, total = words.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    train_tokens, distinct = total + ends, known + (ends > 0)
    model = _gram_scores(sums.where(F.col("kind") == GRAM).select("key", "n"), depth)
    held = counts.where(F.col("kind") == WORD)
    back = counts.where(F.col("kind") == GRAM).join(model, "key").select("block", "kind", "key", "value")
    back = back.unionByName(held.join(words.select("key", F.col("n").alias("all")), "key").where(F.col("all") != F.col("n")).select("block", "kind", "key", F.col("all").cast("double").alias("value")))
    id_type = rows.schema["_id"].dataType.simpleString()
    names = ["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"]
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]

    def score(texts: pa.Table, looked: pa.Table) -> pa.Table:
        kind, key, value = (looked.column(c).to_numpy() for c in ("kind", "key", "value"))
        look = {}
        for k in (GRAM, WORD):
            keys, values = key[kind == k].view(np.uint64), value[kind == k]
            by = np.argsort(keys)
            look[k] = (keys[by], values[by])
        texts = texts.combine_chunks()
        learn = texts.column("learn").to_numpy()
        slices = [(at, C.lowered(buf), offsets) for at, buf, offsets in C.text_slices(texts.column("text"))]
        hashed, own = [], []
        for at, buf, offsets in slices:
            start, end, first = C.word_spans(buf, offsets)
            hashed.append((C.word_hashes(buf, start, end), first))
            own.append(hashed[-1][0][np.repeat(learn[at : at + len(offsets) - 1], np.diff(first))])
        mine, n = np.unique(np.concatenate(own or [np.zeros(0, np.uint64)]), return_counts=True)

        def counted(words):
            """Counts in all training texts: those of this block, or what came back because there are more."""
            out = np.zeros(len(words))
            for keys, values in ((mine, n), look[WORD]):
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
                    out = np.where(keys[at] == words, values[at], out)
            return out

        denominator = math.log10(train_tokens + 1 * (distinct + 1))
        end_score = math.log10(ends + 1) - denominator
        outs = []
        for (at, buf, offsets), (words, first) in zip(slices, hashed, strict=True):
            c = counted(words)
            base = np.concatenate(([0], np.cumsum(np.log10(c + 1) - denominator)))
            seen = np.concatenate(([0], np.cumsum(c > 0)))
            keys, values = look[GRAM]
            p = values[np.searchsorted(keys, grams(buf, offsets, depth))]
            past = offsets + np.arange(len(offsets))
            run = np.add.reduceat(p, past[:-1]) if len(p) else np.zeros(0)
            outs.append((np.diff(first) + 1, np.diff(seen[first]) + (ends > 0), np.diff(base[first]) + end_score, run, np.diff(offsets)))
        tokens, knew, base, score_, size = (np.concatenate(x) for x in zip(*outs, strict=True))
        columns = [~learn, tokens, knew, np.full(len(tokens), train_tokens), base, score_, size]
        return pa.Table.from_arrays([texts.column("_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    schema = f"_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    scored = rows.select("block", "_id", "learn", "text").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score, schema)
    return scored.withColumnRenamed("_id", id_col).withColumn("bits_per_byte", F.try_divide(-F.col("score") * math.log2(10), F.col("n_bytes")))
