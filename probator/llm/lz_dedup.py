"""Removal of repeated passages by relative Lempel-Ziv parsing.

A factor of WIDTH words or more lies in passages that share an anchor (see ``anchors``), so what a document could
have in common with others comes to the reference blocks that hold it, and what lies between has no such factor.  The passages
of an anchor form a reference block, in the order in which the corpus has them.  Each passage is parsed greedily
against the block's index of the passages before it: a factor is a run of words, at least WIDTH of them, that the reference
also has, compared word by word.  Where it ends, the window across its end is looked up: if an occurrence of that goes
back to the factor's beginning, the factor goes on there, else the next one starts.  A long factor is a duplicate
span, and since every window across an end is looked up, none is hidden between two factors.  Then the passage joins the reference.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from . import common as C

#: Words of a passage that counts as repeated, and of the grams that anchor it.
WIDTH = 20
GRAM = 5


class Reference:
    """A reference block: the words of the passages so far, and where each window of ``width`` words first occurs in them."""

    def __init__(self, width: int):
        self.width = width
        self.words: list[int] = []
        self.index: dict[int, int] = {}

    def occurrence(self, words: list[int], keys: list[int], p: int) -> int | None:
        """Where the reference has the window at p first, the same words and not just the same hash."""
        at = self.index.get(keys[p])
        return at if at is not None and self.words[at : at + self.width] == words[p : p + self.width] else None

    def extent(self, words: list[int], p: int, at: int, size: int) -> int:
        """How many words from p on the reference has from ``at`` on, given that it has ``size``."""
        while p + size < len(words) and at + size < len(self.words) and self.words[at + size] == words[p + size]:
            size += 1
        return size

    def parse(self, words: list[int], keys: list[int]) -> list[tuple[int, int]]:
        """Factors (start, length) of at least ``width`` words, greedily from the left. keys: the hash of each window."""
        out, p, n = [], 0, len(keys)
        while p < n:
            at = self.occurrence(words, keys, p)
            if at is None:
                p += 1
                continue
            size = self.extent(words, p, at, self.width)
            while (q := p + size - self.width + 1) < n and (other := self.occurrence(words, keys, q)) is not None:
                back = other - (q - p)
                if back < 0 or self.words[back:other] != words[p:q]:
                    break
                size = self.extent(words, p, back, size)
            out.append((p, size))
            # Windows across the factor's end start within its last width - 1 words.
            p += size - self.width + 1
        return out

    def add(self, words: list[int], keys: list[int]) -> None:
        base = len(self.words)
        self.words += [*words, -1]  # -1 is no word's hash: factors do not run into the next passage
        for i, key in enumerate(keys):
            self.index.setdefault(key, base + i)


def parse_blocks(data: list[np.ndarray], blocks: list[int], width: int) -> list[np.ndarray | None]:
    """For each passage the mask of its windows that an earlier passage of its block has, or None."""
    out, now, reference = [], None, None
    sizes = np.array([len(d) for d in data])
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    h = C.prefix_hash(np.concatenate(data))
    for i, words in enumerate(data):
        if blocks[i] != now:
            now, reference = blocks[i], Reference(width)
        at = np.arange(bounds[i], bounds[i + 1] - width + 1)
        keys = C.span_hash(h, at, at + width).tolist()
        listed = words.tolist()
        factors = reference.parse(listed, keys) if reference.index else []
        if factors:
            mask = np.zeros(len(keys), bool)
            for start, size in factors:
                mask[start : start + size - width + 1] = True
            out.append(mask)
        else:
            out.append(None)
        reference.add(listed, keys)
    return out


def word_symbols(buf: np.ndarray, offsets: np.ndarray):
    start, end, first = C.word_spans(buf, offsets)
    return C.word_hashes(buf, start, end), first


def remove_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """A row for each document: id, n_words, n_removed, kept_sha256 (and with ``keep_text`` kept, the words left joined by spaces).

    Each word inside a window of ``width`` words that also starts earlier (smaller id, or same document and earlier) goes.
    Windows are judged on the input, words compare unchanged. A null or empty text has no words. Ids order
    null first; rows with one id are separate documents in the order of the table.
    """
    rows = C.numbered(C.batched(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")), "_id", "text")

    def compare(data, blocks, _copies):
        return parse_blocks(data, blocks, width)

    spans = anchors.repeats(rows, word_symbols, compare, k=gram, width=width, first_stays=True, symbol_bytes=8, name="passages")
    found = rows.join(spans, "_row", "left").select("_id", "text", "spans")

    def finish(batches):
        for batch in batches:
            counts, gone, kept = [], [], []
            for at, buf, offsets in C.text_slices(batch.column(1)):
                for r in range(len(offsets) - 1):
                    words = buf[offsets[r] : offsets[r + 1]].tobytes().split()  # bytes.split() splits at the six white-space characters
                    counts.append(len(words))
                    s = batch.column(2)[at + r].as_py()
                    if s:
                        mask = anchors.covered(len(words), s, width)
                        words = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
                    gone.append(counts[-1] - len(words))
                    kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), *([pa.array([k.decode() for k in kept], pa.string())] if keep_text else [])],
                ["_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if keep_text else [])],
            )

    return found.mapInArrow(finish, f"_id {rows.schema['_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text).withColumnRenamed("_id", id_col)
