"""Benchmark decontamination with a distributed positional inverted index.

The index is a table: a row for each block of documents, with the positions of every word of the block (its postings), sorted by
word and then by position.  It is built in one pass over the documents and stored; everything after that
reads the index and no text.

A test phrase is answered from the lists of its words, the rarest in the whole corpus first: that list, moved back to where the
phrase would start, is intersected with the lists of the next rarest words, each moved by its word's offset, until nothing
or a match is left.  A proximity match has all words of a phrase, in any order, within some distance of the rarest one.

Blocks are independent and nothing but counts of words is shuffled.  Test items travel to the executors in slices of a bounded
size; more items than that mean more passes over the index, not a larger broadcast.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes of test text that one pass takes to the executors.
SLICE_BYTES = 4 << 20
#: Phrases whose first lists are expanded together.
QUERIES = 4096


def hashed_words(buf: np.ndarray, offsets: np.ndarray):
    """(hash of each word, first word of each text): lower-case words of letters, digits and non-ASCII bytes."""
    buf = C.lowered(buf)
    start, end, first = C.word_spans(buf, offsets, C.PLAIN_BREAKS)
    return C.word_hashes(buf, start, end), first


class Phrases:
    """The windows of a slice of test items, numbered by distinct word sequence."""

    def __init__(self, items: list[tuple], width: int):
        texts = pa.array([t for _, t in items], pa.large_string())
        found: dict[tuple, int] = {}
        self.items: list[list] = []
        for at, buf, offsets in C.text_slices(texts):
            words, first = hashed_words(buf, offsets)
            for k in range(len(offsets) - 1):
                own = words[first[k] : first[k + 1]].tolist()
                size = min(width, len(own))
                for i in range(len(own) - size + 1 if size else 0):
                    key = tuple(own[i : i + size])
                    if key not in found:
                        found[key] = len(found)
                        self.items.append([])
                    if not self.items[found[key]] or self.items[found[key]][-1] != items[at + k][0]:
                        self.items[found[key]].append(items[at + k][0])
        self.terms = np.unique(np.array([w for key in found for w in key], np.uint64))
        self.size = np.array([len(key) for key in found], np.int64)
        self.ids = [np.searchsorted(self.terms, np.array(key, np.uint64)) for key in found]

    def plan(self, counts: np.ndarray) -> None:
        """Sets, for each size of window, its numbers, the ids of its words, and their offsets from the rarest to the commonest."""
        self.groups = []
        sizes = defaultdict(list)
        for n, ids in enumerate(self.ids):
            sizes[len(ids)].append(n)
        for size, numbers in sorted(sizes.items()):
            ids = np.array([self.ids[n] for n in numbers])
            self.groups.append((size, np.array(numbers), ids, np.argsort(counts[ids], axis=1, kind="stable")))


class Block:
    """The postings of a block for the words that some phrase has.

    ``known`` marks the phrases' words that the block has. Lists are kept as one sorted array of word * span + position, so that a search in it
    is a search in a word's list.
    """

    def __init__(self, terms: np.ndarray, words: np.ndarray, starts: np.ndarray, positions: np.ndarray, first: np.ndarray):
        self.span = int(first[-1]) + 1
        at = np.searchsorted(words, terms)
        at[at == len(words)] = 0
        self.known = words[at] == terms if len(words) else np.zeros(len(terms), bool)
        size = np.where(self.known, starts[at + 1] - starts[at], 0) if len(words) else np.zeros(len(terms), np.int64)
        self.lists = np.concatenate(([0], np.cumsum(size)))
        take = np.arange(self.lists[-1]) - np.repeat(self.lists[:-1], size) + np.repeat(starts[at] if len(words) else size, size)
        self.positions = positions[take].astype(np.int64)
        self.keys = np.repeat(np.arange(len(terms)), size) * self.span + self.positions
        self.text_end = np.repeat(first[1:], np.diff(first))

    def shifted(self, term: np.ndarray, offset: np.ndarray):
        """(query, position - offset) for every posting of each query's term."""
        size = self.lists[term + 1] - self.lists[term]
        query = np.repeat(np.arange(len(term)), size)
        inner = np.arange(len(query)) - np.repeat(np.cumsum(size) - size, size)
        return query, self.positions[self.lists[term][query] + inner] - offset[query]

    def holds(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each term's list has the position."""
        key = term * self.span + position
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return self.keys[at] == key

    def near(self, term: np.ndarray, position: np.ndarray, distance: int) -> np.ndarray:
        """Whether each term's list has a position of the same text no further away."""
        end = self.text_end[position]
        out = np.zeros(len(term), bool)
        right = np.searchsorted(self.keys, term * self.span + position)
        for k in (right - 1, right):
            k = np.clip(k, 0, len(self.keys) - 1)
            other = self.keys[k] - term * self.span
            ok = (other >= 0) & (other < self.span - 1) & (abs(other - position) <= distance)
            out |= ok & (self.text_end[np.where(ok, other, 0)] == end)
        return out


def phrase_matches(block: Block, phrases: Phrases):
    """(phrase, start) of each exact occurrence in the block."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for size, numbers, ids, order in phrases.groups:
        here = np.flatnonzero(block.known[ids].all(axis=1))
        for lo in range(0, len(here), QUERIES):
            own = here[lo : lo + QUERIES]
            terms, offsets = ids[own], order[own]
            query, start = block.shifted(np.take_along_axis(terms, offsets[:, :1], 1)[:, 0], offsets[:, 0])
            ok = (start >= 0) & (start + size < block.span)
            query, start = query[ok], start[ok]
            ok = block.text_end[start] >= start + size
            query, start = query[ok], start[ok]
            for k in range(1, size):
                if not len(query):
                    break
                offset = offsets[query, k]
                ok = block.holds(terms[query, offset], start + offset)
                query, start = query[ok], start[ok]
            out.append((numbers[own[query]], start))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def proximity_matches(block: Block, phrases: Phrases, distance: int):
    """(phrase, position of its rarest word) wherever all its words, in any order, are at most ``distance`` words from there."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for size, numbers, ids, order in phrases.groups:
        here = np.flatnonzero(block.known[ids].all(axis=1))
        for lo in range(0, len(here), QUERIES):
            own = here[lo : lo + QUERIES]
            ranked = np.take_along_axis(ids[own], order[own], 1)
            query, position = block.shifted(ranked[:, 0], np.zeros(len(own), np.int64))
            for k in range(1, size):
                if not len(query):
                    break
                ok = block.near(ranked[query, k], position, distance)
                query, position = query[ok], position[ok]
            out.append((numbers[own[query]], position))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


# --- the index ----------------------------------------------------------------------------------------------------


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index as a table: ids, rows (numbers of the documents), first (where each begins, and the end), words (sorted hashes), starts (of each word's list), positions.

    The last four are arrays of numbers as bytes. Null and empty texts are documents without words.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def index(batches):
        for batch in batches:
            for at, buf, offsets in C.text_slices(batch.column(1)):
                words, first = hashed_words(buf, offsets)
                by = np.argsort(words, kind="stable")
                distinct, starts = np.unique(words[by], return_index=True)
                rows = len(offsets) - 1
                own = [pa.array([x.slice(at, rows).to_pylist()], pa.list_(x.type)) for x in (batch.column(0), batch.column(2))]
                data = [first.astype(np.int32), distinct, np.append(starts, len(words)).astype(np.int32), by.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array([x.tobytes()], pa.binary()) for x in data)], ["ids", "rows", "first", "words", "starts", "positions"])

    return C.numbered(C.batched(docs), id_col, text_col).mapInArrow(index, f"ids array<{kind}>, rows array<long>, first binary, words binary, starts binary, positions binary")


def _numbers(cell, kind) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def term_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each term occurs in all documents, from the lengths of its lists. Only words and starts are read."""

    def count(batches):
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for i in range(len(batch)):
                words, starts = _numbers(batch.column(0)[i], np.uint64), _numbers(batch.column(1)[i], np.int32)
                if len(words):
                    at = np.searchsorted(words, terms)
                    at[at == len(words)] = 0
                    total += np.where(words[at] == terms, starts[at + 1] - starts[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["term", "n"])

    out = np.zeros(len(terms), np.int64)
    for r in index.select("words", "starts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most the terms of a slice
        out[r.term] = r.n
    return out


def _slices(items: DataFrame, item_id: str, item_text: str):
    """The items in lists of at most SLICE_BYTES of text (or one item): the driver never holds more."""
    items = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // SLICE_BYTES)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64(F.col("i").cast("string")), F.lit(n)) == k)
        held, used = [], 0
        for r in part.toLocalIterator():  # a slice by hash may be larger than the mean
            if held and used + len(r.t) > SLICE_BYTES:
                yield held
                held, used = [], 0
            held.append((r.i, r.t))
            used += len(r.t)
        if held:
            yield held


def find_contamination(docs: DataFrame, items: DataFrame, *, width: int = 10, distance: int | None = None, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document: ``id_col``, _row, n_words, n_hit (words inside an occurrence of a window of an item), spans (of hit words: first, past the last), items and near_items (sorted arrays of strings).

    A window is ``width`` consecutive words of an item; an item with fewer words is one window. items have an exact occurrence of a window; near_items a proximity
    match: all words of a window, in any order, at most ``distance`` words from its rarest one (none if distance is None).
    Null or empty texts have no words, items without words or id find nothing, rows with the same
    id are judged one by one, and other columns are not looked at. The matches are written; the index is deleted when all slices have been asked.
    """
    index, drop_index = C.passing(build_index(docs, id_col=id_col, text_col=text_col), "decontamination-index")
    found = []
    for rows in _slices(items, item_id, item_text):
        phrases = Phrases(rows, width)
        if len(phrases.terms):
            phrases.plan(term_counts(index, phrases.terms))
            part = _match(index, phrases, distance, id_col)
            # From the second slice on documents without any match are left out.
            found.append(C.written(part.where("size(spans) > 0 or size(near_items) > 0") if found else part, "contamination"))
    if not found:
        none = Phrases([], width)
        none.plan(np.zeros(0, np.int64))
        found = [C.written(_match(index, none, distance, id_col), "contamination")]
    drop_index()
    out = found[0]
    hits = "aggregate(spans, 0L, (n, s) -> n + s.past - s.first)"
    if len(found) > 1:
        for more in found[1:]:
            out = out.unionByName(more)
        merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        out = out.groupBy("_row").agg(F.first(id_col, True).alias(id_col), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), merged("items"), merged("near_items"))
        hits = "aggregate(array_sort(spans), struct(0L as n, 0L as at), (a, s) -> struct(a.n + greatest(0L, s.past - greatest(s.first, a.at)) as n, greatest(a.at, s.past) as at), a -> a.n)"
    return out.select(id_col, "_row", "n_words", F.expr(hits).alias("n_hit"), "spans", "items", "near_items")


def _match(index: DataFrame, phrases: Phrases, distance: int | None, id_col: str) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(phrases)  # SLICE_BYTES of test text
    spans_type = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))

    def named(rows: int, owner: np.ndarray, phrase: np.ndarray) -> pa.Array:
        """The items of the phrases found in each document."""
        items: dict[int, set] = defaultdict(set)
        for r, w in set(zip(owner.tolist(), phrase.tolist(), strict=True)):
            items[r].update(phrases_of(w))
        return pa.array([sorted(map(str, items[r])) if r in items else [] for r in range(rows)], pa.list_(pa.string()))

    phrases_of = lambda w: shared.value.items[w]

    def search(batches):
        phrases: Phrases = shared.value
        for batch in batches:
            for i in range(len(batch)):
                first = _numbers(batch.column(2)[i], np.int32).astype(np.int64)
                block = Block(phrases.terms, _numbers(batch.column(3)[i], np.uint64), _numbers(batch.column(4)[i], np.int32).astype(np.int64), _numbers(batch.column(5)[i], np.int32), first)
                rows, total = len(first) - 1, int(first[-1])
                phrase, start = phrase_matches(block, phrases)
                length = phrases.size[phrase] if len(phrase) else np.zeros(0, np.int64)
                edge = np.zeros(total + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + length, -1)
                covered = np.cumsum(edge[:-1]) > 0
                new = np.zeros(total + 1, bool)
                new[first] = True
                opens = np.flatnonzero(covered & (new[:-1] | ~np.concatenate(([False], covered[:-1]))))
                closes = np.flatnonzero(covered & (new[1:] | ~np.concatenate((covered[1:], [False])))) + 1
                owner = np.searchsorted(first, opens, "right") - 1
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(opens - first[owner]), pa.array(closes - first[owner])], ["first", "past"]))
                close, position = proximity_matches(block, phrases, distance) if distance is not None else (np.zeros(0, np.int64),) * 2
                in_doc = lambda at: np.searchsorted(first, at, "right") - 1  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i].values, batch.column(1)[i].values, pa.array(np.diff(first)), spans.cast(spans_type), named(rows, in_doc(start), phrase), named(rows, in_doc(position), close)],
                    [id_col, "_row", "n_words", "spans", "items", "near_items"],
                )

    kind = index.schema["ids"].dataType.elementType.simpleString()
    # A batch holds a few blocks: their bytes bound it, not their number.
    return index.mapInArrow(search, f"`{id_col}` {kind}, _row long, n_words long, spans array<struct<first: long, past: long>>, items array<string>, near_items array<string>")
