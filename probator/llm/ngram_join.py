"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's tokens are the distinct hashes of its N-word shingles, in the order of the hash.  Two sets with a similarity of
at least t share at least l of the first |set| - ceil(t |set|) + l tokens of each, for every l: the longer the prefix, the
more matches are due.  Tokens in many sets cost many candidates, so each document's prefix is lengthened until
fewer than l of its tokens are such costly ones: among l shared tokens at least one is then cheap, and
looking up the cheap ones finds every partner.  Further cheap tokens lengthen the prefix again, up to MATCHES of them are then
due from a pair, and a pair that shares fewer is not verified.

Long sets post a share of their tokens only.  Those whose prefix cannot be lengthened enough within it, and
the documents that share a costly token with them, form a second round in which whole sets are posted: there a token
that no other document of the round has cannot be shared, which rules out most of them, and a set made
almost wholly of costly tokens takes its rarest ones.

Tokens that no other cluster holds cannot be shared: they shorten the prefix, since the same number of matches is due from
fewer tokens, and with the places of a shared token they bound how much two sets can have in common.
A document with too few other tokens has no partner, and pairs whose bound is too small are not made.  Nor are pairs whose
bitmaps differ in too many bits: a set's bitmap has the parity of its tokens at each place, so sets differ in at least as
many tokens as their bitmaps in bits.

Classes first: equal sets are one document, and documents that a first round links to a holder of their
tokens (stars, never all pairs) are one cluster.  Cost counts clusters, and only pairs of different clusters are
candidates, so a group of n near copies takes about n comparisons.  Every candidate is
verified on its whole set; links within a cluster are implied by connectivity.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .components import connected_components

WORDS = 5
#: Similarity in per cent.
PERCENT = 75
#: A token in more clusters than this is costly.
COSTLY = 4
#: Shared tokens that are due from a pair, where both prefixes have as many cheap ones to spare.
MATCHES = 3
#: How far a prefix may grow: over the whole set up to FULL tokens, else over the hashes below LOW, which are REACH of all.
FULL, REACH = 256, 0.35
LOW = np.uint64(int(REACH * 2**64))
#: Passes over the tokens when postings are made.
PASSES = 2
#: Names of the 64-bit parts of a set's bitmap, and the parts of the finer one that sets of the second round have.
BITS = [f"bits{k}" for k in range(8)]
FINE = 64
#: Documents of one block when candidates are verified.
FAMILY = 64
#: Parts of the documents of a family or a component, when they meet what holds for all of it, and the members from which that is done.
SALT, CROWD = 16, 1024
#: Tokens that are judged together, in whole documents.
HELD = 1 << 17


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, words: int):
    """A sorted array of distinct shingle hashes for each text: all its words at once if there are fewer than ``words``."""
    buf = C.lowered(buf)
    start, end, first = C.word_spans(buf, offsets)
    h = C.prefix_hash(C.word_hashes(buf, start, end))
    sizes = np.diff(first)
    count = np.where(sizes == 0, 0, np.maximum(1, sizes - words + 1))
    owner = np.repeat(np.arange(len(sizes)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]
    to = np.minimum(at + words, first[owner + 1])
    hashes = C.span_hash(h, at, to)
    edges = np.concatenate(([0], np.cumsum(count)))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(sizes) + 1))


def _prefixes(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(_id, _row, size, posted, counted, same, tokens, sketch, bits0 and so on).

    size and same: the size and hash of the set. tokens: its longest prefix, ``posted`` tokens. The first ``counted`` of them
    are in the prefix of any similar set that holds them. sketch: 16 bits of each token. And the set's bitmap.
    """

    def work(batches):
        for batch in batches:
            for at, buf, offsets in C.text_slices(batch.column(2)):
                hashes, bounds = shingle_sets(buf, offsets, words)
                size = np.diff(bounds)
                h = C.prefix_hash(hashes)
                same = C.span_hash(h, bounds[:-1], bounds[1:])
                need = -(-size * percent // 100)
                low = np.diff(np.concatenate(([0], np.cumsum(hashes < LOW)))[bounds])
                longest = np.where(size <= FULL, size, np.maximum(size - need + 1, low))
                counted = np.where(100 * size <= FULL * percent, size, low)
                owner = np.repeat(np.arange(len(size)), longest)
                take = np.arange(len(owner)) - np.repeat(np.cumsum(longest) - longest, longest) + bounds[owner]
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(longest))), pa.int32()), pa.array(hashes[take].view(np.int64)))
                bits = _parities(hashes, bounds, len(BITS))
                short = (hashes & np.uint64(0xFFFF)).astype(np.uint16)
                sketch = [np.sort(short[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(size)), batch.column(1).slice(at, len(size)), *(pa.array(c, pa.int64()) for c in (size, longest, counted)), pa.array(same.view(np.int64)), tokens, pa.array(sketch, pa.binary()), *(pa.array(bits[:, k]) for k in range(len(BITS)))], ["_id", "_row", "size", "posted", "counted", "same", "tokens", "sketch", *BITS])

    return rows.select("_id", "_row", "text").mapInArrow(work, f"_id {rows.schema['_id'].dataType.simpleString()}, _row long, size long, posted long, counted long, same long, tokens array<long>, sketch binary, {', '.join(b + ' long' for b in BITS)}")


def _full_sets(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rep, data): the whole set of each wanted document, as sorted 64-bit integers."""

    def work(batches):
        for batch in batches:
            for at, buf, offsets in C.text_slices(batch.column(1)):
                hashes, bounds = shingle_sets(buf, offsets, words)
                data = [hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(data)), pa.array(data, pa.binary())], ["rep", "data"])

    return rows.select("_row", "text").join(wanted.select(F.col("rep").alias("_row")), "_row").mapInArrow(work, "rep long, data binary")


def _ranked16(sketch: np.ndarray) -> np.ndarray:
    """A sorted multiset of 16-bit values as distinct numbers: value and how many equal ones stand before it."""
    return sketch.astype(np.int64) << 32 | (np.arange(len(sketch)) - np.searchsorted(sketch, sketch))


def _verified(pairs: DataFrame, sets: DataFrame, blocks: DataFrame, percent: int, sketched: bool) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough.

    With ``sketched`` the sets are 16 bits of each token, and equal bits count as a match: that finds no less than the
    truth, so it only clears pairs away, and those left are held against the tokens themselves.

    Sets travel to pairs of blocks, not to pairs of documents: documents with a common family share
    blocks of about FAMILY, so each set is sent once for many partners, and no task holds more than two blocks.
    """
    placed = pairs.join(blocks.select(F.col("rep").alias("a"), F.col("block").alias("ba")), "a").join(blocks.select(F.col("rep").alias("b"), F.col("block").alias("bb")), "b")
    members = placed.select("ba", "bb", F.explode(F.array("a", "b")).alias("rep")).distinct().join(sets, "rep")
    none = F.lit(None)
    both = members.select("ba", "bb", F.lit(0).alias("kind"), F.col("rep").alias("a"), none.cast("long").alias("b"), "data").unionByName(placed.select("ba", "bb", F.lit(1).alias("kind"), "a", "b", none.cast("binary").alias("data")))
    both = both.repartition(C.partitions(pairs.sparkSession), "ba", "bb").sortWithinPartitions("ba", "bb", "kind")

    def work(batches):
        now, held = None, {}
        for batch in batches:
            found = []
            data = batch.column(5)
            for i, (x, y, kind, a, b) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)):
                if (x, y) != now:
                    now, held = (x, y), {}
                if not kind:
                    held[a] = _ranked16(np.frombuffer(data[i].as_py(), np.uint16)) if sketched else np.frombuffer(data[i].as_py(), np.uint64)
                    continue
                merged = np.concatenate((held[a], held[b]))
                merged.sort()
                shared = int((merged[1:] == merged[:-1]).sum())
                if 100 * shared >= percent * (len(merged) - shared):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return both.mapInArrow(work, "a long, b long")


def _linked(rows: DataFrame, pairs: DataFrame, sketches: DataFrame, blocks: DataFrame, words: int, percent: int, name: str) -> DataFrame:
    """The similar ones of the pairs. Whole sets are made for those documents only that sketches leave in a pair."""
    pairs, drop_pairs = C.passing(pairs, f"{name}-pairs")
    left, drop_left = C.passing(_verified(pairs, sketches, blocks, percent, True), f"{name}-left")
    drop_pairs()
    wanted = left.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    full, drop_full = C.passing(_full_sets(rows, wanted, words), f"{name}-sets")
    links = C.written(_verified(left, full, blocks, percent, False), name)
    drop_left()
    drop_full()
    return links


def _parities(hashes: np.ndarray, bounds: np.ndarray, parts: int) -> np.ndarray:
    """A row of 64-bit numbers for each set: bit by bit, whether an odd number of its tokens falls there."""
    n, width = len(bounds) - 1, 64 * parts
    place = np.repeat(np.arange(n), np.diff(bounds)) * width + ((hashes >> np.uint64(20)) % np.uint64(width)).astype(np.int64)
    odd = (np.bincount(place, minlength=n * width) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(n, parts)


def _whole_sets(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rep, size, tokens, fine): all tokens of each wanted document, and its finer bitmap."""

    def work(batches):
        for batch in batches:
            for at, buf, offsets in C.text_slices(batch.column(1)):
                hashes, bounds = shingle_sets(buf, offsets, words)
                n = len(bounds) - 1
                tokens = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes.view(np.int64)))
                fine = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * FINE, pa.int32()), pa.array(_parities(hashes, bounds, FINE).reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(np.diff(bounds), pa.int64()), tokens, fine], ["rep", "size", "tokens", "fine"])

    own = rows.select("_row", "text").join(wanted.select(F.col("rep").alias("_row")), "_row")
    return own.mapInArrow(work, "rep long, size long, tokens array<long>, fine array<long>")


def _postings(posted: DataFrame, name: str):
    """(rep, size, pos, token, pivot) of the tokens that several documents have, pivot being the least of these; and a function that deletes it.

    In passes over a share of the tokens each, so that the postings are never all in shuffle files at once.
    """
    parts = []
    for k in range(PASSES):
        some = posted.where(F.pmod("token", F.lit(PASSES)) == k)
        tokens, drop_tokens = C.passing(some.groupBy("token").agg(F.count("*").alias("n"), F.min("rep").alias("pivot")).where("n > 1").select("token", "pivot"), f"{name}-tokens")
        parts.append(C.passing(some.join(tokens, "token"), f"{name}-postings"))
        drop_tokens()
    return reduce(DataFrame.unionByName, (part for part, _ in parts)), lambda: [drop() for _, drop in parts]


def _priced(shared: DataFrame, cluster: DataFrame, name: str):
    """(the postings with cluster and clusters, the number of clusters that have the token, without tokens that one cluster only has; leading costly tokens; a function that deletes both).

    A passage that many documents have is as many tokens as it has words, but all of them have the same holders, known by their number and the sum modulo 2
    of their hashes. The first of such tokens leads: who looks up one of them looks up the first as well, so a pair meets there.
    """
    known = shared.select("rep", "size", "pos", "token").join(cluster, "rep", "left").withColumn("cluster", F.coalesce("cluster", "rep"))
    kinds = known.groupBy("token", "cluster").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("who"))
    wide = kinds.groupBy("token").agg(F.count("*").alias("clusters"), F.sum("n").alias("n"), F.bit_xor("who").alias("who")).where("clusters > 1")
    wide, drop_wide = C.passing(wide, f"{name}-tokens")
    priced, drop_priced = C.passing(known.join(wide.select("token", "clusters"), "token"), name)
    order = F.col("token").bitwiseXOR(F.lit(-(2**63)))  # hashes are ordered as they would be without a sign
    leads = wide.where(F.col("clusters") > COSTLY).groupBy("n", "who").agg(F.min(order).alias("least")).select(F.col("least").bitwiseXOR(F.lit(-(2**63))).alias("token"))
    return priced, leads, lambda: (drop_priced(), drop_wide())


def _active(known: DataFrame, prefixes: DataFrame | None, percent: int) -> DataFrame:
    """(rep, size, most, token, cluster, clusters, costly, place, stuck, fills, near, due): what each document looks up.

    ``most`` is how many of its tokens another cluster may hold, ``place`` how many of these stand before the token when
    cheap ones come first, in the order of the hash, and costly ones follow by rising cost. ``due`` is how many of the tokens that it looks
    up a partner must look up as well. prefixes: rep, posted, counted; without them whole sets are posted.

    A document's tokens come in order, after a row with its prefix; batches are closed where a document ends.
    """
    names = ["rep", "size", "most", "token", "cluster", "clusters", "costly", "place", "stuck", "fills", "near", "due"]
    rows = known.select("rep", "pos", "size", "token", "cluster", "clusters")
    whole = prefixes is None
    if not whole:
        rows = rows.unionByName(prefixes.select("rep", F.lit(-1).alias("pos"), F.lit(0).cast("long").alias("size"), F.col("posted").alias("token"), F.col("counted").alias("cluster"), F.lit(0).cast("long").alias("clusters")))
    dealt = rows.repartition(C.partitions(known.sparkSession), "rep").sortWithinPartitions("rep", "pos")

    def judged(rep, pos, size, token, cluster, clusters):
        begins = np.concatenate(([True], rep[1:] != rep[:-1]))
        group = np.cumsum(begins) - 1
        n = group[-1] + 1
        if whole:
            posted = counted = size[begins]
        else:
            posted, counted = token[begins], cluster[begins]
            body = pos >= 0
            rep, pos, size, token, cluster, clusters, group = (x[body] for x in (rep, pos, size, token, cluster, clusters, group))
        costly = clusters > COSTLY
        inside = pos < counted[group]
        alone = counted - np.bincount(group, inside, n).astype(np.int64)
        dear = np.bincount(group, costly, n).astype(np.int64)
        start = np.searchsorted(group, np.arange(n))
        seen = np.concatenate(([0], np.cumsum(costly)))
        before = seen[:-1] - seen[start[group]]
        turn = np.zeros(len(group), np.int64)
        own = np.flatnonzero(costly)
        by = own[np.lexsort((pos[own], clusters[own], group[own]))]
        turn[by] = np.arange(len(by)) - np.searchsorted(group[by], group[by])
        most = size - alone[group]
        first = most + (-size * percent) // 100 + 1
        rank = np.where(inside, np.arange(len(group)) - start[group], pos - alone[group])
        cheap = (posted - alone - dear)[group]
        few, ends = cheap < first, posted[group] == size
        # A set that is all posted takes all its cheap tokens and its rarest costly ones; a longer one that is stuck goes to the second round.
        stuck, near = few & ~ends, rank < first
        fills = few & ends & costly & (turn < first - cheap)
        place = np.where(costly, cheap + turn, rank - before)
        due = np.where(few, 1, np.minimum(MATCHES, cheap - first + 1))
        looks = np.where(costly, fills | (near & (100 * size > FULL * percent)), np.where(stuck, near, place < first + due - 1))
        keep = np.flatnonzero((first > 0) & looks)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (rep, size, most, token, cluster, clusters, costly, place, stuck, fills, near, due)], names)

    def work(batches):
        held = None
        for batch in batches:
            now = [batch.column(k).to_numpy() for k in range(6)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if len(held[0]) < HELD or held[0][0] == held[0][-1]:
                continue
            cut = np.searchsorted(held[0], held[0][-1])
            yield judged(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            yield judged(*held)

    return dealt.mapInArrow(work, "rep long, size long, most long, token long, cluster long, clusters long, costly boolean, place long, stuck boolean, fills boolean, near boolean, due long")


def _candidates(known: DataFrame, leads: DataFrame, percent: int, fine: DataFrame | None = None) -> DataFrame:
    """(a, b): documents of different clusters that share as many of the tokens they look up as is due, and can have enough in common.

    known: also ``asks``; one of the two must. leads: the costly tokens that stand for others. fine: (rep, fine), finer bitmaps for sets of costly tokens, whose
    pairs are otherwise too many where texts are put together from the same passages.
    """

    def side(rows: DataFrame, cluster: str, k: str) -> DataFrame:
        return rows.select("token", F.col("cluster").alias(cluster), F.col("rep").alias(k), F.col("size").alias(f"s{k}"), F.col("most").alias(f"m{k}"), F.col("place").alias(f"p{k}"), F.col("due").alias(f"d{k}"), F.col("asks").alias(f"asks{k}"), *(F.col(b).alias(f"{b}{k}") for b in BITS))

    both = F.col("sx") + F.col("sy")
    differ = sum((F.bit_count(F.col(f"{b}x").bitwiseXOR(F.col(f"{b}y"))) for b in BITS), F.lit(0))
    shared = F.least("px", "py") + F.least(F.col("mx") - F.col("px"), F.col("my") - F.col("py"))
    enough = (F.col("asksx") | F.col("asksy")) & (100 * F.least("sx", "sy") >= percent * F.greatest("sx", "sy")) & ((100 + percent) * shared >= percent * both) & ((100 + percent) * differ <= (100 - percent) * both)
    # Cheap tokens: pairs of clusters first, so that nothing within a cluster is paired.
    cheap, fills = known.where("not costly"), known.where("fills").join(leads, "token", "left_semi")
    held = cheap.groupBy("token", "cluster").agg(F.count("*").alias("n"))
    meet = held.select("token", F.col("cluster").alias("ca")).join(held.select("token", F.col("cluster").alias("cb")), "token").where("ca < cb")
    pairs = meet.join(side(cheap, "ca", "x"), ["token", "ca"]).join(side(cheap, "cb", "y"), ["token", "cb"]).where(enough)
    # Costly tokens: only of sets that have too few cheap ones.
    left, right = side(fills, "ca", "x"), side(fills, "cb", "y")
    if fine is not None:
        left, right = (d.join(fine.select(F.col("rep").alias(k), F.col("fine").alias(f"f{k}")), k) for d, k in ((left, "x"), (right, "y")))
        apart = F.aggregate(F.zip_with("fx", "fy", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, d: n + d)
        enough = enough & ((100 + percent) * apart <= (100 - percent) * both)
    pairs = pairs.select("x", "y", "dx", "dy").unionByName(left.join(right, "token").where((F.col("ca") < F.col("cb")) & enough).select("x", "y", "dx", "dy"))
    met = pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("n"), F.min(F.least("dx", "dy")).alias("due"))
    return met.where("n >= due").select("a", "b")


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row for each document: id, _row, n_shingles, component_id (least id reachable by links), is_first (of its component, by id and row).

    Documents link when 100 * shared >= percent * union of their shingle sets. A null or empty text has an empty set and
    links with nothing. Rows with one id are separate documents; a null id counts as the least.
    """
    rows = C.numbered(C.batched(docs).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")), "_id", "text")
    sets = C.written(_prefixes(rows, words, percent), "ngram-prefixes")
    classes = sets.where("size > 0").groupBy("same", "size").agg(F.min("_row").alias("rep"))
    reps = C.written(classes, "ngram-classes")
    posted = sets.select(F.col("_row").alias("rep"), "size", "tokens").join(reps.select("rep"), "rep", "left_semi").select("rep", "size", F.posexplode("tokens").alias("pos", "token"))
    shared, drop_shared = _postings(posted, "ngram")
    sketches = sets.select(F.col("_row").alias("rep"), F.col("sketch").alias("data"))
    # A document's family is the least holder of most of its tokens; families are cut in blocks by hash.
    family = shared.groupBy("rep", "pivot").agg(F.count("*").alias("n")).groupBy("rep").agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("family"))
    crowds = family.groupBy("family").agg(F.ceil(F.count("*") / FAMILY).alias("parts")).where("parts > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    blocks = family.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit("salt")), F.lit(SALT)).cast("int")).join(crowds, ["family", "salt"], "left").select("rep", F.xxhash64("family", F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1)))).alias("block"))
    blocks = C.written(blocks, "ngram-blocks")
    first = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    # First round: stars around the least holder of a token, and around the holder with the largest share of tokens that
    # others have: an original has more of them than its edited copies, which may be too far from each other to link.
    ranks = shared.groupBy("rep", "size").agg(F.round(F.count("*") / F.col("size"), 3).alias("share")).select("rep", "share")
    hubs = shared.select("rep", "token").join(ranks, "rep").groupBy("token").agg(F.max_by("rep", F.struct("share", -F.col("rep"))).alias("hub"))
    around = shared.select("rep", "size", F.col("pivot").alias("hub")).unionByName(shared.select("rep", "size", "token").join(hubs, "token").where("hub <> rep").select("rep", "size", "hub"))
    stars = around.where("hub <> rep").groupBy("rep", "hub", "size").agg(F.count("*").alias("n")).where(F.col("n") * 2 >= first)
    stars = stars.select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()
    links = _linked(rows, stars, sketches, blocks, words, percent, "ngram-stars")
    cluster = C.written(connected_components(links).select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "ngram-clusters")
    bits = sets.select(F.col("_row").alias("rep"), *BITS)
    wide, leads, drop_wide = _priced(shared, cluster, "ngram-wide")
    drop_shared()
    known, drop_known = C.passing(_active(wide, sets.select(F.col("_row").alias("rep"), "posted", "counted"), percent).join(bits, "rep").withColumn("asks", F.lit(True)), "ngram-active")
    pairs, drop_pairs = C.passing(_candidates(known, leads, percent), "ngram-met")
    drop_wide()
    # Second round: a stuck document and a partner both have one of their costly tokens in their 1-match prefixes.
    dear = known.where("costly and near")
    again = dear.groupBy("token").agg(F.max("stuck").alias("any"), F.min("cluster").alias("lo"), F.max("cluster").alias("hi")).where("any and lo <> hi").select("token")
    again, drop_again = C.passing(dear.join(again, "token", "left_semi").groupBy("rep").agg(F.max("stuck").alias("asks")), "ngram-again")
    drop_known()
    whole, drop_whole = C.passing(_whole_sets(rows, again, words), "ngram-whole")
    shared, drop_shared = _postings(whole.select("rep", "size", F.posexplode("tokens").alias("pos", "token")), "ngram-whole")
    wide, leads, drop_wide = _priced(shared, cluster, "ngram-whole-wide")
    drop_shared()
    known, drop_known = C.passing(_active(wide, None, percent).join(bits, "rep").join(again, "rep"), "ngram-whole-active")
    links = links.unionByName(_linked(rows, pairs.unionByName(_candidates(known, leads, percent, whole.select("rep", "fine"))).distinct(), sketches, blocks, words, percent, "ngram-links"))
    for drop in (drop_pairs, drop_again, drop_known, drop_wide, drop_whole):
        drop()
    found = connected_components(links)
    # Back to all documents: their class, its component, and the least id in it.
    members = sets.select("_id", "_row", "size", "same").join(reps, ["same", "size"], "left").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    members = members.select("_id", "_row", "size", F.coalesce("component", "rep", F.when(F.col("size") == 0, -1 - F.col("_row"))).alias("_c"))
    members = C.written(members, "ngram-members")
    least = members.groupBy("_c").agg(F.min(F.struct("_id", "_row")).alias("_least"), F.count("*").alias("_n"))
    crowds = least.where(F.col("_n") > CROWD).select("_c", "_least", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt"))
    met = members.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALT)).cast("int")).join(crowds, ["_c", "_salt"], "left").drop("_salt")
    rest = met.where("_least is null").drop("_least").join(least.where(F.col("_n") <= CROWD).select("_c", "_least"), "_c")
    return met.where("_least is not null").unionByName(rest).select(F.col("_id").alias(id_col), "_row", F.col("size").alias("n_shingles"), F.col("_least._id").alias("component_id"), (F.col("_row") == F.col("_least._row")).alias("is_first"))
