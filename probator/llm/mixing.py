"""Mixing sources to target weights by entropy balancing.

Each source gets a target of words.  A document's rate r (expected copies) keeps as close as it can, in relative
entropy with the box 0 <= r <= 3, to one copy per document, while the source's rates times sizes add up to
the target.  The convex dual has one multiplier a source: r = 3 / (1 + 2 exp(-t x)), x = size / mean size:
odds of r against its cap, tilted exponentially by size.  Newton iterations on the dual run over the counts
of each (source, size), which Spark aggregates once; sources, their targets and multipliers are tables like any other, so
there may be as many sources as documents.  Rates become whole copies by systematic rounding: documents in order of
size, each takes the whole numbers that the running sum of rates passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common as C

WEIGHTS = (5, 2, 1)
CAP = 3
#: Rates are whole multiples of 1 / SCALE, so that sums do not depend on the order of rows.
SCALE = 1 << 20
#: Newton steps at most, the relative gap that ends them, and the largest multiplier.
ROUNDS, NEAR, LARGEST = 60, 1e-9, 600.0
#: A third of all rows may have one source and one size: rows of a size class are numbered in so many parts.
PARTS = 64


def targets(sources: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """sources (source, source_size) with target: shares of the total by weight, none above cap times the size, the excess reshared by weight.

    Sources sort by code point with null last and take the weights in turn. Their places come from numbering within the first character, so no task sorts all
    of them. What is above its cap at one level of the share stays so when the excess raises the level, so each round fixes more sources until none is above.
    """
    letter = F.coalesce(F.concat(F.lit("a"), F.substring("source", 1, 1)), F.lit("b"))
    rows = sources.withColumn("_l", letter)
    starts = rows.groupBy("_l").agg(F.count("*").alias("_c")).select("_l", F.coalesce(F.sum("_c").over(W.orderBy("_l").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_s"))  # one row a character
    place = F.row_number().over(W.partitionBy("_l").orderBy(F.col("source").asc_nulls_last())) - 1
    rows = rows.withColumn("_i", place).join(starts, "_l").withColumn("_w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("_s") + F.col("_i"), F.lit(len(weights))) + 1).cast("int"))).select("source", "source_size", "_w")
    rows = C.written(rows, "mix-sources")
    # A source is at its cap if weight * level exceeds cap * size: level starts at total / weights and only rises.
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, fixed = 0.0, -1
    while True:
        above = F.col("_w") * F.lit(level) > cap * F.col("source_size")
        n, held, free = rows.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, cap * F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("_w"))), F.lit(0.0))).first()
        new = (total - held) / free if free else level
        if n == fixed and new <= level:
            break
        level, fixed = max(level, new), n
    return rows.select("source", "source_size", F.least(F.col("_w") * F.lit(level), (cap * F.col("source_size")).cast("double")).alias("target"))


def _tilted(t: Column, x: Column) -> Column:
    """3 / (1 + 2 exp(-t x)), safe for large arguments."""
    return CAP / (1 + (CAP - 1) * F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -t * x))))


def _multipliers(histogram: DataFrame, goals: DataFrame) -> DataFrame:
    """goals (source, source_size, target, mean) with t, the dual's solution for each source, or +-infinity where the target lies on the box. histogram: source, size, n.

    Newton steps that leave the bracket are replaced by its middle, or by a doubled step while a side is open. Every round writes the state, a row a source.
    """
    inside = (F.col("target") > 0) & (F.col("target") < CAP * F.col("source_size"))
    start = F.when(inside, 0.0).when(F.col("target") <= 0, float("-inf")).otherwise(float("inf"))
    state = C.written(goals.withColumns({"t": start, "low": F.lit(float("-inf")), "high": F.lit(float("inf")), "done": ~inside}), "mix-dual")
    for _ in range(ROUNDS):
        open_ = state.where("not done").select(F.col("source").alias("_s"), "t", "mean")
        x = F.col("size") / F.col("mean")
        r = _tilted(F.col("t"), x)
        sums = histogram.join(open_, F.col("source").eqNullSafe(F.col("_s"))).groupBy("_s").agg(F.sum(F.col("n") * F.col("size") * r).alias("value"), F.sum(F.col("n") * F.col("size") * x * r * (1 - r / CAP)).alias("slope"))
        met = state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left")
        gap = F.col("value") - F.col("target")
        there = F.col("done") | F.coalesce(F.abs(gap) <= NEAR * F.col("target"), F.lit(True))
        low, high = F.when(gap < 0, F.col("t")).otherwise(F.col("low")), F.when(gap > 0, F.col("t")).otherwise(F.col("high"))
        newton = F.col("t") - F.try_divide(gap, F.col("slope"))
        closed = (F.abs(low) != float("inf")) & (F.abs(high) != float("inf"))
        step = F.when((newton > low) & (newton < high), newton).when(closed, (low + high) / 2).otherwise(2 * F.col("t") + F.when(gap < 0, 1.0).otherwise(-1.0))
        step = F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), step))
        state = C.written(met.select("source", "source_size", "target", "mean", F.when(there, F.col("t")).otherwise(step).alias("t"), F.when(there, F.col("low")).otherwise(low).alias("low"), F.when(there, F.col("high")).otherwise(high).alias("high"), there.alias("done")), "mix-dual")
        if state.where("not done").isEmpty():
            break
    return state.select("source", "source_size", "target", "mean", F.round("t", 7).alias("t"))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS) -> DataFrame:
    """A row for each document: id, _row, source, size (words), source_size, target (its source's words), rate, copies.

    Null or empty texts have size 0 and no effect; they get one copy unless their source gets none. A null source is a source.
    Repeated ids are separate documents; which of several equal rows gets more copies is open, since it makes no difference. An empty table gives an empty result.
    The same documents give the same copies, however they are dealt over files.
    """
    text = F.col(text_col)
    own = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), C.n_words(text).alias("size"), F.xxhash64(text).alias("_mark"))
    rows = C.written(C.numbered(own, "_id", "source", "size", "_mark"), "mix-sizes")
    histogram = C.written(rows.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "mix-histogram")
    sizes = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), (F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    every = rows.groupBy("source").agg(F.count("*").alias("_rows")).withColumnRenamed("source", "_s")
    per = C.written(every.join(sizes, F.col("source").eqNullSafe(F.col("_s")), "left").select(F.col("_s").alias("source"), F.coalesce("source_size", F.lit(0).cast("long")).alias("source_size"), F.coalesce("mean", F.lit(1.0)).alias("mean"), "_rows"), "mix-per")
    goals = targets(per.select("source", "source_size"), weights)
    goals = goals.join(per.select(F.col("source").alias("_s"), "mean"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    known = C.written(_multipliers(histogram, goals), "mix-known")
    # A source with a third of the rows is one key: rows meet their source's numbers in parts.
    facts = known.join(per.select(F.col("source").alias("_s"), "_rows"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    key = F.coalesce(F.concat(F.lit("a"), F.col("source")), F.lit("b"))
    rows = C.met_in_parts(rows.withColumn("_key", key), facts.withColumn("_key", key).drop("source"), ["_key"], "_rows", "_row")
    tilt = F.when(F.col("t") == float("inf"), F.lit(float(CAP))).when(F.col("t") == float("-inf"), F.when(F.col("size") == 0, 1.0).otherwise(0.0)).otherwise(_tilted(F.col("t"), F.col("size") / F.col("mean")))
    rows = rows.withColumn("_units", F.round(tilt * SCALE).cast("long"))
    # Classes of size, each in PARTS by a hash of the document; the running sum starts from the sums of the classes before.
    rows = rows.withColumns({"_class": F.floor(F.log2(F.col("size") + 1.0) * 32).cast("int"), "_part": F.pmod(F.xxhash64("_id", "_mark"), F.lit(PARTS)).cast("int")})
    key_columns = ["_key", "_class", "_part"]
    before = W.partitionBy("_key").orderBy("_class", "_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy(*key_columns).agg(F.sum("_units").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = W.partitionBy(*key_columns).orderBy("size", "_id", "_mark", "_row").rowsBetween(W.unboundedPreceding, 0)
    joined = rows.withColumn("_upto", F.sum("_units").over(inside)).join(offsets, key_columns)
    half = SCALE // 2
    passed = lambda c: F.floor((F.col("_before") + c + half) / F.lit(SCALE))
    copies = passed(F.col("_upto")) - passed(F.col("_upto") - F.col("_units"))
    return joined.select(F.col("_id").alias(id_col), "_row", "source", "size", "source_size", "target", (F.col("_units") / SCALE).alias("rate"), copies.cast("long").alias("copies"))
