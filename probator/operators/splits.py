"""Train and test partitions that are the same for the same data and seed.

Keys are put in an order by the MD5 of seed and key, so membership depends on nothing else. Every partition is (row_id, part) with part
``train``, ``test`` or ``excluded``, and has a row for each row of the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contract import CaseError, Section
from ..functions.columns import draw, missing, named
from ..functions.ordered import numbered_keys, share_of
from ..roles import entity_ids, is_unit, pair_is_unit

TEST = 0.25
FRACTIONS = (0.35, 0.65, 1.0)
#: A learning curve needs so many groups, and each of its subsets.
FEWEST_GROUPS, SUBSET_GROUPS = 4, 3


def _drawn(keys: DataFrame, seed: int) -> DataFrame:
    order = draw(seed, F.col("key"))
    return numbered_keys(keys, order, F.substring(order, 1, 3))


def _held(keys: DataFrame, seed: int, most: Column) -> DataFrame:
    return _drawn(keys, seed).where(F.col("place") <= most).select("key")


def _part(test: Column) -> Column:
    return F.when(test, "test").otherwise("train").alias("part")


def random_rows(df: DataFrame, row: str, seed: int, share: float = TEST) -> DataFrame:
    """``random`` and ``random_pair``: the share of the rows, rounded up, is for testing. Row ids are distinct."""
    keys = df.select(named(row).alias("key"))
    return _drawn(keys, seed).select(F.col("key").alias("row_id"), _part(F.col("place") <= F.ceil(F.lit(share) * F.col("n"))))


def whole_groups(df: DataFrame, row: str, group: str | Column, seed: int, share: float = TEST) -> DataFrame:
    """``group``, ``cold_left``, ``cold_right`` and ``scaffold``: the share of the groups (not of the rows), rounded up. Rows without a group are one group. ``group`` may be an expression."""
    rows = df.select(named(row).alias("row_id"), (named(group) if isinstance(group, str) else group).alias("_g"))
    places = _drawn(rows.select(F.col("_g").alias("key")).distinct(), seed)
    return rows.join(places, F.col("_g").eqNullSafe(F.col("key"))).select("row_id", _part(F.col("place") <= F.ceil(F.lit(share) * F.col("n"))))


def double_cold(df: DataFrame, row: str, left: str, right: str, seed: int, share: float = TEST) -> DataFrame:
    """Test rows have both ids held out, train rows neither, others are excluded. A missing id is never held out."""
    rows = df.select(named(row).alias("row_id"), *(F.when(~missing(df, c), named(c)).alias(a) for c, a in ((left, "_l"), (right, "_r"))))
    for c in ("_l", "_r"):
        held = _held(rows.where(F.col(c).isNotNull()).select(F.col(c).alias("key")).distinct(), seed, F.greatest(F.lit(1), share_of(F.col("n"), share)))
        rows = rows.join(held.select(F.col("key").alias(c), F.lit(True).alias("_held" + c)), c, "left").withColumn("_held" + c, F.coalesce("_held" + c, F.lit(False)))
    both, none = F.col("_held_l") & F.col("_held_r"), ~F.col("_held_l") & ~F.col("_held_r")
    return rows.select("row_id", F.when(both, "test").when(none, "train").otherwise("excluded").alias("part"))


def by_time(df: DataFrame, row: str, stamp: str, share: float = 1 - TEST) -> DataFrame:
    """``time``: the first rows by time are for training; equal times go by row id. Rows without a time come last, so they are for testing while there are few of them."""
    keys = df.select(named(row).alias("key"), named(stamp).try_cast("timestamp").alias("_t"))
    places = numbered_keys(keys, F.col("_t"), F.col("_t").cast("date"))
    return places.select(F.col("key").alias("row_id"), F.when(F.col("place") <= share_of(F.col("n"), share), "train").otherwise("test").alias("part"))


def supplied(df: DataFrame, row: str, label: str) -> DataFrame:
    """``supplied``: labels train, and test or holdout, in either case; whatever else, and none, is excluded."""
    text = F.lower(named(label).cast("string"))
    return df.select(named(row).alias("row_id"), F.when(text == "train", "train").when(text.isin("test", "holdout"), "test").otherwise("excluded").alias("part"))


def create_split(df: DataFrame, scenario: Section, seed: int, row: str, *, scaffold: Column | None = None) -> DataFrame:
    """The partition of a scenario. ``scaffold`` is the expression that groups structures, for that strategy."""
    s = scenario
    column = {"group": s.group_column, "time": s.group_column, "scaffold": s.group_column, "cold_left": s.left_column, "cold_right": s.right_column, "double_cold": s.left_column, "supplied": s.split_column}.get(s.strategy)
    if s.strategy not in ("random", "random_pair") and (column is None or column not in df.columns or s.strategy == "double_cold" and s.right_column not in df.columns):
        raise CaseError(f"scenario {s.name!r}: the column that {s.strategy} needs is missing")
    if s.strategy in ("random", "random_pair"):
        return random_rows(df, row, seed)
    if s.strategy in ("group", "cold_left", "cold_right"):
        return whole_groups(df, row, column, seed)
    if s.strategy == "scaffold":
        if scaffold is None:
            raise CaseError("scaffold groups need a function from structures to scaffolds")
        return whole_groups(df, row, scaffold, seed)
    if s.strategy == "time":
        return by_time(df, row, column)
    return double_cold(df, row, s.left_column, s.right_column, seed) if s.strategy == "double_cold" else supplied(df, row, column)


def part_sizes(split: DataFrame) -> dict[str, int]:
    found = {r.part: r["n"] for r in split.groupBy("part").agg(F.count("*").alias("n")).collect()}
    return {p: found.get(p, 0) for p in ("train", "test", "excluded")}


def require_both_sides(split: DataFrame, scenario: Section) -> dict[str, int]:
    """The sizes of the parts; an empty side is an error."""
    sizes = part_sizes(split)
    if not sizes["train"] or not sizes["test"]:
        raise CaseError(f"scenario {scenario.name!r}: {scenario.strategy} leaves {sizes['train']} train and {sizes['test']} test rows")
    return sizes


def fingerprints(split: DataFrame, scenario: str, strategy: str, seed: int) -> DataFrame:
    """One row: membership (of the rows to the parts alone, whatever their order) and manifest (with scenario, strategy and seed), as hexadecimal digests.

    Row hashes are summed up exactly, so that no list of members is ever gathered.
    """
    member = F.xxhash64(F.col("row_id").cast("string"), "part")
    total = split.agg(F.count("*").alias("n"), F.sum(member.cast("decimal(38,0)")).alias("s"), F.bit_xor(member).alias("x"))
    seen = F.concat_ws("|", F.col("n"), F.coalesce("s", F.lit(0)), F.coalesce("x", F.lit(0)))
    return total.select(F.sha2(seen, 256).alias("membership"), F.sha2(F.concat_ws("|", F.lit(scenario), F.lit(strategy), F.lit(seed), seen), 256).alias("manifest"))


# --- rows that may be looked at ----------------------------------------------------------------------------------


def development_rows(df: DataFrame, row: str, labels: list[str]) -> DataFrame:
    """(row_id, agreed): rows that any of the supplied label columns has for training, and whether all of them do. Without such columns, all rows."""
    if not labels:
        return df.select(named(row).alias("row_id"), F.lit(True).alias("agreed"))
    marks = [F.coalesce(F.lower(named(c).cast("string")) == "train", F.lit(False)) for c in labels]
    return df.where(reduce(lambda a, b: a | b, marks)).select(named(row).alias("row_id"), reduce(lambda a, b: a & b, marks).alias("agreed"))


def label_columns(case: Section) -> list[str]:
    """The supplied splits' columns, each once; none if any scenario is not supplied, since then every row is for development."""
    if any(s.strategy != "supplied" for s in case.generalization_scenarios):
        return []
    return list(dict.fromkeys(s.split_column for s in case.generalization_scenarios))


def development_scope(df: DataFrame, case: Section, *, consistent: bool = False) -> Column:
    """Which rows are for development, as a condition. With ``consistent``, or a holdout, all supplied splits must draw one boundary; no row at all is an error."""
    labels = label_columns(case)
    absent = sorted(set(labels).difference(df.columns))
    if absent:
        raise CaseError(f"missing supplied split columns: {absent}")
    if not labels:
        return F.lit(True)
    marks = [F.coalesce(F.lower(named(c).cast("string")) == "train", F.lit(False)) for c in labels]
    some, every = reduce(lambda a, b: a | b, marks), reduce(lambda a, b: a & b, marks)
    n, split = df.agg(F.count_if(some), F.count_if(some & ~every)).first()
    if (consistent or case.holdout.enabled) and split:
        raise CaseError("the supplied splits must draw one consistent training boundary")
    if not n:
        raise CaseError("no development row is left")
    return some


def modelling_rows(splits: list[DataFrame]) -> DataFrame:
    """(row_id): rows that any partition uses."""
    return reduce(DataFrame.unionByName, (s.where("part <> 'excluded'").select("row_id") for s in splits)).distinct()


# --- learning curves, isolation, permutation ---------------------------------------------------------------------


def nested_subsets(df: DataFrame, row: str, group: str, seed: int, fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """(row_id, least): the least of the fractions whose subset has the row. Subsets are whole groups, each inside the next, of three groups at least; nothing if there are fewer than four."""
    rows = df.where(~missing(df, group)).select(named(row).alias("row_id"), named(group).alias("_g"))
    places = _drawn(rows.select(F.col("_g").alias("key")).distinct(), seed).where(F.col("n") >= FEWEST_GROUPS)
    least = F.lit(None).cast("double")
    for f in sorted(fractions, reverse=True):
        least = F.when(F.col("place") <= F.greatest(F.lit(SUBSET_GROUPS), share_of(F.col("n"), f)), F.lit(f)).otherwise(least)
    return rows.join(places.select(F.col("key").alias("_g"), least.alias("least")), "_g").where("least is not null").select("row_id", "least", F.col("_g").alias("group_id"))


def subset_sizes(subsets: DataFrame, fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """(fraction, n_groups, n_rows) of nested subsets."""
    steps = F.explode(F.filter(F.array(*map(F.lit, fractions)), lambda f: f >= F.col("least"))).alias("fraction")
    cells = subsets.groupBy("group_id", "least").agg(F.count("*").alias("_n")).select(steps, "group_id", "_n")
    return cells.groupBy("fraction").agg(F.count_distinct("group_id").alias("n_groups"), F.sum("_n").alias("n_rows"))


def protected_entities(case: Section, scenario: Section) -> list[str]:
    """Entities whose ids must not be on both sides of this scenario: those it groups by, and with a locked holdout those that make up the prediction or its independent unit."""
    if scenario.strategy not in ("group", "scaffold", "supplied"):
        return []
    locked = scenario.strategy == "supplied" and case.holdout.enabled
    out = []
    for name, entity in case.entities.items():
        own = [c for c in (entity.id_column, entity.representation_column) if c]
        if scenario.group_column in own or locked and (is_unit(case, name) or case.evaluation.bootstrap_unit in own):
            out.append(name)
    return out


def require_isolation(case: Section, scenario: Section, entity_overlap: dict[str, int], pair_overlap: int | None) -> None:
    """An error if ids, or pairs of a locked pair task, that the scenario protects cross train and test."""
    for name in protected_entities(case, scenario):
        if entity_overlap.get(name):
            raise CaseError(f"scenario {scenario.name!r}: {entity_overlap[name]} {name} identifiers cross train and test")
    if scenario.strategy == "supplied" and case.holdout.enabled and pair_is_unit(case) and pair_overlap:
        raise CaseError(f"scenario {scenario.name!r}: {pair_overlap} pairs cross train and test")


def pair_columns(case: Section, columns: list[str]) -> list[str]:
    found = entity_ids(case, columns)[:2]
    return found if len(found) == 2 else []


def permute_within(df: DataFrame, row: str, group: str | None, value: str, seed: int) -> DataFrame:
    """(row_id, permuted): groups of one size hand their blocks of values on to the next in a drawn order, and every block is shuffled; a lone size shuffles inside.

    Rows without a group are one group; without ``group`` all rows are shuffled. Every value is given out once. Positions within a group come from a
    window, so a group must fit one task's sort (it spills); groups are numbered in their size's order without a window over all of them.
    """
    if group is None:
        rows = df.select(named(row).alias("key"), named(value).alias("_v"))
        to = _drawn(rows.select("key"), seed).select(F.col("key").alias("row_id"), "place")
        source = numbered_keys(rows.select("key"), draw(seed + 1, F.col("key")), F.substring(draw(seed + 1, F.col("key")), 1, 3)).select("key", "place")
        return to.join(source, "place").join(rows, "key").select("row_id", F.col("_v").alias("permuted"))
    rows = df.select(named(row).alias("row_id"), named(group).alias("_g"), named(value).alias("_v"))
    sizes = rows.groupBy("_g").agg(F.count("*").alias("_n")).withColumn("_h", draw(seed, F.col("_g")))
    # Groups of one size in the order of their draw: numbered within (size, first digits), from the counts of the digits before.
    digits = F.substring("_h", 1, 3)
    inside = Window.partitionBy("_n", "_d").orderBy("_h", F.col("_g").asc_nulls_first())
    cells = sizes.groupBy("_n", digits.alias("_d")).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy("_n").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("_start", F.coalesce(F.sum("_c").over(upto), F.lit(0))).withColumn("_peers", F.sum("_c").over(Window.partitionBy("_n"))).drop("_c")
    order = sizes.withColumn("_d", digits).withColumn("_i", F.row_number().over(inside)).join(starts, ["_n", "_d"]).select("_n", "_g", (F.col("_start") + F.col("_i")).alias("_place"), "_peers")
    giver = order.select("_n", F.col("_g").alias("_from"), F.col("_place").alias("_next"))
    pairs = order.withColumn("_next", F.col("_place") % F.col("_peers") + 1).join(giver, ["_n", "_next"]).select(F.col("_g").alias("_to"), "_from")
    source = rows.select(F.col("_g").alias("_sg"), "_v", F.row_number().over(Window.partitionBy("_g").orderBy(draw(seed + 1, F.col("row_id")), "row_id")).alias("_k"))
    target = rows.select("row_id", "_g", F.row_number().over(Window.partitionBy("_g").orderBy("row_id")).alias("_k"))
    given = target.join(pairs, F.col("_g").eqNullSafe(F.col("_to"))).select("row_id", "_from", F.col("_k").alias("_tk"))
    return given.join(source, F.col("_from").eqNullSafe(F.col("_sg")) & (F.col("_tk") == F.col("_k"))).select("row_id", F.col("_v").alias("permuted"))
