"""Incidence-density matching: up to k random controls per case.

The candidate pairs are never formed. Within a matching cell the controls are
numbered by falling follow-up, so those eligible for a case are the first E of
them. E is a running count, the sample is k distinct numbers in 1..E drawn from
a hash of seed and case, and an equi-join on (cell, number) fetches the people.
Work is linear in people plus cases times k, for any distribution of cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.values import typed_null
from matchloom.operators.ranking import dense_index, running_total
from matchloom.session import broadcast_if_small, cut_lineage, discard

HASH_DIGITS = 15
HASH_RANGE = 16**HASH_DIGITS


@dataclass(frozen=True)
class MatchRules:
    """Which people may be controls of a case.

    ``exact``: columns that must be equal. ``near``: integer column that may
    differ by ``tolerance``. ``at_least``: column in which the control must
    reach the case's value (follow-up days).
    """

    exact: tuple[str, ...]
    near: str | None = None
    tolerance: int = 1
    at_least: str = "follow_up_days"
    person: str = "person_id"
    case: str = "case"
    cases_as_controls: bool = True

    @property
    def cell(self) -> list[str]:
        return [*self.exact, "_near"] if self.near else list(self.exact)


def hash_number(*parts) -> Column:
    """Number in ``[0, 16^15)`` from the MD5 of the parts joined by ``|``."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("long")


def _kept(people: DataFrame, rules: MatchRules, *extra: str) -> DataFrame:
    """The columns that matching reads, written out once.

    The table of people is usually the end of a long pipeline, and the steps
    below read it several times.
    """
    near = [rules.near] if rules.near else []
    wanted = dict.fromkeys([rules.person, rules.case, *rules.exact, *near, rules.at_least, *extra])
    return cut_lineage(people.select(*wanted))


def _numbered(people: DataFrame, rules: MatchRules) -> DataFrame:
    """Controls with their number in the cell, and cases with their eligible count.

    Both are one running count over (follow-up descending, controls first): a
    control adds 1, the probe of a case adds 0 and reads the count so far. The
    result is narrow, and written out because it is read as three tables.
    """
    needed = [rules.person, *rules.exact, rules.at_least, *([rules.near] if rules.near else [])]
    usable = people.na.drop(subset=needed)
    is_case = F.coalesce(F.col(rules.case) == 1, F.lit(False))
    level = (-F.col(rules.at_least)).alias("_level")
    near = [F.col(rules.near).alias("_near")] if rules.near else []
    probes = usable.where(is_case).select(
        *rules.exact, *near, level, F.lit(1).alias("_probe"), F.col(rules.person).alias("_id"), F.lit(False).alias("_own")
    )
    pool = usable if rules.cases_as_controls else usable.where(~is_case)
    if rules.near:
        reach = F.sequence(F.col(rules.near) - rules.tolerance, F.col(rules.near) + rules.tolerance)
        pool = pool.withColumn("_near", F.explode(reach))
        own = is_case & (F.col("_near") == F.col(rules.near))
    else:
        own = is_case
    controls = pool.select(*rules.cell, level, F.lit(0).alias("_probe"), F.col(rules.person).alias("_id"), own.alias("_own"))
    occupied = broadcast_if_small(probes.select(*rules.cell).distinct())
    merged = controls.join(occupied, rules.cell, "left_semi").unionByName(probes)
    return cut_lineage(
        running_total(merged, ["_level", "_probe", "_id"], rules.cell, weight=1 - F.col("_probe"), out="_number")
    )


def _case_ranges(numbered: DataFrame, rules: MatchRules) -> DataFrame:
    """Per case: how many controls are eligible, and its own number among them."""
    own = numbered.where(F.col("_own")).select("_id", F.col("_number").alias("_self"))
    return (
        numbered.where(F.col("_probe") == 1)
        .select(*rules.cell, "_id", "_number")
        .join(own, "_id", "left")
        .withColumn("n_eligible", F.col("_number") - F.when(F.col("_self").isNotNull(), 1).otherwise(0))
        .drop("_number")
    )


def eligible_counts(people: DataFrame, rules: MatchRules) -> DataFrame:
    """Number of eligible controls of every case, 0 for cases without any."""
    people = _kept(people, rules)
    counted = _case_ranges(_numbered(people, rules), rules).select(F.col("_id").alias(rules.person), "n_eligible")
    cases = people.where(F.col(rules.case) == 1).select(rules.person)
    return cases.join(counted, rules.person, "left").na.fill(0, ["n_eligible"])


def unmatched_cases(people: DataFrame, rules: MatchRules) -> DataFrame:
    return eligible_counts(people, rules).where(F.col("n_eligible") == 0).select(rules.person)


def _distinct_draws(seed: int, case_id: Column, n: Column, k: int) -> Column:
    """``min(k, n)`` distinct numbers of 1..n, every subset equally likely.

    Floyd's method (Bentley and Floyd, 1987): for j in n-k+1..n take a random
    number up to j, or j itself when that number is already taken.
    """
    steps = F.sequence(F.greatest(n - k, F.lit(0)) + 1, n)

    def step(taken: Column, j: Column) -> Column:
        t = F.lit(1) + F.pmod(hash_number(F.lit(seed), case_id, j), j)
        return F.array_append(taken, F.when(F.array_contains(taken, t), j).otherwise(t))

    return F.when(n > 0, F.aggregate(steps, F.array().cast("array<bigint>"), step))


def sample_controls(people: DataFrame, rules: MatchRules, k: int = 10, seed: int = 42) -> DataFrame:
    """Up to ``k`` controls per case: ``case_id, control_id, random_num, control_rank``.

    A control is used once per case and may serve several cases. The sample
    depends on seed and data only, not on the partitioning.
    """
    return _draw_controls(_numbered(_kept(people, rules), rules), rules, k, seed)


def _draw_controls(numbered: DataFrame, rules: MatchRules, k: int, seed: int) -> DataFrame:
    draws = _distinct_draws(seed, F.col("_id"), F.col("n_eligible"), k)
    ranked = F.array_sort(
        F.transform(draws, lambda d: F.struct(hash_number(F.lit(seed), F.col("_id"), F.lit("rank"), d).alias("h"), d.alias("d")))
    )
    wanted = (
        _case_ranges(numbered, rules)
        .where(F.col("n_eligible") > 0)
        .select(*rules.cell, "_id", "_self", F.posexplode(ranked).alias("_place", "_draw"))
        .select(
            *rules.cell,
            F.col("_id").alias("case_id"),
            (F.col("_draw.d") + F.when(F.col("_draw.d") >= F.col("_self"), 1).otherwise(0)).alias("_number"),
            (F.col("_draw.h").cast("double") / F.lit(float(HASH_RANGE))).alias("random_num"),
            (F.col("_place") + 1).alias("control_rank"),
        )
    )
    controls = numbered.where(F.col("_probe") == 0).select(*rules.cell, "_number", F.col("_id").alias("control_id"))
    return wanted.join(controls, [*rules.cell, "_number"]).select("case_id", "control_id", "random_num", "control_rank")


def matched_sets(
    people: DataFrame,
    rules: MatchRules,
    index_date: str,
    k: int = 10,
    seed: int = 42,
    source: str | None = "source",
    code: str | None = "code",
) -> DataFrame:
    """Cases with their sampled controls, one row per member.

    Controls get ``case = 0`` and the index date of their case, whatever they
    are elsewhere. ``set`` numbers the matched cases in order of their id.
    """
    people = _kept(people, rules, index_date, *[c for c in (source, code) if c])
    numbered = _numbered(people, rules)
    pairs = _draw_controls(numbered, rules, k, seed)
    matched = _case_ranges(numbered, rules).where(F.col("n_eligible") > 0).select(F.col("_id").alias(rules.person))
    sets = dense_index(matched, rules.person, "set")
    text = lambda name: (F.col(name) if name else F.lit(None)).cast("string")
    cases = people.where(F.col(rules.case) == 1).select(
        rules.person, F.col(index_date).alias("index_date"), text(source).alias("source"), text(code).alias("code")
    )
    heads = sets.join(cases, rules.person)
    case_rows = heads.select(
        "set", rules.person, F.lit(1).alias("case"), "index_date", "source", "code",
        typed_null("double").alias("random_num"), typed_null("int").alias("control_rank"),
    )
    control_rows = pairs.join(
        heads.select("set", F.col(rules.person).alias("case_id"), "index_date"), "case_id"
    ).select(
        "set", F.col("control_id").alias(rules.person), F.lit(0).alias("case"), "index_date",
        typed_null("string").alias("source"), typed_null("string").alias("code"),
        "random_num", "control_rank",
    )
    return case_rows.unionByName(control_rows)


def set_size_distribution(sets: DataFrame) -> DataFrame:
    """Cases by number of controls in their set, with the percentage of all cases."""
    per_set = sets.groupBy("set").agg(
        F.sum(F.when(F.col("case") == 0, 1).otherwise(0)).alias("num_controls"),
        F.sum(F.when(F.col("case") == 1, 1).otherwise(0)).alias("_cases"),
    )
    counts = per_set.groupBy("num_controls").agg(F.sum("_cases").alias("num_cases")).where(F.col("num_cases") > 0)
    total = per_set.agg(F.sum("_cases"))
    return counts.withColumn("percentage", F.col("num_cases") / total.scalar() * 100)


def stratum_sizes(people: DataFrame, keys: list[str], case: str = "case") -> DataFrame:
    """Cases, non-cases and a has-a-case flag per matching stratum."""
    return people.groupBy(*keys).agg(
        F.sum(F.when(F.col(case) == 1, 1).otherwise(0)).alias("num_cases"),
        F.sum(F.when(F.col(case) == 1, 0).otherwise(1)).alias("num_others"),
    ).withColumn("has_case", (F.col("num_cases") > 0).cast("int"))


# Children of a block of consecutive numbers, as a power of two.
FAN_BITS = 3
# Level of the leaves: blocks of so few numbers that their controls are looked at one by one.
LEAF = 2


def overlap_counts(
    controls: DataFrame, asked: DataFrame, cell: list[str], levels: Sequence[int]
) -> DataFrame:
    """How many controls of a block of numbers overlap a window: ``_id, _level, _block, _n``.

    ``controls`` has the cell, ``_number`` and the window ``_from``, ``_to``;
    ``asked`` the cell, ``_id``, ``_level``, ``_block``, ``_from`` and ``_to``. Block b of
    level l holds the numbers above b * 8^l, 8^l of them. Those that overlap are
    those that start by the end of the window less those that end before its
    start: two counts below a bound, read off one running count per block in order
    of the date, for all blocks in one pass.
    """
    above = F.explode(F.array(*[F.lit(level).cast("int") for level in levels]))
    block = F.call_function("shiftright", F.col("_number") - 1, F.col("_level") * FAN_BITS)
    posted = controls.select(*cell, above.alias("_level"), "_number", "_from", "_to").withColumn("_block", block)
    no_id = F.lit(None).cast(asked.schema["_id"].dataType)
    turn = lambda side, day, order, points: points.select(
        *cell, "_level", "_block", F.lit(side).alias("_side"), F.col(day).alias("_day"), F.lit(order).alias("_turn"),
        "_id" if "_id" in points.columns else no_id.alias("_id"),
    )
    # a start on the last day counts, an end on the first day does not
    merged = reduce(DataFrame.unionByName, [
        turn(0, "_from", 0, posted), turn(0, "_to", 1, asked), turn(1, "_to", 1, posted), turn(1, "_from", 0, asked),
    ])
    point = F.col("_id").isNull()
    counted = running_total(
        merged, ["_day", "_turn", "_id"], [*cell, "_level", "_block", "_side"], weight=F.when(point, 1).otherwise(0), out="_count"
    )
    return counted.where(~point).groupBy("_id", "_level", "_block").agg(
        F.sum(F.when(F.col("_side") == 0, F.col("_count")).otherwise(-F.col("_count"))).alias("_n")
    )


def _prefix_blocks(upto: Column, levels: Sequence[int]) -> Column:
    """The blocks of ``levels`` among those that make up the numbers 1..upto, as structs ``_level``, ``_block``."""
    at = lambda level: lambda b: F.struct(F.lit(level).cast("int").alias("_level"), b.alias("_block"))
    parts = []
    for level in levels:
        digit = F.shiftright(upto, level * FAN_BITS).bitwiseAND(F.lit((1 << FAN_BITS) - 1).cast("long"))
        first = F.shiftleft(F.shiftright(upto, (level + 1) * FAN_BITS), FAN_BITS)
        blocks = F.when(digit > 0, F.sequence(first, first + digit - 1)).otherwise(F.array().cast("array<bigint>"))
        parts.append(F.transform(blocks, at(level)))
    return F.concat(*parts)


def _leaves(controls: DataFrame, cell: list[str]) -> DataFrame:
    """The controls of every leaf, in order of their number: at most 8^``LEAF`` numbers in a row."""
    members = F.array_sort(F.collect_list(F.struct("_number", "_from", "_to")))
    leaf = F.shiftright(F.col("_number") - 1, LEAF * FAN_BITS).alias("_leaf")
    return cut_lineage(controls.groupBy(*cell, leaf).agg(members.alias("_members")))


def _bounds() -> list[Column]:
    """The numbers of the row's block are those above ``_low``, up to ``_high``."""
    at = lambda block: F.call_function("shiftleft", block, F.col("_level") * FAN_BITS)
    return [at(F.col("_block")).alias("_low"), at(F.col("_block") + 1).alias("_high")]


def sample_overlapping(
    people: DataFrame, rules: MatchRules, start: str, end: str, k: int = 10, seed: int = 42
) -> DataFrame:
    """As ``sample_controls``, and the windows of case and control must overlap.

    The follow-up test bounds a prefix of the numbered cell as before. The prefix is
    a few blocks of numbers, and how many controls overlap in each is counted, in
    blocks from a leaf on by ``overlap_counts``, in smaller ones by looking at the
    leaf. So a case's number of candidates is known exactly and a case without any is
    settled there. ``k`` different ranks below it are drawn, and each is followed
    down its block, into the child that holds it by the counts of the children, to a
    leaf and there to one control. Work is ``k`` times the depth and a leaf per case,
    whatever share of the cell overlaps. A window that is null or ends before it
    starts overlaps nothing. Gives ``case_id, control_id, control_rank``.
    """
    people = _kept(people, rules, start, end)
    numbered = _numbered(people, rules)
    windows = people.where(F.col(start) <= F.col(end)).select(
        F.col(rules.person).alias("_id"), F.col(start).alias("_from"), F.col(end).alias("_to")
    )
    cell = rules.cell
    controls = cut_lineage(
        numbered.where(F.col("_probe") == 0).join(windows, "_id").select(*cell, "_number", F.col("_id").alias("control_id"), "_from", "_to")
    )
    cases = cut_lineage(_case_ranges(numbered, rules).join(windows, "_id"))
    longest = numbered.agg(F.max("_number")).first()[0] or 0
    levels = max(1, math.ceil(longest.bit_length() / FAN_BITS))
    # numbers up to the last eligible one, the case's own included, and those before its own
    prefixes = F.array(
        F.struct(F.lit(False).alias("_own"), (F.col("n_eligible") + F.when(F.col("_self").isNotNull(), 1).otherwise(0)).alias("_upto")),
        F.struct(F.lit(True).alias("_own"), F.coalesce(F.col("_self") - 1, F.lit(0)).alias("_upto")),
    )
    starts = cases.select(*cell, "_id", "_from", "_to", F.inline(prefixes))
    leaves = _leaves(controls, cell)
    meets = lambda m: (m["_from"] <= F.col("_to")) & (m["_to"] >= F.col("_from"))
    inside = lambda n: (n > F.col("_low")) & (n <= F.col("_high"))
    met = starts.withColumn("_leaf", F.shiftright("_upto", LEAF * FAN_BITS)).join(leaves, [*cell, "_leaf"]).select(
        *starts.columns, F.transform(F.filter("_members", meets), lambda m: m["_number"]).alias("_met")
    )
    # bounds come out of a generator, so that they are not worked out for every member
    sized = (
        met.select("*", F.inline(_prefix_blocks(F.col("_upto"), range(LEAF))))
        .select("*", F.inline(F.array(F.struct(*_bounds()))))
        .withColumn("_n", F.size(F.filter("_met", inside)).cast("long"))
        .drop("_met", "_low", "_high")
    )
    if levels > LEAF:
        parts = cut_lineage(starts.select("*", F.inline(_prefix_blocks(F.col("_upto"), range(LEAF, levels)))))
        asked = parts.select(*cell, "_id", "_from", "_to", "_level", "_block").distinct()
        counts = cut_lineage(overlap_counts(controls, asked, cell, range(LEAF, levels)))
        sized = sized.unionByName(parts.join(counts, ["_id", "_level", "_block"]))
    sized = cut_lineage(sized.where(F.col("_n") > 0))
    totals = sized.groupBy("_id").agg(
        F.sum(F.when(F.col("_own"), F.lit(0)).otherwise(F.col("_n"))).alias("_all"), F.sum(F.when(F.col("_own"), F.col("_n")).otherwise(0)).alias("_before")
    )
    self_in = F.col("_self").isNotNull()
    n = F.col("_all") - F.when(self_in, 1).otherwise(0)
    drawn = (
        cases.join(totals, "_id")
        .select("_id", self_in.alias("_in"), "_before", F.explode(_distinct_draws(seed, F.col("_id"), n, k)).alias("_draw"))
        .select("_id", "_draw", (F.col("_draw") + F.when(F.col("_in") & (F.col("_draw") > F.col("_before")), 1).otherwise(0)).alias("_rank"))
    )
    along = Window.partitionBy("_id").orderBy(F.call_function("shiftleft", F.col("_block"), F.col("_level") * FAN_BITS))
    placed = sized.where(~F.col("_own")).withColumn("_upto", F.sum("_n").over(along))
    # a case has at most seven blocks per level, and k draws; items end in leaves or below
    items = cut_lineage(
        drawn.join(placed, "_id")
        .where((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n")))
        .select(*cell, "_id", "_from", "_to", "_draw", "_level", "_block", (F.col("_rank") - (F.col("_upto") - F.col("_n"))).alias("_rank"))
    )
    for level in range(levels - 1, LEAF, -1):
        before, items = items, cut_lineage(_one_level_down(controls, items, cell, level))
        discard(before)
    order = hash_number(F.lit(seed), F.col("_id"), F.lit("rank"), F.col("_draw"))
    leaf = F.call_function("shiftright", F.col("_block"), (LEAF - F.col("_level")) * FAN_BITS).alias("_leaf")
    reached = items.select("*", leaf, *_bounds()).join(leaves, [*cell, "_leaf"])
    fitting = F.filter("_members", lambda m: meets(m) & inside(m["_number"]))
    chosen = F.get(fitting, (F.col("_rank") - 1).cast("int"))["_number"]
    found = reached.select(*cell, "_id", "_draw", chosen.alias("_number")).join(
        controls.select(*cell, "_number", "control_id"), [*cell, "_number"]
    )
    ranked = F.row_number().over(Window.partitionBy("_id").orderBy(order, "_draw"))
    return found.select(F.col("_id").alias("case_id"), "control_id", ranked.alias("control_rank"))


def _one_level_down(controls: DataFrame, items: DataFrame, cell: list[str], level: int) -> DataFrame:
    """Draws of blocks of ``level`` moved into the child that holds their rank."""
    here = items.where(F.col("_level") == level)
    last = (1 << FAN_BITS) - 1
    child = F.explode(F.transform(F.sequence(F.lit(0), F.lit(last - 1)), lambda j: F.shiftleft(F.col("_block"), FAN_BITS) + j))
    asked = here.select(*cell, "_id", "_from", "_to", "_block").distinct().select(
        *cell, "_id", "_from", "_to", F.lit(level - 1).cast("int").alias("_level"), child.alias("_block")
    )
    counts = overlap_counts(controls, asked, cell, [level - 1])
    # at most seven children of a block
    children = counts.groupBy("_id", F.shiftright("_block", FAN_BITS).alias("_block")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_block").alias("child"), F.col("_n").alias("n")))).alias("_children")
    )
    start = F.struct(F.lit(None).cast("long").alias("child"), F.col("_rank").alias("rank"))
    step = lambda at, x: F.when(at["child"].isNull() & (at["rank"] <= x["n"]), F.struct(x["child"].alias("child"), at["rank"].alias("rank"))).otherwise(
        F.struct(at["child"].alias("child"), F.when(at["child"].isNull(), at["rank"] - x["n"]).otherwise(at["rank"]).alias("rank"))
    )
    moved = here.join(children, ["_id", "_block"]).withColumn("_at", F.aggregate("_children", start, step))
    down = moved.select(
        *cell, "_id", "_from", "_to", "_draw", F.lit(level - 1).cast("int").alias("_level"),
        F.coalesce(F.col("_at.child"), F.shiftleft(F.col("_block"), FAN_BITS) + last).alias("_block"), F.col("_at.rank").alias("_rank"),
    )
    return items.where(F.col("_level") < level).unionByName(down)
