"""Rules that depend on what came before, as folds over one key's short ordered array."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

PICKS = StructType([StructField("items", ArrayType(StringType())), StructField("used", LongType()), StructField("covered", IntegerType())])


def ema(values: Column, keep: float) -> Column:
    """Exponential mean that starts at the first value."""
    first = F.get(values, F.lit(0))
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), first, lambda acc, x: F.lit(keep) * acc + F.lit(1 - keep) * x)


def suppress(items: Column, pause: int) -> Column:
    """Ids of items struct<t, id> that come `pause` or more after the last one let through."""
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        said = acc["last"].isNull() | (x["t"] - acc["last"] >= pause)
        return F.struct(F.when(said, x["t"]).otherwise(acc["last"]).alias("last"), F.when(said, F.concat(acc["out"], F.array(x["id"]))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(items, start, step, lambda acc: acc["out"])


def breaker(items: Column, limit: int, pause: int) -> Column:
    """How often a circuit breaker opens over items struct<bad, t>: after `limit` failures in a row, for `pause`."""
    start = F.struct(F.lit(0).alias("fails"), F.lit(0).alias("opened"), F.lit(0).cast("bigint").alias("until"))

    def step(acc: Column, x: Column) -> Column:
        closed = x["t"] >= acc["until"]
        fails = F.when(~closed, acc["fails"]).when(x["bad"], acc["fails"] + 1).otherwise(F.lit(0))
        trips = closed & x["bad"] & (fails >= limit)
        return F.struct(fails.alias("fails"), F.when(trips, acc["opened"] + 1).otherwise(acc["opened"]).alias("opened"), F.when(trips, x["t"] + pause).otherwise(acc["until"]).cast("bigint").alias("until"))

    return F.aggregate(items, start, step, lambda acc: acc["opened"])


def batches(sizes: Column, most: int, budget: float) -> Column:
    """Number of batches in order, each of at most `most` items and `budget` in all."""
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0.0).alias("used"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["batch"] == 0) | (acc["n"] >= most) | (acc["used"] + x > budget)
        return F.struct(F.when(new, acc["batch"] + 1).otherwise(acc["batch"]).alias("batch"), F.when(new, 1).otherwise(acc["n"] + 1).alias("n"), F.when(new, x).otherwise(acc["used"] + x).alias("used"))

    return F.aggregate(sizes, start, step, lambda acc: acc["batch"])


def fill(sizes: Column, budget: int) -> Column:
    """struct<used, taken> of a greedy fill that skips what doesn't fit."""
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("taken"))

    def step(acc: Column, n: Column) -> Column:
        fits = acc["used"] + n <= budget
        return F.struct(F.when(fits, acc["used"] + n).otherwise(acc["used"]).alias("used"), F.when(fits, acc["taken"] + 1).otherwise(acc["taken"]).alias("taken"))

    return F.aggregate(sizes, start, step)


def best_subset(units: Column, budget: int) -> Column:
    """struct<mask, size, gain> of the best subset of units struct<size, gain> of whole numbers, none below 0, within a budget.

    Gain first, then the smaller size, then the lower mask, which has room for 62 units: more are an error.
    A fold over the units holds, for each size up to the budget, the best loss and mask of exactly that size.
    """
    cell = "struct<loss:bigint,mask:bigint>"
    none = F.lit(None).cast(cell)
    empty = F.struct(F.lit(0).cast("bigint").alias("loss"), F.lit(0).cast("bigint").alias("mask"))
    start = F.concat(F.array(empty), F.array_repeat(none, budget)).cast(f"array<{cell}>")
    placed = F.transform(units, lambda u, i: F.struct(u["size"].alias("size"), u["gain"].alias("gain"), F.pow(F.lit(2), i).cast("bigint").alias("bit")))

    def step(acc: Column, u: Column) -> Column:
        def better(x: Column, at: Column) -> Column:
            before = F.get(acc, (at - u["size"]).cast("int"))
            taken = F.struct((before["loss"] - u["gain"]).alias("loss"), (before["mask"] + u["bit"]).alias("mask"))
            return F.least(x, F.when(before.isNotNull(), taken))

        return F.when(u["size"] <= budget, F.transform(acc, better)).otherwise(acc)

    def best(acc: Column) -> Column:
        return F.array_min(F.transform(acc, lambda x, at: F.when(x.isNotNull(), F.struct(x["loss"].alias("loss"), at.cast("bigint").alias("size"), x["mask"].alias("mask")))))

    few = F.when(F.size(units) <= 62, placed).otherwise(F.raise_error(F.lit("best_subset: more than 62 units")))
    found = F.aggregate(few, start, step, best)
    return F.struct(found["mask"].alias("mask"), found["size"].alias("size"), (-found["loss"]).alias("gain"))


def speed(values: Column, keep: float = 0.75) -> Column:
    """Mean speed of struct<v, skipped>: the first run is a warm-up, the next is taken as it is, then `keep` old to the rest new; a skipped run lowers it by 1 - keep."""
    start = F.struct(F.lit(None).cast("double").alias("mean"), F.lit(False).alias("warm"))

    def step(acc: Column, x: Column) -> Column:
        new = F.when(acc["mean"].isNull(), x["v"]).otherwise(acc["mean"] * keep + x["v"] * (1 - keep))
        mean = F.when(x["skipped"], acc["mean"] * keep).when(acc["warm"], new).otherwise(acc["mean"])
        return F.struct(mean.alias("mean"), (acc["warm"] | ~x["skipped"]).alias("warm"))

    return F.aggregate(values, start, step, lambda acc: acc["mean"])


# How units struct<size, gain, uses, at> of a task may be ordered before a budget is filled.
HEURISTICS = {
    "shortest": ("size", "at"),
    "longest": ("-size", "at"),
    "best": ("-gain", "size", "at"),
    "densest": ("-gain / greatest(size, 1)", "at"),
    "most_used": ("-uses", "size", "at"),
    "in_order": ("at",),
}


def heuristic_fill(units: DataFrame, group: str, budget: int, heuristic: str = "shortest", stop: bool = False) -> DataFrame:
    """(group, taken, used, gain): a budget filled with the units of a group in a heuristic's order.

    stop: the first unit that doesn't fit ends the list; else it is skipped and later ones may fit.
    """
    keys = F.struct(*(F.expr(e).alias(f"k{i}") for i, e in enumerate(HEURISTICS[heuristic])), F.col("size"), F.col("gain"))
    listed = units.groupBy(group).agg(F.array_sort(F.collect_list(keys)).alias("_u"))
    start = F.struct(F.lit(0).alias("taken"), F.lit(0).cast("bigint").alias("used"), F.lit(0).cast("bigint").alias("gain"), F.lit(False).alias("over"))

    def step(acc: Column, x: Column) -> Column:
        fits = ~acc["over"] & (acc["used"] + x["size"] <= budget)
        over = F.lit(stop) & (acc["over"] | ~fits)
        return F.struct(
            F.when(fits, acc["taken"] + 1).otherwise(acc["taken"]).alias("taken"),
            F.when(fits, acc["used"] + x["size"]).otherwise(acc["used"]).cast("bigint").alias("used"),
            F.when(fits, acc["gain"] + x["gain"]).otherwise(acc["gain"]).cast("bigint").alias("gain"),
            over.alias("over"),
        )

    return listed.select(group, F.aggregate("_u", start, step).alias("_f")).select(group, "_f.taken", "_f.used", "_f.gain")


def misses(needed: Column, offered: Column, known: Column, sizes: Column, budget: int) -> Column:
    """Why needed names were not covered: array<struct<name, why>> with why unknown, too_big, not_picked; covered names are left out."""
    why = lambda n: F.when(~F.array_contains(known, n), "unknown").when(F.coalesce(F.try_element_at(sizes, n), F.lit(0)) > budget, "too_big").otherwise("not_picked")
    return F.transform(F.filter(needed, lambda n: ~F.array_contains(offered, n)), lambda n: F.struct(n.alias("name"), why(n).alias("why")))


def breaker_calls(items: Column, limit: int, pause: int) -> Column:
    """struct<opened, refused, state> of a circuit breaker over struct<kind, t>: asks for a call, and their outcomes ok and fail.

    After `limit` failures in a row it opens for `pause`; then one ask is let through as a probe, whose success
    closes it and whose failure opens it again.  A probe without an outcome is replaced after another `pause`.
    """
    start = F.struct(
        F.lit("closed").alias("state"), F.lit(0).alias("fails"), F.lit(0).cast("bigint").alias("at"), F.lit(0).alias("opened"), F.lit(0).alias("refused")
    )

    def step(acc: Column, x: Column) -> Column:
        ask, ok, fail = x["kind"] == "ask", x["kind"] == "ok", x["kind"] == "fail"
        over = ((acc["state"] == "open") & (x["t"] >= acc["at"])) | ((acc["state"] == "half-open") & (x["t"] - acc["at"] >= pause))
        trips = fail & ~((acc["state"] == "closed") & (acc["fails"] + 1 < limit))
        refused = ask & (acc["state"] != "closed") & ~over
        state = F.when(ask & over, "half-open").when(ok, "closed").when(trips, "open").otherwise(acc["state"])
        at = F.when(ask & over, x["t"]).when(trips, x["t"] + pause).otherwise(acc["at"])
        fails = F.when(ok | trips, 0).when(fail, acc["fails"] + 1).otherwise(acc["fails"])
        return F.struct(state.alias("state"), fails.alias("fails"), at.cast("bigint").alias("at"), (acc["opened"] + trips.cast("int")).alias("opened"), (acc["refused"] + refused.cast("int")).alias("refused"))

    return F.aggregate(items, start, step, lambda acc: F.struct(acc["opened"].alias("opened"), acc["refused"].alias("refused"), acc["state"].alias("state")))


def fill_grid(units: DataFrame, group: str, sizes: str, caps: list[int], budgets: list[int]) -> DataFrame:
    """(group, cap, budget, used, taken): a greedy fill of each group's sizes, at most cap units, for every cap and budget."""
    grid = units.select(group, sizes, F.explode(F.array(*map(F.lit, caps))).alias("cap")).withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("taken"))

    def step(acc: Column, n: Column) -> Column:
        fits = (acc["used"] + n <= F.col("budget")) & (acc["taken"] < F.col("cap"))
        return F.struct((acc["used"] + F.when(fits, n).otherwise(0)).cast("bigint").alias("used"), (acc["taken"] + fits.cast("int")).alias("taken"))

    return grid.select(group, "cap", "budget", F.aggregate(sizes, start, step).alias("f")).select(group, "cap", "budget", "f.used", "f.taken")


def padded_batches(sizes: Column, most: int, budget: float) -> Column:
    """struct<batches, padded> of sizes taken from the longest on: a batch holds at most `most` items, and its items times its longest stay within the budget; padded is what shorter items are filled up with."""
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0.0).alias("longest"), F.lit(0.0).alias("padded"))
    falling = F.reverse(F.array_sort(sizes))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["batch"] == 0) | (acc["n"] >= most) | ((acc["n"] + 1) * acc["longest"] > budget)
        longest = F.when(new, x).otherwise(acc["longest"])
        return F.struct((acc["batch"] + new.cast("int")).alias("batch"), F.when(new, 1).otherwise(acc["n"] + 1).alias("n"), longest.alias("longest"), (acc["padded"] + longest - x).alias("padded"))

    return F.aggregate(falling, start, step, lambda acc: F.struct(acc["batch"].alias("batches"), acc["padded"].alias("padded")))


def greedy_picks(calls: Column, costs: Column, budget: int) -> Column:
    """struct<items, used, covered>: what a greedy picker shows of the items that calls need, within a budget of characters.

    calls: array<array<string>>, the items of each call, all of which must be shown to answer it; costs: map of items.
    Each step shows what the call lacks that is answered at the least cost for each call that this answers, which need
    not be that call alone; equal ones by cost, then by items.  Calls without items, or with an item of unknown cost,
    are never answered.  Rows are worked off in Arrow batches; each pick looks at the distinct sets of items that are still lacked.
    """

    def picks(calls: pa.Array, costs: pa.Array) -> pa.Array:
        found = [None if c is None else greedily(c, dict(k or ()), budget) for c, k in zip(calls.to_pylist(), costs.to_pylist(), strict=True)]
        return pa.array([f and dict(zip(PICKS.names, f, strict=True)) for f in found], to_arrow_type(PICKS))

    return F.arrow_udf(picks, PICKS)(calls, costs)


def greedily(calls: list[list[str]], costs: dict[str, int], budget: int) -> tuple[list[str], int, int]:
    """`greedy_picks` of one row; sets of items are the bits of a number."""
    usable = [set(c) for c in calls if c and all(i in costs for i in c)]
    names = sorted(set().union(*usable))
    bit = {name: 1 << k for k, name in enumerate(names)}
    lack = Counter(sum(bit[i] for i in c) for c in usable)  # how many calls lack the same items
    items: list[str] = []
    used = 0
    of = lambda x: [name for name in names if x & bit[name]]
    while lack:
        best = None
        for x in lack:
            each = [costs[i] for i in of(x)]
            if None not in each and used + (cost := sum(each)) <= budget:
                one = (cost / sum(n for y, n in lack.items() if not y & ~x), cost, of(x), x)
                best = one if best is None or one < best else best
        if best is None:
            break
        items, used, left = items + best[2], used + best[1], Counter()
        for x, n in lack.items():
            if x & ~best[3]:
                left[x & ~best[3]] += n
        lack = left
    shown = set(items)
    return items, used, sum(bool(c) and shown.issuperset(c) for c in calls)


def injection_price(chars: Column, later_reads: Column, write_price: float = 3.75, read_price: float = 0.3, tokens_per_char: float = 1 / 3.5) -> Column:
    """What so many characters cost: written to the cache once, then read by each later call of the turn; prices for a million tokens."""
    return chars * tokens_per_char * (write_price + read_price * F.greatest(later_reads, F.lit(0))) / 1e6


def break_even_chars(saving: Column, later_reads: Column, write_price: float = 3.75, read_price: float = 0.3, tokens_per_char: float = 1 / 3.5) -> Column:
    """How many characters may be shown for each call saved before they cost what the call did."""
    return saving / (tokens_per_char * (write_price + read_price * later_reads) / 1e6)
