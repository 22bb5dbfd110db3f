"""Paired statistics of runs: changes between two arms, bootstrap intervals, ranks and exact percentiles.

A run is a row with a task, an arm and numbers; a pair is one task with its numbers under two arms.
Sums are taken before anything is shuffled; windows hold one group's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DRAWS, LOW, HIGH = 10_000, 0.025, 0.975
BROADCAST_PAIRS = 200_000
BLOCK = 2_000_000  # numbers that a task draws at a time
PIECE, MAX_PARTS = 500_000, 32  # pairs of a stratum that a task holds, tasks that share the draws of a piece
_MODULUS = 2_147_483_647


def pair(runs: DataFrame, a: str, b: str, metrics: list[str], task: str = "task", arm: str = "arm") -> DataFrame:
    """(task, x_<metric>, y_<metric>) of tasks that have a run in both arms; the others drop out."""
    x = runs.filter(F.col(arm) == a).select(task, *(F.col(m).alias(f"x_{m}") for m in metrics))
    y = runs.filter(F.col(arm) == b).select(task, *(F.col(m).alias(f"y_{m}") for m in metrics))
    return x.join(y, task)


def change(x: str, y: str) -> Column:
    """Sum over sum, less one; null where there is nothing to compare with."""
    return F.sum(x) / F.nullif(F.sum(y), F.lit(0)) - 1


def wins(x: str, y: str) -> Column:
    return F.count_if(F.col(x) < F.col(y))


def changes_by(pairs: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """The change of each group and, under a null group, of all pairs together."""
    return pairs.groupingSets([[group], []], group).agg(change(x, y).alias("change"), F.count("*").alias("n"))


def balanced_change(pairs: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """One row: the mean of the groups' changes, each group counting once."""
    return pairs.groupBy(group).agg(change(x, y).alias("change")).agg(F.count("*").alias("groups"), F.avg("change").alias("change"))


def complete_tasks(runs: DataFrame, arms: int, task: str = "task", arm: str = "arm") -> DataFrame:
    """Tasks that ran in all arms."""
    return runs.groupBy(task).agg(F.countDistinct(arm).alias("_arms")).filter(F.col("_arms") == arms).select(task)


def drawn(draw, place, n):
    """A whole number below n for each draw and place: two squarings modulo a prime, the same in every engine."""
    u = (draw * 1_000_003 + place * 7_919 + 17) % _MODULUS
    u = (u * u) % _MODULUS
    u = (u * 48_271 + 11) % _MODULUS
    return ((u * u) % _MODULUS) % n


def _drawn_sums(placed: DataFrame, columns: list[str], draws: int) -> DataFrame | None:
    """(_b, columns): sums of each draw and stratum, drawn in arrays by tasks that hold all (few) pairs; None if a number is missing."""
    spark = placed.sparkSession
    found = placed.toPandas()
    if found[columns].isna().any(axis=None):
        return None
    strata = [part.sort_values("_i")[columns].to_numpy(float) for _, part in found.groupby("_s", dropna=False)]
    shared = spark.sparkContext.broadcast(strata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for numbers in shared.value:
                n, block = len(numbers), max(1, BLOCK // len(numbers))
                for at in range(0, batch.num_rows, block):
                    draw = batch.column(0).slice(at, block).to_numpy()
                    picks = drawn(draw[:, None], np.arange(n)[None, :], n)
                    sums = [pa.array(numbers[:, j][picks].sum(axis=1)) for j in range(numbers.shape[1])]
                    yield pa.RecordBatch.from_arrays([pa.array(draw), *sums], names=["_b", *columns])

    every = spark.range(draws).repartition(spark.sparkContext.defaultParallelism, "id")
    return every.mapInArrow(run, ", ".join(["_b long", *(f"{c} double" for c in columns)]))


def _drawn_by_piece(placed: DataFrame, columns: list[str], draws: int) -> DataFrame:
    """(_b, _s, columns): sums of each draw over pieces of strata; a task draws for all places of a stratum and adds up what falls into its piece.

    placed: (_s, _i, _n, columns), places and sizes within strata.  Pairs are copied once for each task that shares the
    draws, never for each draw; what a task holds is bounded by PIECE and BLOCK.  Missing numbers count as in SQL.
    """
    pieces = placed.withColumn("_piece", F.floor(F.col("_i") / PIECE))
    n_pieces = pieces.select("_s", "_piece").distinct().count()
    parts = max(1, min(MAX_PARTS, draws, -(-8 * placed.sparkSession.sparkContext.defaultParallelism // max(1, n_pieces))))
    held, block = PIECE, BLOCK

    def run(table: pa.Table) -> pa.Table:
        n, low, part = table["_n"][0].as_py(), table["_piece"][0].as_py() * held, table["_part"][0].as_py()
        at, m = table["_i"].to_numpy() - low, len(table)
        numbers = []  # by column: its values, nothing in place of the missing ones and, last, of what lies in other pieces
        for c in columns:
            there = ~table[c].is_null().to_numpy()
            values, known = np.zeros(m + 1), np.zeros(m + 1)
            values[at], known[at] = np.where(there, table[c].cast(pa.float64()).to_numpy(), 0.0), there
            numbers.append((values, None if there.all() else known))
        every = np.arange(part, draws, parts)
        sums, counts = np.zeros((len(columns), len(every))), np.zeros((len(columns), len(every)))
        step = max(1, block // n)
        for a in range(0, len(every), step):
            draw = every[a : a + step, None]
            for lo in range(0, n, block):
                picks = drawn(draw, np.arange(lo, min(n, lo + block))[None, :], n) - low
                if m < n:
                    picks[(picks < 0) | (picks >= m)] = m
                for j, (values, known) in enumerate(numbers):
                    sums[j, a : a + step] += values[picks].sum(axis=1)
                    counts[j, a : a + step] += 1 if known is None else known[picks].sum(axis=1)
        key = table["_s"].combine_chunks().take(pa.array(np.zeros(len(every), int)))
        return pa.Table.from_arrays([pa.array(every), key, *(pa.array(x, mask=n == 0) for x, n in zip(sums, counts, strict=True))], names=["_b", "_s", *columns])

    shared = pieces.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    kind = placed.schema["_s"].dataType.simpleString()
    return shared.groupBy("_s", "_piece", "_part").applyInArrow(run, ", ".join(["_b long", f"_s {kind}", *(f"{c} double" for c in columns)]))


def bootstrap(pairs: DataFrame, stratum: str, metrics: dict[str, tuple[str, str]], task: str = "task", draws: int = DRAWS, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(metric, pooled, lo, hi, balanced, balanced_lo, balanced_hi): changes with bootstrap intervals.

    Each draw resamples the pairs of every stratum with replacement, as many as it has; one set of places
    serves all metrics.  An interval ends at the sorted draws' places floor(low * n) and floor(high * n) - 1.
    Few pairs go to every task, which draws in arrays for its part of the draws; many, or pairs with missing
    numbers, are held piece by piece.  Either way at most a row for each draw and stratum in each task is
    shuffled, and the picks are the same.
    """
    names = list(metrics)
    numbers = [F.col(c).alias(f"_{side}{i}") for i, m in enumerate(names) for side, c in zip("xy", metrics[m], strict=True)]
    placed = pairs.select(F.col(stratum).alias("_s"), (F.row_number().over(Window.partitionBy(stratum).orderBy(task)) - 1).cast("long").alias("_i"), F.count("*").over(Window.partitionBy(stratum)).alias("_n"), *numbers)
    columns = [f"_{side}{i}" for i in range(len(names)) for side in "xy"]
    sums = [F.sum(c).alias(c) for c in columns]
    few = pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    by_stratum = _drawn_sums(placed, columns, draws) if few else None
    if by_stratum is None:
        by_stratum = _drawn_by_piece(placed, columns, draws).groupBy("_b", "_s").agg(*sums)
    ratio = lambda i: F.col(f"_x{i}") / F.nullif(F.col(f"_y{i}"), F.lit(0)) - 1
    per_draw = by_stratum.groupBy("_b").agg(*(change(f"_x{i}", f"_y{i}").alias(f"_p{i}") for i in range(len(names))), *(F.avg(ratio(i)).alias(f"_q{i}") for i in range(len(names))))
    # `draws` numbers a metric, however many pairs there are.
    gathered = per_draw.agg(*(F.array_sort(F.collect_list(f"_{c}{i}")).alias(f"_{c}{i}") for i in range(len(names)) for c in "pq"))
    whole = placed.groupBy("_s").agg(*sums)
    points = whole.agg(*(change(f"_x{i}", f"_y{i}").alias(f"_pooled{i}") for i in range(len(names))), *(F.avg(ratio(i)).alias(f"_balanced{i}") for i in range(len(names))))

    def ends(c: str) -> tuple[Column, Column]:
        n = F.size(c)
        return F.get(c, F.floor(n * low).cast("int")), F.get(c, (F.floor(n * high) - 1).cast("int"))

    rows = [
        F.struct(
            F.lit(m).alias("metric"),
            F.col(f"_pooled{i}").alias("pooled"),
            ends(f"_p{i}")[0].alias("lo"),
            ends(f"_p{i}")[1].alias("hi"),
            F.col(f"_balanced{i}").alias("balanced"),
            ends(f"_q{i}")[0].alias("balanced_lo"),
            ends(f"_q{i}")[1].alias("balanced_hi"),
        )
        for i, m in enumerate(names)
    ]
    return points.crossJoin(gathered).select(F.inline(F.array(*rows)))  # one row each


def nearest_rank(rows: DataFrame, group: str, value: str, tie: str) -> DataFrame:
    """(group, p50, p95, p95_low, top, n): exact values of the sorted rows, at places floor(n * p) and floor((n - 1) * p)."""
    w = Window.partitionBy(group)
    placed = rows.select(group, value, (F.row_number().over(w.orderBy(value, tie)) - 1).alias("_k"), F.count("*").over(w).alias("_n"))
    at = lambda place: F.max(F.when(F.col("_k") == F.floor(place), F.col(value)))
    n = F.col("_n")
    return placed.groupBy(group).agg(at(n * 0.5).alias("p50"), at(n * 0.95).alias("p95"), at((n - 1) * 0.95).alias("p95_low"), F.max(value).alias("top"), F.count("*").alias("n"))


def latency_report(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Counts with interpolated percentiles."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.95).alias("p95"), F.max(value).alias("top"))


def median_with_never(rows: DataFrame, value: str) -> DataFrame:
    """(median, ever, n): the median where null means never, itself null if most never did."""
    never = 1e308
    found = rows.agg(F.percentile(F.coalesce(F.col(value).cast("double"), F.lit(never)), 0.5).alias("m"), F.count(value).alias("ever"), F.count("*").alias("n"))
    return found.select(F.when(F.col("m") < 1e300, F.col("m")).alias("median"), "ever", "n")


def average_rank(order: str, *partition: str) -> Column:
    """Ranks from 1, ties sharing their mean."""
    return F.rank().over(Window.partitionBy(*partition).orderBy(order)) + (F.count("*").over(Window.partitionBy(*partition, order)) - 1) / 2


def spearman(rows: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(group, rho, n): the correlation of the average ranks."""
    ranked = rows.select(group, average_rank(a, group).alias("_a"), average_rank(b, group).alias("_b"))
    return ranked.groupBy(group).agg(F.corr("_a", "_b").alias("rho"), F.count("*").alias("n"))


def regression(rows: DataFrame, y: str, x: str) -> DataFrame:
    """(slope, intercept, r2) of the least-squares line."""
    return rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def rank_changes(pairs: DataFrame, group: str, x: str, y: str, task: str = "task", least: float = 1e-9) -> DataFrame:
    """(task, old_rr, new_rr): tasks whose reciprocal rank in their group differs between two numbers, best first."""
    by = lambda c: 1 / F.rank().over(Window.partitionBy(group).orderBy(F.desc(c), task))
    return pairs.select(task, by(x).alias("old_rr"), by(y).alias("new_rr")).filter(F.abs(F.col("old_rr") - F.col("new_rr")) > least)


def grid(spark, **values: list) -> DataFrame:
    """Every combination of the named values, numbered in their order; their number is in the caller's hand."""
    from itertools import product

    names = list(values)
    return spark.createDataFrame([(*combo, i) for i, combo in enumerate(product(*values.values()))], [*names, "config"])


def ranges(rows: DataFrame, key: str, parts: int = 64) -> Column:
    """The number of the range of `key` that a row falls into: at most `parts` ranges of about as many rows, by cut points found once."""
    cuts = rows.agg(F.percentile_approx(F.col(key).cast("double"), [(i + 1) / parts for i in range(parts - 1)])).first()[0]
    value = F.col(key).cast("double")
    return F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < value)) if cuts else F.lit(0)


def running(rows: DataFrame, key: str, amount: Column, part: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of `amount` over all rows with a smaller key (keys distinct), range by range, so that no task holds all rows."""
    ranged = rows.withColumn("_part", part)
    inner = F.sum(amount).over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    outer = F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    before = ranged.groupBy("_part").agg(F.sum(amount).alias("_s")).select("_part", F.coalesce(outer, F.lit(0)).alias("_before"))
    return ranged.withColumn(out, F.coalesce(inner, F.lit(0))).join(F.broadcast(before), "_part").withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_before")


def numbered(rows: DataFrame, key: str, first: Column | None = None) -> DataFrame:
    """Adds `place`, 0 .. n - 1 in the order of a distinct number; rows where `first` holds come before the others."""
    part = ranges(rows, key)
    if first is not None:
        part = F.when(first, part).otherwise(part + 1_000)
    return running(rows, key, F.lit(1), part, "place")


def balanced_plan(tasks: DataFrame, arms: list[str], repeats: int = 1, task: str = "task") -> DataFrame:
    """(task, arm, rep, place): every arm once a task and repeat.

    The order is rotated from task to task and reversed in every other block of tasks, so each arm comes first
    equally often and each two arms come in both orders.
    """
    n = len(arms)
    total = tasks.agg(F.count("*").alias("_total"))  # one row
    runs = numbered(tasks.select(task), task).crossJoin(F.broadcast(total)).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    k = F.col("rep") * F.col("_total") + F.col("place")
    ordered = runs.select(task, "rep", k.alias("_at"), F.posexplode(F.array(*map(F.lit, arms))).alias("_j", "arm"))
    forward = F.pmod(F.col("_j") - F.col("_at"), F.lit(n))
    back = F.pmod(F.floor(F.col("_at") / n), F.lit(2)) == 1
    return ordered.select(task, "arm", "rep", F.when(back, n - 1 - forward).otherwise(forward).cast("long").alias("place"))


def even_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(key, k): n rows evenly spread over the order of the key, the first and the last among them (halves to even)."""
    total = rows.agg(F.count("*").alias("_total"))  # one row
    wanted = total.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"), "_total")
    wanted = wanted.select("k", F.bround(F.col("k") * (F.col("_total") - 1) / float(max(1, n - 1)), 0).cast("long").alias("place"))
    return numbered(rows.select(key), key).join(F.broadcast(wanted), "place").select(key, "k").distinct()  # n rows
