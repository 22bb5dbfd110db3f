"""Calibration of chances against 0/1 truths: losses, areas, bins, thresholds and temperatures.

Every figure is one aggregate; `group` (optional) gives a row for each of its values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanlens.operators.stats import ranges, running
from spanlens.sources.store import stored

EPSILON = 1e-9
T_MIN, T_MAX, GRID = math.exp(-2), math.exp(2), 121


def _clipped(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1 - EPSILON)), F.lit(EPSILON))


def log_loss(p: Column, y: Column) -> Column:
    """-ln of the chance given to what is true; y may lie between 0 and 1."""
    p = _clipped(p)
    return -(y * F.ln(p) + (1 - y) * F.ln(1 - p))


def nll(rows: DataFrame, p: str = "p", y: str = "y", group: str | None = None) -> DataFrame:
    return rows.groupBy(*([group] if group else [])).agg(F.avg(log_loss(F.col(p), F.col(y))).alias("nll"), F.count("*").alias("n"))


def auroc(rows: DataFrame, p: str = "p", y: str = "y", group: str | None = None) -> DataFrame:
    """(auroc, positives, n): the chance that a positive is ranked above a negative, ties counting half.

    From the counts of each value of p: what is below it is a running sum over distinct values, taken range by
    range, so that no task holds all rows.  Null where a group has one kind only.
    """
    keys = [group] if group else []
    levels = rows.groupBy(*keys, F.col(p).alias("_p")).agg(F.sum(F.col(y).cast("long")).alias("_pos"), F.count("*").alias("_n")).withColumn("_neg", F.col("_n") - F.col("_pos"))
    if group:
        below = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        summed = levels.withColumn("_below", F.coalesce(F.sum("_neg").over(below), F.lit(0)))
    else:
        summed = running(levels, "_p", F.col("_neg"), ranges(levels, "_p"), "_below")
    positives, negatives = F.sum("_pos"), F.sum("_neg")
    area = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2)) / F.nullif(positives * negatives, F.lit(0))
    return summed.groupBy(*keys).agg(area.alias("auroc"), positives.alias("positives"), F.sum("_n").alias("n"))


def reliability(rows: DataFrame, bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """(bin, n, conf, acc) of equal-width bins of the chance; 1 falls into the last."""
    place = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("long")
    return rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("conf"), F.avg(y).alias("acc"))


def ece(rows: DataFrame, bins: int = 15, p: str = "p", y: str = "y") -> DataFrame:
    """Expected calibration error: the bins' gaps between chance and truth, by their rows."""
    return reliability(rows, bins, p, y).agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def precision_recall(rows: DataFrame, thresholds: list[float], p: str = "p", y: str = "y") -> DataFrame:
    """(threshold, kept, precision, recall) at each of a few thresholds, in one pass."""
    cells = []
    for i, t in enumerate(thresholds):
        hit = F.col(p) >= t
        cells += [F.count_if(hit).alias(f"_k{i}"), F.sum(F.when(hit, F.col(y)).otherwise(0)).alias(f"_t{i}")]
    found = rows.agg(F.sum(y).alias("_all"), *cells)
    row = [
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_k{i}").alias("kept"), (F.col(f"_t{i}") / F.nullif(F.col(f"_k{i}"), F.lit(0))).alias("precision"), (F.col(f"_t{i}") / F.nullif(F.col("_all"), F.lit(0))).alias("recall"))
        for i, t in enumerate(thresholds)
    ]
    return found.select(F.inline(F.array(*row)))


def tempered(p: Column, log_t: Column) -> Column:
    """The chance at another temperature, from its log-odds."""
    z = F.ln(p / (1 - p)) / F.exp(log_t)
    return 1 / (1 + F.exp(-z))


def _losses(rows: DataFrame, log_ts: list[float], p: str, y: str, n: str | None = None) -> DataFrame:
    """(i, log_t, nll) of each of a few logarithms of the temperature; sums are taken in each task.  n: how often each row counts."""
    spots = F.posexplode(F.array(*(F.lit(float(t)) for t in log_ts))).alias("i", "log_t")
    every = rows.select(F.col(p).alias("_p"), F.col(y).alias("_y"), (F.col(n) if n else F.lit(1)).alias("_n"), spots)
    loss = log_loss(tempered(F.col("_p"), F.col("log_t")), F.col("_y"))
    mean = F.sum(loss * F.col("_n")) / F.sum(F.when(loss.isNotNull(), F.col("_n"))) if n else F.avg(loss)
    return every.groupBy("i", "log_t").agg(mean.alias("nll"))


def temperature_grid(rows: DataFrame, p: str = "p", y: str = "y", low: float = -2.0, high: float = 2.0, steps: int = GRID) -> DataFrame:
    """(i, log_t, nll) at evenly spaced logarithms of the temperature, both ends included."""
    return _losses(rows, [low + (high - low) * i / (steps - 1) for i in range(steps)], p, y)


def fit_temperature(rows: DataFrame, p: str = "p", y: str = "y", refine: int = 60) -> float:
    """The temperature of the least loss: the best of a grid, then golden-section steps around it.

    Equal chances and outcomes are counted once, into the shared folder; each step is one aggregate over these counts at
    a few temperatures, of which one number each reaches the driver.
    """
    counted = stored(rows.groupBy(F.col(p).alias("p"), F.col(y).alias("y")).agg(F.count("*").alias("n")), "chances")
    low, high = math.log(T_MIN), math.log(T_MAX)

    def losses(spots: list[float]) -> list[float]:
        return [r.nll for r in sorted(_losses(counted, spots, "p", "y", "n").collect(), key=lambda r: r.i)]

    grid = [low + (high - low) * i / (GRID - 1) for i in range(GRID)]
    found = losses(grid)
    at = min(range(GRID), key=lambda i: found[i])
    lo, hi = grid[max(0, at - 1)], grid[min(GRID - 1, at + 1)]
    golden, inner = (math.sqrt(5) - 1) / 2, 16
    # As narrow a bracket as `refine` golden-section steps leave, but a pass over the rows tries sixteen inner points at once.
    while hi - lo > max(1e-12, 2 * (grid[1] - grid[0]) * golden**refine):
        spots = [lo + (hi - lo) * (i + 1) / (inner + 1) for i in range(inner)]
        found = losses(spots)
        k = min(range(inner), key=lambda i: found[i])
        lo, hi = (spots[k - 1] if k else lo), (spots[k + 1] if k + 1 < inner else hi)
    return math.exp((lo + hi) / 2)
