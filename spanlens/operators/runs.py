"""Tables of runs: repeats averaged, stalled tasks left out, ledgers of tool calls, prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def average_repeats(runs: DataFrame, metrics: list[str], healthy: Column, codes: str, task: str = "task", arm: str = "arm", model: str | None = None) -> DataFrame:
    """(task, arm, metrics, reps, codes, unhealthy): the runs of a task in an arm as one.

    Unhealthy runs go where a healthy one exists, else they all stay and the row says so.  Means leave nulls out.
    Runs of two models are never averaged: with `model` given that is an error.
    """
    of = Window.partitionBy(task, arm)
    marked = runs.withColumn("_ok", F.coalesce(healthy, F.lit(True))).withColumn("_any", F.max("_ok").over(of)).filter("_ok OR NOT _any")
    cells = [F.avg(m).alias(m) for m in metrics]
    if model is not None:
        mixed = F.size(F.collect_set(F.coalesce(F.col(model), F.lit("-")))) > 1
        cells.append(F.when(mixed, F.raise_error(F.concat(F.lit("runs of two models: "), F.first(F.col(task).cast("string"))))).otherwise(F.first(model)).alias(model))
    return marked.groupBy(task, arm).agg(*cells, F.count("*").alias("reps"), F.array_sort(F.collect_list(codes)).alias("codes"), (~F.max("_any")).alias("unhealthy"))


def without(runs: DataFrame, bad: Column, task: str = "task") -> DataFrame:
    """The runs of tasks that have no bad run in any arm."""
    return runs.join(runs.filter(bad).select(task).distinct(), task, "left_anti")


def interim(runs: DataFrame, tasks: DataFrame, metric: str, task: str = "task", arm: str = "arm") -> DataFrame:
    """(arm, mean, n) over the given tasks only."""
    return runs.join(tasks, task, "left_semi").groupBy(arm).agg(F.avg(metric).alias(metric), F.count("*").alias("n"))


def tool_ledger(sessions: DataFrame, tools: list[str], calls: str = "tool_calls", arm: str = "arm") -> DataFrame:
    """(arm, sessions, each tool, other, total): mean calls a session, from a map of counts; no map is no calls."""
    counts = F.coalesce(F.col(calls), F.create_map().cast("map<string,bigint>"))
    total = F.aggregate(F.map_values(counts), F.lit(0).cast("bigint"), lambda a, n: a + n)
    named = {t: F.coalesce(F.try_element_at(counts, F.lit(t)), F.lit(0)) for t in tools}
    rows = sessions.select(arm, total.alias("total"), *(c.alias(t) for t, c in named.items()))
    rows = rows.withColumn("other", F.col("total") - sum((F.col(t) for t in tools), F.lit(0)))
    return rows.groupBy(arm).agg(F.count("*").alias("sessions"), *(F.avg(c).alias(c) for c in (*tools, "other", "total")))


def action_counts(log: DataFrame, *by: str) -> DataFrame:
    return log.groupBy(*by).agg(F.count("*").alias("n"))


def price(usage: DataFrame, rates: dict[str, tuple[float, float]], session: str, component: str, amount: str) -> DataFrame:
    """(session, component, cost, fees): amounts at the rate of their component plus a fee for each entry; others cost nothing."""
    rate = fee = F.lit(None).cast("double")
    for name, (per, once) in rates.items():
        rate, fee = F.when(F.col(component) == name, per).otherwise(rate), F.when(F.col(component) == name, once).otherwise(fee)
    priced = usage.select(session, component, (F.col(amount) * rate).alias("_c"), fee.alias("_f")).dropna(subset=["_f"])
    return priced.groupBy(session, component).agg(F.sum("_c").alias("cost"), F.sum("_f").alias("fees"))


def cold_cost(runs: DataFrame, order: list[str], cost: str = "cost", task: str = "task", arm: str = "arm") -> DataFrame:
    """(arm, cold, n): the median cost over the runs that came first for their task, before anything was warm."""
    first = runs.groupBy(task).agg(F.min(F.struct(*order, arm, cost)).alias("_f")).select(F.col(f"_f.{arm}").alias(arm), F.col(f"_f.{cost}").alias(cost))
    return first.groupBy(arm).agg(F.percentile(cost, 0.5).alias("cold"), F.count("*").alias("n"))


def shares(rows: DataFrame, group: str, kind: str, weight: str | None = None) -> DataFrame:
    """(group, kind, n, share): each kind's part of its group, by rows or by weight."""
    n = F.sum(weight) if weight else F.count("*")
    counted = rows.groupBy(group, kind).agg(n.alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def summary(rows: DataFrame, by: list[str], chars: str, gold: Column) -> DataFrame:
    """(by, prompts, chars, gold) of a replay."""
    return rows.groupBy(*by).agg(F.count("*").alias("prompts"), F.avg(chars).alias("chars"), F.count_if(gold).alias("gold"))
