"""What a learned re-ranker needs around the model: questions, budgets, losses over lists, labels from diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HEAD, OPTION, WINDOW, LEAST = 192, 48, 512, 16
HUNK, SAME_FILE, OTHER = 1.0, 0.6, 0.0


def render_question(kind: Column, text: Column, options: Column) -> Column:
    """`kind: text` and the options in brackets."""
    return F.concat(kind, F.lit(": "), text, F.array_join(F.transform(options, lambda o: F.concat(F.lit(" ["), o, F.lit("]"))), ""))


def option_bucket(kind: Column, options: Column) -> Column:
    """Which temperature a question is calibrated with: its kind and how many options it has."""
    size = F.when(options <= 2, "2").when(options <= 5, "3-5").when(options <= 10, "6-10").otherwise("11+")
    return F.concat(kind, F.lit(":"), size)


def sequence_budget(head: Column, option: Column, options: int = 4, window: int = WINDOW) -> Column:
    """struct<head, opt, state>: ids for the question, each option and the rest, which keeps at least a few."""
    h, o = F.least(head, F.lit(HEAD)), F.least(option, F.lit(OPTION))
    return F.struct(h.alias("head"), o.alias("opt"), F.greatest(F.lit(window) - h - o * options, F.lit(LEAST)).alias("state"))


def softmax(rows: DataFrame, group: str, logit: Column, temperature: float = 1.0, out: str = "p") -> DataFrame:
    """Adds the chance of each row within its group; the largest logit is taken off first."""
    w = Window.partitionBy(group)
    scaled = rows.withColumn("_z", logit / temperature)
    shifted = scaled.withColumn("_e", F.exp(F.col("_z") - F.max("_z").over(w)))
    return shifted.withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_z", "_e")


def _log_sum(z: str, top: str) -> Column:
    return F.col(top) + F.ln(F.sum(F.exp(F.col(z) - F.col(top))))


def listwise_loss(rows: DataFrame, group: str, logit: Column, label: Column) -> DataFrame:
    """(lists, loss): cross entropy of each list's softmax against its labels' shares; lists without a positive are left out."""
    z = rows.select(F.col(group).alias("_g"), logit.alias("_z"), label.cast("double").alias("_y")).withColumn("_m", F.max("_z").over(Window.partitionBy("_g")))
    lists = z.groupBy("_g", "_m").agg((F.col("_m") + F.ln(F.sum(F.exp(F.col("_z") - F.col("_m"))))).alias("_l"), F.sum("_y").alias("_ys"), F.sum(F.col("_y") * F.col("_z")).alias("_yz"))
    return lists.filter("_ys > 0").agg(F.count("*").alias("lists"), F.avg(F.col("_l") - F.col("_yz") / F.col("_ys")).alias("loss"))


def distillation_loss(rows: DataFrame, group: str, teacher: Column, student: Column) -> DataFrame:
    """(lists, loss): the mean divergence of the student's softmax from the teacher's."""
    both = softmax(softmax(rows.select(F.col(group).alias("_g"), teacher.alias("_t"), student.alias("_s")), "_g", F.col("_t"), out="_p"), "_g", F.col("_s"), out="_q")
    lists = both.groupBy("_g").agg(F.sum(F.col("_p") * (F.ln("_p") - F.ln("_q"))).alias("_k"))
    return lists.agg(F.count("*").alias("lists"), F.avg("_k").alias("loss"))


def teacher_cache(rows: DataFrame, key: str, position: str, logit: str) -> DataFrame:
    """(key, logits): a list's logits in order as one array, to be written as Parquet and joined by key."""
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("_at"), F.col(logit).cast("double").alias("_z")))), lambda x: x["_z"]).alias("logits"))


def with_teacher(rows: DataFrame, cache: DataFrame, key: str, position: str, out: str = "teacher") -> DataFrame:
    """The rows with the cached logit of their place in the list (from 0); null where the cache has none."""
    return rows.join(cache, key, "left").withColumn(out, F.get("logits", F.col(position).cast("int"))).drop("logits")


def label_candidates(candidates: DataFrame, hunks: DataFrame, path: str = "path", id: str = "id") -> DataFrame:
    """(id, label): 1 for spans (lo, hi) that a hunk of their file touches, 0.6 for others of a touched file, 0 for the rest."""
    h = hunks.select(F.col(path), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    met = candidates.join(h, path, "left").groupBy(id).agg(F.count("_lo").alias("_file"), F.count_if((F.col("lo") <= F.col("_hi")) & (F.col("_lo") <= F.col("hi"))).alias("_hit"))
    return met.select(id, F.when(F.col("_hit") > 0, F.lit(HUNK)).when(F.col("_file") > 0, F.lit(SAME_FILE)).otherwise(F.lit(OTHER)).alias("label"))
