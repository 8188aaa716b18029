"""Confusion and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(rows: DataFrame, classes: int, ignore: int | None = None) -> DataFrame:
    """``label, pred, n`` over rows with both classes in the domain and the label not ignored."""
    valid = rows.where(F.col("label").between(0, classes - 1) & F.col("pred").between(0, classes - 1))
    if ignore is not None:
        valid = valid.where(F.col("label") != ignore)
    return valid.groupBy("label", "pred").agg(F.count("*").alias("n"))


def confusion_wide(counts: DataFrame, classes: int) -> DataFrame:
    return counts.groupBy("label").pivot("pred", list(range(classes))).agg(F.sum("n")).na.fill(0)


def class_metrics(counts: DataFrame, classes: int) -> DataFrame:
    """``label, support, recall, iou`` of every class; null where a class has no rows to judge."""
    domain = counts.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"))
    truth = counts.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    guess = counts.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("guessed"))
    all_of = domain.join(truth, "label", "left").join(guess, "label", "left").na.fill(0, ["support", "hit", "guessed"])
    union = F.col("support") + F.col("guessed") - F.col("hit")
    return all_of.select("label", "support", F.when(F.col("support") > 0, F.col("hit") / F.col("support")).alias("recall"), F.when(union > 0, F.col("hit") / union).alias("iou"))


def overall(counts: DataFrame, classes: int) -> DataFrame:
    """One row: overall accuracy, mean recall over classes with rows, mean IoU over classes with a union, and the number judged."""
    means = class_metrics(counts, classes).agg(F.avg("recall").alias("macc"), F.avg("iou").alias("miou"))
    total = counts.agg(F.sum("n").alias("judged"), F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    return total.crossJoin(F.broadcast(means)).select("judged", F.when(F.col("judged") > 0, F.col("hit") / F.col("judged")).alias("oa"), "macc", "miou")


def cross_entropy(rows: DataFrame, probabilities: str = "probs") -> DataFrame:
    """Mean of -ln of the probability given to each row's label: infinite if one is 0, NaN if one is negative or NaN; nulls do not count.

    Spark's logarithm is null for what is not positive, which would leave such rows out of the mean.
    """
    p = F.element_at(probabilities, F.col("label").cast("int") + 1)
    loss = F.when(p < 0, float("nan")).when(p == 0, float("inf")).otherwise(-F.log(p))
    return rows.agg(F.avg(loss).alias("loss"))


def run_statistics(runs: DataFrame, by: str, values: list[str]) -> DataFrame:
    """Mean and population deviation of several runs."""
    return runs.groupBy(by).agg(F.count("*").alias("runs"), *[f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def argmax_class(probabilities: str = "probs"):
    """The first class of the largest probability."""
    return (F.array_position(F.col(probabilities), F.array_max(probabilities)) - 1).cast("int")


def top_share(counts: DataFrame) -> DataFrame:
    """Adds ``share``: of each label's rows, the part that each prediction has."""
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("label")))
