"""Counts, confusion, recall, accuracy, rolling means, leaderboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status_counts(df: DataFrame, source: str, status: str) -> DataFrame:
    """Counts by (source, status), by status and in total, in one pass; ``level`` tells which."""
    sets = df.groupingSets([[F.col(source), F.col(status)], [F.col(status)], []], source, status)
    return sets.agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def reason_counts(df: DataFrame, reasons: Column) -> DataFrame:
    return df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: Column) -> DataFrame:
    return df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def merge_counts(a: DataFrame, b: DataFrame, key: str, n: str = "n") -> DataFrame:
    return a.unionByName(b).groupBy(key).agg(F.sum(n).cast("long").alias(n))


def confusion(df: DataFrame, truth: str, said: str, labels: Sequence) -> DataFrame:
    """One row for each truth, one column for each label and one for the rest."""
    at = [F.count_if(F.col(said) == v).alias(f"said_{v}") for v in labels]
    return df.groupBy(truth).agg(*at, F.count_if(F.col(said).isNull() | ~F.col(said).isin(*labels)).alias("said_none"))


def precision_recall(df: DataFrame, truth: str, said: str) -> DataFrame:
    """Precision, recall, F1 and support of each label; 0 where a denominator is 0. One pass:
    a row counts once for its truth and once for what was said."""
    hit = F.coalesce(F.col(truth) == F.col(said), F.lit(False)).cast("int")
    both = df.select(F.inline(F.array(
        F.struct(F.col(truth).cast("string").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("s"), hit.alias("h")),
        F.struct(F.col(said).cast("string").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("s"), F.lit(0).alias("h")),
    ))).where("label is not null")
    g = both.groupBy("label").agg(F.sum("t").alias("t"), F.sum("s").alias("s"), F.sum("h").alias("h"))
    p, r = F.coalesce(F.try_divide("h", "s"), F.lit(0.0)), F.coalesce(F.try_divide("h", "t"), F.lit(0.0))
    return g.select("label", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), F.col("t").alias("support"))


def macro(report: DataFrame) -> DataFrame:
    return report.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))


def rate_rollup(df: DataFrame, label: str, ok: Column, name: str = "rate") -> DataFrame:
    """Rows, hits and hits over rows for each label and in total (a null label)."""
    rows = df.select(F.col(label).alias("label"), ok.cast("int").alias("_ok"))
    g = rows.rollup("label").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_ok"), F.lit(0)).alias("ok"), F.grouping_id().alias("level"))
    return g.withColumn(name, F.coalesce(F.try_divide("ok", "n"), F.lit(0.0)))


def accuracy(df: DataFrame, category: str, ok: Column, parsed: Column) -> DataFrame:
    """Per cent right for each category and in total, and how many outputs could not be read."""
    rows = df.select(F.col(category).alias("category"), ok.cast("int").alias("_ok"), (~parsed).cast("int").alias("_bad"))
    g = rows.rollup("category").agg(F.count(F.lit(1)).alias("n"), F.sum("_ok").alias("ok"), F.sum("_bad").alias("invalid"), F.grouping_id().alias("level"))
    return g.withColumn("accuracy", F.round(100.0 * F.col("ok") / F.col("n"), 2))


def score(points: Column, expected: Column, category: Column, in_mask: Column) -> Column:
    """Counting: as many points as expected, all in the mask. Else: the first point in the mask."""
    return F.when(category == "counting", (F.size(points) == expected) & F.forall(in_mask, lambda x: x)).otherwise(F.coalesce(F.get(in_mask, 0), F.lit(False)))


def weighted_mean(df: DataFrame, loss: Column, weight: Column, by: Sequence[str] = ()) -> DataFrame:
    """Sum of loss times weight over the larger of 1 and the weights."""
    return df.groupBy(*by).agg((F.sum(loss * weight) / F.greatest(F.sum(weight), F.lit(1.0))).alias("mean"), F.sum(weight).alias("weight"))


def rolling_mean(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], n: int = 100) -> DataFrame:
    over = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rolling_mean", F.avg(value).over(over.rowsBetween(1 - n, 0))).withColumn("running_mean", F.avg(value).over(over.rowsBetween(Window.unboundedPreceding, 0)))


def leaderboard(old: DataFrame, new: DataFrame, ident: str, m: int) -> DataFrame:
    """The m best by overall, then reasoning, then steerability, then the earlier step. What is
    submitted again replaces its old entry."""
    kept = old.join(new.select(ident).distinct(), ident, "left_anti").unionByName(new)
    return kept.orderBy(F.desc("overall"), F.desc("reasoning"), F.desc("steerability"), "step", ident).limit(m)


def audit(df: DataFrame, dataset: str, datasets: DataFrame, image: Column, image_id: Column, points: Column) -> DataFrame:
    """Rows, rows with and without an image, distinct images, mean points; datasets without rows too."""
    g = df.groupBy(dataset).agg(F.count(F.lit(1)).alias("rows_total"), F.count_if(image).alias("rows_with_image"), F.count_if(~image).alias("rows_missing_image"), F.count_distinct(image_id).alias("distinct_images"), F.avg(points).alias("avg_points"))
    filled = datasets.join(g, dataset, "left")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return filled.select(dataset, n("rows_total"), n("rows_with_image"), n("rows_missing_image"), n("distinct_images"), F.coalesce("avg_points", F.lit(0.0)).alias("avg_points"), (n("rows_with_image") == n("rows_total")).alias("all_have_images"))
