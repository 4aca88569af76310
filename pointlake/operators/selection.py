"""Choosing rows: ranks, quotas, resume points, exclusion keys, prefixes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import LIMIT, first_rows, rank


def with_rank(df: DataFrame, source: str, order: Sequence[str], name: str = "source_rank") -> DataFrame:
    """1-based rank within each source by a total order that opens with a number; a source of any
    size is spread over many tasks."""
    return rank(df, [source], order, name).withColumn(name, F.col(name) + 1)


def resume_after(df: DataFrame, frontier: DataFrame, source: str = "source", at: str = "source_rank") -> DataFrame:
    """Rows beyond each source's frontier (source, resume_rank). A source without one starts at 1."""
    return df.join(frontier, source, "left").where(F.col(at) > F.coalesce("resume_rank", F.lit(0))).drop("resume_rank")


def resume_before(df: DataFrame, frontier: DataFrame, source: str = "source", at: str = "source_rank") -> DataFrame:
    """The same for a scan from the end: rows below the frontier; 0 or none means all."""
    return df.join(frontier, source, "left").where((F.coalesce("resume_rank", F.lit(0)) == 0) | (F.col(at) < F.col("resume_rank"))).drop("resume_rank")


def frontier(done: DataFrame, source: str = "source", at: Column | None = None, reverse: bool = False) -> DataFrame:
    """Largest (or smallest) processed rank of each source."""
    at = F.col("source_rank") if at is None else at
    return done.groupBy(source).agg((F.min(at) if reverse else F.max(at)).alias("resume_rank")).where("resume_rank is not null")


def rank_or_prefix(given: Column, file: Column) -> Column:
    """The rank, else the digits that the file name opens with."""
    return F.coalesce(given.try_cast("int"), F.nullif(F.regexp_extract(file, r"^([0-9]+)(?:__|$|\.)", 1), F.lit("")).try_cast("int"))


def quota_cap(df: DataFrame, quotas: Mapping[str, int] | None, cap: int, source: str = "source", order: Sequence[str] = ("source_rank",), name: str = "source_rank") -> DataFrame:
    """The first rows of each source up to its quota (0 shuts it, none is no limit), then the first
    ``cap`` of them by source and rank. Adds the rank within the source, 1-based.

    No source can give more than ``cap`` rows, so only first rows are ranked (``ranking.first_rows``).
    """
    quotas = dict(quotas or {})
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(source)) if quotas else F.lit(None).cast("int")
    ranked = first_rows(df, [source], order, cap, name)
    return ranked.where(F.col(name) <= F.coalesce(limit, F.lit(cap))).orderBy(source, name).limit(cap)


def prefix_until(df: DataFrame, hit: Column, order: Sequence, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows up to and with the n-th hit in order: what a scan that stops early has read.

    The n-th hit is found first (the hits alone are ranked), then rows are compared with it: no
    running total over all rows. ``order`` is a list of column names that is total.
    """
    key = F.struct(*order)
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) if by else None
    hits = df.where(hit)
    if by:
        stop = hits.withColumn("_n", nth).where(F.col("_n") == n).select(*by, key.alias("_stop"))
        return df.join(stop, list(by), "left").where(F.col("_stop").isNull() | (key <= F.col("_stop"))).drop("_stop")
    found = hits.select(key.alias("_stop")).orderBy("_stop").limit(n)
    stop = found.agg(F.max("_stop").alias("_stop"), F.count(F.lit(1)).alias("_n"))
    # One row: its size is known.
    return df.join(F.broadcast(stop)).where((F.col("_n") < n) | (key <= F.col("_stop"))).drop("_stop", "_n")


def first_per_group(df: DataFrame, by: Sequence, order: Sequence, n: int = 1) -> DataFrame:
    """The first n rows of each group. Beyond 1000 rows ``by`` and ``order`` are column names."""
    if n > LIMIT:
        return first_rows(df, by, order, n).drop("_nth")
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def exclude(df: DataFrame, keys: DataFrame, key: Column, column: str) -> DataFrame:
    """Rows whose key isn't among ``keys``; a blank key never matches. Keys may be whole texts: they meet
    as digests, so that only these are shuffled beside the columns that are kept."""
    wanted = keys.select(digest(F.col(column)).alias("_key")).where("_key is not null").distinct()
    return df.withColumn("_own", digest(key)).join(wanted, F.col("_own") == F.col("_key"), "left_anti").drop("_own")


def digest(text: Column) -> Column:
    """A key of fixed length for a text; null if it is blank."""
    return F.when(F.trim(text) != "", F.sha2(text.cast("binary"), 256))


def unfinished(jobs: DataFrame, done: DataFrame, keys: Sequence[str], valid: Column) -> DataFrame:
    """Jobs without a valid result: running again is a no-op."""
    return jobs.join(done.where(valid).select(*keys).distinct(), list(keys), "left_anti")


def selection_stats(df: DataFrame, source: Column, reason: Column) -> DataFrame:
    """Scanned, selected and skipped by reason (null: selected), for each source."""
    return df.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("scanned"), F.count_if(reason.isNull()).alias("selected"), F.count_if(reason.isNotNull()).alias("skipped"))


def contributed(keys: DataFrame, root: str, order: Column, key: str) -> DataFrame:
    """How many distinct keys each root was the first to give; roots that gave none count 0."""
    first = keys.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(order.alias("o"), F.col(root).alias("r")))["r"].alias(root))
    counts = first.groupBy(root).agg(F.count(F.lit(1)).alias("new_keys"))
    return keys.select(root).distinct().join(counts, root, "left").select(root, F.coalesce("new_keys", F.lit(0)).alias("new_keys"))


def prefix_summary(df: DataFrame, n_points: Column, target: int, at: str, start: int = 0) -> DataFrame:
    """A bounded scan for records of several points: what was selected, scanned, skipped; and where it ended."""
    seen = prefix_until(df.where(F.col(at) > start).withColumn("_p", n_points), F.col("_p") > 1, [at], target)
    n = F.count(F.lit(1))
    return seen.agg(
        F.count_if(F.col("_p") > 1).alias("selected"), n.alias("scanned"), F.count_if(F.coalesce("_p", F.lit(0)) <= 0).alias("skipped_no_points"), F.count_if(F.col("_p") == 1).alias("skipped_single_point"),
        (F.lit(start) + n).alias("end_rank"), (F.count_if(F.col("_p") > 1) / F.greatest(n, F.lit(1))).alias("rate"),
    )


def quota_marks(df: DataFrame, kept: Column, quota: int, source: str, order: str) -> DataFrame:
    """Add ``within_quota`` to kept rows: among the first ``quota`` of their source by ``order`` (unique).

    Only the first rows of each source are ranked (``ranking.first_rows``); the last of them is the mark
    that all rows are compared with. A source of any size stays spread out.
    """
    first = first_per_group(df.where(kept).select(source, order), [source], [order], quota)
    marks = first.groupBy(source).agg(F.max(order).alias("_mark"))
    return df.join(marks, source, "left").withColumn("within_quota", kept & F.coalesce(F.col(order) <= F.col("_mark"), F.lit(False))).drop("_mark")
