"""Set operations and key checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .selection import first_per_group


def key_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct().orderBy(key)


def rows_of_all(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def split(df: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): every row is in one of them; a null condition drops."""
    yes = F.coalesce(keep, F.lit(False))
    return df.where(yes), df.where(~yes)


def dedup_queries(df: DataFrame, query: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The first row of each normalised query. Rows are grouped by a digest of it."""
    return first_per_group(df.withColumn("query_key", F.sha2(X.query_key(F.col(query)).cast("binary"), 256)), [*by, "query_key"], order)


def repeated_ids(df: DataFrame, key: str) -> DataFrame:
    """Empty if the key is unique."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def split_complete(whole: DataFrame, parts: Sequence[DataFrame]) -> DataFrame:
    """One row: how many rows there are, how many the parts have, and whether these agree."""
    n = whole.agg(F.count(F.lit(1)).alias("n_whole"))
    union = parts[0].select(F.lit(1).alias("one"))
    for p in parts[1:]:
        union = union.union(p.select(F.lit(1)))
    return n.join(F.broadcast(union.agg(F.count(F.lit(1)).alias("n_parts")))).withColumn("complete", F.col("n_whole") == F.col("n_parts"))
