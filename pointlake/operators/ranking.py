"""Ranks without a task for each group.

``row_number`` over a group sorts the whole group in one task. Here the order is cut into ranges of
about equal numbers of rows, rows are counted for each group and range (map-side), running sums of
those counts give each range its offset, and only rows of one group and range are ranked together.
The ranges are cut on the whole order, so that rows which share its first column are split too, and
their number grows with the rows up to MOST.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Spark's default for spark.sql.optimizer.windowGroupLimitThreshold.
LIMIT = 1000
#: Rows of a range, about; the most ranges; and how many rows are looked at for each.
ROWS, MOST, LOOK = 100_000, 1024, 20


def _bucket(value: Column, bounds: Sequence[Column], low: int = 0) -> Column:
    """How many bounds lie below the value, by a balanced tree of comparisons."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(value <= bounds[mid], _bucket(value, bounds[:mid], low)).otherwise(_bucket(value, bounds[mid + 1 :], low + mid + 1))


def ranges(df: DataFrame, order: Sequence[str], n: int | None = None) -> list[Column]:
    """Bounds that cut the order into ranges of about equal counts: quantiles of the rows whose hash is
    least, LOOK for each range in expectation. What is collected has a fixed bound."""
    total = df.count()
    n = n or min(MOST, max(1, total // ROWS))
    if n < 2:
        return []
    part = F.pmod(F.xxhash64(*order), F.lit(1 << 40)) / float(1 << 40)
    seen = df.select(*order).where(part < LOOK * n / max(1, total)).orderBy(*order).limit(2 * LOOK * n).collect()
    picked = [seen[len(seen) * k // n] for k in range(1, n)] if seen else []
    kinds = [df.schema[c].dataType for c in order]
    return [F.struct(*[F.lit(v).cast(t).alias(c) for c, v, t in zip(order, r, kinds)]) for r in dict.fromkeys(map(tuple, picked))]


def rank(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str, size: str | None = None, n: int | None = None) -> DataFrame:
    """Add the 0-based rank of each row within ``by`` and, as ``size``, the number of rows of ``by``.

    ``order`` names columns and is total, ascending, nulls first. ``n``: how many ranges, by default
    one for ROWS rows.
    """
    key = F.struct(*[F.col(c).alias(c) for c in order])
    placed = df.withColumn("_range", _bucket(key, ranges(df, order, n)))
    counts = placed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy(*by)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(over.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if size:
        offsets = offsets.withColumn(size, F.sum("_n").over(over))
    same = [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in (*by, "_range")]
    offsets = offsets.drop("_n").withColumnsRenamed({c: f"_o_{c}" for c in (*by, "_range")})
    inner = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)) - 1
    ranked = placed.withColumn("_inner", inner)
    return ranked.join(offsets, reduce(and_, same)).withColumn(name, F.col("_before") + F.col("_inner")).drop("_range", "_before", "_inner", *[f"_o_{c}" for c in (*by, "_range")])


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], most: int, name: str = "_nth") -> DataFrame:
    """Rows whose 1-based rank (added as ``name``) is at most ``most``.

    Up to LIMIT the rank limit is one that Spark applies in each task before the shuffle. A greater
    one is no such limit, so ranks are found over ranges: no task sorts a whole group either way.
    """
    if most <= LIMIT:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= most)
    return rank(df, by, order, name).withColumn(name, (F.col(name) + 1).cast("int")).where(F.col(name) <= most)
