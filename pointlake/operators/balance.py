"""Balancing and sampling: category pools, quotas from ratios, rotation, stratified and weighted samples."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import first_rows, rank


def integer_weights(ratios: Mapping[str, float]) -> dict[str, int]:
    """Ratios as the smallest whole numbers in the same proportion; those not above 0 are left out."""
    parts = {k: Fraction(str(float(v))).limit_denominator(1000) for k, v in ratios.items() if v is not None and float(v) > 0}
    if not parts:
        raise ValueError("no ratio is above 0")
    common = math.lcm(*(p.denominator for p in parts.values()))
    whole = {k: int(p * common) for k, p in parts.items()}
    shared = math.gcd(*whole.values())
    return {k: whole[k] // max(1, shared) for k in sorted(whole)}


def pools(df: DataFrame, category: str, order: Sequence[str]) -> DataFrame:
    """Add each row's 0-based place in its category and the size of the category. ``order`` is total
    and opens with a number."""
    return rank(df, [category], order, "pool_index", "pool_size")


def quotas(df: DataFrame, category: str, weights: Mapping[str, int]) -> DataFrame:
    """(category, weight, available, quota): weight times the number of whole sets there are."""
    table = df.sparkSession.createDataFrame(list(weights.items()), "category string, weight long").withColumnRenamed("category", category)
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("available"))
    # One row for each weight given.
    both = F.broadcast(table).join(counts, category, "left").withColumn("available", F.coalesce("available", F.lit(0)))
    sets = F.min(F.floor(F.col("available") / F.col("weight"))).over(Window.partitionBy())
    return both.withColumn("quota", (F.col("weight") * sets).cast("long"))


def rotate(df: DataFrame, index: Column, size: Column, quota: Column, offset: Column) -> DataFrame:
    """Add ``active``: the slice of ``quota`` places from ``offset`` on, wrapping around."""
    return df.withColumn("active", F.when(quota <= 0, False).when(quota >= size, True).otherwise(F.pmod(index - offset, size) < quota))


def next_offset(offset: Column, size: Column, quota: Column, step: Column | None = None) -> Column:
    """The offset of the next round; it moves only where there is something to rotate."""
    return F.when((size > quota) & (quota > 0), F.pmod(offset + (quota if step is None else step), size)).otherwise(offset)


def report(df: DataFrame, category: str) -> DataFrame:
    """Eligible, active and discarded rows of each category."""
    return df.groupBy(category).agg(F.count(F.lit(1)).alias("eligible"), F.count_if("active").alias("active"), F.count_if(~F.col("active")).alias("discarded"))


def source_ratio(df: DataFrame, source: str) -> DataFrame:
    counts = df.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("ratio", F.col("n") / F.sum("n").over(Window.partitionBy()))


def expected_ratio(df: DataFrame, source: str, power: float) -> DataFrame:
    """Shares of the sources when rows are drawn with weight (1 / count) ** power."""
    counts = df.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    mass = F.col("n") * F.pow(F.lit(1.0) / F.col("n"), F.lit(power))
    return counts.withColumn("ratio", mass / F.sum(mass).over(Window.partitionBy()))


def stratified(df: DataFrame, strata: Sequence[str], n: int, key: Column) -> DataFrame:
    """n rows of each stratum: those with the least hash."""
    return first_rows(df.withColumn("_k", key), strata, ["_k"], n).drop("_k", "_nth")


def manifest(df: DataFrame, ident: str, category: str, method: str, per_category: int, per_method: int, key: Column) -> DataFrame:
    """Union of the ids of both stratified samples."""
    rows = df.select(ident, category, method, key.alias("_key"))
    pick = lambda by, n: stratified(rows, [by], n, F.col("_key")).select(ident)
    return pick(category, per_category).unionByName(pick(method, per_method)).distinct()


def shuffled(df: DataFrame, ident: Column, seed: int, round_: int = 0) -> DataFrame:
    """Deterministic order by hash; the same seed and round give the same order on any cluster."""
    return df.orderBy(_shuffle_key(ident, seed, round_), ident)


def _shuffle_key(ident: Column, seed: int, round_: int = 0) -> Column:
    return F.md5(F.concat(F.lit(f"{seed + round_}:"), ident.cast("string")).cast("binary"))


def shuffle_places(df: DataFrame, ident: str, seed: int, name: str = "place", round_: int = 0) -> DataFrame:
    """The 0-based place of each row in that order; ids are unique. No task sorts all rows."""
    return rank(df.withColumn("_key", _shuffle_key(F.col(ident), seed, round_)), [], ["_key", ident], name).drop("_key")


def weighted_draws(df: DataFrame, ident: str, source: str, power: float, draws: int, seed: int) -> DataFrame:
    """(draw, ident): ``draws`` rows with replacement, weight (1 / count of the source) ** power.

    First each draw picks a source by the cumulative shares, of which there are few, then a place in
    it; the place is met by rank. No draw looks at all rows.
    """
    ranked = rank(df.select(ident, source), [source], [ident], "_i")
    shares = expected_ratio(df, source, power)
    upto = Window.orderBy(source).rowsBetween(Window.unboundedPreceding, 0)
    cum = shares.withColumn("_hi", F.sum("ratio").over(upto)).withColumn("_lo", F.col("_hi") - F.col("ratio"))
    unit = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{salt}:"), F.col("draw").cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    table = cum.agg(F.array_sort(F.collect_list(F.struct("_hi", "_lo", "n", F.col(source).alias("s")))).alias("_t"))
    picks = df.sparkSession.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(table)).withColumn("_u", unit(1))
    chosen = F.coalesce(F.get(F.filter("_t", lambda x: F.col("_u") < x["_hi"]), 0), F.element_at("_t", -1))
    picks = picks.withColumn("_c", chosen).select("draw", F.col("_c.s").alias(source), F.floor(unit(2) * F.col("_c.n")).alias("_i"))
    return picks.join(ranked, [source, "_i"]).select("draw", ident, source)
