"""Mixing sources to target weights.

Aggregate word counts per source, derive repetition rates, then emit each document floor(rate)
times plus one hash-seeded Bernoulli copy with probability equal to the fraction.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; rows with
equal ids share their draw; a null id draws as the text "null". A source of size 0 has target 0 and
rate 0. A very long text is counted in its row. An empty table gives an empty result. Columns of the
input keep their names; if one is named like a column of the plan (case aside), the plan's gets
underscores before its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, materialise, numbered, renamed, small_side

WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float, cap: float, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source_null, source_name, source_size) -> the same and target.

    Water filling in closed form: in order of cap over weight, a source is full while its ratio is
    below the level that the rest would get. The windows run over one row for each source in one
    task: sources may be many thousands, but this is no operator for a source a row.
    """
    order = Window.orderBy("source_null", "source_name")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    named = sizes.withColumn("w", w.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    total = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), "source_null", "source_name").rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        named.withColumn("all_w", F.sum("w").over(total))
        .withColumn("all_size", F.sum("source_size").over(total) * F.lit(float(share)))
        .withColumn("full_cap", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("full_w", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("all_size") - F.col("full_cap")) / (F.col("all_w") - F.col("full_w")))
        .withColumn("full", F.col("cap") / F.col("w") <= F.col("level"))
        .withColumn("rest", F.col("all_size") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(total))
        .withColumn("rest_w", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(total))
    )
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * F.try_divide("rest", "rest_w"))
    return levels.select("source_null", "source_name", "source_size", target.alias("target"))


def draw(ident: Column, seed: int) -> Column:
    """A number in [0, 1) from the id and the seed: the first 52 bits of an MD5."""
    hexed = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("null")))), 1, 13)
    return F.conv(hexed, 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_plan(docs: DataFrame, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, cap: float = 2.0, seed: int = 8, spool: bool = True) -> DataFrame:
    """Each row's ``carry`` columns (all by default) with mix_size, mix_source_size, mix_target and mix_copies.

    Sizes aggregate map-side. The source table, one row for each source, is written and measured: it
    is broadcast if it is small, so that no row moves; else the join is a plain one, in which AQE
    splits a hot source. ``spool``: write the sized rows once, as they are read twice; worth it
    where ``carry`` is narrow.
    """
    names = docs.columns if carry is None else carry
    rows, at = numbered(docs, "mi_in_")
    kept = range(len(names)) if carry is None else [int(at(c).removeprefix("mi_in_")) for c in carry]
    held = [f"mi_in_{k}" for k in kept]
    sized = rows.select(*held, F.col(at(id_col)).alias("mi_id"), F.col(at(source_col)).isNull().alias("source_null"), F.coalesce(F.col(at(source_col)), F.lit("")).alias("source_name"), word_count(F.col(at(text_col))).alias("mi_size"))
    if spool:
        sized = materialise(sized, "mix-sizes")
    sizes = sized.groupBy("source_null", "source_name").agg(F.sum("mi_size").alias("source_size"))
    rates = targets(sizes, share, cap).withColumn("rate", F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0)))
    joined = sized.join(small_side(rates, "mix-rates", ["source_name"]), ["source_null", "source_name"])
    whole = F.floor("rate")
    copies = whole + F.when(draw(F.col("mi_id"), seed) < F.col("rate") - whole, 1).otherwise(0)
    out = {"mix_size": F.col("mi_size"), "mix_source_size": F.col("source_size"), "mix_target": F.col("target"), "mix_copies": copies.cast("long")}
    return joined.select(*[F.col(h).alias(n) for h, n in zip(held, names)], *[c.alias(fresh(k, names)) for k, c in out.items()])


def mix(docs: DataFrame, **params) -> DataFrame:
    """The documents of the mix: every row as often as it is taken, in the input's columns."""
    names = docs.columns
    plan = mix_plan(docs, **{"spool": False} | params)
    # By place: names of the input may repeat when case is set aside.
    taken = plan.toDF(*[f"mi_{k}" for k in range(len(names))], "mi_size", "mi_source", "mi_target", "mi_copies")
    taken = taken.where("mi_copies > 0").withColumn("mi_copy", F.explode(F.sequence(F.lit(1), F.col("mi_copies").cast("int"))))
    return taken.select(*renamed("mi_", names))
