"""A batch pipeline of stages with a Parquet table between each two, which may start at any stage."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

Stage = tuple[str, Callable[[SparkSession, DataFrame], DataFrame]]


def run_stages(spark: SparkSession, first: DataFrame | None, stages: Sequence[Stage], folder: str, start: str | None = None) -> DataFrame:
    """Run the stages from ``start`` on (all by default), each over the table that the one before wrote."""
    names = [n for n, _ in stages]
    at = names.index(start) if start else 0
    df = first if at == 0 else spark.read.parquet(f"{folder}/{names[at - 1]}")
    if df is None:
        raise ValueError("the first stage needs an input")
    for name, stage in stages[at:]:
        stage(spark, df).write.mode("overwrite").parquet(f"{folder}/{name}")
        df = spark.read.parquet(f"{folder}/{name}")
    return df
