"""Structured Streaming: counters that resume, latest versions, early stop, windows with late data."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_of(spark: SparkSession, path: str, schema=None, files_per_trigger: int = 1) -> DataFrame:
    """A folder of parquet, or one file of it, as a stream; event time is cast to a zoned timestamp."""
    schema = schema or spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    df = reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else reader.parquet(path)
    zoned = {f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"}
    return df.withColumns(zoned) if zoned else df


def run_once(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Process what there is, then stop; the checkpoint lets a later call go on from there."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def merged_table(spark: SparkSession, path: str, keys: Sequence[str], version: str) -> Callable[[DataFrame, int], None]:
    """A sink that appends each batch's rows with their batch number. A batch that is written again
    after a failure replaces itself."""

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/batch={n:08d}")

    return write


def current(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The newest row of each key in a table made by ``merged_table``."""
    df = spark.read.parquet(path)
    row = F.struct(*[c for c in df.columns if c != "batch"])
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order, F.col("batch"))).alias("_r")).select("_r.*")


def counts(spark: SparkSession, source: DataFrame, keys: Sequence[str], work: str) -> DataFrame:
    """Incremental counts by key: state in the checkpoint, each batch's changes merged."""
    agg = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    run_once(agg, f"{work}/checkpoint", merged_table(spark, f"{work}/table", keys, "n"))
    return current(spark, f"{work}/table", keys, [F.col("n")])


def latest(spark: SparkSession, source: DataFrame, key: str, order: Sequence[str], work: str) -> DataFrame:
    """The latest row of each key, kept up to date by stateful aggregation."""
    row = F.struct(*source.columns)
    agg = source.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("_r")).select("_r.*")
    run_once(agg, f"{work}/checkpoint", merged_table(spark, f"{work}/table", [key], order[0]))
    return current(spark, f"{work}/table", [key], [F.col(c) for c in order])


def windowed(source: DataFrame, ts: str, keys: Sequence[str], length: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling or sliding counts with a watermark for late rows."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return source.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def until_reached(spark: SparkSession, source: DataFrame, key: str, targets: Mapping[str, int], work: str) -> DataFrame:
    """Counts that stop the stream once every target is reached. Stops between batches, so counts may
    go beyond the targets by what the last batch held."""
    agg = source.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    write = merged_table(spark, f"{work}/table", [key], "n")
    done: list[bool] = []

    def each(batch: DataFrame, n: int) -> None:
        if done:
            return
        write(batch, n)
        have = {r[key]: r["n"] for r in current(spark, f"{work}/table", [key], [F.col("n")]).where(F.col(key).isin(*targets)).collect()}
        if all(have.get(k, 0) >= v for k, v in targets.items()):
            done.append(True)

    query = agg.writeStream.outputMode("update").option("checkpointLocation", f"{work}/checkpoint").foreachBatch(each).trigger(processingTime="0 seconds").start()
    while query.isActive and not done:
        before = (query.lastProgress or {}).get("batchId") if query.lastProgress else None
        query.processAllAvailable()
        if ((query.lastProgress or {}).get("batchId") if query.lastProgress else None) == before:
            break
    query.stop()
    return current(spark, f"{work}/table", [key], [F.col("n")])
