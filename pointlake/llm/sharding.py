"""Sharding by proportional stratified interleaving.

Rank seeded-shuffled rows within each source, sort by fractional rank, and cut into shards of equal
row counts: every stretch of the order, and so every shard, has the mixture of the whole.

Edge cases: a null text has 0 bytes; a null source is a source of its own; null ids and repeated
rows are ordered by what else they hold, and fully equal rows are interchangeable. Fewer rows than
shards leave the last shards with fewer rows. Of a very long text only its length and checksum move.
Carried columns keep their names; if one is named like a column of the plan (case aside), the plan's
gets underscores before its name. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialise, numbered

#: Buckets whose running sum one task forms.
SPAN = 4096


def _bucketed_rank(rows: DataFrame, by: list[str], bucket: str, order: list[str], out: str, n: str | None = None) -> DataFrame:
    """0-based rank of each row within ``by`` by (bucket, order), without a task per ``by``.

    Counts for each bucket aggregate map-side; their running sums give the offsets: over spans of
    SPAN buckets in one task (rows / 8,000,000 of them), and within spans. Only rows of one bucket,
    whose number has a bound in expectation, are ranked together. ``n``: column for the number of
    rows of ``by``.
    """
    counts = rows.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("rk_n")).withColumn("rk_top", F.floor(F.col(bucket) / SPAN))
    # Running sums on two levels: of spans of buckets, then within each span.
    tops = counts.groupBy(*by, "rk_top").agg(F.sum("rk_n").alias("rk_m"))
    over = Window.partitionBy(*by)
    before = lambda w, order: w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("rk_from", F.coalesce(F.sum("rk_m").over(before(over, "rk_top")), F.lit(0)))
    if n:
        tops = tops.withColumn(n, F.sum("rk_m").over(over))
    inside = F.coalesce(F.sum("rk_n").over(before(Window.partitionBy(*by, "rk_top"), bucket)), F.lit(0))
    offsets = counts.withColumn("rk_in", inside).join(tops.drop("rk_m"), [*by, "rk_top"])
    offsets = offsets.withColumn("rk_at", F.col("rk_in") + F.col("rk_from")).drop("rk_n", "rk_top", "rk_in", "rk_from")
    placed = rows.join(offsets, [*by, bucket])
    inner = Window.partitionBy(*by, bucket).orderBy(*order)
    return placed.withColumn(out, F.col("rk_at") + F.row_number().over(inner) - 1).drop("rk_at", bucket)


def shard_plan(docs: DataFrame, shards: int = 8, carry: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, bucket_rows: int = 2000) -> DataFrame:
    """``carry`` columns with sh_size, sh_crc32, sh_shard and sh_slot. No text is shuffled
    unless ``carry`` names it.

    Both orders (within each source, then of the whole) are ranked by buckets of about
    ``bucket_rows`` rows (a quarter of that within sources), so a source with a third of all rows
    is spread over many tasks.
    """
    carry = [id_col] if carry is None else carry
    table, at = numbered(docs, "sh_in_")
    text = F.coalesce(F.col(at(text_col)), F.lit(""))
    rows = table.select(
        *[F.col(at(c)).alias(f"sh_out_{k}") for k, c in enumerate(carry)],
        F.col(at(id_col)).alias("sh_id"),
        F.col(at(source_col)).isNull().alias("sh_null"),
        F.coalesce(F.col(at(source_col)), F.lit("")).alias("sh_source"),
        (F.octet_length(text) + 1).cast("long").alias("sh_size"),
        F.crc32(text.cast("binary")).alias("sh_crc32"),
    ).withColumn("sh_key", F.xxhash64(F.lit(seed), "sh_id", "sh_crc32"))
    if text_col not in carry:  # read several times, and much narrower than the texts
        rows = materialise(rows, "shard-rows")
    total = rows.count()
    buckets = max(1, -(-total // bucket_rows))
    rows = rows.withColumn("sh_bucket", F.floor(F.shiftrightunsigned("sh_key", 11) * F.lit(4 * buckets / float(1 << 53))))
    order = ["sh_key", F.col("sh_id").asc_nulls_last(), "sh_crc32", "sh_size"]
    ranked = _bucketed_rank(rows, ["sh_null", "sh_source"], "sh_bucket", order, "sh_rank", "sh_n")
    placed = ranked.withColumn("sh_frac", (F.col("sh_rank") + 0.5) / F.col("sh_n")).withColumn("sh_one", F.lit(0)).withColumn("sh_bucket", F.floor(F.col("sh_frac") * buckets))
    whole = _bucketed_rank(placed, ["sh_one"], "sh_bucket", ["sh_frac", "sh_null", "sh_source", "sh_rank"], "sh_at")
    # Shard s holds the places from ceil(s * total / shards) on.
    shard = F.expr(f"(sh_at * {shards}) div {max(1, total)}")
    start = F.expr(f"((sh_at * {shards}) div {max(1, total)} * {total} + {shards - 1}) div {shards}")
    out = {"sh_size": F.col("sh_size"), "sh_crc32": F.col("sh_crc32"), "sh_shard": shard.cast("int"), "sh_slot": (F.col("sh_at") - start).cast("long")}
    return whole.select(*[F.col(f"sh_out_{k}").alias(c) for k, c in enumerate(carry)], *[v.alias(fresh(k, carry)) for k, v in out.items()])
