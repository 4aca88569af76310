"""Line dedup: explode normalised lines, hash, count distinct documents per hash, drop, reassemble.

Edge cases: a null or empty text is one empty line. Rows that share an id are one document for
counting; each row is returned. Ids are of an integer type; null ids are one document that sorts
after all others. Keys shorter than ``min_chars`` are never dropped. A very long text is one row
throughout, its lines rows of a few numbers. All columns of the input pass through, whatever their
names; if one is named like a count (case aside), the count's name gets underscores before it. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, SPACE_CHARS, fresh, lower_ascii, materialise, numbered, renamed


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """Drop every line whose key is in ``min_docs`` documents or more, save in the smallest id.

    Only (row, position, 128-bit hash) is kept and shuffled to find the lines; the text moves once, to meet
    its list of dropped positions. The hash table aggregates map-side, so a line that a third of
    all documents share is one row for each map task; the join back is a plain sort-merge join,
    which AQE splits when one hash is hot.
    """
    names = docs.columns
    rows, at = numbered(docs, "ld_in_")
    body = at(text_col)
    text = F.coalesce(F.col(body).cast("string"), F.lit(""))
    ident = F.coalesce(F.col(at(id_col)).cast("long"), F.lit(NULL_ID))
    row = (ident.alias("i"), F.xxhash64(text).alias("th"))

    key = F.btrim(F.col("line"), F.lit(SPACE_CHARS))
    hashed = (
        rows.select(*row, F.posexplode(F.split(lower_ascii(text), "\n", -1)).alias("pos", "line"))
        .select("i", "th", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select("i", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    # Read twice, and much narrower than the texts.
    hashed = materialise(hashed, "lines")
    found = [F.min("i").alias("least"), F.max("i").alias("most")] + ([F.count_distinct("i").alias("n")] if min_docs > 2 else [])
    shared = hashed.groupBy("h1", "h2").agg(*found).where("least < most")
    if min_docs > 2:
        shared = shared.where(F.col("n") >= min_docs)
    # xor 0 hides the aggregate's partitioning: both sides of the join then have an exchange of
    # their own, which is what lets AQE split a hot hash.
    shared = shared.select(F.col("h1").bitwiseXOR(F.lit(0)).alias("h1"), F.col("h2").bitwiseXOR(F.lit(0)).alias("h2"), "least")
    dropped = hashed.join(shared, ["h1", "h2"]).where("i != least").groupBy("i", "th").agg(F.collect_set("pos").alias("gone"))

    whole = rows.withColumns({"i": ident, "th": F.xxhash64(text)}).join(dropped, ["i", "th"], "left")
    total = F.size("lines")  # used twice below, so that the split is not inlined into the lambda
    keep = F.array_except(F.sequence(F.lit(0), total - 1), F.coalesce("gone", F.array().cast("array<int>")))
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(keep, lambda p: F.get("lines", p)), "\n"))
    out = whole.withColumn("lines", F.split(text, "\n", -1)).withColumns({body: kept, "ld_total": total.cast("long"), "ld_gone": F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")})
    return out.select(*renamed("ld_in_", names), F.col("ld_total").alias(fresh(n_lines, names)), F.col("ld_gone").alias(fresh(n_dropped, names)))
