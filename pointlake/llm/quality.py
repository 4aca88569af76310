"""Quality rules: thresholds from mergeable quantile sketches for each language and source.

Built-in functions only. A sketch is a histogram over integer buckets that keep three significant
digits (relative error below 1 %), so sketches merge by adding counts, in any order and with the
same result, and aggregate map-side. Each group's quartiles are averaged with those of the merged
sketch of all documents, which weighs as much as PRIOR rows, so small groups lean on the whole.

Edge cases: a null text has no words and fails the base rule; null languages and sources are groups
of their own; a document without words has all ratios 0; ties at a fence are kept; repeated rows
get the same verdict. A very long text is measured in its row, whole, with arrays of its words and
windows. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, bucket, fresh, materialise, numbered, small_side

#: Of each measure: the least distance of the upper fence above the median, and of the lower below.
FENCES = {"mean_word": (60, 15), "symbols": (100, None), "dup_lines": (300, None), "repeats": (150, None)}
#: How many distances between the quartiles the fences stand beyond them.
REACH = 4
#: Rows that the quartiles of the whole weigh against a group's own.
PRIOR = 200


def base_measures(docs: DataFrame, text_col: str, prefix: str = "q_") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, each under ``prefix``.

    Everything stays within the row: no shuffle. Five-word windows are hashed to 64 bits; only rows
    in which a hash occurs twice (array_distinct finds them in linear time) sort theirs to find
    which words the repeated windows cover.
    """
    names = docs.columns
    w, h, s = (fresh(prefix + x, names) for x in ("words", "hashes", "sorted"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.split(F.btrim(text, F.lit("\t\n\x0b\f\r ")), SPACE, -1)
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit("\t\n\x0b\f\r "))) > 0)
    n = F.when(F.element_at(w, 1) == "", 0).otherwise(F.size(w))
    windows = F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))).otherwise(F.array().cast("array<bigint>"))
    first = (
        docs.withColumn(w, words)
        .withColumn(h, windows)
        .withColumns({
            prefix + "n_words": n.cast("long"),
            prefix + "word_chars": F.length(F.array_join(w, "")).cast("long"),
            prefix + "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
            prefix + "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        })
    )
    pairs = F.when(F.size(h) > F.size(F.array_distinct(h)), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))))
    second = first.withColumn(s, pairs).drop(w, h)
    col = F.col(s)
    twice = F.filter(col, lambda x, i: ((i > 0) & (F.get(col, i - 1)["h"] == x["h"])) | (F.coalesce(F.get(col, i + 1)["h"] == x["h"], F.lit(False))))
    at = F.array_sort(F.transform(twice, lambda x: x["p"]))
    gaps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(F.lit(5), F.coalesce(b - a, F.lit(5))))
    covered = F.when(col.isNull(), 0).otherwise(F.aggregate(gaps, F.lit(0), lambda t, x: t + x))
    return second.withColumn(prefix + "n_repeat_words", covered.cast("long")).drop(s)


def measures(prefix: str = "q_") -> dict[str, Column]:
    """The ratios that have adaptive thresholds: tenths of characters a word, and thousandths."""
    c = lambda x: F.col(prefix + x)
    ratio = lambda a, b: F.coalesce(F.floor(F.try_divide(a, b)), F.lit(0)).cast("long")
    return {
        "mean_word": ratio(c("word_chars") * 10, c("n_words")),
        "symbols": ratio(c("n_symbols") * 1000, c("word_chars")),
        "dup_lines": ratio(c("n_dup_lines") * 1000, c("n_lines")),
        "repeats": ratio(c("n_repeat_words") * 1000, c("n_words")),
    }


def sketches(rows: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """(by, measure, bucket, n): one pass, counted map-side."""
    each = F.array(*[F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket")) for k, v in values.items()])
    return rows.select(*by, F.inline(each)).groupBy(*by, "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by, measure) -> n, q1, q2, q3: the least buckets with a quarter, a half, three quarters of the rows below or in them."""
    over = Window.partitionBy(*by, "measure")
    upto = over.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(over))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("bucket")))
    return ranked.groupBy(*by, "measure").agg(F.max("all").alias("n"), *[at(k).alias(f"q{k}") for k in (1, 2, 3)])


def fences(sketch: DataFrame, by: list[str], reach: int = REACH, prior: int = PRIOR) -> DataFrame:
    """One row for each group: hi_<measure> and lo_<measure>.

    A group's quartiles are averaged with those of the merged sketch of all groups, which weighs
    ``prior`` rows. Integers throughout, so that reruns agree.
    """
    merged = sketch.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    whole = quartiles(merged, []).select("measure", *[F.col(f"q{k}").alias(f"all{k}") for k in (1, 2, 3)])
    blend = {f"q{k}": F.expr(f"(n * q{k} + {prior} * all{k}) div (n + {prior})") for k in (1, 2, 3)}
    # One row for each measure: its size has a fixed bound.
    quart = quartiles(sketch, by).join(F.broadcast(whole), "measure").withColumns(blend)
    spread = F.lit(reach) * (F.col("q3") - F.col("q1"))
    out = []
    for m, (up, down) in FENCES.items():
        here = F.col("measure") == m
        out.append(F.max(F.when(here, F.greatest(F.col("q3") + spread, F.col("q2") + up))).alias(f"hi_{m}"))
        if down is not None:
            out.append(F.max(F.when(here, F.least(F.col("q1") - spread, F.col("q2") - down))).alias(f"lo_{m}"))
    return quart.groupBy(*by).agg(*out)


def quality_verdicts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all by default) with the base measures q_*, q_base_failed and q_kept. If a carried
    column has such a name (case aside), underscores come before the name of the operator's column.

    The measures are materialised once, as both the sketches and the filter need them. The join
    with the fences, one row for each language and source, broadcasts them if they are small when
    measured; if not it is a plain join, in which AQE splits a hot source.
    """
    table, at = numbered(docs, "qi_in_")
    spare = [f"qi_in_{k}" for k in range(len(docs.columns))] if carry is None else [at(c) for c in carry]
    carry = docs.columns if carry is None else carry
    rows = table.select(*[F.col(v).alias(f"qi_{k}") for k, v in enumerate(spare)], F.col(at(text_col)).alias("qi_text"), F.col(at(lang_col)).alias("qi_lang"), F.col(at(source_col)).alias("qi_source"))
    rows = rows.withColumns({g: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for g, c in (("g_lang", "qi_lang"), ("g_source", "qi_source"))})
    lines = F.filter(F.split(F.coalesce("qi_text", F.lit("")), "\n", -1), lambda x: F.length(F.btrim(x, F.lit("\t\n\x0b\f\r "))) > 0)
    measured = base_measures(rows, "qi_text").withColumn("q_n_lines", F.size(lines).cast("long")).drop("qi_text", "qi_lang", "qi_source")
    measured = materialise(measured, "quality")
    limits = fences(sketches(measured, ["g_lang", "g_source"], measures()), ["g_lang", "g_source"])
    limits = limits.withColumnsRenamed({"g_lang": "f_lang", "g_source": "f_source"})
    limits = small_side(limits, "quality-fences", ["f_lang", "f_source"])
    joined = measured.join(limits, (F.col("g_lang") == F.col("f_lang")) & (F.col("g_source") == F.col("f_source")))
    failed = (F.col("q_n_words") < 10) | (F.col("q_n_repeat_words") * 100 > F.col("q_n_words") * 20)
    fits = F.lit(True)
    for m, v in measures().items():
        fits = fits & (v <= F.col(f"hi_{m}"))
        if FENCES[m][1] is not None:
            fits = fits & (v >= F.col(f"lo_{m}"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = {f"q_{b}": F.col(f"q_{b}") for b in base} | {"q_base_failed": failed, "q_kept": ~failed & fits}
    return joined.select(*[F.col(f"qi_{k}").alias(c) for k, c in enumerate(carry)], *[v.alias(fresh(k, carry)) for k, v in out.items()])
