"""Many runs of the same samples: candidates, the latest judgement, history, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions import patterns as P
from ..functions import text as X


def latest(df: DataFrame, key: str | Sequence[str], judged: Column, order: Sequence[Column]) -> DataFrame:
    """The judged row of each key that is largest in ``order``, by one aggregate with map-side combine."""
    keys = [key] if isinstance(key, str) else list(key)
    row = F.struct(*[F.col(c) for c in df.columns])
    best = df.where(judged).groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def history(df: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """All versions of each key in order, and how many."""
    items = F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order])))
    return df.groupBy(key).agg(items.alias("history")).withColumn("history_count", F.size("history").cast("long"))


def _at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _typed(v: Column, path: str, kind: str, cast: str) -> Column:
    return X.let(F.try_variant_get(v, f"$.{path}", "variant"), lambda got: F.when(J.kind(got) == kind, F.try_variant_get(got, "$", cast)))


def rewrite_text(v: Column) -> Column:
    found = X.first_filled(*[_typed(v, f"rewrite.{k}", "STRING", "string") for k in (*P.REWRITE_KEYS, "raw_output")])
    return F.coalesce(X.rewritten(found), F.lit(""))


def facts(v: Column, merged: bool = False) -> dict[str, Column]:
    """What judgements are made from, as columns: each is read from the document once."""
    section = lambda k: F.coalesce(J.kind(F.try_variant_get(v, f"$.{k}", "variant")) == "OBJECT", F.lit(False))
    return {
        "_status": X.strip(_at(v, "processing.status")),
        "_stage": F.nullif(X.strip(_at(v, "processing.filter_stage")), F.lit("")),
        "_keep": F.coalesce(_typed(v, "cleaning.keep", "BOOLEAN", "boolean"), _typed(v, "cleaning.parsed.keep", "BOOLEAN", "boolean")),
        "_reason": X.first_filled(_typed(v, "cleaning.reason", "STRING", "string"), _typed(v, "cleaning.parsed.reason", "STRING", "string")),
        "_multi": F.coalesce(_typed(v, "multipoint.multi_point", "BOOLEAN", "boolean"), _typed(v, "multipoint.parsed.multi_point", "BOOLEAN", "boolean")),
        "_category": X.category(_at(v, "classification.category"), merged),
        "_question": rewrite_text(v),
        "_sections": F.array_compact(F.array(*[F.when(section(k), k) for k in ("processing", "cleaning", "multipoint", "classification", "rewrite")])),
    }


def full_judged(categories: Sequence[str] = P.CATEGORIES) -> Column:
    """Over the columns of ``facts``: whether all stages that the outcome needs have spoken."""
    has = lambda k: F.array_contains("_sections", k)
    out = (
        F.when(~has("processing") | ~has("cleaning"), False)
        .when(~F.coalesce(F.col("_status").isin("completed", "filtered_out"), F.lit(False)), False)
        .when(F.col("_keep").isNull() | F.col("_reason").isNull(), False)
        .when(~F.col("_keep"), F.col("_status") == "filtered_out")
        .when(~has("multipoint") | ~has("classification") | ~has("rewrite") | F.col("_multi").isNull(), False)
        .when(F.col("_status") == "filtered_out", (F.col("_stage") == "classification") & F.col("_category").isNull())
        .otherwise(F.col("_category").isin(*categories) & X.rewrite_is_valid(F.col("_question")))
    )
    return F.coalesce(out, F.lit(False))


def legacy_judged(categories: Sequence[str] = P.CATEGORIES) -> Column:
    return F.coalesce((F.col("_status") == "completed") & F.col("_category").isin(*categories) & X.rewrite_is_valid(F.col("_question")), F.lit(False))


def candidates(audits: DataFrame, merged: bool = False) -> DataFrame:
    """(root_name, path, modified, payload variant) -> typed candidates; what isn't an object is left out."""
    v = F.col("payload")
    cats = P.CATEGORIES_MERGED if merged else P.CATEGORIES
    rows = audits.where(J.kind(v) == "OBJECT").withColumn("version_kind", J.version_kind(F.json_object_keys(F.to_json(v)))).withColumns(facts(v, merged))
    rows = rows.withColumn("decision_rank", F.when((F.col("version_kind") == "full_workflow") & full_judged(cats), 2).when((F.col("version_kind") == "legacy_classify_rewrite") & legacy_judged(cats), 1).otherwise(0))
    done = F.coalesce(_at(v, "processing.completed_at"), _at(v, "processing.started_at"))
    source = F.coalesce(_at(v, "processing.source"), _at(v, "record.source"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    ident = X.sample_id(_at(v, "processing.sample_id"), _at(v, "record.id"), source, _at(v, "processing.source_file"), F.coalesce(_at(v, "processing.source_rank"), X.stem(F.col("path"))))
    return rows.select(
        ident.alias("sample_id"), "root_name", "path", "version_kind", "decision_rank", (F.col("decision_rank") > 0).alias("is_judged"), F.coalesce(F.nullif("_status", F.lit("")), F.lit("unknown")).alias("status"),
        F.col("_category").alias("category"), F.col("_stage").alias("filter_stage"), F.col("_question").alias("question"), J.parse_time(done, F.col("modified")).alias("ts"), J.timestamp_iso(done, F.col("modified")).alias("ts_iso"), F.to_json(v).alias("document"),
    )


def with_training_row(df: DataFrame, payload: str = "payload", merged: bool = False) -> DataFrame:
    """Add ``row``: what a model is trained on, or null where there is no valid category, question,
    size or point. Needs sample_id, category and question."""
    from ..functions import geometry as G

    v = F.col(payload)
    size = lambda name, k: F.coalesce(*[X.let(c, lambda n: F.when(n > 0, n)) for c in (J.whole_number(_at(v, f"record.{name}")), J.whole_number(_at(v, f"record.target.image_size[{k}]")))], F.lit(0))
    of = lambda path: J.points(F.try_variant_get(v, f"$.{path}", "variant"))
    label = J.display_label(*[_at(v, p) for p in ("record.ground_truth_label", "cleaning.core_target", "cleaning.parsed.core_target", "record.label", "record.raw_meta.label", "record.raw_meta.raw_meta.label", "record.meta.label")], category=F.col("category"))
    df = df.withColumns({"_w": size("width", 0), "_h": size("height", 1), "_direct": of("record.points_abs"), "_target": of("record.target.points"), "_other": of("record.points"), "_label": label, "_norm": F.lower(X.strip(_at(v, "record.target.point_format"))) == "xy_norm_01"})
    clip = lambda p: F.struct(G.clip_pixel(p["x"], F.col("_w")).alias("x"), G.clip_pixel(p["y"], F.col("_h")).alias("y"))
    scale = lambda p: F.struct(G.norm_to_pixel(p["x"], F.col("_w")).alias("x"), G.norm_to_pixel(p["y"], F.col("_h")).alias("y"))
    target = F.when(F.col("_norm"), F.transform("_target", scale)).otherwise(F.transform("_target", clip))
    df = df.withColumn("_points", F.when(F.size("_direct") > 0, F.transform("_direct", clip)).when(F.size("_target") > 0, target).when(F.size("_other") > 0, F.transform("_other", clip)))
    row = F.struct(
        F.coalesce(_at(v, "record.id"), F.col("sample_id")).alias("id"), F.coalesce(X.strip(_at(v, "record.image_path")), F.lit("")).alias("image"), F.when(F.col("category") == "Counting", "point_count").otherwise("pointing").alias("style"),
        F.col("_label").alias("label"), "question", F.col("_points").alias("points"), F.col("_w").alias("width"), F.col("_h").alias("height"), "category",
    )
    ok = F.col("category").isin(*(P.CATEGORIES_MERGED if merged else P.CATEGORIES)) & X.rewrite_is_valid(F.col("question")) & (F.col("_w") > 0) & (F.col("_h") > 0) & F.col("_points").isNotNull()
    return df.withColumn("row", F.when(F.coalesce(ok, F.lit(False)), row)).drop("_w", "_h", "_direct", "_target", "_other", "_label", "_norm", "_points")


def summarise(audits: DataFrame, merged: bool = False) -> DataFrame:
    """One row for each sample: its latest judgement, whether it can be trained on, its history."""
    found = candidates(audits, merged)
    best = latest(found, "sample_id", F.col("is_judged"), [F.col("decision_rank"), F.col("ts"), F.col("path")])
    rows = with_training_row(best.withColumn("payload", F.try_parse_json("document")), merged=merged)
    rows = rows.withColumn("trainable", F.coalesce(F.col("row").isNotNull() & (F.col("status") == "completed"), F.lit(False)))
    past = history(found, "sample_id", ["ts", "path"], ["root_name", "status", "category", "version_kind", "decision_rank", "is_judged", "filter_stage"])
    return rows.drop("payload", "document").join(past, "sample_id")


def summary_counts(summary: DataFrame) -> DataFrame:
    """(what, key, n): statuses, categories of completed rows, roots, trainable rows."""
    each = F.array(
        F.struct(F.lit("status").alias("what"), F.col("status").alias("key")), F.struct(F.lit("category").alias("what"), F.when(F.col("status") == "completed", F.col("category")).alias("key")),
        F.struct(F.lit("root").alias("what"), F.col("root_name").alias("key")), F.struct(F.lit("trainable").alias("what"), F.col("trainable").cast("string").alias("key")),
    )
    return summary.select(F.inline(each)).where("key is not null").groupBy("what", "key").agg(F.count(F.lit(1)).alias("n"))


def run_tables(roots: dict[str, DataFrame]) -> DataFrame:
    """Several roots as one table tagged with the root's name."""
    out = None
    for name, df in roots.items():
        tagged = df.withColumn("root_name", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
