"""Queries on rules, reasons and validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..operators import metrics as M
from ..operators import rules as R
from ..operators import selection as S
from .registry import bounded, joined, query, table

_REASON = "CASE WHEN n_chars < 100 THEN 'too_short' WHEN n_chars > 8000 THEN 'too_long' WHEN contains(text, 'license') THEN 'license_text' END"


def document_rules():
    return [("too_short", F.col("n_chars") < 100), ("too_long", F.col("n_chars") > 8000), ("license_text", F.contains("text", F.lit("license")))]


@query(f"""
WITH r AS (SELECT doc_id, source, {_REASON} AS reason FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY source, reason IS NULL ORDER BY doc_id) AS n FROM r),
s AS (SELECT source, CASE WHEN reason IS NOT NULL THEN 'rule:' || reason WHEN n <= 20 THEN 'selected' ELSE 'over_quota' END AS status FROM k)
SELECT source, status, count(*) AS n, grouping(source, status) AS level FROM s GROUP BY GROUPING SETS ((source, status), (status), ())""")
def curation_funnel(spark, sf):
    """Documents -> ordered rules -> quota of each source -> status counts with totals."""
    docs = table(spark, sf, "documents").select("doc_id", "source", R.first_reason(document_rules()).alias("reason"))
    marked = S.quota_marks(docs, F.col("reason").isNull(), 20, "source", "doc_id")
    status = F.when(F.col("reason").isNotNull(), F.concat(F.lit("rule:"), "reason")).when(F.col("within_quota"), "selected").otherwise("over_quota")
    return M.status_counts(marked.select("source", status.alias("status")), "source", "status")


@query("""
SELECT doc_id, CASE WHEN n_chars % 4 = 0 THEN 'missing_points_abs' WHEN n_chars % 5 > 1 THEN 'counting_gt_one' WHEN n_chars % 4 > 1 THEN 'points_abs_multi_point'
  WHEN source = 'src3' AND contains(text, ' the ') THEN 'refspatial_multiple_choice' END AS reason FROM documents""")
def local_rule_funnel(spark, sf):
    d = table(spark, sf, "documents")
    rules = R.local_rules((F.col("n_chars") % 4).cast("int"), F.when(F.col("source") == "src3", "refspatial").otherwise(F.col("source")), F.replace("text", F.lit(" the "), F.lit(" (A) ")), (F.col("n_chars") % 5).cast("string"))
    return d.select("doc_id", R.first_reason(rules).alias("reason"))


@query("""
SELECT doc_id, n_chars % 4 <> 0 AS keep, CASE WHEN n_chars % 4 = 0 THEN 'missing_points_abs' END AS rule_filtered,
  CASE WHEN n_chars % 4 = 0 THEN '{"keep":false,"core_target":"","reason":"no points"}' END AS raw_output FROM documents""")
def rule_rejection(spark, sf):
    d = table(spark, sf, "documents").withColumn("r", R.first_reason(R.hosted_rules((F.col("n_chars") % 4).cast("int"), F.col("source"), F.lit(""))))
    d = d.withColumn("cleaning", R.rejected(F.col("r"), F.lit("no points")))
    return d.select("doc_id", F.coalesce("cleaning.keep", F.lit(True)).alias("keep"), F.col("cleaning.rule_filtered").alias("rule_filtered"), F.col("cleaning.raw_output").alias("raw_output"))


@query("""
WITH r AS (SELECT list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'lang:' || lang END, CASE WHEN contains(text, '@') THEN 'contact' END, CASE WHEN contains(text, chr(10)) THEN 'lines' END], lambda x: x IS NOT NULL) AS rs FROM documents)
SELECT reason, count(*) AS n FROM (SELECT unnest(rs) AS reason FROM r) GROUP BY reason""")
def reason_explode_hist(spark, sf):
    d = table(spark, sf, "documents")
    rules = [("short", F.col("n_chars") < 200), F.when(F.col("lang") != "en", F.concat(F.lit("lang:"), "lang")), ("contact", F.contains("text", F.lit("@"))), ("lines", F.contains("text", F.lit("\n")))]
    return M.reason_counts(d, R.all_reasons(rules))


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_LABEL = f"""
CASE WHEN low = '' THEN 'empty_label' WHEN length(low) > 70 THEN 'label_too_long' WHEN regexp_matches(low, '[0-9]') AND len(tok) >= 2 THEN 'numeric_phrase_label'
 WHEN list_has_any(tok, {_sql_list(P.STUFF_WORDS)}) THEN 'stuff_label' WHEN list_has_any(tok, {_sql_list(P.SPATIAL_WORDS)}) THEN 'spatial_label'
 WHEN list_has_any(tok, {_sql_list(P.TEXTLIKE_WORDS)}) THEN 'text_like_label' WHEN list_has_any(tok, {_sql_list(P.ARTIFACT_WORDS)}) THEN 'appearance_artifact_label'
 WHEN list_contains({_sql_list(P.BAD_HEAD_WORDS)}, tok[-1]) THEN 'generic_head_noun' WHEN len(tok) > 4 THEN 'too_many_tokens'
 WHEN len(tok) = 1 AND list_contains({_sql_list(P.ATTRIBUTE_WORDS)}, tok[-1]) THEN 'attribute_only_label' WHEN len(tok) = 1 AND list_contains({_sql_list(P.ABSTRACT_WORDS)}, tok[-1]) THEN 'abstract_category_label'
 WHEN len(tok) >= 2 AND list_has_any(tok, {_sql_list(P.FUNCTIONAL_WORDS)}) THEN 'functional_phrase' WHEN len(tok) >= 3 AND list_has_any(tok, {_sql_list(P.RELATIONAL_WORDS)}) THEN 'relational_phrase' END"""
_NAMES = "SELECT p_partkey, p_name, lower(p_name) AS low, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS tok FROM part"


@query(f"WITH t AS ({_NAMES}) SELECT coalesce({_LABEL}, 'keep') AS value, count(*) AS n FROM t GROUP BY 1")
def drop_reason_hist(spark, sf):
    return M.histogram(table(spark, sf, "part"), F.coalesce(R.label_reason(F.col("p_name")), F.lit("keep")))


@query(f"WITH t AS ({_NAMES}) SELECT p_partkey, {_LABEL} AS reason FROM t")
def label_gate(spark, sf):
    return table(spark, sf, "part").select("p_partkey", R.label_reason(F.col("p_name")).alias("reason"))


@query("""
SELECT grp AS "group", pos, array_to_string(reasons, ',') AS reasons FROM (VALUES
 ('straight_axis_templates', 0, []::VARCHAR[]), ('straight_axis_templates', 1, ['duplicate']), ('straight_axis_templates', 2, ['missing_direction_placeholder', 'ui_specific']), ('straight_axis_templates', 3, ['empty']),
 ('two_step_axis_templates', 0, []), ('two_step_axis_templates', 1, ['missing_required_placeholder:{second_axis}', 'missing_then_step_order']),
 ('nearest_among_objects_templates', 0, []), ('nearest_among_objects_templates', 1, ['missing_nearest_word', 'missing_blue_point_reference']), ('other_templates', 0, ['guide_wording'])) t(grp, pos, reasons)""")
def template_filter(spark, sf):
    rows = [
        ("straight_axis_templates", 0, "Go {axis_direction} from the point to the {label}."), ("straight_axis_templates", 1, " Go {axis_direction} from the point to the {label}. "), ("straight_axis_templates", 2, "Click the {label}."), ("straight_axis_templates", 3, "  "),
        ("two_step_axis_templates", 0, "Go {first_axis}, then {second_axis} to the {label}."), ("two_step_axis_templates", 1, "Go {first_axis} to the {label}."),
        ("nearest_among_objects_templates", 0, "Point to the {label} nearest to the blue point."), ("nearest_among_objects_templates", 1, "Point to the {label}."), ("other_templates", 0, "A guide to the {label}."),
    ]
    return R.filter_templates(spark.createDataFrame(rows, "group string, pos int, text string")).select("group", "pos", joined("reasons").alias("reasons"))


@query(f"SELECT d.doc_id, b.item_id IS NOT NULL OR starts_with(lower('benchmark_' || d.lang), 'benchmark_fr') AS held_out FROM documents d LEFT JOIN (SELECT text, min(item_id) AS item_id FROM benchmark GROUP BY text) b ON d.text = b.text")
def leakage_guard(spark, sf):
    """Documents that equal a benchmark passage, or whose id marks them as part of the benchmark."""
    bench = table(spark, sf, "benchmark").select(S.digest(F.col("text")).alias("key")).distinct().withColumn("hit", F.lit(True))
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", S.digest(F.col("text")).alias("key")).join(bench, "key", "left")
    ident = F.when(F.col("lang") == "fr", F.concat(F.lit(" Benchmark_"), F.col("lang"))).otherwise(F.col("lang"))
    return d.select("doc_id", (F.coalesce("hit", F.lit(False)) | R.evaluation_row(ident, [F.col("source")], [F.col("lang")])).alias("held_out"))


@query("SELECT doc_id, doc_id % 3 = 0 AND doc_id % 5 <> 0 AND n_chars % 4 = 1 AND lang <> 'de' AS eligible FROM documents")
def eligibility(spark, sf):
    d = table(spark, sf, "documents")
    e = R.eligible(F.when(F.col("doc_id") % 3 == 0, "completed"), F.col("doc_id") % 5 != 0, F.lit(True), F.col("lang") == "de", F.lit(True), F.col("n_chars") % 4, "single")
    return d.select("doc_id", e.alias("eligible"))


@query("""
SELECT doc_id, CASE WHEN lang = 'fr' AND n_chars > 1000 THEN 'filtered_out' WHEN n_chars > 1000 THEN 'completed' ELSE 'skipped' END AS status,
  CASE WHEN lang = 'fr' AND n_chars > 1000 THEN 'category_filter_spatial_relation_removed' END AS stage FROM documents""")
def category_filter(spark, sf):
    d = table(spark, sf, "documents")
    cat = F.when(F.col("lang") == "fr", "Spatial Relation").otherwise("Counting")
    status, stage = R.drop_category(F.when(F.col("n_chars") > 1000, "completed").otherwise("skipped"), cat, F.lit(None).cast("string"))
    return d.select("doc_id", status.alias("status"), stage.alias("stage"))


@query("""
WITH p AS (SELECT vec_id, (embedding[1]::DOUBLE + 1) / 2 AS x, embedding[2]::DOUBLE AS y, label FROM embeddings)
SELECT vec_id, array_to_string(list_filter([CASE WHEN label = 0 THEN 'bad_query' END, CASE WHEN 100 + label * 20 < 224 THEN 'image_too_small' END, CASE WHEN NOT (x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1) THEN 'point_out_of_range' END], lambda r: r IS NOT NULL), ',') AS reasons FROM p""")
def image_rule_pack(spark, sf):
    e = table(spark, sf, "embeddings")
    pt = F.struct(((F.get("embedding", 0).cast("double") + 1) / 2).alias("x"), F.get("embedding", 1).cast("double").alias("y"))
    q = F.when(F.col("label") == 0, " N/A ").otherwise("find it")
    return e.select("vec_id", joined(R.all_reasons(R.image_rules(q, F.lit(500), 100 + F.col("label") * 20, F.array(pt)))).alias("reasons"))


@query(f"""
SELECT doc_id, regexp_matches(lower(text), '{bounded("then|for")}') AS affordance, regexp_matches(lower(text), '{bounded("all|each")}') AS multi_instance,
  regexp_matches(lower(text), '{bounded("then|for")}') AND NOT regexp_matches(lower(text), '{bounded("all|each")}') AS candidate FROM documents""")
def cue_flags(spark, sf):
    """Cue families with a pack of words that the documents hold."""
    low = F.lower("text")
    a, m = X.any_of(low, [bounded("then|for")]), X.any_of(low, [bounded("all|each")])
    return table(spark, sf, "documents").select("doc_id", a.alias("affordance"), m.alias("multi_instance"), (a & ~m).alias("candidate"))


@query("""
WITH q(id, query, target, predicted, expected) AS (VALUES
 (1, 'Point to where the existing point is', 'cup', 'Affordance', 'Object Reference'), (2, 'the book about cats', 'book', 'Object Reference', 'Reasoning'), (3, 'something used to cut', 'knife', 'None', 'Affordance'),
 (4, 'the red cup', 'cup', 'Counting', 'Counting'), (5, 'tool to hold', '', 'Affordance', 'Affordance'), (6, 'the legs holding up the table', 'legs', 'Affordance', 'Reasoning'), (7, 'the red cup', 'cup', 'Affordance', 'Object Reference'))
SELECT id, expected AS refined FROM q""")
def category_refinement(spark, sf):
    rows = [
        (1, "Point to where the existing point is", "cup", "Affordance"), (2, "the book about cats", "book", "Object Reference"), (3, "something used to cut", "knife", None), (4, "the red cup", "cup", "Counting"),
        (5, "tool to hold", "", "Affordance"), (6, "the legs holding up the table", "legs", "Affordance"), (7, "the red cup", "cup", "Affordance"),
    ]
    df = spark.createDataFrame(rows, "id int, query string, target string, predicted string")
    return df.select("id", X.refine_category(F.col("query"), F.col("target"), F.col("predicted")).alias("refined"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'missing_query,missing_points,missing_split' END AS reasons FROM documents""")
def record_validation(spark, sf):
    good = '{"id": "x", "source": "s", "task_type": "t", "image_path": "a.jpg", "query": "Point to it", "target": {"type": "point", "points": [[12.0, 34.0]], "point_format": "xy_abs_pixels", "image_size": [100, 80]}, "meta": {"split": "train"}}'
    bad = good.replace("Point to it", " ").replace("[[12.0, 34.0]]", "[]").replace('"split": "train"', "")
    return table(spark, sf, "documents").select("doc_id", joined(R.record_reasons(F.try_parse_json(F.when(F.col("doc_id") % 2 == 0, good).otherwise(bad)))).alias("reasons"))


@query("SELECT event_id, event_id % 3 = 0 AS accepted FROM events")
def acceptance(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", R.accepted(F.when(F.col("event_id") % 3 == 0, '{"pass": true}').when(F.col("event_id") % 3 == 1, '{"pass": false}')).alias("accepted"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 AND lang <> 'fr' THEN lang END AS category FROM documents")
def completed_category(spark, sf):
    d = table(spark, sf, "documents")
    reasons = F.array_compact(F.array(F.when(F.col("doc_id") % 2 != 0, "bad")))
    return d.select("doc_id", R.completed_category(reasons, F.when(F.col("doc_id") % 3 == 0, "completed"), F.when(F.col("lang") == "fr", " ").otherwise(F.col("lang"))).alias("category"))


@query("SELECT name AS module_name, branch FROM (VALUES ('model.vision_backbone.image_vit.0.wq', 'vision'), ('model.vision_backbone.image_projector.w1', 'projector'), ('model.transformer.blocks.0.att_proj', 'llm')) t(name, branch)")
def adapter_scope(spark, sf):
    names = ["model.vision_backbone.image_vit.0.wq", "model.vision_backbone.image_projector.w1", "model.transformer.blocks.0.att_proj", "model.transformer.blocks.0.norm", "lm_head.wq"]
    return R.adapter_targets(spark.createDataFrame([(n,) for n in names], "module_name string")).select("module_name", "branch")


@query("""SELECT style AS value, count(*) AS n FROM (SELECT CASE WHEN n_chars % 3 = 0 THEN 'two_step_axis_move' WHEN n_chars % 3 = 1 THEN 'nearest_or_closest' ELSE 'not_anchor_or_unclear' END AS style FROM documents) GROUP BY style""")
def style_histogram(spark, sf):
    k = F.col("n_chars") % 3
    q = F.when(k == 0, "go left then up").when(k == 1, "the closest cup").otherwise("the cup")
    return M.histogram(table(spark, sf, "documents"), X.styles(q)[1])
