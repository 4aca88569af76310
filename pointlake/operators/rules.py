"""Rule packs: tables of (condition, reason) compiled into one expression, and the packs themselves."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X

Rule = tuple[str, Column]


def first_reason(rules: Sequence[Rule]) -> Column:
    """The first rule that applies, or null: one CASE, short-circuited."""
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in rules])


def all_reasons(rules: Sequence[Rule | Column]) -> Column:
    """Every rule that applies, in order. A bare Column gives its own text where it isn't null."""
    return F.array_compact(F.array(*[r if isinstance(r, Column) else F.when(r[1], F.lit(r[0])) for r in rules]))


def multiple_choice(source: Column, query: Column) -> Rule:
    return "refspatial_multiple_choice", (source == "refspatial") & F.contains(query, F.lit(" (A) "))


def hosted_rules(n_points: Column, source: Column, query: Column) -> list[Rule]:
    return [("missing_points_abs", F.coalesce(n_points, F.lit(0)) <= 0), multiple_choice(source, query)]


def local_rules(n_points: Column, source: Column, query: Column, counting: Column, counting_enabled: bool = False) -> list[Rule]:
    out = [("missing_points_abs", F.coalesce(n_points, F.lit(0)) <= 0), ("counting_gt_one", F.coalesce(counting.try_cast("int") > 1, F.lit(False)))]
    if not counting_enabled:
        out.append(("points_abs_multi_point", n_points > 1))
    return [*out, multiple_choice(source, query)]


def rejected(reason: Column, detail: Column) -> Column:
    """What a stage result looks like when a rule, not a model, rejected the record."""
    raw = F.to_json(F.struct(F.lit(False).alias("keep"), F.lit("").alias("core_target"), detail.alias("reason")))
    return F.when(reason.isNotNull(), F.struct(F.lit(False).alias("keep"), F.lit("").alias("core_target"), detail.alias("reason"), F.lit("rule_filtered").alias("finish_reason"), raw.alias("raw_output"), reason.alias("rule_filtered")))


def label_reason(label: Column) -> Column:
    """Why a label does not name one visible thing, or null if it may."""
    low = F.lower(X.clean_label(label))
    tokens, head = X.label_tokens(label), X.head_noun(label)
    n = F.size(tokens)
    among = lambda words: F.arrays_overlap(tokens, F.array(*map(F.lit, words)))
    return first_reason([
        ("empty_label", F.coalesce(low, F.lit("")) == ""),
        ("label_too_long", F.length(low) > 70),
        ("text_artifact_or_url", low.rlike(r"https?://|www\.|@|\.com|\\|[{}\[\]]")),
        ("caption_like_punctuation", low.rlike("[,'\"“”‘’:;()]")),
        ("numeric_only_label", low.rlike(r"^\p{Nd}+$")),
        ("single_character_label", low.rlike("^[a-z]$")),
        ("numeric_phrase_label", low.rlike(r"\p{Nd}") & (n >= 2)),
        ("qa_or_functional_phrase", reduce(or_, (F.startswith(low, F.lit(x)) for x in P.QUESTION_OPENERS))),
        ("stuff_label", among(P.STUFF_WORDS)),
        ("spatial_label", among(P.SPATIAL_WORDS)),
        ("text_like_label", among(P.TEXTLIKE_WORDS)),
        ("appearance_artifact_label", among(P.ARTIFACT_WORDS)),
        ("generic_head_noun", head.isin(*P.BAD_HEAD_WORDS)),
        ("too_many_tokens", n > 4),
        ("attribute_only_label", (n == 1) & head.isin(*P.ATTRIBUTE_WORDS)),
        ("abstract_category_label", (n == 1) & head.isin(*P.ABSTRACT_WORDS)),
        ("functional_phrase", (n >= 2) & among(P.FUNCTIONAL_WORDS)),
        ("relational_phrase", (n >= 3) & among(P.RELATIONAL_WORDS)),
        ("generic_non_instance", low.isin(*P.GENERIC_LABELS)),
    ])


def point_mode(n_points: Column, mode: str | None) -> Column:
    how = (mode or "all").strip().lower()
    return (n_points == 1) if how == "single" else (n_points > 1) if how == "multi" else (n_points > 0)


def object_reasons(label: Column, n_points: Column, spread: Column, most: int = 8, widest: float = 0.25) -> Column:
    return F.coalesce(label_reason(label), first_reason([("too_many_points_for_single_instance", n_points > most), ("multi_point_spread_too_large", (n_points >= 3) & (spread > widest))]))


def evaluation_row(ident: Column, files: Sequence[Column], roots: Sequence[Column], prefix: str = "benchmark_", file: str = "val_benchmark.jsonl") -> Column:
    """Whether a row belongs to the held-out benchmark: by the prefix of its id or root, or its file."""
    low = lambda c: F.lower(X.strip(F.coalesce(c, F.lit(""))))
    path = lambda c: F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("/")))
    tests = [F.startswith(low(ident), F.lit(prefix)), *[F.endswith(path(c), F.lit(file)) for c in files], *[F.startswith(low(c), F.lit(prefix)) for c in roots]]
    return reduce(or_, tests)


def eligible(status: Column, trainable: Column, row_present: Column, evaluation: Column, image_ok: Column, n_points: Column, mode: str = "all") -> Column:
    return reduce(and_, (F.coalesce(c, F.lit(False)) for c in (status == "completed", trainable, row_present, ~evaluation, image_ok, point_mode(n_points, mode))))


def drop_category(status: Column, category: Column, stage: Column, removed: str = P.REMOVED_CATEGORY) -> tuple[Column, Column]:
    """(status, stage) after completed rows of a removed category are filtered out."""
    hit = (status == "completed") & (category == removed)
    return F.when(hit, "filtered_out").otherwise(status), F.when(hit, "category_filter_spatial_relation_removed").otherwise(stage)


def image_rules(query: Column, width: Column, height: Column, points: Column, smallest: int = 224) -> list[Rule]:
    """Keep rules for queries, image sizes and points in [0, 1]."""
    out = lambda p: ~(p["x"].between(0.0, 1.0) & p["y"].between(0.0, 1.0))
    return [("bad_query", F.lower(F.coalesce(X.strip(query), F.lit(""))).isin("", "n/a")), ("image_too_small", F.least(width, height) < smallest), ("point_out_of_range", F.exists(points, out))]


# --- templates ---


def template_reasons(group: Column, template: Column) -> Column:
    """Reasons against a template; groups that aren't known only meet the general ones."""
    rules: list[Rule | Column] = []
    for g, names in P.TEMPLATE_REQUIRED.items():
        rules += [(f"missing_required_placeholder:{n}", (group == g) & ~F.contains(template, F.lit(n))) for n in names]
    for g, names in P.TEMPLATE_DIRECTION.items():
        rules.append(("missing_direction_placeholder", (group == g) & ~reduce(or_, (F.contains(template, F.lit(n)) for n in names))))
    rules += [(name, template.rlike(p)) for name, p in P.TEMPLATE_BANNED.items()]
    for g, banned in P.TEMPLATE_GROUP_BANNED.items():
        rules += [(name, (group == g) & template.rlike(p)) for name, p in banned.items()]
    blue = F.contains(template, F.lit("blue point")) | F.contains(template, F.lit("blue reference point"))
    rules.append(("missing_blue_point_reference", (group == "nearest_among_objects_templates") & F.contains(template, F.lit("{label}")) & ~blue))
    rules.append(("missing_then_step_order", (group == "two_step_axis_templates") & ~F.contains(F.lower(template), F.lit("then"))))
    return all_reasons(rules)


def filter_templates(templates: DataFrame) -> DataFrame:
    """(group, pos, text) -> the same with reasons; empty is kept. A text counts as seen before it is judged."""
    rows = templates.withColumn("text", X.strip(F.col("text")))
    first = F.row_number().over(Window.partitionBy("group", "text").orderBy("pos"))
    rows = rows.withColumn("nth", first)
    return rows.withColumn("reasons", F.when(F.col("text") == "", F.array(F.lit("empty"))).when(F.col("nth") > 1, F.array(F.lit("duplicate"))).otherwise(template_reasons(F.col("group"), F.col("text")))).drop("nth")


# --- payloads ---


def payload_reasons(v: Column, local: bool = False, counting_enabled: bool | None = None, style: str = "benchmark") -> Column:
    """All reasons against an audit document (a variant), or an empty array.

    Missing sections end the list early, as nothing can be said beyond them. ``local``: the
    variant with three categories, where several points filter a record out unless counting is
    enabled and sessions need 2, 4 and 6 messages after the three stages. ``style`` names the benchmark
    whose style a rewrite must have in the reason for one that hasn't.
    """
    return X.let(v, lambda doc: _payload_reasons(doc, local, counting_enabled, style))


def _payload_reasons(v: Column, local: bool, counting_enabled: bool | None, style: str) -> Column:
    from ..functions.jsonx import kind

    at = lambda path: F.try_variant_get(v, f"$.{path}", "variant")
    text = lambda path: F.when(kind(at(path)) == "STRING", F.try_variant_get(v, f"$.{path}", "string"))
    is_kind = lambda path, k: F.coalesce(kind(at(path)) == k, F.lit(False))
    filled = lambda path: F.coalesce(X.strip(text(path)) != "", F.lit(False))
    flag = lambda path: F.when(kind(at(path)) == "BOOLEAN", F.try_variant_get(v, f"$.{path}", "boolean"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    empty = lambda path: at(path).isNull() | is_kind(path, "VOID") | F.coalesce(F.to_json(at(path)).isin("[]", "{}"), F.lit(False))

    status, stage = F.coalesce(text("processing.status"), F.lit("None")), F.coalesce(text("processing.filter_stage"), F.lit(""))
    keep, multi, skipped = flag("cleaning.keep"), flag("multipoint.multi_point"), yes(flag("classification.skipped_for_multipoint"))
    valid = P.CATEGORIES_LOCAL if local else P.CATEGORIES
    given = F.try_variant_get(v, "$.classification.allowed_categories", "array<string>")
    allowed = F.filter(F.transform(given, lambda c: X.category(c)), lambda c: c.isin(*valid, *(("Counting",) if counting_enabled else ())))
    allowed = F.when(F.coalesce(F.size(allowed), F.lit(0)) > 0, allowed).otherwise(F.array(*map(F.lit, valid)))
    off = F.lit(not counting_enabled) if local or counting_enabled is not None else ~F.array_contains(allowed, "Counting")
    cat = F.coalesce(text("classification.category"), F.lit("None"))
    completed, out = status == "completed", status == "filtered_out"
    cleaned, rejects = yes(keep), yes(~keep)
    several, single = yes(multi), yes(~multi)
    forced = cleaned & several & skipped
    judged = cleaned & ~forced & ~(F.lit(local) & several & off)
    said = lambda prefix, value, when: F.when(when, F.concat(F.lit(prefix + ":"), value))
    messages = F.size(F.try_variant_get(v, "$.session_messages", "array<variant>"))
    least = {"completed": 6, "cleaning": 2, "multipoint": 4, "classification": 6}
    rules: list[Rule | Column] = [
        ("missing_record", ~is_kind("record", "OBJECT")),
        ("missing_session_messages", ~is_kind("session_messages", "ARRAY")),
        said("non_terminal_status", status, ~status.isin("completed", "filtered_out")),
        ("missing_completed_at", ~F.coalesce(text("processing.completed_at") != "", F.lit(False))),
        ("cleaning_missing_raw_output", ~filled("cleaning.raw_output")),
        ("cleaning_finish_length", yes(text("cleaning.finish_reason") == "length")),
        ("cleaning_missing_parsed", ~is_kind("cleaning.parsed", "OBJECT")),
        ("cleaning_missing_keep", keep.isNull()),
        ("cleaning_missing_reason", ~filled("cleaning.reason")),
        ("cleaning_missing_core_target", cleaned & ~filled("cleaning.core_target")),
        ("cleaning_keep_false_but_completed", rejects & completed),
        ("filtered_out_from_wrong_stage_for_cleaning", rejects & out & (stage != "cleaning")),
        ("multipoint_missing_raw_output", cleaned & ~filled("multipoint.raw_output")),
        ("multipoint_finish_length", cleaned & yes(text("multipoint.finish_reason") == "length")),
        ("multipoint_missing_parsed", cleaned & ~is_kind("multipoint.parsed", "OBJECT")),
        ("multipoint_missing_value", cleaned & multi.isNull()),
        ("multipoint_missing_reason", cleaned & ~filled("multipoint.reason")),
        ("multipoint_true_should_filter_out", F.lit(local) & cleaned & several & off & ~(out & (stage == "multipoint"))),
        ("multipoint_skip_invalid_when_counting_disabled", forced & off),
        said("multipoint_forced_category_invalid", cat, forced & (cat != "Counting")),
        ("classification_missing_forced_thought", forced & ~filled("classification.thought")),
        said("classification_finish_should_be_skipped", F.coalesce(text("classification.finish_reason"), F.lit("")), forced & yes(text("classification.finish_reason") != "skipped")),
        ("classification_raw_should_be_empty_when_skipped", forced & yes(text("classification.raw_output") != "")),
        ("classification_parsed_should_be_empty_when_skipped", forced & ~empty("classification.parsed")),
        ("classification_should_be_skipped_for_multipoint", judged & several & ~off & ~skipped),
        ("classification_unexpected_skip_for_single_point", judged & single & skipped),
        ("classification_missing_raw_output", judged & ~filled("classification.raw_output")),
        ("classification_finish_length", judged & yes(text("classification.finish_reason") == "length")),
        ("classification_missing_parsed", judged & ~is_kind("classification.parsed", "OBJECT")),
        ("classification_missing_thought", judged & ~filled("classification.thought")),
        said("classification_invalid_category", cat, judged & completed & ~F.array_contains(allowed, cat)),
        ("filtered_out_but_category_is_valid", judged & out & (stage == "classification") & F.array_contains(allowed, cat)),
        ("multipoint_should_be_empty_when_cleaning_rejects", ~cleaned & ~reduce(and_, (empty(f"multipoint.{k}") for k in ("raw_output", "parsed", "multi_point", "reason", "finish_reason")))),
        ("rewrite_missing_raw_output", completed & ~filled("rewrite.raw_output")),
        ("rewrite_finish_length", completed & yes(text("rewrite.finish_reason") == "length")),
        ("rewrite_missing_query", completed & ~filled("rewrite.rewritten_query")),
        (f"rewrite_not_{style}_style", completed & filled("rewrite.rewritten_query") & ~X.rewrite_is_valid(text("rewrite.rewritten_query"))),
        ("session_messages_too_short_completed", completed & (messages < least["completed"])),
        *[(f"session_messages_too_short_{k}_filter", out & (stage == k) & (messages < least[k])) for k in (("cleaning", "multipoint", "classification") if local else ("cleaning", "classification"))],
    ]
    missing = lambda k: ~is_kind(k, "OBJECT")
    stop = F.when(missing("processing"), F.array(F.lit("missing_processing")))
    before: list[Rule] = [("missing_record", missing("record"))]
    for k in ("cleaning", "multipoint", "classification", "rewrite"):
        stop = stop.when(missing(k), all_reasons([*before, (f"missing_{k}", F.lit(True))]))
    return F.when(F.coalesce(kind(v), F.lit("")) != "OBJECT", F.array(F.lit("payload_not_dict"))).otherwise(F.coalesce(stop, all_reasons(rules)))


# --- other checks ---


def record_reasons(v: Column) -> Column:
    """Reasons against a unified record (a variant): text fields, a target with points, format and size, a split."""
    return X.let(v, _record_reasons)


def _record_reasons(v: Column) -> Column:
    from ..functions.jsonx import kind, points

    text = lambda path: F.coalesce(X.strip(F.try_variant_get(v, f"$.{path}", "string")), F.lit(""))
    at = lambda path: F.try_variant_get(v, f"$.{path}", "variant")
    size = lambda k: F.coalesce(F.try_variant_get(v, f"$.target.image_size[{k}]", "int"), F.lit(0))
    rules: list[Rule | Column] = [(f"missing_{k}", text(k) == "") for k in P.RECORD_SOURCES_NEED]
    rules += [
        ("missing_target", F.coalesce(kind(at("target")) != "OBJECT", F.lit(True))),
        ("missing_points", F.size(points(at("target.points"))) == 0),
        ("unknown_point_format", ~text("target.point_format").isin(*P.POINT_FORMATS)),
        ("bad_image_size", (size(0) <= 0) | (size(1) <= 0)),
        ("missing_split", text("meta.split") == ""),
    ]
    return F.when(F.coalesce(kind(v) != "OBJECT", F.lit(True)), F.array(F.lit("record_not_dict"))).otherwise(all_reasons(rules))


def accepted(json_column: Column) -> Column:
    """Whether a judge's JSON says pass."""
    return F.coalesce(F.get_json_object(json_column, "$.pass") == "true", F.lit(False))


def completed_category(reasons: Column, status: Column, category: Column) -> Column:
    """The category of an output that is valid and completed, else null."""
    return F.when((F.size(reasons) == 0) & (status == "completed"), F.nullif(X.strip(category), F.lit("")))


def module_branch(name: Column) -> Column:
    low = F.lower(F.coalesce(X.strip(name), F.lit("")))
    return (
        F.when(F.contains(low, F.lit("vision_backbone.image_vit")), "vision")
        .when(F.contains(low, F.lit("vision_backbone.image_projector")), "projector")
        .when(F.startswith(low, F.lit("model.transformer.")) | F.contains(low, F.lit(".transformer.blocks.")), "llm")
        .otherwise("other")
    )


def adapter_targets(modules: DataFrame, scope: str = "vision+llm") -> DataFrame:
    """Modules (module_name) whose last part takes an adapter, with their branch, within a scope."""
    if scope not in P.MODULE_SCOPES:
        raise ValueError(f"no such scope: {scope}")
    leaf = F.element_at(F.split("module_name", r"\."), -1)
    found = modules.withColumn("leaf_name", leaf).where(F.col("leaf_name").isin(*P.MODULE_LEAVES)).withColumn("branch", module_branch(F.col("module_name")))
    return found.where(F.col("branch").isin(*P.MODULE_SCOPES[scope]))
