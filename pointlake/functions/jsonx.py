"""JSON and nested values as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import category, first_filled, let, strip, strip_fence


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, BIGINT, DOUBLE, VOID ... of a variant."""
    return F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1)


def lenient_object(text: Column) -> Column:
    """A JSON object: the whole text, else the widest {...} in it; null if it is neither."""
    only = lambda v: F.when(kind(v) == "OBJECT", v)
    within = lambda t: F.coalesce(let(F.try_parse_json(t), only), let(F.try_parse_json(F.regexp_extract(t, r"\{[\s\S]*\}", 0)), only))
    return let(strip_fence(text), within)


def boolish(v: Column) -> Column:
    """True and false, and the words for them; numbers are neither."""
    word = lambda s: F.when(s.isin("true", "yes", "1", "keep"), True).when(s.isin("false", "no", "0", "drop"), False)
    of = lambda x: F.when(kind(x) == "BOOLEAN", F.try_variant_get(x, "$", "boolean")).when(kind(x) == "STRING", let(F.lower(strip(F.try_variant_get(x, "$", "string"))), word))
    return let(v, of)


def whole_number(text: Column, default: int = 0) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(default))


def truncated(number: Column, default: int = 0) -> Column:
    """As above for numbers: fractions are cut off."""
    return F.coalesce(number.try_cast("double").try_cast("int"), F.lit(default))


def expected_count(count: Column, points: Column) -> Column:
    return F.greatest(F.coalesce(count.try_cast("int"), F.size(points)), F.lit(0))


def point(v: Column) -> Column:
    """[x, y, ...] or {x, y} as a struct, else null."""
    at = lambda p, path: F.try_variant_get(p, path, "double")
    whole = lambda q: F.when(q["x"].isNotNull() & q["y"].isNotNull(), q)
    return let(v, lambda p: let(F.struct(F.coalesce(at(p, "$[0]"), at(p, "$.x")).alias("x"), F.coalesce(at(p, "$[1]"), at(p, "$.y")).alias("y")), whole))


def points(v: Column) -> Column:
    """A list of either form of point; those that are neither are left out."""
    items = F.try_variant_get(v, "$", "array<variant>")
    return F.coalesce(F.array_compact(F.transform(items, point)), F.array().cast("array<struct<x:double,y:double>>"))


def first_nonempty(*arrays: Column) -> Column:
    return F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays])


def version_kind(keys: Column) -> Column:
    """Of a document by its keys."""
    has = lambda *names: F.size(F.array_except(F.array(*map(F.lit, names)), keys)) == 0
    return F.when(has("cleaning", "multipoint", "classification", "rewrite"), "full_workflow").when(has("classification", "rewrite"), "legacy_classify_rewrite").otherwise("unknown")


def classifier_output(text: Column, labels: Sequence[str] = P.CATEGORIES) -> Column:
    """The category in a classifier's output: of its JSON object, else the first one named in the text."""
    keyed = category(F.try_variant_get(lenient_object(text), "$.category", "string"))
    named = F.regexp_extract(text, "(?i)(" + "|".join(labels) + ")", 1)
    return F.coalesce(keyed, category(F.nullif(named, F.lit(""))))


def _said(v: Column, key: str) -> Column:
    return F.coalesce(strip(F.try_variant_get(v, f"$.{key}", "string")), F.lit(""))


def cleaning_output(text: Column) -> Column:
    """keep, core_target, reason, or null where one that is needed is missing."""
    read = lambda v: F.struct(boolish(F.try_variant_get(v, "$.keep", "variant")).alias("keep"), _said(v, "core_target").alias("core_target"), _said(v, "reason").alias("reason"))
    whole = lambda s: F.when(s["keep"].isNotNull() & (s["reason"] != "") & (~s["keep"] | (s["core_target"] != "")), F.struct(s["keep"].alias("keep"), F.when(s["keep"], s["core_target"]).otherwise("").alias("core_target"), s["reason"].alias("reason")))
    return let(lenient_object(text), lambda v: let(read(v), whole))


def multipoint_output(text: Column) -> Column:
    read = lambda v: F.struct(boolish(F.try_variant_get(v, "$.multi_point", "variant")).alias("multi_point"), _said(v, "reason").alias("reason"))
    return let(lenient_object(text), lambda v: let(read(v), lambda s: F.when(s["multi_point"].isNotNull() & (s["reason"] != ""), s)))


def display_label(*values: Column, category: Column) -> Column:
    return F.coalesce(first_filled(*values), first_filled(category), F.lit("target"))


def timestamp_iso(text: Column, fallback: Column) -> Column:
    """UTC, as 2024-01-02T03:04:05Z with a fraction only where there is one; the fallback if it can't be read."""

    def show(t: Column) -> Column:
        micro = F.pmod(F.unix_micros(t), F.lit(1_000_000))
        return F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micro == 0, "").otherwise(F.format_string(".%06d", micro)), F.lit("Z"))

    return let(parse_time(text, fallback), show)


def parse_time(text: Column, fallback: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(strip(text)), fallback)


def elapsed(start: Column, end: Column) -> Column:
    return F.round((F.unix_micros(end) - F.unix_micros(start)) / 1e6, 3)


def padded(values: Column, longest: Column, fill: Column) -> Column:
    """The values and fill up to ``longest``."""
    return F.concat(values, F.array_repeat(fill, F.greatest(longest - F.size(values), F.lit(0)).cast("int")))


def pad_mask(values: Column, longest: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(longest, F.lit(1)).cast("int")), lambda i: (i <= F.size(values)).cast("int"))
