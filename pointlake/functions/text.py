"""String functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

#: White space as Python's strip and \s see it (Java's \s is ASCII only).
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: expressions that use a part several times would
    otherwise hold as many copies of it, and nested ones exponentially many."""
    return F.get(F.transform(F.array(value), use), 0)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def normalise(text: Column) -> Column:
    return collapse(F.lower(F.coalesce(text, F.lit(""))))


def any_of(text: Column, patterns: Iterable[str]) -> Column:
    """Whether one of the patterns is found: one alternation, one pass."""
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def first_filled(*values: Column) -> Column:
    """The first value that isn't blank, stripped."""
    return F.coalesce(*[F.nullif(strip(v.cast("string")), F.lit("")) for v in values])


def lookup(key: Column, table: Mapping[str, object], default: Column | None = None) -> Column:
    """A constant table as a literal map: no join."""
    found = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    got = F.element_at(found, key)
    return got if default is None else F.coalesce(got, default)


def category(value: Column, merged: bool = False, none: str | None = None) -> Column:
    """The category that an alias names; ``none`` where there is none. ``merged`` knows Steerable."""
    key = collapse(F.translate(F.lower(value.cast("string")), "_-", "  "))
    return lookup(key, P.CATEGORY_ALIAS | (P.STEERABLE_ALIAS if merged else {}), F.lit(none))


def strip_fence(text: Column) -> Column:
    """Without a surrounding code fence."""

    def bare(t: Column) -> Column:
        inside = F.regexp_replace(F.regexp_replace(t, rf"(?i)^```(?:json)?{SPACE}*", ""), rf"{SPACE}*```$", "")
        return strip(F.when(F.startswith(t, F.lit("```")), inside).otherwise(t))

    return let(strip(F.coalesce(text, F.lit(""))), bare)


def unquote(text: Column) -> Column:
    return F.btrim(F.btrim(strip(text), F.lit('"')), F.lit("'"))


def short_text(text: Column) -> Column:
    return collapse(unquote(strip_fence(text)))


def rewritten(text: Column) -> Column:
    """The rewritten query in a model's output: a known key of a JSON object or the text; its first
    line that isn't blank; from its first "Point to" on; white space collapsed."""
    from .jsonx import lenient_object

    breaks = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"
    keyed = lambda v: first_filled(*[_string_at(v, k) for k in P.REWRITE_KEYS])
    first_line = lambda t: F.coalesce(F.get(F.filter(F.transform(F.split(t, breaks), strip), lambda x: x != ""), 0), t)
    from_point = lambda t: collapse(F.when(F.contains(t, F.lit("Point to")), F.regexp_extract(t, r"Point to[\s\S]*", 0)).otherwise(t))
    bare = lambda b: let(F.coalesce(let(lenient_object(b), keyed), b), lambda t: let(unquote(first_line(t)), from_point))
    return let(strip_fence(text), bare)


def _string_at(variant: Column, key: str) -> Column:
    return let(F.try_variant_get(variant, f"$.{key}", "variant"), lambda at: F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(at, "$", "string")))


def rewrite_is_valid(text: Column) -> Column:
    return F.coalesce(F.startswith(strip(text), F.lit("Point to")), F.lit(False))


# --- labels ---


def clean_label(text: Column) -> Column:
    return collapse(F.translate(F.coalesce(text, F.lit("")), "_/", "  "))


def label_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(clean_label(text)), F.lit("[a-z0-9]+"), 0)


def head_noun(text: Column) -> Column:
    words = F.filter(label_tokens(text), lambda w: ~w.isin("the", "a", "an"))
    return F.coalesce(F.try_element_at(words, F.lit(-1)), F.lower(clean_label(text)))


def class_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(clean_label(text)), r"^(a|an|the)\s+", "")


def file_name(text: Column, longest: int = 90, default: str = "object") -> Column:
    safe = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"[^A-Za-z0-9_.-]+", "_")
    return F.coalesce(F.nullif(F.btrim(F.substring(safe, 1, longest), F.lit("._")), F.lit("")), F.lit(default))


def image_key(record: Mapping[str, Column]) -> Column:
    """First of meta_sha256, meta_id, sha256, image_id, the path's stem, id that isn't blank."""
    none = F.lit(None).cast("string")
    get = lambda k: record.get(k, none)
    return F.coalesce(first_filled(get("meta_sha256"), get("meta_id"), get("sha256"), get("image_id")), stem(first_filled(get("path"))), first_filled(get("id")), F.lit(""))


def stem(path: Column) -> Column:
    name = F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"([^/]*)$", 1)
    return F.when(path.isNotNull(), F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def key_of_value(value: Column) -> Column:
    """The stem of a file name with a suffix, else the text."""
    bare = strip(F.coalesce(value, F.lit("")))
    return F.when(bare.rlike(r"[^/]\.[^./]+$"), stem(bare)).otherwise(bare)


def sample_id(sample: Column, record: Column, source: Column, file: Column, rank: Column) -> Column:
    return F.coalesce(first_filled(sample, record), F.concat_ws("::", F.coalesce(source, F.lit("")), F.coalesce(file, F.lit("")), F.coalesce(rank.cast("string"), F.lit(""))))


# --- cues and styles ---


def cues(text: Column) -> dict[str, Column]:
    low = normalise(text)
    families = {"affordance": P.AFFORDANCE_CUES, "non_human": P.NON_HUMAN_CUES, "existing_point": P.EXISTING_POINT_CUES, "semantic": P.SEMANTIC_CUES, "reasoning": P.REASONING_CUES, "multi_instance": P.MULTI_INSTANCE_CUES}
    return {k: any_of(low, v) for k, v in families.items()}


def refine_category(query: Column, target: Column, predicted: Column) -> Column:
    """Ordered decisions over the query and its core target; the first that applies wins."""
    found = cues(F.concat_ws(" ", normalise(query), normalise(target)))
    said = F.coalesce(first_filled(predicted), F.lit("None"))
    return (
        F.when(found["existing_point"], "Object Reference")
        .when(found["semantic"] & (said == "Object Reference"), "Reasoning")
        .when(said.isin("Object Reference", "None") & found["affordance"], "Affordance")
        .when(said != "Affordance", said)
        .when(found["affordance"], "Affordance")
        .when(found["non_human"], "Reasoning")
        .otherwise("Object Reference")
    )


def keeps_cues(cat: Column, query: Column, rewrite: Column) -> Column:
    """An Object Reference that names an existing point must still name one when rewritten."""
    return ~((F.coalesce(strip(cat), F.lit("")) == "Object Reference") & cues(query)["existing_point"]) | cues(rewrite)["existing_point"]


def prefilter(query: Column, target: str) -> Column:
    found = cues(query)
    if target == "Affordance":
        return found["affordance"] & ~found["multi_instance"]
    if target == "Reasoning":
        return found["reasoning"] & ~found["existing_point"]
    return F.lit(True)


def coarse_task(query: Column, default: str = "unknown") -> Column:
    low = F.lower(F.coalesce(query, F.lit("")))
    out = F.lit(default)
    for name, words in reversed(P.COARSE_TASKS):
        out = F.when(reduce(or_, (F.contains(low, F.lit(w)) for w in words)), name).otherwise(out)
    return out


def runtime_category(query: Column, anchors: Sequence[str], keywords: Mapping[str, Sequence[str]], default: str = "reasoning") -> Column:
    """Keyword lists in order, the anchor phrases first."""
    low = F.lower(F.coalesce(query, F.lit("")))
    out = F.lit(default)
    for name, words in reversed([("steerability", anchors), *keywords.items()]):
        out = F.when(reduce(or_, (F.contains(low, F.lit(w)) for w in words)), name).otherwise(out)
    return out


def styles(question: Column) -> tuple[Column, Column, Column]:
    """(flags, primary style, whether it refers to an anchor) of a question."""
    has = {k: question.rlike(p) for k, p in (("anchor", P.STYLE_ANCHOR), ("move", P.STYLE_MOVE), ("near", P.STYLE_NEAREST), ("then", P.STYLE_TWO_STEP), ("diagonal", P.STYLE_DIAGONAL), ("axis", P.STYLE_AXIS), ("same", P.STYLE_SAME))}
    flags = F.array_compact(F.array(
        F.when(has["anchor"], "explicit_anchor"), F.when(has["move"], "implicit_move_anchor"), F.when(has["near"], "nearest"), F.when(has["then"], "two_step"),
        F.when(has["diagonal"] & ~has["then"], "single_diagonal"), F.when(has["axis"], "straight_axis"), F.when(has["same"], "same_position_or_existing_object"),
    ))
    anchored = has["anchor"] | has["move"] | has["same"]
    primary = (
        F.when(has["then"], "two_step_axis_move").when(has["diagonal"], "single_diagonal_move").when(has["near"], "nearest_or_closest").when(has["axis"], "straight_axis_relation_or_move")
        .when(has["same"], "same_position_or_existing_object").when(anchored, "anchor_other").otherwise("not_anchor_or_unclear")
    )
    return flags, primary, anchored


# --- rendering ---


def fill(template: Column, values: Mapping[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def markdown(text: Column) -> Column:
    return F.translate(F.replace(text, F.lit("|"), F.lit("\\|")), "\n", " ")


def percent(x: Column) -> Column:
    return F.format_string("%.2f%%", x)


def csv_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")


def point_text(points: Column, multi: bool = False) -> Column:
    """Points in [0, 1] as tags in thousandths; (500, 500) if there is none."""
    pair = lambda p, sep: F.concat_ws(sep, *[F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1000.0), p[k] * 1000))).cast("int").cast("string") for k in ("x", "y")])
    if multi:
        shown = F.concat(F.lit("<points>"), F.array_join(F.transform(points, lambda p: pair(p, ",")), "; "), F.lit("</points>"))
    else:
        shown = F.concat(F.lit("<point>"), pair(F.element_at(points, 1), ","), F.lit("</point>"))
    none = "<points>500,500</points>" if multi else "<point>500,500</point>"
    return F.when(F.coalesce(F.size(points), F.lit(0)) <= 0, none).otherwise(shown)


def coords_tag(points: Column, width: Column, height: Column, label: Column, mode: Column) -> Column:
    """Points scaled to thousandths, sorted and numbered, in one of the output modes."""
    scale = lambda v, s: F.rint(1000.0 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / F.greatest(s.cast("double"), F.lit(1.0))))).cast("int")
    placed = F.array_sort(F.transform(points, lambda p: F.struct(scale(p["x"], width).alias("x"), scale(p["y"], height).alias("y"))))
    listed = F.array_join(F.transform(placed, lambda p, i: F.format_string("%d %03d %03d", i + 1, p["x"], p["y"])), " ")
    tag = F.concat(F.lit('<points coords="1 '), listed, F.lit('">'), F.coalesce(first_filled(label), F.lit("target")), F.lit("</points>"))
    n = F.size(points)
    how = F.coalesce(F.nullif(F.lower(strip(mode)), F.lit("")), F.lit("pointing"))
    return (
        F.when(F.coalesce(n, F.lit(0)) <= 0, "There are none.")
        .when(how.isin("point_count", "point_then_count"), F.concat(F.lit("Counting the "), tag, F.lit(" shows a total of "), n.cast("string"), F.lit(".")))
        .when(how == "count_then_point", F.concat(F.lit("There are "), n.cast("string"), F.lit(" "), tag, F.lit(".")))
        .when(how == "count", n.cast("string"))
        .otherwise(tag)
    )


def fixed_tokens(points: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """The number of points, then POS_dddd for each coordinate in thousandths."""
    one = lambda v, s: F.format_string("POS_%04d", F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v if s is None else v / s)) * 1000).cast("int"))
    return F.concat_ws(" ", F.size(points).cast("string"), F.flatten(F.transform(points, lambda p: F.array(one(p["x"], width), one(p["y"], height)))))


def fixed_tokens_decode(text: Column) -> Column:
    """POS_dddd tokens, in pairs, as points in thousandths."""
    n = F.transform(F.regexp_extract_all(text, F.lit(r"POS_([0-9]{4})"), 1), lambda x: x.cast("int"))
    return F.transform(F.filter(F.transform(n, lambda x, i: F.struct(x.alias("x"), F.get(n, i + 1).alias("y"), i.alias("i"))), lambda p: (p["i"] % 2 == 0) & p["y"].isNotNull()), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def retry_after(header: Column, body: Column, patterns: Sequence[str]) -> Column:
    """Seconds to wait: the header's digits, else the largest number that a pattern finds."""
    found = F.flatten(F.array(*[F.regexp_extract_all(body, F.lit(p), 1) for p in patterns]))
    return F.coalesce(F.try_to_number(F.when(header.rlike("^[0-9]{1,9}$"), header), F.lit("999999999")).cast("double"), F.array_max(F.transform(found, lambda x: x.cast("double"))))


def wrap(text: Column, width: int) -> Column:
    """Greedy word wrap: the lines."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def step(acc: Column, w: Column) -> Column:
        longer = F.when(acc["line"] == "", w).otherwise(F.concat(acc["line"], F.lit(" "), w))
        fits = (F.length(longer) <= width) | (acc["line"] == "")
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["line"]))).alias("done"), F.when(fits, longer).otherwise(w).alias("line"))

    return F.aggregate(F.filter(F.split(collapse(text), " "), lambda w: w != ""), start, step, lambda acc: F.when(acc["line"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["line"]))))


def cache_name(uid: Column) -> Column:
    return F.concat(F.sha1(uid), F.lit(".json"))


def stable_seed(canonical: Column) -> Column:
    """The first 8 bytes of SHA-256, as an unsigned decimal."""
    return F.conv(F.substring(F.sha2(canonical, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def query_key(text: Column) -> Column:
    """For dedup: stripped, lower case, without a full stop at the end."""
    return strip(F.regexp_replace(F.lower(strip(text)), r"\.+$", ""))


def cleaning_method(root: Column, extract: str = "benchmark_extract") -> Column:
    """Which pipeline made a run, by the name of its root; ``extract`` is the name for the hosted one."""
    name = F.coalesce(root, F.lit(""))
    return (
        F.when(F.startswith(name, F.lit("sam_clean")), "sam_clean")
        .when(F.contains(name, F.lit("three_types")) | F.contains(name, F.lit("3types")), "clean_3types_local")
        .when(F.startswith(name, F.lit("mix4")) | F.contains(name, F.lit("pointsabs")), extract)
        .otherwise("unknown")
    )


def bullet_list(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: F.concat(F.lit("- "), x)), "\n")


def endpoint(url: Column) -> Column:
    return F.rtrim(url, F.lit("/"))
