"""Queries on strings, dates, JSON and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonx as J
from ..functions import parsers as PR
from ..functions import patterns as P
from ..functions import rng as RNG
from ..functions import text as X
from ..operators import selection as S
from ..operators import tasks as T
from ..operators import versions as V
from ..operators import workflow as W
from .registry import bounded, joined, query, table


@query("""
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Spatial Relation' WHEN 1 THEN 'Object Reference' WHEN 2 THEN 'Counting' WHEN 3 THEN 'Steerable' WHEN 4 THEN NULL ELSE 'Affordance' END AS category FROM part""")
def normalize_category(spark, sf):
    said = F.element_at(F.array(*map(F.lit, (" Spatial_Relation ", "object-reference", "COUNTING", "steerability", "none", "affordance"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", X.category(said, merged=True).alias("category"))


@query("""
WITH t AS (SELECT p_partkey, 'The_' || p_name || '/big' AS label FROM part), c AS (SELECT p_partkey, lower(translate(label, '_/', '  ')) AS low FROM t)
SELECT p_partkey, array_to_string(regexp_extract_all(low, '[a-z0-9]+'), ',') AS tokens, 'big' AS head, regexp_replace(low, '^(a|an|the)\\s+', '') AS same_class_key FROM c""")
def label_tokens(spark, sf):
    label = F.concat(F.lit("The_"), "p_name", F.lit("/big"))
    return table(spark, sf, "part").select("p_partkey", joined(X.label_tokens(label)).alias("tokens"), X.head_noun(label).alias("head"), X.class_key(label).alias("same_class_key"))


@query("""
SELECT p_partkey, coalesce(nullif(trim(substr(regexp_replace(p_name || ' ' || p_brand || '..', '[^A-Za-z0-9_.-]+', '_', 'g'), 1, 90), '._'), ''), 'object') AS safe FROM part""")
def sanitize_name(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.file_name(F.concat("p_name", F.lit(" "), "p_brand", F.lit(".."))).alias("safe"))


@query("SELECT doc_id, source || '/' || lpad(doc_id::VARCHAR, greatest(4, length(doc_id::VARCHAR))::INT, '0') || '__doc_' || doc_id || '.json' AS path FROM documents")
def output_path(spark, sf):
    from ..sources.sinks import sample_file

    return table(spark, sf, "documents").select("doc_id", sample_file(F.col("source"), F.col("doc_id"), X.file_name(F.concat(F.lit("doc "), "doc_id"))).alias("path"))


_BOUND = {k: bounded(v) for k, v in {"then": "then", "all": "all", "the": "the"}.items()}


@query(f"""
WITH f AS (SELECT doc_id, regexp_matches(lower(text), '{_BOUND["then"]}') AS t, regexp_matches(lower(text), '{_BOUND["all"]}') AS a, regexp_matches(lower(text), '{_BOUND["the"]}') AS h FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN h THEN 'the' END, CASE WHEN a AND NOT t THEN 'all' END, CASE WHEN t THEN 'then' END], lambda x: x IS NOT NULL), ',') AS flags, CASE WHEN t THEN 'two_step' WHEN a THEN 'many' WHEN h THEN 'named' ELSE 'unclear' END AS style FROM f""")
def style_primary(spark, sf):
    """Flags (several) and one primary style by ordered decisions, with a pack of words that occur."""
    low = F.lower("text")
    has = {k: low.rlike(p) for k, p in _BOUND.items()}
    flags = F.array_compact(F.array(F.when(has["the"], "the"), F.when(has["all"] & ~has["then"], "all"), F.when(has["then"], "then")))
    return table(spark, sf, "documents").select("doc_id", joined(flags).alias("flags"), F.when(has["then"], "two_step").when(has["all"], "many").when(has["the"], "named").otherwise("unclear").alias("style"))


@query(f"""
WITH f AS (SELECT doc_id, CASE WHEN regexp_matches(lower(text), '{_BOUND["then"]}') THEN 'two_step' WHEN regexp_matches(lower(text), '{_BOUND["all"]}') THEN 'many' ELSE 'other' END AS style FROM documents)
SELECT style, doc_id FROM f QUALIFY row_number() OVER (PARTITION BY style ORDER BY doc_id) <= 8""")
def top_n_per_style(spark, sf):
    low = F.lower("text")
    style = F.when(low.rlike(_BOUND["then"]), "two_step").when(low.rlike(_BOUND["all"]), "many").otherwise("other")
    return S.first_per_group(table(spark, sf, "documents").select(style.alias("style"), "doc_id"), ["style"], ["doc_id"], 8)


_TASKS = " ".join(f"WHEN {' OR '.join(f"contains(low, '{w}')" for w in words)} THEN '{name}'" for name, words in P.COARSE_TASKS)


@query(f"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents) SELECT doc_id, CASE {_TASKS} ELSE 'unknown' END AS task FROM d""")
def coarse_task(spark, sf):
    """Whole texts by the first list of which a word stands in them."""
    return table(spark, sf, "documents").select("doc_id", X.coarse_task(F.col("text")).alias("task"))


@query("""
WITH q(id, primary_style) AS (VALUES (1, 'two_step_axis_move'), (2, 'single_diagonal_move'), (3, 'nearest_or_closest'), (4, 'straight_axis_relation_or_move'), (5, 'same_position_or_existing_object'), (6, 'anchor_other'), (7, 'not_anchor_or_unclear')) SELECT * FROM q""")
def question_styles(spark, sf):
    rows = [(1, "Move right then up until the cup"), (2, "Go up-right to the cup"), (3, "The cup nearest to the blue point"), (4, "The cup above the plate"), (5, "The object where the blue point is"), (6, "The colour of the existing point"), (7, "The red cup")]
    return spark.createDataFrame(rows, "id int, q string").select("id", X.styles(F.col("q"))[1].alias("primary_style"))


@query("""SELECT doc_id, 'Task ' || doc_id || ' from ' || source || ': ' || coalesce(lang, '') AS prompt FROM documents""")
def prompt_render(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.fill(F.lit("Task {id} from {source}: {lang}"), {"id": F.col("doc_id").cast("string"), "source": F.col("source"), "lang": F.coalesce("lang", F.lit(""))}).alias("prompt"))


_XY = "SELECT vec_id, label, (embedding[1]::DOUBLE + 1) / 2 AS x, (embedding[2]::DOUBLE + 1) / 2 AS y FROM embeddings"


def _xy(spark, sf):
    half = lambda k: ((F.get("embedding", k).cast("double") + 1) / 2)
    return table(spark, sf, "embeddings").select("vec_id", "label", half(0).alias("x"), half(1).alias("y"))


def _point(x="x", y="y"):
    return F.array(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))


@query(f"SELECT vec_id, '<point>' || round_even(x * 1000, 0)::INT || ',' || round_even(y * 1000, 0)::INT || '</point>' AS target, '<points>' || round_even(x * 1000, 0)::INT || ',' || round_even(y * 1000, 0)::INT || '</points>' AS targets FROM ({_XY})")
def target_text(spark, sf):
    return _xy(spark, sf).select("vec_id", X.point_text(_point()).alias("target"), X.point_text(_point(), multi=True).alias("targets"))


@query(f"""
WITH p AS (SELECT vec_id, label, lpad(round_even(1000 * x, 0)::INT::VARCHAR, 3, '0') AS a, lpad(round_even(1000 * y, 0)::INT::VARCHAR, 3, '0') AS b FROM ({_XY})), t AS (SELECT vec_id, label, '<points coords="1 1 ' || a || ' ' || b || '">item</points>' AS tag FROM p)
SELECT vec_id, CASE label % 4 WHEN 0 THEN tag WHEN 1 THEN 'Counting the ' || tag || ' shows a total of 1.' WHEN 2 THEN 'There are 1 ' || tag || '.' ELSE '1' END AS answer FROM t""")
def coords_tag(spark, sf):
    mode = F.element_at(F.array(*map(F.lit, ("pointing", "point_count", "count_then_point", "count"))), F.col("label") % 4 + 1)
    return _xy(spark, sf).select("vec_id", X.coords_tag(_point(), F.lit(1), F.lit(1), F.lit("item"), mode).alias("answer"))


@query(f"SELECT vec_id, '1 POS_' || lpad((round_even(x * 1000, 0)::INT)::VARCHAR, 4, '0') || ' POS_' || lpad((round_even(y * 1000, 0)::INT)::VARCHAR, 4, '0') AS tokens, round_even(x * 1000, 0)::INT AS x, round_even(y * 1000, 0)::INT AS y FROM ({_XY})")
def fixed_width_tokens(spark, sf):
    t = _xy(spark, sf).select("vec_id", X.fixed_tokens(_point()).alias("tokens"))
    p = F.element_at(X.fixed_tokens_decode(F.col("tokens")), 1)
    return t.select("vec_id", "tokens", p["x"].alias("x"), p["y"].alias("y"))


@query("SELECT doc_id, sha1('doc:' || doc_id) || '.json' AS cache_name FROM documents")
def cache_key_sha1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.cache_name(F.concat(F.lit("doc:"), "doc_id")).alias("cache_name"))


@query("""SELECT doc_id, ('0x' || substr(sha256('{"parts": [' || doc_id || '], "seed": 1}'), 1, 15))::BIGINT AS seed_head FROM documents""")
def stable_seed(spark, sf):
    seed = X.stable_seed(F.format_string('{"parts": [%d], "seed": 1}', "doc_id"))
    return table(spark, sf, "documents").select("doc_id", F.floor(seed / 16).cast("long").alias("seed_head"))


@query("""SELECT doc_id, '| ' || replace(replace(text, '|', '\\|'), chr(10), ' ') AS cell FROM documents""")
def markdown_cell(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("| "), X.markdown(F.col("text"))).alias("cell"))


@query("SELECT c_custkey, replace(c_name, '#', '_') AS key FROM customer")
def image_key(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", X.image_key({"meta_sha256": F.lit(" "), "path": F.concat(F.lit("/img/a/"), F.replace("c_name", F.lit("#"), F.lit("_")), F.lit(".png"))}).alias("key"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 's' || doc_id WHEN doc_id % 3 = 1 THEN 'r' || doc_id ELSE source || '::f.jsonl::' || doc_id END AS sample_id FROM documents")
def sample_ids(spark, sf):
    d = table(spark, sf, "documents")
    s, r = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" s"), "doc_id")), F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("r"), "doc_id"))
    return d.select("doc_id", X.sample_id(s, r, F.col("source"), F.lit("f.jsonl"), F.col("doc_id")).alias("sample_id"))


@query("""
WITH q(id, outcome) AS (VALUES (1, 'Point to the cup.'), (2, 'Point to the lid'), (3, 'no target'), (4, 'Point to a b')) SELECT id, outcome AS rewritten FROM q""")
def rewrite_normalize(spark, sf):
    rows = [(1, '```json\n{"rewritten_query": "Point to the cup."}\n```'), (2, '\n  "Sure: Point to the lid"\nmore'), (3, "no target"), (4, '{"text": "Point to  a\\tb"}')]
    return spark.createDataFrame(rows, "id int, t string").select("id", X.rewritten(F.col("t")).alias("rewritten"))


@query("""
WITH w AS (SELECT p_partkey, string_split(p_name || ' ' || p_brand || ' ' || p_type, ' ') AS w FROM part)
SELECT p_partkey, list_reduce(w, lambda done, x: done || CASE WHEN length(regexp_extract(done, '[^,]*$')) + 1 + length(x) <= 14 THEN ' ' ELSE ',' END || x) AS lines FROM w""")
def word_wrap(spark, sf):
    said = F.concat(F.lit("  "), "p_name", F.lit(" \t "), "p_brand", F.lit("\n"), "p_type", F.lit(" "))
    return table(spark, sf, "part").select("p_partkey", joined(X.wrap(said, 14)).alias("lines"))


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (event_id % 100)::DOUBLE WHEN event_id % 5 = 0 THEN NULL ELSE greatest(user_id % 50 + 0.5, (event_id % 40)::DOUBLE) END AS seconds FROM events""")
def retry_after(spark, sf):
    """The header where it has digits, else the largest number that the body names."""
    e = table(spark, sf, "events")
    text = lambda c: c.cast("string")
    head = F.when(F.col("event_id") % 3 == 0, text(F.col("event_id") % 100)).when(F.col("event_id") % 3 == 1, "soon")
    body = F.when(F.col("event_id") % 5 == 0, "no").otherwise(F.concat(F.lit("retry in 0.5s, retry in "), text(F.col("user_id") % 50), F.lit(".5s; wait "), text(F.col("event_id") % 40), F.lit(" seconds")))
    return e.select("event_id", X.retry_after(head, body, (r"retry in ([0-9.]+)s", r"wait ([0-9]+) seconds")).alias("seconds"))


# --- dates ---


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') END || 'Z' AS iso FROM events""")
def iso_time_canonical(spark, sf):
    e = table(spark, sf, "events")
    said = F.when(F.col("event_id") % 10 == 0, F.lit("not a time")).otherwise(F.col("ts").cast("string"))
    return e.select("event_id", J.timestamp_iso(said, F.col("ts").cast("timestamp")).alias("iso"))


@query("""
WITH o AS (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) SELECT event_id, round((epoch_us(nxt) - epoch_us(ts)) / 1000000.0::DOUBLE, 3) AS elapsed FROM o""")
def elapsed_seconds(spark, sf):
    from pyspark.sql import Window

    nxt = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf, "events").withColumn("nxt", nxt)
    return e.select("event_id", J.elapsed(F.col("ts").cast("timestamp"), F.col("nxt").cast("timestamp")).alias("elapsed"))


# --- JSON ---


def _shown(p):
    return F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))


@query("SELECT event_id, json_type(props) = 'OBJECT' AS is_object, (props->>'$.k')::INT AS k FROM events")
def lenient_json(spark, sf):
    """Objects in text around them."""
    v = J.lenient_object(F.concat(F.lit("Here: ```json\n"), "props", F.lit("\n``` done")))
    return table(spark, sf, "events").select("event_id", F.coalesce(J.kind(v) == "OBJECT", F.lit(False)).alias("is_object"), F.try_variant_get(v, "$.k", "int").alias("k"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE quality = 1 END AS b FROM labels""")
def boolish(spark, sf):
    """Labels as booleans, as digits in quotes, as words; as bare numbers they say nothing."""
    good, k = F.col("quality") == 1, F.col("doc_id") % 5
    said = F.when(k == 0, F.when(good, "true").otherwise("false")).when(k == 1, F.concat(F.lit('" '), "quality", F.lit(' "'))).when(k == 2, F.when(good, '" Yes "').otherwise('"no"')).when(k == 3, F.when(good, '"KEEP"').otherwise('"drop"')).otherwise(F.col("quality").cast("string"))
    return table(spark, sf, "labels").select("doc_id", J.boolish(F.try_parse_json(said)).alias("b"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE (event_id % 1000)::INT END AS n, trunc(value)::INT AS whole FROM events")
def int_coerce(spark, sf):
    e = table(spark, sf, "events")
    said = F.when(F.col("event_id") % 3 == 0, "x").otherwise((F.col("event_id") % 1000).cast("string"))
    return e.select("event_id", J.whole_number(said, -1).alias("n"), J.truncated(F.col("value")).alias("whole"))


@query("""
SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN label || '.0 ' || vec_id || '.0' WHEN 1 THEN label || '.0 ' || vec_id || '.5,' || vec_id || '.0 ' || label || '.0' ELSE '' END AS points FROM embeddings""")
def point_access(spark, sf):
    """Pairs, objects, what is neither, and no list at all."""
    a, b, k = F.col("label").cast("string"), F.col("vec_id").cast("string"), F.col("vec_id") % 4
    both = X.fill(F.lit('[{"x": A, "y": B.5}, [B, A, 7], ["a"], {"x": 1}]'.replace("A", "{a}").replace("B", "{b}")), {"a": a, "b": b})
    said = F.when(k == 0, F.concat(F.lit("[["), a, F.lit(", "), b, F.lit("]]"))).when(k == 1, both).when(k == 2, F.lit("[]")).otherwise(b)
    return table(spark, sf, "embeddings").select("vec_id", joined(F.transform(J.points(F.try_parse_json(said)), _shown)).alias("points"))


_SAID = f"[{', '.join(f"'{c}'" for c in P.CATEGORIES)}][doc_id % {len(P.CATEGORIES)} + 1]"


@query(f"SELECT doc_id, CASE WHEN n_chars % 4 = 3 THEN NULL ELSE {_SAID} END AS category FROM documents")
def classifier_parse(spark, sf):
    """Answers that are JSON, hold JSON, only name a category, or name none."""
    name, k = F.element_at(F.array(*map(F.lit, P.CATEGORIES)), (F.col("doc_id") % len(P.CATEGORIES) + 1).cast("int")), F.col("n_chars") % 4
    said = F.when(k == 0, F.concat(F.lit('{"category": "'), F.lower(name), F.lit('"}'))).when(k == 1, F.concat(F.lit('Sure {"thought": "'), F.coalesce("lang", F.lit("")), F.lit('", "category": "'), name, F.lit('"} ok'))).when(k == 2, F.concat(F.lit("I think it is "), name, F.lit(", if anything"))).otherwise(F.concat(F.lit("no idea "), F.coalesce("source", F.lit(""))))
    return table(spark, sf, "documents").select("doc_id", J.classifier_output(said).alias("category"))


@query(f"""
WITH p AS (SELECT vec_id, greatest(2, round_even(x * 1000, 0)::INT) AS a, greatest(2, round_even(y * 1000, 0)::INT) AS b FROM ({_XY}))
SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN a || ' ' || 2 * b WHEN 1 THEN a || ' ' || 2 * b || CASE WHEN a = 7 AND b = 9 THEN '' ELSE ',7 18' END ELSE '' END AS points FROM p""")
def point_tag_parse(spark, sf):
    """A point tag, one of several points with a repeat, and a text without any; images of 1001 by 2001 pixels."""
    part = lambda c: F.greatest(F.lit(2), F.rint(F.col(c) * 1000).cast("int")).cast("string")
    pair, k = F.concat(part("x"), F.lit(","), part("y")), F.col("vec_id") % 3
    said = F.when(k == 0, F.concat(F.lit("<point>"), pair, F.lit("</point>"))).when(k == 1, F.concat(F.lit("<points>"), pair, F.lit("; 7,9; "), pair, F.lit("</points>"))).otherwise("nothing")
    t = _xy(spark, sf).select("vec_id", said.alias("t"), F.lit(1001).alias("w"), F.lit(2001).alias("h"))
    return t.select("vec_id", joined(F.transform(PR.parse_points("t", "w", "h"), _shown)).alias("points"))


@query("SELECT id, t FROM (VALUES (1, 'see (208, 233)'), (2, '(200, 350)'), (3, '(1000, 0)'), (4, 'none')) t(id, t)")
def coord_rewrite(spark, sf):
    rows = [(1, "see (0.208,0.233)", 1000, 1000), (2, "(20, 35)", 1280, 720), (3, "(2000, -15)", 1000, 500), (4, "none", 5, 5)]
    return spark.createDataFrame(rows, "id int, t string, w int, h int").select("id", PR.normalise_tuples("t", "w", "h").alias("t"))


@query("""SELECT bucket, text FROM (VALUES ('anchor_digits', '11'), ('coord_digits_all', '300798'), ('coord_hundreds', '37'), ('coord_tens', '09'), ('coord_ones', '08'), ('coord_x_digits_all', '300'), ('coord_y_digits_all', '798'),
 ('coord_x_hundreds', '3'), ('coord_x_tens', '0'), ('coord_x_ones', '0'), ('coord_y_hundreds', '7'), ('coord_y_tens', '9'), ('coord_y_ones', '8'), ('fixed_field', '<points coords="1 1  "></points>'), ('label_text', 'the hand'), ('other_target_text', 'Counting the  shows a total of 1.')) t(bucket, text)""")
def target_segments(spark, sf):
    """The characters of a target text by bucket, joined in order."""
    df = spark.createDataFrame([('Counting the <points coords="1 1 300 798">the hand</points> shows a total of 1.',)], "t string")
    s = df.select("t", F.inline(PR.segment_text("t"))).withColumn("part", F.expr("substring(t, start + 1, end - start)"))
    return s.groupBy("bucket").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda x: x["part"]), "").alias("text"))


# --- stages ---


@query("""
WITH c AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'), v AS (SELECT conv_id, min(turn) FILTER (length(text) > 200) AS good, max(turn) AS last, count(*) AS turns FROM c GROUP BY conv_id)
SELECT v.conv_id, c.text AS value, good IS NOT NULL AS valid, turns FROM v JOIN c ON c.conv_id = v.conv_id AND c.turn = coalesce(good, last)""")
def first_valid_turn(spark, sf):
    """Of each session the first answer that is long enough, else the last."""
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    return W.chosen_turn(c, ["conv_id"], "turn", F.length("text") > 200, F.col("text"))


@query("""
WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, text FROM conversations WHERE role = 'assistant'),
g AS (SELECT conv_id, max(n) AS n, coalesce(bool_or(length(text) > 200), false) AS ok, arg_max(coalesce(text, ''), n) AS last FROM c GROUP BY conv_id)
SELECT conv_id, n + 1 AS turn, 'rewrite_repair_' || n AS stage, 'Session ' || conv_id || ': that was not valid, answer again.' || chr(10) || last AS prompt FROM g WHERE NOT ok AND n <= 3""")
def repair_prompts(spark, sf):
    """The next prompt of sessions without an answer that is long enough, after three turns at most."""
    from pyspark.sql import Window

    c = table(spark, sf, "conversations").where("role = 'assistant'").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    build = lambda said: X.fill(F.lit("Session {id}: that was not valid, answer again.\n{previous}"), {"id": F.col("conv_id").cast("string"), "previous": said})
    out = W.repair_prompts(c, ["conv_id"], "n", "rewrite", F.length("text") > 200, F.col("text"), build, 3)
    return out.select("conv_id", F.col("n").cast("long").alias("turn"), "stage", "prompt")


@query("""
WITH a AS (SELECT conv_id, turn, text FROM conversations), v AS (SELECT conv_id, min(turn) FILTER (contains(text, '?')) AS good, max(turn) AS last FROM a GROUP BY conv_id)
SELECT conv_id, coalesce(good, last) AS turn, CASE WHEN good IS NULL THEN 'invalid_sample_exhausted' ELSE 'valid' END AS outcome FROM v""")
def sample_retry_pick(spark, sf):
    a = table(spark, sf, "conversations").select("conv_id", "turn", F.array_compact(F.array(F.when(~F.contains("text", F.lit("?")), "no_question"))).alias("reasons"))
    return W.retry_pick(a, ["conv_id"], "turn", F.col("reasons")).select("conv_id", "turn", "outcome")


@query("""
WITH d AS (SELECT doc_id, doc_id % 8 AS k FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN 'filtered_out' WHEN 1 THEN 'filtered_out' WHEN 2 THEN 'cleaning_parse_failed' WHEN 3 THEN 'completed' WHEN 4 THEN 'filtered_out' WHEN 5 THEN 'rewrite_failed' WHEN 6 THEN 'cleaning_request_failed' ELSE 'completed' END AS status,
 CASE k WHEN 0 THEN 'cleaning' WHEN 1 THEN 'cleaning' WHEN 4 THEN 'classification' END AS filter_stage, CASE k WHEN 3 THEN 'Counting' WHEN 5 THEN 'Reasoning' WHEN 7 THEN 'Reasoning' END AS category FROM d""")
def stage_workflow_status(spark, sf):
    """The four stages over a table of responses; every eighth document takes one of eight courses."""
    k = F.col("doc_id") % 8
    d = table(spark, sf, "documents").select("doc_id", k.alias("k"))
    keep = '{"keep": true, "core_target": "cup", "reason": "ok"}'
    clean = F.when(k == 1, '{"keep": false, "core_target": "", "reason": "bad"}').when(k == 2, "what?").when(k != 6, keep)
    multi = F.when(k == 3, '{"multi_point": true, "reason": "two"}').when(k.isin(4, 5, 7), '{"multi_point": "no", "reason": "one"}')
    cls = F.when(k == 4, '{"category": "None"}').when(k.isin(5, 7), '{"category": "Reasoning"}')
    cls = F.when(k == 4, "Spatially none").otherwise(cls)
    rew = F.when(k.isin(3, 7), "Point to the cup").when(k == 5, "cup")
    each = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(1).alias("turn"), t.alias("text"), F.lit("stop").alias("finish_reason")) for s, t in (("cleaning", clean), ("multipoint", multi), ("classification", cls), ("rewrite", rew))])
    r = d.select("doc_id", F.inline(each)).where("text is not null")
    # What a classifier said but is no category ends in a filter, not in a failure to parse.
    r = r.withColumn("text", F.when((F.col("stage") == "classification") & (F.col("text") == "Spatially none"), '{"category": "spatial"}').otherwise(F.col("text")))
    out = W.statuses(d, W.stage_columns(r, ["doc_id"]), ["doc_id"], F.when(F.col("k") == 0, "missing_points_abs"), local=True, counting_enabled=True)
    return out.select("doc_id", "status", "filter_stage", "category")


@query("""SELECT d.doc_id, coalesce(l.quality, -1) AS response, l.doc_id IS NOT NULL AS from_cache FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def cache_first_merge(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    cache = table(spark, sf, "labels").select(X.cache_name(F.col("doc_id").cast("string")).alias("cache_name"), F.col("quality").alias("response"))
    return W.cache_first(d, cache, "doc_id", F.lit(-1), "doc_id").select("doc_id", "response", "from_cache")


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'missing_multipoint' ELSE 'rewrite_not_benchmark_style,session_messages_too_short_completed' END AS reasons FROM documents""")
def payload_validation(spark, sf):
    """Audit documents of three kinds against the validator."""
    from ..operators.rules import payload_reasons

    good = '{"processing": {"status": "completed", "completed_at": "2024"}, "record": {}, "cleaning": {"raw_output": "x", "parsed": {}, "keep": true, "core_target": "cup", "reason": "r"}, "multipoint": {"raw_output": "x", "parsed": {}, "multi_point": false, "reason": "r"}, "classification": {"raw_output": "x", "parsed": {}, "category": "Counting", "thought": "t"}, "rewrite": {"raw_output": "x", "rewritten_query": "Point to it"}, "session_messages": [1, 2, 3, 4, 5, 6]}'
    bad = good.replace("Point to it", "it").replace("[1, 2, 3, 4, 5, 6]", "[1, 2]")
    text = F.when(F.col("doc_id") % 3 == 0, good).when(F.col("doc_id") % 3 == 1, '{"processing": {"status": "completed"}, "record": {}, "cleaning": {}}').otherwise(bad)
    return table(spark, sf, "documents").select("doc_id", joined(payload_reasons(F.try_parse_json(text))).alias("reasons"))


@query("""
SELECT doc_id AS sample_id, CASE WHEN doc_id % 2 = 0 THEN 'filtered_out' ELSE 'completed' END AS status, doc_id % 2 = 1 AS trainable, 2::BIGINT AS history_count FROM (SELECT doc_id::VARCHAR AS doc_id_text, doc_id FROM documents)""")
def run_summary(spark, sf):
    """Two runs of each sample: a full workflow supersedes an older completed legacy one."""
    d = table(spark, sf, "documents").select("doc_id")
    legacy = '{"processing": {"status": "completed", "completed_at": "2024-03-20T00:00:00Z"}, "record": {"id": "ID", "image_path": "a.png", "width": 100, "height": 50, "points_abs": [[200, 20]]}, "classification": {"category": "Counting"}, "rewrite": {"rewritten_query": "Point to it"}}'
    full = '{"processing": {"status": "filtered_out", "completed_at": "2024-03-21T00:00:00Z", "filter_stage": "cleaning"}, "record": {"id": "ID"}, "cleaning": {"keep": false, "reason": "bad"}, "multipoint": {}, "classification": {}, "rewrite": {}}'
    ident = lambda t: F.replace(F.lit(t), F.lit("ID"), F.col("doc_id").cast("string"))
    rows = lambda t, p: d.select(F.lit(p).alias("root_name"), F.concat(F.lit(f"/{p}/a/"), "doc_id").alias("path"), F.lit("2024-01-01").cast("timestamp").alias("modified"), F.try_parse_json(t).alias("payload"))
    second = F.when(F.col("doc_id") % 2 == 0, ident(full)).otherwise(ident(legacy))
    both = V.run_tables({"old": rows(ident(legacy), "old").drop("root_name"), "new": rows(second, "new").drop("root_name")})
    return V.summarise(both).select(F.col("sample_id").cast("long"), "status", "trainable", F.col("history_count"))


@query("SELECT g.opening || ' ' || b.body AS text, (row_number() OVER (ORDER BY o, b.p)) AS n FROM (VALUES (0, 'Point to'), (1, 'Find'), (2, 'Show')) g(o, opening), (VALUES (0, 'the cup'), (1, 'a hat'), (2, 'it')) b(p, body)")
def template_cross_product(spark, sf):
    df = T.phrases(spark, ["Point to", "Find", "Show"], ["the cup", "a hat", "it"], n=9)
    return df.select("text", (F.col("pos") + 1).alias("n"))


@query("SELECT p_partkey, i::INT AS style_index, ['Point to the ', 'Find the '][i + 1] || p_name AS question FROM part, range(2) t(i)")
def template_explode(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    lines = F.array(*[X.fill(F.lit(t), {"label": F.col("p_name")}) for t in ("Point to the {label}", "Find the {label}")])
    return p.select("p_partkey", F.posexplode(lines).alias("style_index", "question"))


@query("""
WITH t(pos, text) AS (VALUES (0, 'Point to the {label}'), (1, 'Find the {label}'), (2, 'Where is the {label}?'), (3, 'Show {label}'), (4, '{missing} {label}')),
p AS (SELECT p_partkey, replace(text, '{label}', p_name) AS q, row_number() OVER (PARTITION BY p_partkey ORDER BY md5('0:' || p_partkey || ':' || pos)) AS r FROM part, t)
SELECT p_partkey AS candidate_id, (row_number() OVER (PARTITION BY p_partkey ORDER BY r) - 1)::INT AS style_index, q AS question FROM p WHERE r <= 3 AND NOT contains(q, '{missing}')""")
def template_questions(spark, sf):
    """Three templates by hash for each part, filled in."""
    lib = spark.createDataFrame([("g", k, t) for k, t in enumerate(("Point to the {label}", "Find the {label}", "Where is the {label}?", "Show {label}", "{missing} {label}"))], "group string, pos int, text string")
    c = table(spark, sf, "part").select(F.col("p_partkey").alias("candidate_id"), "p_name")
    return T.questions(c, lib, F.lit("g"), {"label": F.col("p_name")}, 3).select("candidate_id", "style_index", "question")


@query()
def seeded_orders(spark, sf):
    """Shuffles that equal those of Python's generator."""
    return table(spark, sf, "customer").select("c_custkey", joined(RNG.sample_order(F.lit(1), F.col("c_name"), F.lit(6)).cast("array<string>")).alias("order"))


@query("SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN 'C' WHEN c_nationkey % 5 = 1 THEN 'steer' ELSE 'B' END AS expert FROM customer")
def category_expert(spark, sf):
    cat = F.when(F.col("c_nationkey") % 5 == 0, "counting").when(F.col("c_nationkey") % 5 == 1, "steerability").when(F.col("c_nationkey") % 5 == 2, "reasoning").otherwise("other")
    return table(spark, sf, "customer").select("c_custkey", X.lookup(cat, P.CATEGORY_EXPERT, F.lit("B")).alias("expert"))
