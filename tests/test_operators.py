import json

import pytest
from pyspark.sql import functions as F

from pointlake.functions import jsonx as J
from pointlake.operators import balance as B
from pointlake.operators import metrics as M
from pointlake.operators import rules as R
from pointlake.operators import selection as S
from pointlake.operators import sets as ST
from pointlake.operators import tasks as T
from pointlake.operators import versions as V
from pointlake.operators import workflow as W


def payload(**change):
    doc = {
        "processing": {"status": "completed", "completed_at": "2024-01-01"}, "record": {"id": "a"}, "cleaning": {"raw_output": "x", "parsed": {}, "keep": True, "core_target": "cup", "reason": "r"},
        "multipoint": {"raw_output": "x", "parsed": {}, "multi_point": False, "reason": "r"}, "classification": {"raw_output": "x", "parsed": {}, "category": "Counting", "thought": "t"},
        "rewrite": {"raw_output": "x", "rewritten_query": "Point to it"}, "session_messages": [{}] * 6,
    }
    for path, value in change.items():
        section, _, key = path.partition("__")
        if value is None:
            doc.pop(section)
        elif key:
            doc[section][key] = value
        else:
            doc[section] = value
    return json.dumps(doc)


@pytest.mark.parametrize(("change", "want"), [
    ({}, []),
    ({"processing": None}, ["missing_processing"]),
    ({"record": None, "cleaning": None}, ["missing_record", "missing_cleaning"]),
    ({"processing__status": "running"}, ["non_terminal_status:running"]),
    ({"cleaning__keep": "true"}, ["cleaning_missing_keep", "multipoint_should_be_empty_when_cleaning_rejects"]),
    ({"cleaning__keep": False, "multipoint": {}}, ["cleaning_keep_false_but_completed"]),
    ({"cleaning__finish_reason": "length"}, ["cleaning_finish_length"]),
    ({"multipoint__multi_point": True}, ["classification_should_be_skipped_for_multipoint"]),
    ({"multipoint__multi_point": True, "classification": {"skipped_for_multipoint": True, "category": "Counting", "thought": "t", "finish_reason": "skipped"}}, []),
    ({"multipoint__multi_point": True, "classification": {"skipped_for_multipoint": True, "category": "Affordance", "thought": "t", "raw_output": "x"}}, ["multipoint_forced_category_invalid:Affordance", "classification_raw_should_be_empty_when_skipped"]),
    ({"classification__category": "Other"}, ["classification_invalid_category:Other"]),
    ({"classification__allowed_categories": ["affordance"]}, ["classification_invalid_category:Counting"]),
    ({"rewrite__rewritten_query": "Show it"}, ["rewrite_not_benchmark_style"]),
    ({"session_messages": [1]}, ["session_messages_too_short_completed"]),
])
def test_payload_validator(spark, change, want):
    got = spark.createDataFrame([(payload(**change),)], "j string").select(R.payload_reasons(F.try_parse_json("j"))).first()[0]
    assert got == want


def test_payload_validator_of_other_things(spark):
    df = spark.createDataFrame([("[1]",), ("nope",)], "j string")
    assert [r[0] for r in df.select(R.payload_reasons(F.try_parse_json("j"))).collect()] == [["payload_not_dict"]] * 2


def test_local_validator(spark):
    doc = payload(multipoint__multi_point=True, classification__category="Affordance")
    df = spark.createDataFrame([(doc,)], "j string")
    assert "multipoint_true_should_filter_out" in df.select(R.payload_reasons(F.try_parse_json("j"), local=True)).first()[0]


@pytest.mark.parametrize(("label", "want"), [
    ("", "empty_label"), ("a" * 71, "label_too_long"), ("www.x", "text_artifact_or_url"), ("it's", "caption_like_punctuation"), ("42", "numeric_only_label"), ("x", "single_character_label"), ("cup 3", "numeric_phrase_label"),
    ("where cups go", "qa_or_functional_phrase"), ("brick wall", "stuff_label"), ("top shelfy", "spatial_label"), ("blue logo", "text_like_label"), ("bright glare", "appearance_artifact_label"), ("red thing", "generic_head_noun"),
    ("one two three four five", "too_many_tokens"), ("red", "attribute_only_label"), ("food", "abstract_category_label"), ("sit here", "functional_phrase"), ("cup of tea", "relational_phrase"), ("The_red/cup", None),
])
def test_label_gate(spark, label, want):
    assert spark.createDataFrame([(label,)], "x string").select(R.label_reason(F.col("x"))).first()[0] == want


def test_quotas_and_prefix_by_loops(spark):
    rows = [(f"s{k % 3}", k) for k in range(60)]
    df = spark.createDataFrame(rows, "source string, n int")
    got = [(r["source"], r["source_rank"]) for r in S.quota_cap(df, {"s0": 4, "s1": 0}, 10, order=["n"]).orderBy("source", "source_rank").collect()]
    assert got == [("s0", k) for k in range(1, 5)] + [("s2", k) for k in range(1, 7)]
    for want, hits in ((0, 5), (3, 5), (7, 100)):
        cond = F.col("n") % 7 == want
        seen, found = [], 0
        for _, k in rows:
            seen.append(k)
            found += k % 7 == want
            if found >= hits:
                break
        assert sorted(r["n"] for r in S.prefix_until(df, cond, ["n"], hits).collect()) == seen
    marks = S.quota_marks(df, F.col("n") % 2 == 0, 3, "source", "n").where("within_quota").groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in marks} == {"s0": 3, "s1": 3, "s2": 3}


def test_resume_and_rerun(spark):
    jobs = spark.createDataFrame([("a", k) for k in range(1, 6)] + [("b", k) for k in range(1, 4)], "source string, source_rank int")
    done = S.frontier(jobs.where("source = 'a' and source_rank <= 3"))
    left = {(r["source"], r["source_rank"]) for r in S.resume_after(jobs, done).collect()}
    assert left == {("a", 4), ("a", 5), ("b", 1), ("b", 2), ("b", 3)}
    back = S.frontier(jobs.where("source = 'a' and source_rank >= 4"), reverse=True)
    assert {(r["source"], r["source_rank"]) for r in S.resume_before(jobs, back).collect()} == {("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("b", 3)}
    assert S.unfinished(jobs, jobs, ["source", "source_rank"], F.lit(True)).count() == 0
    keys = spark.createDataFrame([("x",), ("",), (None,)], "k string")
    assert [r["id"] for r in S.exclude(spark.createDataFrame([(1, "x"), (2, ""), (3, None), (4, "y")], "id int, k string"), keys, F.col("k"), "k").orderBy("id").collect()] == [2, 3, 4]
    assert ST.split(jobs, F.col("source_rank") > 2)[0].count() + ST.split(jobs, F.col("source_rank") > 2)[1].count() == jobs.count()


def audits(spark, rows):
    return spark.createDataFrame(rows, "root_name string, path string, t string").select("root_name", "path", F.lit("2020-01-01").cast("timestamp").alias("modified"), F.try_parse_json("t").alias("payload"))


def test_merge_of_runs(spark):
    legacy = lambda i, when, **r: json.dumps({"processing": {"status": "completed", "completed_at": when}, "record": {"id": i, "image_path": "a.png", **r}, "classification": {"category": "object reference"}, "rewrite": {"rewritten_query": "Point to the cup"}})
    full = json.dumps({"processing": {"status": "filtered_out", "filter_stage": "cleaning", "completed_at": "2026-03-21T00:00:00Z"}, "record": {"id": "dup"}, "cleaning": {"parsed": {"keep": False, "reason": "bad"}}, "multipoint": {}, "classification": {}, "rewrite": {}})
    rows = [
        ("r1", "/r1/s/1.json", legacy("dup", "2026-03-20T00:00:00Z", width=100, height=50, points_abs=[[1, 2]])), ("r2", "/r2/s/1.json", full), ("r1", "/r1/s/2.json", legacy("only", "2026-03-20T00:00:00Z", width=100, height=50, points_abs=[[14, 22], {"x": 500, "y": -3}])),
        ("r1", "/r1/s/3.json", legacy("norm", "2026-03-20T00:00:00Z", target={"points": [[0.5, 0.5]], "point_format": "xy_norm_01", "image_size": [101, 51]})), ("r1", "/r1/s/4.json", legacy("bare", "bad time")), ("r1", "/r1/s/5.json", "[1]"), ("r1", "/r1/s/6.json", "broken"),
    ]
    got = {r["sample_id"]: r for r in V.summarise(audits(spark, rows)).collect()}
    assert set(got) == {"dup", "only", "norm", "bare"}
    assert (got["dup"]["status"], got["dup"]["trainable"], got["dup"]["history_count"]) == ("filtered_out", False, 2)
    pts = lambda i: [(p["x"], p["y"]) for p in got[i]["row"]["points"]]
    assert pts("only") == [(14.0, 22.0), (99.0, 0.0)] and pts("norm") == [(50.0, 25.0)]
    assert got["only"]["category"] == "Object Reference" and got["only"]["trainable"] and not got["bare"]["trainable"]
    counts = {(r["what"], r["key"]): r["n"] for r in V.summary_counts(V.summarise(audits(spark, rows))).collect()}
    assert counts[("trainable", "true")] == 2 and counts[("status", "completed")] == 3


def test_balance(spark):
    assert B.integer_weights({"a": 0.5, "b": 1, "c": 0}) == {"a": 1, "b": 2}
    with pytest.raises(ValueError):
        B.integer_weights({"a": 0})
    df = spark.createDataFrame([("o", k) for k in range(4)] + [("r", k) for k in range(2)], "category string, id int")
    q = {r["category"]: r["quota"] for r in B.quotas(df, "category", {"o": 1, "r": 1}).collect()}
    assert q == {"o": 2, "r": 2}
    pool = B.pools(df, "category", ["id"])
    seen = []
    offset = 0
    for _ in range(3):
        active = B.rotate(pool, F.col("pool_index"), F.col("pool_size"), F.lit(2), F.when(F.col("category") == "o", offset).otherwise(0)).where("active")
        seen.append({r["id"] for r in active.where("category = 'o'").collect()})
        assert active.where("category = 'r'").count() == 2
        offset = spark.range(1).select(B.next_offset(F.lit(offset), F.lit(4), F.lit(2))).first()[0]
    assert seen == [{0, 1}, {2, 3}, {0, 1}]
    draws = B.weighted_draws(df, "id", "category", 1.0, 4000, 9).groupBy("category").count().collect()
    assert all(r["count"] == pytest.approx(2000, abs=200) for r in draws)


def test_leaderboard(spark):
    schema = "step int, overall double, reasoning double, steerability double, ckpt string"
    board = spark.createDataFrame([], schema)
    for step, o, r, s in ((200, 60.0, 40.0, 30.0), (400, 61.0, 35.0, 30.0), (600, 61.0, 45.0, 10.0), (800, 50.0, 50.0, 50.0)):
        board = M.leaderboard(board, spark.createDataFrame([(step, o, r, s, f"c{step}")], schema), "ckpt", 2)
    assert [r["step"] for r in board.collect()] == [600, 400]


OBJECTS = "image_id string, object_id string, object_order int, same_class_key string, center_x double, center_y double"


def test_anchors_and_sectors(spark):
    objs = spark.createDataFrame([("i", "t", 0, "cup", 100.0, 100.0), ("i", "ok", 1, "hat", 50.0, 100.0), ("i", "d1", 2, "pen", 40.0, 100.0), ("i", "d2", 3, "pen", 60.0, 100.0), ("i", "off", 4, "key", 50.0, 150.0)], OBJECTS)
    got = T.other_class_anchors(objs).where("object_id = 't' and direction = 'right'").collect()
    assert [(r["anchor_id"], r["distance_px"]) for r in got] == [("ok", 50.0)]
    same = spark.createDataFrame([("i", "target", 0, "cup", 150.0, 100.0), ("i", "near", 1, "cup", 130.0, 110.0), ("i", "behind", 2, "cup", 60.0, 100.0)], OBJECTS)
    a = spark.createDataFrame([("i", "target", 100.0, 100.0, "right")], "image_id string, object_id string, ax double, ay double, direction string")
    r = T.sector_nearest(same, a).first()
    assert (r["pass"], r["blocking_ids"], r["distance_px"], r["n_sector"]) == (False, ["near"], 50.0, 1)
    assert T.sector_nearest(same.where("object_id <> 'near'"), a).first()["pass"]
    alone = T.same_class_nearest(same.where("object_id = 'target'"), a.drop("direction")).first()
    assert alone["pass"] and alone["second_dist"] is None
    assert not T.same_class_nearest(same, a.drop("direction")).first()["pass"]


def test_mix_of_tasks(spark):
    assert T.targets_for(10_000) == {"move_until_axis_fixed": 8500, "nearest_among_objects": 500, "nearest_among_objects_axis_constrained": 500, "move_then_axis_limited_fixed": 250, "move_until_axis_from_other_object": 250}
    rows = [("c1", "i1", "move_until_axis_fixed", 0, 0, 0), ("c2", "i1", "nearest_among_objects", 0, 0, 3), ("c3", "i2", "move_until_axis_fixed", 1, 0, 0), ("c4", "i2", "move_then_axis_limited_fixed", 1, 0, 2), ("c5", "i3", "move_until_axis_fixed", 2, 0, 0), ("c6", "i4", "nearest_among_objects_axis_constrained", 3, 0, 4)]
    df = spark.createDataFrame(rows, "candidate_id string, image_id string, task_type string, image_order int, object_order int, task_rank int")
    left = {"move_until_axis_fixed": 10, "nearest_among_objects": 1, "nearest_among_objects_axis_constrained": 1, "move_then_axis_limited_fixed": 1, "move_until_axis_from_other_object": 0}
    assert sorted(r["candidate_id"] for r in T.one_per_image(df, left).collect()) == ["c2", "c4", "c5", "c6"]
    new = T.renumber(df, "image_id", "image_order", 5).select("image_id", "new_order").distinct().orderBy("new_order").collect()
    assert [(r["image_id"], r["new_order"]) for r in new] == [("i1", 5), ("i2", 6), ("i3", 7), ("i4", 8)]
    with pytest.raises(ValueError):
        T.phrases(spark, ["a"], ["b"], n=2)


def test_objects(spark):
    rec = [("i", "p", 100, 50, "r1", "Red_Cup", "", k, x, 0.5) for k, x in enumerate((0.1, 0.2, 1.5))] + [("i", "p", 100, 50, "r2", "wall", "wall", 9, 0.5, 0.5), ("i", "p", 100, 50, "r3", "hat", "hat", 10, 0.5, 0.25)]
    rec += [("j", "p", 10, 10, f"q{k}", "hat", "hat", k, 0.5, 0.5) for k in range(3)]
    df = spark.createDataFrame(rec, "image_id string, image_path string, image_width int, image_height int, row_id string, label_raw string, label_clean string, pos int, point_x_norm double, point_y_norm double")
    got = {(r["image_id"], r["row_id"]): r for r in T.objects(df, most_objects=2 + 1).collect()}
    assert got[("i", "r1")]["drop_reason"] == "multi_point_spread_too_large" and got[("i", "r2")]["drop_reason"] == "stuff_label"
    kept = got[("i", "r3")]
    assert (kept["drop_reason"], kept["object_order"], kept["center_x"], kept["center_y"], kept["same_class_key"]) == (None, 0, 50.0, 12.5, "hat")
    crowd = T.objects(df, most_objects=2).where("image_id = 'j'").collect()
    assert [r["drop_reason"] for r in crowd] == ["too_many_raw_objects_in_image"]
    groups = T.label_groups(T.objects(df).where("drop_reason is null").withColumn("object_id", F.col("row_id"))).where("image_id = 'j'").first()
    assert (groups["label_group_id"], groups["object_ids"], len(groups["points"])) == ("label_000", ["q0", "q1", "q2"], 3)


def test_workflow_retries(spark):
    r = spark.createDataFrame([(1, "cleaning", 1, "junk", "stop"), (1, "cleaning", 2, '{"keep": false, "reason": "x"}', "stop"), (2, "cleaning", 1, '{"keep": true, "core_target": "a", "reason": "x"}', "length")], "id int, stage string, turn int, text string, finish_reason string")
    s = W.stage_columns(r, ["id"])
    out = {x["id"]: x for x in W.statuses(spark.createDataFrame([(1,), (2,), (3,)], "id int"), s, ["id"]).collect()}
    assert (out[1]["status"], out[1]["filter_stage"]) == ("filtered_out", "cleaning")
    assert out[2]["status"] == "cleaning_parse_failed" and out[3]["status"] == "cleaning_request_failed"
    pick = W.chosen_turn(r.where("id = 1"), ["id"], "turn", J.cleaning_output(F.col("text")).isNotNull(), F.col("text")).first()
    assert pick["valid"] and "keep" in pick["value"]


def test_cache_hits(spark):
    from pointlake.functions import text as X

    req = spark.createDataFrame([(1, "u"), (2, "u"), (3, "v")], "ord int, uid string")
    cache = spark.createDataFrame([("v", "hit")], "uid string, response string").select(X.cache_name(F.col("uid")).alias("cache_name"), "response")
    got = {r["ord"]: (r["response"], r["from_cache"]) for r in W.cache_first(req, cache, "uid", F.lit("new"), "ord").collect()}
    assert got == {1: ("new", False), 2: ("new", True), 3: ("hit", True)}


def test_responder(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    got = T.answers(df, lambda pdf: pdf.assign(text=pdf["id"].astype(str) + "!"), "id int, text string").collect()
    assert sorted(r["text"] for r in got) == ["1!", "2!"]


def test_split_of_template_library(spark):
    df = spark.createDataFrame([("g", 0, "Use a guide"), ("g", 1, "Use a guide"), ("g", 2, "fine {label}")], "group string, pos int, text string")
    got = {r["pos"]: r["reasons"] for r in R.filter_templates(df).collect()}
    assert got == {0: ["guide_wording"], 1: ["duplicate"], 2: []}


def test_rank_without_a_task_for_each_group(spark):
    from pointlake.operators.ranking import rank

    rows = [("hot" if k % 3 else "cold", k * 7919 % 1000, k) for k in range(1000)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    for n in (1, 2, 16, 300):
        got = {r["id"]: (r["at"], r["all"]) for r in rank(df, ["g"], ["v", "id"], "at", "all", n).collect()}
        for g in ("hot", "cold"):
            own = sorted((v, i) for h, v, i in rows if h == g)
            assert [got[i] for _, i in own] == [(k, len(own)) for k in range(len(own))]
    assert rank(df.limit(0), ["g"], ["v", "id"], "at").count() == 0
    whole = rank(df, [], ["v", "id"], "at").orderBy("at").collect()
    assert [r["at"] for r in whole] == list(range(1000)) and [(r["v"], r["id"]) for r in whole] == sorted((v, i) for _, v, i in rows)


def test_families(spark):
    from pointlake.functions import geometry as G
    from pointlake.operators import families as FA

    rows = [(0, k, 0, k, f"k{k % 3}" if k < 6 else f"u{k}", 100.0 + 90 * k, 150.0 + 60 * (k % 4), 1000, 800) for k in range(8)]
    objs = spark.createDataFrame(rows, "image_id int, object_id int, image_order int, object_order int, same_class_key string, center_x double, center_y double, width int, height int")
    got = FA.all_families(objs, dict.fromkeys(FA.P.TASK_TYPES, 100)).collect()
    kinds = {r["task_type"] for r in got}
    assert {"move_until_axis_fixed", "move_then_axis_limited_fixed", "nearest_among_objects"} <= kinds
    assert len({(r["task_type"], r["object_id"]) for r in got}) == len(got)
    straight = FA.moves(objs, 42).join(objs.select("object_id", "center_x", "center_y"), "object_id")
    off = straight.where(~G.matches(F.col("ax"), F.col("ay"), F.col("center_x"), F.col("center_y"), F.col("direction_text"), 10.5))
    assert straight.count() == 8 and off.count() == 0
    assert FA.all_families(objs, {"move_until_axis_fixed": 3}).count() == 3
    assert {r["object_id"] for r in FA.drops(objs).collect()} == {6, 7}


def test_stages_start_anywhere(spark, tmp_path):
    from pointlake.plans.stages import run_stages

    stages = [("one", lambda s, d: d.withColumn("a", F.lit(1))), ("two", lambda s, d: d.withColumn("b", F.col("a") + 1))]
    assert run_stages(spark, spark.range(3), stages, str(tmp_path)).columns == ["id", "a", "b"]
    assert run_stages(spark, None, stages, str(tmp_path), "two").count() == 3
    with pytest.raises(ValueError):
        run_stages(spark, None, stages, str(tmp_path))
