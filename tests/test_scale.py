"""Plans and operators that must not bring a whole group, or all rows, into one task."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from pointlake.operators import balance, ranking, selection, tasks, workflow
from pointlake.sources import scans, sinks


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def ties(spark):
    """Half of the rows share their first order column; groups are null, hot and cold."""
    r = random.Random(1)
    rows = [(k, "hot" if k % 3 else r.choice(["a", None]), 0.0 if k % 2 else r.random(), f"s{r.randrange(50)}") for k in range(3000)]
    return spark.createDataFrame(rows, "id long, g string, x double, s string").repartition(4)


@pytest.mark.parametrize("by", [["g"], []])
@pytest.mark.parametrize("order", [["x", "id"], ["s", "x", "id"]])
def test_rank_over_ranges(ties, by, order):
    got = ranking.rank(ties, by, order, "r", "n", n=40).collect()
    groups = {}
    for t in ties.collect():
        groups.setdefault(t["g"] if by else None, []).append(t)
    assert len(got) == 3000
    for key, rows in groups.items():
        want = {t["id"]: k for k, t in enumerate(sorted(rows, key=lambda t: tuple(t[c] for c in order)))}
        mine = {t["id"]: t["r"] for t in got if not by or t["g"] == key}
        assert mine == want and all(t["n"] == len(rows) for t in got if not by or t["g"] == key)


def test_ranges_split_ties(ties):
    bounds = ranking.ranges(ties, ["x", "id"], 40)
    sizes = [r["count"] for r in ties.withColumn("b", ranking._bucket(F.struct(F.col("x"), F.col("id")), bounds)).groupBy("b").count().collect()]
    assert len(sizes) >= 35 and max(sizes) < 300


def test_no_group_is_sorted_in_one_task(spark, ties, monkeypatch):
    """Windows over a group alone only ever have a rank limit that Spark applies before the shuffle."""
    monkeypatch.setattr(ranking, "LIMIT", 10)
    monkeypatch.setattr(selection, "LIMIT", 10)
    monkeypatch.setattr(ranking, "ROWS", 100)
    typed = ties.withColumn("task_type", F.coalesce("g", F.lit("b")))
    want = {k: 700 if k == "hot" else 20 for k in ("hot", "a")}
    quota = tasks.task_quota(typed, want, ["x", "id"])
    capped = selection.quota_cap(ties, {"a": 30}, 900, "g", ["x", "id"], "place")
    first = selection.first_per_group(ties, ["g"], ["x", "id"], 500)
    for df in (quota, capped, first):
        for line in plan(df).splitlines():
            if "row_number" in line and "windowspecdefinition" in line:
                assert "_range" in line.split("windowspecdefinition", 1)[1].split("ASC")[0], line
    rows = typed.collect()
    key = lambda t: (t["x"], t["id"])
    for kind, n in want.items():
        best = sorted((t for t in rows if t["task_type"] == kind), key=key)[:n]
        assert {t["id"] for t in quota.where(F.col("task_type") == kind).collect()} == {t["id"] for t in best}
    marks = selection.quota_marks(ties, F.col("id") % 5 > 0, 100, "g", "id").where("within_quota").collect()
    hot = sorted(t["id"] for t in rows if t["g"] == "hot" and t["id"] % 5)[:100]
    assert sorted(t["id"] for t in marks if t["g"] == "hot") == hot


def test_limits_reach_the_shuffle(ties):
    typed = ties.withColumn("task_type", F.coalesce("g", F.lit("b")))
    for df in (tasks.task_quota(typed, {"hot": 30}, ["x", "id"]), selection.quota_cap(ties, None, 20, "g", ["x", "id"]), balance.stratified(ties, ["g"], 5, F.md5(F.col("s").cast("binary")))):
        assert "WindowGroupLimit" in plan(df)


def test_one_per_image_grows_with_the_tasks_only(spark):
    kinds = tasks.P.TASK_TYPES
    rows = [(i, i, o, o % 5, f"c{i}_{o}", kinds[(i + o) % 5]) for i in range(60) for o in range(1 + i % 4)]
    df = spark.createDataFrame(rows, "image_id int, image_order int, object_order int, task_rank int, candidate_id string, task_type string")
    out = tasks.one_per_image(df, {k: 9 for k in kinds})
    assert plan(out).count("LogicalRDD") + plan(out).count("LocalRelation") <= 1
    free, won = {r[0] for r in rows}, []
    for t in sorted(kinds, key=lambda t: (tasks.P.TASK_SHARES[t], t)):
        best = {}
        for r in sorted((r for r in rows if r[5] == t and r[0] in free), key=lambda r: (r[1], r[2], r[3], r[4])):
            best.setdefault(r[0], r)
        took = sorted(best.values(), key=lambda r: (r[1], r[0]))[:9]
        won += took
        free -= {r[0] for r in took}
    assert sorted(map(tuple, out.collect())) == sorted(won)
    assert tasks.one_per_image(df, {}).count() == 0


def test_ranked_lines_counts_in_tasks(spark, tmp_path, monkeypatch):
    """Lines of all lengths, blank, not UTF-8, across splits; with and without an end of line at the end."""
    monkeypatch.setattr(scans, "BLOCK", 1 << 10)
    r = random.Random(3)
    for name, end in (("a", b""), ("b", b"\n"), ("c", b"\n\n")):
        lines = [b"x" * r.choice((0, 1, 5, 700, 3000)) + (b"\xff" if k % 50 == 0 else b"") + str(k).encode() for k in range(400)]
        lines[7], lines[8] = b"", b"y" * 9000
        (tmp_path / f"{name}.jsonl").write_bytes(b"\n".join(lines) + end)
        want = [(name, k, x.decode("utf-8", "replace")) for k, x in enumerate((b"\n".join(lines) + end).split(b"\n"), 1)]
        want = want[:-1] if not want[-1][2] else want
        for split in (1 << 10, 5000, 1 << 30):
            reader = scans._RankedReader({"path": f"{tmp_path}/{name}.jsonl", "split_bytes": str(split)})
            got = [(s, n, v) for p in reader.partitions() for s, n, _, v in reader.read(p)]
            assert got == want, (name, split)
    monkeypatch.undo()
    (tmp_path / "big").mkdir()
    (tmp_path / "big" / "d.jsonl").write_text("".join(f"{k}\n" for k in range(500_000)))
    df = scans.ranked_lines(spark, str(tmp_path / "big"), 1 << 20)
    assert df.rdd.getNumPartitions() == 4
    assert df.agg(F.count("*"), F.sum((F.col("source_rank") == F.col("value").cast("long") + 1).cast("int"))).first()[:] == (500_000, 500_000)


def test_sample_files_replace(spark, tmp_path):
    df = spark.createDataFrame([(1, "a/b", "{}"), (12345, "x", '{"k": 1}')], "rank int, id string, doc string")
    for _ in range(2):
        n = sinks.write_sample_files(df, f"file://{tmp_path}/out", F.lit("src"), F.col("rank"), F.regexp_replace("id", "[^a-z]", "_"), F.col("doc"))
        assert n == 2
    assert sorted(p.name for p in (tmp_path / "out" / "src").iterdir()) == ["0001__a_b.json", "12345__x.json"]
    assert json.loads((tmp_path / "out" / "src" / "12345__x.json").read_text()) == {"k": 1}
    with pytest.raises(Exception):
        sinks.write_files(df, f"file://{tmp_path}/out", F.lit(None), F.col("doc"))


def test_repair_prompts(spark):
    rows = [("a", 1, "bad", False), ("a", 2, "worse", False), ("b", 1, "bad", False), ("b", 2, "good", True), ("c", 1, "x", False), ("c", 2, "y", False), ("c", 3, "z", False), ("d", 1, None, None)]
    df = spark.createDataFrame(rows, "id string, turn int, text string, ok boolean")
    build = lambda said: F.concat(F.col("id"), F.lit(": not "), said)
    got = workflow.repair_prompts(df, ["id"], "turn", "cleaning", F.col("ok"), F.col("text"), build, 2).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("a", 3, "cleaning_repair_2", "a: not worse"), ("d", 2, "cleaning_repair_1", "d: not ")]
