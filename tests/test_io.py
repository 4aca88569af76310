import json

import pytest
from pyspark.sql import functions as F

from pointlake.sources import scans, sinks
from pointlake.streaming import jobs


def test_ranked_lines(spark, tmp_path):
    for name, n in (("b", 5), ("a", 700)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"id": f"{name}{k}é"}) + "\n" for k in range(1, n + 1)) + ("" if n == 5 else '{"id": "last"}'))
    (tmp_path / "notes.txt").write_text("no")
    got = scans.ranked_records(spark, str(tmp_path), "id string").orderBy("source", "source_rank").collect()
    assert [r["source_rank"] for r in got] == [*range(1, 702), *range(1, 6)] and got[700]["record"]["id"] == "last"
    reader = scans._RankedReader({"path": str(tmp_path), "split_bytes": "2000000"})
    whole = [x for p in reader.partitions() for x in reader.read(p)]
    big = tmp_path / "big"
    big.mkdir()
    (big / "c.jsonl").write_text("".join(f"{k}\n" for k in range(400_000)))
    parts = scans._RankedReader({"path": str(big), "split_bytes": "300000"})
    lines = [x for p in parts.partitions() for x in parts.read(p)]
    assert len(parts.partitions()) == 3 and [x[1] for x in lines] == list(range(1, 400_001)) and all(int(x[3]) == x[1] - 1 for x in lines)
    assert len(whole) == 706


def test_audit_scan(spark, tmp_path):
    for root in ("run1", "tmp_x", "smoke_run", "empty"):
        (tmp_path / root / "src").mkdir(parents=True)
        if root != "empty":
            (tmp_path / root / "src" / "1.json").write_text('{"a": 1}')
    (tmp_path / "run1" / "src" / "2.json").write_text("{broken")
    assert scans.discover_roots(spark, f"file://{tmp_path}") == ["run1"]
    got = {r["path"].rsplit("/", 1)[-1]: (r["root_name"], r["reason"]) for r in scans.audits(spark, f"file://{tmp_path}/run1").collect()}
    assert got == {"1.json": ("run1", None), "2.json": ("run1", "file_read_or_json_error")}
    assert scans.unique_paths(["a/", "b", "a"]) == ["a", "b"]


def test_small_sources(spark, tmp_path):
    (tmp_path / "lib.json").write_text(json.dumps({"g": ["a", " ", " b "], "h": []}))
    assert [(r["group"], r["pos"], r["text"]) for r in scans.template_library(spark, str(tmp_path / "lib.json")).collect()] == [("g", 0, "a"), ("g", 2, "b")]
    d = tmp_path / "labels"
    d.mkdir()
    (d / "cup.txt").write_text(" one \n\ntwo\n")
    assert sorted(tuple(r) for r in scans.labelled_lines(spark, str(d), {"cup.txt": "Cup"}).collect()) == [("Cup", "one"), ("Cup", "two")]
    (tmp_path / "k.csv").write_text("image_filename,x\na.png,1\na.png,2\n")
    assert [r[0] for r in scans.csv_keys(spark, str(tmp_path / "k.csv"), "image_filename").collect()] == ["a.png"]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\nnope\n')
    with pytest.raises(Exception):
        scans.json_lines(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    names = spark.createDataFrame([("cup.txt",), ("hat.txt",)], "name string")
    assert [r[0] for r in scans.missing_files(spark, names, str(d)).collect()] == ["hat.txt"]


def test_first_appearance(spark, tmp_path):
    spark.createDataFrame([(k, f"i{k % 3}") for k in (5, 1, 0, 4, 2)], "k int, image string").coalesce(1).write.parquet(str(tmp_path / "p"))
    got = scans.first_appearance(spark.read.parquet(str(tmp_path / "p")), "image").orderBy("pos").collect()
    assert [r["image"] for r in got] == ["i2", "i1", "i0"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b", "x", "x", "ok"), (2, "c", "x", "y", "ok"), (3, "d", "x", "x", "err")], "id int, s string, truth string, said string, status string")
    assert sinks.write_json_lines(df, str(tmp_path / "j")) == 3
    sinks.write_document(spark, f"file://{tmp_path}/doc.json", {"a": 1})
    sinks.write_document(spark, f"file://{tmp_path}/doc.json", {"a": 2})
    assert json.loads((tmp_path / "doc.json").read_text()) == {"a": 2} and not (tmp_path / "doc.json.tmp").exists()
    sinks.write_report(df.select("id"), f"file://{tmp_path}/rep.json")
    assert len(json.loads((tmp_path / "rep.json").read_text())) == 3
    assert sorted(r[0] for r in sinks.fail_cases(df, "truth", "said", "status", ["id", "said"]).collect()) == ["2\ty", "3\tx"]
    assert "a\\|b" in sinks.markdown_table(df)
    sinks.write_markdown(spark, f"file://{tmp_path}/r.md", "Report", {"Rows": df})
    assert (tmp_path / "r.md").read_text().startswith("# Report\n\n## Rows")
    sinks.write_samples(df.withColumn("source", F.lit("s")), str(tmp_path / "samples"))
    assert spark.read.json(str(tmp_path / "samples")).count() == 3
    sinks.append_log(df, str(tmp_path / "log"))
    sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6
    calls = []
    build = lambda: calls.append(1) or df
    for rebuild in (False, False, True):
        assert sinks.cached_table(spark, str(tmp_path / "cache"), build, rebuild).count() == 3
    assert len(calls) == 2


EVENTS = "event_id long, ts timestamp_ntz, kind string"


def feed(spark, folder, part, rows):
    df = spark.createDataFrame(rows, "event_id long, t string, kind string").select("event_id", F.col("t").cast("timestamp_ntz").alias("ts"), "kind")
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/part{part}")


def source(spark, folder):
    schema = spark.createDataFrame([], EVENTS).schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def test_stream_resumes(spark, tmp_path):
    data, work = str(tmp_path / "data"), str(tmp_path / "work")
    feed(spark, data, 1, [(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 00:01:00", "b")])
    one = {r["kind"]: r["n"] for r in jobs.counts(spark, source(spark, data), ["kind"], work).collect()}
    feed(spark, data, 2, [(3, "2024-01-01 00:02:00", "a")])
    two = {r["kind"]: r["n"] for r in jobs.counts(spark, source(spark, data), ["kind"], work).collect()}
    three = {r["kind"]: r["n"] for r in jobs.counts(spark, source(spark, data), ["kind"], work).collect()}
    assert one == {"a": 1, "b": 1} and two == three == {"a": 2, "b": 1}


def test_stream_stops_early(spark, tmp_path):
    data = str(tmp_path / "data")
    for k in range(3):
        feed(spark, data, k, [(k, "2024-01-01 00:00:00", "a")])
    got = jobs.until_reached(spark, source(spark, data), "kind", {"a": 1}, str(tmp_path / "work")).collect()
    assert got[0]["n"] >= 1


def test_stream_windows(spark, tmp_path):
    data, work = str(tmp_path / "data"), str(tmp_path / "work")
    feed(spark, data, 1, [(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 00:09:00", "a"), (3, "2024-01-01 00:11:00", "a")])
    w = jobs.windowed(source(spark, data), "ts", ["kind"])
    jobs.run_once(w, f"{work}/c", jobs.merged_table(spark, f"{work}/t", ["start", "kind"], "n"))
    got = jobs.current(spark, f"{work}/t", ["start", "kind"], [F.col("n")]).orderBy("start").collect()
    assert [r["n"] for r in got] == [2, 1]
