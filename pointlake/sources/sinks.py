"""Sinks: JSON lines, single documents, partitioned samples, CSV, logs, reports, caches."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """The number of rows, counted while they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(path)
    return seen.get["n"]


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, by a temporary name and a rename."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    final, early = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs = final.getFileSystem(conf)
    out = fs.create(early, True)
    out.write(bytearray(text.encode()))
    out.close()
    # One rename that replaces what is there: a reader sees the old document or the new one.
    how = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(how, 1)
    over[0] = how.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(early, final, over)


def write_document(spark: SparkSession, path: str, payload: object) -> None:
    _write_text(spark, path, json.dumps(payload, ensure_ascii=False, indent=2) + "\n")


def write_report(df: DataFrame, path: str) -> None:
    """A result of a few rows as one document."""
    write_document(df.sparkSession, path, [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).collect()])


def sample_file(source: Column, rank: Column, safe_id: Column) -> Column:
    return F.concat(source, F.lit("/"), F.format_string("%04d__%s.json", rank, safe_id))


def write_samples(df: DataFrame, path: str, source: str = "source", mode: str = "append") -> None:
    """Samples in files of many rows, by source: for runs whose single documents nothing looks up."""
    df.write.mode(mode).partitionBy(source).json(path)


def write_files(df: DataFrame, folder: str, name: Column, content: Column) -> int:
    """One file for each row, ``name`` (of parts joined by /) under the folder; how many were written.

    Tasks write under a name of their own and rename, so a file is whole or not there, and a task that
    runs again replaces what it wrote. Names are unique; a null name or content is an error.
    """

    def write(it):
        from pyspark import TaskContext

        from .scans import _open

        own, root = _open(folder)
        task, n, made = TaskContext.get().taskAttemptId(), 0, set()
        for b in it:
            for at, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if at is None or data is None:
                    raise ValueError("a file needs a name and content")
                parent, _, last = f"{root.rstrip('/')}/{at}".rpartition("/")
                if parent not in made:
                    own.create_dir(parent, recursive=True)
                    made.add(parent)
                early = f"{parent}/.{last}.{task}.tmp"
                with own.open_output_stream(early, compression=None) as f:
                    f.write(data)
                own.move(early, f"{parent}/{last}")
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    rows = df.select(name.cast("string").alias("name"), content.cast("binary").alias("content"))
    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def write_sample_files(df: DataFrame, root: str, source: Column, rank: Column, safe_id: Column, payload: Column) -> int:
    """<root>/<source>/<rank>__<id>.json for each sample: what resuming looks up."""
    return write_files(df, root, sample_file(source, rank, safe_id), payload)


def write_csv(df: DataFrame, path: str) -> None:
    """A small index in one file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def fail_cases(df: DataFrame, truth: str, said: str, status: str, columns: Sequence[str]) -> DataFrame:
    """Tab-separated lines of rows that are wrong or not ok."""
    bad = ~F.col(truth).eqNullSafe(F.col(said)) | (F.col(status) != "ok")
    return df.where(bad).select(F.concat_ws("\t", *[F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[\t\n]", " "), F.lit("")) for c in columns]).alias("value"))


def markdown_table(df: DataFrame) -> str:
    """Of a small result."""
    show = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    rows = [df.columns, ["---"] * len(df.columns), *[[show(v) for v in r] for r in df.collect()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows) + "\n"


def write_markdown(spark: SparkSession, path: str, title: str, sections: dict[str, DataFrame]) -> None:
    _write_text(spark, path, f"# {title}\n\n" + "\n".join(f"## {k}\n\n{markdown_table(v)}" for k, v in sections.items()))


def group_ordered(df: DataFrame, group: Column, order: Sequence[str], groups: Sequence[str] = ("C", "B", "steer")) -> DataFrame:
    """Rows by group in the given order, stable inside."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, groups)), group), F.lit(0))
    return df.orderBy(F.when(rank == 0, len(groups) + 1).otherwise(rank), *order)


def cached_table(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The table at the path, built first where there is none or it is to be rebuilt."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if rebuild or not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
