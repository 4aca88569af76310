"""Shared pieces: the ASCII word and case rules, tables, and materialised intermediates."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = "\t\n\x0b\f\r "
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NULL_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII only take the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir.

    Where that is unset, a folder of this machine if driver and executors are one process; on a
    cluster there is no folder to fall back to, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (the master is {master!r})")
    return "file://" + os.path.join(tempfile.gettempdir(), "pointlake-shared")


#: Paths made since the innermost ``intermediates`` block was entered.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when its ``intermediates`` block or the driver ends."""
    path = f"{shared_dir(spark)}/pointlake-{label}-{uuid.uuid4().hex}"
    held = _MADE.get()
    if held is None:
        atexit.register(remove, spark, path)
    else:
        held.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone before the interpreter is
        pass


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what operators wrote to the shared folder within it. Results are lazy and read
    those files, so write or collect them inside the block."""
    token = _MADE.set([])
    try:
        yield
    finally:
        for path in _MADE.get() or ():
            remove(spark, path)
        _MADE.reset(token)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors,
    forgets the partitioning (so that AQE may split skewed joins on it)."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], spark: SparkSession, label: str) -> tuple[DataFrame, str]:
    """What ``make`` gives, written, and its path; all that was written on the way is deleted."""
    path = scratch(spark, label)
    with intermediates(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def fresh(name: str, taken: list[str]) -> str:
    """A column name that does not clash with those taken, whatever their case: underscores come before it."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def numbered(df: DataFrame, prefix: str) -> tuple[DataFrame, Callable[[str], str]]:
    """The table with its columns called prefix0, prefix1, ..., so that none clashes with another name,
    and the new name of a given one (of the same case if there is such a column, else of any)."""
    names = df.columns

    def at(name: str) -> str:
        if name in names:
            return f"{prefix}{names.index(name)}"
        return f"{prefix}{[n.lower() for n in names].index(name.lower())}"

    return df.toDF(*[f"{prefix}{k}" for k in range(len(names))]), at


def renamed(prefix: str, names: list[str]) -> list[Column]:
    """The columns of ``numbered`` under their own names."""
    return [F.col(f"{prefix}{k}").alias(n) for k, n in enumerate(names)]


def small_side(df: DataFrame, label: str, texts: list[str], most_bytes: int = 8 << 20) -> DataFrame:
    """The table, written once and measured: with a broadcast hint if it is within ``most_bytes``
    (64 bytes a row and the length of its texts), else as it is, for a shuffled join."""
    table_ = materialise(df, label)
    size = sum((F.coalesce(F.sum(F.octet_length(F.col(t))), F.lit(0)) for t in texts), F.count(F.lit(1)) * 64)
    return F.broadcast(table_) if table_.agg(size.alias("n")).first()["n"] <= most_bytes else table_


def bucket(value: Column) -> Column:
    """The value with all but its three leading digits set to 0."""
    step = F.pow(F.lit(10.0), F.greatest(F.length(value.cast("string")) - 3, F.lit(0))).cast("long")
    return value - F.pmod(value, step)
