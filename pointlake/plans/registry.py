"""Queries by name, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        FOUND[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(words: str) -> str:
    """A pattern for whole words that Java's and RE2's regular expressions agree on for all letters."""
    return r"(^|[^\p{L}\p{N}_])(" + words + r")([^\p{L}\p{N}_]|$)"


def joined(values):
    """A list as text: results stay flat."""
    from pyspark.sql import functions as F

    return F.array_join(values, ",")


def work_folder(spark: SparkSession) -> str:
    """A new folder that all executors see: under spark.checkpoint.dir, or a temporary one where driver
    and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="pointlake-work-")
    atexit.register(shutil.rmtree, own, True)
    return f"file://{own}"
