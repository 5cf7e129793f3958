"""Staged processing that resumes: each stage's rows are a Parquet table beside a manifest, reused while its input's hash is the same."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def content_mark(df: DataFrame) -> str:
    """A hash of a table's rows, whatever their order."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    n, total = df.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{df.schema.simpleString()}:{n}:{total}".encode()).hexdigest()


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(stage, input_mark, done_at) of all stages done under root; empty where there is none."""
    schema = "stage string, input_mark string, done_at timestamp"
    try:
        return spark.read.schema(schema).parquet(f"{root}/_manifest")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def run(spark: SparkSession, root: str, source: DataFrame, stages: list[Stage], resume: bool = True) -> tuple[DataFrame, list[str]]:
    """source through all stages; the last one's table and the names of those that ran. A stage whose input's mark is in the
    manifest is read, not run: its data are there, since the manifest is written after them."""
    done = {(r.stage, r.input_mark) for r in manifest(spark, root).collect()} if resume else set()
    now, ran = source, []
    for name, step in stages:
        mark = content_mark(now)
        path = f"{root}/stage={name}/{mark[:16]}"
        if (name, mark) not in done:
            step(now).write.mode("overwrite").parquet(path)
            spark.range(1).select(F.lit(name).alias("stage"), F.lit(mark).alias("input_mark"), F.current_timestamp().alias("done_at")).write.mode("append").parquet(f"{root}/_manifest")
            ran.append(name)
        now = spark.read.parquet(path)
    return now, ran
