"""Windows, dedup and upserts over the events table, as streams that read what is there and stop, and as their batch twins. Beyond the
prospectus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerleaf.sources.scratch import new_path
from ledgerleaf.sources.tables import table
from ledgerleaf.streaming.upserts import UpsertTable


def events(rows: DataFrame) -> DataFrame:
    """Event times as TIMESTAMP: watermarks refuse TIMESTAMP_NTZ."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(rows: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    out = rows.groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(rows: DataFrame, gap: str = "6 hours") -> DataFrame:
    out = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), "n")


def run_once(spark: SparkSession, path: str, plan: Callable[[DataFrame], DataFrame], checkpoint: str, mode: str = "complete", late: str = "1 hour") -> DataFrame:
    """plan over the Parquet files of path as a stream, to the end of what is there. mode complete: also windows that the
    watermark hasn't passed are in the result."""
    schema = spark.read.parquet(path).schema
    name = f"stream_{uuid.uuid4().hex}"
    source = events(spark.readStream.schema(schema).parquet(path)).withWatermark("ts", late)
    running = plan(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name)


def deduped(rows: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_to_table(spark: SparkSession, folder: str, plan: Callable[[DataFrame], DataFrame], mode: str = "append", late: str = "1 hour", files: int = 1, out: str | None = None) -> DataFrame:
    """plan over the Parquet files of a folder as a stream, some files a batch in order of their age, to the end of what is there. The result
    is a table that tasks write, a part for each batch, a replayed one over its own; mode complete: the last part holds all. Rows that come
    when the watermark has passed them by more than `late` are dropped."""
    out = out or new_path(spark, "stream")
    schema = spark.read.parquet(folder).schema
    source = events(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)).withWatermark("ts", late)
    shown = plan(source)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")

    running = shown.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    rows = spark.read.schema(StructType([*shown.schema.fields, *StructType.fromDDL("batch int").fields])).parquet(f"{out}/rows")
    if mode == "complete":
        rows = rows.where(F.col("batch") == (rows.agg(F.max("batch")).first()[0] or 0))
    return rows.drop("batch")


def in_files(spark: SparkSession, sf_dir: str, files: int = 4) -> str:
    """A folder with the events dealt to files by their ids: a stream's input of several batches."""
    folder = new_path(spark, "events")
    table(spark, sf_dir, "events").repartition(files, "event_id").write.parquet(folder)
    return folder


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and kind, by batches in any order."""
    folder, at = in_files(spark, sf_dir), new_path(spark, "upserts")
    kept = UpsertTable(spark, f"{at}/table", "user_id long, event_type string, event_id long, value double", ["user_id", "event_type"], order="event_id", buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    source = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 2).parquet(folder)
    kept.from_stream(source.select("user_id", "event_type", "event_id", "value"), f"{at}/checkpoint")
    return kept.read()


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(run_to_table(spark, in_files(spark, sf_dir), sessions, "complete", "36500 days", 2))


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user and kind once, when first seen."""
    return run_to_table(spark, in_files(spark, sf_dir), lambda rows: rows.dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type"), "append", "36500 days", 2)


def _plain(rows: DataFrame) -> DataFrame:
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "stream_upsert": stream_upsert,
    "stream_sessions": stream_sessions,
    "stream_dedupe": stream_dedupe,
    "ev_tumbling": lambda spark, sf_dir: _plain(tumbling(events(table(spark, sf_dir, "events")))),
    "ev_sliding": lambda spark, sf_dir: _plain(tumbling(events(table(spark, sf_dir, "events")), "2 days", "1 day")),
    "ev_session": lambda spark, sf_dir: _plain(sessions(events(table(spark, sf_dir, "events")))),
    "ev_dedupe": lambda spark, sf_dir: table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id")),
}
SQL = {
    "stream_upsert": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "stream_dedupe": "SELECT DISTINCT user_id, event_type FROM events",
    "ev_tumbling": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "ev_sliding": "SELECT (date_trunc('day', ts) - to_days(k))::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (VALUES (0), (1)) v(k) GROUP BY ALL",
    "ev_session": "WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS n FROM s GROUP BY user_id, g",
    "ev_dedupe": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
}
SQL["stream_sessions"] = SQL["ev_session"]
