"""A keyed table that streams and batches upsert into, and that recomputes only what has changed.

Rows are dealt to buckets by key. A batch rewrites the buckets that hold keys of its own, and no others, into a folder of its own; a commit
then names the folder of every bucket and the batch. Readers see the last commit, never half of one. A batch that is replayed, after a
failure or by hand, is known by its id and changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerleaf.sources.files import Files

HASH, BUCKET = "_hash", "_bucket"


def content(columns: Sequence[str]) -> Column:
    """SHA-256 of a row's columns; null and empty differ."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}), 256)


class UpsertTable:
    """Rows of a schema, one for each key. order: where given, a row replaces another of its key only if it is larger by it, so that late
    and reordered batches give what one batch of all rows would; else the later batch counts. Within a batch the last by order
    counts, or else the one with the largest hash. Rows whose key holds a null are skipped."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType | str, key: Sequence[str], order: str | None = None, buckets: int = 16):
        self.spark, self.folder, self.key, self.order, self.buckets = spark, folder.rstrip("/"), list(key), order, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self.files = Files(spark, folder)

    # ---- commits ----

    def commit(self) -> dict:
        """The last whole commit: number, batch (its id, by writer) and the folder of each bucket."""
        for name in reversed(self.files.names("commits")):
            try:
                return json.loads(self.files.text(f"commits/{name}"))
            except json.JSONDecodeError:  # a writer died in it
                continue
        return {"number": 0, "batches": {}, "folders": {}, "marks": None}

    def _publish(self, last: dict, folders: dict[str, str], writer: str, batch: int, marks: str) -> None:
        new = {"number": last["number"] + 1, "batches": last["batches"] | {writer: batch}, "folders": last["folders"] | folders, "marks": marks}
        if not self.files.claimed(f"commits/{new['number']:012d}.json", json.dumps(new)):
            raise RuntimeError("another writer has committed meanwhile; replay the batch")

    # ---- reading ----

    def _stored(self, folders: dict[str, str]) -> DataFrame:
        schema = StructType([*self.schema.fields, *StructType.fromDDL(f"{HASH} string").fields])
        if not folders:
            return self.spark.createDataFrame([], schema).withColumn(BUCKET, F.lit(0))
        paths = [f"{self.folder}/{at}/{BUCKET}={b}" for b, at in sorted(folders.items())]
        return self.spark.read.schema(schema).parquet(*paths).withColumn(BUCKET, self._bucket())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        return self._stored(self.commit()["folders"]).select(*self.schema.names)

    def lookup(self, **key: object) -> DataFrame:
        """The row of a key, read from its bucket alone."""
        kind = {f.name: f.dataType for f in self.schema.fields}
        one = self.spark.range(1).select(*[F.lit(key[k]).cast(kind[k]).alias(k) for k in self.key]).select(self._bucket().alias("b")).first()
        folders = self.commit()["folders"]
        own = {b: at for b, at in folders.items() if int(b) == one.b}
        rows = self._stored(own)
        for k in self.key:
            rows = rows.where(F.col(k) == F.lit(key[k]))
        return rows.select(*self.schema.names)

    def changes(self) -> DataFrame:
        """(key, change, batch) of all batches: inserted or updated. Rows that came again as they were are none."""
        last = self.commit()
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.schema.fields if f.name in self.key)
        kept = [n for n in self.files.names("changes") if n == last["marks"] or self.files.exists(f"changes/{n}/_COMMITTED")]
        if not kept:
            return self.spark.createDataFrame([], f"{kinds}, change string, batch long")
        return self.spark.read.schema(f"{kinds}, change string, batch long").parquet(*[f"{self.folder}/changes/{n}" for n in kept])

    # ---- writing ----

    def upsert(self, rows: DataFrame, batch: int, writer: str = "", derive: Callable[[DataFrame], DataFrame] | None = None, given: Sequence[str] | None = None) -> dict[str, int]:
        """Puts a batch in; how many keys were inserted and updated, both 0 for a batch that this writer has put in before. Batches of a
        writer come in order of their ids. derive: makes the table's other columns from those `given`, and runs on changed rows alone."""
        last = self.commit()
        if last["marks"]:  # what the next commit no longer names
            self.files.claimed(f"changes/{last['marks']}/_COMMITTED")
        if batch <= last["batches"].get(writer, -1):
            return {"inserted": 0, "updated": 0}
        given = list(given or self.schema.names)
        number = last["number"] + 1
        at = f"data/{number:012d}-{uuid.uuid4().hex[:8]}"
        by = [F.desc(self.order), F.desc(HASH)] if self.order else [F.desc(HASH)]
        new = rows.select(*given).where(" AND ".join(f"`{k}` IS NOT NULL" for k in self.key)).withColumn(HASH, content(given))
        new = new.withColumn("_n", F.row_number().over(Window.partitionBy(*self.key).orderBy(*by))).where("_n = 1").drop("_n").withColumn(BUCKET, self._bucket())
        staged = f"{self.folder}/staged/{number:012d}-{uuid.uuid4().hex[:8]}"
        new.write.parquet(staged)
        new = self.spark.read.schema(new.schema).parquet(staged)
        touched = [str(r[0]) for r in new.select(BUCKET).distinct().collect()]  # buckets at most
        old = self._stored({b: f for b, f in last["folders"].items() if b in touched})
        known = old.select(*self.key, F.col(HASH).alias("_was"), *([F.col(self.order).alias("_before")] if self.order else []))
        met = new.join(known, self.key, "left").where(F.col("_was").isNull() | (F.col("_was") != F.col(HASH)))
        if self.order:
            met = met.where(F.col("_was").isNull() | (F.col(self.order) > F.col("_before")) | ((F.col(self.order) == F.col("_before")) & (F.col(HASH) > F.col("_was"))))
        change = F.when(F.col("_was").isNull(), "inserted").otherwise("updated")
        marks = f"{number:012d}-{uuid.uuid4().hex[:8]}"
        met.select(*self.key, change.alias("change"), F.lit(batch).cast("long").alias("batch")).write.parquet(f"{self.folder}/changes/{marks}")
        counted = self.spark.read.schema(", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in self.schema.fields if f.name in self.key), "change string, batch long"])).parquet(f"{self.folder}/changes/{marks}")
        done = {r["change"]: r["n"] for r in counted.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
        folders: dict[str, str] = {}
        if done:
            touched = [str(r[0]) for r in counted.select(self._bucket().alias("b")).distinct().collect()]  # buckets without a change stay
            old = self._stored({b: f for b, f in last["folders"].items() if b in touched})
            fresh = new.join(counted.select(*self.key), self.key, "left_semi")
            fresh = (derive(fresh.select(*given)).join(fresh.select(*self.key, HASH), self.key) if derive else fresh).select(*self.schema.names, HASH).withColumn(BUCKET, self._bucket())
            kept = old.join(counted.select(*self.key), self.key, "left_anti").select(*self.schema.names, HASH, BUCKET)
            # a bucket's rows meet in one file's writer: as many as the table has over its buckets
            kept.unionByName(fresh).repartition(self.buckets, BUCKET).write.partitionBy(BUCKET).parquet(f"{self.folder}/{at}")
            written = {n.partition("=")[2] for n in self.files.names(at) if n.startswith(f"{BUCKET}=")}
            folders = {b: at for b in touched if b in written}
        self._publish(last, folders, writer, batch, marks)
        Files(self.spark, staged).delete()
        return {"inserted": done.get("inserted", 0), "updated": done.get("updated", 0)}

    def from_stream(self, source: DataFrame, checkpoint: str, writer: str = "stream", derive: Callable[[DataFrame], DataFrame] | None = None, given: Sequence[str] | None = None) -> None:
        """Upserts a stream's batches to the end of what is there; the stream's batch ids make replays known."""
        running = source.writeStream.foreachBatch(lambda rows, batch: self.upsert(rows, batch, writer, derive, given)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        running.awaitTermination()

    def cleanup(self, keep: int = 1) -> int:
        """Removes data that only commits before the last `keep` name, for when no reader is behind them; how many folders went."""
        names = self.files.names("commits")
        used = set()
        for name in names[-keep:]:
            used |= {f.partition("/")[2] for f in json.loads(self.files.text(f"commits/{name}"))["folders"].values()}
        gone = [n for n in self.files.names("data") if n not in used and (not names or int(n.partition("-")[0]) <= int(names[-1].partition(".")[0]))]
        for name in gone:
            self.files.delete(f"data/{name}")
        for name in names[:-keep]:
            self.files.delete(f"commits/{name}")
        return len(gone)
