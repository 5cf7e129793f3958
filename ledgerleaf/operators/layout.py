"""A store of tables laid out by document: partitions that writes touch one by one, and buckets that joins by document need no exchange for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.operators.store import deleted, updated, upserted
from ledgerleaf.sources.files import Files
from ledgerleaf.sources.scratch import written

PART = "_part"  # a partition column that rows get, by hash of the document


class DocumentStore:
    """Tables of rows with a document column, each under a folder of its own. All have the same partitions and buckets, by document. A write
    stages the new rows of the partitions that it touches in the shared folder and then replaces these and no others; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, name: str, document: str = "document_id", partitions: int = 16, buckets: int = 8):
        self.spark, self.folder, self.name, self.document, self.partitions, self.buckets = spark, folder.rstrip("/"), name, document, partitions, buckets

    def table(self, table: str) -> str:
        return f"{self.name}_{table}"

    def part_of(self, document: Column) -> Column:
        return F.pmod(F.xxhash64(document), F.lit(self.partitions)).cast("int")

    def create(self, table: str, rows: DataFrame) -> None:
        """Makes the table of these rows, in place of any before it. Rows without a document are refused by a ValueError."""
        if not rows.where(F.col(self.document).isNull()).isEmpty():
            raise ValueError("every row needs a document")
        out = rows.withColumn(PART, self.part_of(F.col(self.document))).repartition(self.partitions * 2, PART, F.pmod(F.hash(self.document), F.lit(self.buckets)))
        out.write.partitionBy(PART).bucketBy(self.buckets, self.document).sortBy(self.document).option("path", f"{self.folder}/{table}").mode("overwrite").saveAsTable(self.table(table))

    def read(self, table: str) -> DataFrame:
        """All rows; joins of two tables of a store by document need no exchange."""
        return self.spark.table(self.table(table)).drop(PART)

    def of_document(self, table: str, *documents: object) -> DataFrame:
        """Rows of some documents, read from their partitions alone."""
        rows = self.spark.table(self.table(table))
        kind = rows.schema[self.document].dataType
        some = self.spark.createDataFrame([(d,) for d in documents], f"d {kind.simpleString()}").select(self.part_of(F.col("d")).alias("p")).distinct().collect()
        return rows.where(F.col(PART).isin([r.p for r in some]) & F.col(self.document).isin(list(documents))).drop(PART)

    def _replace(self, table: str, touched: Sequence[int], rows: DataFrame) -> None:
        """rows, of the partitions touched, in place of what these hold."""
        whole = self.spark.table(self.table(table))
        staged = written(rows.withColumn(PART, self.part_of(F.col(self.document))).select(*whole.columns), "staged")
        left = {r[0] for r in staged.select(PART).distinct().collect()}  # partitions at most
        if left:
            mode = "spark.sql.sources.partitionOverwriteMode"  # which insertInto takes from the session alone
            before = self.spark.conf.get(mode)
            self.spark.conf.set(mode, "dynamic")
            try:
                staged.repartition(PART, F.pmod(F.hash(self.document), F.lit(self.buckets))).write.mode("overwrite").insertInto(self.table(table))
            finally:
                self.spark.conf.set(mode, before)
        files = Files(self.spark, f"{self.folder}/{table}")
        for p in sorted(set(touched) - left):  # emptied
            files.delete(f"{PART}={p}")
        self.spark.catalog.refreshTable(self.table(table))

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self.part_of(F.col(self.document)).alias("p")).where("p IS NOT NULL").distinct().collect())

    def _rows(self, table: str, touched: Sequence[int]) -> DataFrame:
        return self.spark.table(self.table(table)).where(F.col(PART).isin(list(touched))).drop(PART)

    def upsert(self, table: str, rows: DataFrame, key: str) -> int:
        """Puts rows in, in place of those of the same document and key; how many partitions that rewrote. Of rows that share both, one counts."""
        rows = written(rows.dropDuplicates([self.document, key]), "new")
        touched = self._touched(rows)
        old = self._rows(table, touched).withColumn("_key", F.struct(self.document, key))
        self._replace(table, touched, upserted(old, rows.select(*old.columns[:-1]).withColumn("_key", F.struct(self.document, key)), "_key").drop("_key"))
        return len(touched)

    def update(self, table: str, when: Column, values: Mapping[str, object], stamp: str | None = None) -> int:
        """Sets values where a condition holds, and a timestamp column to now there; how many partitions that rewrote."""
        touched = self._touched(self.read(table).where(when))
        if touched:
            rows = self._rows(table, touched).withColumn("_hit", F.coalesce(when, F.lit(False)))
            rows = updated(rows, F.col("_hit"), **values)
            if stamp:
                rows = rows.withColumn(stamp, F.when(F.col("_hit"), F.current_timestamp()).otherwise(F.col(stamp)))
            self._replace(table, touched, rows.drop("_hit"))
        return len(touched)

    def delete(self, document: object, *tables: str) -> dict[str, int]:
        """A document's rows of every table given, gone; how many each had."""
        gone = self.spark.createDataFrame([(document,)], f"`{self.document}` {self.spark.table(self.table(tables[0])).schema[self.document].dataType.simpleString()}")
        touched, out = self._touched(gone), {}
        for table in tables:
            out[table] = self.of_document(table, document).count()
            if out[table]:
                self._replace(table, touched, deleted(self._rows(table, touched), gone, self.document))
        return out

    def info(self, table: str) -> DataFrame:
        """(partition, documents, n) of a table."""
        return self.spark.table(self.table(table)).groupBy(F.col(PART).alias("partition")).agg(F.countDistinct(self.document).alias("documents"), F.count(F.lit(1)).alias("n"))

    def drop(self, table: str) -> bool:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table(table)}")
        return Files(self.spark, f"{self.folder}/{table}").delete()


def page_after(rows: DataFrame, key: str, limit: int, after: object = None) -> DataFrame:
    """The `limit` rows that follow a key in its order, the first page after None: a filter and the least `limit` of each task, where an
    offset would bring all rows before it to one place. Keys are unique and not null."""
    return (rows if after is None else rows.where(F.col(key) > F.lit(after))).orderBy(key).limit(limit)
