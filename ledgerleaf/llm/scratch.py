"""Tables that a job writes to cut its lineage, and keys for rows that have none."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, as in tests, a new local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="ledgerleaf-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/ledgerleaf/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and safe when an executor is lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> bool:
    """Removes all tables that `written` has made in the shared folder, by this session or others. Results that still read them
    must have been written or collected before. False: there were none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/ledgerleaf")
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))


def text_bytes(df: DataFrame, column: str) -> int:
    """The bytes of a string column's values, summed over all rows."""
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def buckets_for(text_bytes: int, bytes_per_bucket: int, least: int = 8) -> int:
    """How many buckets to deal rows made of a text to, so that a bucket's size doesn't grow with the input."""
    return max(least, -(-text_bytes // bytes_per_bucket))


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lets texts travel between the JVM and Python in batches of so many rows, so that a task holds a few MB of them on either side.
    A session that has another size than Spark's default keeps it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def rows_of(df: DataFrame) -> DataFrame:
    """df's rows as one struct `row`, so that none of its columns can clash with an operator's own."""
    return df.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns]).alias("row"))


def fields(columns: list[str]) -> list[Column]:
    """The columns of a `row` that rows_of has made."""
    return [F.col("row").getField(c).alias(c) for c in columns]


def with_key(df: DataFrame, id_col: str, key: str = "_k") -> DataFrame:
    """df with a long key that is unique, in place of any column of that name. It is id_col itself (a column, or a struct's field)
    where those are unique and not null; else each row is written once with a number of its own, so that repeated rows stay apart."""
    kind = df.select(F.col(id_col).alias("id"))
    if kind.dtypes[0][1] in ("bigint", "int", "smallint", "tinyint"):
        bad = kind.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col("id").isNull())
        if bad.isEmpty():
            return df.withColumn(key, F.col(id_col).cast("long"))
    return written(df.withColumn(key, F.monotonically_increasing_id()), "keyed")
