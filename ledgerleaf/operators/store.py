"""Repository queries over stored tables, filters for vector payloads, and writes: each a plan over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F


def equal(rows: DataFrame, **values: object) -> DataFrame:
    for k, v in values.items():
        rows = rows.where(F.col(k) == v)
    return rows


def contains_ci(rows: DataFrame, column: str, needle: str) -> DataFrame:
    """% and _ in the needle match as in LIKE."""
    return rows.where(F.col(column).ilike(f"%{needle}%"))


def in_list(rows: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    return rows.where(F.col(column).isin(*values))


def stabbed(rows: DataFrame, start: str, end: str, at: object) -> DataFrame:
    return rows.where((F.col(start) <= at) & (F.col(end) >= at))


def contained(rows: DataFrame, start: str, end: str, low: object, high: object) -> DataFrame:
    return rows.where((F.col(start) >= low) & (F.col(end) <= high))


def exists(rows: DataFrame, **values: object) -> bool:
    return not equal(rows, **values).isEmpty()


def count(rows: DataFrame, **values: object) -> int:
    return equal(rows, **values).count()


def find(rows: DataFrame, **values: object) -> Row | None:
    """The only row with these values of a key; None where there is none."""
    return equal(rows, **values).first()


def flagged(rows: DataFrame, column: str, on: bool = False) -> DataFrame:
    """Rows whose flag, kept as 0 or 1, is on or off; a null flag is neither."""
    return rows.where(F.col(column).cast("int") == int(on))


def top_level(sections: DataFrame) -> DataFrame:
    """Sections of level 1 with each one's place in its document by start page."""
    w = Window.partitionBy("document_id").orderBy("start_page", "section_id")
    return sections.where("level = 1").withColumn("place", F.row_number().over(w))


def failed_agents(runs: DataFrame) -> DataFrame:
    return runs.where("status = 'failed'").select("document_id", "agent_name", "error_message")


def runs_of(runs: DataFrame, agent: str) -> DataFrame:
    """All of an agent's runs, the latest first within a document."""
    w = Window.partitionBy("document_id").orderBy(F.desc("started_at"), F.desc("run_id"))
    return runs.where(F.col("agent_name") == agent).withColumn("place", F.row_number().over(w))


def present(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.dropna(subset=list(columns))


def page_of_rows(rows: DataFrame, key: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of rows in order of the key, so that pages neither overlap nor leave gaps."""
    return rows.orderBy(key).offset(offset).limit(limit)


def top_n(rows: DataFrame, by: str, n: int = 10, tie: str | None = None) -> DataFrame:
    return rows.orderBy(F.desc(by), *([tie] if tie else [])).limit(n)


def severity_rank(c: Column) -> Column:
    return F.when(c == "critical", 0).when(c == "major", 1).when(c == "minor", 2).otherwise(3)


def with_children(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """parents with each child table's rows as an array: collected by key before the join, so that children don't multiply."""
    for name, child in children.items():
        rest = [c for c in child.columns if c != key]
        packed = child.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))
        parents = parents.join(packed, key, "left")
    return parents


def latest(rows: DataFrame, by: Sequence[str], *order: Column) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_by(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Rows without duplicates of the key: the last by ordinal counts."""
    return latest(rows, [key], F.desc(ordinal))


def deleted(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def deleted_with_children(gone: DataFrame, key: str, parents: DataFrame, **children: DataFrame) -> dict[str, DataFrame]:
    """parents and every child table without the rows whose key is in gone."""
    return {"parents": deleted(parents, gone, key)} | {name: deleted(child, gone, key) for name, child in children.items()}


def updated(rows: DataFrame, when: Column, **values: object) -> DataFrame:
    """rows with values set where the condition holds; names that aren't columns are ignored."""
    return rows.withColumns({k: F.when(when, F.lit(v)).otherwise(F.col(k)) for k, v in values.items() if k in rows.columns})


def upserted(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return deleted(rows, new, key).unionByName(new)


def payload_filter(conditions: Mapping[str, object], exact: bool = False, of: Callable[[str], Column] = F.col) -> Column:
    """Conditions joined by AND: a scalar equals, two numbers are an inclusive range, another list is any of its values; None is
    ignored. exact: every value of a list must match, as in the definition this follows, so two different ones match nothing. of: the
    column of a name."""
    out = F.lit(True)
    for k, v in conditions.items():
        if v is None:
            continue
        if isinstance(v, (list, tuple)):
            if len(v) == 2 and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v):
                out = out & of(k).between(*v)
            elif exact:
                for x in v:
                    out = out & (of(k) == x)
            else:
                out = out & of(k).isin(*v)
        else:
            out = out & (of(k) == v)
    return out


def point_id(chunk_id: Column) -> Column:
    """The first 15 hex digits of the id's SHA-256, as a number."""
    return F.conv(F.substring(F.sha2(chunk_id, 256), 1, 15), 16, 10).cast("long")


def content_hash(texts: DataFrame, by: str, text: str, order: str) -> DataFrame:
    """One hash of a group's texts in order."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "|||")
    return texts.groupBy(by).agg(F.sha2(joined, 256).alias("content_hash"))


def cache_misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows of texts (content_hash, model) that the cache doesn't hold for the same model."""
    return texts.join(cache.select("content_hash", "model").distinct(), ["content_hash", "model"], "left_anti")
