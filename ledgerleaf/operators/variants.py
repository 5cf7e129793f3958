"""Semi-structured columns as VARIANT: findings, results, table data and the like, kept as given and read by typed paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """JSON text as a variant; null where the text is null, blank or no JSON."""
    return F.try_parse_json(text)


def packed(*columns: str | Column) -> Column:
    """Columns as one variant, nulls included."""
    return F.parse_json(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def text_of(value: Column) -> Column:
    """A variant as JSON text."""
    return F.to_json(value)


def at(value: Column, path: str, kind: str) -> Column:
    """What a path ($.a.b[0]) holds, as a type; null where there is nothing or something of another kind."""
    return F.try_variant_get(value, path, kind)


def items(value: Column, kind: str = "variant", path: str = "$") -> Column:
    """The list that a variant holds; empty where it is null, malformed, no list, or JSON's null, false, 0, "" or {}."""
    return F.coalesce(F.try_variant_get(value, path, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def entries(value: Column, kind: str = "variant", path: str = "$") -> Column:
    """The map that a variant's object holds; empty where it is none."""
    return F.coalesce(F.try_variant_get(value, path, f"map<string, {kind}>"), F.create_map().cast(f"map<string, {kind}>"))


def falsy_to_null(text: Column) -> Column:
    """JSON text to store, or null for a value that says nothing: null, an empty list, object or text, 0 and false."""
    return F.when(F.regexp_replace(text, r"\s", "").isin("null", "[]", "{}", '""', "0", "false", "0.0", ""), None).otherwise(text)


def typed(rows: DataFrame, value: str, fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """rows with columns of a variant: name to (path, type)."""
    return rows.withColumns({name: at(F.col(value), path, kind) for name, (path, kind) in fields.items()})


def schemas(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """The schema that fits a variant column's values, of each group."""
    return rows.groupBy(*by).agg(F.schema_of_variant_agg(F.col(value)).alias("schema"), F.count(value).alias("n"))


def flattened(rows: DataFrame, value: str, path: str = "$") -> DataFrame:
    """rows with a row for each item of a list in a variant: item, a variant, and its position; rows without items are left out."""
    return rows.select("*", F.posexplode(items(F.col(value), path=path)).alias("position", "item"))


# the records that a store keeps, each with its fields and their types
RECORDS: dict[str, dict[str, str]] = {
    "chunk": {"chunk_id": "string", "section": "string", "page_start": "int", "page_end": "int", "text": "string", "metadata": "map<string, string>"},
    "section": {"section_id": "string", "title": "string", "level": "int", "start_page": "int", "end_page": "int", "children": "array<string>"},
    "table": {"table_id": "string", "page_num": "int", "headers": "array<string>", "rows": "array<array<string>>", "confidence": "double"},
    "entity": {"text": "string", "entity_type": "string", "value": "double", "aliases": "array<string>", "pages": "array<int>"},
    "citation": {"claim_id": "string", "section": "string", "page": "int", "snippet": "string"},
    "finding": {"severity": "string", "message": "string", "evidence": "array<string>"},
    "agent_run": {"agent_name": "string", "status": "string", "results": "map<string, string>", "error": "string"},
    "risk": {"name": "string", "score": "double", "flags": "array<string>", "critical": "boolean"},
}


def record(kind: str) -> Column:
    """The columns of a kind of record as one variant."""
    return packed(*RECORDS[kind])


def unpacked(rows: DataFrame, value: str, kind: str) -> DataFrame:
    """rows with the fields of a kind of record, out of a variant; fields that are absent or of another type are null."""
    return typed(rows, value, {name: (f"$.{name}", t) for name, t in RECORDS[kind].items()})
