"""Chunks of documents by section: tables first, then paragraphs packed to a target size, each chunk linked with its neighbours."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.operators.text import markdown, page_sections, tokens


@dataclass(frozen=True)
class Sizes:
    """In characters; table_tokens in tokens of four."""

    target: int = 4000
    overlap: int = 400
    least: int = 400
    most: int = 6000
    table_tokens: int = 1000


def paragraphs_of(text: str) -> list[str]:
    return [p for p in map(str.strip, re.split(r"\n\s*\n", text)) if p]


def sentences_of(text: str) -> list[str]:
    return [s for s in map(str.strip, re.split(r"(?<=[.!?।])\s+", text)) if s]


def tail(text: str, n: int) -> str:
    """The last n characters, from after their first blank on if that is in their first half, but not at their start."""
    if len(text) <= n:
        return text
    end = text[len(text) - n :]
    at = end.find(" ")
    return end[at + 1 :] if 0 < at < len(end) // 2 else end


class Packer:
    """Gathers units of text until the next would pass the target. Parts of the chunk in hand are kept apart and joined once, so
    the work grows with the text alone."""

    def __init__(self, joint: str, sizes: Sizes, start: int):
        self.joint, self.sizes, self.start, self.parts, self.length = joint, sizes, start, [], 0

    def fits(self, unit: str) -> bool:
        return not self.parts or self.length + len(unit) + len(self.joint) <= self.sizes.target

    def add(self, unit: str) -> None:
        self.length += len(unit) + (len(self.joint) if self.parts else 0)
        self.parts.append(unit)

    def text(self) -> str:
        return self.joint.join(self.parts)


def packed(text: str, sizes: Sizes) -> list[tuple[int, str]]:
    """(start, text) of the chunks of a text. A paragraph over the most that a chunk may have is cut into its sentences, in chunks of
    its own; after a full chunk the next begins with its tail; a short end joins the chunk before if that has room."""
    out: list[tuple[int, str]] = []
    now, at = Packer("\n\n", sizes, 0), 0

    def turned(full: Packer, unit: str, start: int) -> Packer:
        """The packer after a full one, which begins with its tail."""
        carried = tail(full.text(), sizes.overlap)
        new = Packer(full.joint, sizes, start - len(carried))
        if carried:
            new.add(carried)
        new.add(unit)
        return new

    for paragraph in paragraphs_of(text):
        if len(paragraph) > sizes.most:
            if now.parts:
                out.append((now.start, now.text()))
            inner = Packer(" ", sizes, at)
            for sentence in sentences_of(paragraph):
                if inner.fits(sentence):
                    inner.add(sentence)
                else:
                    chunk = inner.text().strip()
                    out.append((inner.start, chunk))
                    inner = turned(inner, sentence, inner.start + len(chunk))
            if inner.parts:
                out.append((inner.start, inner.text().strip()))
            now = Packer("\n\n", sizes, at + len(paragraph) + 2)
        elif now.fits(paragraph):
            if not now.parts:
                now.start = at
            now.add(paragraph)
        else:
            out.append((now.start, now.text()))
            now = turned(now, paragraph, at)
        at += len(paragraph) + 2
    last = now.text()
    if last.strip():
        if len(last) < sizes.least and out and len(out[-1][1]) + len(last) + 2 <= sizes.most:
            out[-1] = (out[-1][0], out[-1][1] + "\n\n" + last)
        else:
            out.append((now.start, last))
    return out


def chunk_id(document: object, section: object, start: int, text: str) -> str:
    return f"{document}_chunk_" + hashlib.md5(f"{document}:{section}:{start}:{text[:100]}".encode()).hexdigest()[:12]


_CHUNK = "start_char long, text string, chunk_id string"


def narrative(sections: DataFrame, sizes: Sizes) -> DataFrame:
    """(document_id, section_id, ordinal, start_char, text, chunk_id) of sections (document_id, section_id, content)."""
    kinds = dict(sections.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, documents, ids = [], batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, content in enumerate(batch.column(2).to_pylist()):
                rows += [(i, k, start, text, chunk_id(documents[i], ids[i], start, text)) for k, (start, text) in enumerate(packed(content or "", sizes))]
            of, ordinal, start, text, name = zip(*rows, strict=True) if rows else ((),) * 5
            at = pa.array(of, pa.int64())
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(ordinal, pa.int32()), pa.array(start, pa.int64()), pa.array(text, pa.string()), pa.array(name, pa.string())], names=["document_id", "section_id", "ordinal", "start_char", "text", "chunk_id"])

    return sections.select("document_id", "section_id", "content").mapInArrow(run, f"document_id {kinds['document_id']}, section_id {kinds['section_id']}, ordinal int, {_CHUNK}")


def linked(chunks: DataFrame, *order: str) -> DataFrame:
    w = Window.partitionBy("document_id").orderBy(*order)
    return chunks.withColumns({"seq": F.row_number().over(w), "preceding": F.lag("chunk_id").over(w), "following": F.lead("chunk_id").over(w)})


def measured(chunks: DataFrame) -> DataFrame:
    return chunks.withColumns({"token_count": tokens(F.col("text")), "char_count": F.length("text"), "end_char": F.col("start_char") + F.length("text")})


def chunk_texts(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:  # noqa: B008 (frozen)
    """docs (document_id, text) as linked chunks, each document one section."""
    rows = narrative(docs.select("document_id", F.concat(F.col("document_id").cast("string"), F.lit("_section_0")).alias("section_id"), F.col("text").alias("content")), sizes)
    return measured(linked(rows, "ordinal")).drop("ordinal")


def table_sections(tables: DataFrame, sections: DataFrame) -> DataFrame:
    """tables (document_id, table_id, page_num, ...) joined with every section that their page is in."""
    return page_sections(tables, sections)


def table_text(most_tokens: int) -> Column:
    """A table (headers, rows, table_type) as text: whole where it has few tokens, else its kind, size, first headers and rows."""
    whole = markdown(F.col("headers"), F.col("rows"))
    names = F.concat(F.lit("Headers: "), F.array_join(F.slice("headers", 1, 5), ", "), F.when(F.size("headers") > 5, F.concat(F.lit(" (+"), F.size("headers") - 5, F.lit(" more)"))).otherwise(""))
    sample = F.transform(F.slice("rows", 1, 3), lambda r: F.concat(F.lit("  "), F.array_join(F.transform(F.slice(r, 1, 5), lambda c: F.substring(F.coalesce(c, F.lit("")), 1, 30)), " | ")))
    head = F.array(F.concat(F.lit("[TABLE: "), "table_type", F.lit("]")), F.concat(F.lit("Rows: "), F.size("rows"), F.lit(", Columns: "), F.size("headers")))
    named = F.when(F.size("headers") > 0, F.array(names)).otherwise(F.array().cast("array<string>"))
    rows = F.when(F.size("rows") > 0, F.concat(F.array(F.lit("Sample data:")), sample)).otherwise(F.array().cast("array<string>"))
    return F.when(tokens(whole) <= most_tokens, whole).otherwise(F.array_join(F.concat(head, named, rows), "\n"))


def chunk_sections(sections: DataFrame, tables: DataFrame | None = None, sizes: Sizes = Sizes()) -> DataFrame:  # noqa: B008 (frozen)
    """Linked chunks of sections (document_id, section_id, parent_id, title, section_type, start_page, end_page, content): of sections without
    a parent, each followed by its own subsections, in order of section_id; deeper ones are in their parents' pages. A section's
    tables (document_id, table_id, page_num, headers, rows, table_type) come before its text, by page. Sections without text are left out."""
    roots = sections.where("parent_id is null").select("document_id", F.col("section_id").alias("parent_id"))
    top = sections.where("parent_id is null").withColumn("root", F.col("section_id"))
    second = sections.join(roots, ["document_id", "parent_id"]).withColumn("root", F.col("parent_id"))
    used = top.unionByName(second).where(F.length(F.trim("content")) > 0)
    about = used.select("document_id", "section_id", "root", F.col("title").alias("section"), "section_type", F.col("start_page").alias("page_start"), F.col("end_page").alias("page_end"))
    rows = narrative(used, sizes).withColumns({"chunk_type": F.lit("narrative"), "table_id": F.lit(None).cast("string"), "page": F.lit(1 << 30), "tie": F.lit("")})
    if tables is not None:
        met = table_sections(tables, used).withColumn("text", table_text(sizes.table_tokens)).where(F.trim("text") != "")
        name = F.concat(F.col("document_id").cast("string"), F.lit("_chunk_"), F.substring(F.md5(F.concat_ws(":", F.col("document_id").cast("string"), F.col("section_id").cast("string"), F.lit("0"), F.substring("text", 1, 100))), 1, 12))
        of_tables = met.select("document_id", "section_id", F.lit(0).alias("ordinal"), F.lit(0).cast("long").alias("start_char"), "text", name.alias("chunk_id"), F.lit("table").alias("chunk_type"), F.col("table_id").cast("string").alias("table_id"), F.col("page_num").cast("int").alias("page"), F.col("table_id").cast("string").alias("tie"))
        rows = rows.unionByName(of_tables)
    joined = rows.join(about, ["document_id", "section_id"])
    return measured(linked(joined, "root", "section_id", "page", "tie", "ordinal")).drop("root", "page", "tie", "ordinal")
