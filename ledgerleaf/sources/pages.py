"""Scans of extracted pages: ranges, validation and layout. A page is (document_id, page_num from 1, text, image_count, …)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions.exprs import stripped


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages that an extractor has written as Parquet, with the columns a scan needs, missing ones null."""
    df = spark.read.parquet(path)
    wanted = {"document_id": "long", "page_num": "int", "text": "string", "image_count": "int", "image_share": "double", "blocks": "array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>", "width": "double", "height": "double"}
    return df.select(*[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in wanted.items()])


def page_range(pages: DataFrame, start: int, end: int) -> DataFrame:
    """Pages start (from 0) up to but not including end."""
    return pages.where(F.col("page_num").between(start + 1, end))


def page_text(pages: DataFrame, document: object, number: int) -> str:
    """The text of a document's page, counted from 1; ValueError where there is none."""
    row = pages.where((F.col("document_id") == document) & (F.col("page_num") == number)).select("text").first()
    if row is None:
        raise ValueError(f"no page {number}")
    return row.text


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("page_count"))


def page_fonts(spans: DataFrame) -> DataFrame:
    """Of spans (document_id, page_num, font, size) each page's different fonts in order and sizes, to a tenth, the largest first. Empty
    names and sizes of 0 don't count."""
    fonts = F.array_sort(F.collect_set(F.when(F.col("font") != "", F.col("font"))))
    sizes = F.sort_array(F.collect_set(F.when(F.col("size") > 0, F.round("size", 1))), asc=False)
    return spans.groupBy("document_id", "page_num").agg(fonts.alias("fonts"), sizes.alias("font_sizes"))


def is_scanned(text: Column, images: Column, image_share: Column) -> Column:
    """Little text beside an image, or one image over four fifths of the page with hardly more."""
    n = F.length(stripped(F.coalesce(text, F.lit(""))))
    return ((n < 100) & (F.coalesce(images, F.lit(0)) > 0)) | ((F.coalesce(images, F.lit(0)) == 1) & (F.coalesce(image_share, F.lit(0.0)) > 0.8) & (n < 200))


def validation(pages: DataFrame, probe: int = 10) -> DataFrame:
    """One row a document: pages, how many are likely scanned by its first ones, and a warning where that is over half."""
    scanned = is_scanned(F.col("text"), F.col("image_count"), F.col("image_share"))
    early = F.col("page_num") <= probe
    out = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("page_count"), (F.count_if(early & scanned) / F.greatest(F.count_if(early), F.lit(1))).alias("scanned_share"))
    return out.withColumns({"scanned_pages": F.round(F.col("scanned_share") * F.col("page_count")).cast("long"), "mostly_scanned": F.col("scanned_share") > 0.5})


def has_tables(blocks: Column) -> Column:
    """Numbers or short lines in over three tenths of a page's blocks."""
    texts = F.transform(blocks, lambda b: b["text"])
    numeric = F.size(F.filter(texts, lambda t: F.regexp_count(t, F.lit(r"\d")) > F.length(t) * 0.3))
    short = F.size(F.filter(texts, lambda t: (F.size(F.split(t, r"\n")) > 2) & (F.length(t) / F.size(F.split(t, r"\n")) < 20)))
    return F.coalesce((numeric + short) / F.nullif(F.size(blocks), F.lit(0)) > 0.3, F.lit(False))


def is_multi_column(blocks: Column, width: Column) -> Column:
    """Four blocks or more, with several left edges both in the left fifth and right of three tenths."""
    edges = lambda keep: F.size(F.array_distinct(F.transform(F.filter(blocks, keep), lambda b: F.round(b["x0"]))))
    return (F.size(blocks) >= 4) & (edges(lambda b: b["x0"] < width * 0.2) > 1) & (edges(lambda b: b["x0"] > width * 0.3) > 1)


def edge_text(blocks: Column, height: Column, top: bool) -> Column:
    """The last short block in the top or bottom twelfth: a header or footer."""
    inside = (lambda b: b["y1"] < height * 0.08) if top else (lambda b: b["y0"] > height * 0.92)
    return F.try_element_at(F.transform(F.filter(blocks, lambda b: inside(b) & (F.length(b["text"]) < 200)), lambda b: stripped(b["text"])), F.lit(-1))
