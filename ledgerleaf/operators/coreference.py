"""Coreference of names, document by document: alike names are merged greedily, the most mentioned first, to a fixed point.

Names are alike as text.alike has it. In order of mentions (ties by name) each name that isn't merged yet becomes canonical and takes in
every alike name that isn't merged yet. The order is not followed one by one: in each round, all names without a better alike name left
become canonical, and the names alike to them are merged. That gives the same result, in as many rounds as the longest chain of
decisions that wait for each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.operators.text import HEAD, alike, normal_name
from ledgerleaf.sources.scratch import written

SALT = 16  # tasks that what meets a short name is dealt to


def alike_pairs(names: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, a, b): every two alike names (column name) of the same group, both ways round. They meet by a rare word of the one, and by
    the characters at a place of the longer that the shorter one begins with; not by every pair. names: distinct within a group."""
    by = list(by)
    low = names.select(*by, "name", F.lower("name").alias("low"), F.array_distinct(F.split(F.lower("name"), r"\s+")).alias("words"))
    # two names that share four fifths of the shorter one's words share one of its rarest: as many as may be missing, and one
    word = low.select(*by, "name", "words", F.explode("words").alias("key"))
    counts = word.groupBy(*by, "key").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by, "name").orderBy("n", "key"))
    rare = word.join(counts, [*by, "key"]).withColumn("_r", rank).where(F.col("_r") <= F.size("words") - F.ceil(F.size("words") * 0.8) + 1)
    by_word = rare.select(*by, "key", F.col("name").alias("a")).join(word.select(*by, "key", F.col("name").alias("b")), [*by, "key"])
    # a name within another begins at one of its places; names of HEAD characters and more meet by their first HEAD
    places = lambda size: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("low") - size + 1), lambda i: F.substring(F.col("low"), i, size)))
    long = low.where(F.length("low") >= HEAD)
    by_head = long.select(*by, F.substring("low", 1, HEAD).alias("key"), F.col("name").alias("a")).join(long.select(*by, F.col("name").alias("b"), F.explode(places(F.lit(HEAD))).alias("key")), [*by, "key"])
    # shorter ones are whole keys: few names, which very many may contain, so that the names that contain them are dealt to SALT tasks each
    short = low.where((F.length("low") < HEAD) & (F.col("low") != ""))
    sizes = F.filter(F.sequence(F.lit(1), F.lit(HEAD - 1)), lambda n: n <= F.length("low"))
    within = low.where("low <> ''").select(*by, F.col("name").alias("b"), F.explode(F.array_distinct(F.flatten(F.transform(sizes, places)))).alias("key"))
    within = within.join(short.select(*by, F.col("low").alias("key")).distinct(), [*by, "key"], "left_semi").withColumn("s", F.pmod(F.xxhash64("b"), F.lit(SALT)).cast("int"))
    by_short = short.select(*by, F.col("low").alias("key"), F.col("name").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("s")).join(within, [*by, "key", "s"]).drop("s")
    met = by_word.unionByName(by_head).unionByName(by_short).where(F.col("a") != F.col("b")).where(alike(F.col("a"), F.col("b"))).select(*by, "a", "b")
    # the empty name is in every other one
    empty = low.where("low = ''").select(*by, F.col("name").alias("a")).join(low.where("low <> ''").select(*by, F.col("name").alias("b")), by)
    met = met.unionByName(empty)
    return met.unionByName(met.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def canonical_names(names: DataFrame, by: Sequence[str]) -> DataFrame:
    """names (by, name, mentions) with the canonical name of each: its own, or that of the best canonical name it is alike to. No canonical
    name has another one. Repeated names of a group are summed; null names, and groups with a null, are left out."""
    by = list(by)
    names = names.where(" AND ".join(f"{c} IS NOT NULL" for c in [*by, "name"])).groupBy(*by, "name").agg(F.sum("mentions").alias("mentions"))
    names = written(names, "names")
    rank = names.select(*by, F.col("name").alias("b"), F.col("mentions").alias("mb"))
    pairs = alike_pairs(names.select(*by, "name"), by).join(names.select(*by, F.col("name").alias("a"), F.col("mentions").alias("ma")), [*by, "a"]).join(rank, [*by, "b"])
    # from each name to those that come before it
    better = (F.col("mb") > F.col("ma")) | ((F.col("mb") == F.col("ma")) & (F.col("b") < F.col("a")))
    edges = written(pairs.where(better).select(*by, "a", "b", "mb"), "better")
    left, waiting = edges.select(*by, "a", "b"), names.select(*by, F.col("name").alias("a"))
    chosen: DataFrame | None = None
    while not waiting.isEmpty():
        first = written(waiting.join(left.select(*by, "a"), [*by, "a"], "left_anti"), "canonical")
        chosen = first if chosen is None else chosen.unionByName(first)
        merged = written(left.join(first.select(*by, F.col("a").alias("b")), [*by, "b"], "left_semi").select(*by, "a").distinct(), "merged")
        decided = first.unionByName(merged)
        waiting = written(waiting.join(decided, [*by, "a"], "left_anti"), "waiting")
        # a name merged now is no longer in the way of others
        left = written(left.join(decided, [*by, "a"], "left_anti").join(merged.select(*by, F.col("a").alias("b")), [*by, "b"], "left_anti").select(*by, "a", "b"), "left")
    if chosen is None:
        return names.withColumn("canonical", F.col("name"))
    to = edges.join(chosen.select(*by, F.col("a").alias("b")), [*by, "b"], "left_semi").join(chosen, [*by, "a"], "left_anti")
    best = to.groupBy(*by, "a").agg(F.min_by("b", F.struct(-F.col("mb"), F.col("b"))).alias("canonical")).withColumnRenamed("a", "name")
    return names.join(best, [*by, "name"], "left").withColumn("canonical", F.coalesce("canonical", "name"))


def merged_entities(found: DataFrame, document: str = "document_id") -> DataFrame:
    """found (document_id, ordinal, name, entity_type, page, confidence): each document's entities by canonical normal name and type, with
    mentions, aliases and pages in order, first (the ordinal of the first mention) and confidence, the mean of the mentions'. Names of
    companies and persons are resolved; of other types, equal normal names are one entity."""
    rows = found.where(f"{document} IS NOT NULL AND name IS NOT NULL AND entity_type IS NOT NULL").withColumn("normalized", normal_name(F.col("name"), F.col("entity_type")))
    counts = rows.groupBy(document, "entity_type", "normalized").agg(F.count(F.lit(1)).alias("mentions"))
    known = canonical_names(counts.where(F.col("entity_type").isin("COMPANY", "PERSON")).withColumnRenamed("normalized", "name"), [document, "entity_type"])
    known = known.select(document, "entity_type", F.col("name").alias("normalized"), "canonical")
    # a name's mentions are summed up before names meet: what travels is a row for each name, alias and page
    aliases = rows.groupBy(document, "entity_type", "normalized", "name", "page").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"), F.sum("confidence").alias("sure"))
    whole = aliases.join(known, [document, "entity_type", "normalized"], "left").withColumn("canonical", F.coalesce("canonical", "normalized"))
    return whole.groupBy(document, "entity_type", "canonical").agg(F.sum("n").alias("mentions"), F.array_sort(F.collect_set("name")).alias("aliases"), F.array_sort(F.collect_set("page")).alias("pages"), F.min("first").alias("first"), (F.sum("sure") / F.sum("n")).alias("confidence"))
