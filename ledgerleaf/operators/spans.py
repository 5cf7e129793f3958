"""Joins of points with spans, and of spans with spans, by bins of widths that follow the spans' own.

A span goes into a few bins of the level whose bins are about a quarter of its length, so that a span of a million pages makes as many rows
as one of four; a point looks its bin up on each level that some span has. Rows meet by equality of key, level and bin.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN_BITS = 2  # a level's bins are 4 times as wide as those of the level below
BINS = 6  # that a span takes at most


def level_of(start: Column, end: Column) -> Column:
    """The level of a span: bits by which its ends are shifted to give bins."""
    bits = F.ceil(F.log2((end - start + 1).cast("double")) / FAN_BITS).cast("int")
    return F.greatest(F.lit(0), bits - 1) * FAN_BITS


def binned(spans: DataFrame, start: str, end: str) -> DataFrame:
    """spans with a row for each of their bins (_level, _bin): BINS rows a span at most. Spans without an end or a start, or that end before
    they start, hold nothing and are left out."""
    fine = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    rows = fine.withColumn("_level", level_of(F.col(start).cast("long"), F.col(end).cast("long")))
    shifted = lambda c: F.expr(f"shiftright(cast(`{c}` as bigint), _level)")
    return rows.withColumn("_bin", F.explode(F.sequence(shifted(start), shifted(end))))


def points_in_spans(points: DataFrame, spans: DataFrame, by: Sequence[str], point: str, start: str, end: str) -> DataFrame:
    """points joined with every span of the same `by` that covers them, both ends included: the columns of both, `by` once. Other columns
    of the two must have different names. Null points are in no span."""
    bins = binned(spans, start, end)
    levels = [r["_level"] for r in bins.select("_level").distinct().orderBy("_level").collect()]  # 32 at most
    if not levels:
        return points.join(bins.drop("_level", "_bin"), [*by]).limit(0)
    asked = points.where(F.col(point).isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels])))
    asked = asked.withColumn("_bin", F.expr(f"shiftright(cast(`{point}` as bigint), _level)"))
    met = asked.join(bins, [*by, "_level", "_bin"])
    return met.where(F.col(point).between(F.col(start), F.col(end))).drop("_level", "_bin")


def spans_within(inner: DataFrame, outer: DataFrame, by: Sequence[str], own: tuple[str, str], other: tuple[str, str]) -> DataFrame:
    """Spans of inner (its ends are the columns `own`) joined with every span of outer (`other`) that they lie in."""
    met = points_in_spans(inner.where(F.col(own[0]) <= F.col(own[1])), outer, by, own[0], *other)
    return met.where(F.col(own[1]) <= F.col(other[1]))


def spans_overlapping(a: DataFrame, b: DataFrame, by: Sequence[str], own: tuple[str, str], other: tuple[str, str]) -> DataFrame:
    """Spans of a (ends `own`) joined with every span of b (`other`) that they share a point with: one of the two starts within the other.
    A pair whose starts are equal is found once."""
    fine = lambda rows, ends: rows.where(F.col(ends[0]) <= F.col(ends[1]))
    first = points_in_spans(fine(a, own), b, by, own[0], *other)
    second = points_in_spans(fine(b, other), a, by, other[0], *own).where(F.col(other[0]) > F.col(own[0]))
    return first.unionByName(second.select(*first.columns))


# ---- totals over joins, without a row for each pair ----


def _met_once(rows: DataFrame, columns: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Rows that are equal in `columns` as one, with totals over them."""
    return rows.groupBy(*columns).agg(*[x.alias(name) for name, x in totals.items()])


def totals_of(join: Callable[[DataFrame, DataFrame], DataFrame], rows: DataFrame, places: Sequence[str], totals: dict[str, Column], asked: DataFrame, key: str, asked_places: Sequence[str], merged: dict[str, Column]) -> DataFrame:
    """(key, *merged) of what each of asked meets in join(rows, asked). What is equal in all the places that the join looks at meets once: rows
    are first summed up by `places` into `totals`, and asked by `asked_places`; `merged` sums the totals up again. So pairs
    are those of different places, and what shares one costs a sum. A key that meets nothing has no row; one of several rows has all they meet."""
    own = [f"_{c}" for c in asked_places]
    wanted = asked.select(key, *[F.col(c).alias(o) for c, o in zip(asked_places, own, strict=True)])
    places_of = wanted.select(*[F.col(o).alias(c) for c, o in zip(asked_places, own, strict=True)]).distinct()
    met = join(_met_once(rows, places, totals), places_of).groupBy(*asked_places).agg(*[x.alias(name) for name, x in merged.items()])
    found = met.select(*[F.col(c).alias(o) for c, o in zip(asked_places, own, strict=True)], *merged)
    return wanted.join(found, own).groupBy(key).agg(*[x.alias(name) for name, x in merged.items()])
