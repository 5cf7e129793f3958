"""Connected components: in numpy for the links one task has found, in Spark for all of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerleaf.llm.scratch import written


class Forest:
    """Labels 0..n-1 joined link by link, many at a time; a label is the smallest number it is joined to."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while len(a):
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                return
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            low, high = np.minimum(la, lb), np.maximum(la, lb)
            np.minimum.at(label, high, low)
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """One link for each number that isn't the smallest of its tree."""
        at = np.flatnonzero(self.label != np.arange(len(self.label)))
        return at, self.label[at]


def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a batch's links (src, dst), as many as hold its components together, each to the component's smallest id."""
    for batch in batches:
        src, dst = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        ids, flat = np.unique(np.concatenate([src, dst]), return_inverse=True)
        forest = Forest(len(ids))
        forest.join(flat[: len(src)], flat[len(src) :])
        a, b = forest.links()
        yield pa.record_batch([pa.array(ids[a], pa.int64()), pa.array(ids[b], pa.int64())], names=["src", "dst"])


def components(links: DataFrame, rounds: int = 60, spanning_already: bool = False) -> DataFrame:
    """(id, component_id) of every id that occurs in links (src, dst), both long and not null; component_id is
    the smallest id reachable. Alternating large-star and small-star rounds: a round only takes the minimum over
    a node's neighbours, which Spark combines before it shuffles, so a node with very many links is no hot task.
    Each round's links are written to the shared folder. spanning_already: each task's links span what they join, so that they
    need not be thinned out first, which would take another Python worker beside the one that has made them."""
    if not spanning_already:
        links = links.mapInArrow(spanning, "src long, dst long")
    now = written(links.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "links")
    seen = None
    for _ in range(rounds):
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
