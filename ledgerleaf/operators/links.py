"""Rows that refer to other rows: chains of chunks and trees of sections, walked by pointer doubling.

In each round every row jumps as far again as it already has, so that a chain of n rows takes about log2(n) rounds, whatever its order in the
table. Each round's rows are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.sources.scratch import written


def walked(links: DataFrame, row: str | Column, to: str | Column, path: bool = False) -> DataFrame:
    """(id, end, steps, cyclic, broken) of every row of links, whose column `row` is its id and `to` the id that it refers to, if any: the
    last row that its links lead to, itself if there are none, and how many links that takes. path: the ids on the way too, the nearest first.

    A link to an id that isn't there is broken: the walk ends before it. Rows whose links run into a cycle are cyclic: their end is the
    smallest id of the cycle, steps and path are null. Of rows that share an id the one with the smallest link counts; null ids are left out."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    rows = links.select(as_column(row).alias("id"), as_column(to).alias("to")).where("id is not null").groupBy("id").agg(F.min("to").alias("to"))
    there = rows.select(F.col("id").alias("to"), F.lit(True).alias("there"))
    rows = rows.join(there, "to", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    way = F.when(F.col("there"), F.array("to")).otherwise(F.array().cast(f"array<{dict(rows.dtypes)['id']}>"))
    now = rows.select("id", F.when(F.col("there"), F.col("to")).otherwise(F.col("id")).alias("at"), F.col("there").cast("long").alias("steps"), (~F.col("there")).alias("done"), F.col("id").alias("low"), (F.col("to").isNotNull() & ~F.col("there")).alias("broken"), *([way.alias("path")] if path else []))
    now, before, length = written(now, "walk"), -1, 1
    while True:
        left = now.where("not done").count()
        if not left or left == before and length >= left:  # what is left goes round in circles, and has gone round them once
            break
        on = now.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"), F.col("done").alias("ended"), F.col("low").alias("lower"), *([F.col("path").alias("rest")] if path else []))
        ahead = now.where("not done").join(on, "at").select(
            "id", F.col("next").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), F.col("ended").alias("done"), F.least("low", "lower").alias("low"), "broken", *([F.concat("path", "rest").alias("path")] if path else []),
        )
        now, before, length = written(now.where("done").unionByName(ahead), "walk"), left, 2 * length
    circle = now.where("not done").select(F.col("id").alias("at"), F.col("low").alias("least"))
    out = now.join(circle, "at", "left") if left else now.withColumn("least", F.lit(None).cast(dict(now.dtypes)["id"]))
    end = F.when(F.col("done"), F.col("at")).otherwise(F.col("least"))
    return out.select("id", end.alias("end"), F.when(F.col("done"), F.col("steps")).alias("steps"), (~F.col("done")).alias("cyclic"), "broken", *([F.when(F.col("done"), F.col("path")).alias("path")] if path else []))


def chunk_chains(chunks: DataFrame, key: str = "chunk_id", before: str = "preceding", after: str = "following") -> DataFrame:
    """Each chunk's chain by its links, both ways: (key, head, place, tail, remaining, cyclic, broken). place: links back to the head;
    remaining: links on to the tail; broken: one of its own two links leads nowhere. The two ways are walked apart, so that links that
    contradict each other show: place and remaining of neighbours then don't add up."""
    back, on = walked(chunks, key, before), walked(chunks, key, after)
    back = back.select("id", F.col("end").alias("head"), F.col("steps").alias("place"), F.col("cyclic").alias("c1"), F.col("broken").alias("b1"))
    on = on.select("id", F.col("end").alias("tail"), F.col("steps").alias("remaining"), F.col("cyclic").alias("c2"), F.col("broken").alias("b2"))
    both = back.join(on, "id")
    return both.select(F.col("id").alias(key), "head", "place", "tail", "remaining", (F.col("c1") | F.col("c2")).alias("cyclic"), (F.col("b1") | F.col("b2")).alias("broken"))


def chain_from(chunks: DataFrame, start: object, limit: int | None = None, key: str = "chunk_id", before: str = "preceding", after: str = "following") -> DataFrame:
    """The chunks that follow one by their links, itself first, with each one's position from it; at most `limit` of them. Nothing where
    it isn't there; from within a cycle, nothing is behind anything, and only the chunk itself is given."""
    chains = chunk_chains(chunks, key, before, after)
    own = chains.where(F.col(key) == F.lit(start)).select(F.col("tail").alias("_tail"), F.col("remaining").alias("_remaining"))  # one row
    met = chains.join(F.broadcast(own), F.col("tail").eqNullSafe(F.col("_tail")))
    found = met.where((F.col(key) == F.lit(start)) | (F.col("remaining") < F.col("_remaining"))).select(key, F.coalesce(F.col("_remaining") - F.col("remaining"), F.lit(0)).alias("position"))
    out = chunks.join(found, key)
    return out if limit is None else out.where(F.col("position") < limit)


def subtrees(nodes: DataFrame, key: str | Sequence[str], parent: str, sums: Sequence[str] = (), least: Sequence[str] = (), most: Sequence[str] = ()) -> DataFrame:
    """nodes with depth (0 at a root), path (ids from the root to the node) and, over each node's whole subtree, itself included,
    subtree_size, sums as subtree_<name>, and the least and most of others as first_<name> and last_<name>. key: the id, or the columns that
    an id is unique within and the id last, as a parent is of the same document. Any depth. A missing parent makes a root; a cycle's nodes have
    neither depth nor path and make up no subtree."""
    within, own = ([], key) if isinstance(key, str) else (list(key[:-1]), key[-1])
    full = lambda last: F.struct(*[F.col(c).alias(c) for c in within], F.col(last).alias("id")) if within else F.col(last)
    up = F.when(F.col(parent).isNotNull(), full(parent)) if within else F.col(parent)
    tree = walked(nodes, full(own), up, path=True)
    plain = (lambda x: x["id"]) if within else (lambda x: x)
    path = F.transform(F.reverse(F.concat(F.array("id"), "path")), plain)
    about = tree.select("id", F.col("steps").alias("depth"), F.when(~F.col("cyclic"), path).alias("path"), F.when(~F.col("cyclic"), F.concat(F.array("id"), "path")).alias("_up"))
    mine = nodes.withColumn("_id", full(own)).join(about, F.col("_id") == F.col("id")).drop("id") if "id" not in nodes.columns or own != "id" else nodes.withColumn("_id", full(own)).join(about.withColumnRenamed("id", "_about"), F.col("_id") == F.col("_about")).drop("_about")
    each = mine.select(F.explode("_up").alias("_top"), *[F.col(c) for c in dict.fromkeys([*sums, *least, *most])])
    totals = [F.count(F.lit(1)).alias("subtree_size"), *[F.sum(c).alias(f"subtree_{c}") for c in sums], *[F.min(c).alias(f"first_{c}") for c in least], *[F.max(c).alias(f"last_{c}") for c in most]]
    return mine.join(each.groupBy("_top").agg(*totals), F.col("_id") == F.col("_top"), "left").drop("_id", "_top", "_up")
