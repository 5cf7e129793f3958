"""Substring dedup with fixed-block anchors: exact repeats of many words, found and removed.

1. Every text's blocks of `block` words at places 0, block, 2 * block, ... are the index; every rolling window of
   `block` words is a probe. A repeat of at least 2 * block - 1 words holds a whole block of either text, so each
   block that is found anywhere else is an anchor, and no repeat is without one.
2. Around the anchors only, every run of `window` words is looked up among all others such. The runs found twice
   join to the maximal repeats, and what they cover is removed.

Windows are dealt by their hash in packed arrays. What a task has seen itself more than once it settles itself and
sends once, so a passage that a third of all texts share is no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm.scratch import buckets_for, text_bytes, with_key
from ledgerleaf.llm.streams import groups
from ledgerleaf.llm.textbytes import Words, pieces, planes, unplanes

SENT = "bucket int, grp int, settled boolean, probes binary, hashes binary, keys binary, counts binary, places binary"
FOUND = "grp int, keys binary, counts binary, places binary"


def packed_places(keys: np.ndarray, places: np.ndarray) -> list[bytes]:
    """(key, place) pairs sorted by both, as runs of a key with the steps from place to place."""
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    step = np.diff(places, prepend=0)
    step[at] = places[at]
    return [planes(keys[at].astype(np.int64)), planes(np.diff(np.append(at, len(keys))).astype(np.uint32)), planes(step.astype(np.uint32))]


def unpacked_places(keys: bytes, counts: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = unplanes(counts, np.uint32).astype(np.int64)
    step = np.cumsum(unplanes(places, np.uint32).astype(np.int64))
    before = np.concatenate([[0], step])[np.cumsum(n) - n] if len(n) else np.zeros(0, np.int64)
    return np.repeat(unplanes(keys, np.int64), n), step - np.repeat(before, n)


def seen_here(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of h occur more than once in it, and the index of one of each distinct."""
    order = np.argsort(h, kind="stable")
    new = np.append(True, h[order][1:] != h[order][:-1]) if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    twice = np.zeros(len(h), bool)
    twice[order] = np.repeat(np.diff(np.append(first, len(h))) > 1, np.diff(np.append(first, len(h))))
    return twice, order[first]


def sent(grp: int, buckets: int, h: np.ndarray, keys: np.ndarray, places: np.ndarray, wanted: np.ndarray, size: type) -> Iterator[tuple]:
    """Rows of SENT for hashes h, each once; those wanted come with their key and place, and twice seen ones of them are settled here."""
    twice, once = seen_here(h)
    settled = np.flatnonzero(twice & wanted)
    if len(settled):
        yield (int(h[settled[0]] % np.uint64(buckets)), grp, True, None, None, *packed_places(keys[settled], places[settled]))
    bucket = ((h[once] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    named = wanted[once] & ~twice[once]
    order = np.lexsort((once, ~named, bucket))
    once, bucket, named = once[order], bucket[order], named[order]
    cuts = [*np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(once)] if len(once) else []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        mid = lo + int(named[lo:hi].sum())
        own, rest = once[lo:mid], once[mid:hi]
        yield (int(bucket[lo]), grp, False, h[rest].astype(size).tobytes(), h[own].astype(size).tobytes(), *packed_places(keys[own], places[own]))


def as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.record_batch([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def found_twice(batches: Iterator[pa.RecordBatch], size: type) -> Iterator[pa.RecordBatch]:
    """Of each bucket's named hashes, those that any other row has sent too."""
    for table in groups(batches, "bucket"):
        rows = table.to_pylist()
        out = [(r["grp"], r["keys"], r["counts"], r["places"]) for r in rows if r["settled"]]
        rows = [r for r in rows if not r["settled"]]
        if rows:
            own = np.concatenate([np.frombuffer(r["hashes"], size) for r in rows])
            index, back, count = np.unique(own, return_inverse=True, return_counts=True)
            if len(index):
                bits = np.dtype(size).itemsize * 8
                maybe = np.zeros(1 << 20, bool)
                maybe[(index >> size(bits - 20)).astype(np.int64)] = True
                for r in rows:
                    probe = np.frombuffer(r["probes"], size)
                    probe = probe[maybe[(probe >> size(bits - 20)).astype(np.int64)]]
                    at = np.minimum(np.searchsorted(index, probe), len(index) - 1)
                    np.add.at(count, at[index[at] == probe], 1)
            hit, lo = count[back] > 1, 0
            for r in rows:
                n = len(r["hashes"]) // np.dtype(size).itemsize
                mine, lo = hit[lo : lo + n], lo + n
                if mine.any():
                    keys, places = unpacked_places(r["keys"], r["counts"], r["places"])
                    out.append((r["grp"], *packed_places(keys[mine], places[mine])))
        yield as_batch(out, FOUND)


def all_places(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    rows = [unpacked_places(*r) for r in zip(*(found.column(c).to_pylist() for c in ("keys", "counts", "places")), strict=True)]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([k for k, _ in rows]), np.concatenate([p for _, p in rows])


def marked(table_keys: np.ndarray, counts: np.ndarray, found: pa.Table) -> np.ndarray:
    """For texts with `counts` words each, which words' places are among those found."""
    keys, places = all_places(found)
    order = np.argsort(table_keys, kind="stable")
    row = order[np.searchsorted(table_keys[order], keys)] if len(keys) else keys
    mark = np.zeros(int(counts.sum()), bool)
    mark[(np.cumsum(counts) - counts)[row] + places] = True
    return mark


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, with_text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256 and, if asked for, kept_text) of every row of docs: each word goes that a
    run of `window` words covers whose words also start anywhere else, the same text included. Windows are judged on the
    input. What is kept is joined by single spaces.

    A null or blank text has no words and keeps the empty string. Rows that repeat an id, or whole rows, are texts
    of their own and repeat each other."""
    block = (window + 1) // 2
    size = text_bytes(docs, text_col)
    buckets, many = buckets_for(size, 10 << 20), buckets_for(size, 3 << 20)
    keyed = with_key(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    keyed = keyed.withColumn("grp", F.pmod(F.xxhash64("_k"), F.lit(many)).cast("int"))
    id_type = dict(keyed.dtypes)["id"]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, grp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for g_lo, g_hi, data, offsets in pieces(batch.column(2), 2 << 20):
                words = Words(data, offsets)
                h, at = words.runs(words.hashes(), block)
                long = words.counts[words.text_of()[at]] >= window
                h, at = h[long], at[long]
                text, place = words.text_of()[at], words.place()[at]
                # an anchor's group is looked up again by its key
                rows = list(sent(-1, buckets, h, keys[g_lo:g_hi][text], place, place % block == 0, np.uint32))
                if rows:
                    yield as_batch(rows, SENT)

    def regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found_twice(batches, np.uint32):
            keys, places = all_places(pa.Table.from_batches([batch]))
            yield pa.record_batch([pa.array(keys), pa.array(places.astype(np.int32))], names=["_k", "place"])

    def extend(texts: pa.Table, anchors: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if anchors.num_rows:
            grp, keys = texts.column("grp")[0].as_py(), texts.column("_k").to_numpy()
            hit, place = anchors.column("_k").to_numpy(), anchors.column("place").to_numpy()
            order = np.lexsort((place, hit))
            hit, place = hit[order], place[order]
            keep = np.isin(keys, hit)
            texts, keys = texts.filter(pa.array(keep)), keys[keep]
            h_all, k_all, p_all = [], [], []
            lo_row = 0
            for lo, hi, data, offsets in pieces(texts.column("text").combine_chunks(), 2 << 20):
                words = Words(data, offsets)
                mine = keys[lo:hi]
                anchor = np.zeros(len(words) + 2 * block, bool)
                chosen = np.isin(hit, mine)
                by = np.argsort(mine, kind="stable")
                row = by[np.searchsorted(mine[by], hit[chosen])]
                anchor[words.first[row] + place[chosen]] = True
                h, at = words.runs(words.hashes(), block)
                where = np.full(len(words) + window, -1)
                where[at] = np.arange(len(at))
                start = np.flatnonzero(np.repeat(words.first[1:], words.counts) - np.arange(len(words)) >= window)
                p = words.place()[start]
                start = start[anchor[start + (-p) % block]]
                both = h[where[start]] * np.uint64(0x9E3779B97F4A7C15) + (h[where[start + window - block]] ^ (h[where[start]] >> np.uint64(29)))
                h_all.append(both)
                k_all.append(mine[words.text_of()[start]])
                p_all.append(words.place()[start])
                lo_row = hi
            if lo_row:
                rows = list(sent(grp, buckets, np.concatenate(h_all), np.concatenate(k_all), np.concatenate(p_all), np.ones(sum(map(len, h_all)), bool), np.uint64))
        return pa.Table.from_batches([as_batch(rows, SENT)])

    def cut(texts: pa.Table, found: pa.Table) -> pa.Table:
        keys = texts.column("_k").to_numpy()
        texts_ = [t.as_py() or b"" for t in texts.column("text").cast(pa.large_binary())]
        words = [t.split() for t in texts_]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        drop = np.zeros(int(counts.sum()) + 1, np.int64)
        starts = np.flatnonzero(marked(keys, counts, found))
        np.add.at(drop, starts, 1)
        np.add.at(drop, starts + window, -1)
        gone = np.cumsum(drop)[:-1] > 0
        to = np.cumsum(counts)
        removed, digest, kept_text = [], [], []
        for i, w in enumerate(words):
            mine = gone[to[i] - counts[i] : to[i]]
            n = int(mine.sum())
            kept = b" ".join(w if not n else [w[j] for j in np.flatnonzero(~mine).tolist()])
            removed.append(n)
            digest.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                kept_text.append(kept.decode())
        columns = [texts.column("id").combine_chunks(), pa.array(counts), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
        names = ["id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            columns.append(pa.array(kept_text, pa.string()))
        return pa.table(columns, names=[*names, "kept_text"][: len(columns)])

    anchors = keyed.select("_k", "grp", "text").mapInArrow(probe, SENT).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(regroup, "_k long, place int")
    anchors = anchors.withColumn("grp", F.pmod(F.xxhash64("_k"), F.lit(many)).cast("int"))
    by_group = keyed.groupBy("grp")
    runs = by_group.cogroup(anchors.groupBy("grp")).applyInArrow(extend, SENT)
    found = runs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: found_twice(b, np.uint64), FOUND)
    return by_group.cogroup(found.groupBy("grp")).applyInArrow(cut, f"id {id_type}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY k) > 1),
g AS (SELECT doc_id, list(j) AS gone FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(gone, j)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
