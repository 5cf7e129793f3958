"""Token sequences of fixed length, filled by bounded-space online best-fit."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm.scratch import written
from ledgerleaf.llm.streams import groups
from ledgerleaf.llm.textbytes import SEPARATOR, hash_spans, pieces, trim

# The UTF-8 forms of the characters above U+007F that Unicode calls white space.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
LETTER, OTHER = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
OTHER[:128] = ~LETTER[:128]


def cuttable(spec: dict) -> bool:
    """Whether a tokenizer file is of the kind whose texts ChunkTokenizer can cut: a byte-level BPE with the usual pattern of words."""
    before = spec.get("pre_tokenizer") or {}
    model = spec["model"]
    usual = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    return usual and model["type"] == "BPE" and not spec.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges") and not any(model.get(x) for x in ("continuing_subword_prefix", "end_of_word_suffix", "unk_token"))


class ChunkTokenizer:
    """Token ids of whole texts, encoding each distinct chunk of a byte-level BPE's about once; of any other tokenizer's, text by text.

    A byte-level BPE never joins a character that isn't white space with white space after it, nor a letter with
    what is no letter after it. So a text can be cut there, and the ids of its chunks are the ids of the text. Ids of
    chunks are kept in a table of fixed size, found by the chunk's 64-bit hash; what has no place there is encoded again."""

    SLOTS, KEEP = 1 << 20, 6_000_000

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(file)
        self.encoder.encode_special_tokens = True  # the text of a special token is ordinary text
        self.whole = not cuttable(json.loads(self.encoder.to_str()))
        if self.whole:
            return
        vocabulary = self.encoder.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(x) for x in vocabulary]  # one character stands for a byte
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(self.SLOTS, np.uint64)
        self.at, self.size = np.zeros(self.SLOTS, np.int32), np.zeros(self.SLOTS, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def keep(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in flat each chunk's ids are, and how many."""
        if self.used > self.KEEP:
            self.clear()
        h = hash_spans(data, starts, ends) | np.uint64(1)  # 0 is an empty slot
        one = (h >> np.uint64(44)).astype(np.int64)
        two = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        slot = np.where(self.key[one] == h, one, two)
        at, size = self.at[slot].astype(np.int64), self.size[slot]
        missing = np.flatnonzero(self.key[slot] != h)
        if len(missing):
            new, first, back = np.unique(h[missing], return_index=True, return_inverse=True)
            rows = missing[first]
            ids, new_size = self.encoded(data, starts[rows], ends[rows])
            new_at = self.keep(ids) + np.cumsum(new_size) - new_size
            at[missing], size[missing] = new_at[back], new_size[back]
            place = np.where(self.key[one[rows]] == 0, one[rows], two[rows])
            self.key[place], self.at[place], self.size[place] = new, new_at, new_size
        return at, size

    def encoded(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks one after another, and how many each has. Chunks that start with white space and end
        with a letter are encoded many to a string, and parted again by the bytes that each id stands for."""
        size = np.zeros(len(starts), np.int64)
        many = SEPARATOR[data[starts]] & LETTER[data[ends - 1]]
        raw, found = data.tobytes(), []
        order = np.concatenate([np.flatnonzero(many), np.flatnonzero(~many)])
        joined = int(many.sum())
        spans = list(zip(starts[order].tolist(), ends[order].tolist(), strict=True))
        strings = [b"".join([raw[s:e] for s, e in spans[i : min(i + 1000, joined)]]).decode() for i in range(0, joined, 1000)]
        if joined:
            for x in self.encoder.encode_batch_fast(strings, add_special_tokens=False):
                found.append(np.array(x.ids, np.uint32))
            bounds = np.cumsum(ends[order[:joined]] - starts[order[:joined]])
            reached = np.searchsorted(np.cumsum(self.bytes_of[np.concatenate(found)]), bounds) + 1
            size[:joined] = np.diff(reached, prepend=0)
        if joined < len(order):
            for i, x in enumerate(self.encoder.encode_batch_fast([raw[s:e].decode() for s, e in spans[joined:]], add_special_tokens=False)):
                found.append(np.array(x.ids, np.uint32))
                size[joined + i] = len(x.ids)
        flat, at = np.concatenate(found), np.cumsum(size) - size
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        size, at = size[back], at[back]
        return flat[np.arange(len(flat)) + np.repeat(at - (np.cumsum(size) - size), size)], size

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts one after another, and the n + 1 places where each text's begin."""
        if self.whole:
            raw = data.tobytes()
            found = [np.array(x.ids, np.uint32) for x in self.encoder.encode_batch_fast([raw[s:e].decode() for s, e in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.cumsum([0, *map(len, found)])
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        space = SEPARATOR[data]
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[1:] |= LETTER[data[:-1]] & OTHER[data[1:]]
        for m in WIDE_SPACE.finditer(data):
            if m.end() < len(data):
                begin[m.end()] = False
        begin[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(begin)
        at, size = self.look_up(data, starts, np.append(starts[1:], len(data)))
        to = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.arange(to[-1]) + np.repeat(at - to[:-1], size)], to[np.searchsorted(starts, offsets)]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32 and, if asked for, ids): each text's ids and end_id, cut only where
    there are more than `length`; the first piece then takes what is over. Null text: empty, one piece of end_id alone."""
    file = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ChunkTokenizer(file)  # goes with the task: workers live on, and an executor's memory counts what they keep
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column(1)):
                flat, to = own.ids(data, offsets)
                rows: list[tuple] = []
                for i in range(hi - lo):
                    line = np.append(flat[to[i] : to[i + 1]], np.uint32(end_id))
                    over = len(line) % length if len(line) > length else len(line)
                    cuts = [0, *range(over or length, len(line) + 1, length)]
                    for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append((lo + i, k, s, e - s, zlib.crc32(line[s:e].astype("<u4").tobytes()), line[s:e] if with_ids else None))
                doc, *cols, ids = zip(*rows, strict=True)
                arrays = [batch.column(0).take(pa.array(doc)), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.record_batch(arrays, names=[*names, "ids"][: len(arrays)])
        del own
        trim()

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


class OpenBins:
    """A fixed number of open bins. Bit f of one integer is set if an open bin has f free places: the best fit is
    the lowest bit set from the item's size up, and the fullest bin is the lowest bit set of all."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.free, self.open, self.made = size, most, 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def take(self, free: int) -> int:
        bins = self.bins[free]
        number = bins.pop()
        if not bins:
            self.free ^= 1 << free
        self.open -= 1
        return number

    def put(self, item: int) -> tuple[int, int]:
        """(bin, offset in it) of an item, at most as large as a bin."""
        fitting = self.free >> item
        if fitting:
            free = item + (fitting & -fitting).bit_length() - 1
            number = self.take(free)
        else:
            if self.open >= self.most:
                self.take((self.free & -self.free).bit_length() - 1)
            free, number = self.size, self.made
            self.made += 1
        if left := free - item:
            if not self.bins[left]:
                self.free |= 1 << left
            self.bins[left].append(number)
            self.open += 1
        return number, self.size - free


def best_fit(items: DataFrame, length: int = 2048, open_bins: int = 256, ahead: int = 512, group_rows: int = 100_000) -> DataFrame:
    """items (a column length, 1 to `length`) with sequence_id and offset. Items are dealt to streams of about group_rows, each
    packed online by one task into open_bins open bins: an item goes to the fullest bin that it fits in; where none does, the
    fullest bin of all closes for a new one. The stream is read `ahead` items at a time, the larger of them first. A
    stream's memory and time don't grow with the input. Repeated rows are items of their own."""
    n = items.count()
    many = max(1, -(-n // group_rows))
    keys = [c for c in items.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, group, held = OpenBins(length, open_bins), None, []

        def placed() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            size = table.column("length").to_numpy()
            at = np.zeros((len(size), 2), np.int64)
            for i in np.argsort(-size, kind="stable").tolist():
                at[i] = bins.put(int(size[i]))
            table = table.drop_columns(["_group"]).append_column("sequence_id", pa.array(at[:, 0] + (group << 32))).append_column("offset", pa.array(np.ascontiguousarray(at[:, 1])))
            yield from table.to_batches()

        for batch in batches:
            of, lo = batch.column(batch.schema.get_field_index("_group")).to_numpy(), 0
            while lo < batch.num_rows:
                if of[lo] != group:
                    if held:
                        yield from placed()
                    bins, group, held = OpenBins(length, open_bins), int(of[lo]), []
                hi = min(int(np.searchsorted(of, group, "right")), lo + ahead - sum(b.num_rows for b in held))
                held.append(batch.slice(lo, hi - lo))
                lo = hi
                if sum(b.num_rows for b in held) >= ahead:
                    yield from placed()
                    held = []
        if held:
            yield from placed()

    dealt = items.withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(many)))
    dealt = dealt.repartition(many, "_group").sortWithinPartitions("_group", F.xxhash64(F.lit(1), *keys), *keys)
    schema = ", ".join(f"`{c}` {t}" for c, t in items.dtypes)
    return dealt.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """token_pieces of docs with the sequence and offset of each. Empty and null texts are pieces of one token;
    repeated rows and null ids are pieces like others."""
    return best_fit(written(token_pieces(docs, id_col, text_col, tokenizer, length, end_id, with_ids), "pieces"), length)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
