"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question whose parameters were changed has the same template.
Windows of the template are joined by hash with those of the benchmark. Where enough of an item's windows are found,
its slots are compared with the text's: each value must stand for one value throughout, or the likeness is chance.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm.scratch import fields, rows_of, with_key
from ledgerleaf.llm.textbytes import LOWER_ASCII, Words, mixed, pieces

LITERAL, NUMBER, NAME, UNIT = range(4)
# Units of measure, in lower case.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms lb lbs oz pound pounds ounce ounces "
    "ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "metre metres meter meters kilometre kilometres kilometer kilometers mph kmh kph hz khz mhz ghz w kw mw kwh j kj v kv pa kpa bar kb mb gb tb "
    "dollar dollars cent cents euro euros usd eur gbp inr rupee rupees crore lakh million billion percent pct degree degrees celsius fahrenheit"
).split()

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    return np.unique(Words(data, np.array([0, len(data)])).hashes())


_UNITS = _unit_hashes()


@dataclass
class Template:
    words: Words  # without punctuation at their ends; those that are nothing else are left out
    hashes: np.ndarray
    kinds: np.ndarray
    plain: np.ndarray  # hashes of the words themselves, in lower case
    heads: np.ndarray  # whether a word is the first of its line


def template(data: np.ndarray, offsets: np.ndarray) -> Template:
    """The words of texts with their kinds. A word with a digit is a number; a capitalised one in mid-sentence, with a
    small letter too, is a name; all others are in lower case."""
    words = Words(data, offsets)
    lower = LOWER_ASCII[data]
    if len(data):
        lower[1:] += ((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)).astype(np.uint8) * 32
    starts, ends = words.starts.copy(), words.ends.copy()
    while (at := np.flatnonzero((starts < ends) & _PUNCTUATION[data[np.minimum(starts, len(data) - 1)]])).size:
        starts[at] += 1
    while (at := np.flatnonzero((starts < ends) & _PUNCTUATION[data[ends - 1]])).size:
        ends[at] -= 1
    opens = np.ones(len(words), bool)  # at a sentence's start
    if len(words) > 1:
        closing = np.isin(data[words.ends[:-1] - 1], np.frombuffer(b".!?:;", np.uint8))
        opens[1:] = closing | (data[words.starts[1:] - 1] == 10)
        opens[words.first[:-1][words.counts > 0]] = True
    keep = starts < ends
    text = words.text_of()[keep]
    words.starts, words.ends, opens = starts[keep], ends[keep], opens[keep]
    words.first = np.searchsorted(text, np.arange(len(offsets)))
    words.counts = np.diff(words.first)
    h = words.hashes(lower)
    kinds = np.zeros(len(h), np.uint8)
    if len(h):
        head = data[words.starts]
        wide = (head == 0xC3) & (data[np.minimum(words.starts + 1, len(data) - 1)] <= 0x9E)
        small = ((data >= 97) & (data <= 122)) | (np.append(0, data[:-1]) == 0xC3) & (data >= 0x9F)
        small = np.concatenate([[0], np.cumsum(small)])
        mixed_case = small[words.ends] > small[words.starts]  # else the whole text may be in capitals
        kinds[(((head >= 65) & (head <= 90)) | wide) & ~opens & mixed_case] = NAME
        kinds[np.isin(h, _UNITS)] = UNIT
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        kinds[digits[words.ends] > digits[words.starts]] = NUMBER
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    heads = np.ones(len(h), bool)
    heads[1:] = breaks[words.starts[1:]] > breaks[words.ends[:-1]]
    heads[words.first[:-1][words.counts > 0]] = True
    return Template(words, np.where(kinds == LITERAL, h, mixed(kinds.astype(np.uint64))), kinds, h, heads)


TYPED, PLAIN = 0, 1


def windows(t: Template, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(TYPED, hashes of a template's windows of `size` words, at least half of them literal, and their first words), and the same of
    the words themselves (PLAIN). A window of one or two words is PLAIN, and a line of its own."""
    if size >= 3:
        h, at = t.words.runs(t.hashes, size)
        literal = np.concatenate([[0], np.cumsum(t.kinds == LITERAL)])
        rich = 2 * (literal[at + size] - literal[at]) >= size
        yield TYPED, h[rich] + np.uint64(size), at[rich]
    h, at = t.words.runs(t.plain, size)
    if size < 3:
        ends = np.append(t.heads[1:], True)
        alone = t.heads[at] & ends[at + size - 1] & ~np.any([t.heads[at + i] for i in range(1, size)] or [np.zeros(len(at), bool)], axis=0)
        h, at = h[alone], at[alone]
    yield PLAIN, mixed(h + np.uint64(size)), at


def values(t: Template, lo: int, hi: int, data: np.ndarray) -> list[tuple[int, bytes]]:
    """Kind and lower-case bytes of words lo to hi."""
    raw = LOWER_ASCII[data[t.words.starts[lo] : t.words.ends[hi - 1]]].tobytes() if hi > lo else b""
    base = int(t.words.starts[lo]) if hi > lo else 0
    return [(int(t.kinds[i]), raw[t.words.starts[i] - base : t.words.ends[i] - base]) for i in range(lo, hi)]


def consistent(pairs: list[tuple[int, bytes, bytes]], least: float = 0.8) -> bool:
    """Whether values stand for values one to one, but for a few: pairs of (kind, benchmark's, text's)."""
    if not pairs:
        return True
    there, back = defaultdict(Counter), defaultdict(Counter)
    for kind, a, b in pairs:
        there[kind, a][b] += 1
        back[kind, b][a] += 1
    return all(sum(max(c.values()) for c in way.values()) >= least * len(pairs) for way in (there, back))


class Index:
    """The benchmark's windows by hash, and its items' words for the comparison of slots."""

    def __init__(self, ids: list[int], texts: list[str], size: int):
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
        t = template(data, offsets)
        self.ids = ids
        self.values = [values(t, t.words.first[i], t.words.first[i + 1], data) for i in range(len(ids))]
        count = t.words.counts
        rows = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self.sizes = sorted({min(size, int(c)) for c in count if c})
        for s in self.sizes:
            for way, h, at in windows(t, s):
                item = t.words.text_of()[at]
                own = np.minimum(count[item], size) == s
                rows.append((h[own], item[own] * 2 + way, t.words.place()[at][own]))
        h, item, place = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.place = h[order], item[order], place[order]
        self.total = np.bincount(self.item, minlength=2 * len(ids))
        bits = np.zeros(1 << 20, bool)
        bits[(self.h >> np.uint64(44)).astype(np.int64)] = True
        self.bits = bits

    def hits(self, t: Template) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, TYPED or PLAIN, windows found, offset of the text's words from the item's) where any is found."""
        found: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        of, place = t.words.text_of(), t.words.place()
        for s in self.sizes:
            for _, h, at in windows(t, s):
                maybe = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
                lo = np.searchsorted(self.h, h[maybe])
                hi = np.searchsorted(self.h, h[maybe], "right")
                for a, x, y in zip(at[maybe[lo < hi]].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                    for k in range(x, y):
                        found[int(of[a]), int(self.item[k])].append((int(self.place[k]), int(place[a])))
        for (text, item), pairs in found.items():
            shift = Counter(p - q for q, p in pairs).most_common(1)[0][0]
            yield text, item // 2, item % 2, len({q for q, _ in pairs}), shift

    def verified(self, t: Template, data: np.ndarray, text: int, item: int, shift: int) -> tuple[bool, bool]:
        """Whether the slots agree, and whether any value was changed."""
        lo, hi = int(t.words.first[text]), int(t.words.first[text + 1])
        a, b = max(lo, lo + shift), min(hi, lo + shift + len(self.values[item]))
        pairs = [(k, v, w) for (k, v), (kind, w) in zip(self.values[item][a - lo - shift :], values(t, a, b, data), strict=False) if k == kind != LITERAL]
        return consistent(pairs), any(v != w for _, v, w in pairs)

    def items_in(self, data: np.ndarray, offsets: np.ndarray, least: float) -> list[tuple[int, int, float, bool]]:
        """(text, item id, share of windows found, whether values were changed) of each item of which a share `least` of the
        windows is in a text, either of its words or of its template with agreeing slots."""
        t = template(data, offsets)
        best: dict[tuple[int, int], tuple[float, bool]] = {}
        for text, item, way, n, shift in self.hits(t):
            share = n / float(self.total[2 * item + way])
            if share >= least:
                agree, changed = self.verified(t, data, text, item, shift)
                if agree or way == PLAIN:
                    old = best.get((text, item), (0.0, True))
                    best[text, item] = max(share, old[0]), changed and old[1]
        return [(text, self.ids[item], share, changed) for (text, item), (share, changed) in best.items()]


FOUND = "key long, item_id long, containment double, reparameterised boolean"


def parts_of(benchmark: DataFrame, size: int, part_items: int) -> Iterator[Broadcast]:
    """The index of benchmark (item_id, text), in parts of about part_items items that are each broadcast."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    parts = max(1, -(-items.count() // part_items))
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").toPandas()
        yield benchmark.sparkSession.sparkContext.broadcast(Index(rows.item_id.tolist(), rows.text.tolist(), size))


def matches(docs: DataFrame, index: Broadcast, least: float) -> DataFrame:
    """FOUND rows of docs (_k, text) for each item that is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for lo, _, data, offsets in pieces(batch.column(1)):
                rows = [(int(keys[lo + text]), *found) for text, *found in index.value.items_in(data, offsets, least)]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.bool_()), strict=True)], names=["key", "item_id", "containment", "reparameterised"])

    return docs.select("_k", "text").mapInArrow(run, FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", size: int = 8, least: float = 0.5, part_items: int = 20_000) -> DataFrame:
    """The rows of docs that hold no item of benchmark, each judged where it is read. As `contained` in all else."""
    rows = rows_of(docs)

    def keep(index: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fine = np.ones(batch.num_rows, bool)
                for lo, _, data, offsets in pieces(batch.column(0).field(text_col)):
                    fine[[lo + text for text, *_ in index.value.items_in(data, offsets, least)]] = False
                yield batch.filter(pa.array(fine))

        return run

    for index in parts_of(benchmark, size, part_items):
        rows = rows.mapInArrow(keep(index), rows.schema)
    return rows.select(*fields(docs.columns))


def contained(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 8, least: float = 0.5, part_items: int = 20_000) -> DataFrame:
    """(id, n_items, item_id, containment, reparameterised, contaminated) of every row of docs: how many items of benchmark
    (item_id, text) it holds, that with the most windows found (ties: the smallest id), and whether that one's values differ.

    An item is found by its words, or by its template where half of a window's words are literal: with changed values, one that
    is mostly values cannot be told from chance. An item shorter than a window is one window; one of fewer than three words is only
    found where it is a line of its own. Null items and those without words match nothing.

    The benchmark's index is broadcast in parts of part_items items, each a pass over docs, so no part outgrows a task
    however long the benchmark is. Null and blank texts hold nothing. Repeated ids and rows are judged one by one; other
    columns are left out."""
    keyed = with_key(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    found = None
    for index in parts_of(benchmark, size, part_items):
        some = matches(keyed, index, least)
        found = some if found is None else found.unionByName(some)
    best = found.groupBy("key").agg(F.countDistinct("item_id").alias("n_items"), F.max(F.struct("containment", -F.col("item_id"), "reparameterised")).alias("b"))
    best = best.select("key", "n_items", (-F.col("b.col2")).alias("item_id"), "b.containment", "b.reparameterised")
    joined = keyed.select("id", "_k").join(best, F.col("_k") == F.col("key"), "left")
    return joined.select("id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "item_id", F.coalesce("containment", F.lit(0.0)).alias("containment"), F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"), F.col("key").isNotNull().alias("contaminated"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumnRenamed("id", "doc_id")
