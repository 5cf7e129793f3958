"""Tables out of the blocks of a page: rows and columns are gaps and islands over the blocks' coordinates.

A block is a piece of text with its box (x0, x1 from the left, y0, y1 from the top). Blocks that overlap vertically make a band; bands of two
cells or more that follow each other closely make a table; the gaps that run through all of a table's bands below the first part its columns.
Spark brings the blocks of a page together and in order, once; a task then numbers those of many pages at a time by their coordinates, and
holds an Arrow batch and a page, however long the document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["document_id", "page_num"]


def _starts(of: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it; the first does."""
    return np.append(True, of[1:] != of[:-1])[: len(of)]


def _reach(of: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The largest end before each row within its group, NaN the largest as in SQL; undefined for a group's first. Groups ascend."""
    n, order = len(ends), np.argsort(ends, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    best = np.maximum.accumulate(of * n + rank) % max(n, 1)  # a later group's keys are above all of an earlier one's
    return ends[order[np.append(0, best[:-1])[:n]]]


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a > b, NaN the largest as in SQL."""
    return ~(a <= b) & ~np.isnan(b)


def _joined(texts: pa.Array, counts: np.ndarray) -> pa.Array:
    """Texts that follow each other, so many a row, with blanks between them."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(_offsets(counts), pa.int32()), texts), " ")


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(counts))


def _columns(table: np.ndarray, x0: np.ndarray, x1: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each piece's column and how many gaps each table has: those that its pieces below the header leave, parted in their middles. A piece
    goes where its own middle is."""
    along = np.flatnonzero(body)
    along = along[np.lexsort((x0[along], table[along]))]
    of, left, reach = table[along], x0[along], _reach(table[along], x1[along])
    gap = ~_starts(of) & _over(left, reach)
    edge_table, edge = of[gap], (left[gap] + reach[gap]) / 2
    edges = np.bincount(edge_table, minlength=table.max(initial=-1) + 1)
    piece = np.append(np.zeros(len(edge), bool), np.ones(len(table), bool))
    order = np.lexsort((piece, np.append(edge, (x0 + x1) / 2), np.append(edge_table, table)))  # an edge before a middle upon it
    passed = np.empty(len(order), np.int64)
    passed[order] = np.cumsum(~piece[order])
    return passed[piece] - _offsets(edges)[table], edges


def _blocks(rows: pa.Table) -> tuple[np.ndarray, pa.Array, list[np.ndarray]]:
    """The page of each block of whole pages, counted from 0, its text and its box; those without text or with an empty or null box left out."""
    parts = rows["blocks"].combine_chunks()
    of = np.repeat(np.cumsum(_starts(rows["page"].to_numpy())) - 1, pc.fill_null(pc.list_value_length(parts), 0).to_numpy())
    blocks = parts.flatten()
    text, *box = (pc.struct_field(blocks, c) for c in ("text", "x0", "x1", "y0", "y1"))
    text, null = pc.utf8_trim(text, " "), np.any([x.is_null().to_numpy(zero_copy_only=False) for x in box], axis=0)
    x0, x1, y0, y1 = box = [x.cast(pa.float64()).to_numpy(zero_copy_only=False) for x in box]
    fine = pc.fill_null(pc.not_equal(text, ""), False).to_numpy(zero_copy_only=False) & ~null & ~_over(x0, x1) & ~_over(y0, y1)
    return of[fine], text.filter(pa.array(fine)), [x[fine] for x in box]


def _rightward(band: np.ndarray, x0: np.ndarray, x1: np.ndarray, text: pa.Array) -> np.ndarray:
    """Blocks in order of band, x0, x1 and text."""
    along = np.lexsort((x1, x0, band))
    b, left, right = band[along], x0[along], x1[along]
    if np.any((b[1:] == b[:-1]) & ~_over(left[1:], left[:-1]) & ~_over(right[1:], right[:-1])):
        rank = np.empty(len(band), np.int64)
        rank[pc.sort_indices(text).to_numpy()] = np.arange(len(band))
        along = np.lexsort((rank, x1, x0, band))
    return along


def _tables(rows: pa.Table, cell_gap: float, band_gap: float) -> pa.Table:
    """The tables of whole pages, which come page by page."""
    of, text, (x0, x1, y0, y1) = _blocks(rows)
    # a block that starts below the middle of all before it, as far down as they reach, opens a band
    down = np.lexsort((y0, of))
    low = _reach(of[down], ((y0 + y1) / 2)[down])
    band = np.empty(len(of), np.int64)
    band[down] = np.cumsum(_starts(of[down]) | _over(y0[down], low)) - 1
    along = _rightward(band, x0, x1, text)
    band, x0, x1, y0, y1, of = band[along], x0[along], x1[along], y0[along], y1[along], of[along]
    # in a band, blocks less than cell_gap apart are one piece of text
    first = np.flatnonzero(_starts(band) | ~(x0 - _reach(band, x1) < cell_gap))
    text = _joined(text.take(pa.array(along)), np.diff(np.append(first, len(band))))
    left, right, piece_band, at = x0[first], np.maximum.reduceat(x1, first), band[first], np.flatnonzero(_starts(band))
    top, bottom, page, pieces = np.fmin.reduceat(y0, at), np.maximum.reduceat(y1, at), of[at], np.bincount(piece_band)
    # a band of one piece, or one further below the last than band_gap times the last's height, ends a table; one of a single band is none
    far = _over(top[1:] - bottom[:-1], band_gap * (bottom[:-1] - top[:-1]))
    run = np.cumsum(_starts(page) | (pieces < 2) | np.append(True, (pieces[:-1] < 2) | far)) - 1
    inside = (np.bincount(run) > 1)[run]
    header = _starts(run)[inside]
    table, line = np.cumsum(header) - 1, np.cumsum(inside) - 1
    kept = np.flatnonzero(inside[piece_band])
    line_of = line[piece_band[kept]]
    column, edges = _columns(table[line_of], left[kept], right[kept], ~header[line_of])
    # every line has a cell for each of its table's columns
    cell = _offsets(edges[table] + 1)
    place, left, text = cell[line_of] + column, left[kept], text.take(pa.array(kept))
    texts = _joined(text.take(pa.array(_rightward(place, left, left, text))), np.bincount(place, minlength=cell[-1]))
    lines = pa.ListArray.from_arrays(pa.array(cell, pa.int32()), texts)
    tables = pa.ListArray.from_arrays(pa.array(np.append(np.flatnonzero(header), len(table)), pa.int32()), lines)
    on = page[inside][header]
    new = np.flatnonzero(_starts(on))
    number = np.arange(len(on)) - np.repeat(new, np.diff(np.append(new, len(on)))) + 1
    whose = rows.select(PAGE).take(pa.array(np.flatnonzero(_starts(rows["page"].to_numpy()))[on]))
    return whose.append_column("table", pa.array(number, pa.int32())).append_column("cells", tables)


def _in_pages(cell_gap: float, band_gap: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of a page that the next batch may go on with
        for batch in batches:
            page = batch["page"].to_numpy()
            last = held[-1]["page"].to_numpy()[-1:] if held else page[:0]
            starts = np.flatnonzero(_starts(np.append(last, page))[len(last) :])
            if len(starts) and (whole := [b for b in [*held, batch.slice(0, starts[-1])] if b.num_rows]):
                yield from _tables(pa.Table.from_batches(whole), cell_gap, band_gap).combine_chunks().to_batches()
            if len(starts):
                held, batch = [], batch.slice(starts[-1])
            held += [batch] if batch.num_rows else []
        if held:
            yield from _tables(pa.Table.from_batches(held), cell_gap, band_gap).combine_chunks().to_batches()

    return run


def tables_of_parts(parts: DataFrame, cell_gap: float = 8.0, band_gap: float = 1.5) -> DataFrame:
    """page_tables of rows (document_id, page_num, blocks), each with an array of blocks of a page, all of them or some: as sources.pages.read_pages
    gives them, or a line a row."""
    # a window, so that rows that are together by page are neither moved nor sorted again; a page is the least number of its rows
    rows = parts.select(*PAGE, "blocks", F.monotonically_increasing_id().alias("_row")).withColumn("page", F.min("_row").over(Window.partitionBy(*PAGE))).drop("_row")
    kinds = dict(rows.dtypes)
    found = rows.mapInArrow(_in_pages(cell_gap, band_gap), f"document_id {kinds['document_id']}, page_num {kinds['page_num']}, table int, cells array<array<string>>")
    return found.withColumn("table_id", F.concat_ws("_", F.lit("table"), "document_id", "page_num", "table"))


def page_tables(blocks: DataFrame, cell_gap: float = 8.0, band_gap: float = 1.5) -> DataFrame:
    """(document_id, page_num, table, table_id, cells): the tables of pages of blocks, each an array of rows of as many cells as it has
    columns, the header first; empty where a row has nothing in a column. Blocks less than cell_gap apart are one piece of text. A piece that
    spans several columns goes where its middle is; of several in a cell, blanks part them. Blocks without text or with an empty or null box
    are left out. What text.extracted takes as raw tables."""
    return tables_of_parts(blocks.select(*PAGE, F.array(F.struct("text", "x0", "x1", "y0", "y1")).alias("blocks")), cell_gap, band_gap)
