import zlib

import numpy as np
import pyarrow as pa
from helpers import docs, odd

from ledgerleaf.llm import packing
from ledgerleaf.llm.textbytes import pieces


def encoder():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    t.encode_special_tokens = True
    return t


def test_chunk_ids_are_the_tokenizers():
    import random

    rng = random.Random(0)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "\t", " ", "　", "1", "22", ".", "'s", "'", "!?", "日", "\x1c", "<|endoftext|>", "\r\n", "x\u0085"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    want = [x.ids for x in encoder().encode_batch(texts, add_special_tokens=False)]
    own, got = packing.ChunkTokenizer(packing.default_tokenizer()), []
    for lo, hi, data, offsets in pieces(pa.array(texts)):
        flat, to = own.ids(data, offsets)
        got += [flat[to[i] : to[i + 1]].tolist() for i in range(hi - lo)]
    assert got == want


def test_pieces_and_places(spark):
    rows = [(r.doc_id, r.text) for r in odd(spark).collect()]
    got = packing.pack(odd(spark)).collect()
    want = []
    for i, t in rows:
        ids = [*encoder().encode(t or "", add_special_tokens=False).ids, 0]
        over = len(ids) % 2048 if len(ids) > 2048 else len(ids)
        cuts = [0, *range(over or 2048, len(ids) + 1, 2048)]
        want += [(i is None, i or 0, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 2048) + 1


def test_fullest_bin_closes_first():
    bins = packing.OpenBins(10, 2)
    assert [bins.put(x) for x in (7, 6, 5)] == [(0, 0), (1, 0), (2, 0)]  # bin 0, with 3 free, closed
    assert bins.put(3) == (1, 6) and bins.put(3) == (2, 5)


def test_empty_table(spark):
    assert packing.pack(docs(spark, [])).count() == 0


def test_other_tokenizers_are_encoded_text_by_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    texts = ["It's a  small text, isn't it?", "", "Another one.\n"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    flat, to = packing.ChunkTokenizer(file).ids(data, np.cumsum([0, *(len(t.encode()) for t in texts)]))
    plain = Tokenizer.from_file(file)
    assert [flat[to[i] : to[i + 1]].tolist() for i in range(3)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_streams_with_few_open_bins_fill_sequences(spark):
    import random

    rng = random.Random(1)
    sizes = [min(2048, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(6000)]
    items = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length long")
    for rows in (100_000, 1500):
        got = packing.best_fit(items, open_bins=64, ahead=100, group_rows=rows).collect()
        bins = {}
        for r in got:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(got) == len(sizes) and sorted(r.length for r in got) == sorted(sizes)
        for b in bins.values():
            b.sort()
            assert all(x + n == y for (x, n), (y, _) in zip(b, b[1:])) and b[0][0] == 0 and b[-1][0] + b[-1][1] <= 2048
        assert len(bins) <= 1.02 * sum(sizes) / 2048 + 16
