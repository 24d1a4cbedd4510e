import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from revscope.llm import packing

TEXTS = ["the cat sat", None, "", "  ", "It's  A\tTEST\n\nline　two <|endoftext|>x 123,45!?", "Ünïcödé́ naïve é", "word " * 9000, "a" * 3000, "the cat sat"]
SCHEMA = "doc_id long, text string, length string, start int, r string"


def brute(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for x in texts]


def test_pieces_cover_every_id_once(spark):
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 1, "y"), (None, "no id", None, None, None)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), packing.default_vocabulary()).collect()
    ids = {i: x for i, x in enumerate(brute(TEXTS))} | {None: brute(["no id"])[0]}
    spans, sequences = defaultdict(list), defaultdict(list)
    for p in got:
        piece = ids[p.doc_id][p.start:p.start + p.length]
        assert p.doc_tokens == len(ids[p.doc_id]) and len(piece) == p.length > 0
        assert p.ids_crc32 == zlib.crc32(piece.tobytes())
        spans[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    assert spans.pop(3) == [(0, len(ids[3]))] * 2  # the repeated row is packed twice
    for i, s in spans.items():
        assert [a for a, _ in sorted(s)] == list(np.cumsum([0] + [n for _, n in sorted(s)])[:-1])
        assert sum(n for _, n in s) == len(ids[i])
    for s in sequences.values():
        assert [a for a, _ in sorted(s)] == list(np.cumsum([0] + [n for _, n in sorted(s)])[:-1])
        assert sum(n for _, n in s) <= 2048


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), packing.default_vocabulary()).count() == 0


def test_plan_uses_the_histogram_with_little_padding():
    rng = np.random.default_rng(0)
    lengths = np.clip(rng.lognormal(6, 1, 20_000).astype(int), 1, 2047)
    h = dict(zip(*map(lambda x: x.tolist(), np.unique(lengths, return_counts=True)), strict=True))
    used, sequences = defaultdict(int), 0
    for parts, n in packing.plan(h, 2048):
        assert sum(parts) <= 2048
        sequences += n
        for p in parts:
            used[p] += n
    assert dict(used) == h
    assert sequences * 2048 <= 1.005 * lengths.sum() + 2048
    assert packing.plan({}, 2048) == []


def test_nnls_against_a_small_exact_case():
    # combinations of lengths 1..3 filling 4: (1,3), (2,2), (1,1,2); the histogram is reachable
    columns = packing.combinations(np.array([1, 2, 3]), 4, 3)
    assert sorted(map(tuple, columns.tolist())) == [(0, 1, 3), (0, 2, 2), (1, 1, 2)]
    x = packing.nnls(columns, np.array([0, 9.0, 8.0, 5.0, 0]), 2000)
    by = {tuple(c): v for c, v in zip(columns.tolist(), x, strict=True)}
    assert by[0, 1, 3] == pytest.approx(5, abs=0.01) and by[1, 1, 2] == pytest.approx(2, abs=0.01) and by[0, 2, 2] == pytest.approx(3, abs=0.01)


def test_testdata_has_little_padding(spark):
    got = packing.op9_packing(spark, "/root/testdata/sf0.01")
    x = got.agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("s")).first()
    assert x.s * 2048 <= 1.01 * x.n
