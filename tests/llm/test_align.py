import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from revscope.llm import align
from revscope.llm.common import span_hashes, stored

SCHEMA = "doc_id long, text string, row int, pair string, told string"
TEXTS = [None, "", " ", "  ", "\n", "plain words and more words", "  two  blanks \n and\tlines \n\n end ", "naïve café Ünïcödé 終わり　wide hard   x",
         "<|endoftext|> <s> </s> <unk> <0x41>", "a▁b", "▁", "x" * 3000 + " " + "word " * 4000, "𝒳𝒴 emoji 🙂🙂 mixed7numbers 1234567 3.14",
         "don't it's we'll (brackets) [x]; {y}: \"q\"", "plain words and more words", "tab\t tab", "a \x00 b", "é combining", "trailing   ", "\u0085 next \u0085 x"]


def brute(rows):
    pair = align.Pair(*align.default_vocabularies())
    out, counts = [], Counter()
    for i, text in rows:
        entry = (i, 0, 0, [], [])
        if text:
            a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
            whole = (" " + text).encode()
            x, y = [pair.bytes_a[t] for t in a], [pair.bytes_b[t] for t in b]
            if b"".join(x) == whole == b"".join(y):
                ex, ey = list(accumulate(map(len, x))), list(accumulate(map(len, y)))
                both = sorted(set(ex) & set(ey))
                by_x, by_y = defaultdict(list), defaultdict(list)
                for e, t in zip(ex, a, strict=True):
                    by_x[both[bisect_left(both, e)]].append(t)
                for e, t in zip(ey, b, strict=True):
                    by_y[both[bisect_left(both, e)]].append(t)
                groups = [f"{','.join(map(str, by_x[c]))}|{','.join(map(str, by_y[c]))}" for c in both]
                links = [(by_x[c][-1], by_y[c][-1]) for c in both]
                entry = (i, len(a), len(b), groups, links)
        counts.update(entry[4])
        out.append(entry)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(i, a, b, len(g), len(k), sum(counts[x] == best[x[1]] for x in k), sum(counts[x] for x in k),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, a, b, g, k in out]


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA).repartition(3)
    a, b = align.default_vocabularies()
    found = stored(align.aligned(docs, a, b).withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups"), "aligned")
    got = align.link_counts(found, a, b).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    return sorted(map(tuple, got), key=str)


def test_against_whole_texts_encoded_plainly(spark):
    rng = random.Random(3)
    letters = " \t\n'.,ab cé終　 <|x1-"
    rows = list(enumerate(TEXTS)) + [(100 + i, "".join(rng.choice(letters) for _ in range(rng.randint(1, 120)))) for i in range(300)]
    rows += [(None, "null id"), (5, TEXTS[5]), (5, TEXTS[5])]
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_testdata(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = sorted(brute(rows), key=str)
    got = sorted((tuple(r) for r in align.op11_align(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == want
    assert sum(r[4] for r in got) == sum(r[3] for r in got) > 10_000


def test_identity_map():
    pair = align.Pair(*align.default_vocabularies())
    assert pair.cuts
    assert all(s < 0 or pair.bytes_a[i] == pair.bytes_b[s] for i, s in enumerate(pair.same.tolist()))
    assert (pair.same >= 0).sum() > 10_000


def test_forgetting_pieces_changes_nothing(spark, monkeypatch):
    pair = align.Pair(*align.default_vocabularies())
    few = align.Pieces(pair)
    monkeypatch.setattr(align, "CACHE_PIECES", 9)
    raw = b"one two three four five six seven eight one two"
    data, offsets = np.frombuffer(raw, np.uint8), np.array([0, 20, len(raw)])
    for _ in range(3):
        start, end, first = align._cut(data, offsets, True)
        n = few.find(raw, start, end, span_hashes(data, start, end))
        assert b";".join(few.groups[i] for i in n[first[0]:first[1]]) == pair.align(raw[:20].decode(), *next(pair.encode([raw[:20].decode()])))[0]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (1, "")]])
def test_nothing_to_align(spark, rows):
    assert run(spark, rows) == [(i, 0, 0, 0, 0, 0, 0, "") for i, _ in rows]
