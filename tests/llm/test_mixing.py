import hashlib
import re
from collections import defaultdict

import pytest

from revscope.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target string, copies int, key string"


def brute(rows, weights=(5, 2, 1)):
    docs = []
    for r in rows:
        text = r[1] or ""
        digest = hashlib.md5(text.encode()).hexdigest()
        u = (int(hashlib.md5(f"mix:{'' if r[0] is None else r[0]}:{digest}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        docs.append([r[0], r[2], len(re.findall(r"[^\x20\x09-\x0D]+", text)), u, digest])
    sources = sorted({d[1] for d in docs}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(d[2] for d in docs if d[1] == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    full, budget = set(), 1.5 * sum(size.values())
    while True:
        free = [s for s in sources if s not in full]
        level = (budget - sum(2 * size[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level >= 2 * size[s]}
        if not over:
            break
        full |= over
    target = {s: 2.0 * size[s] if s in full else weight[s] * level for s in sources}
    taken = defaultdict(int)
    for s in sources:
        ratio = target[s] / size[s] if size[s] else 0
        certain, p, reached = int(ratio), ratio % 1, 0
        mean = size[s] / sum(d[1] == s for d in docs)
        for d in sorted((d for d in docs if d[1] == s), key=lambda d: (d[3] / (1 - d[3]) / ((mean + 1) / (d[2] + 1)) ** 0.5, d[0] is not None, d[0] or 0, d[4])):
            draw = p > 0 and reached + d[2] / 2 <= target[s] - certain * size[s]
            taken[d[0], s, d[4]] += (certain + draw) * d[2]
            reached += d[2]
    return target, taken


def rows():
    out = [(i, "w " * (i * 37 % 90 + 1), f"s{i % 3}" if i % 2 else "hot", "x", "y", 1, "k") for i in range(300)]
    out += [(1000, None, None, "x", "y", 1, "k"), (1001, "", "s0", "x", "y", 1, "k"), (1002, "a b", None, "x", "y", 1, "k"), (None, "no id", "s1", None, None, None, None)]
    return out + [out[5]] * 2 + [(2000, "big " * 30_000, "ünï", "x", "y", 1, "k"), (2001, "small", "ünï", "x", "y", 1, "k")]


def test_against_brute_force(spark):
    data = rows()
    got = mixing.mix(spark.createDataFrame(data, SCHEMA)).collect()
    target, taken = brute(data)
    assert len(got) == len(data)
    sums = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(target[r.src])
        assert r.copies <= 2
        sums[r.doc_id, r.src, r.digest] += r.copies * r.size
    assert dict(sums) == dict(taken)
    for s in target:
        biggest = max(r.size for r in got if r.src == s)
        assert abs(sum(r.copies * r.size for r in got if r.src == s) - target[s]) <= biggest / 2 + 1e-6


def test_reruns_agree_and_documents_come_as_often_as_taken(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    a = sorted(map(str, mixing.mix(df).collect()))
    assert a == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    n = mixing.mix(df).groupBy().sum("copies").first()[0]
    assert mixed.count() == n


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(df).count() == 0 and mixing.mixed_documents(df).count() == 0


def test_inclusion_odds_are_the_documents_own(spark):
    rows = [(i, "w " * (5 if i % 2 else 80), "a" if i < 4000 else "b", None, None, None, None) for i in range(5000)]
    got = [r for r in mixing.mix(spark.createDataFrame(rows, SCHEMA), weights=(1, 30)).collect() if r.src == "a"]
    share = {n: sum(r.copies for r in got if r.size == n) / sum(r.size == n for r in got) for n in (5, 80)}
    certain = min(r.copies for r in got)
    odds = {n: (x - certain) / (1 - (x - certain)) for n, x in share.items()}
    assert odds[5] / odds[80] == pytest.approx((81 / 6) ** 0.5, rel=0.25)
