import random
from collections import Counter

import numpy as np
import pytest

from revscope.llm import neardup
from revscope.llm.common import components, word_hashes

SCHEMA = "doc_id long, text string, id long, node string, n int, sketch string"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_alignment_against_plain_distance(monkeypatch):
    monkeypatch.setattr(neardup, "NARROW", 3)
    rng = random.Random(0)
    for _ in range(1500):
        a = [rng.randint(0, 6) for _ in range(rng.randint(0, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            i = rng.randint(0, len(b))
            b[i:i + rng.randint(0, 1)] = [rng.randint(0, 6)] * rng.randint(0, 2)
        most = rng.randint(0, 20)
        d = plain_distance(a, b)
        want = d if d <= most else None
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        assert neardup.edit_within(x, y, most) == want
        long, short = sorted((a, b), key=len, reverse=True)
        if len(long) > most and short:
            assert neardup._banded(long, short, most) == want


def words(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]))[2]


def test_sketch_against_brute_force():
    texts = ["a b c d e f g a b c d e f g h i", "one two", "", "x " * 30, "w1 w2 w3 w4 w5"]
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    n, sketch = neardup.sketches(np.concatenate(data), offsets)
    assert n.tolist() == [16, 2, 0, 30, 5]
    for i, d in enumerate(data):  # a text's sketch does not depend on its block
        assert neardup.sketches(d, np.array([0, len(d)]))[1].tolist() == [sketch[i].tolist()]
    assert not sketch[2].any() and len({tuple(s) for s in sketch.tolist()}) == 5
    from revscope.llm.common import mix, seeds, shingle_hashes

    w = words(texts[0])
    sh, _ = shingle_hashes(w, np.array([0, len(w)]), 5)
    seen, base = Counter(), []
    for s in sh:
        base.append(mix(np.array([s]) + np.array([seen[int(s)]], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0])
        seen[int(s)] += 1
    for t, seed in enumerate(seeds(neardup.SKETCHES, 77)):
        h = (np.array(base) ^ seed) * (seed | np.uint64(1))
        h ^= h >> np.uint64(32)
        value = np.array([seed])
        for p in sorted(np.argsort(h)[:neardup.PICKED]):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + sh[p:p + 1])
        assert value[0] == sketch[0][t]


def test_components_against_union_find(spark):
    rng = random.Random(1)
    for n, m in ((60, 45), (200, 199), (5, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if n != 200 else [(i, i + 1) for i in range(199)]
        root = list(range(n))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[max(find(a), find(b))] = min(find(a), find(b))
        got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
        assert got == {x: find(x) for e in edges for x in e if e[0] != e[1] or x in got}


def fixture():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, group = [], {}

    def add(t, g):
        group[len(rows)] = g
        rows.append(" ".join(t))

    for g in range(25):  # near copies: a few words changed, put in or taken out
        first = text(rng.choice([30, 120, 400]))
        add(first, g)
        for _ in range(rng.randint(0, 4)):
            t = list(first)
            for _ in range(max(1, len(t) // 50)):
                i = rng.randrange(len(t))
                t[i:i + rng.randint(0, 1)] = text(rng.randint(0, 2))
            add(t, g)
    boiler = text(60)  # unlike texts that share a passage
    for i in range(40):
        add(boiler + text(45), f"shared{i}")
    for _ in range(30):
        add("the same text again and again".split(), "copies")
    for t, g in (("one two", "two"), ("one two", "two"), ("one three", "three"), ("", "empty"), ("", "empty"), ("!!", "marks"), ("??", "other marks"), ("long " * 30_000, "long"), ("long " * 29_990, "long")):
        add([t], g)
    return rows, group


def test_classes_against_all_pairs(spark):
    rows, _ = fixture()
    data = [(i, t, 1, "x", 1, "y") for i, t in enumerate(rows)] + [(3, rows[3], 1, "x", 1, "y"), (None, rows[0], None, None, None, None), (len(rows), None, 0, "", 0, "")]
    texts = {i: t for i, t in enumerate(rows)} | {len(rows): ""}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    hashed = {i: words(t) for i, t in texts.items()}
    for i in texts:
        for j in range(i):
            n = max(len(hashed[i]), len(hashed[j]))
            if texts[i] == texts[j] or n and min(len(hashed[i]), len(hashed[j])) >= 0.8 * n and neardup.similar(hashed[i], hashed[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    df = spark.createDataFrame(data, SCHEMA)
    got = neardup.classes(df).collect()
    assert len(got) == len(data)
    assert {r.id: r.class_id for r in got if r.id != neardup._LAST} == {i: find(i) for i in texts}
    sizes = Counter(r.class_id for r in got)
    assert all(r.class_size == sizes[r.class_id] for r in got)
    kept = neardup.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in texts})


def test_empty_table_and_nulls_only(spark):
    assert neardup.classes(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, None, None, None, None, None)] * 2, SCHEMA)
    assert [r.class_size for r in neardup.classes(df).collect()] == [2, 2]
    assert neardup.deduplicated(df).count() == 1


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_query(spark, sf):
    got = neardup.op1_neardup(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.filter("class_id > doc_id").count() == 0


def test_stars_and_chains_against_all_colliding_pairs(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(20_000)]

    def edited(text, n):
        out = list(text)
        for i in rng.sample(range(len(out)), n):
            out[i] = rng.choice(vocabulary)
        return out

    texts = []
    for _ in range(2):  # one original and copies that are unlike each other
        base = [rng.choice(vocabulary) for _ in range(200)]
        texts += [base, *(edited(base, 24) for _ in range(200))]
    step = [rng.choice(vocabulary) for _ in range(200)]
    for _ in range(100):  # every text is an edited copy of the one before
        texts.append(step)
        step = edited(step, 16)
    rows = [" ".join(t) for t in texts]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in rows]
    got = {r.id: r.class_id for r in neardup.classes(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    sketch = [{(r, x) for r, x in enumerate(next(iter(neardup.sketches(d, np.array([0, len(d)]))[1])).tolist())} for d in raw]
    hashed, root = [words(t) for t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sketch[i] & sketch[j] and find(i) != find(j) and neardup.similar(hashed[i], hashed[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    for i in range(len(rows)):  # at least what all colliding pairs give
        assert got[i] == got[find(i)]
    assert max(Counter(got[i] for i in range(201)).values()) > 150


def test_every_class_keeps_one_document_whatever_its_id(spark):
    rng = random.Random(9)
    unlike = [" ".join(f"n{rng.randrange(10_000)}" for _ in range(40)) for _ in range(5)]
    rows = [(None, unlike[0]), (None, unlike[1]), (None, unlike[1]), (7, unlike[2]), (7, unlike[3]), (8, unlike[3]), (9, unlike[4])]
    kept = neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in kept) == sorted(unlike)
    assert {r.text: r.doc_id for r in kept}[unlike[3]] == 7


def block_of(texts):
    raw = [np.frombuffer(" ".join(t).encode(), np.uint8) for t in texts]
    return np.concatenate(raw), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


@pytest.mark.parametrize("length", [60, 200, 600])
@pytest.mark.parametrize(("share", "least"), [(0.8, 0.95), (0.83, 0.97), (0.85, 0.98), (0.87, 0.99), (0.9, 0.99)])
def test_recall_of_scattered_edits(length, share, least):
    rng, left, right = random.Random(length), [], []
    for _ in range(300):
        text = [f"w{rng.randrange(50_000)}" for _ in range(length)]
        left.append(text)
        right.append(list(text))
        for i in rng.sample(range(length), int((1 - share) * length + 1e-9)):
            right[-1][i] = f"x{rng.randrange(50_000)}"
    a, b = neardup.entries(*block_of(left))[1], neardup.entries(*block_of(right))[1]
    found = (a == b).any(1).mean()
    print(f"{length} words, similarity {share}: {found:.3f}, entries of {neardup.SHORT_K} words {(a == b)[:, neardup.SKETCHES:].mean():.3f}")
    assert found >= least


def test_sets_of_any_size_rule_pairs_out():
    import numpy as np

    from revscope.llm import common

    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (0, 3, 900, 1500, 1500, 3000, 10_000, 12_000)]
    near = sets[5].copy()
    near[:100] = rng.integers(0, 2**63, 100, dtype=np.uint64)
    sets.append(near)
    first = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    bits = common.set_bits(np.concatenate(sets), first)
    width, folded = common._folded_sets(bits)
    assert [w * 64 for w in width] == [1024, 1024, 2048, 4096, 4096, 8192, 32768, 32768, 8192]
    for i in range(len(sets)):
        for j in range(i):
            w = min(width[i], width[j])
            differ = int(np.bitwise_count(folded[w][i] ^ folded[w][j]).sum())
            true = len(set(sets[i].tolist()) ^ set(sets[j].tolist()))
            assert differ <= true
            a, b = np.array([len(sets[i])]), np.array([len(sets[j])])
            for bound in (common.edits_apart, common.jaccard_apart):
                if (i, j) == (8, 5):
                    assert differ <= bound(a, b, 0.8)[0]
                elif abs(len(sets[i]) - len(sets[j])) <= bound(a, b, 0.8)[0] and len(sets[i]) > 3:
                    assert differ > bound(a, b, 0.8)[0]


def test_a_star_of_copies_unlike_each_other_is_one_class_for_few_pairs(spark):
    """Each copy has 12% of its words replaced: 0.88 like the original, 0.775 like each other."""
    rng = random.Random(12)
    base = [f"b{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(500, " ".join(base))]
    for i in range(250):
        t = list(base)
        for k in rng.sample(range(200), 24):
            t[k] = f"x{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.class_id for r in neardup.classes(docs).collect()}
    assert sum(c == got[500] for c in got.values()) >= 0.97 * len(rows)
