import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from revscope.llm import forest, topk

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, score string, rank int"
MORE = ("x", "y", "z", 1)
BAD = [(100001, None), (100002, [math.nan] * 8), (100003, [math.inf] + [0.0] * 7), (100004, [None] + [0.0] * 7), (None, [1.0] * 8)]


def rows(n=700, ties=250, dim=8):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(n, dim)).astype(np.float32)
    v[:ties] = v[0]
    out = [(i * 3, v[i].tolist()) for i in range(n)]
    out += [out[7], (21, [9.0] * dim), (60_000, [0.0] * dim), (60_020, [1.0, 2.0]), (60_040, [2.0, 1.0]), (60_060, [])]
    return [(a, b, 0, *MORE) for a, b in out + BAD]


def good(data, zero):
    kept = {}
    for i, v, *_ in data:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not zero and not any(v):
            continue
        kept[i] = min(kept.get(i, v), v)
    return kept


def brute(kept, k, score):
    out = {}
    for q, x in kept.items():
        if q % 20 == 0:
            found = sorted(((-score(x, y), c) for c, y in kept.items() if c != q and len(x) == len(y)))[:k]
            out[q] = [(c, -s) for s, c in found]
    return out


def by_query(got):
    out = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        out[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def integer_score(x, y):
    return sum(math.floor(64 * float(a)) * math.floor(64 * float(b)) for a, b in zip(x, y, strict=True))


@pytest.mark.parametrize("small", [False, True])
def test_topk_against_brute_force(spark, monkeypatch, small):
    if small:  # more blocks, coarser histograms: more passes
        monkeypatch.setattr("revscope.llm.vectors.ROWS", 100)
        monkeypatch.setattr("revscope.llm.vectors.QUERIES", 16)
    data = rows()
    got = by_query(topk.search(spark.createDataFrame(data, SCHEMA), 20, F.col("id") % 20 == 0).collect())
    want = brute(good(data, True), 20, integer_score)
    assert {q: v for q, v in want.items() if v} == dict(got)


def test_topk_blocks_meet_by_shuffles_and_pass_on_the_highest_bins(spark):
    state = spark.createDataFrame([(0, 2, [1.0, 2.0], 0.0, 1.0, 0.0)], "id long, dim int, v array<double>, low double, width double, above double")
    rows = spark.createDataFrame([(2, 0, b"", b"")], "dim int, rb long, ids binary, matrix binary")
    plan = topk._pairs(state, rows, 1, 1000)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan  # a block of queries stands beside each block of rows: many times its size
    ids, scores = np.arange(50, dtype="<i8"), np.arange(50.0)
    found = topk._histogram(3)(np.array([99]).tobytes(), np.array([1.0]).tobytes(), np.zeros(1).tobytes(), np.ones(1).tobytes(), ids.tobytes(), scores.tobytes())
    assert found.to_pydict() == {"id": [99] * 3, "bin": [47, 48, 49], "n": [1] * 3}


def test_topk_products_beyond_doubles():
    q, c = np.array([[2.0**40, 1.0]]), np.array([[2.0**15, 3.0], [2.0**40, 0.0]])
    assert topk.products(q, c).tolist() == [[2**55 + 3, 2**63 - 1]]


def test_forest_whole_probe_is_exact(spark):
    data = rows()
    got = by_query(forest.search(spark.createDataFrame(data, SCHEMA), 20, F.col("id") % 20 == 0, target_recall=1.0).collect())
    kept = good(data, False)
    want = brute(kept, 20, lambda x, y: float((np.array(x, float) * np.array(y, float)).sum()))
    want = {q: v for q, v in want.items() if v}
    assert set(want) == set(got)
    hits = 0
    for q, w in want.items():
        hits += len({c for c, _ in w} & {c for c, _ in got[q]})
        assert all(s == pytest.approx(float(np.dot(np.array(kept[q], float), np.array(kept[c], float)))) for c, s in got[q])
    assert hits >= 0.99 * sum(map(len, want.values()))


def test_forest_walk_visits_leaves_in_order_of_their_worst_margin():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 6))
    f = forest.fit(x, float(np.linalg.norm(x, axis=1).max()), 10, 0.9, leaf_rows=64)
    leaves = f.leaves(x)
    assert leaves.shape == (3000, 4) and leaves.max() < 2**f.depth
    order = f.walk(x[:5], 4 * 2**f.depth)
    assert all(len(set(o)) == 4 * 2**f.depth for o in order)
    near = sum(np.sum((leaves[:, t] == leaf)) for o in order for t, leaf in o[:f.visits]) / 5
    assert near < 4 * 3000  # fewer rows than all trees hold


def test_forest_recall_on_testdata(spark):
    sf = "/root/testdata/sf0.1"
    got = by_query(forest.op3_forest(spark, sf).collect())
    t = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    v, ids = np.array(t.embedding.tolist(), float), t.vec_id.to_numpy()
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = v @ v[i]
        s[i] = -np.inf
        want = set(ids[np.argsort(-s)[:20]])
        hits += len(want & {c for c, _ in got[ids[i]]})
        total += 20
    assert hits / total >= 0.9


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert topk.search(df, 20, F.col("id") % 20 == 0).count() == 0
    assert forest.search(df, 20, F.col("id") % 20 == 0).count() == 0
