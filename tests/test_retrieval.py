"""Index search equals brute force (numpy) on clustered vectors."""

import numpy as np
import pytest

from revscope.operators import retrieval

LABELS = ["negative", "neutral", "positive"]


def make(spark, n=240, q=40, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dim))
    x = centers[rng.integers(0, 6, n)] + 0.3 * rng.normal(size=(n, dim))
    x[5] = x[4]  # an exact tie: row_id breaks it
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    lab = [LABELS[i % 2 * 2] if i % 7 else "neutral" for i in range(n)]
    corpus = spark.createDataFrame([(i, lab[i], [float(v) for v in x[i]]) for i in range(n)],
                                   "row_id long, label string, embedding array<float>")
    qv = centers[rng.integers(0, 6, q)] + 0.4 * rng.normal(size=(q, dim))
    qv = qv / np.linalg.norm(qv, axis=1, keepdims=True)
    foci = [None, "negative", "Positive", "missing", "neutral"]
    qs = spark.createDataFrame([(j, [float(v) for v in qv[j]], foci[j % 5]) for j in range(q)],
                               "q_id long, q_vec array<float>, focus string")
    xf = np.array([[float(np.float32(v)) for v in r] for r in x])
    qf = np.array([[float(np.float32(v)) for v in r] for r in qv])
    return corpus, qs, xf, qf, lab, foci


def brute(xf, qf, lab, foci, k):
    present = set(lab)
    out = {}
    for j, qv in enumerate(qf):
        f = foci[j % 5]
        eff = f.lower() if f and f.lower() in present else None
        cand = [(round(1 - float(np.dot(qv, xf[i])), 6) + 0.0, i) for i in range(len(xf)) if eff is None or lab[i] == eff]
        out[j] = [i for _, i in sorted(cand)[:k]]
    return out


def hits_of(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r.q_id, r.rank)):
        got.setdefault(r.q_id, []).append(r.row_id)
    return got


@pytest.mark.parametrize("tile_rows", [4096, 7])
def test_index_search_is_exact(spark, tile_rows):
    corpus, qs, xf, qf, lab, foci = make(spark)
    idx = retrieval.build_index(corpus, tile_rows=tile_rows)
    assert idx.tiles.count() >= (3 if tile_rows > 100 else 20)
    assert hits_of(retrieval.search(qs, idx, top_k=5).collect()) == brute(xf, qf, lab, foci, 5)


def test_k_larger_than_corpus(spark):
    corpus, qs, xf, qf, lab, foci = make(spark, n=12, q=5)
    idx = retrieval.build_index(corpus, materialize=False)
    assert hits_of(retrieval.search(qs, idx, top_k=50).collect()) == brute(xf, qf, lab, foci, 50)


def test_any_length_null_labels_and_zero_vectors(spark):
    corpus = spark.createDataFrame([(1, None, [0.0, 3.0]), (2, "a", [5.0, 0.0]), (3, None, [0.0, 0.0]), (4, "a", [-1.0, -1.0]), (5, "a", None)],
                                   "row_id long, label string, embedding array<double>")
    qs = spark.createDataFrame([(1, [0.0, 0.5], None), (2, [9.0, 0.0], "A"), (3, [0.0, 0.0], "b"), (4, None, None)], "q_id long, q_vec array<double>, focus string")
    got = retrieval.search(qs, retrieval.build_index(corpus), top_k=4).collect()
    assert hits_of(got) == {1: [1, 2, 3, 4], 2: [2, 4], 3: [1, 2, 3, 4]}
    by = {(r.q_id, r.row_id): r.distance for r in got}
    assert by[1, 1] == 0 and by[1, 2] == 1 and by[1, 3] == 1 and by[1, 4] == pytest.approx(1.707107) and by[3, 2] == 1


def test_empty_corpus_gives_no_hits(spark):
    corpus = spark.createDataFrame([], "row_id long, label string, embedding array<double>")
    qs = spark.createDataFrame([(1, [0.0, 0.5], "a")], "q_id long, q_vec array<double>, focus string")
    assert retrieval.search(qs, retrieval.build_index(corpus), top_k=4).count() == 0


def test_encoder_embeds_questions_like_the_corpus(spark):
    docs = spark.createDataFrame([(1, "red apples and pears"), (2, "fast cars on roads"), (3, None), (4, "apples pears plums")], "row_id long, text string")
    enc = retrieval.fit_encoder(docs, dim=64)
    rows = {r.row_id: r.embedding for r in retrieval.encode(docs, enc).collect()}
    assert sum(x * x for x in rows[1]) == pytest.approx(1, abs=1e-5) and not any(rows[3])
    labelled = retrieval.encode(docs, enc).selectExpr("row_id", "'x' AS label", "embedding", "text", "1 AS label_id", "'train' AS split")
    idx = retrieval.build_index(labelled, payload=("text", "label_id", "split"))
    from revscope.operators.ask import ask
    from revscope.operators.qa import GeneratorConfig

    asked = spark.createDataFrame([(1, "apples pears plums", 1, None), (2, "fast cars", 2, "llm")], "q_id long, question string, top_k int, generation_mode string")
    got = {r.q_id: r for r in ask(asked, idx, enc).collect()}
    assert [c.row_id for c in got[1].contexts] == [4] and got[2].contexts[0].row_id == 2 and len(got[2].contexts) == 2
    cfg = GeneratorConfig(mode="extractive", model="m", base_url="http://h/v1")
    got = {r.q_id: r for r in ask(asked, idx, enc, cfg, generator=lambda prompt: "G").collect()}
    assert (got[1].generation_mode, got[2].generation_mode, got[2].answer) == ("extractive", "llm", "G")


def test_focus_read_off_the_question_filters_the_search(spark):
    corpus = spark.createDataFrame([(1, "positive", [1.0, 0.0], "good", 2, "train"), (2, "negative", [0.0, 1.0], "bad", 0, "train")],
                                   "row_id long, label string, embedding array<double>, text string, label_id int, split string")
    idx = retrieval.build_index(corpus, payload=("text", "label_id", "split"))
    from revscope.operators.ask import ask

    q = spark.createDataFrame([(1, "почему всё плохо?", [1.0, 0.0], 1)], "q_id long, question string, q_vec array<double>, top_k int")
    r = ask(q, idx).first()
    assert r.sentiment_focus == "negative" and [c.row_id for c in r.contexts] == [2] and "negative (1/1)" in r.answer


def test_a_vector_is_shipped_once_per_block_and_only_k_rows_of_a_block_leave(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist(), ["a", "b", None][i % 3]) for i in range(600)]
    asked = [(i, rng.integers(-2, 3, 4).astype(float).tolist(), ["a", None, "zz"][i % 3], i % 5) for i in range(90)]
    monkeypatch.setattr(retrieval, "TILE_QUESTIONS", 8)
    monkeypatch.setattr(retrieval, "LEAST_BLOCKS", 3)
    index = retrieval.build_index(spark.createDataFrame(rows, "row_id long, embedding array<double>, label string"), tile_rows=16)
    q = spark.createDataFrame(asked, "q_id long, q_vec array<double>, focus string, k int")
    got = {(r.q_id, r["rank"]): (r.distance, r.row_id, r.label) for r in retrieval.search(q, index, focus_col="focus", k_col="k").collect()}
    want = {}
    for q_id, v, focus, k in asked:
        near = []
        for row_id, x, label in rows:
            if focus != "a" or label == "a":
                n = np.linalg.norm(v) * np.linalg.norm(x)
                near.append((np.floor((1 - (np.dot(v, x) / n if n else 0)) * 1e6 + 0.5) / 1e6, row_id, label))
        want |= {(q_id, i + 1): x for i, x in enumerate(sorted(near, key=lambda x: x[:2])[:k])}
    assert got == want
    assert retrieval._per_block(1000, 4096, 64) == 16 and retrieval._per_block(1000, 4096, 256) == 4 and retrieval._per_block(7, 4096, 64) == 3


def test_norm_of_a_wide_vector_is_computed_once(spark):
    import time

    from pyspark.sql import functions as F

    from revscope.functions.vector import normalize

    wide = spark.range(8).select("id", F.transform(F.sequence(F.lit(1), F.lit(8192)), lambda x: (x + F.col("id")).cast("double")).alias("v")).localCheckpoint()
    began = time.monotonic()
    rows = wide.select("v", normalize("v").alias("u")).collect()
    assert time.monotonic() - began < 20  # minutes, when every component computed the norm
    for r in rows:
        assert np.allclose(r.u, np.array(r.v) / np.linalg.norm(r.v), rtol=1e-12, atol=0)
    flawed = spark.createDataFrame([(0, [0.0, 0.0]), (1, None), (2, [3.0, None, 4.0]), (3, []), (4, [3.0, 4.0])], "id long, v array<double>")
    assert [r.u for r in flawed.select("id", normalize("v").alias("u")).orderBy("id").collect()] == [[0.0, 0.0], None, [0.0, 0.0, 0.0], [], [0.6, 0.8]]


def test_hashed_encoder_equals_plain_counting(spark):
    import hashlib
    import re

    texts = ["one two two Three", None, "", "a b", "three three four"]
    docs = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string").repartition(3)
    enc = retrieval.fit_encoder(docs, dim=16)
    buckets = [[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 16 for w in re.findall(r"\b\w\w+\b", (t or "").lower())] for t in texts]
    df = np.array([sum(i in b for b in buckets) for i in range(16)])
    assert np.allclose(enc.idf, np.log(6 / (1 + df)) + 1)
    for r in retrieval.encode(docs, enc).collect():
        v = np.bincount(buckets[r.row_id], minlength=16) * np.array(enc.idf)
        norm = np.linalg.norm(v)
        assert np.allclose(r.embedding, v / norm if norm else v)
