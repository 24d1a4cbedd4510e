"""The approximate index: search against the exact one, versions of its folder, encoders."""

import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from revscope.operators import cells, encoders, retrieval
from revscope.operators.features import TermSpec
from revscope.sources import commits, index

LABELS = ["negative", "neutral", "positive"]


def make(spark, n=900, q=60, dim=20, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(25, dim))
    x = centers[rng.integers(0, 25, n)] + 0.25 * rng.normal(size=(n, dim))
    x[5] = x[4]  # a tie
    x[6] = 0
    corpus = spark.createDataFrame([(i, LABELS[i % 3] if i % 7 else None, x[i].tolist(), f"text {i}") for i in range(n)], "row_id long, label string, embedding array<double>, text string")
    foci = [None, "negative", "Positive", "missing"]
    qv = centers[rng.integers(0, 25, q)] + 0.3 * rng.normal(size=(q, dim))
    qv[7] = 0
    questions = spark.createDataFrame([(j, qv[j].tolist(), foci[j % 4]) for j in range(q)], "q_id long, q_vec array<double>, focus string")
    return corpus, questions


def rows_of(df):
    return sorted(map(tuple, df.select("q_id", "rank", "row_id", "label", "distance").collect()))


@pytest.mark.parametrize("center_bytes", [1 << 27, 0])
def test_all_cells_give_the_exact_result(spark, monkeypatch, center_bytes):
    monkeypatch.setattr(cells, "CENTER_BYTES", center_bytes)
    corpus, questions = make(spark, n=300 if not center_bytes else 900)
    idx = cells.build_cells(corpus, tile_rows=40)
    n = len(idx.model.centers)
    assert n > 10 and idx.cells.count() > n
    want = rows_of(retrieval.search(questions, retrieval.build_index(corpus), 5))
    assert rows_of(idx.search(questions, 5, probes=n)) == want


def test_what_leaves_a_task_is_bounded_by_blocks(spark, tmp_path):
    """Vectors that codes tell nothing about: a search moved nearly every pair of question and row, and each vector once per probed cell."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 48))
    corpus = spark.createDataFrame([(i, LABELS[i % 3], v.tolist()) for i, v in enumerate(x)], "row_id long, label string, embedding array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:400])], "q_id long, q_vec array<double>")
    idx = cells.build_cells(corpus)
    for probes in (len(idx.model.centers), 40):
        plan = idx.search(asked, 5, focus_col=None, probes=probes)
        assert plan.count() == 2000
        moved, node = [], [plan._jdf.queryExecution().executedPlan()]
        plan._jdf.queryExecution().executedPlan().execute().count()
        while node:
            at = node.pop()
            kind = at.getClass().getSimpleName()
            if kind == "ShuffleExchangeExec":
                moved.append(at.metrics().apply("shuffleRecordsWritten").value())
            if kind.startswith("AdaptiveSparkPlan"):
                node.append(at.executedPlan())
            elif kind.endswith("QueryStageExec"):
                node.append(at.plan())
            else:
                children = at.children()
                node.extend(children.apply(i) for i in range(children.size()))
        assert moved and max(moved) <= 400 * 5 * 6, moved


def test_questions_that_share_a_number(spark):
    corpus, questions = make(spark, n=200)
    idx = cells.build_cells(corpus)
    one = questions.filter("q_id = 3").drop("focus")
    once = [r[2] for r in rows_of(idx.search(one, 5, focus_col=None, probes=len(idx.model.centers)))]
    twice = [r[2] for r in rows_of(idx.search(one.union(one), 5, focus_col=None, probes=len(idx.model.centers)))]
    assert len(set(once)) == 5 and twice == [once[0]] * 4 + [once[1]]


def test_few_cells_find_most_of_it(spark):
    corpus, questions = make(spark, n=2000)
    idx = cells.build_cells(corpus)
    asked = questions.filter("q_id <> 7").drop("focus")
    exact = retrieval.search(asked, retrieval.build_index(corpus), 5, focus_col=None)
    assert len(idx.model.centers) > 30 and idx.metadata["probes"] <= len(idx.model.centers) // 3
    assert cells.recall_at_k(idx.search(asked, 5, focus_col=None), exact) >= 0.9
    assert cells.recall_at_k(idx.search(asked, 5, focus_col=None, rerank=40), exact) >= 0.85
    one = cells.recall_at_k(idx.search(asked, 5, focus_col=None, probes=1), exact)
    assert one < cells.recall_at_k(idx.search(asked, 5, focus_col=None, probes=8), exact)


def test_cells_grow_with_the_table(spark):
    rng = np.random.default_rng(0)
    for n in (1, 2, 100, 400):
        rows = cells.unit_rows(spark.createDataFrame([(i, "a", rng.normal(size=3).tolist()) for i in range(n)], "row_id long, label string, embedding array<double>"))
        assert 0.6 * np.sqrt(n) <= len(cells.fit_cells(rows).centers) <= np.ceil(np.sqrt(n))


def test_imperfect_vectors_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [nan, 0.0]), (3, "a", [inf, 1.0]), (4, "a", None), (5, "a", []), (6, "a", [None, 1.0]), (7, None, [0.0, 2.0])]
    corpus = spark.createDataFrame(rows, "row_id long, label string, embedding array<double>")
    questions = spark.createDataFrame([(1, [1.0, 0.0], None), (2, [nan, 0.0], None), (3, [1.0, 0.0, 0.0], None), (4, None, None), (5, [0.0, 1.0], "A")], "q_id long, q_vec array<double>, focus string")
    exact = rows_of(retrieval.search(questions, retrieval.build_index(corpus), 5))
    assert [r[:3] for r in exact] == [(1, 1, 1), (1, 2, 7), (5, 1, 1)]
    assert rows_of(cells.build_cells(corpus).search(questions, 5)) == exact
    empty = cells.build_cells(corpus.limit(0))
    assert empty.search(questions).count() == 0 and retrieval.search(questions, retrieval.build_index(corpus.limit(0))).count() == 0
    with pytest.raises(ValueError):
        cells.build_cells(spark.createDataFrame([(1, "a", [1.0]), (2, "a", [1.0, 2.0])], "row_id long, label string, embedding array<double>"))


def test_exact_search_keeps_lengths_apart(spark):
    corpus = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0, 0.0]), (3, "b", [0.0, 1.0]), (4, "b", [0.0, 0.0, 1.0])], "row_id long, label string, embedding array<double>")
    questions = spark.createDataFrame([(1, [1.0, 1.0], None), (2, [1.0, 0.0, 1.0], "b"), (3, [1.0], None)], "q_id long, q_vec array<double>, focus string")
    got = rows_of(retrieval.search(questions, retrieval.build_index(corpus), 5))
    assert [r[:3] for r in got] == [(1, 1, 1), (1, 2, 3), (2, 1, 4)]


# ---- versions ----------------------------------------------------------------------------

def test_versions_append_compact_clean(spark):
    corpus, questions = make(spark, n=400)
    base = tempfile.mkdtemp(prefix="cells-")
    with pytest.raises(FileNotFoundError):
        index.open_index(spark, base)
    first = index.rebuild(corpus.filter("row_id < 300"), base, payload=("text",), meta={"collection_name": "c"})
    assert (first.number, first.meta["size"]) == (1, 300)
    old = index.open_index(spark, base)
    want_old = rows_of(retrieval.search(questions, retrieval.build_index(corpus.filter("row_id < 300")), 5))
    second = index.append(corpus.filter("row_id >= 300 AND row_id < 350"), base)
    index.append(corpus.filter("row_id >= 350"), base)
    now = index.open_index(spark, base)
    assert now.metadata["size"] == now.rows.count() == 400 and now.metadata["collection_name"] == "c" and now.rows.columns == ["row_id", "label", "text"]
    want = rows_of(retrieval.search(questions, retrieval.build_index(corpus), 5))
    everything = len(now.model.centers)
    assert rows_of(now.search(questions, 5, probes=everything)) == want
    assert rows_of(old.search(questions, 5, probes=everything)) == want_old  # a reader keeps its version
    packed = index.compact(spark, base)
    assert len(packed.parts["rows"]) == 1 and rows_of(index.open_index(spark, base).search(questions, 5, probes=everything)) == want
    assert index.open_index(spark, base, number=second.number).rows.count() == 350
    gone = index.clean(spark, base)
    assert len(gone) == 6 and commits.numbers(spark, base) == [packed.number]
    assert rows_of(index.open_index(spark, base).search(questions, 5, probes=everything)) == want


def test_a_build_that_dies_leaves_the_last_version(spark, monkeypatch):
    corpus, questions = make(spark, n=100)
    base = tempfile.mkdtemp(prefix="cells-")
    index.rebuild(corpus, base, payload=("text",))
    before = rows_of(index.open_index(spark, base).search(questions))
    monkeypatch.setattr(commits, "publish", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        index.rebuild(corpus.filter("row_id < 50"), base, payload=("text",))
    monkeypatch.undo()
    assert rows_of(index.open_index(spark, base).search(questions)) == before
    assert len(index.clean(spark, base)) == 3  # the dead build's folders


def test_one_of_two_writers_wins(spark, monkeypatch):
    corpus, _ = make(spark, n=120)
    base = tempfile.mkdtemp(prefix="cells-")
    index.rebuild(corpus.filter("row_id < 100"), base, payload=("text",))
    with pytest.raises(commits.Conflict):
        commits.publish(spark, base, {}, {}, 0)
    assert commits.latest(spark, base).number == 1
    # an append that finds its number taken starts again from the newer version
    publish, raced = commits.publish, []

    def race(spark, base, parts, meta, after):
        if not raced:
            raced.append(publish(spark, base, commits.latest(spark, base).parts, {**meta, "other": True}, after))
        return publish(spark, base, parts, meta, after)

    monkeypatch.setattr(commits, "publish", race)
    v = index.append(corpus.filter("row_id >= 100"), base)
    assert v.number == 3 and v.meta["other"] and index.open_index(spark, base).rows.count() == 120


# ---- encoders ----------------------------------------------------------------------------

def documents(spark, n=120):
    rng = random.Random(4)
    topics = [[f"{t}{i}" for i in range(30)] for t in ("red", "cat", "sea")]
    rows = [(i, " ".join(rng.choice(topics[i % 3]) for _ in range(rng.randint(3, 25)))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, ""), (n + 2, "unheard"), (0, rows[0][1])], "id long, text string")


def test_lsa_against_an_exact_decomposition(spark):
    docs = documents(spark)
    spec = TermSpec(ngram_max=1, min_df=2)
    enc = encoders.fit_lsa(docs, dim=12, spec=spec)
    rows = encoders.tfidf_rows(docs, spec, enc.terms, enc.idf).collect()
    a = np.zeros((len(rows), len(enc.terms)))
    for i, r in enumerate(rows):
        a[i, r.terms] = r.weights
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(enc.basis.T @ enc.basis, np.eye(12), atol=1e-9)
    assert np.allclose(enc.singular, s[:12], rtol=0.03)
    lost, least = ((a - a @ enc.basis @ enc.basis.T) ** 2).sum(), (s[12:] ** 2).sum()
    assert least <= lost <= 1.02 * least
    got = encoders.encode(docs, enc).collect()
    x = np.array([r.embedding for r in got])
    want = a @ enc.basis
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(x, np.divide(want, norm, out=np.zeros_like(want), where=norm > 1e-12), atol=1e-9)
    assert [tuple(r)[:2] for r in got] == [tuple(r) for r in docs.collect()]  # every row on its own, ids repeated or not
    same = [x[i] @ x[j] for i in range(0, 60, 3) for j in range(60, 120, 3)]
    other = [x[i] @ x[j] for i in range(0, 60, 3) for j in range(61, 120, 3)]
    assert np.mean(same) > 0.3 + np.mean(other)


def test_lsa_of_nothing(spark):
    enc = encoders.fit_lsa(spark.createDataFrame([], "id long, text string"), dim=4)
    assert [r.embedding for r in encoders.encode(documents(spark).limit(3), enc).collect()] == [[0.0] * 4] * 3


@pytest.mark.parametrize("make_encoder", [lambda d: encoders.fit_lsa(d, dim=8, spec=TermSpec(ngram_max=1, min_df=1)), lambda d: retrieval.fit_encoder(d, dim=32)])
def test_a_reopened_index_answers_a_text_question(spark, make_encoder):
    from revscope.operators.ask import ask

    docs = documents(spark).filter("text IS NOT NULL AND text <> ''").dropDuplicates(["id"])
    enc = make_encoder(docs)
    base = tempfile.mkdtemp(prefix="cells-")
    corpus = encoders.encode(docs, enc).selectExpr("id AS row_id", "'x' AS label", "embedding", "text", "1 AS label_id", "'train' AS split")
    index.rebuild(corpus, base, encoder=enc, payload=("text", "label_id", "split"))
    again = index.open_index(spark, base)
    assert type(again.encoder) is type(enc)
    texts = {r.id: r.text for r in docs.collect()}
    asked = spark.createDataFrame([(1, texts[9], 1), (2, texts[10], 1)], "q_id long, question string, top_k int")
    got = {r.q_id: r.contexts[0].text for r in ask(asked, again).collect()}
    assert got == {1: texts[9], 2: texts[10]}


def test_the_callers_encoder_is_loaded_once_a_worker_and_fed_batches(spark):
    folder = tempfile.mkdtemp(prefix="calls-")

    def load():
        import os
        import uuid

        open(os.path.join(folder, f"load-{os.getpid()}-{uuid.uuid4().hex}"), "w").close()

        def run(texts):
            open(os.path.join(folder, f"batch-{len(texts)}-{uuid.uuid4().hex}"), "w").close()
            return [[len(t), 1.0] for t in texts]

        return run

    import os
    enc = encoders.CallerEncoder(load, 2)
    got = encoders.encode(documents(spark).repartition(6), enc, batch_size=10).collect()
    assert len(got) == 124 and all(np.allclose(r.embedding, np.array([len(r.text or ""), 1]) / np.hypot(len(r.text or ""), 1)) for r in got)
    names = os.listdir(folder)
    loads = [n.split("-")[1] for n in names if n.startswith("load")]
    assert len(loads) == len(set(loads)) and max(int(n.split("-")[1]) for n in names if n.startswith("batch")) <= 10
    with pytest.raises(Exception, match="returned vectors"):
        encoders.encode(documents(spark), encoders.CallerEncoder(load, 3)).collect()


def test_the_index_job_as_one_call(spark):
    rows = [(i, f"<b>text</b> about thing{i % 9} and word{i % 5}", i % 3, LABELS[i % 3], ("train", "test")[i % 2]) for i in range(60)]
    reviews = spark.createDataFrame(rows, "id long, text string, label int, label_text string, split string")
    base = tempfile.mkdtemp(prefix="cells-")
    v = index.build_review_index(reviews, base, sample_size=20, batch_size=16)
    idx = index.open_index(spark, base)
    assert v.meta["size"] == 40 and v.meta["sample_size"] == 20 and v.meta["embedding_model"] == "lsa" and v.meta["batch_size"] == 16
    got = idx.rows.orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(40)) and all("<b>" not in r.text for r in got) and {r.split for r in got[:20]} == {"train"}


# ---- requests ----------------------------------------------------------------------------

def test_requests_that_share_an_id_are_answered_each_on_its_own(spark):
    from revscope.operators.ask import ask

    corpus = spark.createDataFrame([(1, "positive", [1.0, 0.0], "good", 2, "train"), (2, "negative", [0.0, 1.0], "bad", 0, "train")],
                                   "row_id long, label string, embedding array<double>, text string, label_id int, split string")
    asked = spark.createDataFrame([(7, "about good", [1.0, 0.0], 1), (7, "about bad", [0.0, 1.0], 1), (None, "about good too", [1.0, 0.1], 1), (8, "no vector", None, 1)],
                                  "q_id long, question string, q_vec array<double>, top_k int")
    for idx in (retrieval.build_index(corpus, payload=("text", "label_id", "split")), cells.build_cells(corpus, payload=("text", "label_id", "split"))):
        got = {r.question: r for r in ask(asked, idx).collect()}
        assert len(got) == 4 and [got[q].q_id for q in ("about good", "about bad", "about good too", "no vector")] == [7, 7, None, 8]
        assert "positive (1/1)" in got["about good"].answer and "negative (1/1)" in got["about bad"].answer
        assert "positive (1/1)" in got["about good too"].answer and not got["no vector"].contexts
    text_ids = asked.selectExpr("cast(q_id AS string) AS q_id", "question", "q_vec", "top_k")
    assert {r.q_id for r in ask(text_ids, idx).collect()} == {"7", "8", None}
