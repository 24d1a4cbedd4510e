import numpy as np
import pytest
from pyspark.sql import functions as F

from revscope.llm import toxicity

DOCS = "doc_id long, text string, toxic int, score string, predicted string, held_out int"
LABELS = "doc_id long, quality int, toxic int, text string"


def model_of(texts, spark):
    df = spark.createDataFrame([(i, t, 0, None, None, None) for i, t in enumerate(texts)], DOCS)
    return toxicity.CharModel(toxicity.count_trigrams(df))


def test_trigram_counts_against_brute_force(spark):
    texts = ["Abc  abd!", None, "", "é1é", "abc" * 400_000]
    df = spark.createDataFrame([(i, t, 0, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = toxicity.count_trigrams(df)
    at = {c: i for i, c in enumerate(toxicity.ALPHABET)}
    n = toxicity._N
    assert got[(at["a"] * n + at["b"]) * n + at["c"]] == 400_001
    assert got[(at["a"] * n + at["b"]) * n + at["d"]] == 1
    assert got[(at[" "] * n + at["é"]) * n + at[" "]] == 2


@pytest.mark.parametrize(("seen", "want"), [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("i d i o t", "idiot"), ("idiooooot", "idiot"), ("l0$er", "loser"),
                                            ("sstttupid", "stupid"), ("tr@sh", "trash"), ("p4th3t1c", "pathetic"), ("l-o-s-e-r", "loser"),
                                            ("i d 1 0 t", "idiot"), ("1 d 1 0 t", "idiot"), ("l 0 s e r", "loser"), ("iiddiioott", "idiot"), ("lloosseerr", "loser"), ("id-iot", "idiot"),
                                            ("lo-ser", "loser"), ("pa_the_tic", "pathetic"), ("t.r.@.s.h", "trash")])
def test_viterbi_restores_disguised_words(spark, seen, want):
    model = getattr(test_viterbi_restores_disguised_words, "model", None)
    if model is None:
        model = model_of(["the idiot is a stupid loser and this trash is pathetic little old tall sitting dog " * 5] * 20, spark)
        test_viterbi_restores_disguised_words.model = model
    assert toxicity._DISGUISED.fullmatch(seen)
    assert toxicity.decode(seen, model) == want


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    model = toxicity.CharModel(rng.integers(0, 50, toxicity._N**3))

    def total(text, channel):
        ctx, s = "  ", channel
        for c in text + " ":
            s, ctx = s + model.logp(ctx, c), ctx[1] + c
        return s

    for seen in ("1d10t", "aaab0", "a.b.c", "x1!"):
        paths = [("", 0.0)]
        for options in toxicity.lattice(seen):
            paths = [(t + x, s + c) for t, s in paths for x, c in options]
        best = max(paths, key=lambda p: total(*p))
        got = toxicity.decode(seen, model)
        assert max(total(t, c) for t, c in paths if t == got) == pytest.approx(total(*best))


def test_held_out_quality_on_testdata(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.op2_toxicity(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = got.filter("held_out").join(labels, "doc_id")
    x = held.agg(F.sum(F.expr("int(predicted = 1 AND toxic = 1)")).alias("tp"), F.sum("predicted").alias("p"), F.sum("toxic").alias("t")).first()
    assert x.tp / x.p > 0.85 and x.tp / x.t > 0.8  # few labels here, some of them on texts without a toxic word


def test_disguises_and_defined_cases(spark):
    clean = ["the tall house stands by the old river", "a small dog sits in the garden", "it is a little idle talk about trains", "many stories are told here"]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, f"{clean[i % 3]} {'you idiot and loser' if bad else clean[(i + 1) % 4]} number{i}", 9, "x", "y", 1))
        labels.append((i, 1, int(bad), "t"))
    labels += [(0, 1, 0, "t"), (None, 1, 1, "t"), (1, 1, None, "t"), (777_777, 1, 1, "no such document")]
    model = toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    ask = [(1, None), (2, ""), (3, clean[0]), (4, "what an idiot"), (5, "what an 1d10t"), (6, "what an i d i o t!"), (7, "what an idiooooot"), (8, clean[1] + " " + "word " * 60_000 + "loser"),
           (3, clean[0]), (None, "you LOSER"), (9, "what an i d 1 0 t"), (10, "what an iiddiioott"), (11, "such a lo-ser!"), (12, clean[0] + " 1 2 3 4 5 a 7 8"),
           (13, "an up-to-date re-do of the 2 b 2 talk")]
    got = toxicity.score(spark.createDataFrame([(a, b, 0, None, None, None) for a, b in ask], DOCS), model).collect()
    assert [r.predicted for r in got] == [0, 0, 0, 1, 1, 1, 1, 1, 0, 1, 1, 1, 1, 0, 0]
    assert all(0 <= r.score <= 1 for r in got)


def test_one_kind_of_label_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", 0, None, None, None)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert toxicity.score(docs, toxicity.fit(docs, none)).first().score == 0
    assert toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([(1, 1, 1, "")], LABELS))).first().score == 1
    empty = spark.createDataFrame([], DOCS)
    assert toxicity.score(empty, toxicity.fit(empty, none)).count() == 0
