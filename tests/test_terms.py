import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from revscope.operators import features as fe

SPECS = [fe.CHAR_SPEC, fe.TermSpec(analyzer="char_wb", ngram_min=5, ngram_max=6), fe.WORD_SPEC, fe.TermSpec(ngram_min=2, ngram_max=3, stop_words=("ab",), token="key")]


def texts(letters="abcé漢😀 İß", n=60):
    rng = random.Random(1)
    return ["".join(rng.choice(letters + "\t ") for _ in range(rng.randint(0, 90))) for _ in range(n)] + ["", None, " \n", "ab ab  ab-cd abc"]


@pytest.mark.parametrize("spec", SPECS)
def test_counts_are_those_of_exploded_terms(spark, monkeypatch, spec):
    """Ids repeat, also beyond a slice, or are null; all their rows are one document."""
    monkeypatch.setattr(fe, "TASK_DOCS", 3)
    rows = [(None if i % 10 == 0 else i % 7, t) for i, t in enumerate(texts())] + [(100 + i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "id long, text string")
    long = fe.term_counts(docs, spec)
    want = {r.term: (r.df, r.cf) for r in long.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).collect()}
    assert want and {r.term: (r.df, r.cf) for r in fe.term_stats(docs, spec).collect()} == want
    vocab = fe.fit_vocabulary(long, docs.count(), spec)
    by_join = {(r.id, r.term): (r["index"], r.weight) for r in fe.tfidf_weights(long, vocab, spec).collect()}
    for got in (fe.tfidf(docs, spec), fe.transform_tfidf(docs, fe.fit_tfidf(docs, spec), spec)):
        found = {(r.id, r.term): (r["index"], r.weight) for r in got.collect()}
        assert found.keys() == by_join.keys() and all(found[k] == pytest.approx(by_join[k], abs=1e-12) for k in found)


def test_many_letters_are_counted_by_rank():
    letters = "".join(chr(0x4E00 + i) for i in range(9000))
    text = "".join(f" {w} " for w in (letters, "ab", letters[:50], "ab"))
    doc, names, code, tf = fe.count_terms(pa.array([text, None, text]), fe.CHAR_SPEC, np.arange(3))
    padded = [f" {w} " for w in (letters, "ab", letters[:50], "ab")]
    want = Counter(p[i:i + n] for p in padded for n in (3, 4, 5) for i in range(len(p) - n + 1))
    name = names.to_pylist()
    assert {name[c]: f for d, c, f in zip(doc, code, tf, strict=True) if d == 2} == want and set(doc.tolist()) == {0, 2}


def test_terms_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "id long, text string")
    plan = fe.transform_tfidf(docs, fe.fit_tfidf(docs, fe.CHAR_SPEC).checkpoint(), fe.CHAR_SPEC)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "term" not in plan.split("Exchange")[1]


def test_a_vocabulary_beyond_what_tasks_are_sent_is_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 20, t) for i, t in enumerate(texts())], "id long, text string")
    vocab = fe.fit_tfidf(docs, fe.CHAR_SPEC).checkpoint()
    want = {(r.id, r.term): r.weight for r in fe.transform_tfidf(docs, vocab, fe.CHAR_SPEC).collect()}
    monkeypatch.setattr(fe, "ROW_TERMS", 10)
    got = {(r.id, r.term): r.weight for r in fe.transform_tfidf(docs, vocab, fe.CHAR_SPEC).collect()}
    assert got == pytest.approx(want)
