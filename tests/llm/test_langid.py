import numpy as np
import pytest
from pyspark.sql import functions as F

from revscope.llm import langid

SCHEMA = "doc_id long, text string, lang string, lang_pred string, score string, source int"


def brute_grams(text):
    letters = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
    padded = f" {letters} " if letters else ""
    return {n: [padded[i:i + n] for i in range(len(padded) - n + 1)] for n in langid.ORDERS}


@pytest.mark.parametrize("text", ["Ab c", "", "!!", "  x--y  ", "Élan 12 vital!", "日本 ok", "a" * 2000])
def test_ngrams_of_blocks_are_those_of_single_texts(text):
    alone = next(iter(langid.ngram_rows([text])))
    together = list(langid.ngram_rows(["zz top", text, None, "other words"]))
    assert sorted(alone) == sorted(together[1]) and not len(together[2])
    want = brute_grams(text)
    assert len(alone) == sum(len(x) for x in want.values())
    assert len(set(alone.tolist())) <= len({(n, g) for n, x in want.items() for g in x})


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(0)
    rows = [(np.array([y, 2 + int(rng.integers(0, 200))]), np.array([1.0, 0.2]), y) for y in rng.integers(0, 2, 400)]
    w, b = langid.fit_ftrl(rows, 2, 300, l1=0.5)
    assert all(int((x @ w[f] + b).argmax()) == y for f, x, y in rows)
    assert (w[2:] == 0).mean() > 0.8  # the penalty leaves noise out


def test_temperature_is_that_of_least_loss():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(4000, 3))
    y = np.array([rng.choice(3, p=langid.softmax(r)) for r in z])
    assert langid.fit_temperature(z * 5, y) == pytest.approx(5, rel=0.15)


def test_accuracy_on_held_out_documents_and_unknowns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = langid.op7_langid(spark, "/root/testdata/sf0.1").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    x = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("hit"), F.count("*").alias("n"), F.min("score"), F.max("score")).first()
    assert x.n > 1500 and x.hit > 0.97 and 0 <= x[2] and x[3] <= 1


def test_defined_cases(spark):
    rows = [(i, t * 20, lang, "x", "y", 1) for i, (t, lang) in enumerate([("the house and ", "en"), ("das haus und ", "de")] * 20)]
    rows += [(None, "the house", "en", None, None, None), (900, "nothing", None, None, None, None), rows[0], rows[0]]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA))
    assert model.languages == ["de", "en"]
    ask = [(1, None), (2, ""), (3, "123 --"), (4, "und das"), (5, "the and"), (6, "the and" * 60_000), (5, "the and"), (None, "the and")]
    got = langid.identify(spark.createDataFrame([(a, b, None, "x", "y", 0) for a, b in ask], SCHEMA), model).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "de", "en", "en", "en", "en"]
    assert [r.score for r in got[:3]] == [0, 0, 0]


def test_no_labels_and_empty_table(spark):
    df = spark.createDataFrame([(1, "some text", None, None, None, None)], SCHEMA)
    assert [(r.lang_pred, r.score) for r in langid.identify(df, langid.fit(df)).collect()] == [("und", 0.0)]
    none = spark.createDataFrame([], SCHEMA)
    assert langid.identify(none, langid.fit(none)).count() == 0
