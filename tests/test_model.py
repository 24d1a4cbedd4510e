import pytest
from pyspark.sql import functions as F

from revscope.operators import model as md


def toy(spark):
    rows = []
    words = {0: "awful terrible broken slow", 1: "okay average usual plain", 2: "great lovely fast perfect"}
    for i in range(60):
        lab = i % 3
        rows.append((i, f"{words[lab]} item{i % 5} text", lab))
    return spark.createDataFrame(rows, "id long, text string, label int")


def test_fit_predict_separable(spark):
    df = toy(spark)
    m = md.fit_baseline(df, md.BaselineConfig(feature_mode="word", max_iter=200))
    out = md.predict(m, spark.createDataFrame([(100, "great lovely"), (101, "awful broken")], "id long, text string"), keep=("id",))
    got = {r.id: (r.label, sorted(r.scores)) for r in out.collect()}
    assert got[100][0] == "positive" and got[101][0] == "negative"
    assert got[100][1] == ["negative", "neutral", "positive"]


def test_binary_and_bad_modes(spark):
    df = toy(spark).filter(F.col("label") != 1).withColumn("label", (F.col("label") == 2).cast("int"))
    m = md.fit_baseline(df, md.BaselineConfig(label_mode="binary_polarity", feature_mode="word_char", max_iter=100))
    assert m.id2label == {0: "negative", 1: "positive"}
    with pytest.raises(ValueError):
        md.BaselineConfig(feature_mode="chars").specs()
    with pytest.raises(ValueError):
        md.id2label_for_mode("other")


def test_rows_that_share_an_id_are_scored_each_on_its_own(spark):
    m = md.fit_baseline(toy(spark), md.BaselineConfig(feature_mode="word", max_iter=200))
    rows = [(7, "great lovely"), (7, "awful broken"), (8, "okay plain"), (None, ""), (None, None), (8, "okay plain")]
    got = md.predict(m, spark.createDataFrame(rows, "id long, text string"), keep=("id",)).collect()
    assert len(got) == len(rows)
    assert {r.text: r.label for r in got if r.text} == {"great lovely": "positive", "awful broken": "negative", "okay plain": "neutral"}
    facts = md.predict(m, spark.createDataFrame(rows, "id long, text string")).select(*md.score_facts()).collect()
    assert all(all(f) for f in facts)


@pytest.mark.parametrize("mode", ["multiclass", "binary_polarity"])
def test_scores_are_those_of_the_fitted_classifier(spark, mode):
    from pyspark.ml.functions import vector_to_array

    df = toy(spark)
    if mode != "multiclass":
        df = df.filter(F.col("label") != 1).withColumn("label", (F.col("label") == 2).cast("int"))
    m = md.fit_baseline(df, md.BaselineConfig(label_mode=mode, max_iter=100))
    w = md.feature_weights(df, m.vocabs, m.config.specs(), m.sizes)
    vectors = md.stored_vectors(df, w, sum(m.sizes))
    want = {r.id: r.p for r in m.classifier.transform(vectors).select("id", vector_to_array("probability").alias("p")).collect()}
    for r in md.score_clean(m, df).collect():
        assert [r.scores[m.id2label[i]] for i in sorted(m.id2label)] == pytest.approx(want[r.id], abs=1e-5)


def test_feature_union_norm(spark):
    from revscope.operators import features as fe

    df = toy(spark)
    specs = md.BaselineConfig().specs()
    vocabs = [fe.fit_tfidf(df, s) for s in specs]
    sizes = [v.count() for v in vocabs]
    w = md.feature_weights(df, vocabs, specs, sizes)
    for r in md.stored_vectors(df, w, sum(sizes)).collect():
        assert r.features.norm(2) ** 2 == pytest.approx(2.0) and r.features.size == sum(sizes)


def test_frequency_index_against_sorting(spark):
    from revscope.operators import features as fe

    rows = [(f"t{i:03d}" if i % 3 else f"é{i}", 1 + i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "term string, cf long")
    want = sorted(rows, key=lambda r: (-r[1], r[0].encode()))
    for most in (None, 1, 60, 500):
        got = sorted((r["index"], r["term"]) for r in fe.frequency_index(df, "cf", "term", most).collect())
        assert got == [(i, t) for i, (t, _) in enumerate(want[:most])]


def test_any_scorer_is_loaded_once_and_gives_predictions(spark):
    def load():
        calls = []

        def score(texts):
            calls.append(1)
            return [[float(len(t)), 3.0, float(len(calls) > 100)] for t in texts]
        return score

    docs = spark.createDataFrame([("abcd",), ("a",), (None,)], "text string")
    got = md.predictions_from_logits(md.score_with(docs, load), md.id2label_for_mode("multiclass")).collect()
    assert [(r.text, r.label) for r in got] == [("abcd", "negative"), ("a", "neutral"), (None, "neutral")]
    assert all(sum(r.scores.values()) == pytest.approx(1, abs=1e-5) for r in got)


def test_many_documents_are_cut_into_tasks_of_a_bounded_size(spark, monkeypatch):
    from revscope.operators import features as fe

    docs = spark.range(600).select("id", F.lit("good great").alias("text"))
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert fe.by_document(docs).rdd.getNumPartitions() <= 4
    monkeypatch.setattr(fe, "TASK_DOCS", 50)
    assert fe.by_document(docs).rdd.getNumPartitions() == 12
