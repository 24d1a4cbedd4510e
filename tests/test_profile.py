import pandas as pd
from pyspark.sql import functions as F

from revscope.operators import dataset, profile


def test_class_distribution_counts_null_group(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "label_text string")
    got = {r.label_text: (r["count"], r.share) for r in profile.class_distribution(df).collect()}
    assert got == {"a": (2, 0.5), "b": (1, 0.25), None: (1, 0.25)}


def test_duplicated_texts_keep_all_members(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, "x"), (5, "x"), (6, "X"), (7, "y")],
                               "id int, text string")
    got = sorted(r.id for r in profile.duplicated_texts(df).collect())
    assert got == [1, 2, 3, 4, 5]


def test_length_summary_matches_pandas(spark):
    texts = ["a", "abcd", None, "abcdefghij", "xy", "hello world"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = profile.text_length_summary(df).first().asDict()
    s = pd.Series([len(t or "") for t in texts]).describe(percentiles=[0.5, 0.9, 0.95, 0.99])
    for k, pk in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("p50", "50%"),
                  ("p90", "90%"), ("p95", "95%"), ("p99", "99%"), ("max", "max")]:
        assert abs(got[k] - s[pk]) < 1e-9, k


def test_samples_are_bounded_and_deterministic(spark):
    df = spark.range(0, 200).select(F.col("id"), F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split"))
    a = profile.sample_per_split(df, 7)
    assert sorted((r.split, r.c) for r in a.groupBy("split").agg(F.count("*").alias("c")).collect()) == [("test", 7), ("train", 7)]
    b = profile.sample_per_split(df.repartition(5), 7)
    assert sorted(r.id for r in a.collect()) == sorted(r.id for r in b.collect())
    assert profile.sample_examples(df, label_value="none", label_col="split").count() == 0


def test_prepare_and_binary_view(spark):
    df = spark.createDataFrame([(1, "<b>bad</b>", 0, "negative", "train"), (2, "meh", 1, "neutral", "train"),
                                (3, "good &amp; fine", 2, "positive", "train")],
                               "id long, text string, label int, label_text string, split string")
    p = dataset.prepare_classification(df)
    assert p.columns == ["text", "label"]
    assert dataset.prepare_classification(df, keep_label_text=True).columns == ["text", "label", "label_text"]
    b = {r.text: r.label for r in dataset.label_view(df, "binary_polarity").collect()}
    assert b == {"bad": 0, "good & fine": 1}
    import pytest

    with pytest.raises(ValueError):
        dataset.label_view(df, "ternary")


def test_global_row_ids_are_dense(spark):
    df = spark.range(0, 300).select(F.col("id"), F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"))
    # one outlying id, and ids as text
    df = df.union(spark.createDataFrame([(10**15, "train")], "id long, split string"))
    got = dataset.global_row_ids(df).collect()
    want = sorted(((r.split == "test", r.id) for r in got))
    assert [(r.split == "test", r.id) for r in sorted(got, key=lambda r: r.row_id)] == want
    assert sorted(r.row_id for r in got) == list(range(301))
    text = df.withColumn("id", F.col("id").cast("string"))
    got = sorted(dataset.global_row_ids(text).collect(), key=lambda r: r.row_id)
    assert [r.row_id for r in got] == list(range(301))
    assert [(r.split == "test", r.id) for r in got] == sorted((r.split == "test", r.id) for r in got)


def test_splits_and_model_inputs(spark):
    a = spark.createDataFrame([(1, "<b>x</b> y", 0)], "id long, text string, label int")
    b = spark.createDataFrame([(2, "z", 1, "neutral")], "id long, text string, label int, label_text string")
    both = dataset.union_splits({"train": a, "test": b})
    assert {(r.id, r.split, r.label_text) for r in both.collect()} == {(1, "train", None), (2, "test", "neutral")}
    assert [r.text for r in dataset.split_frame(both, "train", clean=True).collect()] == ["x y"]
    assert [r.text for r in dataset.split_frame(both, "train").collect()] == ["<b>x</b> y"]
    enc = both.withColumn("input_ids", F.array(F.lit(1))).withColumn("attention_mask", F.array(F.lit(1)))
    assert dataset.tokenizer_inputs(enc).columns == ["input_ids", "attention_mask", "labels"]
    assert dataset.tokenizer_inputs(enc, keep_label_text=True, keep_text=True).columns == ["text", "input_ids", "attention_mask", "labels", "label_text"]
