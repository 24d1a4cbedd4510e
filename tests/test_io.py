import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from revscope.sources import io


def test_jsonl_splits_and_ingest(spark):
    d = tempfile.mkdtemp(prefix="jsonl-")
    for split, n in [("train", 3), ("validation", 1), ("test", 2)]:
        with open(os.path.join(d, f"{split}.jsonl"), "w", encoding="utf-8") as fh:
            for i in range(n):
                fh.write(json.dumps({"id": f"{split}{i}", "text": "т е к с т", "label": i % 3, "label_text": "x"},
                                    ensure_ascii=False) + "\n\n")
    df = io.read_jsonl_splits(spark, d)
    assert sorted((r.split, r.c) for r in df.groupBy("split").agg(F.count("*").alias("c")).collect()) == \
        [("test", 2), ("train", 3), ("validation", 1)]
    table = os.path.join(d, "table")
    src = df
    calls = []

    def load():
        calls.append(1)
        return src

    a = io.ingest_or_reuse(spark, table, load)
    b = io.ingest_or_reuse(spark, table, load)
    assert a.count() == b.count() == 6 and len(calls) == 1
    assert a.schema["id"].dataType.simpleString() == "string" and a.schema["label"].dataType.simpleString() == "bigint"
    assert {r.id for r in a.collect()} == {"train0", "train1", "train2", "validation0", "test0", "test1"}
    io.ingest_or_reuse(spark, table, load, force=True)
    assert len(calls) == 2
    other = os.path.join(d, "other")
    spark.createDataFrame([(1, "x")], "number int, value string").write.parquet(other)
    with pytest.raises(ValueError):
        io.read_reviews(spark, other)


def test_run_metrics_and_fallback(spark):
    d = tempfile.mkdtemp(prefix="runs-")
    os.makedirs(os.path.join(d, "run_seven"))
    record = {"task": "polarity", "accuracy": 0.5, "report_dict": {"mild": {"f1-score": 0.25, "support": 4.0}, "harsh": {"recall": 1.0}}}
    with open(os.path.join(d, "run_seven", "metrics.json"), "w") as fh:
        json.dump(record, fh, indent=1)
    (m,) = io.read_run_metrics(spark, d).collect()
    assert (m.model, m.task, m.accuracy, m.f1_macro) == ("run_seven", "polarity", 0.5, None)
    assert m.report["mild"]["f1-score"] == 0.25 and m.report["harsh"]["recall"] == 1.0
    fb = os.path.join(d, "fallback.json")
    with open(fb, "w") as fh:
        json.dump({"older": {"task": "polarity", "f1_macro": 0.125}, "oldest": {"accuracy": 1}}, fh)
    rows = {r.model: r for r in io.read_fallback(spark, fb).collect()}
    assert set(rows) == {"older", "oldest"} and rows["older"].f1_macro == 0.125 and rows["oldest"].accuracy == 1.0 and rows["oldest"].source is None
    assert io.read_fallback(spark, os.path.join(d, "absent.json")).count() == 0
    bad = os.path.join(d, "bad.json")
    with open(bad, "w") as fh:
        json.dump([1, 2], fh)
    with pytest.raises(ValueError):
        io.read_fallback(spark, bad)
    with open(bad, "w") as fh:
        json.dump({"m": 3}, fh)
    with pytest.raises(ValueError):
        io.read_fallback(spark, bad)


def test_confusion_csv_round_trip(spark):
    d = tempfile.mkdtemp(prefix="cm-")
    cm = spark.createDataFrame([("negative", 5, 1, 0), ("neutral", 0, 3, 2), ("positive", 1, 0, 9)],
                               "true_label string, negative long, neutral long, positive long")
    cm.coalesce(1).write.mode("overwrite").option("header", True).csv(os.path.join(d, "cm"))
    back = io.read_confusion_csv(spark, os.path.join(d, "cm"), ["negative", "neutral", "positive"])
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in cm.collect())


def test_model_save_load(spark):
    from revscope.operators import model as md

    rows = [(i, ["bad awful", "fine okay", "good great"][i % 3] + f" w{i % 4}", i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    m = md.fit_baseline(df, md.BaselineConfig(feature_mode="word", max_iter=50))
    d = tempfile.mkdtemp(prefix="model-")
    md.save_model(m, d)
    m2 = md.load_model(spark, d)
    assert m2.id2label == m.id2label and m2.sizes == m.sizes
    a = {r.id: r.label_id for r in md.predict(m, df, keep=("id",)).collect()}
    b = {r.id: r.label_id for r in md.predict(m2, df, keep=("id",)).collect()}
    assert a == b
    # without its metadata a model has the default map
    bare = tempfile.mkdtemp(prefix="bare-")
    m.classifier.write().overwrite().save(os.path.join(bare, "classifier"))
    m.vocabs[0].write.parquet(os.path.join(bare, "vocab_0"))
    m3 = md.load_model(spark, bare)
    assert m3.id2label == {0: "negative", 1: "neutral", 2: "positive"} and m3.sizes == m.sizes


def test_index_round_trip_keeps_numeric_looking_labels(spark):
    from revscope.operators import retrieval

    corpus = spark.createDataFrame([(1, "0", [1.0, 0.0]), (2, "1", [0.0, 1.0]), (3, None, [1.0, 1.0])], "row_id long, label string, embedding array<double>")
    d = tempfile.mkdtemp(prefix="idx-")
    for _ in range(2):  # written again, it is replaced
        io.write_index(retrieval.build_index(corpus), d, {"collection_name": "c"})
    idx = io.read_index(spark, d)
    assert idx.metadata["size"] == 3 and idx.metadata["collection_name"] == "c"
    q = spark.createDataFrame([(1, [0.0, 1.0], "0")], "q_id long, q_vec array<double>, focus string")
    assert [(r.row_id, r.label) for r in retrieval.search(q, idx, 5).collect()] == [(1, "0")]


def test_index_round_trip_requires_all_parts(spark):
    with pytest.raises(FileNotFoundError):
        io.read_index(spark, tempfile.mkdtemp(prefix="idx-"))


def test_baseline_job_writes_artifacts(spark):
    from revscope.operators import compare as cmp
    from revscope.operators import model as md

    rows = []
    words = {0: "bad awful broken", 1: "fine okay plain", 2: "good great lovely"}
    for i in range(90):
        split = ["train", "train", "train", "validation", "test"][i % 5]
        rows.append((i, f"<b>{words[i % 3]}</b> w{i % 4}", i % 3, ["negative", "neutral", "positive"][i % 3], split))
    reviews = spark.createDataFrame(rows, "id long, text string, label int, label_text string, split string")
    out = tempfile.mkdtemp(prefix="baseline-")
    res = md.run_baseline(reviews, md.BaselineConfig(feature_mode="word", max_iter=60), out_dir=out, track=True)
    acc = {r.split: r.accuracy for r in res["metrics"].collect()}
    assert set(acc) == {"validation", "test"} and acc["test"] > 0.9
    for part in ("errors", "confusion_matrix", "classification_report", "classification_report.txt", "metrics.json", "split_metrics",
                 "classifier", "model_metadata.json", "run_log"):
        assert os.path.exists(os.path.join(out, part)), part
    logged = {r.key for r in spark.read.parquet(os.path.join(out, "run_log")).filter("kind = 'metric'").collect()}
    assert logged == {"test_accuracy", "test_f1_macro", "validation_accuracy", "validation_f1_macro"}
    # a second run, then both are compared through the readers
    runs = tempfile.mkdtemp(prefix="runs-")
    for name, mode in (("full", "multiclass"), ("polar", "binary_polarity")):
        md.run_baseline(reviews, md.BaselineConfig(label_mode=mode, feature_mode="word", max_iter=60), out_dir=os.path.join(runs, name))
    e = spark.createDataFrame([("full", 0), ("polar", 1), ("gone", 2)], "model string, ord int")
    m, meta = io.read_run_metrics(spark, runs), io.read_run_metadata(spark, runs)
    fb = spark.createDataFrame([], "model string, source string, task string, accuracy double, f1_macro double")
    rows_df = cmp.compare_runs(e, m, meta, fb)
    found = {r.model: r for r in rows_df.collect()}
    assert set(found) == {"full", "polar"} and found["polar"].task == "binary_polarity" and found["polar"].f1_neutral is None
    assert found["full"].f1_neutral is not None and found["full"].accuracy > 0.9
    summ = cmp.summary(rows_df, cmp.missing_runs(e, m, fb))
    lines = cmp.report_rows(rows_df).select(F.concat_ws(" ", "model", "f1_macro").alias("value"))
    io.write_comparison(out, rows_df, summ, lines)
    back = spark.read.json(os.path.join(out, "model_comparison_json")).first()
    assert back.summary.best_model in found and len(back.rows) == 2
    io.write_records(reviews.select("text", F.col("label").alias("label_id"), F.col("label_text").alias("label"), "split"),
                     os.path.join(out, "records"))
    assert io.read_records(spark, os.path.join(out, "records")).count() == 90
    table = io.read_comparison_csv(spark, os.path.join(out, "model_comparison_csv"))
    assert {(r.model, r.rank): r.f1_macro for r in table.collect()} == {(r.model, r.rank): r.f1_macro for r in rows_df.collect()}
    io.write_history(spark.createDataFrame([(1.0, 0.5)], "epoch double, val_f1_macro double"), os.path.join(out, "history"), {"epochs": 3})
    assert io.read_small_json(spark, os.path.join(out, "history_config.json")) == {"epochs": 3}
    assert spark.read.json(os.path.join(out, "history")).count() == 1
