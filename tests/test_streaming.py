import os

import pyarrow.parquet as pq
import pytest

from revscope.operators import model as md
from revscope.operators import retrieval
from revscope.session import scratch_path
from revscope.streaming import jobs

SCHEMA = "id long, text string, label int"


def folders(spark):
    base = scratch_path(spark, "stream-test")
    return base + "/in", {"out_dir": base + "/out", "dead_dir": base + "/dead", "checkpoint_dir": base + "/checkpoint"}


def test_stream_predict_equals_batch_and_goes_on_after_a_restart(spark):
    rows = [(i, t, i % 3) for i, t in enumerate(["good great", "bad awful", "okay plain", "", "great good fine"] * 6)]
    train = spark.createDataFrame(rows, SCHEMA)
    m = md.fit_baseline(train, md.BaselineConfig(feature_mode="word", max_iter=50))
    src, at = folders(spark)
    train.write.parquet(os.path.join(src, "a"))
    jobs.stream_predict(spark, src + "/*", SCHEMA, m, **at).awaitTermination()
    batch = {r.id: r.label for r in md.predict(m, train.filter("length(text) > 0"), keep=("id",)).collect()}
    assert {r.id: r.label for r in spark.read.parquet(at["out_dir"]).collect()} == batch
    assert spark.read.parquet(at["dead_dir"]).count() == 6
    # started again on the same folders: new requests are added, nothing is lost
    spark.createDataFrame([(100, "good great", 2), (101, None, 2)], SCHEMA).write.parquet(os.path.join(src, "b"))
    jobs.stream_predict(spark, src + "/*", SCHEMA, m, **at).awaitTermination()
    assert {r.id for r in spark.read.parquet(at["out_dir"]).collect()} == set(batch) | {100}
    assert spark.read.parquet(at["dead_dir"]).count() == 7


def test_a_replayed_batch_adds_nothing(spark):
    rows = [(i, t, i % 3) for i, t in enumerate(["good great", "bad awful", "okay plain", ""] * 6)]
    train = spark.createDataFrame(rows, SCHEMA)
    m = md.fit_baseline(train, md.BaselineConfig(feature_mode="word", max_iter=20))
    src, at = folders(spark)
    train.write.parquet(os.path.join(src, "a"))
    jobs.stream_predict(spark, src + "/*", SCHEMA, m, **at).awaitTermination()
    # as after a crash between the sink's log and the checkpoint's: the batch is run again
    for kind in ("scored", "rejected"):
        folder = os.path.join(at["checkpoint_dir"], kind, "commits")
        for name in os.listdir(folder):
            os.remove(os.path.join(folder, name))
    job = jobs.stream_predict(spark, src + "/*", SCHEMA, m, **at)
    job.awaitTermination()
    assert spark.read.parquet(at["out_dir"]).count() == 18 and spark.read.parquet(at["dead_dir"]).count() == 6
    assert not job.isActive and job.exception() is None


def test_scoring_moves_no_rows(spark):
    train = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(["good great", "bad awful", "okay plain"] * 6)], SCHEMA)
    m = md.fit_baseline(train, md.BaselineConfig(max_iter=20))
    plan = md.predict(m, train, keep=("id",))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_stream_ask_answers_requests_that_share_an_id(spark):
    corpus = spark.createDataFrame([(1, "positive", [1.0, 0.0], "good", 2, "train"), (2, "negative", [0.0, 1.0], "bad", 0, "train")],
                                   "row_id long, label string, embedding array<double>, text string, label_id int, split string")
    idx = retrieval.build_index(corpus, payload=("text", "label_id", "split"))
    schema = "q_id long, question string, q_vec array<double>, top_k int"
    src, at = folders(spark)
    spark.createDataFrame([(7, "about good", [1.0, 0.0], 1), (7, "about bad", [0.0, 1.0], 1), (None, "any", [0.1, 1.0], 1)], schema).write.parquet(os.path.join(src, "a"))
    jobs.stream_ask(spark, src + "/*", schema, idx, **at).awaitTermination()
    got = {(r.q_id, r.question): r.contexts[0].text for r in spark.read.parquet(at["out_dir"]).collect()}
    assert got == {(7, "about good"): "good", (7, "about bad"): "bad", (None, "any"): "bad"}


def test_stream_ask_uses_the_request_mode_and_the_focus_of_the_question(spark):
    corpus = spark.createDataFrame([(1, "positive", [1.0, 0.0], "good", 2, "train"), (2, "negative", [0.0, 1.0], "bad", 0, "train")],
                                   "row_id long, label string, embedding array<double>, text string, label_id int, split string")
    idx = retrieval.build_index(corpus, payload=("text", "label_id", "split"))
    schema = "q_id long, question string, q_vec array<double>, top_k int"
    src, at = folders(spark)
    spark.createDataFrame([(1, "почему всё плохо?", [1.0, 0.0], 1), (2, "any?", [1.0, 0.0], 99)], schema).write.parquet(os.path.join(src, "a"))
    jobs.stream_ask(spark, src + "/*", schema, idx, **at).awaitTermination()
    (r,) = spark.read.parquet(at["out_dir"]).collect()
    assert r.sentiment_focus == "negative" and [c.row_id for c in r.contexts] == [2]
    (d,) = spark.read.parquet(at["dead_dir"]).collect()
    assert "top_k" in d.reason


def test_missing_model_fails_before_start(spark):
    with pytest.raises(FileNotFoundError):
        jobs.stream_predict(spark, "/nonexistent", "id long, text string", None, out_dir="a", dead_dir="b", checkpoint_dir="c")


def test_stream_queries_read_tables_of_one_file_and_of_many(spark):
    from revscope.plans import registry

    registry.load_all()
    base = scratch_path(spark, "stream-tables")
    docs = [(i, ["good great", "bad awful", "okay plain", ""][i % 4], "en", "web", 10) for i in range(40)]
    tables = {"documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
              "labels": spark.createDataFrame([(i, i % 2, int(i % 4 == 1)) for i in range(40)], "doc_id long, quality int, toxic int"),
              "embeddings": spark.createDataFrame([(i, [float(i % 3), 1.0], i % 3) for i in range(40)], "vec_id long, embedding array<float>, label int")}
    for name, table in tables.items():
        table.repartition(3).write.parquet(os.path.join(base, "folders", name + ".parquet"))
        os.makedirs(os.path.join(base, "files"), exist_ok=True)
        pq.write_table(table.toArrow(), os.path.join(base, "files", name + ".parquet"))
    for kind in ("folders", "files"):
        assert registry.QUERIES["stream_ask"](spark, os.path.join(base, kind)).count() == sum(1 <= i % 23 - 1 <= 20 for i in range(40))
        assert registry.QUERIES["stream_predict"](spark, os.path.join(base, kind)).count() == 30
