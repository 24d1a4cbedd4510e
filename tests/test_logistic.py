import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from revscope.operators import features as fe
from revscope.operators import logistic, subwords
from revscope.operators import model as md


def rows(spark, classes=3):
    words = {0: "awful terrible broken slow", 1: "okay average usual plain", 2: "great lovely fast perfect"}
    data = [(i, f"{words[(i + i % 7 // 5) % 3]} item{i % 5} text{i % 11}", i % classes) for i in range(90)]
    return spark.createDataFrame([*data, (90, None, 0), (91, "", 1)], "id long, text string, label int")


@pytest.mark.parametrize("mode,classes", [("multiclass", 3), ("binary_polarity", 2)])
def test_the_fit_is_mllibs(spark, mode, classes):
    """The model has the coefficients that MLlib finds, given steps enough."""
    from pyspark.ml.classification import LogisticRegression

    df = rows(spark, classes)
    m = md.fit_baseline(df, md.BaselineConfig(label_mode=mode, tol=1e-9))
    vectors = md.stored_vectors(df, md.feature_weights(df, m.vocabs, m.config.specs(), m.sizes), sum(m.sizes), keep=("label",))
    want = LogisticRegression(maxIter=1000, tol=1e-12, regParam=1 / (0.7 * 92), standardization=False, family="binomial" if classes == 2 else "multinomial").fit(vectors)
    assert m.classifier.coefficientMatrix.toArray() == pytest.approx(want.coefficientMatrix.toArray(), abs=1e-4)
    assert m.classifier.interceptVector.toArray() == pytest.approx(want.interceptVector.toArray(), abs=1e-4)


def test_few_steps_find_the_least_loss_of_unlike_features():
    scale = np.array([[1e3, 1.0, 1e-1, 10.0]])
    steps = []

    def loss(w):
        steps.append(1)
        return float((scale * (w - 3) ** 2).sum()), 2 * scale * (w - 3)

    assert logistic.minimum(loss, np.zeros((1, 4)), 1000, 1e-12) == pytest.approx(np.full((1, 4), 3.0), abs=1e-3)
    assert len(steps) < 60


def test_training_writes_no_rows_of_terms_and_refuses_what_has_no_class(spark, tmp_path, monkeypatch):
    written = []
    kept = md.scratch_path
    monkeypatch.setattr(md, "scratch_path", lambda spark, name: written.append(name) or kept(spark, name))
    md.fit_baseline(rows(spark), md.BaselineConfig(feature_mode="word", max_iter=3))
    assert written == ["rows"]
    for bad in (rows(spark).limit(0), rows(spark).withColumn("label", F.lit(None).cast("int")), rows(spark).withColumn("label", F.lit(0.5))):
        with pytest.raises(ValueError):
            md.fit_baseline(bad, md.BaselineConfig(feature_mode="word"))


def test_a_single_class_is_certain(spark):
    m = md.fit_baseline(rows(spark).withColumn("label", F.lit(2)), md.BaselineConfig(feature_mode="word"))
    assert {r.label for r in md.score_clean(m, rows(spark)).collect()} == {"positive"}


def test_slices_are_bounded_by_size():
    texts = pa.array(["x" * (fe.SLICE_BYTES // 2), "y" * (fe.SLICE_BYTES // 2), "z", None, "w" * 3 * fe.SLICE_BYTES, "v"])
    parts = [*fe.slices(pa.RecordBatch.from_arrays([texts], ["t"]))]
    assert [p.num_rows for p in parts] == [2, 2, 1, 1] and pa.concat_arrays([p.column(0) for p in parts]).equals(texts)
    lists = pa.array([[1] * fe.SLICE_WORDS, [1], None, []], pa.list_(pa.int32()))
    assert [p.num_rows for p in fe.slices(pa.RecordBatch.from_arrays([lists], ["t"]))] == [1, 3]


def test_long_texts_are_encoded_a_few_at_a_time(spark, monkeypatch):
    """No slice of texts that are tokens at one time is larger than its bound."""
    texts = ["good great " * 60_000, "bad " * 100_000, "fine"] * 3
    df = spark.createDataFrame([*enumerate(texts)], "id int, text string").coalesce(1)
    largest = []
    real = subwords._tokenizer

    class Spy:
        def encode_batch(self, texts, **k):
            largest.append(sum(map(len, texts)))
            return real(subwords.default_vocabulary()).encode_batch(texts, **k)

    monkeypatch.setattr(subwords, "_tokenizer", lambda path: Spy())
    seen = {}

    class Frame:  # the operator's task function, run here
        schema = df.schema
        withColumn = lambda self, *a: self
        mapInArrow = lambda self, run, schema: seen.update(run=run)

    subwords.encode_subwords(Frame(), "any", None)
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts), pa.array(texts)], ["id", "text", "_text"])
    assert sum(p.num_rows for p in seen["run"](iter([batch]))) == 9 and max(largest) <= fe.SLICE_BYTES


@pytest.mark.parametrize("outputs", [1, 3])
def test_loss_and_gradient_of_blocks_are_those_of_all_rows(outputs):
    """Class 0 takes no pass over the terms; blocks are bounded by their terms; rows without terms count."""
    rng = np.random.default_rng(4)
    n, size = 500, 40
    x = rng.random((n, size)) * (rng.random((n, size)) < 0.3)
    x[:3] = x[17] = x[-1] = 0
    labels, w = rng.integers(0, max(outputs, 2), n), rng.normal(size=(outputs, size + 1))
    row, index = np.nonzero(x)
    kept, logistic.BLOCK_TERMS = logistic.BLOCK_TERMS, 100
    try:
        blocks = [b.to_pylist()[0] for b in logistic.in_blocks(labels, np.cumsum(np.bincount(row, minlength=n)), index, x[row, index])]
    finally:
        logistic.BLOCK_TERMS = kept
    assert len(blocks) > 50 and max(len(b["indices"]) for b in blocks) <= 4 * 100
    gradient = np.zeros_like(w)
    lost = sum(logistic.block_loss(b, w, gradient) for b in blocks)
    margins = x @ w[:, :-1].T + w[:, -1]
    margins = margins if outputs > 1 else np.hstack([np.zeros((n, 1)), margins])
    p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
    assert lost == pytest.approx(-np.log(p[np.arange(n), labels]).sum())
    p[np.arange(n), labels] -= 1
    want = np.hstack([x, np.ones((n, 1))]).T @ p[:, -outputs:]
    assert logistic.whole(gradient) == pytest.approx(want.T)


def test_documents_are_counted_once_for_a_vocabulary(spark):
    counted = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            counted.add(batch.num_rows)
            yield batch

    stats = spark.createDataFrame([(f"t{i}", i % 4 + 1, i % 7 + 1) for i in range(60)], "term string, df long, cf long").mapInArrow(run, "term string, df long, cf long")
    assert fe.vocabulary_of(stats, 10, fe.WORD_SPEC).count() == 45
    assert counted.value == 60
