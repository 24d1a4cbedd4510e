"""Metrics against a pure-Python implementation of the same definitions."""

import pytest

from revscope.constants import MULTICLASS_ID2LABEL
from revscope.operators import evaluate as ev


def py_scores(y, p):
    labels = sorted(set(y) | set(p))
    out = {}
    for c in labels:
        tp = sum(1 for a, b in zip(y, p) if a == c and b == c)
        sup = sum(1 for a in y if a == c)
        pc = sum(1 for b in p if b == c)
        prec = tp / pc if pc else 0.0
        rec = tp / sup if sup else 0.0
        f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
        out[c] = (prec, rec, f1, sup)
    return out


CASES = [
    ([0, 1, 2, 2, 1, 0, 2], [0, 2, 2, 2, 1, 1, 0]),
    ([0, 0, 1, 1], [0, 0, 0, 0]),          # class never predicted
    ([2, 2, 2], [2, 0, 2]),                 # class never true
    ([1, 1], [1, 1]),                       # single class
    ([0, 1, 2], [1, 2, 0]),                 # all wrong
]


@pytest.mark.parametrize("y,p", CASES)
def test_metrics(spark, y, p):
    df = spark.createDataFrame(list(zip(y, p)), "label int, pred int")
    want = py_scores(y, p)
    assert ev.accuracy(df).first().accuracy == pytest.approx(sum(a == b for a, b in zip(y, p)) / len(y))
    assert ev.f1_macro(df).first().f1_macro == pytest.approx(sum(v[2] for v in want.values()) / len(want))
    rep = {r.label: r for r in ev.classification_report(df).collect()}
    for c, (prec, rec, f1, sup) in want.items():
        r = rep[str(c)]
        assert (r.precision, r.recall, r.f1_score, r.support) == pytest.approx((prec, rec, f1, sup))
    assert rep["weighted avg"].f1_score == pytest.approx(sum(v[2] * v[3] for v in want.values()) / len(y))


def test_confusion_matrix_has_zero_rows(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (2, 2)], "label int, pred int")
    cm = {r.true_label: (r.negative, r.neutral, r.positive) for r in ev.confusion_matrix(df, MULTICLASS_ID2LABEL).collect()}
    assert cm == {"negative": (1, 0, 1), "neutral": (0, 0, 0), "positive": (0, 0, 1)}
    long = ev.confusion_long(ev.confusion_matrix(df, MULTICLASS_ID2LABEL))
    assert long.count() == 9 and long.filter("is_dark").count() == 3


def test_error_table_names(spark):
    df = spark.createDataFrame([("a", 0, 0), ("b", 2, 1), ("c", 5, 0)], "text string, label int, pred int")
    got = sorted(tuple(r) for r in ev.error_table(df, MULTICLASS_ID2LABEL).collect())
    assert got == [("b", 2, 1, "positive", "neutral"), ("c", 5, 0, "5", "negative")]


def test_softmax_argmax_and_loss(spark):
    import math

    df = spark.createDataFrame([(0, 2, [0.1, 0.4, 1.8]), (1, 0, [1.0, 1.0, 0.0])], "pos long, label int, logits array<double>")
    s = ev.scored_from_logits(df)
    rows = {r.pos: r for r in s.collect()}
    assert rows[0].pred == 2 and rows[1].pred == 0
    e = [math.exp(x) for x in (0.1, 0.4, 1.8)]
    assert rows[0].probs == pytest.approx([x / sum(e) for x in e])
    loss = ev.batched_log_loss(s, batch_size=1).first()
    want = (-math.log(e[2] / sum(e)) - math.log(math.e / (2 * math.e + 1))) / 2
    assert loss.loss == pytest.approx(want)


def test_best_epoch_first_on_ties_and_checkpoints(spark):
    hist = spark.createDataFrame(
        [(1.0, 0.5, 0.6), (2.0, 0.7, 0.71), (3.0, 0.7, 0.72), (4.0, 0.6, 0.65), (5.0, 0.8, 0.8), (6.0, 0.8, 0.9)],
        "epoch double, val_f1_macro double, val_accuracy double")
    b = ev.best_epoch(hist).first()
    assert (b.epoch, b.val_accuracy) == (5.0, 0.8)
    assert [r.epoch for r in ev.checkpoint_epochs(hist).orderBy("epoch").collect()] == [1.0, 2.0, 5.0]


def test_classes_outside_the_domain_keep_their_rows_and_columns(spark):
    df = spark.createDataFrame([(0, 0), (7, 1), (2, 9), (None, 1), (2, 2)], "label int, pred int")
    cm = ev.confusion_matrix(df, MULTICLASS_ID2LABEL)
    assert cm.columns == ["true_label", "negative", "neutral", "positive", "7", "9", "null"]
    rows = {r.true_label: r for r in cm.collect()}
    assert rows["7"].neutral == 1 and rows["positive"]["9"] == 1 and rows["null"].neutral == 1
    assert sum(sum(r[c] for c in cm.columns[1:]) for r in rows.values()) == 5
