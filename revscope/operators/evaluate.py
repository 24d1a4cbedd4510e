"""Evaluation of predictions (AGG5-AGG8, AGG14, AGG16, WIN6, FLT3, PRJ4, JOIN1,
JOIN2, SET3, EVL1, MTH2).

All metrics come from one grouped pass over ``(class, is_true, is_pred)``
pairs: each prediction row contributes two small records (its true class
and its predicted class) via ``explode`` of a two-element array, so there is
no union scan and the aggregation combines partially on the map side. The
per-class table has one row per class (and per ``by`` group), so every later
step works on a tiny table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revscope.functions.vector import argmax, softmax


def class_counts(df: DataFrame, true_col: str = "label", pred_col: str = "pred",
                 by: list[str] | None = None, weight_col: str | None = None) -> DataFrame:
    """Per class: support (true count), predicted count and true positives.

    Classes are the union of labels seen in truth or prediction (SET3). With
    ``weight_col`` a row stands for that many.
    """
    by = by or []
    t, p = F.col(true_col).cast("int"), F.col(pred_col).cast("int")
    w = F.col(weight_col) if weight_col else F.lit(1)
    zero = F.lit(0).cast("long")
    w = w.cast("long")
    pairs = F.array(
        F.struct(t.alias("cls"), w.alias("s"), F.when(t == p, w).otherwise(zero).alias("tp"), zero.alias("pc")),
        F.struct(p.alias("cls"), zero.alias("s"), zero.alias("tp"), w.alias("pc")),
    )
    exploded = df.select(*by, F.explode(pairs).alias("e"))
    return (exploded.groupBy(*by, F.col("e.cls").alias("cls"))
            .agg(F.sum("e.s").cast("long").alias("support"),
                 F.sum("e.pc").cast("long").alias("predicted"),
                 F.sum("e.tp").cast("long").alias("tp")))


def per_class_scores(counts: DataFrame) -> DataFrame:
    """precision, recall, F1 with zero_division=0."""
    tp, sup, pc = F.col("tp"), F.col("support"), F.col("predicted")
    prec = F.when(pc > 0, tp / pc).otherwise(F.lit(0.0))
    rec = F.when(sup > 0, tp / sup).otherwise(F.lit(0.0))
    f1 = F.when(sup + pc > 0, 2 * tp / (sup + pc)).otherwise(F.lit(0.0))
    return counts.withColumn("precision", prec).withColumn("recall", rec).withColumn("f1", f1)


def accuracy(df: DataFrame, true_col: str = "label", pred_col: str = "pred",
             by: list[str] | None = None) -> DataFrame:
    """AGG5."""
    by = by or []
    acc = F.avg((F.col(true_col) == F.col(pred_col)).cast("double")).alias("accuracy")
    return df.groupBy(*by).agg(acc) if by else df.agg(acc)


def f1_macro(df: DataFrame, true_col: str = "label", pred_col: str = "pred",
             by: list[str] | None = None) -> DataFrame:
    """AGG6: unweighted mean of per-class F1 over the classes seen."""
    by = by or []
    scores = per_class_scores(class_counts(df, true_col, pred_col, by))
    agg = F.avg("f1").alias("f1_macro")
    return scores.groupBy(*by).agg(agg) if by else scores.agg(agg)


def classification_report(df: DataFrame, true_col: str = "label", pred_col: str = "pred",
                          by: list[str] | None = None) -> DataFrame:
    """AGG7: per-class rows plus 'accuracy', 'macro avg', 'weighted avg'.

    Columns: label (string key), precision, recall, f1_score, support. The
    accuracy row carries the accuracy in f1_score and null precision/recall.
    """
    by = by or []
    s = per_class_scores(class_counts(df, true_col, pred_col, by))
    per_class = s.select(*by, F.col("cls").cast("string").alias("label"), "precision", "recall",
                         F.col("f1").alias("f1_score"), "support")
    tot = s.groupBy(*by).agg(
        F.sum("support").alias("n"), F.sum("tp").alias("tp_all"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"),
        F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1") * F.col("support")).alias("wf"),
    ) if by else s.agg(
        F.sum("support").alias("n"), F.sum("tp").alias("tp_all"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"),
        F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1") * F.col("support")).alias("wf"),
    )
    n = F.col("n")
    summary = tot.select(*by, F.explode(F.array(
        F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), (F.col("tp_all") / n).alias("f1_score"),
                 n.alias("support")),
        F.struct(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1_score"), n.alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), (F.col("wp") / n).alias("precision"),
                 (F.col("wr") / n).alias("recall"), (F.col("wf") / n).alias("f1_score"), n.alias("support")),
    )).alias("r")).select(*by, "r.*")
    return per_class.unionByName(summary)


def id2label_frame(spark: SparkSession, id2label: dict[int, str]) -> DataFrame:
    return spark.createDataFrame([(int(k), str(v)) for k, v in sorted(id2label.items())],
                                 "label_id int, label_name string")


def attach_label_names(df: DataFrame, id_col: str, dim: DataFrame, out_col: str) -> DataFrame:
    """PRJ4 / JOIN2: id → name by a broadcast lookup; unknown id → str(id).

    The dimension is a label map (a handful of rows), so broadcasting it is
    bounded by construction.
    """
    d = dim.select(F.col("label_id").alias("_lid"), F.col("label_name").alias("_lname"))
    out = df.join(F.broadcast(d), F.col(id_col) == F.col("_lid"), "left")
    return out.withColumn(out_col, F.coalesce(F.col("_lname"), F.col(id_col).cast("string"))) \
        .drop("_lid", "_lname")


def confusion_matrix(df: DataFrame, id2label: dict[int, str], true_col: str = "label",
                     pred_col: str = "pred") -> DataFrame:
    """AGG8: rows = truth, columns = prediction, over the label domain.

    Counts are aggregated first (a tiny table), then pivoted with an explicit
    domain. Classes that never occur get zero rows and columns; classes
    outside the domain get rows and columns of their own, named by their id
    (``null`` for none), so every input row is counted.
    """
    spark = df.sparkSession
    pairs = (df.groupBy(F.col(true_col).cast("int").cast("string").alias("t"), F.col(pred_col).cast("int").cast("string").alias("p")).count()
             .na.fill("null", ["t", "p"]).checkpoint(eager=True))
    seen = {r[0] for r in pairs.select("t").union(pairs.select("p")).distinct().collect()}  # one row per class
    domain = [(str(i), id2label[i]) for i in sorted(id2label)]
    domain += [(c, c) for c in sorted(seen - {i for i, _ in domain}, key=lambda c: (c == "null", len(c), c))]
    piv = pairs.groupBy("t").pivot("p", [i for i, _ in domain]).agg(F.first("count"))
    out = spark.createDataFrame(domain, "t string, true_label string").join(piv, "t", "left")
    return out.select("true_label", *[F.coalesce(F.col(f"`{i}`"), F.lit(0)).cast("long").alias(n) for i, n in domain])


def confusion_long(confusion: DataFrame, label_col: str = "true_label") -> DataFrame:
    """RPT2: melt to (true, pred, n, is_dark = n > max/2)."""
    value_cols = [c for c in confusion.columns if c != label_col]
    long = confusion.unpivot([label_col], value_cols, "pred_label", "n") \
        .withColumnRenamed(label_col, "true_label")
    # max over the 9-cell matrix: a window over the aggregated table only
    return long.withColumn("is_dark", F.col("n") > F.max("n").over(Window.partitionBy()) / 2)


def error_table(df: DataFrame, id2label: dict[int, str] | None, text_col: str = "text",
                true_col: str = "label", pred_col: str = "pred", keep: tuple[str, ...] = ()) -> DataFrame:
    """FLT3: misclassified rows with both label names."""
    spark = df.sparkSession
    errs = df.filter(F.col(true_col) != F.col(pred_col)).select(
        *keep, F.col(text_col).alias("text"), F.col(true_col).cast("int").alias("true_label"),
        F.col(pred_col).cast("int").alias("pred_label"))
    if not id2label:
        return errs.withColumn("true_label_text", F.col("true_label").cast("string")) \
            .withColumn("pred_label_text", F.col("pred_label").cast("string"))
    dim = id2label_frame(spark, id2label)
    errs = attach_label_names(errs, "true_label", dim, "true_label_text")
    return attach_label_names(errs, "pred_label", dim, "pred_label_text")


def scored_from_logits(df: DataFrame, logits_col: str = "logits") -> DataFrame:
    """MTH2: soft-max probabilities and arg-max prediction."""
    return df.withColumn("probs", softmax(logits_col)).withColumn("pred", argmax(logits_col))


#: The loss of a probability of 0, as binary cross-entropy clamps its logarithms.
MAX_LOSS = 100.0


def batched_log_loss(df: DataFrame, probs_col: str = "probs", label_col: str = "label",
                     pos_col: str = "pos", batch_size: int = 16, by: list[str] | None = None) -> DataFrame:
    """AGG14: mean of per-batch mean cross-entropy (a short last batch weighs
    the same as a full one) and the plain row mean.

    ``pos`` is the dense 0-based position in evaluation order. A true class of
    probability 0 costs ``MAX_LOSS``; a row without a probability for its
    label has no loss and counts in no mean.
    """
    by = by or []
    p = F.try_element_at(F.col(probs_col), F.col(label_col).cast("int") + 1)
    ce = F.when(p > 0, F.least(-F.log(p), F.lit(MAX_LOSS))).when(p.isNotNull(), F.lit(MAX_LOSS))
    rows = df.select(*by, F.floor(F.col(pos_col) / batch_size).alias("batch"), ce.alias("ce"))
    per_batch = rows.groupBy(*by, "batch").agg(F.avg("ce").alias("b"), F.sum("ce").alias("s"),
                                               F.count("ce").alias("c"))
    aggs = [F.avg("b").alias("loss"), (F.sum("s") / F.sum("c")).alias("row_mean_loss"),
            F.count(F.lit(1)).alias("batches")]
    return per_batch.groupBy(*by).agg(*aggs) if by else per_batch.agg(*aggs)


def best_epoch(history: DataFrame, metric: str = "val_f1_macro") -> DataFrame:
    """AGG16: highest metric, first epoch on ties, with its accuracy."""
    best = F.max_by(F.struct("epoch", metric, "val_accuracy"),
                    F.struct(F.col(metric), -F.col("epoch")))
    return history.agg(best.alias("b")).select("b.*")


def checkpoint_epochs(history: DataFrame, metric: str = "val_f1_macro") -> DataFrame:
    """WIN6: epochs whose metric beats every earlier epoch (a checkpoint save).

    The history is one row per epoch, so the ordered window is tiny.
    """
    w = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.max(metric).over(w)
    return history.withColumn("prev_best", prev) \
        .filter(F.col("prev_best").isNull() | (F.col(metric) > F.col("prev_best"))) \
        .select("epoch", metric)


def _one_row(df: DataFrame) -> DataFrame:
    return df.withColumn("_g", F.lit(0))


def evaluate_epoch(scored: DataFrame, probs_col: str = "probs", label_col: str = "label",
                   pred_col: str = "pred", pos_col: str = "pos", batch_size: int = 16) -> DataFrame:
    """EVL1: batched loss, accuracy and macro F1 of a scored set in one row.

    Each metric is a grouped aggregate ending in one row; the three rows are
    joined on a constant key (1-row broadcast hash joins).
    """
    loss = batched_log_loss(scored, probs_col, label_col, pos_col, batch_size).select("loss")
    acc = accuracy(scored, label_col, pred_col)
    f1 = f1_macro(scored, label_col, pred_col)
    out = _one_row(loss).join(F.broadcast(_one_row(acc)), "_g").join(F.broadcast(_one_row(f1)), "_g")
    return out.drop("_g")
