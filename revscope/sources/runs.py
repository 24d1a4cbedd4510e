"""Run tables for the comparison queries, derived from the testdata.

Every document ``source`` (src0, src1, …) stands for one configured model run
whose metrics are computed from the ``predictions`` view restricted to that
source, so the metric work grows with the data. Which runs have artifacts,
metadata or fallback metrics follows the run's ordinal:

* ord % 3 != 0 → artifact metrics; task in the metrics for ord % 4 == 1
  (binary_polarity) and ord % 4 == 2 (multiclass); metadata label_mode
  binary_polarity for ord % 4 == 3; nothing for ord % 4 == 0
* ord % 3 == 0 and even → fallback metrics (source 'previous_run' when
  ord % 4 == 0, else unset), no report
* ord % 3 == 0 and odd → missing
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revscope.operators import evaluate as ev
from revscope.sources import testdata as td


def _ord(c: str = "source") -> F.Column:
    return F.substring(F.col(c), 4, 100).cast("int")


def run_cells(spark: SparkSession, sf: str) -> DataFrame:
    """(model, ord, label, pred, n): documents of every source by true label
    and prediction, null where unlabelled. One pass over the tables, written
    once: every run table below is a few sums over these few rows."""
    docs = td.table(spark, sf, "documents").select("doc_id", F.col("source").alias("model"))
    labelled = td.predictions(spark, sf).select(F.col("id").alias("doc_id"), "label", "pred")
    return (docs.join(labelled, "doc_id", "left").groupBy("model", "label", "pred").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("ord", _ord("model")).checkpoint(eager=True))


def expected_runs(cells: DataFrame) -> DataFrame:
    return cells.select("model", "ord").distinct()


def _binary(ord_col) -> F.Column:
    m = F.pmod(ord_col, F.lit(4))
    return (m == 1) | (m == 3)


def metrics_from_predictions(p: DataFrame, binary_col: str = "binary") -> DataFrame:
    """Per run: accuracy, macro F1 and the per-class report map, computed on
    the run's task view (binary drops neutral truth and maps 2 → 1)."""
    b = F.col(binary_col)
    rows = p.filter(F.col("label").isNotNull() & (~b | (F.col("label") != 1))).select(
        "model", "n",
        F.when(b, (F.col("label") == 2).cast("int")).otherwise(F.col("label")).alias("y"),
        F.when(b, (F.col("pred") == 2).cast("int")).otherwise(F.col("pred")).alias("yp"))
    scores = ev.per_class_scores(ev.class_counts(rows, "y", "yp", by=["model"], weight_col="n"))
    # accuracy: true positives of all classes over their supports
    return scores.groupBy("model").agg(
        F.avg("f1").alias("f1_macro"),
        F.map_from_entries(F.collect_list(F.struct(
            F.col("cls").cast("string"),
            F.struct("precision", "recall", F.col("f1").alias("f1-score"), "support")))).alias("report"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"))


def run_metrics(cells: DataFrame) -> DataFrame:
    p = cells.filter(F.pmod(F.col("ord"), F.lit(3)) != 0).withColumn("binary", _binary(F.col("ord")))
    m = metrics_from_predictions(p).withColumn("ord", _ord("model"))
    k = F.pmod(F.col("ord"), F.lit(4))
    task = (F.when(k == 1, F.lit("binary_polarity")).when(k == 2, F.lit("multiclass"))
            .otherwise(F.lit(None).cast("string")))
    return m.select("model", task.alias("task"), "accuracy", "f1_macro", "report")


def run_metadata(cells: DataFrame) -> DataFrame:
    e = expected_runs(cells)
    k = F.pmod(F.col("ord"), F.lit(4))
    return (e.filter((F.pmod(F.col("ord"), F.lit(3)) != 0) & k.isin(2, 3))
            .select("model", F.when(k == 3, F.lit("binary_polarity")).otherwise(F.lit("multiclass"))
                    .alias("label_mode")))


def run_fallback(cells: DataFrame) -> DataFrame:
    p = cells.filter((F.pmod(F.col("ord"), F.lit(3)) == 0) & (F.pmod(F.col("ord"), F.lit(2)) == 0)).withColumn("binary", F.lit(False))
    m = metrics_from_predictions(p).withColumn("ord", _ord("model"))
    src = F.when(F.pmod(F.col("ord"), F.lit(4)) == 0, F.lit("previous_run")).otherwise(F.lit(None).cast("string"))
    return m.select("model", src.alias("source"), F.lit(None).cast("string").alias("task"),
                    "accuracy", "f1_macro")


def run_log_records(cells: DataFrame) -> DataFrame:
    """One params JSON and one metrics JSON per artifact run (nulls, nested
    values, booleans and text included to exercise the flattening)."""
    m = run_metrics(cells).withColumn("ord", _ord("model"))
    params = F.to_json(F.struct(
        F.lit("tfidf_logreg").alias("model_family"),
        F.col("model").alias("dataset_name"),
        F.lit(None).cast("int").alias("sample_size"),
        F.coalesce(F.col("task"), F.lit("multiclass")).alias("label_mode"),
        F.col("ord").alias("max_features"),
        F.lit(0.7).alias("regularization_c"),
        (F.pmod(F.col("ord"), F.lit(2)) == 0).alias("track_mlflow"),
        F.struct(F.concat(F.lit("artifacts/"), F.col("model")).alias("path")).alias("output_dir"),
    ), {"ignoreNullFields": "false"})
    metrics = F.to_json(F.struct(
        F.col("accuracy").alias("test_accuracy"),
        F.col("f1_macro").alias("test_f1_macro"),
        F.col("ord").alias("epochs"),
        (F.col("task") == "binary_polarity").alias("is_binary"),
        F.struct(F.col("accuracy").alias("accuracy")).alias("nested"),
        F.col("model").alias("note"),
    ), {"ignoreNullFields": "false"})
    return m.select("model", params.alias("params"), metrics.alias("metrics"))
