"""Readers and writers (SRC1-SRC10, SNK1-SNK8).

Distributed tables are written with Spark writers (Parquet/JSON/CSV, one file
per task). Only artifacts that are a handful of rows by construction (a
confusion matrix, a metadata record) are written as one file; nothing
row-sized passes through the driver.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revscope.operators.dataset import SPLITS, check_review_shape, load_reviews
from revscope.sources import commits

RECORD_SCHEMA = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("label_id", T.IntegerType()),
    T.StructField("label", T.StringType()),
    T.StructField("split", T.StringType()),
])
RAW_SPLIT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("label", T.LongType()),
    T.StructField("label_text", T.StringType()),
])
F1_ENTRY = T.StructType([
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1-score", T.DoubleType()),
    T.StructField("support", T.DoubleType()),
])
METRICS_SCHEMA = T.StructType([
    T.StructField("task", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("f1_macro", T.DoubleType()),
    T.StructField("report_dict", T.MapType(T.StringType(), F1_ENTRY)),
])


# ---- sources ------------------------------------------------------------------------------

def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: the materialised split collection (Parquet, partitioned by split);
    the table's own columns are checked, not those of an imposed schema."""
    return load_reviews(spark.read.parquet(path))


def read_jsonl_splits(spark: SparkSession, base_dir: str, splits=SPLITS) -> DataFrame:
    """SRC2/SRC4: line-delimited records, one file per split; the split comes
    from the file name. Blank lines are skipped by the JSON reader."""
    paths = [os.path.join(base_dir, f"{s}.jsonl") for s in splits]
    df = spark.read.schema(RAW_SPLIT_SCHEMA).json(paths)
    split = F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl$", 1)
    return df.withColumn("split", split)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: stored review records."""
    return spark.read.schema(RECORD_SCHEMA).json(path)


def ingest_or_reuse(spark: SparkSession, table_path: str, load_source, force: bool = False) -> DataFrame:
    """SRC3 + SNK1: reuse the materialised table unless forced; otherwise read
    the source and write it partitioned by split. A folder that a killed write
    left, without the mark of a finished job, is written anew."""
    if not force and commits.finished(spark, table_path):
        return read_reviews(spark, table_path)
    src = check_review_shape(load_source())
    write_dataset(src, table_path)
    return read_reviews(spark, table_path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def _run_name(file: str) -> F.Column:
    """The run folder of an artifact, be it one file or a folder of that name."""
    return F.regexp_extract(F.input_file_name(), rf"/([^/]+)/{file}(?:/[^/]*)?$", 1)


def read_run_metrics(spark: SparkSession, runs_dir: str) -> DataFrame:
    """SRC5: one metrics.json per run directory; the run name is its folder."""
    df = spark.read.schema(METRICS_SCHEMA).option("multiLine", True).json(os.path.join(runs_dir, "*", "metrics.json"))
    return df.withColumn("model", _run_name("metrics.json")).withColumnRenamed("report_dict", "report")


def read_run_metadata(spark: SparkSession, runs_dir: str) -> DataFrame:
    """SRC7 input: model metadata (label_mode) per run directory."""
    schema = "label_mode string, model_family string"
    df = spark.read.schema(schema).option("multiLine", True).json(os.path.join(runs_dir, "*", "model_metadata.json"))
    return df.withColumn("model", _run_name("model_metadata.json")).select("model", "label_mode")


def read_fallback(spark: SparkSession, path: str | None) -> DataFrame:
    """SRC6: ``{model: {source?, task?, accuracy, f1_macro}}``; absent → empty;
    a non-object document or entry → ValueError."""
    schema = "model string, source string, task string, accuracy double, f1_macro double"
    if path is None or not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    whole = spark.read.text(path, wholetext=True)
    kind = whole.select(F.expr("schema_of_variant(parse_json(value))").alias("t")).first()["t"]
    if not kind.startswith("OBJECT"):
        raise ValueError("the fallback file must hold one JSON object with an entry per model")
    entries = whole.selectExpr("explode(cast(parse_json(value) AS map<string, variant>)) AS (model, v)")
    bad = entries.filter(~F.expr("schema_of_variant(v)").startswith("OBJECT")).select("model").limit(1).collect()
    if bad:
        raise ValueError(f"the fallback entry of {bad[0]['model']} is not a JSON object")
    return entries.select(
        "model",
        F.expr("try_variant_get(v, '$.source', 'string')").alias("source"),
        F.expr("try_variant_get(v, '$.task', 'string')").alias("task"),
        F.expr("try_variant_get(v, '$.accuracy', 'double')").alias("accuracy"),
        F.expr("try_variant_get(v, '$.f1_macro', 'double')").alias("f1_macro"))


def read_confusion_csv(spark: SparkSession, path: str, labels: list[str]) -> DataFrame:
    """SRC8: confusion matrix CSV whose first column is the row label."""
    schema = T.StructType([T.StructField("true_label", T.StringType())]
                          + [T.StructField(n, T.LongType()) for n in labels])
    return spark.read.option("header", True).schema(schema).csv(path)


def read_comparison_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC8: comparison table CSV."""
    schema = ("model string, artifacts_dir string, task string, source string, accuracy double, f1_macro double, "
              "f1_negative double, f1_neutral double, f1_positive double, rank int")
    return spark.read.option("header", True).schema(schema).csv(path)


# ---- sinks --------------------------------------------------------------------------------

def write_dataset(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK1: the split collection, partitioned by split."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def write_records(df: DataFrame, path: str) -> None:
    """SNK2: review records as JSON lines (UTF-8, not escaped)."""
    df.select("text", "label_id", "label", "split").write.mode("overwrite").json(path)


def write_small_json(spark: SparkSession, obj: dict, path: str) -> None:
    """A one-record JSON artifact (metadata, summaries), written by Spark."""
    rdd_free = spark.createDataFrame([(json.dumps(obj, ensure_ascii=False),)], "value string")
    rdd_free.coalesce(1).write.mode("overwrite").text(path)


def read_small_json(spark: SparkSession, path: str) -> dict:
    row = spark.read.text(path, wholetext=True).first()
    return json.loads(row["value"]) if row else {}


def write_evaluation_artifacts(out_dir: str, *, task: str, metrics: DataFrame, confusion: DataFrame,
                               errors: DataFrame, report: DataFrame) -> None:
    """SNK3: errors as a distributed CSV; the few-row tables as single files.

    ``metrics.json`` is the record of the test split with its per-class
    report; the other splits' metrics go to ``split_metrics``."""
    errors.write.mode("overwrite").option("header", True).csv(os.path.join(out_dir, "errors"))
    confusion.coalesce(1).write.mode("overwrite").option("header", True).csv(os.path.join(out_dir, "confusion_matrix"))
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(os.path.join(out_dir, "classification_report"))
    lines = report.orderBy("label").select(F.format_string("%-14s %9.4f %9.4f %9.4f %9d", "label", "precision", "recall", "f1_score", "support").alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(os.path.join(out_dir, "classification_report.txt"))
    entry = F.struct("precision", "recall", F.col("f1_score").alias("f1-score"), F.col("support").cast("double").alias("support"))
    by_label = report.agg(F.map_from_entries(F.collect_list(F.struct("label", entry))).alias("report_dict"))
    test = metrics.filter(F.col("split") == "test").select("accuracy", "f1_macro").first()  # two numbers
    record = by_label.select(F.lit(task).alias("task"), *[F.lit(test[c] if test else None).cast("double").alias(c) for c in ("accuracy", "f1_macro")],
                             "report_dict")
    record.coalesce(1).write.mode("overwrite").json(os.path.join(out_dir, "metrics.json"))
    metrics.coalesce(1).write.mode("overwrite").json(os.path.join(out_dir, "split_metrics"))


def write_comparison(out_dir: str, rows: DataFrame, summary: DataFrame, report_lines: DataFrame) -> None:
    """SNK4: comparison CSV, JSON ``{summary, rows}`` and the text report."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(os.path.join(out_dir, "model_comparison_csv"))
    packed = summary.withColumn("_g", F.lit(0)).join(
        rows.groupBy(F.lit(0).alias("_g")).agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("rows")),
        "_g").drop("_g")
    packed.select(F.struct(*[c for c in summary.columns]).alias("summary"), "rows") \
        .coalesce(1).write.mode("overwrite").json(os.path.join(out_dir, "model_comparison_json"))
    report_lines.coalesce(1).write.mode("overwrite").text(os.path.join(out_dir, "model_comparison_txt"))


def write_index(index, path: str, meta: dict) -> None:
    """SNK5: write rows, tiles and label table to new folders, then publish
    them as the next version; a reader sees the old index or the new one."""
    spark = index.rows.sparkSession
    last = commits.latest(spark, path)
    parts = {}
    for table, frame in (("rows", index.rows), ("tiles", index.tiles), ("labels", index.labels)):
        parts[table] = [commits.new_folder(table)]
        frame.write.parquet(os.path.join(path, parts[table][0]))
    size = spark.read.parquet(os.path.join(path, parts["rows"][0])).count()
    record = {"vector_store": "parquet", **meta, "size": size, "schema": index.rows.schema.jsonValue()}
    commits.publish(spark, path, parts, record, last.number if last else 0)


def read_index(spark: SparkSession, path: str):
    """SRC9: open the last version of an index; fail unless rows, tiles and labels all exist."""
    from revscope.operators import retrieval

    v = commits.latest(spark, path)
    if v is None:
        raise FileNotFoundError(f"no complete index at {path}: no version has been published")
    missing = [t for t, (folder,) in v.parts.items() if not commits.finished(spark, os.path.join(path, folder))]
    if missing:
        raise FileNotFoundError(f"no complete index at {path}: {', '.join(missing)} not there")

    def table(name: str, schema) -> DataFrame:
        return spark.read.schema(schema).parquet(os.path.join(path, v.parts[name][0]))

    return retrieval.VectorIndex(rows=table("rows", T.StructType.fromJson(v.meta["schema"])), tiles=table("tiles", retrieval.TILE_SCHEMA),
                                 labels=table("labels", retrieval.LABEL_SCHEMA), metadata={**v.meta, "version": v.number})


def write_history(history: DataFrame, path: str, config: dict | None = None) -> None:
    """SNK7: training history table, and the run's configuration beside it."""
    history.coalesce(1).write.mode("overwrite").json(path)
    if config is not None:
        write_small_json(history.sparkSession, config, path.rstrip("/") + "_config.json")


def append_run_log(long_log: DataFrame, path: str, enabled: bool = True, run_id: str | None = None) -> str | None:
    """SNK8: add a run to the flattened log; a no-op when tracking is off.

    A run is the folder of its id: logged again, by a retried job, it replaces
    its own rows. Without an id it gets a new one, which is returned."""
    if not enabled:
        return None
    run = run_id or uuid.uuid4().hex
    if not run.replace("-", "").replace("_", "").isalnum():
        raise ValueError("a run id is made of letters, digits, - and _")
    long_log.write.mode("overwrite").parquet(os.path.join(path, f"run={run}"))
    return run


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all runs, with their run id."""
    runs = [n for n in commits.names(spark, path) if n.startswith("run=") and commits.finished(spark, os.path.join(path, n))]
    schema = "model string, kind string, key string, value string, num double, run string"
    if not runs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*[os.path.join(path, n) for n in runs])
