"""Views over the driver's testdata tables.

The testdata carries no review corpus, so the engine's operators run over
views derived from it. Each view is a lazy DataFrame; Catalyst prunes the
columns an operator does not use and pushes its filters into the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revscope.constants import MULTICLASS_ID2LABEL
from revscope.functions.text import clean_text
from revscope.session import table_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def label_name(label) -> F.Column:
    """0/1/2 → negative/neutral/positive; anything else → its string."""
    expr = None
    for k, v in MULTICLASS_ID2LABEL.items():
        expr = F.when(label == k, F.lit(v)) if expr is None else expr.when(label == k, F.lit(v))
    return expr.otherwise(label.cast("string"))


def split_of(key) -> F.Column:
    """60/20/20 train/validation/test by key."""
    m = F.pmod(key, F.lit(5))
    return (F.when(m < 3, F.lit("train"))
            .when(m == 3, F.lit("validation"))
            .otherwise(F.lit("test")))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REVIEW rows: id, text, label (0 neg / 1 neu / 2 pos), label_text, split, source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    label = (F.when(F.col("toxic") == 1, F.lit(0))
             .when(F.col("quality") == 0, F.lit(1))
             .otherwise(F.lit(2))).cast("int")
    return (docs.join(labels, "doc_id")
            .select(F.col("doc_id").alias("id"), "text", label.alias("label"), "source")
            .withColumn("label_text", label_name(F.col("label")))
            .withColumn("split", split_of(F.col("id")))
            .select("id", "text", "label", "label_text", "split", "source"))


def all_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "documents")
            .select(F.col("doc_id").alias("id"), "text", "lang", "source")
            .withColumn("split", split_of(F.col("id"))))


def raw_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))


def predicted_label(id_col, label_col) -> F.Column:
    """Deterministic stand-in for a model's output (exact oracle possible)."""
    return (F.when(F.pmod(id_col, F.lit(7)) == 0, F.pmod(label_col + 1, F.lit(3)))
            .when(F.pmod(id_col, F.lit(11)) == 0, F.pmod(label_col + 2, F.lit(3)))
            .otherwise(label_col)).cast("int")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviews(spark, sf_dir)
    return r.withColumn("pred", predicted_label(F.col("id"), F.col("label")))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CORPUS rows: row_id, cleaned text, label_id, label, split, unit embedding."""
    emb = table(spark, sf_dir, "embeddings")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    label_id = F.pmod(F.col("label"), F.lit(3)).cast("int")
    return (emb.join(docs, emb.vec_id == docs.doc_id, "left")  # an embedding without a document has no text
            .select(F.col("vec_id").alias("row_id"),
                    clean_text(F.col("text")).alias("text"),
                    label_id.alias("label_id"),
                    label_name(label_id).alias("label"),
                    split_of(F.col("vec_id")).alias("split"),
                    F.col("embedding")))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding row asks for its neighbours: q_id, question, q_vec, focus.

    focus cycles negative / positive / 'missing' (a label no corpus row has,
    which exercises the fallback) / null (no focus).
    """
    emb = table(spark, sf_dir, "embeddings")
    m = F.pmod(F.col("vec_id"), F.lit(4))
    focus = (F.when(m == 0, F.lit("negative")).when(m == 1, F.lit("positive"))
             .when(m == 2, F.lit("missing")).otherwise(F.lit(None).cast("string")))
    return emb.select(
        F.col("vec_id").alias("q_id"),
        F.concat(F.lit("Which reviews resemble item "), F.col("vec_id").cast("string"),
                 F.lit("?")).alias("question"),
        F.col("embedding").alias("q_vec"),
        focus.alias("focus"),
    )


def question_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    return (conv.filter(F.col("role") == "user")
            .select("conv_id", "turn", F.col("text").alias("question")))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scored evaluation set: 3 logits per embedding row (the scaled sums of
    its components by position modulo 3), true label ``label % 3``, dense
    position ``vec_id``."""
    emb = table(spark, sf_dir, "embeddings")

    def logit(j):
        own = F.filter("embedding", lambda x, i: F.pmod(i, F.lit(3)) == j)
        return F.aggregate(own, F.lit(0.0), lambda s, x: s + x.cast("double")) * 10.0

    return emb.select(
        F.col("vec_id").alias("pos"),
        F.pmod(F.col("label"), F.lit(3)).cast("int").alias("label"),
        F.array(*[logit(j) for j in range(3)]).alias("logits"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An epoch history derived from the predictions: six 'epochs' (id % 6),
    losses and accuracy per epoch, macro F1 rounded to one place so that
    exact ties occur."""
    p = predictions(spark, sf_dir)
    diff = (F.col("label") - F.col("pred")).cast("double")
    return (p.groupBy((F.pmod(F.col("id"), F.lit(6)) + 1).cast("double").alias("epoch"))
            .agg(F.avg(F.abs(diff)).alias("train_loss"),
                 F.avg(diff * diff).alias("val_loss"),
                 F.avg((F.col("label") == F.col("pred")).cast("double")).alias("val_accuracy"))
            .withColumn("val_f1_macro", F.bround(F.col("val_accuracy"), 1)))
