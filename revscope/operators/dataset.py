"""Dataset preparation (SRC1 check, PRJ1-PRJ3, PRJ5, FLT1, SET1, WIN5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revscope.constants import LABEL_MODES
from revscope.functions.text import clean_text

REVIEW_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("label", T.LongType()),
    T.StructField("label_text", T.StringType()),
    T.StructField("split", T.StringType()),
])
SPLITS = ("train", "validation", "test")


def check_review_shape(df: DataFrame) -> DataFrame:
    """SRC1: reject a table that is not a labelled split collection."""
    missing = [c for c in ("text", "label", "split") if c not in df.columns]
    if missing:
        raise ValueError(f"not a review split collection, missing columns: {missing}")
    return df


def load_reviews(df: DataFrame) -> DataFrame:
    """SRC1: the review columns in their fixed order."""
    check_review_shape(df)
    return df.select(*[f.name for f in REVIEW_SCHEMA if f.name in df.columns])


def prepare_classification(df: DataFrame, keep_label_text: bool = False,
                           text_col: str = "text") -> DataFrame:
    """PRJ1: drop id (and label_text unless kept), clean text; text, label[, label_text]."""
    cols = [clean_text(text_col).alias("text"), F.col("label")]
    if keep_label_text and "label_text" in df.columns:
        cols.append(F.col("label_text"))
    return df.select(*cols)


def split_frame(df: DataFrame, split: str, clean: bool = False) -> DataFrame:
    """PRJ2: one split; the cleaned variant is a new plan, the input is untouched."""
    out = df.filter(F.col("split") == split)
    return out.withColumn("text", clean_text("text")) if clean else out


def label_view(df: DataFrame, label_mode: str, text_col: str = "text",
               label_col: str = "label", keep: tuple[str, ...] = ()) -> DataFrame:
    """FLT1: multiclass as is; binary drops neutral (1) and maps 2→1, else→0.

    The filter sits below the cleaning projection, so neutral rows are never
    cleaned (and the filter reaches the scan when the label is stored).
    """
    if label_mode not in LABEL_MODES:
        raise ValueError(f"unknown label mode, expected one of {LABEL_MODES}")
    lab = F.col(label_col).cast("int")
    if label_mode == "binary_polarity":
        df = df.filter(lab != 1)
        lab = F.when(lab == 2, F.lit(1)).otherwise(F.lit(0))
    return df.select(*[F.col(k) for k in keep], clean_text(text_col).alias("text"),
                     lab.alias("label"))


def tokenizer_inputs(df: DataFrame, keep_label_text: bool = False, keep_text: bool = False) -> DataFrame:
    """PRJ3: keep model columns and rename label → labels."""
    cols = [c for c in ("input_ids", "attention_mask", "label") if c in df.columns]
    if keep_label_text and "label_text" in df.columns:
        cols.append("label_text")
    if keep_text and "text" in df.columns:
        cols.insert(0, "text")
    return df.select(*cols).withColumnRenamed("label", "labels")


def corpus_records(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """PRJ5 + SET1: the columns in ``keep``, cleaned text, label id, label name (or its string), split."""
    name = (F.coalesce(F.col("label_text"), F.col("label").cast("string"))
            if "label_text" in df.columns else F.col("label").cast("string"))
    return df.select(*keep, clean_text("text").alias("text"), F.col("label").cast("int").alias("label_id"),
                     name.alias("label"), F.col("split"))


def union_splits(frames: dict[str, DataFrame]) -> DataFrame:
    """SET1: concatenate per-split frames with a split tag (UNION ALL)."""
    out = None
    for split, frame in frames.items():
        tagged = frame.withColumn("split", F.lit(split))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def global_row_ids(df: DataFrame, order_cols: tuple[str, ...] = ("id",), split_col: str = "split",
                   split_order: tuple[str, ...] = SPLITS) -> DataFrame:
    """WIN5: consecutive row ids in (split order, order columns) order.

    Rows are range-partitioned on the order, whatever its types and however
    its values are spread, sorted inside the partitions and written once; a
    row's id is its place in its partition plus the rows of the partitions
    before it (one number for each partition).
    """
    split_ord = F.lit(len(split_order))
    for i, s in reversed(list(enumerate(split_order))):
        split_ord = F.when(F.col(split_col) == s, F.lit(i)).otherwise(split_ord)
    order = ["_split_ord", *order_cols]
    placed = (df.withColumn("_split_ord", split_ord).repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_part", F.spark_partition_id())
              # the lower 33 bits number the rows of a partition
              .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
              .drop("_split_ord").checkpoint(eager=True))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    return (placed.join(F.broadcast(offsets), "_part")  # one row for each partition
            .withColumn("row_id", (F.col("_offset") + F.col("_place")).cast("long")).drop("_part", "_place", "_offset"))
