"""Request validation (FLT8) shared by batch and streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revscope.constants import DEFAULT_TOP_K, MAX_TOP_K, MIN_QUESTION_CHARS, MIN_TEXT_CHARS


def validate_predict(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``text`` must have at least one character."""
    ok = F.coalesce(F.length(F.col(text_col)) >= MIN_TEXT_CHARS, F.lit(False))
    return df.withColumn("valid", ok).withColumn(
        "reason", F.when(~ok, F.lit(f"text must have at least {MIN_TEXT_CHARS} character")))


def validate_ask(df: DataFrame, question_col: str = "question", top_k_col: str = "top_k") -> DataFrame:
    """``question`` ≥ 3 chars, ``1 ≤ top_k ≤ 20`` (null → default 5)."""
    top_k = F.coalesce(F.col(top_k_col).cast("int"), F.lit(DEFAULT_TOP_K))
    q_ok = F.coalesce(F.length(F.col(question_col)) >= MIN_QUESTION_CHARS, F.lit(False))
    k_ok = top_k.between(1, MAX_TOP_K)
    reason = (F.when(~q_ok, F.lit(f"question must have at least {MIN_QUESTION_CHARS} characters"))
              .when(~k_ok, F.lit(f"top_k must be between 1 and {MAX_TOP_K}")))
    return (df.withColumn(top_k_col, top_k)
            .withColumn("valid", q_ok & k_ok)
            .withColumn("reason", reason))
