"""Queries of the operators in this subpackage, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from revscope.llm import align, forest, htmlmain, infill, langid, mixing, neardup, packing, passages, suffix, topk, toxicity, warc
from revscope.session import ensure_checkpoint_dir

QueryFn = Callable[[SparkSession, str], DataFrame]


def _with_scratch(fn: QueryFn) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        return fn(spark, sf_dir)

    return run


def queries() -> dict[str, QueryFn]:
    found: dict[str, QueryFn] = {
        "op1_neardup": neardup.op1_neardup,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_forest": forest.op3_forest,
        "op4_warc": warc.op4_warc,
        "op5_topk": topk.op5_topk,
        "op6_html": htmlmain.op6_html,
        "op7_langid": langid.op7_langid,
        "op8_passages": passages.op8_passages,
        "op9_packing": packing.op9_packing,
        "op10_mixing": mixing.op10_mixing,
        "op11_align": align.op11_align,
        "op12_suffix": suffix.op12_suffix,
        "op13_infill": infill.op13_infill,
        "pipeline": corpus_pipeline.run,
    }
    return {name: _with_scratch(fn) for name, fn in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": warc.ORACLE_SQL, "op5_topk": topk.ORACLE_SQL, "op10_mixing": mixing.ORACLE_SQL,
            "op12_suffix": suffix.ORACLE_SQL, "op13_infill": infill.ORACLE_SQL}
