"""Named queries (Spark) and their DuckDB oracle SQL.

Every query takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
testdata views. Query modules register themselves on import.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from revscope.session import ensure_checkpoint_dir

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
HEADLINE: list[str] = []


def query(name: str, sql: str | None = None, headline: bool = False):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query name {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # written intermediates go to the session's shared checkpoint
            # folder; a session without one (tests, local runs) gets a scratch one
            ensure_checkpoint_dir(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        if headline:
            HEADLINE.append(name)
        return fn

    return deco


def load_all() -> None:
    from revscope.plans import (  # noqa: F401
        q_compare,
        q_evaluate,
        q_features,
        q_model,
        q_profile,
        q_retrieval,
        q_streaming,
        q_text,
    )
