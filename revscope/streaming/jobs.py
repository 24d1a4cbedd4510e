"""Structured Streaming jobs for the two request kinds (STM1-STM3).

Scoring is one row-wise plan: no shuffle, no ranking, native file sinks. Two
queries read the source, one for valid texts and one for rejected ones with
their reason; each file sink logs its batches, so a replayed batch adds nothing
and a restart goes on where the checkpoint stands.

Answering needs ranking windows, which are not allowed on a streaming plan, so
each micro-batch is handled in ``foreachBatch`` as a static DataFrame: valid
requests are answered and written to the result table, rejected ones to a
dead-letter table. There the checkpoint folder belongs to the result folders:
it numbers the batches, and a batch writes the sub-folder of its number. A
replayed batch replaces its own output; a job started again on the same folders
and checkpoint goes on with the next number and leaves earlier output alone.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revscope.operators import model as md
from revscope.operators import qa, retrieval
from revscope.operators.ask import ask
from revscope.operators.requests import validate_ask, validate_predict


def _batch_writer(out_dir: str, dead_dir: str, handle_valid):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            valid = batch.filter(F.col("valid")).drop("valid", "reason")
            bad = batch.filter(~F.col("valid"))
            handle_valid(valid).write.mode("overwrite").parquet(os.path.join(out_dir, f"batch={batch_id}"))
            bad.write.mode("overwrite").parquet(os.path.join(dead_dir, f"batch={batch_id}"))
        finally:
            batch.unpersist()
    return write


def _read(spark: SparkSession, source_dir: str, schema: str, glob: str | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(source_dir)


def _start(checked: DataFrame, out_dir: str, dead_dir: str, checkpoint_dir: str, handle_valid, available_now: bool):
    writer = (checked.writeStream.foreachBatch(_batch_writer(out_dir, dead_dir, handle_valid))
              .option("checkpointLocation", checkpoint_dir))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class Both:
    """Several streaming queries of one job, handled as one."""

    def __init__(self, *queries):
        self.queries = queries

    def awaitTermination(self, timeout: float | None = None) -> bool:  # noqa: N802 - as a streaming query's
        return all([q.awaitTermination(timeout) if timeout is not None else q.awaitTermination() or True for q in self.queries])

    def stop(self) -> None:
        for q in self.queries:
            q.stop()

    def processAllAvailable(self) -> None:  # noqa: N802
        for q in self.queries:
            q.processAllAvailable()

    @property
    def isActive(self) -> bool:  # noqa: N802
        return any(q.isActive for q in self.queries)

    def exception(self):
        return next((e for q in self.queries if (e := q.exception())), None)


def _append(rows: DataFrame, out_dir: str, checkpoint_dir: str, available_now: bool):
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", out_dir).option("checkpointLocation", checkpoint_dir)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_predict(spark: SparkSession, source_dir: str, schema: str, model: md.BaselineModel | None, *,
                   out_dir: str, dead_dir: str, checkpoint_dir: str, glob: str | None = None,
                   id_col: str = "id", text_col: str = "text", available_now: bool = True) -> Both:
    """STM1 + STM3: score a stream of texts; empty texts go to dead letters.

    A missing model fails the job before it starts (the 503 of the endpoint);
    so does one whose vocabulary is too large for a row-wise plan."""
    if model is None:
        raise FileNotFoundError("no scoring model is loaded")
    if max(model.sizes, default=0) > md.ROW_TERMS:
        raise ValueError(f"a stream is scored with at most {md.ROW_TERMS} terms a block")

    def checked() -> DataFrame:
        stream = _read(spark, source_dir, schema, glob).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        return validate_predict(stream, "text")

    valid = checked().filter("valid").drop("valid", "reason")
    return Both(_append(md.predict(model, valid, "text", keep=("id",)), out_dir, os.path.join(checkpoint_dir, "scored"), available_now),
                _append(checked().filter("NOT valid"), dead_dir, os.path.join(checkpoint_dir, "rejected"), available_now))


def stream_ask(spark: SparkSession, source_dir: str, schema: str, index: retrieval.VectorIndex | None, *,
               out_dir: str, dead_dir: str, checkpoint_dir: str, glob: str | None = None,
               encoder: retrieval.TextEncoder | None = None, config: qa.GeneratorConfig = qa.GeneratorConfig(),
               generator=None, available_now: bool = True, to_requests=None):
    """STM2 + STM3: answer a stream of requests (q_id, question, top_k and,
    where present, q_vec, focus, generation_mode) against a static index;
    invalid requests go to dead letters."""
    if index is None:
        raise FileNotFoundError("no retrieval index is loaded")
    raw = _read(spark, source_dir, schema, glob)
    return _start(validate_ask(to_requests(raw) if to_requests else raw), out_dir, dead_dir, checkpoint_dir,
                  lambda v: ask(v, index, encoder, config, generator), available_now)
