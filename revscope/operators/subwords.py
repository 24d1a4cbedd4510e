"""Sub-word token ids by a public vocabulary file (FEA5).

The file is a parameter (a ``tokenizers`` JSON file that every executor can
read); nothing is trained or downloaded here. Encoding is one row-wise pass:
no shuffle, every row on its own whatever its id, so it works on streams, too.
A worker opens the file once and encodes slices of texts of a bounded size together.

Defined cases: a null text has the special ids alone; strings of special tokens
inside a text are plain text; ids are cut to ``max_length`` with the special
ids counted; empty tables stay empty; other columns are carried along.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revscope.operators.features import slices


@cache
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def encode_subwords(docs: DataFrame, vocabulary: str, max_length: int | None = 256, text_col: str = "text",
                    start_id: int | None = None, end_id: int | None = None) -> DataFrame:
    """The rows with input_ids and attention_mask; ``start_id`` and ``end_id`` are put around the ids of the text."""
    head, tail = ([x] if x is not None else [] for x in (start_id, end_id))
    room = None if max_length is None else max_length - len(head) - len(tail)
    if room is not None and room < 0:
        raise ValueError("max_length has no room for the special ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(vocabulary)
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
                ids = [[*head, *e.ids[:room], *tail] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, kind), pa.array([[1] * len(i) for i in ids], kind)],
                                                 [*part.schema.names[:-1], "input_ids", "attention_mask"])

    kind = T.ArrayType(T.IntegerType())
    schema = T.StructType([*docs.schema.fields, T.StructField("input_ids", kind), T.StructField("attention_mask", kind)])
    return docs.withColumn("_text", F.col(text_col).cast("string")).mapInArrow(run, schema)


def decode_subwords(rows: DataFrame, vocabulary: str, ids_col: str = "input_ids", out_col: str = "decoded") -> DataFrame:
    """The text that ids stand for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(vocabulary)
        for batch in batches:
            for part in slices(batch):
                texts = tokenizer.decode_batch([i or [] for i in part.column(part.num_columns - 1).to_pylist()], skip_special_tokens=False)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*part.schema.names[:-1], out_col])

    schema = T.StructType([*rows.schema.fields, T.StructField(out_col, T.StringType())])
    return rows.withColumn("_ids", F.col(ids_col)).mapInArrow(run, schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
