"""Vectors as checked rows and as matrix blocks, shared by the two searches.

Defined cases: a vector that is null or holds a null or non-finite component,
and a row with a null id, take no part. Where an id repeats, the smallest of
its vectors stands for it. Scores are taken between vectors of equal length
only. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and queries in one matrix block; they bound the memory of a task.
ROWS, QUERIES = 4096, 1024
BLOCK = "ids binary, matrix binary"


def points(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows that take part: id, v (array<double>), dim."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (df.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
            .filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)
            .groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))


def block_of(column: Column, count: Column) -> Column:
    return F.pmod(F.xxhash64(column), count)


def blocks(df: DataFrame, keys: list[str], kinds: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row for each group: its ids, its vectors as one matrix, and numeric columns as arrays (all binary).

    Groups are bounded by their keys, which hold a block number.
    """
    def gather(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy().astype("<i8")
        rows = table.column("v").combine_chunks()
        flat = rows.flatten().to_numpy(zero_copy_only=False).astype("<f8")
        more = [np.asarray(table.column(c).to_numpy()).astype("<f8").tobytes() for c in extra]
        found = [pa.array([k.as_py()], k.type) for k in key]
        return pa.Table.from_arrays(found + [pa.array([x], pa.binary()) for x in (ids.tobytes(), flat.tobytes(), *more)],
                                    [*keys, "ids", "matrix", *extra])

    schema = ", ".join([kinds, BLOCK, *[f"{c} binary" for c in extra]])
    return df.select(*keys, "id", "v", *extra).groupBy(*keys).applyInArrow(gather, schema)


def matrix(ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(data, "<f8").reshape(len(i), -1)


def over_pairs(pairs: DataFrame, columns: list[str], fn: Callable[..., pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``fn`` to each row of block pairs; it gets the columns' values and returns rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out = fn(*[batch.column(c)[i].as_py() for c in columns])
                if out is not None and out.num_rows:
                    yield out

    return pairs.select(*columns).mapInArrow(run, schema)


def best(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best of each row: largest score, ties to the smaller id."""
    order = np.lexsort((ids, -score, row))
    r = row[order]
    start = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    rank = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
    return order[rank < k]
